"""Running values over all rows of a key in order, with the key's rows spread over tasks.

A window by key holds all its rows in one task. Here rows are dealt in ranges of key and order (chunks), each chunk is scanned on its own, and
one row a key and chunk carries what lies before it: sums and last values are associative, so a scan over these few rows joins the parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import stored

CHUNK = "__chunk"


def chunked(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """`df`, stored, in ranges of keys and order (nulls first), whose number is __chunk. A hot key has several."""
    return stored(df.repartitionByRange(*keys, *order).withColumn(CHUNK, F.spark_partition_id()))


def _with_ends(df: DataFrame, ends: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Adds `names` of the chunk rows to the chunk's rows; null keys meet."""
    ends = ends.withColumnsRenamed({k: f"__{k}_" for k in [*keys, CHUNK]})
    cond = df[CHUNK] == ends[f"__{CHUNK}_"]
    for k in keys:
        cond = cond & df[k].eqNullSafe(ends[f"__{k}_"])
    return df.join(ends, cond, "left").drop(*[f"__{k}_" for k in [*keys, CHUNK]])


def running_sums(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column]) -> DataFrame:
    """Adds to a chunked table the sum of each value over the rows of the same keys up to each row."""
    ends = df.groupBy(*keys, CHUNK).agg(*[F.sum(v).alias(n) for n, v in values.items()])
    before = W.partitionBy(*keys).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select(*keys, CHUNK, *[F.sum(n).over(before).alias(f"__{n}_before") for n in values])
    upto = W.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = _with_ends(df.withColumns({n: F.sum(v).over(upto) for n, v in values.items()}), ends, keys, list(values))
    return out.withColumns({n: F.coalesce(n, F.lit(0)) + F.coalesce(f"__{n}_before", F.lit(0)) for n in values}).drop(*[f"__{n}_before" for n in values])


def running_least(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """A chunked table with `name` as its least value over the rows of the same keys up to each row."""
    ends = df.groupBy(*keys, CHUNK).agg(F.min(name).alias(name))
    before = W.partitionBy(*keys).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select(*keys, CHUNK, F.min(name).over(before).alias("__before")).where(F.col("__before").isNotNull())
    upto = W.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return _with_ends(df.withColumn(name, F.min(name).over(upto)), ends, keys, ["__before"]).withColumn(name, F.least(name, "__before")).drop("__before")


def last_values(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], inclusive: bool = True) -> DataFrame:
    """Adds to a chunked table the last value that is not null among the rows of the same keys up to each row, or before it."""
    place = F.struct(*order)
    ends = df.groupBy(*keys, CHUNK).agg(*[F.max_by(v, F.when(v.isNotNull(), place)).alias(n) for n, v in values.items()])
    before = W.partitionBy(*keys).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select(*keys, CHUNK, *[F.last(n, ignorenulls=True).over(before).alias(f"__{n}_before") for n in values])
    own = W.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    out = _with_ends(df.withColumns({n: F.last(v, ignorenulls=True).over(own) for n, v in values.items()}), ends, keys, list(values))
    return out.withColumns({n: F.coalesce(n, f"__{n}_before") for n in values}).drop(*[f"__{n}_before" for n in values])
