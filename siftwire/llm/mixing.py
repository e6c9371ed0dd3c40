"""Operator 10: systematic sampling of sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, ranked, small_join, stored, table


def targets(totals: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """`totals` (source, source_size): one row a source. Adds target: `share` of all sizes dealt by the weights (which
    repeat over the sources in code point order, null last), each at most `cap` times its source, the excess dealt
    again by weight. In order of cap/weight the first sources that their shares reach are full; the rest share one level."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    t = totals.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    ahead = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    t = t.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
    t = t.withColumn("cap0", F.coalesce(F.sum("cap").over(ahead), F.lit(0.0))).withColumn("w0", F.coalesce(F.sum("w").over(ahead), F.lit(0.0)))
    t = t.withColumn("full", F.col("cap") / F.col("w") <= (F.col("budget") - F.col("cap0")) / (F.sum("w").over(everything) - F.col("w0")))
    level = (F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(everything), F.lit(0.0))) / F.sum(F.when(~F.col("full"), F.col("w"))).over(everything)
    return t.withColumn("level", level).select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("level") * F.col("w")).alias("target"))


def offset(source) -> F.Column:
    """One pseudo-random offset in [0, 1) a source, the same in each run."""
    return F.conv(F.substring(F.md5(F.coalesce(source, F.lit("\x00null")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """Copies of each document so that each source's words come near its target.

    Within a source each document expects target/source_size copies. In the order of size, then md5 of the id, these
    are summed; a source's offset is added, and a document is emitted once for each integer crossed. Neighbours have
    like sizes, so a source misses its target by at most its longest document. Ranks come from sorted range partitions
    and their counts (no source is kept in one task). Null text: 0 words. A source without words has target 0 and takes
    no words. Repeated rows count as rows of their own; an empty table gives no rows; other columns are not read.

    Returns doc_id, size, source_size, target, taken, copies, and the column `row_col` (which tells repeated rows apart)."""
    text, own = F.coalesce(F.col(text_col), F.lit("")), [row_col] if row_col else []
    base = stored(docs.select(F.col(id_col).alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), *own))
    order = base.withColumn("h", F.md5(F.col("doc_id").cast("string").cast("binary")))
    rows = ranked(order, "source", "size", "h", "doc_id", *own).drop("h")
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("row").alias("first"))
    goal = targets(per.select("source", "source_size"), weights, share, cap)
    per = per.drop("source_size").withColumnRenamed("source", "s").join(goal, F.col("s").eqNullSafe(goal["source"])).drop("s")
    per = per.withColumn("e", F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))).withColumn("u", offset(F.col("source")))
    out = small_join(rows, per, ["source"])
    k = F.col("row") - F.col("first")
    copies = F.floor(F.col("e") * (k + 1) + F.col("u")) - F.floor(F.col("e") * k + F.col("u"))
    out = out.withColumn("copies", F.least(copies, F.lit(int(cap))).cast("long"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", *own)


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


SQL = r"""
with b as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size from documents),
s as (select source, cast(sum(size) as bigint) as source_size from b group by source),
w as (select *, [5.0::double, 2.0::double, 1.0::double][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as w, source_size * 2.0::double as cap from s),
a as (select *, sum(source_size) over () * 1.5::double as budget, sum(w) over () as ws,
      coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0.0) as cap0,
      coalesce(sum(w) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0.0) as w0 from w),
f as (select *, cap / w <= (budget - cap0) / (ws - w0) as sat from a),
l as (select *, (budget - coalesce(sum(cap) filter (where sat) over (), 0.0)) / sum(w) filter (where not sat) over () as level from f),
t as (select source, source_size, case when sat then cap else level * w end as target,
      cast('0x' || substr(md5(coalesce(source, chr(0) || 'null')), 1, 8) as ubigint) / 4294967296.0::double as u from l),
r as (select b.*, t.source_size, t.target, t.u, case when t.source_size = 0 then 0.0::double else t.target / t.source_size end as e,
      row_number() over (partition by b.source order by size, md5(cast(doc_id as varchar)), doc_id) as k
      from b join t on b.source is not distinct from t.source),
c as (select *, least(cast(floor(e * k + u) - floor(e * (k - 1) + u) as bigint), 2) as copies from r)
select doc_id, size, source_size, target, copies * size as taken, copies from c
"""
