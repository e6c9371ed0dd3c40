"""Operator 6: contiguous shards of equal bytes from a global prefix sum of sizes."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table


def shard_by_bytes(docs: DataFrame, shards: int = 40, extra: int = 16, slack: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deals all rows into `shards` contiguous shards of nearly equal bytes.

    Order: md5 of the text, then id, so equal texts stand together. Size: UTF-8 bytes plus `extra`. Range partitions are
    sorted and summed on their own; their totals (one row a partition) give the offset of each. A row goes to the
    shard in whose span its first byte falls; a group of equal texts that a cut would part goes whole to its first
    row's shard if it has at most 1/`slack` of a shard (at most shards-1 groups are parted, so that table is broadcast).
    Slots count from 0 in each shard. Null and empty texts count as one text of no bytes; repeated rows each get a slot;
    an empty table gives no rows. Columns of `docs` other than id and text are not read."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + extra).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("h"))
    # Written narrow first: choosing range bounds would else read the texts twice.
    base = stored(base)

    def sums(batches):
        row = total = 0
        for b in batches:
            size = b.column("size").to_numpy(zero_copy_only=False)
            start = size.cumsum() - size + total
            total += int(size.sum())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(start, pa.int64()), pa.array(range(row, row + b.num_rows), pa.int64())], [*b.schema.names, "local", "i"])
            row += b.num_rows

    keys = [F.col("h"), F.col("doc_id").asc_nulls_last()]
    dealt = base.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("p", F.spark_partition_id())
    dealt = stored(dealt.mapInArrow(sums, "doc_id long, size long, text_crc32 long, h string, p int, local long, i long"))
    totals = sorted(dealt.groupBy("p").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect())
    offsets, nbytes, nrows = [], 0, 0
    for p, b, n in totals:
        offsets.append((p, nbytes, nrows))
        nbytes, nrows = nbytes + b, nrows + n
    small = spark.createDataFrame(offsets or [(0, 0, 0)], "p int, b0 long, n0 long")
    placed = dealt.join(F.broadcast(small), "p").select("doc_id", "size", "text_crc32", "h", (F.col("b0") + F.col("local")).alias("start"), (F.col("n0") + F.col("i")).alias("row"))
    placed = placed.withColumn("cut", F.expr(f"cast((start * {shards}) div {max(nbytes, 1)} as int)"))
    # Groups that a cut parts: at most shards - 1.
    parted = placed.groupBy("h").agg(F.min("cut").alias("whole"), F.max("cut").alias("last"), F.sum("size").alias("g")).where(f"whole < last and g * {shards} * {slack} <= {nbytes}").select("h", "whole")
    cut = placed.join(F.broadcast(parted), "h", "left").withColumn("shard", F.coalesce("whole", "cut"))
    firsts = cut.groupBy("shard").agg(F.min("row").alias("first"))  # one row a shard
    return cut.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op6_shard_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"))
