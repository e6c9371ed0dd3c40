"""Pieces shared by the operators: stored intermediate tables, global ranks, components, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, and the words, as every contract here has them.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of our own only where the setting is missing and all tasks run on this machine, as
    in tests."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="siftwire-"))
    return sc._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame) -> DataFrame:
    """`df` written once as Parquet in the shared folder and read back: lineage ends there, and a lost executor loses
    nothing. The write's shuffle files go when it ends. The table stays until `dropped`, or until the application's folder is cleared."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    was = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes stored tables, once all that was made of them is stored itself."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = sc._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def bucket(col: str, n: int) -> Column:
    """crc32 of the id written as text, modulo n: the split that the contracts use."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


def ranked(df: DataFrame, *order: str, first_null: bool = False) -> DataFrame:
    """Adds `row`, the 0-based position of each row in the global order of the columns `order` (nulls last).

    Range partitions are sorted on their own; one count a partition (as many as there are partitions) gives the offsets.
    No key is kept whole, so a hot value of the first columns spreads over partitions as long as later columns differ."""
    keys = [F.col(c).asc_nulls_last() for c in order]
    at = "__at"
    flat = stored(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(at, F.monotonically_increasing_id()))
    part = F.shiftright(at, 33)
    counts = sorted(flat.groupBy(part.alias("p")).count().collect())
    offsets, total = [], 0
    for p, n in counts:
        offsets.append((p, total))
        total += n
    spark = df.sparkSession
    small = spark.createDataFrame(offsets or [(0, 0)], "__p long, __offset long")
    return (
        flat.withColumn("__p", part)
        .join(F.broadcast(small), "__p", "left")
        .withColumn("row", F.col("__offset") + F.col(at).bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("__p", "__offset", at)
    )


def small_join(left: DataFrame, right: DataFrame, keys: list[str], bound: int = 50_000) -> DataFrame:
    """Left join on null-safe keys; `right` is broadcast if it has at most `bound` rows, else both sides are shuffled."""
    held = stored(right)
    if held.count() <= bound:
        held = F.broadcast(held)
    names = {k: f"__{k}" for k in keys}
    held = held.withColumnsRenamed(names)
    cond = None
    for k, other in names.items():
        one = left[k].eqNullSafe(held[other])
        cond = one if cond is None else cond & one
    return left.join(held, cond, "left").drop(*names.values())


def least_count(counts: DataFrame, col: str, most: int, least: int = 2, read: int = 100_000) -> int:
    """The least count, `least` or more, such that at most `most` rows of `counts` have it or a higher one: rows of one count are
    taken or left together. At most `read` distinct counts, the highest, come to the driver; if there are more, none below these is taken."""
    total, last = 0, None
    shares = counts.where(F.col(col) >= least).groupBy(col).agg(F.count("*").alias("__n")).orderBy(F.desc(col)).limit(read).collect()
    for r in shares:
        total += r["__n"]
        if total > most:
            return r[col] + 1
        last = r[col]
    return last if len(shares) == read else least


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each end of `edges` (a, b): component is the smallest node of the connected component.

    Smallest label of the neighbours, then one pointer jump, until nothing changes, which labels that only fall must reach; each round is stored, so that plans stay
    small, and the one before it deleted. Aggregates combine before the shuffle, and the joins are plain equi-joins that adaptive
    execution splits on hot nodes."""
    pairs = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    both = stored(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    old = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")))
    while True:
        labels = old.select("node", "component")
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        step = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "m").alias("c"))
        jump = step.join(labels.select(F.col("node").alias("c"), F.col("component").alias("up")), "c", "left")
        new = stored(jump.select("node", "was", F.least("c", F.coalesce("up", "c")).alias("component")))
        dropped(old)
        old = new
        if new.where("was <> component").isEmpty():
            dropped(both)
            return new.select("node", "component")


class Forest:
    """Edges of a few rows, reduced to one edge a row: (row's id, least id it is joined to)."""

    def __init__(self, ids: np.ndarray) -> None:
        self.ids, self.root = ids, np.arange(len(ids))

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def join(self, left: np.ndarray, right: np.ndarray) -> None:
        for i, j in zip(left.tolist(), right.tolist(), strict=True):
            p, q = self.find(i), self.find(j)
            if p != q:
                p, q = (p, q) if self.ids[p] < self.ids[q] else (q, p)
                self.root[q] = p

    def edges(self) -> pa.RecordBatch:
        top = np.array([self.find(i) for i in range(len(self.ids))], np.int64)
        far = top != np.arange(len(self.ids))
        return pa.RecordBatch.from_arrays([pa.array(self.ids[top[far]]), pa.array(self.ids[far])], ["a", "b"])


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most `rows` rows, so that few texts are Python objects at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def map_arrow(df: DataFrame, make: Callable, schema: str) -> DataFrame:
    """mapInArrow whose function `make` is called once a task; it returns a function from batches to columns."""

    def run(batches):
        for columns in make(slices(batches)):
            yield columns

    return df.mapInArrow(run, schema)
