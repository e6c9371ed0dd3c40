"""Operator 9: near-duplicate vectors by sorted projection passes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Forest, components, dropped, map_arrow, stored, table


def unit(blobs: list[bytes], dim: int) -> np.ndarray:
    """Rows of length 1 in double precision; the bytes are floats or doubles."""
    kind = np.float32 if len(blobs) and len(blobs[0]) == 4 * dim else np.float64
    x = np.frombuffer(b"".join(blobs), kind).reshape(-1, dim).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def prepared(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, dim, vec): the vector as bytes of floats (where the column holds these) or doubles; null vec where it can link with
    nothing."""
    kind = np.float32 if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else np.float64

    def make(batches):
        for b in batches:
            out = []
            for v, label in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                x = None if v is None or label is None or None in v or not v else np.array(v, kind) + kind(0)  # no negative zero
                out.append(None if x is None or not np.isfinite(x).all() or not x.any() else x.tobytes())
            dims = [0 if x is None else len(x) // kind().itemsize for x in out]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2).cast(pa.string()), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], ["vec_id", "label", "dim", "vec"])

    cols = vectors.select(F.col(id_col).cast("long"), vector_col, F.col(label_col).cast("string"))
    return map_arrow(cols, make, "vec_id long, label string, dim int, vec binary")


def near_rows(group: np.ndarray, x: np.ndarray, window: int, least: float, start: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows at most `window` apart, of one group, with cosine of `least` or more; the later row is `start` or after."""
    left, right = [], []
    for d in range(1, min(window, len(x) - 1) + 1):
        i = np.arange(max(start - d, 0), len(x) - d)
        i = i[group[i] == group[i + d]]
        hit = i[np.einsum("ij,ij->i", x[i], x[i + d]) >= least]
        left.append(hit)
        right.append(hit + d)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, int), np.zeros(0, int))


def enough_passes(most: int, window: int, agree: float, recall: float = 0.999) -> float:
    """Passes that find a pair with this chance in a label of `most` vectors, if the signs of one projection agree with chance `agree`: the pair
    meets in a window when about log2(most / window) signs agree."""
    met = agree ** max(0.0, np.log2(max(most, 1) / window))
    return 1.0 if met >= recall else float(np.ceil(np.log(1 - recall) / np.log1p(-met)))


def densities(classes: DataFrame, least: float, window: int, most: int) -> DataFrame:
    """(label, dim, n, mean, passes, whole), stored: of each label's classes the number and the mean of their unit vectors, the passes that find a pair
    of cosine `least`, and whether these would be more than `most`.

    Seen from the mean, vectors of mean squared length s2 lie all around, and a pair at cosine `least` is apart by an angle whose cosine is 1 - (1 -
    least) / s2: the closer the label, the wider the angle, and the more passes. A task gives one sum a label that it meets."""

    def part(batches):
        sums: dict = {}
        for b in batches:
            dims, labels = b.column("dim").to_numpy(), b.column("label").dictionary_encode()
            index, names = labels.indices.to_numpy(), labels.dictionary.to_pylist()
            for dim in np.unique(dims):
                where = np.flatnonzero(dims == dim)
                x = unit(b.column("vec").take(pa.array(where)).to_pylist(), int(dim))
                for i in np.unique(index[where]):
                    mine = x[index[where] == i]
                    n, total = sums.get((names[i], int(dim)), (0, 0.0))
                    sums[names[i], int(dim)] = (n + len(mine), total + mine.sum(0))
            if len(sums) > 10_000:
                yield rows(sums)
                sums = {}
        if sums:
            yield rows(sums)

    def rows(sums):
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.int32()), pa.array([n for n, _ in sums.values()], pa.int64()), pa.array([t.tobytes() for _, t in sums.values()], pa.binary())], ["label", "dim", "n", "sum"])

    def total(t):
        n = sum(t.column("n").to_pylist())
        mean = np.sum([np.frombuffer(x) for x in t.column("sum").to_pylist()], axis=0) / n
        around = max(1e-12, 1.0 - float(mean @ mean))
        agree = 1 - np.arccos(np.clip(1 - (1 - least) / around, 0.0, 1.0)) / np.pi
        need = enough_passes(n, window, agree)
        return pa.table({"label": t.column("label")[:1], "dim": t.column("dim")[:1], "n": pa.array([n], pa.int64()), "mean": pa.array([mean.tobytes()], pa.binary()), "passes": pa.array([int(min(need, most))], pa.int32()), "whole": pa.array([bool(need > most)])})

    found = classes.select("label", "dim", "vec").mapInArrow(part, "label string, dim int, n long, sum binary")
    return stored(found.groupBy("label", "dim").applyInArrow(total, "label string, dim int, n long, mean binary, passes int, whole boolean"))


def pass_edges(classes: DataFrame, known: DataFrame, number: int, window: int, least: float, bits: int, seed: int) -> DataFrame:
    """Verified edges (a, b) of one pass, which orders the vectors of a label by the signs of `bits` random projections
    of what they differ from the label's mean, most significant first, and compares each with the `window` before it. Sorted range partitions hold the order, so a
    large label spreads; rows at a partition's ends meet the next partition's in a job of their own. The vectors are shuffled once a pass, and
    a pass's files go before the next one starts."""

    def coded(batches):
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits - 1, -1, -1, dtype=np.int64)
        for b in batches:
            dims = b.column("dim").to_numpy()
            codes = np.zeros(b.num_rows, np.int64)
            for dim in np.unique(dims):
                where = np.flatnonzero(dims == dim)
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, int(dim), number]).standard_normal((dim, bits))
                mean = np.frombuffer(b"".join(b.column("mean").take(pa.array(where)).to_pylist())).reshape(-1, int(dim))
                codes[where] = ((unit(b.column("vec").take(pa.array(where)).to_pylist(), int(dim)) - mean) @ planes[dim] >= 0) @ weights
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("label"), b.column("dim"), b.column("vec"), pa.array(codes)], ["rep", "label", "dim", "vec", "code"])

    going = known.where(~F.col("whole") & (F.col("passes") > number)).select("label", "dim", "mean")
    rows = map_arrow(classes.join(going, ["label", "dim"]).select("rep", "label", "dim", "vec", "mean"), coded, "rep long, label string, dim int, vec binary, code long")

    def scan(batches):
        import pyspark

        part = pyspark.TaskContext.get().partitionId()
        names = ["rep", "label", "dim", "vec"]
        held, first, none = None, None, lambda n, t: pa.nulls(n, t)

        def ends(t, side):
            n = t.num_rows
            return pa.RecordBatch.from_arrays([none(n, pa.int64()), none(n, pa.int64()), pa.array([part - side] * n, pa.int32()), pa.array([side] * n, pa.int32()), pa.array(range(n), pa.int32()), *[t.column(c).combine_chunks() for c in names]], ["a", "b", "edge", "side", "i", *names])

        for b in batches:
            if not b.num_rows:
                continue
            new = pa.Table.from_batches([b.select(names)])
            start = held.num_rows if held else 0
            both = pa.concat_tables([held, new]).combine_chunks() if held else new
            e = compare(both, start)
            k = e.num_rows
            yield pa.RecordBatch.from_arrays([e.column(0), e.column(1), none(k, pa.int32()), none(k, pa.int32()), none(k, pa.int32()), none(k, pa.int64()), none(k, pa.string()), none(k, pa.int32()), none(k, pa.binary())], ["a", "b", "edge", "side", "i", *names])
            first = both.slice(0, window) if first is None or first.num_rows < window else first
            held = both.slice(max(0, both.num_rows - window))
        if held is not None:
            yield ends(first, 1)
            yield ends(held, 0)

    def compare(t, start):
        dims = t.column("dim").to_numpy()
        labels = t.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
        forest = Forest(t.column("rep").to_numpy())
        for dim in np.unique(dims):
            where = np.flatnonzero(dims == dim)
            x = unit(t.column("vec").take(pa.array(where)).to_pylist(), int(dim))
            i, j = near_rows(labels[where], x, window, least, int(np.searchsorted(where, start)))
            forest.join(where[i], where[j])
        return forest.edges()

    keys = ["label", "dim", "code", "rep"]
    schema = "a long, b long, edge int, side int, i int, rep long, label string, dim int, vec binary"
    found = stored(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(scan, schema))

    def across(t):
        # The end of one partition, then the start of the next: at most 2 * window rows.
        t = t.sort_by([("side", "ascending"), ("i", "ascending")])
        return pa.Table.from_batches([compare(t, int((t.column("side").to_numpy() == 0).sum()))])

    edges = found.where("edge is not null").groupBy("edge").applyInArrow(across, "a long, b long")
    out = stored(found.where("edge is null").select("a", "b").unionByName(edges))
    dropped(found)
    return out


def in_blocks(members: DataFrame, columns: list[str], done, schema: str, block: int = 128, most_blocks: int = 24) -> DataFrame:
    """`done` of each pair of blocks of a component's members (comp, rep, ...), as tables with `side` (0 or 1) and whether the two blocks differ. So
    all pairs of a component are met, in tasks of bounded size."""
    per = members.groupBy("comp").agg(F.count("*").alias("c"))
    k = F.greatest(F.least(F.ceil(F.col("c") / block), F.lit(most_blocks)), F.ceil(F.col("c") / 8192)).cast("int")
    rows = members.join(per.where(F.col("c") > block).select("comp", k.alias("k")), "comp", "left").withColumn("b", F.pmod(F.xxhash64("rep"), F.coalesce("k", F.lit(1))).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.coalesce("k", F.lit(1)) - 1), lambda y: F.struct(F.least("b", y).alias("x"), F.greatest("b", y).alias("y"), (F.col("b") > y).cast("int").alias("side")))
    rows = rows.withColumn("e", F.explode(pairs)).select("comp", "e.x", "e.y", "e.side", *columns)
    rows = rows.withColumn("h", F.xxhash64("comp", "x", "y"))

    def compare(batches):
        def whole(parts):
            t = pa.Table.from_batches(parts)
            return done(t, t.column("x")[0].as_py() != t.column("y")[0].as_py())

        held, last = [], None
        for b in batches:
            h = b.column("h").to_numpy()
            cuts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]).tolist() if len(h) else []
            for a, e in zip(cuts, [*cuts[1:], len(h)], strict=True):
                if h[a] != last and held:
                    yield whole(held)
                    held = []
                last = h[a]
                held.append(b.slice(a, e - a))
        if held:
            yield whole(held)

    return rows.repartition("h").sortWithinPartitions("h").mapInArrow(compare, schema)


def near_blocks(t: pa.Table, cross: bool, least: float):
    """(rows, other rows, which are near) of a pair of blocks, 512 rows at a time; a row is not near itself."""
    dim = int(t.column("dim")[0].as_py())  # one label and dimension
    x, side = unit(t.column("vec").to_pylist(), dim), t.column("side").to_numpy()
    one, two = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if cross else (np.arange(len(x)),) * 2
    for at in range(0, len(one), 512):
        some = one[at : at + 512]
        near = x[some] @ x[two].T >= least
        if not cross:
            near[np.arange(len(some)), some] = False
        yield some, two, near


def counted(members: DataFrame, least: float) -> DataFrame:
    """(rep, links): in each component all pairs are compared, so that links outside every window count too. members: (rep, comp, label, dim,
    copies, vec)."""

    def done(t, cross):
        rep, copies = t.column("rep").to_numpy(), t.column("copies").to_numpy()
        links = np.zeros(len(rep), np.int64)
        for some, two, near in near_blocks(t, cross, least):
            links[some] += near @ copies[two]
            if cross:
                links[two] += copies[some] @ near
        keep = links > 0
        return pa.RecordBatch.from_arrays([pa.array(rep[keep]), pa.array(links[keep])], ["rep", "links"])

    found = in_blocks(members, ["rep", "label", "dim", "copies", "vec"], done, "rep long, links long")
    return found.groupBy("rep").agg(F.sum("links").alias("links"))


def whole_edges(classes: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """Edges (a, b) that join all linked vectors of the labels marked `whole`: all their pairs are compared in blocks, and each pair of blocks gives
    one edge a vector at most."""
    marked = known.where("whole").select("label", "dim")
    some = classes.join(marked, ["label", "dim"])
    firsts = some.groupBy("label", "dim").agg(F.min("rep").alias("comp"))

    def done(t, cross):
        rep, root = t.column("rep").to_numpy(), np.arange(t.num_rows)
        for rows, two, near in near_blocks(t, cross, least):
            for i, hits in zip(rows, near, strict=True):
                if hits.any():
                    tops = np.unique(np.append(root[two[hits]], root[i]))
                    if len(tops) > 1:
                        root[np.isin(root, tops)] = tops[0]
        far = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(rep[root[far]]), pa.array(rep[far])], ["a", "b"])

    return stored(in_blocks(some.join(firsts, ["label", "dim"]), ["rep", "label", "dim", "vec"], done, "a long, b long", block=2048))


def near_vectors(vectors: DataFrame, least: float = 0.98, passes: int = 40, window: int = 64, bits: int = 62, seed: int = 7, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Links vectors of equal label whose cosine in double precision is `least` or more.

    Equal vectors of a label become one class first. Sorted passes, as many as a label's size and density ask for (see densities), order the
    classes of a label by the concatenated signs of `bits` random projections from its mean and compare each with its `window`
    neighbours; verified pairs of all passes are joined into components, in which all pairs are then counted in blocks. A pair is missed
    only if no chain of window neighbours joins it in any pass, with a chance of about 0.001. A label so dense that it would take more than `passes`
    passes is compared whole, in blocks, which is exact and costs its square in CPU. A label of at most `window` vectors is compared whole anyhow.

    Vectors that are null, empty, zero or hold null or non-finite components, or whose label is null, link with nothing, as do
    vectors of different lengths. Repeated rows are copies of each other; ties do not matter; an empty table gives no rows; other columns
    are not read. Returns vec_id, n_links, component_id (least id reachable), kept."""
    every = prepared(vectors, id_col, vector_col, label_col).withColumn("h", F.md5("vec"))
    rows = stored(every.drop("vec"))
    classes = stored(every.where("vec is not null").groupBy("label", "dim", "h").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("vec").alias("vec")))
    table_ = densities(classes, least, window, passes)
    known = F.broadcast(table_) if table_.count() <= 20_000 else table_
    most, dense = table_.agg(F.max(F.when(~F.col("whole"), F.col("passes"))), F.bool_or("whole")).first()
    edges = [pass_edges(classes, known, i, window, least, bits, seed) for i in range(most or (0 if dense else 1))]
    if dense:
        edges.append(whole_edges(classes, known, least))
    found = edges[0]
    for e in edges[1:]:
        found = found.unionByName(e)
    comps = components(found)
    dropped(*edges, table_)
    members = stored(comps.select(F.col("node").alias("rep"), F.col("component").alias("comp")).join(classes, "rep"))
    links = counted(members, least)
    known = classes.select("label", "dim", "h", "rep", "copies").join(comps.withColumnRenamed("node", "rep"), "rep", "left").join(links, "rep", "left")
    known = stored(known.select("label", "dim", "h", F.coalesce("component", "rep").alias("component"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n")))
    dropped(members, classes, comps)
    out = rows.join(known, ["label", "dim", "h"], "left")
    root = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"), (F.col("vec_id") == root).alias("kept"))


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


SQL = """
with recursive v as (select vec_id, label, embedding::double[] as e from embeddings where label is not null and embedding is not null),
g as (select * from v where len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and list_sum(list_transform(e, lambda x: abs(x))) > 0),
l as (select a.vec_id as a, b.vec_id as b from g a join g b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.98),
t as (select vec_id as node, vec_id as root from g union select l.b, t.root from t join l on t.node = l.a),
m as (select node, min(root) as root from t group by node),
k as (select a, count(*) as n from l group by a)
select e.vec_id, coalesce(k.n, 0) as n_links, coalesce(m.root, e.vec_id) as component_id, coalesce(m.root, e.vec_id) = e.vec_id as kept
from embeddings e left join m on e.vec_id = m.node left join k on e.vec_id = k.a
"""
