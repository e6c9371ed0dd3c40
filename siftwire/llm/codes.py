"""Operator 11: vectors as codes of their parts' nearest codebook entries, fitted over anchors-hierarchy metric trees."""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, small_join, stored, table
from .tokens import ragged

#: Components beyond this, either way, count as this, so that squared distances fit 64 bits.
LIMIT = 1 << 27


def whole_numbers(vectors: pa.Array, dim: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows are kept, their integer components): those of `dim` components, all finite."""
    lists = vectors.cast(pa.list_(pa.float64()))
    n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    right = np.flatnonzero(n == dim)
    x = lists.take(pa.array(right)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)  # null components become nan
    good = np.isfinite(x).all(1)
    return right[good], np.floor(np.clip(x[good], -LIMIT / scale, LIMIT / scale) * scale).astype(np.int64)


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances, a row a point, a column an entry."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * most * most * x.shape[1] < 1 << 53:  # doubles hold all sums
        f, e = x.astype(np.float64), entries.astype(np.float64)
        return ((f * f).sum(1)[:, None] - 2.0 * (f @ e.T) + (e * e).sum(1)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(1) for e in entries], 1)


def split(x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of many balls at once. `x` holds the points of ball g at starts[g] up to starts[g + 1]; a ball gets the square root of their number
    in anchors, fewer if it has fewer different points. Each new anchor of a ball is the point farthest from its own anchor; it takes the
    points that are nearer to it, and only those farther from their anchor than half the way between the two anchors are looked at. Returns
    (owner: each point's anchor; pivot: each anchor's point; group: its ball; radius), anchors of a ball standing together."""
    sizes = np.diff(starts)
    balls = np.arange(len(sizes))
    ball = np.repeat(balls, sizes)
    pivot, group, owner = starts[:-1].copy(), balls.copy(), ball.copy()

    def away(points: np.ndarray, others: np.ndarray) -> np.ndarray:
        return np.sqrt(((x[points] - x[others]) ** 2).sum(1).astype(np.float64))

    far = away(np.arange(len(x)), pivot[owner])
    want = np.ceil(np.sqrt(sizes)).astype(np.int64)
    have, live = np.ones(len(sizes), np.int64), balls[want > 1]
    while len(live):
        points = ragged(starts[live], sizes[live])
        heads = np.r_[0, sizes[live].cumsum()[:-1]]
        most = np.maximum.reduceat(far[points], heads)
        at = np.flatnonzero(far[points] == np.repeat(most, sizes[live]))
        new = points[at[np.unique(ball[points[at]], return_index=True)[1]]]
        some = most > 0
        live, new = live[some], new[some]
        of = np.full(len(sizes), -1)
        of[live] = np.arange(len(live))
        points = points[of[ball[points]] >= 0]
        near = np.flatnonzero(of[group] >= 0)
        between = np.zeros(len(pivot))
        between[near] = away(pivot[near], new[of[group[near]]])
        points = points[far[points] * 2 >= between[owner[points]] * (1 - 1e-9)]
        d = away(points, new[of[ball[points]]])
        nearer = d < far[points]
        points = points[nearer]
        owner[points], far[points] = len(pivot) + of[ball[points]], d[nearer]
        pivot, group = np.r_[pivot, new], np.r_[group, live]
        have[live] += 1
        live = live[have[live] < want[live]]
    radius = np.zeros(len(pivot))
    np.maximum.at(radius, owner, far)
    order = np.argsort(group, kind="stable")
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return back[owner], pivot[order], group[order], radius[order]


def joined(centre: np.ndarray, radius: np.ndarray, counts: np.ndarray, group: np.ndarray) -> tuple[list[tuple], np.ndarray, np.ndarray]:
    """Middle-out: the anchors of each group are joined two at a time, always the two of the smallest common ball, up to one node. All groups go
    at once. Returns (rounds of (parents, firsts, seconds), centres, radii); parents are numbered after the anchors."""
    groups, place = np.unique(group, return_inverse=True)
    width = int(np.bincount(place).max())
    nodes = np.full((len(groups), width), -1)
    nodes[place, np.arange(len(place)) - np.searchsorted(place, place)] = np.arange(len(place))
    n, rounds = counts.astype(np.float64), []

    def balls(some: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """Radius of the common ball of each node `some` (a row) with its `rest` (columns); inf where there is none."""
        a, b = some[:, None], rest
        d = np.sqrt(((centre[a] - centre[b]) ** 2).sum(-1))
        share = n[b] / (n[a] + n[b])
        out = np.maximum(share * d + radius[a], (1 - share) * d + radius[b])
        return np.where((a < 0) | (b < 0) | (a == b), np.inf, out)

    costs = np.stack([balls(nodes[:, i], nodes) for i in range(width)], 1)
    for _ in range(width - 1):
        open_ = np.flatnonzero((nodes >= 0).sum(1) > 1)
        best = costs[open_].reshape(len(open_), -1).argmin(1)
        i, j = best // width, best % width
        a, b, parent = nodes[open_, i], nodes[open_, j], len(centre) + np.arange(len(open_))
        total = n[a] + n[b]
        centre = np.concatenate([centre, (centre[a] * n[a, None] + centre[b] * n[b, None]) / total[:, None]])
        radius, n = np.r_[radius, costs[open_, i, j]], np.r_[n, total]
        nodes[open_, i], nodes[open_, j] = parent, -1
        rounds.append((parent, a, b))
        fresh = balls(parent, nodes[open_])
        costs[open_, i, :], costs[open_, :, i] = fresh, fresh
        costs[open_, j, :], costs[open_, :, j] = np.inf, np.inf
    return rounds, centre, radius


def tree(x: np.ndarray, leaf: int = 32) -> dict[str, np.ndarray]:
    """The metric tree over the rows of `x`. Of each node: centre, radius (of a ball around all its points), count and sum of its points, children
    (-1: none) and, but for joined nodes, from where to where its points stand in `order`. Balls of more than `leaf` points that are not all
    equal are split into anchors, and the anchors joined up to the ball, until none is left."""
    order = np.arange(len(x))
    mid = x.mean(0)
    t = {
        "centre": mid[None], "radius": np.sqrt(((x - mid) ** 2).sum(1).max())[None], "count": np.array([len(x)]), "sum": x.sum(0)[None],
        "one": np.array([-1]), "two": np.array([-1]), "from": np.array([0]), "to": np.array([len(x)]),
    }
    todo = np.array([0]) if len(x) > leaf and (x != x[0]).any() else np.zeros(0, np.int64)
    while len(todo):
        sizes = t["count"][todo]
        where = ragged(t["from"][todo], sizes)
        points = order[where]
        owner, pivot, group, r = split(x[points], np.r_[0, sizes.cumsum()])
        by = np.argsort(owner, kind="stable")
        order[where] = points[by]
        counts = np.bincount(owner, minlength=len(pivot))
        heads = counts.cumsum() - counts
        sums, start = np.add.reduceat(x[points[by]], heads, axis=0), where[heads]
        rounds, centre, radius = joined(x[points[pivot]].astype(np.float64), r, counts, group)
        one, two = np.full(len(centre), -1), np.full(len(centre), -1)
        count, total, up = np.r_[counts, np.zeros(len(centre) - len(counts), np.int64)], np.zeros((len(centre), x.shape[1]), np.int64), np.zeros(len(centre), np.int64)
        total[: len(counts)], up[: len(counts)] = sums, group
        top = np.zeros(len(todo), np.int64)
        for p, a, b in rounds:
            one[p], two[p], count[p], total[p], up[p] = a, b, count[a] + count[b], total[a] + total[b], up[a]
            top[up[p]] = p
        number = np.full(len(centre), -1)
        number[top] = todo
        fresh = np.flatnonzero(number < 0)
        number[fresh] = len(t["count"]) + np.arange(len(fresh))
        t["one"][todo], t["two"][todo] = number[one[top]], number[two[top]]
        real = one >= 0
        one[real], two[real] = number[one[real]], number[two[real]]
        span = np.zeros(len(centre), np.int64)
        span[: len(start)] = start
        ends = np.zeros(len(centre), np.int64)
        ends[: len(start)] = start + counts
        new = {"centre": centre, "radius": radius, "count": count, "sum": total, "one": one, "two": two, "from": span, "to": ends}
        t = {k: np.concatenate([v, new[k][fresh]]) for k, v in t.items()}
        todo = number[: len(start)][(counts > leaf) & (r > 0)]
    # Written small: centres in single precision, the radius widened by what that moves them.
    small = t["centre"].astype(np.float32)
    t["radius"] = np.nextafter((t["radius"] + np.sqrt(((small - t["centre"]) ** 2).sum(1))).astype(np.float32), np.float32(np.inf))
    t["centre"], t["x"], t["order"] = small, shrunk(x[order]), order.astype(np.int32)
    return t | {k: t[k].astype(np.int32) for k in ("count", "one", "two", "from", "to")}


def shrunk(x: np.ndarray) -> np.ndarray:
    most = int(np.abs(x).max(initial=0))
    return x.astype(np.int16 if most < 1 << 15 else np.int32)


def descend(t: dict[str, np.ndarray], entries: np.ndarray, coded: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(sums, counts, codes): of each entry the sum and number of the points nearest to it (ties to the lower), and, if `coded`, each point's
    entry in the order of the tree's points.

    A ball keeps the entries that may be nearest to a point in it and hands these on to its children: entry j leaves where entry i, the nearest to the
    centre, is nearer to all of the ball. The difference of their squared distances changes along j - i only, so its least value in
    the ball is that at the centre less twice radius times |j - i|. A ball with one entry left adds its cached sum and count; leaves with more
    compare their points with what is left."""
    k = len(entries)
    sums, counts = np.zeros_like(entries), np.zeros(k, np.int64)
    codes = np.zeros(len(t["x"]), np.int64) if coded else None
    e = entries.astype(np.float64)
    apart = np.sqrt(((e[:, None] - e[None]) ** 2).sum(2))
    first = np.array([not (entries[:j] == entries[j]).all(1).any() for j in range(k)])  # equal entries: the lowest has it all
    nodes, open_ = np.array([0]), first[None]
    last, left = [], []
    while len(nodes):
        d = ((t["centre"][nodes].astype(np.float64)[:, None] - e[None]) ** 2).sum(2)
        best = np.where(open_, d, np.inf).argmin(1)
        row = np.arange(len(nodes))
        gap = d - d[row, best][:, None] - 2 * t["radius"][nodes].astype(np.float64)[:, None] * apart[best]
        open_ = open_ & ~(gap > 0.5 + 1e-9 * (d + d[row, best][:, None]))
        one, leaf = open_.sum(1) == 1, t["one"][nodes] < 0
        own, span = np.flatnonzero(one), t["to"][nodes] > t["from"][nodes]
        if coded:
            fill = np.flatnonzero(one & span)
            n = (t["to"] - t["from"])[nodes[fill]].astype(np.int64)
            codes[ragged(t["from"][nodes[fill]].astype(np.int64), n)] = np.repeat(best[fill], n)
            inner = ~leaf & ~(one & span)
        else:
            np.add.at(sums, best[own], t["sum"][nodes[own]])
            np.add.at(counts, best[own], t["count"][nodes[own]])
            inner = ~leaf & ~one
        end = leaf & ~one
        last.append(nodes[end])
        left.append(open_[end])
        nodes, open_ = np.concatenate([t["one"][nodes[inner]], t["two"][nodes[inner]]]), np.concatenate([open_[inner]] * 2)
    last, left = np.concatenate(last), np.concatenate(left)
    n = (t["to"] - t["from"])[last].astype(np.int64)
    points = ragged(t["from"][last].astype(np.int64), n)
    if len(points):
        x = t["x"][points].astype(np.int64)
        d = squared(x, entries)
        near = np.where(np.repeat(left, n, axis=0), d, np.iinfo(np.int64).max).argmin(1)
        if coded:
            codes[points] = near
        else:
            np.add.at(sums, near, x)
            counts += np.bincount(near, minlength=k)
    return sums, counts, codes


def written(trees: list[dict[str, np.ndarray]]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **{f"{p}.{k}": v for p, t in enumerate(trees) for k, v in t.items()})
    return out.getvalue()


def read(data: bytes) -> list[dict[str, np.ndarray]]:
    held, trees = np.load(io.BytesIO(data)), {}
    for name in held.files:
        p, k = name.split(".")
        trees.setdefault(int(p), {})[k] = held[name]
    return [trees[p] for p in sorted(trees)]


def blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """The rows of the batches, `most` at a time."""
    held, n = [], 0
    for b in batches:
        at = 0
        while at < b.num_rows:
            some = b.slice(at, most - n)
            held.append(some)
            at, n = at + some.num_rows, n + some.num_rows
            if n == most:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def compress_vectors(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, block: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Codes of all vectors: (vec_id, code, error, label_error, codebooks_sha256).

    Components become floor(scale * x). Each of `parts` equal parts has a codebook, which starts as that part of the vectors with the `entries`
    least ids (equal ids by their vectors; fewer vectors, fewer entries) and is fitted in `rounds` rounds: each part goes to its nearest
    entry, ties to the lower, and entries become the floor of their parts' mean. Exact, by metric trees (see tree, descend) over blocks of `block`
    vectors, built once and stored; a round reads the trees and shuffles a sum an entry and task. So no label or copy is hot, and the
    codebooks are all that reaches the driver.

    Rows whose vector is null or empty or holds null or non-finite components are dropped, as are those whose length differs from that of the
    first vector kept, or all if `parts` does not divide it. Components beyond 2^27 count as 2^27. Repeated rows count and are returned each; null
    ids stand last; null labels are one label; long vectors are one part longer each; an empty table gives no rows; other columns are not read."""
    spark = vectors.sparkSession
    given = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vec"), F.col(label_col).alias("label"))
    good = given.where(F.col("vec").isNotNull() & (F.size("vec") > 0) & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    order = [F.asc_nulls_last("vec_id"), F.col("vec")]
    first = good.select("vec_id", "vec").orderBy(*order).limit(1).collect()
    dim = len(first[0]["vec"]) if first and len(first[0]["vec"]) % parts == 0 else 0
    width = dim // parts
    good = good.where(F.size("vec") == dim)
    kinds = {f.name: f.dataType.simpleString() for f in good.schema}
    if not dim:
        return spark.createDataFrame([], f"vec_id {kinds['vec_id']}, code string, error long, label_error long, codebooks_sha256 string")
    seeds = good.select("vec_id", "vec").orderBy(*order).limit(entries).collect()
    _, x = whole_numbers(pa.array([r["vec"] for r in seeds], pa.list_(pa.float64())), dim, scale)
    books = np.stack([x[:, p * width : (p + 1) * width] for p in range(parts)])

    def build(batches):
        for t in blocks(batches, block):
            kept, x = whole_numbers(t.column("vec").chunk(0), dim, scale)
            if len(kept):
                rows = t.take(pa.array(kept))
                data = written([tree(x[:, p * width : (p + 1) * width]) for p in range(parts)])
                lists = [pa.ListArray.from_arrays(pa.array([0, len(kept)], pa.int32()), rows.column(c).combine_chunks()) for c in ("vec_id", "label")]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([data], pa.binary())], ["vec_id", "label", "data"])

    if good.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:  # a table of few files is dealt out
        good = good.repartition(spark.sparkContext.defaultParallelism)
    trees = stored(good.mapInArrow(build, f"vec_id array<{kinds['vec_id']}>, label array<{kinds['label']}>, data binary"))

    for _ in range(rounds):
        def fit(batches, books=books):
            sums, counts = np.zeros_like(books), np.zeros(books.shape[:2], np.int64)
            for b in batches:
                for data in b.column(0):
                    for p, t in enumerate(read(data.as_py())):
                        s, c, _ = descend(t, books[p], False)
                        sums[p] += s
                        counts[p] += c
            p, j = np.nonzero(counts)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * width, pa.int32()), pa.array(sums[p, j].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(j, pa.int32()), pa.array(counts[p, j]), listed], ["part", "entry", "n", "sums"])

        found = trees.select("data").mapInArrow(fit, "part int, entry int, n long, sums array<long>")
        total = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"))
        books = books.copy()
        for r in total.collect():  # parts x entries rows
            books[r["part"], r["entry"]] = np.array(r["sums"], np.int64) // r["n"]

    def code(batches):
        for b in batches:
            for i in range(b.num_rows):
                vec_id, label = b.column("vec_id").slice(i, 1).flatten(), b.column("label").slice(i, 1).flatten()
                codes, error = np.zeros((len(vec_id), parts), np.uint8), np.zeros(len(vec_id), np.int64)
                for p, t in enumerate(read(b.column("data")[i].as_py())):
                    _, _, c = descend(t, books[p], True)
                    codes[t["order"], p] = c
                    error[t["order"]] += ((t["x"].astype(np.int64) - books[p][c]) ** 2).sum(1)
                text = codes.tobytes().hex()
                yield pa.RecordBatch.from_arrays([vec_id, label, pa.array([text[a : a + 2 * parts] for a in range(0, len(text), 2 * parts)], pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    rows = stored(trees.mapInArrow(code, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"))
    dropped(trees)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    errors = rows.groupBy("label").agg(F.sum("error").alias("label_error"))
    return small_join(rows, errors, ["label"]).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_vectors(table(spark, sf_dir, "embeddings"))


def sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The same for vectors of one length: a pair of common tables a round."""
    far = "list_sum(list_transform(list_zip(v.x, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = [
        f"""with k as materialized (select row_number() over (order by vec_id nulls last, embedding) as r, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::double)::bigint) as e from embeddings
where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
v as materialized (select r, p, e[p * len(e) // {parts} + 1 : (p + 1) * len(e) // {parts}] as x from k, range({parts}) t(p)),
c0 as materialized (select p, r - 1 as j, x as e from v where r <= {entries})"""
    ]
    for i in range(rounds + 1):
        steps.append(f"a{i} as materialized (select v.r, v.p, any_value(v.x) as x, min(struct_pack(d := {far}::bigint, j := c.j)) as b from v join c{i} c on v.p = c.p group by v.r, v.p)")
        if i < rounds:
            mean = f"select p, j, list(m order by i) as e from (select p, b.j as j, i, floor(sum(x[i])::double / count(*))::bigint as m from a{i}, range(1, len(x) + 1) t(i) group by p, b.j, i) group by p, j"
            steps.append(f"c{i + 1} as materialized (select c.p, c.j, coalesce(m.e, c.e) as e from c{i} c left join ({mean}) m on c.p = m.p and c.j = m.j)")
    last = f"""s as (select sha256(string_agg(array_to_string(e, ','), ',' order by p, j)) as h from c{rounds}),
o as (select k.vec_id, k.label, string_agg(printf('%02x', b.j), '' order by p) as code, sum(b.d)::bigint as error from a{rounds} a join k on a.r = k.r group by k.r, k.vec_id, k.label)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, h as codebooks_sha256 from o, s"""
    return ",\n".join([*steps, last])


SQL = sql()
