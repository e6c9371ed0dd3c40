"""Equi-joins on tokens, hot keys in blocks; like pairs of token sets at the tokens they share, best matches of blocks against blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import deleted, stored


def block_join(left: DataFrame, right: DataFrame, keys: list[str], most: int = 20_000, bound: int = 100_000) -> DataFrame:
    """The inner equi-join of two stored tables on `keys`, in which no task meets more than about `most` rows of a key on either side.

    A key with more is dealt into blocks of about `most` rows: each block of its left rows meets each of its right rows, so the pairs are spread
    over blocks x blocks tasks. Hot keys are few (at most the rows divided by `most`); they are broadcast if at most `bound`."""
    both = left.select(*keys, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(*keys, F.lit(0).alias("l"), F.lit(1).alias("r")))
    counts = both.groupBy(*keys).agg(F.sum("l").alias("l"), F.sum("r").alias("r")).where((F.greatest("l", "r") > most) & (F.least("l", "r") > 0))
    blocks = lambda c: F.ceil(F.col(c) / most).cast("int")
    hot = stored(counts.select(*keys, blocks("l").alias("__nl"), blocks("r").alias("__nr")))
    n = hot.count()
    if not n:
        deleted(hot)
        return left.join(right, keys)
    if n <= bound:
        hot = F.broadcast(hot)

    def dealt(df: DataFrame, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        spread = df.join(hot, keys, "left")
        spread = spread.withColumn(mine, F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.coalesce(own, F.lit(1))).cast("int"))
        spread = spread.withColumn(theirs, F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)))
        return spread.drop("__nl", "__nr")

    a, b = dealt(left, "__nl", "__nr", "__l", "__r"), dealt(right, "__nr", "__nl", "__r", "__l")
    return a.join(b, [*keys, "__l", "__r"]).drop("__l", "__r")


#: Separates the tokens of a set that is sent as one string; a token holds none.
SEP = "\0"
#: Rows of a block: two blocks and what is counted over them fit one task.
BLOCK = 40_000


def tiled(left: DataFrame, right: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The rows of `left` and of `right`, with the same columns, with `p`, `q` and `x`: those of one (keys, p, q) are a block of at most about
    `most` rows of `left` (an eighth of them, if that is less, so that small tables are spread too), which `x` marks, and one of `right`."""
    size = F.least(F.lit(most), F.greatest(F.lit(max(1, most // 8)), F.count("*") / 8))
    count = lambda df, name: df.groupBy(*keys).agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    own = lambda df, n: F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    n = count(left, "__n").join(count(right, "__m"), keys)
    a = left.join(n, keys).withColumn("p", own(left, "__n")).withColumn("q", every("__m")).withColumn("x", F.lit(True))
    b = right.join(n, keys).withColumn("q", own(right, "__m")).withColumn("p", every("__n")).withColumn("x", F.lit(False))
    return a.select(*left.columns, "p", "q", "x").unionByName(b.select(*left.columns, "p", "q", "x"))


class Sets:
    """Token sets of an Arrow column of joined strings, as flat codes: those of row i are flat[start[i] : start[i + 1]]."""

    def __init__(self, joined):
        import numpy as np
        import pyarrow.compute as pc

        parts = pc.split_pattern(joined.combine_chunks() if isinstance(joined, pa.ChunkedArray) else joined, SEP)
        words = pc.list_flatten(parts).dictionary_encode()
        self.size = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        self.flat, self.words = words.indices.to_numpy().astype(np.int64), len(words.dictionary)

    def some(self, rows):
        """The sets of `rows` only; their codes stay."""
        import numpy as np

        out = object.__new__(Sets)
        out.size, out.words = self.size[rows], self.words
        out.start = np.concatenate([[0], np.cumsum(out.size)])
        out.flat = self.flat[np.repeat(self.start[rows] - out.start[:-1], out.size) + np.arange(out.start[-1])]
        return out

    def postings(self):
        """(rows, first): the rows that hold code w are rows[first[w] : first[w + 1]]."""
        import numpy as np

        rows = np.repeat(np.arange(len(self.size)), self.size)[np.argsort(self.flat, kind="stable")]
        return rows, np.concatenate([[0], np.cumsum(np.bincount(self.flat, minlength=self.words))])

    def marks(self):
        """64 bits a set, one of them set by each token."""
        import numpy as np

        bits = np.uint64(1) << ((self.flat.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(58))
        return np.bitwise_or.reduceat(bits, self.start[:-1]) if len(bits) else bits

    def padded(self, rows, fill: int):
        """A row for each of `rows`, filled up with `fill`, which is no code."""
        import numpy as np

        size = self.size[rows]
        place = np.arange(int(size.max(initial=1)))
        some = place < size[:, None]
        return np.where(some, self.flat[np.where(some, self.start[rows][:, None] + place, 0)], fill)


def spans(first, last, most: int):
    """Yields (i, j), flat: each j from first[i] to last[i] - 1 with its i, about `most` of them (or those of one i) at a time."""
    import numpy as np

    many = np.maximum(last - first, 0)
    ends, at = np.cumsum(many), 0
    while at < len(many):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        i = np.repeat(np.arange(at, to), many[at:to])
        if len(i):
            yield i, first[i] + np.arange(len(i)) - (ends[i] - many[i] - (ends[at - 1] if at else 0))
        at = to


#: Rows of a task of like_pairs, about.
DEALT = 100_000


def meetings(df: DataFrame, keys: list[str], threshold: float, overlap: bool = False, most: int = BLOCK, dealt: int = DEALT) -> DataFrame:
    """The rows of `df` (as in like_pairs) at each token at which one that is like them may meet them first: (keys, n, fresh, size, t, i, p, q, x, __task).

    Tokens are ordered by how many rows have them, rarest first. Rows of two sizes have to share so many tokens, so the first that they share has
    that many behind it in both, itself included. t: the tokens that other rows have too, in order; i: the place of the token in it; __task: many
    tokens go to one task, about `dealt` rows. The rows of a token of more than `most` are dealt in blocks, each two of which meet: p and q,
    and x marks those of p."""
    ranked = df.where("t <> ''").select(*keys, "n", "fresh", F.explode(F.split("t", SEP)).alias("w"), F.size(F.split("t", SEP)).alias("size"))
    # A token of one row is shared with none, but counts in its size. A pair with a fresh row shares tokens of fresh rows only.
    counts = ranked.groupBy(*keys, "w").agg(F.count("*").alias("c"), F.bool_or("fresh").alias("some")).where("c > 1")
    order = ranked.join(counts, [*keys, "w"]).groupBy(*keys, "n", "fresh", "size").agg(F.sort_array(F.collect_list(F.struct("c", "w", "some"))).alias("s"))
    fewest = F.lit(1) if overlap else F.greatest(F.lit(1), F.ceil(F.col("size") * F.lit(float(threshold)) - F.lit(1e-9)).cast("int"))
    order = stored(order.select(*keys, "n", "fresh", "size", "s", (F.size("s") - fewest + 1).alias("ends")).where("ends > 0"))
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil((order.agg(F.sum("ends")).first()[0] or 0) / dealt))
    joined = F.array_join(F.transform("s", lambda x: x["w"]), SEP).alias("t")
    places = order.select(*keys, "n", "fresh", "size", joined, F.posexplode(F.slice("s", F.lit(1), F.col("ends"))).alias("i", "at")).where("at.some")
    blocks = F.ceil(F.col("at.c") / most).cast("int")
    met = places.withColumn("__b", F.pmod(F.xxhash64("n"), blocks).cast("int")).withColumn("__c", F.explode(F.sequence(F.lit(0), blocks - 1)))
    met = met.withColumns({"p": F.least("__b", "__c"), "q": F.greatest("__b", "__c"), "x": F.col("__b") <= F.col("__c")})
    return met.select(*keys, "n", "fresh", "size", "t", "i", "p", "q", "x", F.pmod(F.xxhash64(*keys, "at.w", "p", "q"), F.lit(tasks)).alias("__task"))


def like_pairs(df: DataFrame, keys: list[str], threshold: float, overlap: bool = False, most: int = BLOCK, dealt: int = DEALT) -> DataFrame:
    """Pairs (keys, a, b), a < b, of rows of the stored `df` (keys, n, t: the tokens joined by SEP, fresh) whose token sets are alike: Jaccard
    similarity, or with `overlap` the shared part of the smaller set, of `threshold` or more; only those with a fresh row. Exact.

    Rows go whole to the tokens at which like ones may meet them (meetings). A task holds many tokens; it counts what two rows of one share only if
    their sizes, what they have left behind the token and their marks allow enough of it, and gives out like pairs only. So what is shuffled
    grows with the rows."""
    kind = df.schema["n"].dataType.simpleString()
    shape = ", ".join([*[f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys], f"a {kind}, b {kind}"])
    part = threshold / (1 + threshold)

    def least(n, m):
        import numpy as np

        return np.maximum(1, np.ceil((threshold * n if overlap else part * (n + m)) - 1e-9)).astype(np.int64)

    def meet(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow.compute as pc

        rows = pa.Table.from_batches(list(parts)).combine_chunks()
        sets, names = Sets(rows["t"]), rows["n"].combine_chunks()
        size, i, x, fresh = (rows[c].to_numpy().astype(k) for c, k in (("size", np.int64), ("i", np.int64), ("x", bool), ("fresh", bool)))
        left, marks = sets.size - i, sets.marks()
        # One number for each token of the keys' values and block.
        token, span = sets.flat[sets.start[:-1] + i], sets.words
        for c in [*keys, "p", "q"]:
            codes = rows[c].combine_chunks().dictionary_encode()
            token, span = token * len(codes.dictionary) + codes.indices.to_numpy(), span * len(codes.dictionary)
        one_block = rows["p"].to_numpy() == rows["q"].to_numpy()
        wide = int(size.max()) + 2
        # The smaller row of a pair, or one of two of a size, is looked up by token, side and size; those of another block have the other side.
        small = np.flatnonzero(left >= least(size, size))
        place = (token[small] * 2 + x[small]) * wide + size[small]
        small, place = (v[np.argsort(place, kind="stable")] for v in (small, place))
        near = (token * 2 + np.where(one_block, x, ~x)) * wide
        low = np.ones(len(size), np.int64) if overlap else np.ceil(threshold * size - 1e-9).astype(np.int64)
        high = np.minimum(size, np.floor((left / threshold if overlap else left / part - size) + 1e-6).astype(np.int64))
        first, last = np.searchsorted(place, near + low), np.searchsorted(place, near + high, "right")
        last[high < low] = 0
        for b, a in spans(first, last, 2_000_000):
            a = small[a]
            keep = (fresh[a] | fresh[b]) & ((size[a] < size[b]) | (a < b))
            a, b = a[keep], b[keep]
            need = least(size[a], size[b])
            differ = np.bitwise_count(marks[a] ^ marks[b]).astype(np.int64)
            keep = (np.minimum(left[a], left[b]) >= need) & (sets.size[a] + sets.size[b] - differ >= 2 * need)
            a, b = a[keep], b[keep]
            by = np.argsort(sets.size[b], kind="stable")
            a, b, at = a[by], b[by], 0
            while at < len(a):
                to = at + 1024
                to = at + max(1, 16_000_000 // int(sets.size[a[at:to]].max() * sets.size[b[at:to]].max()))
                to = min(to, at + 1024)
                u, v, at = a[at:to], b[at:to], to
                hit = (sets.padded(u, -1)[:, :, None] == sets.padded(v, -2)[:, None, :]).any(2)
                both = hit.sum(1)
                rest = size[u] if overlap else size[u] + size[v] - both
                # Only at the first token that the two share, so no pair is given out twice.
                keep = (both / rest >= threshold) & ~(hit & (np.arange(hit.shape[1]) < i[u][:, None])).any(1)
                if not keep.any():
                    continue
                u, v = names.take(pa.array(u[keep])), pa.array(v[keep])
                key = [rows[k].combine_chunks().take(v) for k in keys]
                v = names.take(v)
                turned = pc.greater(u, v)
                yield pa.RecordBatch.from_arrays([*key, pc.if_else(turned, v, u), pc.if_else(turned, u, v)], [*keys, "a", "b"])

    return meetings(df, keys, threshold, overlap, most, dealt).groupBy("__task").applyInArrow(meet, shape)


def best_match(mine: DataFrame, theirs: DataFrame, keys: list[str], most: int = BLOCK) -> DataFrame:
    """(keys, node, best): the highest Jaccard similarity of each row of `mine` (keys, node, id, tokens) to rows of `theirs` (keys, id,
    tokens) of equal keys and another id. Rows that share no token with any other are left out.

    The best match may share few and frequent tokens, so no token can be passed over: blocks of rows meet in tasks, each row of `mine` counts what
    it shares with all rows of a block over the lists of rows of its tokens, and gives out its best. Rows of `theirs` with equal sets are one, with
    their least and greatest id, as only a row of the same id alone is no match. What is shuffled is the rows times the blocks."""
    named = F.coalesce(F.concat(F.lit("="), F.col("id").cast("string")), F.lit(""))
    joined = F.array_join(F.sort_array("tokens"), SEP)
    left = mine.where(F.size("tokens") > 0).select(*keys, joined.alias("t"), "node", named.alias("low"), named.alias("high"))
    none = F.lit(None).cast(mine.schema["node"].dataType)
    right = theirs.where(F.size("tokens") > 0).select(*keys, joined.alias("t"), named.alias("id")).groupBy(*keys, "t")
    right = right.agg(F.min("id").alias("low"), F.max("id").alias("high")).select(*keys, "t", none.alias("node"), "low", "high")
    shape = ", ".join([*[f"`{k}` {mine.schema[k].dataType.simpleString()}" for k in keys], f"node {mine.schema['node'].dataType.simpleString()}, best double"])

    def meet(rows: pa.Table) -> pa.Table:
        import numpy as np
        import pyarrow.compute as pc

        sets, x = Sets(rows["t"]), rows["x"].to_numpy()
        one, two = np.flatnonzero(x), np.flatnonzero(~x)
        # Ids that both sides have, as numbers; each names one id at most that a set stands for alone.
        low, high = (rows[c].combine_chunks() for c in ("low", "high"))
        alone = pc.equal(low, high).to_numpy(zero_copy_only=False) & ~x
        ids: dict = {}
        for at, name in zip(np.flatnonzero(alone), low.filter(pa.array(alone)).to_pylist(), strict=True):
            ids.setdefault(name, []).append(at)
        place = np.zeros(len(x), np.int64)
        place[two] = np.arange(len(two))
        a, b = sets.some(one), sets.some(two)
        (holders, first), sizes = b.postings(), b.size.astype(float)
        best, under = np.zeros(len(one)), np.empty(len(two))
        for i, name in enumerate(low.take(pa.array(one)).to_pylist()):
            codes = a.flat[a.start[i] : a.start[i + 1]]
            both = np.bincount(np.concatenate([holders[first[w] : first[w + 1]] for w in codes]), minlength=len(two))
            if name in ids:
                both[place[ids[name]]] = 0
            np.subtract(sizes, both, out=under)
            under += a.size[i]
            np.divide(both, under, out=under)
            best[i] = under.max(initial=0.0)
        hit = np.flatnonzero(best > 0)
        columns = [pa.repeat(rows[k][0], len(hit)) for k in keys] + [rows["node"].combine_chunks().take(pa.array(one[hit])), pa.array(best[hit])]
        return pa.Table.from_arrays(columns, [*keys, "node", "best"])

    met = tiled(stored(left), stored(right), keys, most).groupBy(*keys, "p", "q").applyInArrow(meet, shape)
    return met.groupBy(*keys, "node").agg(F.max("best").alias("best"))
