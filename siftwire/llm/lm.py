"""Operator 2: scores of texts under a unigram baseline and a small causal self-attention model."""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import bucket, dropped, least_count, map_arrow, stored, table

#: The token after a text's last word; no word has white space.
END = b"\n"
CHUNK, BEFORE = 16, 8  # positions scored by a window, and inputs before them
CONTEXT = CHUNK + BEFORE
BATCH = 1024  # windows scored at once


def gathered(batches, size: int):
    """Tables of about `size` bytes from the batches, which are put together or parted by rows; a longer text is not cut."""
    held, total = [], 0
    for b in batches:
        step = max(1, b.num_rows * size // max(b.nbytes, 1))
        for i in range(0, b.num_rows, step):
            held.append(b.slice(i, step))
            total += held[-1].nbytes
            if total >= size:
                yield pa.Table.from_batches(held).combine_chunks()
                held, total = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def worded(texts: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """(words, texts' word counts) of all texts one after the other, A-Z lower-cased, without ends; null is empty."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.combine_chunks(), "")))  # the six ASCII spaces; empty parts beside them
    words = lists.flatten()
    some = pc.greater(pc.binary_length(words), 0)
    upto = np.r_[0, np.cumsum(some.to_numpy(zero_copy_only=False))]
    off = lists.offsets.to_numpy()
    off = off - off[0]
    return words.filter(some), upto[off[1:]] - upto[off[:-1]]


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, c) of all words of `docs` and their ends, lower-cased A-Z. Tasks give out partial counts of about 16 MB of text."""

    def make(batches):
        for t in gathered(batches, 16 << 20):
            words, n = worded(t.column(0))
            seen = words.value_counts()
            word, c = pa.concat_arrays([seen.field("values").cast(pa.binary()), pa.array([END], pa.binary())]), pa.concat_arrays([seen.field("counts"), pa.array([len(n)], pa.int64())])
            for b in pa.table({"word": word, "c": c}).to_batches(max_chunksize=100_000):
                yield b

    return map_arrow(docs.select(text_col), make, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def frequent(counts: DataFrame, most: int) -> tuple[dict[bytes, int], int]:
    """The end's count, and at most `most` words of up to 64 bytes with all counts of `least` or more, and `least`: a table of proven size."""
    least = least_count(counts, "c", most)
    rows = counts.where((F.col("word") == END) | (F.col("c") >= least) & (F.octet_length("word") <= 64)).toPandas()
    return dict(zip(map(bytes, rows["word"]), rows["c"].astype(int), strict=True)), least


# The model -----------------------------------------------------------------------------------------------------------


def pieces_table(path: str, merges: int) -> dict:
    """The tokenizer's first `merges` merges and its byte symbols: few enough pieces for a small softmax. Ids are dense."""
    t = bpe.load(path)
    keep = t["rank"] < merges
    t = t | {"keys": t["keys"][keep], "rank": t["rank"][keep], "made": t["made"][keep]}
    ids = np.unique(np.concatenate([t["first"], t["last"], t["made"]]))
    dense = np.full(t["size"], -1)
    dense[ids] = np.arange(len(ids))
    return {"t": {k: t[k] for k in ("size", "keys", "rank", "made", "first", "last")}, "dense": dense, "n": len(ids) + 1}


def pieces_of(words: list[bytes], table_: dict) -> tuple[np.ndarray, np.ndarray]:
    sym, n = bpe.merge_rounds(words, table_["t"])
    return table_["dense"][sym], n


def runs(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs of `sizes` that begin at `first`, one run after the other."""
    upto = sizes.cumsum()
    return np.repeat(first - (upto - sizes), sizes) + np.arange(sizes.sum())


def merged(words: pa.Array, table_: dict) -> tuple[np.ndarray, np.ndarray]:
    """(pieces of all words one after the other, words' piece counts)."""
    k = len(words)
    off = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + k + 1].astype(np.int64) if k else np.zeros(1, np.int64)
    flat = np.frombuffer(words.buffers()[2], np.uint8) if k and off[-1] else np.zeros(0, np.uint8)
    ids, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(0, k, 60_000):
        o = off[i : i + 60_001]
        sym, m = bpe.merge_flat(flat[o[0] : o[-1]], np.diff(o), table_["t"])
        ids.append(table_["dense"][sym])
        sizes.append(m)
    return np.concatenate(ids), np.concatenate(sizes)


def with_words(table_: dict, words: list[bytes]) -> dict:
    """The table with the pieces of these words at hand, so that `coded` does not merge them again in every batch."""
    some = pa.array([w for w in words if w != END], pa.binary())
    ids, sizes = merged(some, table_)
    return table_ | {"known": (some, ids.astype(np.int32), sizes.cumsum() - sizes, sizes)}


def coded(texts: pa.ChunkedArray, table_: dict) -> tuple:
    """(distinct words, the end last; each token's word; texts' token counts; pieces of the distinct words; where each word's begin, and
    how many they are) of whole texts."""
    words, n = worded(texts)
    d = words.dictionary_encode()
    some = d.dictionary.cast(pa.binary())
    tokens, k = n + 1, len(some)
    which = np.full(int(tokens.sum()), k)
    inside = np.ones(len(which), bool)
    inside[tokens.cumsum() - 1] = False
    which[inside] = d.indices.to_numpy()
    if len(held := table_.get("known", [()])[0]):
        at = pc.fill_null(pc.index_in(some, value_set=held), -1).to_numpy()
        _, pieces, first, many = table_["known"]
        new = at < 0
        fresh, m = merged(some.filter(pa.array(new)), table_)
        sizes = np.empty(k, np.int64)
        sizes[new], sizes[~new] = m, many[at[~new]]
        ids, old = np.empty(int(sizes.sum()), np.int64), np.repeat(~new, sizes)
        ids[~old], ids[old] = fresh, pieces[runs(first[at[~new]], sizes[~new])]
    else:
        ids, sizes = merged(some, table_)
    ids, sizes = np.r_[ids, table_["n"] - 1], np.r_[sizes, 1]
    return pa.concat_arrays([some, pa.array([END], pa.binary())]), which, tokens, ids, sizes.cumsum() - sizes, sizes


def text_pieces(which: np.ndarray, tokens: np.ndarray, ids: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pieces of all tokens, texts' piece counts)."""
    k = sizes[which]
    return ids[runs(first[which], k)], np.add.reduceat(k, tokens.cumsum() - tokens)


def windows(ids: np.ndarray, end: int, per: np.ndarray | None = None, pick: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(inputs, targets) of a text's pieces (its end last), or of texts of `per` pieces one after the other: each window scores the next
    CHUNK pieces, each piece being scored once, and sees BEFORE inputs more. Inputs before the text's start are -1, missing
    targets -1. With `pick` only these windows."""
    per = np.array([len(ids)]) if per is None else per
    n = -(-per // CHUNK)
    at, rows = n.cumsum() - n, np.arange(n.sum()) if pick is None else pick
    place, text = np.arange(len(ids)), np.repeat(np.arange(len(per)), n)[rows]
    targets = np.full(n.sum() * CHUNK, -1, np.int64)
    targets[place + np.repeat(at * CHUNK - (per.cumsum() - per), per)] = ids
    # A text's inputs: BEFORE absent ones, an end, its pieces.
    more = BEFORE + 1
    before = np.zeros(len(targets) + more * len(per), np.int64)
    start = at * CHUNK + more * np.arange(len(per))
    before[(start[:, None] + np.arange(BEFORE)).ravel()] = -1
    before[start + BEFORE] = end
    before[place + np.repeat(start + more - (per.cumsum() - per), per)] = ids
    return before[(rows * CHUNK + more * text)[:, None] + np.arange(CONTEXT)], targets.reshape(-1, CHUNK)[rows]


class Model:
    """One causal self-attention layer and a feed-forward layer over piece ids; the next piece is predicted as class, then
    piece in class. Class logits also have terms of the last two pieces, the first of which starts at smoothed pair frequencies."""

    def __init__(self, p: dict) -> None:
        self.p = p
        self.mask = np.where(np.arange(CONTEXT)[None, :] <= np.arange(BEFORE, CONTEXT)[:, None], 0.0, -1e9).astype(np.float32)

    def fast(self) -> None:
        """Projections of every piece, so that scoring looks them up, and the output tables of each class with its bias as a row."""
        p, d = self.p, self.p["E"].shape[1]
        for n in "qkv":
            w = p["W" + n] * (np.float32(d**-0.5) if n == "q" else 1)
            setattr(self, n, (p["E"] @ w).astype(np.float32))
            setattr(self, "p" + n, (p["P"] @ w).astype(np.float32))
        members = [np.flatnonzero(p["cls"] == c) for c in range(p["Wc"].shape[1])]
        self.U = [np.vstack([p["U"][m].T, p["bu"][m][None]]).astype(np.float32) for m in members]
        self.cls = p["cls"].astype(np.uint16)  # sorted by digits
        self.inside = np.zeros(len(p["cls"]), np.int64)
        for m in members:
            self.inside[m] = np.arange(len(m))

    def score(self, inputs: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """log10 probability of each target (0 where it is -1)."""
        small = np.r_[self.p["small"], -1]  # -1 stays
        out = np.zeros(targets.shape, np.float64)
        for at in range(0, len(inputs), BATCH):
            out[at : at + BATCH] = self._score(small[inputs[at : at + BATCH]], small[targets[at : at + BATCH]])
        return out

    def _score(self, ids: np.ndarray, targets: np.ndarray) -> np.ndarray:
        p = self.p
        last = ids[:, BEFORE:]
        look = lambda t, i, more: np.add(x := t.take(i, axis=0, mode="wrap"), more, out=x)
        s = np.matmul(look(self.q, last, self.pq[BEFORE:]), look(self.k, ids, self.pk).transpose(0, 2, 1))
        s += self.mask
        absent = ids[:, 0] < 0  # a text's first window: nothing stands before its start
        if absent.any():
            s[absent] += np.where(ids[absent] < 0, np.float32(-1e9), np.float32(0))[:, None, :]
        if s.max() > 60:
            np.minimum(s, 60, out=s)
        np.exp(s, out=s)
        o = np.matmul(s, look(self.v, ids, self.pv))
        o /= np.einsum("ijk->ij", s)[:, :, None]
        n, d = targets.size, o.shape[2]
        prev, y, prev2 = last.ravel(), targets.ravel(), ids[:, BEFORE - 1 : -1].ravel()
        h = o.reshape(n, d) @ p["Wo"]
        h += look(p["E"], last, p["P"][BEFORE:]).reshape(n, d)
        a = h @ p["W1"]
        a += p["b1"]
        z = np.ones((n, d + 1), np.float32)
        z[:, :d] = h
        z[:, :d] += np.maximum(a, 0, out=a) @ p["W2"]
        g = z[:, :d] @ p["Wc"]
        g += p["B"].take(prev, axis=0, mode="wrap")
        g += p["B2"].take(prev2, axis=0, mode="wrap")
        if g.max() > 60:
            np.minimum(g, 60, out=g)
        cls = self.cls.take(y, mode="wrap")
        lp = g[np.arange(n), cls] - np.log(np.einsum("ij->i", np.exp(g, out=g)))
        order = np.argsort(cls, kind="stable")
        cuts = np.searchsorted(cls[order], np.arange(len(self.U) + 1)).tolist()
        zs, at = z[order], self.inside.take(y[order], mode="wrap")
        inner = np.empty(n, np.float32)
        for c, u in enumerate(self.U):
            i, j = cuts[c], cuts[c + 1]
            if j > i:
                e = zs[i:j] @ u
                if e.max() > 60:
                    np.minimum(e, 60, out=e)
                own = e[np.arange(j - i), at[i:j]]
                inner[i:j] = own - np.log(np.einsum("ij->i", np.exp(e, out=e)))
        lp[order] += inner
        lp[y == len(p["E"]) - 1] -= p["share"]
        return np.where(y >= 0, lp / np.log(10), 0).reshape(targets.shape)


def classes_of(m: np.ndarray, unigrams: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Classes of pieces that follow alike pieces: k-means on a few singular vectors of `m` (root shares of what stands before
    each piece, or a projection of them), clusters being cut by frequency."""
    seen = np.flatnonzero(unigrams > 0)
    m = m[seen]
    u, s, _ = np.linalg.svd(m - m.mean(0), full_matrices=False)
    f = u[:, :12] * s[:12]
    k = min(k, len(seen))
    centre = f[rng.choice(len(seen), k, replace=False)]
    for _ in range(15):
        near = ((centre**2).sum(1) - 2 * f @ centre.T).argmin(1)
        for c in range(k):
            if (near == c).any():
                centre[c] = np.average(f[near == c], axis=0, weights=unigrams[seen][near == c])
    # Each cluster is cut by frequency, so that a frequent piece competes with few: 24 pieces, then twice as many each time.
    cls, made = np.zeros(len(unigrams), np.int64), 0
    for c in range(k):
        members = seen[near == c][np.argsort(-unigrams[seen][near == c], kind="stable")]
        at, size = 0, 24
        while at < len(members):
            cls[members[at : at + size]] = made
            made, at, size = made + 1, at + size, 2 * size
    return cls


def start(uni: np.ndarray, follow: np.ndarray, cls: np.ndarray, rng: np.random.Generator, dim: int = 16, wide: int = 32) -> dict:
    """Parameters before fitting: `bu` and `B` from counts of pieces and of classes after pieces, the others at random."""
    n, k = len(uni), int(cls.max()) + 1
    share = np.bincount(cls, uni + 0.1, minlength=k)
    share /= share.sum()
    b = np.log((follow + 20 * share) / (follow.sum(1, keepdims=True) + 20))
    size = lambda *s: rng.standard_normal(s) * s[0] ** -0.5
    p = {"E": rng.standard_normal((n, dim)) * 0.3, "P": rng.standard_normal((CONTEXT, dim)) * 0.1, "Wq": size(dim, dim), "Wk": size(dim, dim), "Wv": size(dim, dim), "Wo": size(dim, dim) * 0.3, "W1": size(dim, wide), "b1": np.zeros(wide), "W2": size(wide, dim) * 0.3, "Wc": size(dim, k) * 0.1, "B": b, "B2": np.zeros((n, k)), "U": rng.standard_normal((n, dim)) * 0.05, "bu": np.log(uni + 0.1)}
    return {a: x.astype(np.float32) for a, x in p.items()} | {"cls": cls}


def fit(p: dict, batches, steps: int | None, rate: float) -> None:
    """Fits `p` in place by Adam to batches (inputs, targets) of windows, `steps` at most, with falling steps; to all at one rate without `steps`."""
    members = [np.flatnonzero(p["cls"] == c) for c in range(p["Wc"].shape[1])]
    inside = np.zeros(len(p["cls"]), np.int64)
    for m in members:
        inside[m] = np.arange(len(m))
    by_class = np.concatenate(members)
    now = {a: x for a, x in p.items() if a not in ("cls", "U", "bu")} | {"O": np.hstack([p["U"], p["bu"][:, None]])[by_class]}
    m1, m2, move = ({a: np.zeros_like(x) for a, x in now.items()} for _ in range(3))
    cls, ends = p["cls"].astype(np.uint16), np.cumsum([0, *map(len, members)]).tolist()
    for step, (x, y) in enumerate(itertools.islice(batches, steps)):
        lr, root = rate * min(1, (step + 1) / 30) * (1 - 0.9 * step / steps if steps else 1) / (1 - 0.9 ** (step + 1)), (1 - 0.99 ** (step + 1)) ** 0.5
        for a, (rows, g) in gradients(now, x, y, cls, inside, ends).items():
            one, two, by = m1[a], m2[a], move[a]
            one *= np.float32(0.9)
            two *= np.float32(0.99)
            one[rows] += np.float32(0.1) * g
            two[rows] += np.float32(0.01) * (g * g)
            np.sqrt(two, out=by)
            by += np.float32(1e-8 * root)
            np.divide(one, by, out=by)
            by *= np.float32(lr * root)
            now[a] -= by
    p["U"][by_class], p["bu"][by_class] = now["O"][:, :-1], now["O"][:, -1]


def drawn(inputs: np.ndarray, targets: np.ndarray, steps: int, batch: int, rng: np.random.Generator):
    """Batches of windows in random order, again from the start when all were taken."""
    order = rng.permutation(len(inputs))
    for step in range(steps):
        rows = order[np.arange(step * batch, (step + 1) * batch) % len(order)]
        yield inputs[rows], targets[rows]


def train(texts: list[bytes], table_: dict, groups: int = 24, steps: int = 1000, batch: int = 144, rate: float = 5e-3, seed: int = 11) -> dict:
    """Parameters fitted to a few whole texts at hand."""
    rng = np.random.default_rng(seed)
    n = table_["n"]
    end = n - 1
    inputs, targets = [np.zeros((0, CONTEXT), np.int64)], [np.zeros((0, CHUNK), np.int64)]
    for raw in texts:
        words = raw.lower().split()
        x, y = windows(np.r_[pieces_of(words, table_)[0] if words else np.zeros(0, np.int64), end], end)
        inputs.append(x)
        targets.append(y)
    inputs, targets = np.concatenate(inputs), np.concatenate(targets)
    some, inputs, targets = narrowed(np.unique(targets[targets >= 0]), n, inputs, targets)
    live, m = targets >= 0, len(some)
    uni = np.bincount(targets[live], minlength=m).astype(np.float64)
    pairs = np.zeros((m, m))
    np.add.at(pairs, (inputs[:, BEFORE:][live], targets[live]), 1)
    cls = classes_of(np.sqrt(pairs.T / np.maximum(uni[:, None], 1)), uni, groups, rng) if len(inputs) else np.zeros(m, np.int64)
    p = start(uni, pairs @ (cls[:, None] == np.arange(cls.max() + 1)), cls, rng)
    if len(inputs):
        fit(p, drawn(inputs, targets, steps, batch, rng), steps, rate)
    return finished(p, some, n)


def narrowed(seen: np.ndarray, n: int, *ids: np.ndarray) -> tuple:
    """The pieces that occur, and arrays of pieces as rows of a table of those; its row of the end is the last, as in the full one."""
    some = np.union1d(seen, [n - 1])
    dense = np.full(n + 1, -1)  # -1 stays
    dense[some] = np.arange(len(some))
    return some, *[dense[x] for x in ids]


def added(codes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes and the sums of their times."""
    order = np.argsort(codes)
    codes = codes[order]
    cuts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    return codes[cuts], np.add.reduceat(times[order], cuts)


def window_hashes(texts: pa.ChunkedArray, count: np.ndarray) -> np.ndarray:
    """A 32-bit hash of each window of the texts, which have `count` windows each."""
    seed = np.array([zlib.crc32(x) for x in texts.cast(pa.binary()).fill_null(b"").to_pylist()], np.uint64) * np.uint64(0x9E3779B1)
    z = np.repeat(seed, count) + (np.arange(count.sum()) - np.repeat(count.cumsum() - count, count)).astype(np.uint64) * np.uint64(0x85EBCA6B)
    z = ((z ^ z >> np.uint64(15)) & np.uint64(0xFFFFFFFF)) * np.uint64(0x2C1B3C6D)
    return (z ^ z >> np.uint64(28)) & np.uint64(0xFFFFFFFF)


def piece_rows(docs: DataFrame, table_: dict, share: int, text_col: str = "text") -> DataFrame:
    """(prev, cur, c): counts of neighbouring pieces of all whole texts, the end standing before a text too; tasks give out partial counts.
    (h, x, y): one window in `share` of every text, chosen by hash, as bytes of 32-bit pieces: where a fit begins. A last row a task has the
    number of all its windows as c, without pieces."""
    held = docs.sparkSession.sparkContext.broadcast(table_)

    def make(batches):
        pieces = held.value
        n = pieces["n"]
        held_counts: list = []  # (codes, times) of batches, summed now and then
        seen = 0

        def summed_up() -> tuple[np.ndarray, np.ndarray]:
            if not held_counts:
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
            return added(np.concatenate([x for x, _ in held_counts]), np.concatenate([x for _, x in held_counts]))

        void = lambda k, t: pa.nulls(k, t)
        names = ["prev", "cur", "c", "h", "x", "y"]

        def counted(codes, times):
            k = len(codes)
            return pa.RecordBatch.from_arrays([pa.array(codes // n, pa.int32()), pa.array(codes % n, pa.int32()), pa.array(times), void(k, pa.int64()), void(k, pa.binary()), void(k, pa.binary())], names)

        for t in gathered(batches, 4 << 20):
            words, which, tokens, ids, first, sizes = coded(t.column(0), pieces)
            # Pairs within a word as often as the word; then the pair at each token's start. A text ends with the end, so the
            # piece before the next text's first is the end.
            inner = np.ones(len(ids), bool)
            inner[first] = False
            inner = np.flatnonzero(inner)
            last = ids[first + sizes - 1]
            codes = np.r_[ids[inner - 1] * n + ids[inner], last[np.r_[len(words) - 1, which[:-1]]] * n + ids[first[which]]]
            held_counts.append(added(codes, np.r_[np.repeat(np.bincount(which, minlength=len(words)), sizes - 1), np.ones(len(which), np.int64)]))
            flat, per = text_pieces(which, tokens, ids, first, sizes)
            if sum(len(x) for x, _ in held_counts) > 2_000_000:
                sums = summed_up()
                held_counts[:] = [sums]
                if len(sums[0]) > 500_000:
                    yield counted(*sums)
                    held_counts.clear()
            count = -(-per // CHUNK)
            seen += int(count.sum())
            z = window_hashes(t.column(0), count)
            pick = np.flatnonzero(z % np.uint64(share) == 0)
            if len(pick):
                cells = lambda w: pa.array([r.tobytes() for r in w.astype(np.int32)], pa.binary())
                x, y = windows(flat, n - 1, per, pick)
                k, h = len(pick), (z[pick] // np.uint64(share)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([void(k, pa.int32()), void(k, pa.int32()), void(k, pa.int64()), pa.array(h), cells(x), cells(y)], names)
        yield counted(*summed_up())
        yield pa.RecordBatch.from_arrays([void(1, pa.int32()), void(1, pa.int32()), pa.array([seen]), void(1, pa.int64()), void(1, pa.binary()), void(1, pa.binary())], names)

    return map_arrow(docs.select(text_col), make, "prev int, cur int, c long, h long, x binary, y binary")


def unpacked(rows) -> tuple[np.ndarray, np.ndarray]:
    """Arrays of (x, y) of stored windows."""
    cell = lambda c, k: np.frombuffer(b"".join(rows.column(c).to_pylist()), np.int32).reshape(-1, k).astype(np.int64)
    return cell("x", CONTEXT), cell("y", CHUNK)


def learned(learn: DataFrame, table_: dict, words: int, text_col: str = "text", groups: int = 24, steps: int = 1000, batch: int = 144, rate: float = 5e-3, rounds: int = 2, seed: int = 11) -> dict:
    """Parameters learned from all texts of `learn`, which has `words` words.

    Piece, pair and class counts cover every text whole. The fit begins on the driver with about steps * batch windows of a large
    table; then, if there are more, all windows of all texts are fitted in `rounds` rounds of tasks, each text in one round, that fit on
    from the same parameters and are averaged. Tasks make the windows of their texts as they go, and none is stored."""
    spark, n, rng = learn.sparkSession, table_["n"], np.random.default_rng(seed)
    share = int(max(1, words // 1_000_000))  # of the windows with which the fit begins
    rows = stored(piece_rows(learn, table_, share, text_col))
    pairs = stored(rows.where("prev is not null").groupBy("prev", "cur").agg(F.sum("c").alias("c")))
    # Signed hashing of the piece before: a projection of all pairs on 64 columns. One row a piece of the tokenizer reaches the driver.
    h, root = F.xxhash64("prev"), F.sqrt("c")
    signed = F.when(F.pmod(F.shiftright(h, 8), 2) == 0, root).otherwise(-root)
    f = pairs.groupBy("cur").agg(F.sum("c").alias("n"), *[F.sum(F.when(F.pmod(h, 64) == i, signed).otherwise(0.0)).alias(f"f{i}") for i in range(64)]).orderBy("cur").toArrow()
    cur = f.column("cur").to_numpy().astype(np.int64)
    some, at = narrowed(cur, n, cur)
    uni = np.zeros(len(some))
    uni[at] = f.column("n").to_numpy()
    if not uni.any():
        return finished(start(uni, np.zeros((len(some), 1)), np.zeros(len(some), np.int64), rng), some, n)
    m = np.zeros((len(some), 64))
    m[at] = np.column_stack([f.column(f"f{i}").to_numpy() for i in range(64)])
    cls = classes_of(m / np.sqrt(np.maximum(uni, 1))[:, None], uni, groups, rng)
    of = spark.createDataFrame(pa.table({"cur": pa.array(some, pa.int32()), "cls": pa.array(cls, pa.int32())}))
    t = pairs.join(F.broadcast(of), "cur").groupBy("prev", "cls").agg(F.sum("c").alias("c")).toArrow()  # pieces times classes at most
    follow = np.zeros((len(some), int(cls.max()) + 1))
    _, prev = narrowed(cur, n, t.column("prev").to_numpy().astype(np.int64))
    follow[prev, t.column("cls").to_numpy()] = t.column("c").to_numpy()
    p = start(uni, follow, cls, rng)
    first = p["E"].copy()
    kept = rows.where("x is not null").select("h", "x", "y")
    total, windows_ = kept.count(), rows.where("c is not null and prev is null").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    part = kept if total <= steps * batch else kept.where(F.pmod("h", F.lit(1 << 20)) < (steps * batch << 20) // total)
    _, x, y = narrowed(cur, n, *unpacked(part.orderBy("h", "x", "y").select("x", "y").toArrow()))
    if len(x):
        fit(p, drawn(x, y, steps, batch, rng), steps, rate)
    texts = learn.select(F.coalesce(F.col(text_col), F.lit("")).alias("t")).withColumn("h", F.crc32(F.col("t").cast("binary")))
    if windows_ > len(x) or windows_ > steps * batch:
        for r in range(rounds):
            # Dealt out evenly (Spark does so by the rows' order in each file) and put in order: a task that runs again fits to the same windows in the
            # same way. Every task gives out one set of parameters, so there are no more tasks than windows ask for.
            each = windows_ // rounds
            dealt = texts.where(F.pmod("h", F.lit(rounds)) == r).repartition(max(1, min(each // 20_000, max(32, each // 200_000)))).sortWithinPartitions("h", "t")
            p = averaged(dealt.select("t"), table_, p, cur, n, rate / 5 / (r + 1))
    still = (p["E"] == first).all(1)  # inputs that no fitted window had
    if still.any() and not still.all():
        p["E"][still] = p["E"][~still].mean(0)
    dropped(rows, pairs)
    return finished(p, some, n)


def averaged(texts: DataFrame, table_: dict, p: dict, cur: np.ndarray, n: int, rate: float, batch: int = 512, cell: int = 16_384) -> dict:
    """`p` fitted on in each task of `texts` to all windows of its whole texts, about 4 MB of text at a time, in the order of their hashes; the mean over
    tasks, weighted by their windows. Means are taken in cells of the parameters, so the driver gets one set whatever the number of tasks."""
    names = [a for a in p if a != "cls"]
    held = texts.sparkSession.sparkContext.broadcast((p, cur, table_))

    def make(batches):
        import pyspark

        old, seen, pieces = held.value
        new, task, total = {a: x.copy() for a, x in old.items()}, pyspark.TaskContext.get().partitionId(), 0

        def fitting():
            nonlocal total
            for t in gathered(batches, 4 << 20):
                _, which, tokens, ids, first, sizes = coded(t.column(0), pieces)
                flat, per = text_pieces(which, tokens, ids, first, sizes)
                _, x, y = narrowed(seen, n, *windows(flat, pieces["n"] - 1, per))
                order = np.argsort(window_hashes(t.column(0), -(-per // CHUNK)), kind="stable")
                total += len(order)
                for i in range(0, len(order), batch):
                    yield x[order[i : i + batch]], y[order[i : i + batch]]

        fit(new, fitting(), None, rate)
        if not total:
            return
        flat = np.concatenate([new[a].ravel() for a in names])
        cuts = range(0, len(flat), cell)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(cuts)), pa.int32()), pa.array([task] * len(cuts), pa.int32()), pa.array([total] * len(cuts), pa.int64()), pa.array([flat[i : i + cell].tobytes() for i in cuts], pa.binary())], ["cell", "task", "w", "v"])

    def mean(t):
        t = t.sort_by("task")  # sums of floats depend on their order
        w = t.column("w").to_numpy().astype(np.float64)
        total = sum(k * np.frombuffer(v.as_py(), np.float32) for k, v in zip(w, t.column("v"), strict=True)) / w.sum()
        return pa.table({"cell": t.column("cell").slice(0, 1), "v": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    out = stored(map_arrow(texts, make, "cell int, task int, w long, v binary")).groupBy("cell").applyInArrow(mean, "cell int, v binary").toArrow().sort_by("cell")
    if not out.num_rows:
        return p
    flat, at, new = np.frombuffer(b"".join(out.column("v").to_pylist()), np.float32), 0, {"cls": p["cls"]}
    for a in names:
        new[a] = flat[at : at + p[a].size].reshape(p[a].shape).copy()
        at += p[a].size
    return new


def grouped(rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order that puts equal rows of a table of `n` together, where each begins there, the distinct rows)."""
    order = np.argsort(rows.astype(np.uint16) if n <= 1 << 16 else rows, kind="stable")  # short integers are sorted by digits
    rows = rows[order]
    cuts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    return order, cuts, rows[cuts]


def group_sums(values: np.ndarray, cuts: np.ndarray, large: int = 48) -> np.ndarray:
    """Sums of groups of rows that begin at `cuts`; those of `large` groups one by one as products, which add many rows faster."""
    sizes = np.diff(np.r_[cuts, len(values)])
    big = sizes >= large
    out = np.empty((len(cuts), values.shape[1]), np.float32)
    if big.all():
        small = np.zeros(0, np.int64)
    else:
        rest = values[np.repeat(~big, sizes)] if big.any() else values
        small = np.flatnonzero(~big)
        out[small] = np.add.reduceat(rest, sizes[small].cumsum() - sizes[small], axis=0)
    ones = np.ones(int(sizes.max()), np.float32)
    for i in np.flatnonzero(big).tolist():
        at, k = cuts[i], sizes[i]
        np.dot(ones[:k], values[at : at + k], out=out[i])
    return out


def finished(p: dict, some: np.ndarray, n: int) -> dict:
    """The fitted parameters with one more row, for all pieces that never occurred: a mean input, and a class of their own that has a
    millionth of the probability, shared evenly. `small` maps a piece to its row."""
    out = {a: p[a] for a in ("P", "Wq", "Wk", "Wv", "Wo", "W1", "b1", "W2")}
    row = lambda a, x: np.vstack([p[a], x[None]]).astype(np.float32)
    k = p["Wc"].shape[1]
    out |= {"E": row("E", p["E"].mean(0)), "U": row("U", np.zeros(p["U"].shape[1])), "B": row("B", p["B"].mean(0)), "B2": row("B2", p["B2"][-1])}  # -1: nothing before
    out["bu"], out["cls"] = np.r_[p["bu"], 0].astype(np.float32), np.r_[p["cls"], k]
    level = np.log(np.exp(out["B"]).sum(1, keepdims=True)) + np.log(1e-6)
    out["B"], out["B2"] = np.hstack([out["B"], level]).astype(np.float32), np.hstack([out["B2"], np.zeros((len(out["B2"]), 1))]).astype(np.float32)
    out["Wc"] = np.hstack([p["Wc"], np.zeros((p["Wc"].shape[0], 1), np.float32)])
    out["small"] = np.full(n, len(some))
    out["small"][some] = np.arange(len(some))
    out["share"] = np.log(max(1, n - len(some)))
    return out


def gradients(p: dict, ids: np.ndarray, targets: np.ndarray, cls: np.ndarray, inside: np.ndarray, ends: list[int]) -> dict:
    """Mean-loss gradients of a batch of windows, as (rows, gradient of these rows) of each table. `O` has the output rows and biases
    in the order of classes, which begin and end at `ends`; `inside` is a piece's place in its class. Logits are bounded as in scoring."""
    d, w, n, whole = p["E"].shape[1], len(ids), targets.size, slice(None)
    last, scale, ones = len(p["E"]) - 1, np.float32(d**-0.5), np.ones(max(n, len(p["E"]), CONTEXT, p["Wc"].shape[1]), np.float32)
    flat = lambda t: t.reshape(-1, t.shape[-1])
    first = np.flatnonzero(ids[:, 0] < 0)  # texts' first windows: nothing stands before their start
    absent = ids[first] < 0
    ids = np.where(ids < 0, last, ids)  # as piece before, -1 stands for the last row, whose piece (the end) is never there else
    x = p["E"].take(ids, axis=0)
    x += p["P"]
    xq = np.ascontiguousarray(x[:, BEFORE:])
    q = (flat(xq) @ (p["Wq"] * scale)).reshape(xq.shape)
    k, v = (flat(x) @ p["Wk"]).reshape(x.shape), (flat(x) @ p["Wv"]).reshape(x.shape)
    s = np.matmul(q, k.transpose(0, 2, 1))
    s += np.where(np.arange(CONTEXT)[None, :] <= np.arange(BEFORE, CONTEXT)[:, None], np.float32(0), np.float32(-1e9))
    s[first] += np.where(absent, np.float32(-1e9), np.float32(0))[:, None, :]
    bounded(s)
    s /= (flat(s) @ ones[:CONTEXT]).reshape(w, CHUNK, 1)
    o = np.matmul(s, v)
    h = flat(o) @ p["Wo"]
    h += flat(xq)
    a = h @ p["W1"]
    a += p["b1"]
    np.maximum(a, 0, out=a)
    z = np.ones((n, d + 1), np.float32)
    np.add(h, a @ p["W2"], out=z[:, :d])
    y, prev, prev2 = targets.ravel(), ids[:, BEFORE:].ravel(), ids[:, BEFORE - 1 : -1].ravel()
    share = (y >= 0).astype(np.float32)
    share /= max(1, np.count_nonzero(share))
    own = cls.take(y, mode="wrap")
    g: dict = {}
    # Classes, positions standing by the piece before.
    order, cuts, rows = grouped(prev, last + 1)
    zs, prev2, part = z[order, :d], prev2[order], share[order]
    e = zs @ p["Wc"]
    e += p["B"].take(prev[order], axis=0)
    e += p["B2"].take(prev2, axis=0)
    bounded(e)
    e *= (part / (e @ ones[: e.shape[1]]))[:, None]
    e[np.arange(n), own[order]] -= part
    g["Wc"], g["B"] = (whole, zs.T @ e), (rows, group_sums(e, cuts))
    dz = np.empty((n, d), np.float32)
    dz[order] = e @ p["Wc"].T
    order, cuts, rows = grouped(prev2, last + 1)
    g["B2"] = rows, group_sums(e.take(order, axis=0), cuts)
    # Pieces in their classes, positions standing by class.
    order = np.argsort(own, kind="stable")
    cuts = np.searchsorted(own[order], np.arange(len(ends))).tolist()
    zs, part = z[order], share[order]
    sizes = np.diff(ends)[own[order]]
    at = sizes.cumsum() - sizes
    chosen = at + inside.take(y[order], mode="wrap")
    e = np.empty(int(sizes.sum()), np.float32)
    at = [*at.tolist(), len(e)]
    blocks = [(i, j, u, e[at[i] : at[j]].reshape(j - i, -1), p["O"][u]) for i, j, u in zip(cuts[:-1], cuts[1:], map(slice, ends[:-1], ends[1:]), strict=True) if i < j]
    for i, j, _, block, rows in blocks:
        np.matmul(zs[i:j], rows.T, out=block)
    bounded(e)
    for i, j, _, block, rows in blocks:
        block *= (part[i:j] / (block @ ones[: len(rows)]))[:, None]
    e[chosen] -= part
    out, ds = np.zeros_like(p["O"]), np.empty((n, d), np.float32)
    for i, j, u, block, rows in blocks:
        np.matmul(block.T, zs[i:j], out=out[u])
        np.matmul(block, rows[:, :d], out=ds[i:j])
    g["O"] = whole, out
    dz[order] += ds
    # Back through the layers.
    da = dz @ p["W2"].T
    da *= a > 0
    g["W2"], g["W1"], g["b1"] = (whole, a.T @ dz), (whole, h.T @ da), (whole, ones[:n] @ da)
    dz += da @ p["W1"].T
    g["Wo"] = whole, flat(o).T @ dz
    do = (dz @ p["Wo"].T).reshape(o.shape)
    ds = np.matmul(do, v.transpose(0, 2, 1))
    ds -= np.einsum("ijk,ijk->ij", do, o)[:, :, None]
    ds *= s
    dv, dk, dq = flat(np.matmul(s.transpose(0, 2, 1), do)), flat(np.matmul(ds.transpose(0, 2, 1), q)), flat(np.matmul(ds, k))
    g["Wq"], g["Wk"], g["Wv"] = (whole, flat(xq).T @ dq * scale), (whole, flat(x).T @ dk), (whole, flat(x).T @ dv)
    dx = dk @ p["Wk"].T
    dx += dv @ p["Wv"].T
    dx = dx.reshape(x.shape)
    dz += dq @ (p["Wq"].T * scale)
    dx[:, BEFORE:] += dz.reshape(xq.shape)
    dx[first] *= ~absent[:, :, None]
    g["P"] = whole, (ones[:w] @ dx.reshape(w, -1)).reshape(CONTEXT, d)
    order, cuts, rows = grouped(ids.ravel(), last + 1)
    g["E"] = rows, group_sums(flat(dx).take(order, axis=0), cuts)
    return g


def bounded(e: np.ndarray) -> None:
    """exp of the logits in place, at most e^60."""
    if e.max(initial=0) > 60:
        np.minimum(e, 60, out=e)
    np.exp(e, out=e)


# Scoring -------------------------------------------------------------------------------------------------------------


def score_texts(docs: DataFrame, learn: DataFrame, path: str | None = None, merges: int = 50_000, max_frequent: int = 150_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores each whole text of `docs` by what `learn` teaches.

    Words (A-Z lower-cased) and one end a text are the tokens. base_score: log10 of the add-one unigram model over all words
    of `learn`. Words with high counts, at most `max_frequent`, are broadcast; the others are joined by word. score: log10
    probability under the attention model over word pieces (the public tokenizer at `path`, its first `merges` merges), learned
    from all texts of `learn` (see `learned`); each piece is scored once, by windows that overlap by a third. Null and empty texts have the end only. Repeated rows are scored each; an empty table gives no rows; if
    `learn` is empty all counts are 0. Returns doc_id, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    counts = stored(word_counts(learn, text_col))
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, space = int(totals.n), int(totals.n + totals.v + 1)
    known, least = frequent(counts, max_frequent)
    table_ = with_words(pieces_table(path or bpe.tokenizer_path(), merges), list(known))
    held = spark.sparkContext.broadcast((learned(learn, table_, n, text_col), table_, known))

    def make(batches):
        params, pieces, common = held.value
        model = Model(params)
        model.fast()
        end, log_space = pieces["n"] - 1, np.log10(space)
        table_words = pa.array(list(common), pa.binary())
        table_logs = np.r_[np.log10(np.array(list(common.values()), np.float64) + 1), np.nan]  # the last: not in the table

        for b in gathered(batches, 2 << 20):
            words, which, n_tokens, ids, first, sizes = coded(b.column(1), pieces)
            base = table_logs[pc.fill_null(pc.index_in(words, value_set=table_words), len(table_words)).to_numpy()]
            starts = n_tokens.cumsum() - n_tokens
            value = base[which]
            rare = np.isnan(value)
            value[rare] = 0
            have = n_tokens - np.add.reduceat(rare.astype(np.int64), starts)
            sums = np.add.reduceat(value, starts) - n_tokens * log_space
            # Pieces of all words of the batch in one array, then windows a text.
            flat, per = text_pieces(which, n_tokens, ids, first, sizes)
            lp = model.score(*windows(flat, end, per)).sum(1)
            rows = -(-per // CHUNK)
            scores = np.add.reduceat(lp, rows.cumsum() - rows)
            # Rarer words wait for their counts, one entry a text and word.
            text = np.repeat(np.arange(len(n_tokens)), n_tokens)[rare]
            pair, times = np.unique(text * np.int64(len(words)) + which[rare], return_counts=True)
            word = words.take(pa.array(pair % len(words)))
            offsets = np.searchsorted(pair // len(words), np.arange(len(n_tokens) + 1))
            entries = pa.StructArray.from_arrays([word, pa.array(times, pa.int32())], ["word", "times"])
            yield pa.RecordBatch.from_arrays([b.column(0).combine_chunks(), pa.array(n_tokens), pa.array(have), pa.array(sums), pa.array(scores), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), entries)], ["doc_id", "n_tokens", "have", "sums", "score", "rare"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = map_arrow(docs.select(F.col(id_col), F.col(text_col)), make, f"doc_id {kind}, n_tokens long, have long, sums double, score double, rare array<struct<word:binary,times:int>>")
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()))
    rare = rows.select("row", F.explode("rare").alias("r")).select("row", F.col("r.word").alias("word"), F.col("r.times").alias("times"))
    # Counts below `least`, and of words too long for the broadcast table.
    others = counts.where(((F.col("c") < least) | (F.octet_length("word") > 64)) & (F.col("word") != END))
    found = rare.join(others, "word").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("extra"), F.sum("times").alias("more"))
    out = rows.drop("rare").join(found, "row", "left")
    return out.select("doc_id", "n_tokens", (F.col("have") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("sums") + F.coalesce("extra", F.lit(0.0))).alias("base_score"), "score")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score_texts(docs, docs.where(bucket("doc_id", 7) != 2))
    return out.select("doc_id", (bucket("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
