"""Operator 8: exact Jaccard self-join of word shingle sets: size-banded tiles, bitmap bounds, sorted-array intersection."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Forest, components, dropped, map_arrow, stored, table

SURE = 100  # keys that are kept of a set's parts in a band, about


class Bands:
    """Sizes in bands that grow by half, and the number of parts that a set of each band is dealt into.

    Sets of a and b shingles with Jaccard similarity of at least percent/100 differ in at most D = (a+b)(100-percent)/(100+percent)
    shingles. A set is dealt by hash into k > D parts, so at least k - D parts are equal in both. Thin parts are poor keys: each set leaves
    out parts below the largest size that fewer than k - D of its own parts stay under. One equal part then reaches both
    sets' sizes, so both give it out.

    Long sets have far more equal parts than one: of those of linked sets, which hold 0.4 k on average even at D differences, a share of
    the keys by hash is kept, about SURE of k; a pair is missed with a chance below 1e-14, as by a collision of hashes."""

    def __init__(self, percent: int) -> None:
        self.percent = percent
        # Below `least` shingles a linked set of another content is impossible: it would differ in no shingle.
        self.least = next(a for a in range(1, 1000) if self.differ(a, math.floor(100 * a / percent)) >= 1)
        self.highs: list[int] = []
        high = self.least
        while high < 2**40:
            self.highs.append(high)
            high = max(high + 1, high * 3 // 2)
        self.most = [self.differ(h, 100 * h // percent) for h in self.highs]
        self.parts = [d + 5 + math.ceil(0.15 * d) for d in self.most]

    def differ(self, a: int, b: int) -> int:
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    def own(self, n: int) -> int:
        return next(i for i, h in enumerate(self.highs) if n <= h)

    def of(self, n: int) -> list[int]:
        """Bands in which a set of n shingles takes part: its own, and those below that hold a size it can be linked to."""
        if n < self.least:
            return []
        s = self.own(n)
        return [i for i in range(s, -1, -1) if i == s or 100 * self.highs[i] >= self.percent * n]

    def words(self, n: int) -> int:
        """64-bit words of a set's bitmap: a power of two, more bits than shingles up to 65,536 bits."""
        w = 2
        while w < 1024 and 64 * w < 1.25 * self.highs[self.own(max(n, 1))]:
            w *= 2
        return w


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's shingles; remembers at most `keep` words."""

    def __init__(self, width: int, keep: int = 200_000) -> None:
        import xxhash

        self.hash, self.width, self.keep, self.known = xxhash.xxh3_64_intdigest, width, keep, {}
        self.factors = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)

    def __call__(self, raw: bytes | None) -> np.ndarray:
        words = raw.lower().split() if raw else ()  # bytes: A-Z and the six ASCII spaces only
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.known) > self.keep:
            self.known.clear()
        known, make = self.known, self.hash
        for w in set(words).difference(known):
            known[w] = make(w)
        h = np.array([known[w] for w in words], np.uint64)
        width = min(self.width, len(h))
        total = np.full(len(h) - width + 1, width, np.uint64)
        for i in range(width):
            total += h[i : len(h) - width + 1 + i] * self.factors[i]
        return np.unique(mix(total))


def tile_keys(s: np.ndarray, bands: Bands) -> np.ndarray:
    """Keys of the tiles (band, part, content of the part) that a set takes part in."""
    out = []
    for band in bands.of(len(s)):
        k = bands.parts[band]
        part = mix(s ^ np.uint64(band + 1)) % np.uint64(k)
        order = np.argsort(part, kind="stable")
        at, first, n = np.unique(part[order], return_index=True, return_counts=True)
        content = np.zeros(k, np.uint64)
        sizes = np.zeros(k, np.int64)
        content[at.astype(np.int64)] = np.add.reduceat(mix(s[order] + np.uint64(band)), first)
        sizes[at.astype(np.int64)] = n
        keys = mix(content + mix(np.arange(k, dtype=np.uint64) + np.uint64(band << 40)))
        spare = k - bands.most[band] - 1
        keys = keys[sizes >= np.partition(sizes, spare)[spare]]
        out.append(keys[mix(keys ^ np.uint64(91)) % np.uint64(k) < np.uint64(SURE)] if k > SURE else keys)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def bitmap(s: np.ndarray, words: int) -> bytes:
    bits = np.zeros(words * 64, np.uint8)
    bits[(s >> np.uint64(7)).astype(np.int64) & (words * 64 - 1)] = 1
    return np.packbits(bits).tobytes()


def folded(cells: list[bytes], words: int) -> np.ndarray:
    """Bitmaps at one width, a row each: the places of wider ones are equal modulo the width, so their pieces are united."""
    out = np.empty((len(cells), words), np.uint64)
    sizes = np.array([len(c) // 8 for c in cells])
    for w in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == w)
        out[at] = np.bitwise_or.reduce(np.frombuffer(b"".join([cells[i] for i in at]), np.uint64).reshape(len(at), w // words, words), axis=1)
    return out


def shingled(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, f1, f2, keys, bits) of each document: the set's size, a 128-bit fingerprint of the set, its tile keys and a
    bitmap of the set."""

    def make(batches):
        sets, bands = Shingler(width), Bands(percent)
        for b in batches:
            rows = []
            for raw in b.column(1).cast(pa.binary()).to_pylist():
                s = sets(raw)
                f = [int(x) for x in np.array([s.sum(), mix(s + np.uint64(77)).sum()], np.uint64).view(np.int64)]
                rows.append((len(s), *f, tile_keys(s, bands).view(np.int64), bitmap(s, bands.words(len(s))) if len(s) else None))
            n, f1, f2, keys, bits = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.binary())], ["doc_id", "n", "f1", "f2", "keys", "bits"])

    return map_arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col)), make, "doc_id long, n long, f1 long, f2 long, keys array<long>, bits binary")


def tile_rows(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, rep) of the tiles that have two members or more, for one document of each class (a Bloom filter of their ids leaves the copies
    out; one that slips through only repeats its class). Rows are sorted over range partitions by key and member, so a tile of
    any size spreads; a partition's first and last tiles are given out in any case, as they may go on in the next."""
    test, places = membership(classes, "rep")

    def keys(batches):
        held = test.value
        for b in batches:
            at = np.array(b.column(2).to_pylist(), np.int64).reshape(b.num_rows, -1)
            b = b.filter(pa.array(((held[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(1)))
            lists = b.column(1)
            yield pa.RecordBatch.from_arrays([lists.flatten(), pa.array(np.repeat(b.column(0).to_numpy(), np.diff(lists.offsets.to_numpy())))], ["key", "rep"])

    rows = rows.where("n > 0 and doc_id is not null").select(F.col("doc_id").alias("rep"), "keys").withColumn("at", places).mapInArrow(keys, "key long, rep long")

    def runs(batches):
        first, last, given = True, None, False  # last: key of the latest run; given: whether its rows are out
        held = np.zeros((0, 2), np.int64)  # the only row so far of the latest run, if not out
        for b in batches:
            if not b.num_rows:
                continue
            new = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)], 1)
            both = np.concatenate([held, new])
            key = both[:, 0]
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[start, len(key)])
            out = size > 1
            out[0] |= first or (given and key[0] == last)
            keep = np.repeat(out, size)
            first, last, given = False, key[-1], bool(out[-1])
            if not given:
                keep[-1] = False
            held = both[len(both) :] if given else both[-1:]
            yield pa.RecordBatch.from_arrays([pa.array(both[keep, 0]), pa.array(both[keep, 1])], ["key", "rep"])
        yield pa.RecordBatch.from_arrays([pa.array(held[:, 0]), pa.array(held[:, 1])], ["key", "rep"])

    return rows.repartitionByRange("key", "rep").sortWithinPartitions("key", "rep").mapInArrow(runs, "key long, rep long")


def tile_edges(rows: DataFrame, classes: DataFrame, percent: int, block: int = 128, most_blocks: int = 24) -> DataFrame:
    """Edges (a, b), enough to join all sets of a tile whose bitmaps do not rule out a link. Large tiles are compared in pairs of blocks
    of bounded size, each in a group of its own. `rows` come from tile_rows, stored."""
    large = rows.groupBy("key").count().where(F.col("count") > block)
    k = F.greatest(F.least(F.ceil(F.col("count") / block), F.lit(most_blocks)), F.ceil(F.col("count") / 8192)).cast("int")
    df = rows.join(large.select("key", k.alias("k")), "key", "left").withColumn("m", F.pmod(F.xxhash64("rep"), F.coalesce("k", F.lit(1))).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.coalesce("k", F.lit(1)) - 1), lambda y: F.struct(F.least("m", y).alias("x"), F.greatest("m", y).alias("y"), (F.col("m") > y).cast("int").alias("side")))
    df = df.join(classes.groupBy("rep").agg(F.first("n").alias("n"), F.first("bits").alias("bits")), "rep").withColumn("e", F.explode(pairs))
    df = df.select(F.xxhash64("key", "e.x", "e.y").alias("h"), (F.col("e.x") != F.col("e.y")).alias("cross"), "e.side", "rep", "n", "bits")

    def compare(batches):
        def done(t):
            h, cross, side, rep, n = (t.column(c).to_numpy(zero_copy_only=False) for c in ("h", "cross", "side", "rep", "n"))
            cells = t.column("bits").to_pylist()
            start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            least = np.repeat(np.minimum.reduceat(np.array([len(c) // 8 for c in cells]), start), np.diff(np.r_[start, len(h)]))
            left, right = [], []
            for words in np.unique(least).tolist():  # the groups whose narrowest bitmap has so many words
                own = np.flatnonzero(least == words)
                bits, g = folded([cells[i] for i in own], words), h[own]
                for d in range(1, len(own)):
                    i = np.flatnonzero(g[:-d] == g[d:])
                    if not len(i):
                        break
                    p, q = own[i], own[i + d]
                    fit = (rep[p] != rep[q]) & (~cross[p] | (side[p] != side[q])) & (100 * np.minimum(n[p], n[q]) >= percent * np.maximum(n[p], n[q]))
                    i, p, q = i[fit], p[fit], q[fit]
                    ok = np.bitwise_count(bits[i] ^ bits[i + d]).sum(1) <= (n[p] + n[q]) * (100 - percent) // (100 + percent)
                    left.append(rep[p[ok]])
                    right.append(rep[q[ok]])
            if not left:
                return None
            pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], 1), axis=0)
            ids, at = np.unique(pairs, return_inverse=True)
            forest = Forest(ids)
            at = at.reshape(-1, 2)
            forest.join(at[:, 0], at[:, 1])
            return forest.edges()

        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
            h = t.column("h").to_numpy()
            end = int(np.flatnonzero(np.r_[True, h[1:] != h[:-1]])[-1]) if len(h) else 0
            if end and (e := done(t.slice(0, end).combine_chunks())) is not None:
                yield e
            held = t.slice(end)
        if held is not None and (e := done(held.combine_chunks())) is not None:
            yield e

    return df.repartition("h").sortWithinPartitions("h", "rep").mapInArrow(compare, "a long, b long")


def membership(members: DataFrame, id_col: str, most_bits: int = 1 << 26, hashes: int = 3):
    """(broadcast bits, column of bit places): a Bloom filter of the ids, so that texts of other documents stay out of the
    shuffle. At most `most_bits` bits, whatever the number of ids: past that it lets more through, and the join decides."""
    bits = max(1 << 13, min(most_bits, 1 << (12 * members.count()).bit_length()))
    places = F.array(*[F.pmod(F.xxhash64(F.col(id_col), F.lit(i)), F.lit(bits)) for i in range(hashes)])
    at = members.select(F.explode(places).alias("at"))
    one = F.expr("shiftleft(1L, cast(at & 63 as int))")
    words = at.groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(one).alias("v")).toPandas()
    held = np.zeros(bits // 64, np.uint64)
    held[words["w"].to_numpy(np.int64)] = words["v"].to_numpy(np.int64).view(np.uint64)
    return members.sparkSession.sparkContext.broadcast(held), places


def links(members: DataFrame, docs: DataFrame, width: int, percent: int, id_col: str, text_col: str, block: int = 128, most_blocks: int = 24, most: int = 2_000_000, counted: bool = True) -> DataFrame:
    """(rep, root, links) of each block compared, stored: `root` is the least set that the block links `rep` to, links the documents
    of other content that it links.

    members: (rep, comp, copies), comp being what tiles have joined. A group of sets (one comp) of up to `block` sets is
    compared whole; a larger one by size class (classes grow by 100/percent, so links stay within neighbours) and in blocks by
    hash, each pair of blocks in a group of its own. Groups have bounded rows and bounded bytes. In a group, set bits that differ
    bound the difference from below; pairs within the limit are intersected as sorted arrays. Unless `counted`, pairs that a block
    has joined already are passed over, and links are some of them."""
    step = math.log(100 / percent)
    test, places = membership(members, "rep")

    def features(batches):
        make, held, bands = Shingler(width), test.value, Bands(percent)
        for b in batches:
            at = np.array(b.column(2).to_pylist(), np.int64).reshape(b.num_rows, -1)
            b = b.filter(pa.array(((held[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(1)))
            out = []
            for raw in b.column(1).cast(pa.binary()).to_pylist():
                s = make(raw)
                out.append((len(s), bitmap(s, bands.words(len(s))), s.tobytes()))
            n, bits, arr = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(bits, pa.binary()), pa.array(arr, pa.binary())], ["rep", "n", "bits", "arr"])

    sets = map_arrow(docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text")).withColumn("at", places), features, "rep long, n long, bits binary, arr binary")
    sets = stored(sets.join(members, "rep").dropDuplicates(["rep"]))
    per = sets.groupBy("comp").agg(F.count("*").alias("c"), F.sum("n").alias("volume"))
    whole = (F.col("c") <= block) & (F.col("volume") <= most)
    held = sets
    sets = sets.join(per.where(~whole).select("comp", F.lit(True).alias("large")), "comp", "left").withColumn("class", F.floor(F.log("n") / F.lit(step) + F.lit(1e-9)))
    small = sets.where("large is null").select(F.struct(F.col("comp"), F.lit(0).cast("long").alias("class"), F.lit(0).alias("x"), F.lit(0).cast("long").alias("up"), F.lit(0).alias("y")).alias("g"), F.lit(0).alias("side"), "rep", "copies", "n", "bits", "arr")
    large = sets.where("large")
    # Blocks of a class: few at first, so that rows are not copied too often, more where a block would hold too much.
    per = large.groupBy("comp", "class").agg(F.count("*").alias("c"), F.sum("n").alias("volume"))
    blocks = per.select("comp", "class", F.greatest(F.least(F.ceil(F.col("c") / block), F.lit(most_blocks)), F.ceil(F.col("volume") / most), F.ceil(F.col("c") / 8192)).cast("int").alias("k"))
    near = stored(
        blocks.alias("x")
        .join(blocks.select("comp", (F.col("class") - 1).alias("class"), F.col("k").alias("k_up")), ["comp", "class"], "left")
        .join(blocks.select("comp", (F.col("class") + 1).alias("class"), F.col("k").alias("k_down")), ["comp", "class"], "left")
    )
    large = large.join(near, ["comp", "class"]).withColumn("b", F.pmod(F.xxhash64("rep"), F.col("k")).cast("int"))
    upto = lambda k: F.when(F.col(k) > 0, F.sequence(F.lit(0), F.col(k) - 1))
    group = lambda c, x, up, y, side: F.struct(F.struct(F.col("comp"), c.alias("class"), x.alias("x"), up.alias("up"), y.alias("y")).alias("g"), side.alias("side"))
    own = F.transform(upto("k"), lambda y: group(F.col("class"), F.least("b", y), F.col("class"), F.greatest("b", y), (F.col("b") > y).cast("int")))
    up = F.transform(upto("k_up"), lambda y: group(F.col("class"), F.col("b"), F.col("class") + 1, y, F.lit(0)))
    down = F.transform(upto("k_down"), lambda y: group(F.col("class") - 1, y, F.col("class"), F.col("b"), F.lit(1)))
    none = F.array().cast("array<struct<g:struct<comp:bigint,class:bigint,x:int,up:bigint,y:int>,side:int>>")
    large = large.withColumn("e", F.explode(F.concat(own, F.coalesce(up, none), F.coalesce(down, none)))).select("e.g", "e.side", "rep", "copies", "n", "bits", "arr")
    rows = small.unionByName(large).withColumn("h", F.xxhash64("g"))

    def compare(batches):
        def done(parts):
            b = pa.Table.from_batches(parts)
            side, rep, copies, n = (b.column(c).to_numpy() for c in ("side", "rep", "copies", "n"))
            g = b.column("g").combine_chunks()
            cls, up, x, y = (g.field(f)[0].as_py() for f in ("class", "up", "x", "y"))
            cross = cls != up or x != y
            cells = b.column("bits").to_pylist()
            widths = np.array([len(c) // 8 for c in cells])  # rows are sorted by n, so widths grow
            bits = {w: (i := int(np.searchsorted(widths, w)), folded(cells[i:], w)) for w in np.unique(widths).tolist()}
            arrs = [np.frombuffer(a, np.uint64) for a in b.column("arr").to_pylist()]
            root = np.arange(len(rep))
            count = np.zeros(len(rep), np.int64)

            def find(i):
                while root[i] != i:
                    root[i] = root[root[i]]
                    i = root[i]
                return i

            tops = np.searchsorted(n, 100 * n // percent, "right")  # rows are sorted by n
            for i in range(len(rep)):
                j = np.arange(i + 1, tops[i])
                if cross:
                    j = j[side[j] != side[i]]
                if not counted and len(j):
                    own = find(i)
                    j = j[[find(x) != own for x in j.tolist()]]
                if not len(j):
                    continue
                first, flags = bits[widths[i]]
                limit = (n[i] + n[j]) * (100 - percent) // (100 + percent)
                j = j[np.bitwise_count(flags[i - first] ^ flags[j - first]).sum(1) <= limit]
                for at in range(0, len(j), 256):
                    some = j[at : at + 256]
                    flat = np.concatenate([arrs[k] for k in some])
                    place = np.minimum(np.searchsorted(arrs[i], flat), len(arrs[i]) - 1)
                    ends = np.r_[0, n[some].cumsum()[:-1]]
                    both = np.add.reduceat((arrs[i][place] == flat).astype(np.int64), ends)
                    for k in some[100 * both >= percent * (n[i] + n[some] - both)]:
                        count[i] += copies[k]
                        count[k] += copies[i]
                        p, q = find(i), find(k)
                        if p != q:
                            root[max(p, q)] = min(p, q)
            top = np.array([find(i) for i in range(len(rep))])
            least = np.full(len(rep), np.iinfo(np.int64).max)
            np.minimum.at(least, top, rep)
            keep = count > 0
            return pa.RecordBatch.from_arrays([pa.array(rep[keep]), pa.array(least[top][keep]), pa.array(count[keep])], ["rep", "root", "links"])

        held, last = [], None
        for b in batches:
            h = b.column("h").to_numpy()
            cuts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]).tolist() if len(h) else []
            for a, e in zip(cuts, [*cuts[1:], len(h)], strict=True):
                if h[a] != last and held:
                    yield done(held)
                    held = []
                last = h[a]
                held.append(b.slice(a, e - a))
        if held:
            yield done(held)

    rows = rows.repartition("h").sortWithinPartitions("h", "n", "side", "rep")
    found = stored(rows.mapInArrow(compare, "rep long, root long, links long"))
    dropped(held, near)
    return found


def jaccard_join(docs: DataFrame, width: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text", counted: bool = True) -> DataFrame:
    """Links all documents whose shingle sets have Jaccard similarity of at least percent/100, exactly.

    Sets of equal content become one class first (by fingerprint, combined before the shuffle). Tile keys bring together
    every pair of classes that can be linked (see Bands); members of a tile whose bitmaps allow a link are joined into comps, and in each
    comp all pairs of fitting size are bounded by bitmaps and verified, in bounded blocks. No pair is given out: blocks return one row a member.

    Returns doc_id, n_shingles, component_id (the least id reachable by links, itself included), n_links (other
    documents linked directly). Texts of fewer than `width` words are one shingle; null, empty or blank texts have none and are
    linked with nothing. Very long texts are sets like others. Made for similarities of 0.7 and more: far below, a set has too few shingles a part,
    empty parts become keys and their tiles large. Repeated rows, and rows of one id, are copies of each other; an empty table gives no rows; other columns are not read."""
    rows = stored(shingled(docs, width, percent, id_col, text_col))
    full = rows.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("bits").alias("bits"))
    classes = stored(full)
    tiles = stored(tile_rows(rows, classes))
    # Keys and bitmaps have done their work when their tiles are there: only the narrow columns stay.
    wide, rows = rows, stored(rows.select("doc_id", "n", "f1", "f2"))
    dropped(wide)
    edges = stored(tile_edges(tiles, classes, percent))
    dropped(tiles)
    comps = components(edges)
    members = comps.select(F.col("node").alias("rep"), F.col("component").alias("comp")).join(classes.groupBy("rep").agg(F.sum("copies").alias("copies")), "rep")
    members = stored(members)
    dropped(edges, comps)
    found = links(members, docs, width, percent, id_col, text_col, counted=counted)
    roots = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    known = classes.select("n", "f1", "f2", "rep", "copies").join(roots.withColumnRenamed("node", "rep"), "rep", "left").join(counts, "rep", "left")
    known = stored(known.select("n", "f1", "f2", F.coalesce("component", "rep").alias("component"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links")))
    dropped(members, found, roots, classes)
    out = rows.join(known, ["n", "f1", "f2"], "left")
    found_links = [F.coalesce("links", F.lit(0)).alias("n_links")] if counted else []
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), *found_links)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct doc_id, array_to_string(ws[i:i + 2], ' ') as g from (select doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 2, 1))) as i from w where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
f as (select doc_id, n, md5(string_agg(g, '|' order by g)) as h from s join n using (doc_id) group by doc_id, n),
c as (select h, min(n) as n, min(doc_id) as rep, count(*) as copies from f group by h),
r as (select s.g, c.rep, c.n from s join c on s.doc_id = c.rep),
o as (select a.rep as a, b.rep as b, count(*) as o, min(a.n) as na, min(b.n) as nb from r a join r b on a.g = b.g and a.rep <> b.rep and 100 * a.n >= 90 * b.n and 100 * b.n >= 90 * a.n group by 1, 2),
l as (select a, b from o where 100 * o >= 90 * (na + nb - o)),
t as (select rep as node, rep as root from c union select l.b, t.root from t join l on t.node = l.a),
m as (select node, min(root) as root from t group by node),
k as (select l.a, sum(copies) as links from l join c on l.b = c.rep group by l.a)
select d.doc_id, coalesce(f.n, 0) as n_shingles, coalesce(m.root, d.doc_id) as component_id, cast(coalesce(c.copies - 1, 0) + coalesce(k.links, 0) as bigint) as n_links
from documents d left join f using (doc_id) left join c on f.h = c.h left join m on c.rep = m.node left join k on c.rep = k.a
"""
