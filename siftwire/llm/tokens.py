"""Operator 13: token ids of a corpus in order of the ids of its documents, as Re-Pair grammars, one a shard."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import tokenizer_path
from .common import dropped, stored, table

MAGIC = b"RPG1"
END = 1


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[0] .. starts[0] + lengths[0] - 1, then those of the next, and so on."""
    ends = lengths.cumsum()
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total < 1 << 31 and int(starts.max(initial=0)) < 1 << 31 else np.int64
    out = np.repeat((starts - ends + lengths).astype(kind), lengths)
    out += np.arange(total, dtype=kind)
    return out


#: Letters up to U+024F, but U+0130: the same in any Unicode version, no accent stands alone, one small form a letter.
LETTERS = "[A-Za-zÀ-ÖØ-öø-įı-ɏ]+"
SIGNS = r"[!-/:-@\[-`{-~]*"


class WordIds:
    """Ids of texts from the tokenizers library, which codes each different piece but once: white space parts the words of a text, and a
    word of plain letters, perhaps with ASCII signs after them, is the letters and the signs, each one run for the tokenizer. At most about
    `keep` pieces of at most `longest` bytes are remembered, as Arrow strings and one flat array of ids."""

    def __init__(self, path: str, keep: int = 1_000_000, longest: int = 64, group: int = 256) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.t, self.keep, self.longest, self.group = Tokenizer.from_file(path), keep, longest, group
        self.t.no_truncation()
        self.t.no_padding()
        ends = [i for t, i in self.t.get_vocab(with_added_tokens=False).items() if t.endswith("</w>")]
        self.ends = np.zeros(self.t.get_vocab_size() + 1, bool)
        self.ends[ends] = True
        self.kind = np.uint16 if len(self.ends) <= 1 << 16 else np.uint32
        self.clear()

    def clear(self) -> None:
        self.pieces = pa.array([], pa.string())
        self.flat, self.starts, self.lengths = np.zeros(0, self.kind), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def encode(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) of the pieces in order. Letters are coded many as one text and parted at the word ends; if there are not as many ends
        as pieces, and for all others, each is coded alone."""
        plain = pc.match_substring_regex(pieces, f"^{LETTERS}$").to_numpy(zero_copy_only=False).astype(bool)
        names = pieces.filter(pa.array(plain)).to_pylist()
        sets = [names[i : i + self.group] for i in range(0, len(names), self.group)]
        flat, sizes = [np.zeros(0, self.kind)], [np.zeros(0, np.int32)]
        for which, found in zip(sets, self.t.encode_batch_fast([" ".join(s) for s in sets], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, self.kind)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(which) and cuts[-1] == len(ids):
                flat.append(ids)
                sizes.append(np.diff(np.r_[0, cuts]).astype(np.int32))
            else:
                self.alone(which, flat, sizes)
        self.alone(pieces.filter(pa.array(~plain)).to_pylist(), flat, sizes)
        flat, sizes = np.concatenate(flat), np.concatenate(sizes)
        place = np.empty(len(pieces), np.int64)  # where each piece's ids are among those coded
        place[np.r_[np.flatnonzero(plain), np.flatnonzero(~plain)]] = np.arange(len(pieces))
        return flat[ragged((sizes.cumsum() - sizes)[place], sizes[place])], sizes[place]

    def alone(self, words: list[str], flat: list[np.ndarray], sizes: list[np.ndarray]) -> None:
        found = [x.ids for x in self.t.encode_batch_fast(words, add_special_tokens=False)]
        flat.append(np.array([i for ids in found for i in ids], self.kind))
        sizes.append(np.array([len(ids) for ids in found], np.int32))

    def known(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, lengths): where the ids of each piece stand in one array. New pieces are coded and remembered."""
        if len(self.pieces) > self.keep:
            self.clear()
        at = pc.fill_null(pc.index_in(pieces, value_set=self.pieces), -1).to_numpy()
        new = at < 0
        fresh = pieces.filter(pa.array(new))
        flat, lengths = self.encode(fresh)
        start, size = np.zeros(len(pieces), np.int32), np.zeros(len(pieces), np.int32)
        start[~new], size[~new] = self.starts[at[~new]], self.lengths[at[~new]]
        start[new], size[new] = lengths.cumsum() - lengths + len(self.flat), lengths
        both = np.concatenate([self.flat, flat])
        short = pc.less_equal(pc.binary_length(fresh), self.longest).to_numpy(zero_copy_only=False).astype(bool)
        kept = lengths[short]
        self.pieces = pa.concat_arrays([self.pieces, fresh.filter(pa.array(short)).cast(pa.string())])
        self.starts = np.append(self.starts, (len(self.flat) + kept.cumsum() - kept).astype(np.int32))
        self.lengths = np.append(self.lengths, kept)
        self.flat = np.concatenate([self.flat, flat[np.repeat(short, lengths)]])
        return both, start, size

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths): all texts' ids, an end id after each, and how many each has."""
        # Capitals have the ids of small letters, but in the names of special tokens.
        texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        split = pc.ascii_split_whitespace(texts)  # no token lies on white space
        offsets = split.offsets.to_numpy()
        coded = split.flatten().dictionary_encode()
        index, words = coded.indices.to_numpy(), coded.dictionary
        cut = pc.extract_regex(words, f"^(?P<a>{LETTERS})(?P<b>{SIGNS})$")
        whole = pc.coalesce(pc.struct_field(cut, "a"), words)
        tail = pc.coalesce(pc.struct_field(cut, "b"), "")
        pieces = pa.concat_arrays([whole.cast(pa.string()), tail.cast(pa.string())]).dictionary_encode()
        flat, start, size = self.known(pieces.dictionary)
        # The pieces of each word one after the other; the empty piece has no ids.
        code = pieces.indices.to_numpy().reshape(2, -1).T.ravel()
        of_word = flat[ragged(start[code], size[code])]
        n_word = size[code].reshape(-1, 2).sum(1).astype(np.int32)
        # One more word, the end id, after each text.
        start, size = np.append(n_word.cumsum() - n_word, len(of_word)).astype(np.int32), np.append(n_word, 1).astype(np.int32)
        every = np.insert(index, offsets[1:] - offsets[0], len(words)) if len(texts) else index
        ends = offsets[1:] - offsets[0] + np.arange(len(texts))
        n = size[every]
        ids = np.append(of_word, np.array([END], self.kind))[ragged(start[every], n)]
        totals = n.cumsum(dtype=np.int64)[ends]
        pa.default_memory_pool().release_unused()
        return ids, np.diff(np.r_[0, totals])


_coders: dict[str, WordIds] = {}


def pieces(batch: pa.RecordBatch, col: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` bytes of `col`, a row at least."""
    sizes = np.concatenate([[0], pc.fill_null(pc.binary_length(batch.column(col)), 0).to_numpy(zero_copy_only=False)]).cumsum()
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def encoded(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, ids): ids as little-endian integers of 2 bytes (4, where the vocabulary is larger), an end id after the others; h their
    crc32. A worker keeps its words from one task to the next; a file that changes under one path needs new workers."""
    path = path or tokenizer_path()

    def run(batches):
        if path not in _coders:
            _coders.clear()
            _coders[path] = WordIds(path)
        coder = _coders[path]
        for whole in batches:
            for b in pieces(whole, "text"):
                ids, n = coder.batch(pc.fill_null(b.column("text"), ""))
                raw, ends = ids.astype(ids.dtype.newbyteorder("<")).tobytes(), n.cumsum() * ids.dtype.itemsize
                rows = [raw[a:e] for a, e in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)] if len(n) else []
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([zlib.crc32(r) for r in rows], pa.int64()), pa.array(rows, pa.binary())], ["doc_id", "h", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, h long, ids binary")


def grammar(ids: np.ndarray, lengths: np.ndarray, base: int, least: int = 4, gain: int = 64, bits: int = 20) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair over documents of `lengths` symbols: (left, right, symbols, documents' symbol counts); nonterminal base + k stands for
    left[k], right[k], and rules use earlier symbols only.

    A round replaces many pairs at once: at each place the pair that is more frequent than both that overlap it, and the first of a row of
    equal ones, if `least` or more such places hold the same pair. Frequencies come from hashed counts, rules from exact ones. No pair
    reaches over the end of a document. Rounds go on while they replace 1/`gain` of the symbols or more."""
    s = ids.astype(np.uint32)
    last = np.zeros(len(s), bool)
    last[lengths.cumsum() - 1] = True
    left, right, made = [], [], base
    while len(s) > 1:
        h = (s[:-1] * np.uint32(0x9E3779B1) + (s[1:] ^ (s[1:] >> np.uint32(7))) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits)
        c = np.bincount(h, minlength=1 << bits).astype(np.int32)[h]
        c[last[:-1]] = 0
        take = c >= least
        take[1:] &= c[1:] > c[:-1]
        take[:-1] &= c[:-1] >= c[1:]
        at = np.flatnonzero(take)
        key = (s[at].astype(np.int64) << 32) | s[at + 1]
        order = np.sort(key)
        head = np.flatnonzero(np.r_[True, order[1:] != order[:-1]]) if len(order) else np.zeros(0, np.int64)
        often = order[head[np.diff(np.r_[head, len(order)]) >= least]]
        if not len(often):
            break
        rule = np.searchsorted(often, key)
        hit = rule < len(often)
        hit[hit] = often[rule[hit]] == key[hit]
        at, rule = at[hit], rule[hit]
        left.append((often >> 32).astype(np.uint32))
        right.append((often & 0xFFFFFFFF).astype(np.uint32))
        s[at] = (made + rule).astype(np.uint32)
        last[at] |= last[at + 1]
        stay = np.ones(len(s), bool)
        stay[at + 1] = False
        made, before = made + len(often), len(s)
        s, last = s[stay], last[stay]
        if len(at) * gain < before:
            break
    none = [np.zeros(0, np.uint32)]
    ends = np.flatnonzero(last) + 1
    return np.concatenate(none + left), np.concatenate(none + right), s, np.diff(np.r_[0, ends])


def expansions(left: np.ndarray, right: np.ndarray, base: int) -> np.ndarray:
    """How many ids each rule stands for. Rules are taken in runs that use only what stands before the run."""
    size = np.ones(base + len(left), np.int64)
    for a, b in runs(left, right, base):
        size[base + a : base + b] = size[left[a:b]] + size[right[a:b]]
    return size[base:]


def runs(left: np.ndarray, right: np.ndarray, base: int) -> Iterator[tuple[int, int]]:
    """(from, to) of rules that use only symbols made before `from`."""
    reach = np.maximum.accumulate(np.maximum(left, right).astype(np.int64)) - base if len(left) else np.zeros(0, np.int64)
    a = 0
    while a < len(left):
        b = max(a + 1, int(np.searchsorted(reach, a, "left")))
        yield a, b
        a = b


def pack(ids: np.ndarray, lengths: np.ndarray, **rules) -> bytes:
    """A shard's file: magic, then base, rules, symbols, documents and width as 64-bit integers, the terminals' ids, the rules' left and right
    symbols and expansion lengths, the symbols, and each document's first symbol and first id, all little-endian. Terminals are numbered from 0
    in the shard, so symbols mostly need two bytes."""
    terminals = np.flatnonzero(np.bincount(ids, minlength=1))
    local = np.zeros(int(terminals[-1]) + 1 if len(terminals) else 1, np.uint32)
    local[terminals] = np.arange(len(terminals))
    base = len(terminals)
    left, right, symbols, counts = grammar(local[ids], lengths, base, **rules)
    width = 2 if base + len(left) <= 1 << 16 else 4
    head = np.array([base, len(left), len(symbols), len(lengths), width], "<i8")
    first = np.r_[0, counts.cumsum()]
    start = np.r_[0, lengths.cumsum()]
    body = [terminals.astype("<u4"), left.astype(f"<u{width}"), right.astype(f"<u{width}"), expansions(left, right, base).astype("<u4"), symbols.astype(f"<u{width}"), first.astype("<i8"), start.astype("<i8")]
    return MAGIC + head.tobytes() + b"".join(x.tobytes() for x in body)


class Shard:
    """Reads a shard's file; documents and ranges of ids are decoded on their own."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != MAGIC:
            raise ValueError("not a shard of token ids")
        self.base, rules, symbols, docs, width = np.frombuffer(data, "<i8", 5, 4).tolist()
        at = 44

        def read(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.terminals = read("<u4", self.base)
        self.left, self.right = read(f"<u{width}", rules), read(f"<u{width}", rules)
        self.size = np.r_[np.ones(self.base, np.int64), read("<u4", rules).astype(np.int64)]
        self.symbols, self.first, self.start = read(f"<u{width}", symbols), read("<i8", docs + 1), read("<i8", docs + 1)
        self.flat = None

    def table(self) -> None:
        """Each symbol's ids in one flat array, made once; as long as all rules' expansions."""
        self.at = self.size.cumsum() - self.size
        self.flat = np.zeros(int(self.size.sum()), np.uint32)
        self.flat[: self.base] = self.terminals
        for a, b in runs(self.left, self.right, self.base):
            # The two halves of each rule, one after the other.
            half = np.stack([self.left[a:b], self.right[a:b]], 1).ravel()
            to = self.at[self.base + a]
            from_ = ragged(self.at[half], self.size[half])
            self.flat[to : to + len(from_)] = self.flat[from_]

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        if self.flat is None:
            self.table()
        return self.flat[ragged(self.at[symbols], self.size[symbols])]

    def document(self, k: int) -> np.ndarray:
        return self.expand(self.symbols[self.first[k] : self.first[k + 1]])

    def ids(self, start: int, count: int) -> np.ndarray:
        """`count` ids from the shard's id number `start` on: only the symbols that hold them are expanded."""
        ends = self.size[self.symbols].cumsum()
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, start + count, "left") + 1
        skip = start - (ends[a - 1] if a else 0)
        return self.expand(self.symbols[a:b])[skip : skip + count]


def write_shards(docs: DataFrame, path: str | None = None, shard_ids: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents' ids in shards, stored as Parquet in the shared folder: (part, shard, doc_ids, start, n_ids, data), a row a shard, data being
    its file (see pack). Documents stand in ascending order of id (null last; equal ids by their token ids' crc32); a shard closes at `shard_ids`
    ids, so a longer text is one shard. start counts ids from the first of its part; parts follow one another by number.

    Null and empty texts have the end id only; repeated rows are documents of their own; an empty table gives no shards; other columns are not
    read. Texts are encoded before the shuffle, which carries two bytes an id; range partitions are sorted each on its own, so a hot id is
    parted by its texts' crc32."""
    flat = stored(encoded(docs, path, id_col, text_col))
    kind = docs.schema[id_col].dataType.simpleString()
    width = "<u2" if flat_kind(path) == np.uint16 else "<u4"

    def run(batches):
        import pyspark

        part, shard, start, held, rows = pyspark.TaskContext.get().partitionId(), 0, 0, 0, []
        def close():
            ids = np.frombuffer(b"".join(r for b in rows for r in b.column("ids").to_pylist()), width)
            lengths = np.concatenate([pc.binary_length(b.column("ids")).to_numpy(zero_copy_only=False) for b in rows]).astype(np.int64) // ids.dtype.itemsize
            names = pa.concat_arrays([b.column("doc_id") for b in rows])
            listed = pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names)
            data = pack(ids, lengths)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), listed, pa.array([start], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([data], pa.binary())], ["part", "shard", "doc_ids", "start", "n_ids", "data"])

        for b in batches:
            size = pc.binary_length(b.column("ids")).to_numpy(zero_copy_only=False) // np.dtype(width).itemsize
            at = 0
            for i, n in enumerate(size.tolist()):
                if held and held + n > shard_ids:
                    if i > at:
                        rows.append(b.slice(at, i - at))
                    yield close()
                    shard, start, held, rows, at = shard + 1, start + held, 0, [], i
                held += n
            if at < b.num_rows:
                rows.append(b.slice(at))
        if rows:
            yield close()

    keys = [F.col("doc_id").asc_nulls_last(), F.col("h")]
    out = stored(flat.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(run, f"part int, shard int, doc_ids array<{kind}>, start long, n_ids long, data binary"))
    dropped(flat)
    return out


def flat_kind(path: str | None):
    return WordIds(path or tokenizer_path()).kind


def read_shards(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files: start counts all ids before it, ids_crc32 is over its ids as
    little-endian 32-bit integers. The parts' totals, a row a part, give their offsets."""
    spark = shards.sparkSession
    totals, offsets, before = sorted(shards.groupBy("part").agg(F.sum("n_ids")).collect()), [], 0
    for part, n in totals:
        offsets.append((part, before))
        before += n
    small = spark.createDataFrame(offsets or [(0, 0)], "part int, before long")
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches):
        for whole in batches:
            for i in range(whole.num_rows):
                b = whole.slice(i, 1)
                s = Shard(b.column("data")[0].as_py())
                ids, at = s.expand(s.symbols).astype("<u4"), s.start.tolist()
                view = memoryview(ids.view(np.uint8))
                crc = [zlib.crc32(view[4 * a : 4 * e]) for a, e in zip(at[:-1], at[1:], strict=True)]
                start = s.start[:-1] + b.column("start")[0].as_py()
                yield pa.RecordBatch.from_arrays([b.column("doc_ids").flatten(), pa.array(start, pa.int64()), pa.array(np.diff(s.start), pa.int64()), pa.array(crc, pa.int64()), pa.array([b.column("part")[0].as_py()] * len(crc), pa.int32())], ["doc_id", "start", "n_tokens", "ids_crc32", "part"])

    rows = shards.select("part", "doc_ids", "start", "data").mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long, part int")
    return rows.join(F.broadcast(small), "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_shards(write_shards(table(spark, sf_dir, "documents")))
