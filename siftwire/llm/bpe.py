"""Operator 7: byte-pair encoding and decoding in batched numpy merge rounds."""

from __future__ import annotations

import hashlib
import json
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table

DEFAULT = "word_bpe_49k.json"


def tokenizer_path(name: str = DEFAULT) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str) -> dict:
    """What executors need of a tokenizer file: sorted pair keys with rank and merged symbol, token strings, first symbols.
    Its size is that of the vocabulary file, whatever the corpus."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
    size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    keys = np.array([vocab[a] * size + vocab[b] for a, b in pairs], np.int64)
    made = np.array([vocab[a + b] for a, b in pairs], np.int64)
    order = np.argsort(keys, kind="stable")
    # The printable stand-in of each byte: Latin-1's printable bytes stand for themselves, the others follow from 256.
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    stand, extra = {}, 0
    for b in range(256):
        stand[b] = chr(b) if b in plain else chr(256 + extra)
        extra += b not in plain
    tokens = [""] * size
    for t, i in vocab.items():
        tokens[i] = t
    special = {}
    for t in spec["added_tokens"]:
        tokens[t["id"]] = t["content"]
        special[t["content"]] = t["id"]
    first = np.array([vocab[stand[b]] for b in range(256)], np.int64)
    last = np.array([vocab[stand[b] + end] for b in range(256)], np.int64)
    split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
    return {"size": size, "keys": keys[order], "rank": order.astype(np.int64), "made": made[order], "tokens": tokens, "special": special, "first": first, "last": last, "split": split}


def merge_rounds(words: list[bytes], t: dict) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, lengths) of all words."""
    return merge_flat(np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words], np.int64), t)


def merge_flat(flat: np.ndarray, lengths: np.ndarray, t: dict) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, lengths) of words that stand one after the other in the bytes `flat`. All symbols lie in one array; a binary
    search over the sorted pair keys ranks every neighbouring pair, in each round each word's lowest rank is merged wherever it
    stands, left to right, and words without a pair leave the array. Only pairs beside a merged symbol are ranked again."""
    sym = t["first"][flat]
    ends = lengths.cumsum() - 1
    sym[ends] = t["last"][flat[ends]]
    word = np.repeat(np.arange(len(lengths)), lengths)
    done_sym, done_word = [], []
    keys, none = t["keys"], len(t["keys"])
    by_rank = np.zeros(none, np.int64)
    by_rank[t["rank"]] = t["made"]

    def ranked(i: np.ndarray) -> np.ndarray:
        """Ranks of the pairs of symbols i and i + 1 of one word."""
        pair = sym[i] * t["size"] + sym[i + 1]
        at = np.searchsorted(keys, pair)
        at[at == none] = 0
        return np.where(keys[at] == pair, t["rank"][at], none)

    ranks = np.full(len(sym), none)
    inner = np.flatnonzero(word[1:] == word[:-1])
    if none:
        ranks[inner] = ranked(inner)
    while len(sym):
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        low = np.minimum.reduceat(ranks, starts)
        sizes = np.diff(np.r_[starts, len(sym)])
        live = np.repeat(low < none, sizes)
        if not live.all():
            done_sym.append(sym[~live])
            done_word.append(word[~live])
        where = np.flatnonzero(ranks == np.repeat(np.where(low < none, low, -1), sizes))
        if not len(where):
            break
        # Neighbouring hits overlap (a pair of equal symbols): every second of such a row counts.
        head = np.r_[True, (np.diff(where) != 1)]
        if not head.all():
            run = np.maximum.accumulate(np.where(head, np.arange(len(where)), 0))
            where = where[(np.arange(len(where)) - run) % 2 == 0]
        sym[where] = by_rank[ranks[where]]
        ranks[where] = none
        live[where + 1] = False
        at = (live.cumsum() - 1)[where]
        sym, word, ranks = sym[live], word[live], ranks[live]
        before = at[at > 0] - 1
        again = np.r_[at[at < len(sym) - 1], before]
        ranks[again] = none
        again = again[word[again] == word[again + 1]]
        ranks[again] = ranked(again)
    if not done_sym:
        return np.zeros(0, np.int64), lengths
    sym, word = np.concatenate(done_sym), np.concatenate(done_word)
    order = np.argsort(word, kind="stable")
    return sym[order], np.bincount(word, minlength=len(lengths))


class Coder:
    """Encodes and decodes whole texts; remembers at most `keep` words."""

    def __init__(self, t: dict, keep: int = 150_000) -> None:
        import regex

        self.t, self.keep, self.cache = t, keep, {}
        self.find = regex.compile(t["split"]).findall
        self.special = regex.compile("(" + "|".join(regex.escape(s) for s in t["special"]) + ")") if t["special"] else None

    def words(self, text: str) -> list[str]:
        """Pieces after normalising (NFC, then lower case letter by letter); special tokens stand for themselves.
        White space is never part of a piece, so it needs no folding."""
        parts = self.special.split(text) if self.special and "<|" in text else [text]
        out = []
        for i, part in enumerate(parts):
            if i % 2:
                out.append(part)
            elif part:
                if not part.isascii():
                    part = unicodedata.normalize("NFC", part).replace("Σ", "σ")  # a capital sigma has one small form here
                out += self.find(part.lower())
        return out

    def learn(self, new: list[str]) -> None:
        coded = [w.encode("utf-8", "replace") for w in new]
        sym, n = merge_rounds(coded, self.t)
        tokens, at = self.t["tokens"], 0
        for w, k in zip(new, n.tolist(), strict=True):
            ids = sym[at : at + k].tolist()
            at += k
            self.cache[w] = (k, " ".join(map(str, ids)), " ".join([tokens[i] for i in ids]), ids)

    def batch(self, texts: list[str]) -> list[list[tuple]]:
        """Per text the entries (count, ids as text, tokens as text, ids) of its words."""
        split = [self.words(x) for x in texts]
        if len(self.cache) > self.keep:
            self.cache.clear()
        if not self.cache:
            self.cache.update({s: (1, str(i), s, [i]) for s, i in self.t["special"].items()})
        new = set().union(*split).difference(self.cache)
        if new:
            self.learn(sorted(new))
        get = self.cache.__getitem__
        return [list(map(get, ws)) for ws in split]


def encode_texts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Token ids and decoded text of each whole text, as the tokenizer file at `path` has them.

    The decoded text joins the tokens by one space. Null and empty texts have no tokens. Repeated rows are coded each; an
    empty table gives no rows; other columns are not read. Only distinct words of a batch are merged; texts are
    handled one after the other in their task. With `digests` the ids and text are given as SHA-256 only."""
    held = docs.sparkSession.sparkContext.broadcast(load(path or tokenizer_path()))

    def make(batches):
        coder = Coder(held.value)
        for b in batches:
            ids, texts = b.column(0), [x or "" for x in b.column(1).to_pylist()]
            n, coded, back = [], [], []
            for entries in coder.batch(texts):
                n.append(sum([e[0] for e in entries]))
                plain = " ".join([e[2] for e in entries])
                if digests:
                    coded.append(hashlib.sha256(" ".join([e[1] for e in entries]).encode()).hexdigest())
                    back.append(hashlib.sha256(plain.encode()).hexdigest())
                else:
                    coded.append([i for e in entries for i in e[3]])
                    back.append(plain)
            kind = pa.string() if digests else pa.list_(pa.int32())
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["doc_id", "n_tokens", "ids", "decoded"]
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(coded, kind), pa.array(back, pa.string())], names)

    kind = docs.schema[id_col].dataType.simpleString()
    out = f"doc_id {kind}, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")
    return map_arrow(docs.select(F.col(id_col), F.col(text_col)), make, out)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), digests=True)
