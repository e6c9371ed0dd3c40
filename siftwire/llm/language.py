"""Operator 3: language identification by words, backing off to character n-grams."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket, least_count, map_arrow, stored, table

LETTERS = r"[^\W\d_]+"


def sampled(docs: DataFrame, rows: int, id_col: str) -> DataFrame:
    """At most `rows` ids of `docs`, those with the least hashes: the same at every run, and few enough to broadcast."""
    ids = docs.select(id_col).distinct().withColumn("__o", F.xxhash64(id_col)).orderBy("__o", id_col).limit(rows).select(id_col)
    return docs.join(F.broadcast(stored(ids)), id_col, "left_semi")


def grams(word: str, n: int) -> list[str]:
    word = f"\x02{word}\x03"
    return [word[i : i + n] for i in range(len(word) - n + 1)]


def train(docs: DataFrame, longest: int = 5, max_docs: int = 20_000, max_words: int = 100_000, max_grams: int = 100_000, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Log frequencies by language of words and of n-grams of 1 to `longest` characters.

    Fitted on at most `max_docs` labelled documents, chosen by a hash of the id. Words and n-grams at or above a count are kept: the least
    count from 2 that at most `max_words` and `max_grams` reach (given as model["least"]), so the model has a fixed bound; rarer words back
    off like unseen ones. Words are counted whole, however long. Counting runs in tasks that give out partial counts whenever they hold
    200,000 entries."""
    sample = sampled(docs.where(F.col(text_col).isNotNull() & F.col("lang").isNotNull()), max_docs, id_col)

    def make(batches):
        letters = re.compile(LETTERS)
        held: Counter = Counter()

        def out():
            words: Counter = Counter()
            for (lang, w), n in held.items():
                words["w", lang, w] += n
                for size in range(1, longest + 1):
                    for g in grams(w, size):
                        words["g", lang, g] += n
            held.clear()
            keys = list(words)
            cols = list(zip(*keys, strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([*[pa.array(c, pa.string()) for c in cols], pa.array([words[k] for k in keys], pa.int64())], ["kind", "lang", "item", "n"])

        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for w, n in Counter(letters.findall(text.lower())).items():
                    held[lang, w] += n
            if len(held) > 200_000:
                yield out()
        yield out()

    counts = stored(map_arrow(sample.select(text_col, "lang"), make, "kind string, lang string, item string, n long").groupBy("kind", "lang", "item").agg(F.sum("n").alias("n")))
    totals = counts.withColumn("size", F.when(F.col("kind") == "g", F.length("item")).otherwise(0)).groupBy("size", "lang").agg(F.sum("n").alias("n")).collect()
    langs = sorted({r.lang for r in totals})
    model: dict = {"langs": langs, "longest": longest, "words": {}, "grams": {}, "least": {}}
    if not langs:
        return model
    total = {(r.size, r.lang): r.n for r in totals}
    for kind, most, least in (("w", max_words, 2), ("g", max_grams, 2)):
        top = counts.where(F.col("kind") == kind).groupBy("item").agg(F.sum("n").alias("all"), *[F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"l{i}") for i, x in enumerate(langs)]).where(F.col("all") >= least)
        top = stored(top)
        model["least"][kind] = least_count(top, "all", most, least)
        rows = top.where(F.col("all") >= model["least"][kind]).toPandas()
        n = rows[[f"l{i}" for i in range(len(langs))]].to_numpy(np.float64)
        size = rows["item"].str.len().to_numpy() if kind == "g" else np.zeros(len(rows), int)
        base = np.array([[total.get((s, x), 0) for x in langs] for s in range(longest + 1)], np.float64)[size.astype(int)] if len(rows) else np.zeros((0, len(langs)))
        logs = np.log10((n + 0.1) / (base + 0.1 * max(len(rows), 1))).astype(np.float32)
        model["words" if kind == "w" else "grams"] = (rows["item"].tolist(), logs)
    return model


class Guesser:
    """Scores words; remembers at most `keep` of them."""

    def __init__(self, model: dict, keep: int = 200_000) -> None:
        self.langs, self.longest, self.keep = model["langs"], model["longest"], keep
        self.words = dict(zip(model["words"][0], model["words"][1], strict=True)) if model["langs"] else {}
        self.grams = dict(zip(model["grams"][0], model["grams"][1], strict=True)) if model["langs"] else {}
        self.at: dict[str, int] = {}
        self.rows: np.ndarray = np.zeros((1024, max(1, len(self.langs))), np.float32)
        self.find = re.compile(LETTERS).findall

    def backoff(self, word: str) -> np.ndarray | float:
        """An unseen word: the mean over its known n-grams of the greatest length that has any."""
        for n in range(min(self.longest, len(word) + 2), 0, -1):
            known = [self.grams[g] for g in grams(word, n) if g in self.grams]
            if known:
                return np.mean(known, axis=0)
        return 0.0

    def index(self, word: str) -> int:
        i = len(self.at)
        if i == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        known = self.words.get(word)
        self.rows[i] = self.backoff(word) if known is None else known
        self.at[word] = i
        return i

    def guess(self, text: str | None) -> tuple[str, float]:
        words = self.find(text.lower()) if text else ()
        # Signs such as ½ or ² are taken for word characters, but are no letters.
        if not self.langs or not any(c.isalpha() for w in words for c in w):
            return "und", 0.0
        if len(self.at) > self.keep:
            self.at.clear()
        at, index = self.at, self.index
        which = [at[w] if w in at else index(w) for w in words]
        mean = self.rows[which].mean(axis=0, dtype=np.float64)
        p = np.exp((mean - mean.max()) * min(len(words), 20) * np.log(10))
        best = int(p.argmax())
        return self.langs[best], float(p[best] / p.sum())


def identify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of each whole text. lang_pred is a learned language, or `und` with score 0 where the text is null
    or has no letter (or nothing was learned); score is the posterior of lang_pred over at most 20 words' weight. Ties go to
    the first language by name. Repeated rows are judged each; an empty table gives no rows; other columns are not read."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make(batches):
        guess = Guesser(held.value).guess
        for b in batches:
            found = [guess(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(F.col(id_col), F.col(text_col)), make, f"doc_id {kind}, lang_pred string, score double")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(bucket("doc_id", 4) != 2))
    return identify(docs, model).select("doc_id", (bucket("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
