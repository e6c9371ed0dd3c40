"""Operator 1: secret scan by patterns and by Markov models of random strings and ordinary text."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table

KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
K = len(ALPHABET) + 1  # 0 stands for any other character


class Patterns:
    """The base patterns; offsets are code points."""

    def __init__(self) -> None:
        self.assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
        self.access = re.compile(r"AKIA[A-Z0-9]+")
        self.run = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
        self.hex = re.compile(r"[0-9a-f]+")
        self.words = ("passw", "secret", "token", "apikey", "api_key")

    def base(self, text: str, runs: list[tuple[int, int]]) -> tuple[list[tuple[int, int, int]], list[str]]:
        """Spans (start, kind, end) in order, and the secret strings; `runs` are all of self.run, which hold every hex match."""
        spans, values = [], []
        low = text.lower()
        if any(w in low for w in self.words):
            for m in self.assign.finditer(text):
                if len(m[2]) >= 12:
                    spans.append((m.start(), 0, m.end()))
                    values.append(m[2])
        if "AKIA" in text:
            for m in self.access.finditer(text):
                if m.end() - m.start() >= 18:
                    spans.append((m.start(), 1, m.end()))
                    values.append(m[0])
        for a, b in runs:
            for m in self.hex.finditer(text, a, b):
                if m.end() - m.start() >= 16:
                    spans.append((m.start(), 2, m.end()))
                    values.append(m[0])
        spans.sort()
        return spans, values


def lookup() -> np.ndarray:
    table = np.zeros(128, np.int64)
    for i, c in enumerate(ALPHABET):
        table[ord(c)] = i + 1
    return table


def codes(text: str, lut: np.ndarray) -> np.ndarray:
    """Symbols of a text with an outside symbol at either end."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros(len(raw) + 2, np.int64)
    out[1:-1] = np.where(raw < 128, lut[np.minimum(raw, 127)], 0)
    return out


def outside(a: int, e: int, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The parts of a run that no base span covers; `spans` are sorted."""
    out = []
    for s, _, t in spans:
        if s < e and a < t:
            if s > a:
                out.append((a, s))
            a = max(a, t)
    return out + [(a, e)] * (a < e)


def wordlike(run: str) -> bool:
    """Whether a run is an identifier: four characters or more in its words of one case on average, and few characters in no word."""
    words = WORDS.findall(run)
    letters = sum(map(len, words))
    return letters >= 4 * len(words) and 4 * letters >= 3 * len(run)


WORDS = re.compile("[A-Z]?[a-z]+|[A-Z]+")


def transitions(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(kind, pair, n): transitions between neighbouring characters in all text (0), in the strings that the base patterns mark (1, the
    labelled secrets), and in identifiers (2: word-like runs that no base span meets). At most 3 * 69 * 69 rows, summed in each task first."""

    def make(batches):
        pat, lut = Patterns(), lookup()
        counts = np.zeros((3, K * K), np.int64)
        for b in batches:
            for text in b.column(0).to_pylist():
                if not text:
                    continue
                c = codes(text, lut)
                counts[0] += np.bincount(c[:-1] * K + c[1:], minlength=K * K)
                runs = [m.span() for m in pat.run.finditer(text)]
                spans, values = pat.base(text, runs)
                plain = [text[a:e] for a, e in runs if not any(s < e and a < t for s, _, t in spans) and wordlike(text[a:e])]
                for kind, found in ((1, values), (2, plain)):
                    for v in found:
                        c = codes(v, lut)
                        np.add.at(counts[kind], c[:-1] * K + c[1:], 1)
        kind, pair = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(pair, pa.int32()), pa.array(counts[kind, pair])], ["kind", "pair", "n"])

    return map_arrow(docs.select(text_col), make, "kind int, pair int, n long").groupBy("kind", "pair").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, text_col: str = "text") -> np.ndarray | None:
    """Log-likelihood ratio of each transition, random string against ordinary identifier; None without any text.

    Prior counts: 20 a row for random strings, shared as their letters are (half a count each, so even over the alphabet in a corpus
    without a labelled secret), and 20 a row for identifiers, shared as the transitions of all other text are."""
    n = np.zeros((3, K, K))
    for r in transitions(docs, text_col).collect():  # bounded by the alphabet
        n[r.kind].flat[r.pair] = r.n
    if not n.any():
        return None
    n[0] = np.maximum(n[0] - n[1], 0)
    # Random strings: a transition model drawn towards its own letter frequencies, as few samples may be at hand.
    share = n[1].sum(0) + 0.5
    p = (n[1] + 20 * share / share.sum()) / (n[1].sum(1, keepdims=True) + 20)
    # Ordinary text: a transition seen once may come from the very string in question, so one count is taken off each.
    usual = n[0].sum(0) + 0.5
    q = (np.maximum(n[0] - 1, 0) + 20 * usual / usual.sum()) / (n[0].sum(1, keepdims=True) + 20)
    q = (n[2] + 20 * q) / (n[2].sum(1, keepdims=True) + 20)
    return np.log(p / q)


def scan_secrets(docs: DataFrame, llr: np.ndarray | None, least: float = 12.0, each: float = 0.8, id_col: str = "doc_id", text_col: str = "text", redact: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Finds secrets in each whole text: the base patterns, and in every run of 16 or more characters the parts that no base
    span covers (the whole run, mostly) whose log-likelihood ratio is `least` or more in all and `each` or more a character.

    Null and empty texts have no spans; repeated rows are scanned each; an empty table gives no rows; other columns are not
    read but for `keep`, which are passed on. Returns doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov,
    secrets (the strings found); with `redact` also redacted, the text with that string in place of each stretch of spans."""

    def make(batches):
        pat, lut = Patterns(), lookup()
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            rows = []
            for text in texts:
                text = text or ""
                runs = [m.span() for m in pat.run.finditer(text)]
                spans, _ = pat.base(text, runs)
                found = list(spans)
                if llr is not None:
                    for run in runs:
                        for a, e in outside(*run, spans):
                            c = codes(text[a:e], lut)
                            score = llr[c[:-1], c[1:]][1:-1].sum()
                            if score >= least and score >= each * (e - a):
                                found.append((a, 3, e))
                    found.sort()
                said = [f"{KINDS[k]}:{s}:{e}" for s, k, e in spans]
                n = np.bincount([k for _, k, _ in found], minlength=4)
                rows.append((*map(int, n[:3]), hashlib.sha256(",".join(said).encode()).hexdigest(), ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found), int(n[3]), [text[s:e] for s, _, e in found]))
                if redact is not None:
                    rows[-1] += (without(text, found, redact) if found else text,)
            names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_markov", "secrets", *["redacted"] * (redact is not None)]
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.list_(pa.string()), pa.string()]
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, t) for c, t in zip(cols, kinds, strict=False)], *[b.column(2 + i) for i in range(len(keep))]], ["doc_id", *names, *keep])

    kind = lambda c: docs.schema[c].dataType.simpleString()
    schema = f"doc_id {kind(id_col)}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_markov long, secrets array<string>"
    schema += ", redacted string" * (redact is not None) + "".join(f", {c} {kind(c)}" for c in keep)
    return map_arrow(docs.select(F.col(id_col), F.col(text_col), *keep), make, schema)


def without(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """The text with `mark` for each stretch that the sorted spans cover."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan_secrets(docs, train(docs)).drop("secrets")
