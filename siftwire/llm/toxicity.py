"""Operator 4: toxic passages as maximum-scoring segments of token log-odds."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket, map_arrow, stored, table

TOKEN = r"[^\W_]+"


def segments(hits: list[tuple[int, float]], gap: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first token, last token, score) of a text in which the tokens `hits` (place, score)
    stand among tokens of score -`gap` each; one pass, each candidate being merged at most once.

    Candidates hold the sums before and after them. A new one is joined to the nearest earlier candidate whose left
    sum is lower, if that one's right sum is lower than the new one's; else both stay."""
    found: list[list] = []  # first, last, left sum, right sum, nearest candidate with a lower left sum
    total, last = 0.0, -1
    for at, score in hits:
        total -= gap * (at - last - 1)
        if score <= 0:
            total, last = total + score, at
            continue
        left, total, last = total, total + score, at
        new = [at, at, left, total]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= new[3]:
                break
            new[0], new[2] = found[j][0], found[j][2]
            del found[j:]
        found.append([*new, j])
    return [(a, b, r - l) for a, b, l, r, _ in found]


def labelled(docs: DataFrame, labels: DataFrame, rows: int, id_col: str, text_col: str) -> DataFrame:
    """(text, toxic) of at most `rows` labelled documents, those with the least hashes of the id; their ids are few enough to
    broadcast. A document with several labels counts as toxic if one says so."""
    ids = labels.where("toxic is not null").groupBy(id_col).agg(F.max("toxic").cast("int").alias("__toxic")).orderBy(F.xxhash64(id_col), id_col).limit(rows)
    return docs.join(F.broadcast(stored(ids)), id_col).select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col("__toxic").alias("toxic"))


def train(docs: DataFrame, labels: DataFrame, max_docs: int = 20_000, prior: float = 0.1, max_tokens: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Token log-odds, the scale of chance scores, and the calibration.

    Fitted on at most `max_docs` labelled documents. Log-odds of a token (counted once a text) between toxic and clean texts have a Dirichlet prior in
    proportion to the token's overall frequency (`prior` of all tokens); tokens at least 2 standard errors from 0, on either side, score their
    own log-odds (of each side the `max_tokens` surest at most), others -gap. Extreme values: the slope lambda solves
    sum p e^(lambda score) = 1 over the tokens of clean texts, and K is the likeliest one for the best segments of clean texts, those below
    the least toxic score being censored. A logistic fit turns a text's evidence into the score. Only a table of tokens and one row
    a training text, both bounded, come to the driver."""
    sample = stored(labelled(docs, labels, max_docs, id_col, text_col))

    def count(batches):
        find, held = re.compile(TOKEN).findall, (Counter(), Counter())

        def out():
            words = list(held[0].keys() | held[1].keys())
            cols = [pa.array(words, pa.string()), *[pa.array([c[w] for w in words], pa.int64()) for c in held]]
            for c in held:
                c.clear()
            return pa.RecordBatch.from_arrays(cols, ["token", "clean", "toxic"])

        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held[bool(toxic)].update(set(find(text.lower())))
            if len(held[0]) + len(held[1]) > 200_000:
                yield out()
        yield out()

    counts = stored(map_arrow(sample, count, "token string, clean long, toxic long").groupBy("token").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))
    n = counts.agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).first()
    model: dict = {"odds": {}, "gap": 0.05, "k": 1.0, "slope": 1.0, "fit": (0.0, -4.0)}
    if not n.clean or not n.toxic:
        return model
    weight = prior * (n.clean + n.toxic)
    a = F.lit(weight) * (F.col("clean") + F.col("toxic")) / F.lit(float(n.clean + n.toxic))
    odds = lambda y, total: F.log((F.col(y) + a) / (F.lit(total + weight) - F.col(y) - a))
    scored = counts.withColumn("delta", odds("toxic", n.toxic) - odds("clean", n.clean)).withColumn("z", F.col("delta") / F.sqrt(1 / (F.col("toxic") + a) + 1 / (F.col("clean") + a)))
    # Log-odds are at most log(1 + share of clean tokens over the prior): tokens well above the noise pass both tests.
    toxic = scored.where("z >= 2 and delta >= 1 and toxic >= 3").orderBy(F.desc("z"), "token").limit(max_tokens)
    clean = scored.where("z <= -2 and delta < 0").orderBy("z", "token").limit(max_tokens)
    top = stored(toxic.unionByName(clean)).select("token", "delta", "clean").toPandas()
    model["odds"] = dict(zip(top["token"], top["delta"].astype(float), strict=True))
    share, delta = top["clean"].to_numpy(float) / n.clean, top["delta"].to_numpy(float)
    chance = float((delta * share)[delta > 0].sum())
    model["gap"] = max(0.02, 2 * chance)  # the mean score of a clean token is below 0
    model["slope"] = slope(share, delta, model["gap"])
    seen = evidence(sample.withColumn("doc_id", F.lit(0)).select("doc_id", "text", "toxic"), model, alpha=math.inf, keep=("toxic",)).select("toxic", "n_tokens", "best", F.transform("passages", lambda x: x["score"]).alias("scores")).toPandas()
    plain = seen[seen["toxic"] == 0]
    least = float(delta[delta > 0].min()) if (delta > 0).any() else 1.0
    hit = plain["best"] >= least
    room = float((plain["n_tokens"] * np.exp(-model["slope"] * plain["best"].where(hit, least))).sum())
    model["k"] = (float(hit.sum()) + 0.5) / (room + 1.0)
    gained = [sum(gain(model["k"], model["slope"], n, s) for s in scores) for n, scores in zip(seen["n_tokens"], seen["scores"], strict=True)]
    model["fit"] = logistic(np.array(gained, float), seen["toxic"].to_numpy(float))
    return model


def slope(share: np.ndarray, score: np.ndarray, gap: float) -> float:
    """lambda > 0 with sum p e^(lambda s) = 1 for tokens of these shares and scores, the other tokens scoring -gap; 1 if none scores above 0."""
    if not (share[score > 0] > 0).any():
        return 1.0
    rest = max(0.0, 1 - share.sum())
    excess = lambda x: (share * np.exp(np.minimum(x * score, 700))).sum() + rest * math.exp(-x * gap) - 1
    low, high = 0.0, 1.0
    while excess(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return max(high, 0.05)


def gain(k: float, rate: float, tokens: int, score: float, alpha: float = 0.05) -> float:
    """What a passage adds to the evidence: ln(alpha / E) + 1 if its E-value is at most alpha, else 0."""
    log_e = math.log(k * max(tokens, 1)) - rate * score
    return math.log(alpha) - log_e + 1 if log_e <= math.log(alpha) else 0.0


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, float]:
    """Slope and intercept by Newton steps on log(1 + evidence)."""
    z = np.stack([np.log1p(x), np.ones(len(x))], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (y - p) - ridge * np.array([w[0] * 0.01, 0])
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * 0.01 * np.eye(2), grad)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1])


def evidence(docs: DataFrame, model: dict, alpha: float = 0.05, keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every significant toxic passage of each whole text, and their sum.

    A passage is a maximal-scoring segment of tokens; its E-value is K n e^(-lambda score) for a text of n tokens, and one
    of `alpha` or less is significant. evidence: the sum over these of ln(alpha / E) + 1. Returns doc_id, n_tokens,
    best (the highest segment score), evidence, passages (first and last token, counted from 0, score, e_value)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make(batches):
        m, find = held.value, re.compile(TOKEN).findall
        odds, gap, k, rate = m["odds"], m["gap"], m["k"], m["slope"]
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                tokens = find(text.lower()) if text else []
                hits = [(i, odds[w]) for i, w in enumerate(tokens) if w in odds]
                found, best, total = [], 0.0, 0.0
                for first, last, score in segments(hits, gap) if hits else ():
                    best = max(best, score)
                    log_e = math.log(k * len(tokens)) - rate * score
                    if log_e <= math.log(alpha):
                        found.append((first, last, score, math.exp(max(log_e, -700.0))))
                        total += math.log(alpha) - log_e + 1
                rows.append((len(tokens), best, total, [dict(zip(("first", "last", "score", "e_value"), f, strict=True)) for f in found]))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            kinds = [pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64())]))]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], *[b.column(2 + i) for i in range(len(keep))]], ["doc_id", "n_tokens", "best", "evidence", "passages", *keep])

    kind = lambda c: docs.schema[c].dataType.simpleString()
    schema = f"doc_id {kind(id_col)}, n_tokens long, best double, evidence double, passages array<struct<first:int,last:int,score:double,e_value:double>>" + "".join(f", {c} {kind(c)}" for c in keep)
    return map_arrow(docs.select(F.col(id_col), F.col(text_col), *keep), make, schema)


def score_toxicity(docs: DataFrame, model: dict, threshold: float = 0.7, keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """evidence() with score (0 to 1) and predicted (1 where score >= `threshold`).

    Null and empty texts have no tokens and get the score of no evidence, as does any text when nothing was learned. Repeated
    rows are scored each; an empty table gives no rows; labels and other columns are not read."""
    slope, base = model["fit"]
    score = 1 / (1 + F.exp(-(F.lit(slope) * F.log1p("evidence") + F.lit(base))))
    return evidence(docs, model, keep=keep, id_col=id_col, text_col=text_col).withColumn("score", score).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs.where(bucket("doc_id", 3) != 1), labels.where(bucket("doc_id", 3) != 1))
    out = score_toxicity(docs, model)
    return out.select("doc_id", (bucket("doc_id", 3) == 1).alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))
