"""Categories by pattern counts, tags and factors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T


def category_text(df: DataFrame, metadata_only: bool = False) -> Column:
    tags = F.array_join(F.coalesce(T.column_or(df, "tags", None, "array<string>"), F.array().cast("array<string>")), " ")
    parts = ["title", "summary"] + ([] if metadata_only else ["content_excerpt", "body_text"])
    return T.clean_text(F.concat_ws(" ", *[T.text_or_empty(T.column_or(df, c, None, "string")) for c in parts], tags))


def category_scores(df: DataFrame, text: Column, rules=fixed.CATEGORY_PATTERNS) -> Column:
    """array<struct<score, place, name>>: .18 a match in `text`, a column of its own, (1 at most) with .35 for one in the title, and the event
    type's boost on top."""
    kind, out = F.coalesce(T.column_or(df, "event_type", None, "string"), F.lit("")), []
    for i, (name, p) in enumerate(rules):
        base = F.least(F.lit(1.0), T.count_hits(text, p) * F.lit(0.18) + F.when(T.hits(T.text_or_empty(F.col("title")), p), 0.35).otherwise(0.0))
        boosts = {k: b for k, (c, b) in fixed.EVENT_CATEGORY_BOOSTS.items() if c == name}
        out.append(F.struct((base + T.lookup(boosts, kind, 0.0)).alias("score"), F.lit(i).alias("place"), F.lit(name).alias("name")))
    return F.array(*out)


def ranked_scores(scores: Column) -> Column:
    """Best first; ties by the categories' own order."""
    order = F.sort_array(F.transform(scores, lambda s: F.struct((-s["score"]).alias("minus"), s["place"].alias("place"), s["name"].alias("name"))))
    return F.transform(order, lambda s: F.struct((-s["minus"]).alias("score"), s["name"].alias("name")))


def source_fallback(df: DataFrame) -> Column:
    return T.lookup(fixed.SOURCE_CATEGORIES, T.first_filled(T.column_or(df, "source_category", None, "string"), F.col("category"), F.lit("")), "business")


def metadata_category(df: DataFrame, name: str) -> DataFrame:
    """Adds `name`, the category of the best score over title, summary and tags. The text, then the scores are columns, so that each is made
    once."""
    scored = df.withColumn("__meta", T.sieved(category_text(df, True), [p for _, p in fixed.CATEGORY_PATTERNS]))
    scored = scored.withColumn("__scores", category_scores(scored, F.col("__meta"))).withColumn("__best", ranked_scores(F.col("__scores"))[0])
    best = F.when(F.col("__best.score") > 0, F.col("__best.name")).otherwise(source_fallback(df))
    return scored.withColumn(name, best).drop("__meta", "__scores", "__best")


def secondary_tags(text: Column, tags: Column, rules=fixed.SECONDARY_TAGS, near: Column | None = None) -> Column:
    """Labels of the rules, names, given tags: the first six. `near`: what a sieve of these rules has left of the text, if there is one."""
    pattern = r"(?:[A-Z][A-Za-z0-9&.-]{2,}|[\x{4e00}-\x{9fff}]{2,10}(?:公司|银行|大学|委员会|部门))"
    names = F.filter(F.regexp_extract_all(text, F.lit(pattern), 0), lambda x: F.length(x) <= 24)
    given = F.filter(F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda x: T.clean_text(x)), lambda x: x != "")
    return F.slice(F.array_distinct(F.concat(T.all_rules(text if near is None else near, rules), names, given)), 1, 6)


#: Patterns of factors that a sieve can look for: all but the subject's.
SIEVED_FACTORS = {k: p.removeprefix("(?i)") for k, p in fixed.FACTOR_PATTERNS.items() if p.startswith("(?i)")}


def factors(text: Column, near: Column | None = None) -> Column:
    found = lambda k, p: F.regexp_extract(near if near is not None and k in SIEVED_FACTORS else text, p, 0)
    return F.struct(*[F.coalesce(F.nullif(found(k, p), F.lit("")), F.lit(fixed.NO_FACTOR)).alias(k) for k, p in fixed.FACTOR_PATTERNS.items()])


def classify_items(items: DataFrame) -> DataFrame:
    """Adds category, secondary_tags, classification (confidence, factors, conflicts, method, status), classification_scores and
    requires_review. Close or weak scores ask for review."""
    tags = T.column_or(items, "tags", None, "array<string>")
    rules = [p for _, p in (*fixed.CATEGORY_PATTERNS, *fixed.SECONDARY_TAGS)] + list(SIEVED_FACTORS.values())
    df = items.withColumn("__text", category_text(items)).withColumn("__near", T.sieved(F.col("__text"), rules))
    df = df.withColumn("__s", category_scores(items, F.col("__near"))).withColumn("__r", ranked_scores(F.col("__s"))).withColumn("__back", source_fallback(items))
    df = df.withColumns({"__top": F.col("__r")[0]["score"], "__second": F.col("__r")[1]["score"]})
    top, gap = F.col("__top"), F.col("__top") - F.col("__second")
    df = df.withColumn("source_category", F.coalesce(T.column_or(items, "source_category", None, "string"), F.col("category"))).withColumn("category", F.when(top > 0, F.col("__r")[0]["name"]).otherwise(F.col("__back")))
    by = lambda name: F.filter("__s", lambda s: s["name"] == name)[0]["score"]
    tech, finance = by("technology"), by("finance")
    confidence = F.when(top > 0, F.greatest(F.lit(0.45), F.least(F.lit(0.96), F.lit(0.55) + top * 0.3 + F.greatest(F.lit(0.0), gap) * 0.25))).otherwise(0.45)
    conflicts = F.transform(F.filter(F.slice("__r", 2, 2), lambda s: F.col("__top") - s["score"] < 0.12), lambda s: s["name"])
    source = (F.col("__back") != F.col("category")) & (F.filter("__s", lambda s: s["name"] == F.col("__back"))[0]["score"] > 0.25)
    close = (F.abs(tech - finance) < 0.12) & (F.greatest(tech, finance) > 0)
    df = df.withColumn("__c", confidence).withColumn("requires_review", (F.col("__c") < 0.72) | (gap < 0.12) | close | source | (top == 0))
    made = F.struct(T.half_up(F.col("__c"), 2).alias("confidence"), factors(F.col("__text"), F.col("__near")).alias("factors"), conflicts.alias("candidate_conflicts"), F.lit("rule").alias("method"), F.when(F.col("requires_review"), "review-required").otherwise("classified").alias("status"))
    df = df.withColumn("classification", made).withColumn("secondary_tags", secondary_tags(F.col("__text"), tags, near=F.col("__near"))).withColumn("classification_scores", F.map_from_entries(F.transform("__s", lambda s: F.struct(s["name"], s["score"]))))
    return df.drop("__text", "__near", "__s", "__r", "__back", "__top", "__second", "__c")
