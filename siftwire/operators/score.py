"""Scores: base, importance, final, hotspot; sorts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from .normalize import event_relevance

# What counts as data, topics and actions in importance.
DATA_PATTERN = r"(\d+(?:\.\d+)?\s?(?:%|pct|bps|bp|亿美元|亿元|万元|美元|人民币|人|家|项|条|倍|年|月|日)|[A-Z]{2,6}\s?\d{1,4})"
ACTION_PATTERN = r"(发布|推出|批准|禁止|调查|起诉|处罚|下调|上调|收购|投资|合作|融资|裁员|召回|launch|release|approve|ban|invest|acquire|merge|recall|lawsuit|guidance|earnings|revenue|profit)"
TOPIC_PATTERN = r"(政策|监管|财报|产品|发布|宏观|通胀|利率|GDP|CPI|PPI|央行|美联储|SEC|证监|披露|earnings|revenue|guidance|regulation|policy|product|launch|macro|inflation|central bank|federal reserve)"


@dataclass(frozen=True)
class ScoreRules:
    base: float = 38
    credibility_weight: float = 0.32
    duplicate_penalty: float = 2
    freshness_weight: float = 18
    half_life_hours: float = 84
    category_boosts: dict = field(default_factory=lambda: dict(fixed.CATEGORY_BOOSTS))
    source_boosts: dict = field(default_factory=lambda: dict(fixed.SOURCE_BOOSTS))
    authority_boosts: dict = field(default_factory=lambda: dict(fixed.AUTHORITY_BOOSTS))
    tier_boosts: dict = field(default_factory=lambda: dict(fixed.TIER_BOOSTS))
    evidence_boosts: dict = field(default_factory=lambda: dict(fixed.EVIDENCE_BOOSTS))
    timeliness_boosts: dict = field(default_factory=lambda: dict(fixed.TIMELINESS_BOOSTS))
    official_window_hours: float = 24
    official_boost: float = 5
    relevance_weight: float = 0.18
    relevance_threshold: float = 45
    relevance_penalty: float = 10
    keywords: tuple = fixed.KEYWORD_SCORES


def age_hours(ts: Column, now: str) -> Column:
    micros = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.coalesce(ts, F.lit(now).cast("timestamp")))
    return F.greatest(F.lit(0.0), micros / F.lit(3.6e9))


def freshness_decay(ts: Column, now: str, weight: float = 18, half_life: float = 96) -> Column:
    return F.lit(float(weight)) * F.pow(F.lit(0.5), age_hours(ts, now) / F.lit(float(half_life)))


def keyword_hits(df: DataFrame, keywords=fixed.KEYWORD_SCORES) -> Column:
    """array<struct<term, score>> of the terms that the item's words contain, as substrings; each term once."""
    tags = F.array_join(F.coalesce(T.column_or(df, "tags", None, "array<string>"), F.array().cast("array<string>")), " ")
    hay = F.lower(F.concat_ws(" ", *[T.text_or_empty(T.column_or(df, c, None, "string")) for c in ("title", "summary", "content_excerpt")], tags))
    terms = {t.lower(): (t, float(s)) for t, s in reversed(keywords)}
    ordered = [terms[t] for t in dict.fromkeys(t.lower() for t, _ in keywords)]
    return T.let(hay, lambda h: F.array_compact(F.array(*[F.when(F.contains(h, F.lit(t.lower())), F.struct(F.lit(t).alias("term"), F.lit(s).alias("score"))) for t, s in ordered])))


def score_items(items: DataFrame, now: str, rules: ScoreRules = ScoreRules()) -> DataFrame:  # noqa: B008
    """Adds keyword_hits, event_relevance_score, score (0 to 100), score_breakdown and importance_score."""
    df = items.withColumn("keyword_hits", keyword_hits(items, rules.keywords)).withColumn("__text", T.item_text(items))
    areas = F.size(F.coalesce(T.column_or(items, "impact_areas", None, "array<string>"), F.array().cast("array<string>")))
    computed = event_relevance(F.col("__text"), F.size("keyword_hits"), areas, F.col("evidence_weight"))
    df = df.withColumn("event_relevance_score", F.coalesce(T.column_or(items, "event_relevance_score", None, "int"), computed))
    official = F.coalesce(F.col("source_authority").isin("official-agency", "official-market"), F.lit(False)) & (age_hours(F.col("published_at"), now) <= rules.official_window_hours)
    boost = lambda t, c: T.lookup({k: float(v) for k, v in t.items()}, F.col(c), 0.0)
    relevance = F.col("event_relevance_score")
    parts = {
        "base": F.lit(float(rules.base)), "credibility": F.coalesce("credibility", F.lit(70.0)) * F.lit(rules.credibility_weight), "freshness": freshness_decay(F.col("published_at"), now, rules.freshness_weight, rules.half_life_hours),
        "keywords": F.aggregate("keyword_hits", F.lit(0.0), lambda a, x: a + x["score"]), "category_boost": boost(rules.category_boosts, "category"), "source_boost": boost(rules.source_boosts, "source"),
        "authority_boost": boost(rules.authority_boosts, "source_authority"), "tier_boost": boost(rules.tier_boosts, "source_tier"), "evidence_boost": boost(rules.evidence_boosts, "evidence_type"),
        "timeliness_boost": boost(rules.timeliness_boosts, "timeliness_tier"), "official_boost": F.when(official, rules.official_boost).otherwise(0.0), "relevance_boost": T.half_up((relevance - 50) * F.lit(rules.relevance_weight), 2),
        "duplicate_penalty": F.coalesce(T.column_or(items, "duplicate_count", 0, "int"), F.lit(0)) * F.lit(float(rules.duplicate_penalty)), "relevance_penalty": F.when(relevance < rules.relevance_threshold, rules.relevance_penalty).otherwise(0.0),
    }
    df = df.withColumn("score_breakdown", F.struct(*[c.cast("double").alias(k) for k, c in parts.items()]))
    b = lambda k: F.col("score_breakdown")[k]
    total = sum((b(k) for k in list(parts)[:-2]), F.lit(0.0)) - b("duplicate_penalty") - b("relevance_penalty")
    df = df.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), T.half_up(total))))
    return df.withColumn("importance_score", importance_score(df)).drop("__text")


def key_data(text: Column, limit: int = 5, hype: tuple[str, ...] = fixed.HYPE_TERMS) -> Column:
    """Numbers with a unit, without hype words, each once."""
    found = F.regexp_extract_all(T.clean_text(text), F.lit(T.pattern(DATA_PATTERN)), 0)
    return T.distinct_ignoring_case(found, limit, lambda x: T.clean_text(F.regexp_replace(x, "(?i)" + "|".join(hype), "")))


def importance_score(df: DataFrame) -> Column:
    lists = [F.coalesce(T.column_or(df, c, None, "array<string>"), F.array().cast("array<string>")) for c in ("article_keywords", "keywords", "impact_areas")]
    text = T.clean_text(F.concat_ws(" ", *[T.column_or(df, c, None, "string") for c in ("title", "summary", "content_excerpt", "summary_short", "why_it_matters", "impact")], *lists))
    source = F.when(F.col("source_authority").isin("official-agency", "official-market", "official-media"), 24).when(F.col("source_authority") == "financial-media", 18).when(F.col("source_authority") == "media", 12).otherwise(8)
    some = F.size(F.concat(*lists)) > 0
    points = lambda c, n: F.when(c, n).otherwise(0)
    data = text.rlike(T.pattern(DATA_PATTERN))
    total = T.half_up(F.coalesce("score", F.lit(0.0)) * F.lit(0.32)) + source + points(some, 10) + points(T.hits(text, TOPIC_PATTERN), 18) + points(T.column_or(df, "timeline_event_id", None, "string").isNotNull(), 8)
    total = total + points(data, 10) + points(T.hits(text, ACTION_PATTERN), 8) + F.least(F.lit(6), F.coalesce(T.column_or(df, "duplicate_count", 0, "int"), F.lit(0)) * 2)
    return F.greatest(F.lit(0), F.least(F.lit(100), total)).cast("int")


def independent_sources(items: DataFrame) -> DataFrame:
    """(run_id, k, n): distinct sources of each cluster (an item without one is its own)."""
    key = F.coalesce(F.col("event_cluster_key"), F.col("id"))
    return items.groupBy("run_id", key.alias("k")).agg(F.count_distinct(T.first_filled(F.col("source_id"), F.col("source"), F.lit(""))).alias("n"))


def final_scores(items: DataFrame) -> DataFrame:
    """score becomes the final one: the base with density, value, confidence and independent sources, less 8 for metadata only."""
    df = items.withColumn("k", F.coalesce(F.col("event_cluster_key"), F.col("id"))).join(independent_sources(items), ["run_id", "k"]).drop("k").withColumnRenamed("n", "independent_source_count")
    parts = {
        "base_score": F.coalesce("score", F.lit(0.0)), "information_density": (F.coalesce("content_density", F.lit(0)) - 55) * F.lit(0.12), "information_gain": (F.coalesce("candidate_value", F.lit(0)) - 60) * F.lit(0.1),
        "classification_confidence": F.coalesce(F.col("classification.confidence"), F.lit(0.5)) * 5, "independent_sources": F.least(F.lit(6), (F.col("independent_source_count") - 1) * 2),
        "evidence_penalty": F.when(F.col("content_review_status") == "metadata-only", -8).otherwise(0),
    }
    df = df.withColumn("final_score_breakdown", F.struct(*[c.cast("double").alias(k) for k, c in parts.items()]))
    total = sum((F.col("final_score_breakdown")[k] for k in parts), F.lit(0.0))
    return df.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), T.half_up(total, 2))))


def sort_items(items: DataFrame, by: str = "score-desc") -> DataFrame:
    time = F.col("published_at")
    keys = {"score-desc": [F.desc_nulls_last("score"), time.desc_nulls_last()], "time-desc": [time.desc_nulls_last()], "time-asc": [time.asc_nulls_first()]}
    return items.orderBy(*keys[by], "id")


def hotspot_scores(items: DataFrame, now: str) -> DataFrame:
    """Adds hotspot (the parts) and top_score; a preset column of a part's name stands in for it where it is not null."""
    have = lambda c, k="string": T.column_or(items, c, None, k)
    none = F.array().cast("array<string>")
    lists = {c: F.coalesce(have(c, "array<string>"), none) for c in ("article_keywords", "keywords", "impact_areas", "tags", "key_data", "summary_points")}
    pool = F.lower(F.concat_ws(" ", *[have(c) for c in ("title", "title_zh", "summary", "summary_zh", "summary_short", "ai_summary", "why_it_matters", "impact", "risks")], *[lists[c] for c in ("article_keywords", "keywords", "impact_areas", "tags")]))
    useful = lambda c: (T.trim_ws(T.text_or_empty(have(c))) != "") & ~T.text_or_empty(have(c)).rlike(fixed.EMPTY_TEXT)
    points = lambda c, n: F.when(c, n).otherwise(0)
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(100.0), T.half_up(c)))
    dups, authority, tier = F.coalesce(have("duplicate_count", "int"), F.lit(0)), F.coalesce(have("source_authority"), have("source_type"), F.lit("")), F.coalesce(have("source_tier"), F.lit(""))
    weight = T.first_filled(have("importance_score", "double"), have("score", "double"), F.lit(0.0))
    base = F.coalesce(F.when(have("importance_score", "double") != 0, have("importance_score", "double")), have("score", "double"), F.lit(0.0))
    relevance, age = have("event_relevance_score", "double"), age_hours(T.first_filled(have("published_at", "timestamp"), have("fetched_at", "timestamp")), now)
    df = items.withColumn("__pool", pool)
    official = have("source_authority").isin("official-agency", "official-market", "official-media")
    trust = F.when(tier == "S", 96).when(tier == "A", 86).when(tier == "B", 72).when(tier == "C", 35).when(tier == "D", 10).when(authority.isin("official-agency", "official-market"), 94).when(authority == "official-media", 88)
    trust = trust.when(authority == "financial-media", 78).when(authority.isin("media", "webpage", "rss"), 68).otherwise(F.coalesce(have("credibility", "double"), F.lit(60.0)))
    impact = F.greatest(base, F.coalesce(relevance, F.lit(0.0)), (F.lit(52) + F.least(F.lit(24), F.size(lists["impact_areas"]) * 8) + F.least(F.lit(12), F.size(lists["key_data"]) * 4) + points(useful("why_it_matters") | useful("impact") | useful("importance"), 8)).cast("double"))
    market = F.lit(35) + points(F.coalesce(have("category"), have("primary_category")).isin("finance", "business", "macro"), 18) + points(F.col("__pool").rlike(fixed.MARKET_POOL), 22) + points(F.size(lists["key_data"]) > 0, 12) + points(dups > 0, 8)
    follow = F.lit(38) + points(have("timeline_event_id").isNotNull(), 24) + points(useful("risks"), 12) + points(useful("why_it_matters") | useful("impact"), 14) + points(useful("importance") | useful("summary_reason"), 8)
    follow = follow + points(useful("summary_short") | useful("ai_summary") | useful("content_excerpt"), 8) + points(F.size(lists["summary_points"]) >= 2, 6) + points(F.size(lists["impact_areas"]) >= 2, 6)
    fresh = F.when(age <= 6, 100.0).when(age <= 24, F.lit(92) - age * 1.5).when(age <= 72, F.lit(62) - (age - 24) * 0.8).otherwise(20.0)
    confidence = F.lower(T.text_or_empty(have("confidence")))
    doubt = F.when(confidence == "low", 14).when(confidence == "medium", 6).otherwise(0) + points(F.col("__pool").rlike(fixed.UNCERTAIN_POOL), 8)
    scored = {"source_trust_score": trust, "multi_source_score": F.lit(45) + F.least(F.lit(40), dups * 14) + points(F.coalesce(official, F.lit(False)), 10), "event_impact_score": impact, "market_feedback_score": market, "follow_up_value_score": follow, "freshness_score": fresh}
    taken = {"uncertainty_penalty": doubt, "duplication_penalty": F.least(F.lit(8), F.greatest(F.lit(0), dups - 2) * 2), "clickbait_penalty": points(T.text_or_empty(have("title")).rlike(fixed.CLICKBAIT), 10)}
    parts = {k: clamp(F.coalesce(have(k, "double"), c.cast("double"))) for k, c in scored.items()} | {k: F.greatest(F.lit(0.0), F.coalesce(have(k, "double"), c.cast("double"))) for k, c in taken.items()}
    parts["event_relevance_penalty"] = F.when(relevance < 45, 12.0).otherwise(0.0)
    df = df.withColumn("hotspot", F.struct(*[c.alias(k) for k, c in parts.items()])).withColumn("__weight", weight)
    h = lambda k: F.col("hotspot")[k]
    total = h("source_trust_score") * 0.20 + h("multi_source_score") * 0.20 + h("event_impact_score") * 0.20 + h("market_feedback_score") * 0.15 + h("follow_up_value_score") * 0.15 + h("freshness_score") * 0.10
    total = total - h("uncertainty_penalty") - h("duplication_penalty") - h("clickbait_penalty") - h("event_relevance_penalty")
    return df.withColumn("top_score", clamp(F.coalesce(have("top_score", "double"), total))).drop("__pool", "__weight")


def top_hotspots(items: DataFrame, now: str, limit: int = 5) -> DataFrame:
    """Each run's best items by top_score, one a hotspot key (its first two areas, keywords or tags, else the title's start); tiers C
    and D stay out. Adds hotspot_rank."""
    scored = hotspot_scores(items, now).where(~F.coalesce(F.upper("source_tier").isin("C", "D"), F.lit(False)))
    none = F.array().cast("array<string>")
    pick = F.coalesce(*[T.column_or(items, c, None, "array<string>") for c in ("impact_areas", "article_keywords", "keywords", "tags")], none)
    words = F.lower(F.array_join(F.slice(pick, 1, 2), "|"))
    title = F.substring(F.lower(T.first_filled(T.column_or(items, "title_zh", None, "string"), F.col("title"), F.lit("未命名信息"))), 1, 24)
    order = [F.desc("top_score"), F.desc(F.coalesce("importance_score", F.col("score"), F.lit(0))), F.desc_nulls_last("published_at"), F.asc("id")]
    key = scored.withColumn("hotspot_key", F.when(words != "", words).otherwise(title))
    first = key.withColumn("__r", F.row_number().over(W.partitionBy("run_id", "hotspot_key").orderBy(*order))).where("__r = 1")
    return first.withColumn("hotspot_rank", F.row_number().over(W.partitionBy("run_id").orderBy(*order))).where(F.col("hotspot_rank") <= limit).drop("__r")
