"""Rule filter with recorded reasons, link rules, content review, score floors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T


@dataclass(frozen=True)
class FilterRules:
    allowed_categories: tuple[str, ...] = ("tech", "finance", "business", "macro", "international", "news")
    blocked_sources: tuple[str, ...] = ()
    blocked_tiers: tuple[str, ...] = ("D",)
    blocked_terms: tuple[str, ...] = fixed.BLOCKED_TERMS
    low_value_titles: tuple[str, ...] = fixed.LOW_VALUE_TITLES
    low_value_content: tuple[str, ...] = fixed.LOW_VALUE_CONTENT
    minimum_title_length: int = 12
    require_url: bool = True
    require_published_at: bool = False
    max_age_hours: float = 48
    extended_max_age_hours: float = 168


def first_term(text: Column, terms) -> Column:
    """The first of the terms that the lower-cased text contains."""
    if not terms:
        return F.lit(None).cast("string")
    return T.let(text, lambda x: F.get(F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(x, F.lower(t))), 0))


def filter_reasons(df: DataFrame, now: str, rules: FilterRules = FilterRules()) -> DataFrame:  # noqa: B008
    """Adds filter_reasons: every reason, in fixed order, to leave an item out; none means that it stays. An item exactly as old as
    the limit stays."""
    title, source = T.clean_text(F.col("title")), F.lower(T.clean_text(F.col("source")))
    hay = F.lower(F.concat_ws(" ", T.text_or_empty(F.col("title")), T.text_or_empty(F.col("summary"))))
    df = df.withColumn("__hay", hay).withColumn("__low", F.lower(title))
    hay, reason = F.col("__hay"), lambda cond, name: F.when(cond, F.lit(name))
    named = lambda text, terms, name: F.concat(F.lit(f"{name}:"), first_term(text, terms))
    tier = F.upper(T.clean_text(F.col("source_tier")))
    extended = F.col("evidence_type").isin("regulatory_document", "research_paper", "data_release") | T.hits(hay, fixed.LONG_LIVED_WORDS)
    limit = F.when(F.coalesce(extended, F.lit(False)), rules.extended_max_age_hours).otherwise(rules.max_age_hours)
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("published_at")) / F.lit(3.6e9)
    found = [
        reason(F.lit(rules.require_url) & (T.text_or_empty(F.col("url")) == ""), "missing-url"),
        reason(~F.lower(T.clean_text(F.col("category"))).isin(*rules.allowed_categories), "category-not-allowed") if rules.allowed_categories else None,
        reason(source.isin(*[s.lower() for s in rules.blocked_sources]), "blocked-source") if rules.blocked_sources else None,
        F.when(tier.isin(*rules.blocked_tiers), F.concat(F.lit("blocked-source-tier:"), tier)) if rules.blocked_tiers else None,
        reason(F.lit(rules.require_published_at) & (F.col("published_at").isNull() | F.coalesce(T.column_or(df, "published_at_inferred", False, "boolean"), F.lit(False))), "missing-published-at"),
        named(hay, rules.blocked_terms, "blocked-term"),
        named(F.col("__low"), rules.low_value_titles, "low-value-title"),
        named(hay, rules.low_value_content, "low-value-content"),
        reason(F.length("__low") < rules.minimum_title_length, "title-too-short"),
        reason(age > limit, "too-old") if rules.max_age_hours > 0 else None,
    ]
    return df.withColumn("filter_reasons", F.array_compact(F.array(*[f for f in found if f is not None]))).drop("__hay", "__low")


def filter_items(df: DataFrame, now: str, rules: FilterRules = FilterRules()) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """(kept, rejected); the rejected keep their reasons for the audit."""
    marked = filter_reasons(df, now, rules)
    return marked.where(F.size("filter_reasons") == 0), marked.where(F.size("filter_reasons") > 0)


def keep_links(links: DataFrame, sources: DataFrame) -> DataFrame:
    """Links of list pages that their source's rules let through: title of 6 or more characters, an address, a date unless waived, no
    navigation title, and the source's own patterns. `sources` is a dimension with one row a source."""
    s = sources.select("source_id", "include_url_pattern", "exclude_title_pattern", F.coalesce("require_published_date", F.lit(True)).alias("__dated"))
    df = links.join(s, "source_id", "left")
    ok = (F.length("title") >= 6) & (T.text_or_empty(F.col("link")) != "") & (~F.coalesce("__dated", F.lit(True)) | F.col("published_at").isNotNull()) & ~F.col("title").rlike(fixed.NAVIGATION_TITLES)
    ok = ok & F.coalesce(F.expr("link rlike include_url_pattern"), F.lit(True)) & ~F.coalesce(F.expr("title rlike exclude_title_pattern"), F.lit(False))
    return df.where(F.coalesce(ok, F.lit(False))).drop("include_url_pattern", "exclude_title_pattern", "__dated")


def content_density(df: DataFrame) -> DataFrame:
    """Adds body_length, content_density (0 to 100) and new_fact_count from the body, or the excerpt where there is none."""
    body = T.clean_text(T.first_filled(T.column_or(df, "body_text", None, "string"), T.column_or(df, "content_excerpt", None, "string"), F.lit("")))
    df = df.withColumn("__b", body)
    b = F.col("__b")
    df = df.withColumns({"__f": T.count_hits(b, fixed.BODY_FACTS), "__n": T.count_hits(b, fixed.BODY_NUMBERS, False), "__e": T.count_hits(b, fixed.BODY_ENTITIES, False), "body_length": F.length(b)})
    evidence = F.when(T.hits(b, fixed.BODY_EVIDENCE), 15).otherwise(0)
    total = F.least(F.lit(35), F.col("__f") * 7) + F.least(F.lit(20), F.col("__n") * 4) + F.least(F.lit(20), F.col("__e") * 3) + evidence + F.least(F.lit(10), T.half_up(F.col("body_length") / 180).cast("int"))
    return df.withColumn("content_density", F.least(F.lit(100), total).cast("int")).withColumn("new_fact_count", F.least(F.lit(20), F.col("__f") + F.col("__n")).cast("int")).drop("__b", "__f", "__n", "__e")


def review_content(df: DataFrame, threshold: int = 55, official: int = 45, metadata_only: int = 75) -> DataFrame:
    """Adds content_review_status (accepted, metadata-only, rejected) and its reason. Bodies that could not be had pass as metadata if
    the candidate's value is high."""
    status, value = F.coalesce("body_fetch_status", F.lit("")), F.coalesce("candidate_value", F.lit(0))
    least = F.when(F.col("source_authority").isin("official-agency", "official-market"), official).otherwise(threshold)
    meta = F.when(value >= metadata_only, "metadata-only").otherwise("rejected")
    low = F.col("content_density") < least
    df = df.withColumn("content_review_status", F.when(status.isin("disabled", "failed"), meta).when(status == "", "rejected").when(low, "rejected").otherwise("accepted"))
    reason = F.when(status == "disabled", "body-fetch-disabled").when(status == "", "body-fetch-status-missing").when(status == "failed", "body-fetch-failed").when(low, "low-content-density").otherwise("content-density-passed")
    return df.withColumn("content_review_reason", reason)


def score_floor(df: DataFrame, least: float) -> DataFrame:
    return df.where(F.col("score") >= least)


def summary_eligible(df: DataFrame, least: float) -> DataFrame:
    return df.where((F.col("score") >= least) & (T.text_or_empty(F.col("title")) != "") & (T.text_or_empty(F.col("url")) != ""))


def event_eligible(df: DataFrame) -> DataFrame:
    """Items whose translation did not fail, or that are Chinese already."""
    text = F.concat_ws(" ", T.first_filled(T.column_or(df, "title_zh", None, "string"), F.col("title")), T.column_or(df, "summary_zh", None, "string"))
    return df.where((F.coalesce("translation_status", F.lit("")) != "failed") | F.coalesce(F.col("source_language").isin("zh", "zh-CN"), F.lit(False)) | text.rlike(r"[\x{4e00}-\x{9fff}]"))
