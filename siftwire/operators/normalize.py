"""Raw records to items: one projection, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T


def source_tier(df: DataFrame) -> Column:
    """S, A, B, C or D: a given tier, else by authority, name, kind and credibility, in this order."""
    explicit = F.upper(T.clean_text(T.column_or(df, "source_tier", None, "string")))
    authority, kind = F.lower(T.clean_text(F.col("source_authority"))), F.lower(T.clean_text(F.col("source_type")))
    name, credibility = F.lower(T.clean_text(F.col("source"))), F.coalesce(F.col("credibility"), F.lit(0.0))
    words = F.concat_ws(" ", kind, authority, name)
    return (
        F.when(explicit.isin("S", "A", "B", "C", "D"), explicit)
        .when(authority.isin("official-agency", "official-market"), "S")
        .when((authority == "official-media") | T.hits(name, fixed.TIER_A_NAMES), "A")
        .when(T.hits(words, fixed.TIER_C_WORDS, False), "C")
        .when(T.hits(words, fixed.TIER_D_WORDS, False), "D")
        .when(authority.isin("financial-media", "media") | (credibility >= 70), "B")
        .otherwise("C")
    )


#: Patterns of evidence that are looked for in the text alone.
LOOSE_EVIDENCE = [fixed.ANNOUNCEMENT_WORDS, fixed.PAPER_WORDS, fixed.DATA_WORDS, fixed.ANALYSIS_WORDS, fixed.MARKET_WORDS, fixed.OPINION_WORDS, fixed.SOCIAL_WORDS]


def evidence_type(df: DataFrame, text: Column, tier: Column) -> Column:
    """The kind of evidence: a given one, else the first rule that the lower-cased text meets."""
    explicit = F.lower(T.clean_text(T.column_or(df, "evidence_type", None, "string")))
    authority = F.lower(T.clean_text(F.col("source_authority")))
    has = lambda t, p: T.hits(t, p, False)

    def kind(low: Column) -> Column:
        name = F.lower(T.clean_text(F.col("source")))
        firm = T.let(T.sieved(F.concat_ws(" ", name, low), [fixed.FINANCIAL_WORDS, fixed.REGULATORY_WORDS]), lambda named: (
            F.when((authority == "official-market") | has(named, fixed.FINANCIAL_WORDS), "financial_report")
            .when((authority == "official-agency") & has(named, fixed.REGULATORY_WORDS), "regulatory_document")
            .when(authority == "official-agency", "official_announcement")
        ))
        return F.coalesce(firm, T.let(T.sieved(low, LOOSE_EVIDENCE), lambda near: (
            F.when(has(near, fixed.ANNOUNCEMENT_WORDS), "official_announcement")
            .when(has(near, fixed.PAPER_WORDS), "research_paper")
            .when(has(near, fixed.DATA_WORDS), "data_release")
            .when(authority.isin("official-media", "financial-media", "media") | (tier == "A"), "reliable_media_report")
            .when(has(near, fixed.ANALYSIS_WORDS), "industry_analysis")
            .when(has(near, fixed.MARKET_WORDS), "market_feedback")
            .when(has(near, fixed.OPINION_WORDS), "expert_opinion")
            .when(has(near, fixed.SOCIAL_WORDS), "social_discussion")
            .otherwise("unknown")
        )))

    # Each rule reads the text in lower case, or what is left of it where the rules can match; these are made once, and only if they are read.
    return F.when(explicit.isin(*fixed.EVIDENCE_WEIGHTS), explicit).otherwise(T.let(F.lower(text), kind))


def evidence_weight(kind: Column) -> Column:
    return T.lookup(fixed.EVIDENCE_WEIGHTS, kind, fixed.EVIDENCE_WEIGHTS["unknown"])


def event_relevance(text: Column, n_keywords: Column, n_areas: Column, weight: Column) -> Column:
    """0 to 100 from named entities, keywords, areas touched, evidence and stated facts."""
    both = T.let(F.lower(text), lambda low: F.struct(sum((T.hits(low, p).cast("int") for p in fixed.ENTITY_PATTERNS), F.lit(0)).alias("entities"), F.when(T.hits(low, fixed.RELEVANT_FACTS), 15).otherwise(0).alias("facts")))
    return T.let(both, lambda f: _relevance(f["entities"], f["facts"], n_keywords, n_areas, weight))


def _relevance(entities: Column, facts: Column, n_keywords: Column, n_areas: Column, weight: Column) -> Column:
    words = F.least(F.lit(25), n_keywords * 5)
    passing = F.when((entities == 0) & (words > 0), 15).otherwise(0)
    total = F.lit(15) + entities * 10 + words + F.least(F.lit(20), n_areas * 8) + T.half_up(weight * F.lit(0.25)).cast("int") + facts - passing
    return F.greatest(F.lit(0), F.least(F.lit(100), total)).cast("int")


def derived_category(base: Column, text: Column, rules=fixed.DERIVED_CATEGORIES) -> Column:
    """The first rule's category that the text meets, else the source's."""
    current = F.coalesce(F.nullif(F.lower(T.clean_text(base)), F.lit("")), F.lit("news"))
    return T.first_rule(text, [(label, p) for label, _, p in rules], current)


def impact_areas(text: Column, rules=fixed.DERIVED_CATEGORIES) -> Column:
    return F.slice(T.all_rules(text, [(label, p) for _, label, p in rules]), 1, 4)


def item_id(category: Column, source: Column, title: Column, url: Column, published: Column) -> Column:
    """slug(category)-slug(source)-ten hex digits of the title, address and time."""
    stamp = F.date_format(published, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.concat_ws("-", T.slug(category), T.slug(source), F.substring(F.sha1(F.concat_ws("|", title, url, stamp).cast("binary")), 1, 10))


def normalize_items(raw: DataFrame, rules=fixed.DERIVED_CATEGORIES) -> DataFrame:
    """Items from rows of (record x raw item).

    Each field is the first filled of its spellings, with defaults (credibility 70, authority media, tier daily, type rss, category news,
    title "Untitled item"); missing columns count as null. Times that do not parse become the fetch time."""
    get = lambda *names: [T.column_or(raw, n, None, "string") for n in names]
    first = lambda *names, default="": T.first_filled(*get(*names), F.lit(default))
    listed = lambda n: T.column_or(raw, n, None, "array<string>")
    df = raw.withColumns({
        "__title": T.decode_html(first("title", "headline", "name", "guid", default="Untitled item")),
        "__url": T.canonical_url(first("link", "url", "href", "guid")),
        "__source": T.clean_text(first("source_name", "source", default="Unknown Source")),
        "__type": F.lower(T.clean_text(first("source_type", default="rss"))),
        "__category": F.lower(T.clean_text(first("category", default="news"))),
        "__authority": F.lower(T.clean_text(first("source_authority", default="media"))),
        "__timeliness": F.lower(T.clean_text(first("timeliness_tier", default="daily"))),
        "__credibility": F.coalesce(T.number(T.column_or(raw, "credibility", None, "string")), F.lit(70.0)),
        "__summary": T.decode_html(first("summary", "content_snippet", "description", "excerpt", "content")),
        "__excerpt": T.truncate_text(T.decode_html(first("content_excerpt", "content", "encoded", "description", "summary", "content_snippet"))),
        "__image": T.https_image(first("image_url", "feed_image_url", "media_url", "thumbnail", "url_to_image")),
        "__tags": F.filter(F.transform(F.coalesce(listed("tags"), listed("categories"), F.array().cast("array<string>")), lambda x: T.clean_text(x)), lambda x: x != ""),
        "__date": T.first_filled(*get("published_at", "pub_date", "iso_date", "date", "published", "updated")),
    })
    df = df.withColumn("__published", F.coalesce(T.parse_date(F.col("__date")), F.col("fetched_at")))
    keep = [c for c in ("run_id", "ord") if c in raw.columns]
    df = df.select(
        *keep, F.coalesce(T.clean_text(first("source_id")), F.lit("")).alias("source_id"), F.col("__title").alias("title"), F.col("__url").alias("url"), F.col("__source").alias("source"), F.col("__type").alias("source_type"),
        F.coalesce(F.nullif(F.col("__category"), F.lit("")), F.lit("news")).alias("source_category"), F.col("__published").alias("published_at"), F.col("__date").isNull().alias("published_at_inferred"), F.col("__summary").alias("summary"), F.col("__excerpt").alias("content_excerpt"),
        F.col("__image").alias("image_url"), "fetched_at", F.col("__credibility").alias("credibility"), F.col("__authority").alias("source_authority"), F.col("__timeliness").alias("timeliness_tier"), F.col("__tags").alias("tags"),
        T.detect_language(first("source_language", "language", "lang"), F.col("__title"), T.first_filled(F.col("__summary"), F.col("__excerpt"))).alias("source_language"), first("source_tier", "tier").alias("source_tier"), first("evidence_type").alias("evidence_type"),
    )
    return classify_items_basic(df, rules)


def classify_items_basic(df: DataFrame, rules=fixed.DERIVED_CATEGORIES) -> DataFrame:
    """Adds category, primary_category, impact_areas, source_tier, evidence_type, evidence_weight and id. The searched text is a
    column of its own, so that each pattern reads it but does not build it again."""
    df = df.withColumn("__text", T.item_text(df))
    df = df.withColumn("category", derived_category(F.col("source_category"), F.col("__text"), rules)).withColumn("impact_areas", impact_areas(F.col("__text"), rules))
    df = df.withColumn("primary_category", F.when(F.col("category") != F.col("source_category"), F.col("source_category")))
    df = df.withColumn("source_tier", source_tier(df))
    df = df.withColumn("evidence_type", evidence_type(df, F.col("__text"), F.col("source_tier")))
    df = df.withColumn("evidence_weight", evidence_weight(F.col("evidence_type")))
    return df.withColumn("id", item_id(F.col("category"), F.col("source"), F.col("title"), F.col("url"), F.col("published_at"))).drop("__text")
