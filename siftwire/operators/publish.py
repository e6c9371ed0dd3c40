"""Keywords, published rows, channel feeds, archives and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from . import scan

NONE = "array<string>"


def _list(df: DataFrame, c: str) -> Column:
    return F.coalesce(T.column_or(df, c, None, NONE), F.array().cast(NONE))


def extract_keywords(df: DataFrame, limit: int = 8) -> Column:
    """Given keywords, hits, areas, tags, rule labels, Latin words and Chinese runs, in this order: distinct ignoring case, at most 30
    characters, without technical labels."""
    parts = [T.column_or(df, c, None, "string") for c in ("title_zh", "translated_title", "title", "summary_zh", "ai_summary", "summary", "content_excerpt")]
    text = T.clean_text(F.concat_ws(" ", *[F.when(T.text_or_empty(p) != "", p) for p in parts]))
    stop, technical = (F.array(*[F.lit(w) for w in words]) for words in (fixed.ENGLISH_STOPWORDS, fixed.TECHNICAL_LABELS))
    terms = F.transform(F.col("keyword_hits"), lambda k: k["term"]) if "keyword_hits" in df.columns else F.array().cast(NONE)
    given = [_list(df, "article_keywords"), F.coalesce(terms, F.array().cast(NONE)), _list(df, "impact_areas"), _list(df, "tags")]

    def made(t: Column) -> Column:
        latin = F.slice(T.first_matches(t, r"[A-Za-z][A-Za-z0-9+-]{2,}", 16, lambda w: ~F.array_contains(stop, F.lower(w))), 1, 16)
        chinese = F.slice(F.regexp_extract_all(t, F.lit(r"[\x{4e00}-\x{9fff}]{2,12}"), 0), 1, 16)
        rules = [*fixed.FINE_KEYWORDS, *[(label, p) for _, label, p in fixed.DERIVED_CATEGORIES]]
        labels = T.let(T.sieved(t, [p for _, p in rules]), lambda near: T.all_rules(near, rules))
        found = F.concat(*given, labels, latin, chinese)
        clean = lambda x: T.trim_ws(F.regexp_replace(T.clean_text(x), "^#", ""))
        fits = lambda v: F.when((F.length(v) <= 30) & ~F.array_contains(technical, F.lower(v)), v).otherwise("")
        return T.distinct_ignoring_case(found, limit, lambda x: T.let(clean(x), fits))

    return T.let(text, made)  # the text is read by each rule, and made once


def publish_items(items: DataFrame) -> DataFrame:
    """The display row of each item: truncated texts, language, translation status, display channel, keywords."""
    have = lambda c, k="string": T.column_or(items, c, None, k)
    language = F.coalesce(F.nullif(T.detect_language(have("source_language"), F.col("title"), T.first_filled(F.col("summary"), have("content_excerpt"))), F.lit("")), F.lit("unknown"))
    df = items.withColumn("__lang", language)
    zh = F.col("__lang") == "zh"
    title_zh = T.first_filled(have("title_zh"), have("translated_title"), F.when(zh, F.col("title")))
    summary_zh = T.first_filled(have("summary_zh"), F.when(have("summary_language") == "zh", have("ai_summary")), F.when(zh, F.col("summary")))
    chinese = zh | F.col("__lang").startswith("zh-") | F.col("__lang").isin("cn", "chinese")
    status = F.coalesce(F.nullif(F.lower(T.clean_text(have("translation_status"))), F.lit("")), F.when(chinese, "not_required").when(title_zh.isNotNull() | summary_zh.isNotNull(), "translated").otherwise("pending"))
    df = df.withColumn("article_keywords", extract_keywords(items))
    areas = F.when(F.size(_list(items, "impact_areas")) > 0, F.slice(_list(items, "impact_areas"), 1, 4)).otherwise(F.slice("article_keywords", 1, 4))
    channel = T.first_filled(have("display_channel"), T.lookup(fixed.DISPLAY_CHANNELS, F.col("category"), None), have("source_category"), F.col("category"))
    keep = [c for c in ("run_id", "ord") if c in items.columns]
    return df.select(
        *keep, "id", have("source_id").alias("source_id"), "title", T.truncate_text(F.col("title"), 180).alias("title_original"), T.truncate_text(title_zh, 120).alias("title_zh"), "url", "source", "category", F.coalesce(have("source_category"), have("primary_category"), F.col("category")).alias("source_category"),
        channel.alias("display_channel"), "published_at", have("source_authority").alias("source_authority"), have("source_tier").alias("source_tier"), have("evidence_type").alias("evidence_type"), T.truncate_text(F.col("summary"), 500).alias("summary"), T.truncate_text(summary_zh, 500).alias("summary_zh"),
        T.truncate_text(have("content_excerpt"), 500).alias("content_excerpt"), F.col("__lang").alias("source_language"), status.alias("translation_status"), T.https_image(have("image_url")).alias("image_url"), F.slice(_list(items, "tags"), 1, 8).alias("tags"), "article_keywords", areas.alias("impact_areas"), "score",
        have("importance_score", "int").alias("importance_score"), F.coalesce(have("duplicate_count", "int"), F.lit(0)).alias("duplicate_count"),
    )


def ranking() -> list[Column]:
    return [F.desc_nulls_last("score"), F.desc_nulls_last("published_at"), F.asc("id")]


def channel_feed(published: DataFrame, limits: dict[str, int] | None = None, default: int = 12, least_score: float | None = None) -> DataFrame:
    """The best items of each run and channel with rank and the channel's count. Spark drops rows past the limit before the shuffle."""
    df = published if least_score is None else published.where(F.col("score") >= least_score)
    channel = F.coalesce("display_channel", "category")
    df = df.withColumn("channel", channel)
    counts = df.groupBy("run_id", "channel").agg(F.count("*").alias("channel_count"))
    limit = T.lookup(limits or {}, F.col("channel"), default)
    most = max([default, *(limits or {}).values()])
    ranked = df.withColumn("rank", F.row_number().over(W.partitionBy("run_id", "channel").orderBy(*ranking()))).where(F.col("rank") <= most).where(F.col("rank") <= limit)
    return ranked.join(counts, ["run_id", "channel"])


def latest_or_previous(runs: DataFrame, feed: DataFrame) -> DataFrame:
    """(run_id, from_run): the run whose feed stands at each run: its own, or the last one before it that was not empty. Runs are scanned in
    chunks (see scan)."""
    filled = feed.select("run_id").distinct().withColumn("filled", F.col("run_id"))
    every = runs.select("run_id").distinct().join(filled, "run_id", "left").withColumn("all", F.lit(0))
    found = scan.last_values(scan.chunked(every, ["all"], ["run_id"]), ["all"], ["run_id"], {"from_run": F.col("filled")})
    return found.select("run_id", "from_run")


def archive_items(feed: DataFrame, limit: int = 20) -> DataFrame:
    """Each day's first `limit` items of each category in feed order, with columns cut to archive lengths."""
    top = feed.withColumn("archive_rank", F.row_number().over(W.partitionBy("date", "category").orderBy(*ranking()))).where(F.col("archive_rank") <= limit)
    return compact_items(top)


def compact_items(df: DataFrame) -> DataFrame:
    cuts = {"title_original": 180, "title_zh": 120, "summary": 500, "summary_zh": 500, "content_excerpt": 500, "ai_summary": 240, "summary_short": 140, "why_it_matters": 240, "impact": 240, "risks": 240, "summary_reason": 160, "importance": 180}
    lists = {"secondary_tags": 6, "tags": 8, "article_keywords": 8, "keywords": 8, "impact_areas": 4, "summary_points": 5, "key_data": 8}
    new = {c: F.substring(c, 1, n) for c, n in cuts.items() if c in df.columns} | {c: F.slice(c, 1, n) for c, n in lists.items() if c in df.columns}
    return df.withColumns(new)


def history_index(archive: DataFrame, days: int = 10) -> DataFrame:
    """The newest days of the archive with their item counts and whether they have a brief (a column of that name), and how many days
    there are."""
    brief = F.coalesce(T.column_or(archive, "has_brief", False, "boolean"), F.lit(False))
    per = archive.groupBy("date").agg(F.count("*").alias("total_items"), F.count_distinct("category").alias("categories"), F.bool_or(brief).alias("has_brief"))
    total = per.groupBy(F.lit(1).alias("k")).agg(F.count("*").alias("total_archive_days"))
    return per.orderBy(F.desc("date")).limit(days).withColumn("k", F.lit(1)).join(F.broadcast(total), "k").drop("k")


def lookup_items(keys: DataFrame, latest: DataFrame, archive: DataFrame) -> DataFrame:
    """The item of each key (key_id, or key_url where that is null): from the latest feed, else from the newest day of the archive."""
    cols = ["id", "url", "title", "source", "score"]
    pool = latest.select(*cols, F.lit(None).cast("date").alias("date"), F.lit(0).alias("p")).unionByName(archive.select(*cols, F.col("date").cast("date").alias("date"), F.lit(1).alias("p")))
    by_id = keys.where("key_id is not null").join(pool, F.col("key_id") == F.col("id"))
    by_url = keys.where("key_id is null and key_url is not null").join(pool, F.col("key_url") == F.col("url"))
    w = W.partitionBy("key_id", "key_url").orderBy("p", F.desc_nulls_last("date"), "id")
    return by_id.unionByName(by_url).withColumn("r", F.row_number().over(w)).where("r = 1").drop("r", "p")


def fill_translations(items: DataFrame, previous: DataFrame, columns: tuple[str, ...] = ("title_zh", "summary_zh")) -> DataFrame:
    """Blank translations filled from the newest earlier row of the same address."""
    last = previous.groupBy("url").agg(F.max_by(F.struct(*columns), "fetched_at").alias("__p"))
    df = items.join(last, "url", "left")
    for c in columns:
        df = df.withColumn(c, T.first_filled(T.column_or(items, c, None, "string"), F.col(f"__p.{c}")))
    return df.drop("__p")


def translation_routing(items: DataFrame) -> DataFrame:
    """(route, count): items that are Chinese, translated already, or still to translate."""
    done = (T.text_or_empty(T.column_or(items, "title_zh", None, "string")) != "") & (T.text_or_empty(T.column_or(items, "summary_zh", None, "string")) != "")
    route = F.when(F.col("source_language").startswith("zh"), "not_required").when(done, "existing").otherwise("needs_translation")
    return items.groupBy(route.alias("route")).count()


def summary_selection(published: DataFrame, per_channel: int = 6, translate: int = 30) -> DataFrame:
    """(run_id, id) of the best of each channel and of the best that still need translation."""
    by = W.partitionBy("run_id", "display_channel").orderBy(*ranking())
    top = published.withColumn("r", F.row_number().over(by)).where(F.col("r") <= per_channel).select("run_id", "id")
    need = published.where("translation_status = 'pending'").withColumn("r", F.row_number().over(W.partitionBy("run_id").orderBy(*ranking()))).where(F.col("r") <= translate).select("run_id", "id")
    return top.unionByName(need).distinct()


def weekly_top_sources(published: DataFrame, limit: int = 6) -> DataFrame:
    n = published.groupBy(T.iso_week(F.col("published_at")).alias("week_id"), "display_channel", "source").count()
    return n.withColumn("rank", F.row_number().over(W.partitionBy("week_id", "display_channel").orderBy(F.desc("count"), "source"))).where(F.col("rank") <= limit)
