"""Weekly review over the archive of events: windows, themes, judgments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


def enabled_only(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows whose primary source is enabled, by id or by name; rows without a source stay."""
    on = sources.where("enabled")
    ids, names = on.select(F.col("source_id").alias("primary_id")).distinct(), on.select(F.col("name").alias("primary_name")).distinct()
    bare = (T.text_or_empty(F.col("primary_id")) == "") & (T.text_or_empty(F.col("primary_name")) == "")
    by_id = rows.where(~bare).join(ids, "primary_id", "left_semi")
    by_name = rows.where(~bare).join(ids, "primary_id", "left_anti").join(names, "primary_name", "left_semi")
    return rows.where(bare).unionByName(by_id).unionByName(by_name)


def theme_identity(df: DataFrame) -> Column:
    entities = F.coalesce(T.column_or(df, "entities", None, "array<string>"), F.array().cast("array<string>"))
    made = F.lower(F.concat_ws(":", F.coalesce("category", F.lit("other")), F.coalesce("event_type", F.lit("other")), T.first_filled(F.array_join(F.slice(entities, 1, 2), "-"), F.col("title"))))
    return F.coalesce(F.nullif(F.col("theme_key"), F.lit("")), made)


def weekly_windows(events: DataFrame, review_dates: list[str]) -> DataFrame:
    """Events of the 7 whole days before each review date (window current) and of the 7 before these (previous); of each event the latest
    version. A backfill gives many dates: each event goes to the weeks that it belongs to, by its age in days."""
    dates = F.array(*[F.lit(d).cast("date") for d in review_dates])
    age = lambda d: F.datediff(d, F.to_date("archived_at"))
    df = events.withColumn("review_date", F.explode(F.filter(dates, lambda d: age(d).between(1, 14))))
    df = df.withColumn("window", F.when(age(F.col("review_date")) <= 7, "current").otherwise("previous"))
    key = F.coalesce(F.nullif(F.col("event_id"), F.lit("")), F.concat_ws(":", "theme_key", "title"))
    w = W.partitionBy("review_date", "window", key).orderBy(F.desc("archived_at"), "ord")
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r").withColumn("week_id", T.iso_week(F.date_sub("review_date", 1).cast("timestamp")))


def weekly_themes(windows: DataFrame, prior: DataFrame | None = None, limit: int = 5) -> DataFrame:
    """Each week's themes: events, distinct source addresses, signal, change against the week before, top event's conclusion, evidence, risks, conflict, and
    the judgment's id and version carried over from `prior` (week_id's review: theme_key, judgment_id, judgment_version, conclusion)."""
    df = windows.withColumn("theme", theme_identity(windows))
    key = ["review_date", "theme"]
    cur = df.where("window = 'current'")
    urls = F.array_distinct(F.filter(F.concat(F.array("primary_url"), F.coalesce(T.column_or(df, "supporting_urls", None, "array<string>"), F.array().cast("array<string>"))), lambda u: T.text_or_empty(u) != ""))
    n_sources = cur.select(*key, F.explode(urls).alias("u")).groupBy(*key).agg(F.count_distinct("u").alias("source_count"))
    top = F.struct(-F.coalesce("importance_score", F.lit(0.0)), F.col("event_id"))
    conclusion = T.truncate_text(T.first_filled(T.column_or(df, "why_it_matters", None, "string"), F.col("summary"), F.col("title")), 260)
    conflict = F.size(F.coalesce(T.column_or(df, "conflicting_evidence", None, "array<string>"), F.array().cast("array<string>"))) > 0
    g = cur.withColumn("__c", conclusion).withColumn("__x", conflict).groupBy(*key).agg(F.min("week_id").alias("week_id"), F.count("*").alias("event_count"), F.min_by("title", top).alias("title"), F.min_by("__c", top).alias("conclusion"), F.bool_or("__x").alias("has_conflict"))
    # Evidence: the theme's five best events; risks: the distinct gaps that its events name.
    best = cur.withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy(top))).where("__n <= 5")
    fact = T.truncate_text(T.first_filled(F.col("summary"), F.col("title"), F.lit("")), 220)
    proof = best.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("__n", "event_id", fact.alias("fact"), F.coalesce("primary_url", F.lit("")).alias("source_url")))), lambda x: F.struct(x["event_id"].alias("event_id"), x["fact"].alias("fact"), x["source_url"].alias("source_url"))).alias("evidence"))
    gaps = F.coalesce(T.column_or(df, "evidence_gaps", None, "array<string>"), F.array().cast("array<string>"))
    risks = cur.select(*key, F.explode(gaps).alias("r")).select(*key, T.clean_text(F.col("r")).alias("r")).where("r <> ''").groupBy(*key).agg(F.sort_array(F.collect_set("r")).alias("risks"))
    before = df.where("window = 'previous'").groupBy(*key).agg(F.count("*").alias("previous_count"))
    g = g.join(proof, key, "left").join(risks, key, "left").withColumn("risks", F.coalesce("risks", F.array().cast("array<string>")))
    out = g.join(n_sources, key, "left").join(before, key, "left").withColumns({"source_count": F.coalesce("source_count", F.lit(0)), "previous_count": F.coalesce("previous_count", F.lit(0))})
    n, s = F.col("event_count"), F.col("source_count")
    out = out.withColumn("signal", F.when((n >= 3) & (s >= 3), "strong").when((n >= 2) | (s >= 2), "medium").otherwise("weak"))
    level = F.when(F.col("signal") == "strong", 0).when(F.col("signal") == "medium", 1).otherwise(2)
    out = out.withColumn("rank", F.row_number().over(W.partitionBy("review_date").orderBy(level, F.desc("event_count"), "theme"))).where(F.col("rank") <= limit)
    if prior is not None:
        p = prior.select(F.col("theme_key").alias("theme"), F.col("judgment_id").alias("__id"), F.col("judgment_version").alias("__v"), F.col("conclusion").alias("__pc"))
        out = out.join(p, "theme", "left")
    else:
        out = out.withColumns({"__id": F.lit(None).cast("string"), "__v": F.lit(None).cast("int"), "__pc": F.lit(None).cast("string")})
    same = T.clean_text(F.col("__pc")) == T.clean_text(F.col("conclusion"))
    version = F.when(F.col("__id").isNull(), 1).when(same, F.coalesce("__v", F.lit(1))).otherwise(F.coalesce("__v", F.lit(1)) + 1)
    return out.withColumn("judgment_id", F.coalesce("__id", T.stable_id("judgment-", F.col("theme")))).withColumn("judgment_version", version.cast("int")).withColumn("had_prior", F.col("__id").isNotNull()).withColumn("same_conclusion", F.coalesce(same, F.lit(False))).drop("__id", "__v", "__pc")


def judgment_validation(themes: DataFrame, prior: DataFrame) -> DataFrame:
    """(theme, judgment_id, outcome): verified, falsified, deviated, or pending where there is no base or no new evidence."""
    p = prior.select(F.col("theme_key").alias("theme"), F.col("judgment_id").alias("__id"), T.clean_text(F.col("conclusion")).alias("__pc"))
    df = themes.select("theme", "judgment_id", "signal", "has_conflict", T.clean_text(F.col("conclusion")).alias("__c")).join(p, "theme", "full")
    new, old = F.col("judgment_id").isNotNull(), F.col("__id").isNotNull()
    outcome = F.when(~new | ~old, "pending").when(F.col("has_conflict"), "falsified").when((F.col("__c") == F.col("__pc")) & (F.col("signal") != "weak"), "verified").otherwise("deviated")
    return df.select("theme", F.coalesce("judgment_id", "__id").alias("judgment_id"), outcome.alias("outcome"))


def weekly_major_events(windows: DataFrame, limit: int = 6) -> DataFrame:
    w = W.partitionBy("review_date").orderBy(F.desc(F.coalesce("importance_score", F.lit(0.0))), "event_id")
    return windows.where("window = 'current'").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def weekly_key_data(windows: DataFrame, limit: int = 10) -> DataFrame:
    """Rows of key data (metric, value, comparison, change, meaning) that are complete, in the events' order."""
    e = windows.where("window = 'current'").select("review_date", "event_id", "primary_url", F.posexplode("key_data").alias("p", "d"))
    fields = {n: T.clean_text(F.col(f"d.{n}")) for n in ("metric", "value", "comparison", "change", "meaning")}
    e = e.withColumns(fields)
    for n in fields:
        e = e.where(F.col(n) != "")
    w = W.partitionBy("review_date").orderBy("event_id", "p")
    return e.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).drop("d", "p")
