"""Feed tables derived from the given ones, in Spark and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer files than the cluster has cores, dealt out evenly before work on each row: a small file is one task otherwise. Tables
    of many files stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def items(spark: SparkSession, sf_dir: str, runs: int = 8) -> DataFrame:
    """documents as items: the first line's start as title, all the text after that as summary, times back from NOW by id. The address holds
    a digest of the text, so that only real copies share it. Null texts are empty, a null source is named unknown."""
    d = spread(table(spark, sf_dir, "documents")).select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("unknown")).alias("source"))
    n = F.coalesce(F.substring("source", 4, 9).try_cast("int"), F.lit(0))
    title = F.substring(F.substring_index("text", "\n", 1), 1, 120)
    authority = F.get(F.array(*[F.lit(x) for x in ("official-agency", "official-media", "media", "blog")]), n % 4)
    category = F.when(F.col("lang") == "en", "tech").when(F.col("lang") == "de", "finance").when(F.col("lang") == "fr", "business").otherwise("news")
    return d.select(
        (F.col("doc_id") % runs).alias("run_id"), F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("id"), F.lit("").alias("source_id"), title.alias("title"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example/"), F.substring(F.md5("text"), 1, 16)).alias("url"), "source", F.lit("rss").alias("source_type"), category.alias("category"), category.alias("source_category"),
        F.timestamp_seconds(F.unix_timestamp(F.lit(NOW).cast("timestamp")) - (F.col("doc_id") % 240) * 3600).alias("published_at"), F.lit(False).alias("published_at_inferred"), F.substr(F.col("text"), F.length(title) + 1).alias("summary"),
        F.lit(NOW).cast("timestamp").alias("fetched_at"), (n * 2 + 60).cast("double").alias("credibility"), authority.alias("source_authority"), F.lit("daily").alias("timeliness_tier"), F.array().cast("array<string>").alias("tags"),
    )


#: White space and tags, cleaned as clean_text does.
SPACES = r"[ \t\n\x0B\f\r\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def cleaned(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), '{SPACES}+', ' ', 'g'))"


ITEMS = """docs as (select doc_id, lang, coalesce(text, '') as text, coalesce(source, 'unknown') as source, coalesce(try_cast(substr(coalesce(source, 'unknown'), 4) as int), 0) as k from documents),
items as (
select doc_id % {runs} as run_id, doc_id as ord, cast(doc_id as varchar) as id, substr(split_part(text, chr(10), 1), 1, 120) as title,
  'https://' || source || '.example/' || substr(md5(text), 1, 16) as url, source, case lang when 'en' then 'tech' when 'de' then 'finance' when 'fr' then 'business' else 'news' end as category,
  timestamp '2024-01-31 00:00:00' - to_hours(cast(doc_id % 240 as int)) as published_at, substr(text, length(substr(split_part(text, chr(10), 1), 1, 120)) + 1) as summary, cast(k * 2 + 60 as double) as credibility,
  (['official-agency', 'official-media', 'media', 'blog'])[k % 4 + 1] as source_authority
from docs),
words as (select *, """ + cleaned("title || ' ' || summary").replace("{", "{{").replace("}", "}}") + """ as text from items)"""

#: Rules of words that the given tables hold.
DERIVED = (("macro", "M", "tion"), ("international", "I", "heit"), ("business", "B", "ción"))
EVENTS = (("policy_change", "aient"), ("earnings_guidance", "heit"), ("commentary", "ción"), ("product_launch", "tion"))
KEYWORDS = (("tion", 8), ("heit", 5), ("ción", 6), ("AI", 2))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as fetch attempts of 20 sources in four streams."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("attempt_id"), (F.col("user_id") % 4).alias("stream"), F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("source"), F.col("ts").cast("timestamp").alias("fetched_at"), (F.col("event_type") != "error").alias("ok"), (F.floor("value").cast("long") % 16).alias("item_count"))


ATTEMPTS = """attempts as (select event_id as attempt_id, user_id % 4 as stream, 'src' || (user_id % 20) as source, ts as fetched_at, event_type <> 'error' as ok, cast(floor(value) as bigint) % 16 as item_count from events)"""


def source_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run a source and day: attempts, items, and what passed."""
    a = attempts(spark, sf_dir).withColumn("day", F.date_trunc("day", "fetched_at"))
    n = F.col("item_count")
    return a.groupBy("source", F.col("day").alias("generated_at")).agg(
        F.sum(n).alias("fetched_count"), F.sum(F.when(F.col("ok"), F.least(n, F.lit(9)))).alias("passed_count"), F.sum(F.when(~F.col("ok"), n).otherwise(F.floor(n / 2))).cast("long").alias("duplicate_count"), F.sum(F.when(n > 14, F.lit(1)).otherwise(0)).cast("long").alias("high_value_count"),
        F.count("*").alias("body_attempt_count"), F.count_if("ok").alias("body_success_count"), F.sum((n * 5).cast("double")).alias("density_total"), F.count("*").alias("density_count"), (F.count_if("ok") == 0).alias("fetch_failed"), F.lit(False).alias("is_probe"),
    ).withColumn("high_value_rate", F.try_divide("high_value_count", "fetched_count")).withColumn("body_success_rate", F.try_divide("body_success_count", "body_attempt_count"))


RUNS = ATTEMPTS + """, runs as (select source, date_trunc('day', fetched_at) as generated_at, cast(sum(item_count) as bigint) as fetched_count, cast(sum(case when ok then least(item_count, 9) end) as bigint) as passed_count,
cast(sum(case when not ok then item_count else item_count // 2 end) as bigint) as duplicate_count, cast(sum(case when item_count > 14 then 1 else 0 end) as bigint) as high_value_count, count(*) as body_attempt_count, count(*) filter (where ok) as body_success_count,
cast(sum(item_count * 5) as double) as density_total, count(*) as density_count from attempts group by 1, 2)"""
