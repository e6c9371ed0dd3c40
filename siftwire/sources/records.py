"""Landed records: JSON documents, feed XML, API bodies, mapped lists, archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from ..functions import text as T

ITEM = "struct<title:string,link:string,guid:string,pub_date:string,published_at:string,headline:string,summary:string,description:string,content:string,content_snippet:string,feed_image_url:string,source_tier:string,evidence_type:string,lang:string,tags:array<string>,categories:array<string>>"
RECORD = f"source_id string, source_name string, source_type string, category string, credibility double, source_authority string, timeliness_tier string, url string, status int, ok boolean, item_count int, fetched_at timestamp, error string, items array<{ITEM}>, body string"


def read_raw_records(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    """JSON documents (arrays or objects over several lines); no rows where the path does not exist."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    if fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(fs) in (None, []) and not fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs):
        return spark.createDataFrame([], Ty._parse_datatype_string(schema))
    return spark.read.schema(schema).json(path, multiLine=True)


def explode_records(records: DataFrame) -> DataFrame:
    """A row for each item of a record: the item's fields, those of the record where the item has none of that name, and ord."""
    df = records.select("*", F.posexplode("items").alias("ord", "item"))
    inner = {f.name for f in df.schema["item"].dataType.fields}
    outer = [c for c in records.columns if c not in ("items", "body") and c not in inner]
    return df.select(*outer, "ord", "item.*")


def api_bodies(body: Column, names: tuple[str, ...] = ("items", "articles", "data"), item: str = ITEM) -> Column:
    """The items of an API body: a bare array, the first of the named arrays, or the object itself."""
    t = T.trim_ws(T.text_or_empty(body))
    listed = F.when(t.startswith("["), F.from_json(t, f"array<{item}>"))
    parsed = F.from_json(t, "struct<" + ",".join(f"`{n}`:array<{item}>" for n in names) + ">")
    single = F.when(t.startswith("{"), F.array(F.from_json(t, item)))
    return F.coalesce(listed, *[parsed[n] for n in names], single, F.array().cast(f"array<{item}>"))


def explode_api_body(records: DataFrame) -> DataFrame:
    return explode_records(records.withColumn("items", api_bodies(F.col("body"))))


def api_item_count(body: Column) -> Column:
    """Items of the first of items, results, data, records that is an array, or of a bare array; else 0."""
    t = T.trim_ws(T.text_or_empty(body))
    names = ("items", "results", "data", "records")
    parsed = F.from_json(t, "struct<" + ",".join(f"{n}:array<string>" for n in names) + ">")
    size = lambda c: F.when(c.isNotNull(), F.size(c))
    return F.coalesce(F.when(t.startswith("["), size(F.from_json(t, "array<string>"))), *[size(parsed[n]) for n in names], F.lit(0))


def decode_xml(c: Column) -> Column:
    out = F.regexp_replace(c, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return T.trim_ws(out)


def tag(block: Column, name: str) -> Column:
    """A tag's content, or its href; empty if there is none."""
    inner = F.regexp_extract(block, rf"(?is)<{name}(?:\s[^>]*)?>(.*?)</{name}>", 1)
    href = F.regexp_extract(block, rf"""(?is)<{name}(?:\s[^>]*)?href=["']([^"']+)["'][^>]*/?>""", 1)
    return decode_xml(F.when(inner != "", inner).otherwise(href))


def attribute(block: Column, name: str, key: str) -> Column:
    return decode_xml(F.regexp_extract(F.regexp_extract(block, rf"(?is)<{name}(?:\s[^>]*)?/?>", 0), rf"""(?is)\s{key}\s*=\s*["']([^"']*)["']""", 1))


def feed_image(block: Column, description: Column, content: Column) -> Column:
    """media:content that is an image, media:thumbnail, an image enclosure, the first img of the content, then of the description."""
    img = lambda c: decode_xml(F.regexp_extract(c, r"""(?is)<img\b[^>]*\bsrc\s*=\s*["']([^"']+)["'][^>]*>""", 1))
    medium = attribute(block, "media:content", "medium")
    first = F.when(medium.isin("", "image"), attribute(block, "media:content", "url"))
    enclosed = F.when(F.lower(attribute(block, "enclosure", "type")).startswith("image/"), attribute(block, "enclosure", "url"))
    filled = [F.nullif(c, F.lit("")) for c in (first, attribute(block, "media:thumbnail", "url"), enclosed, img(content), img(description))]
    return F.coalesce(*filled, F.lit(""))


def parse_feed_items(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """A row for each item or entry of a feed's XML, with its fields, categories and image."""
    blocks = F.regexp_extract_all(F.col(xml), F.lit(r"(?is)<(item|entry)(?:\s[^>]*)?>.*?</\1>"), 0)
    df = feeds.select("*", F.posexplode(blocks).alias("ord", "__b")).drop(xml)
    either = lambda *names: F.coalesce(*[F.nullif(tag(F.col("__b"), n), F.lit("")) for n in names], F.lit(""))
    df = df.withColumns({"title": tag(F.col("__b"), "title"), "link": tag(F.col("__b"), "link"), "guid": either("guid", "id"), "pub_date": either("pubDate", "published", "updated"), "description": either("description", "summary"), "content": either("content:encoded", "content")})
    cats = F.transform(F.regexp_extract_all(F.col("__b"), F.lit(r"(?is)<category(?:\s[^>]*)?>(.*?)</category>"), 1), lambda c: decode_xml(c))
    return df.withColumn("categories", cats).withColumn("feed_image_url", feed_image(F.col("__b"), F.col("description"), F.col("content"))).drop("__b")


def map_json_list(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Items of listed JSON rows (source_id, fetched_at, row map<string,string>) by each source's own mapping of columns."""
    df = rows.join(sources.select("source_id", "mapping", F.col("url").alias("base"), "require_published_date"), "source_id", "left")
    get = lambda k: F.coalesce(F.try_element_at("row", F.coalesce(F.try_element_at("mapping", F.lit(k)), F.lit(k))), F.lit(""))
    raw = get("url")
    root = F.regexp_extract("base", r"^(https?://[^/]+)", 1)
    link = F.when(raw.rlike("^https?://"), raw).when(raw.startswith("//"), F.concat(F.lit("https:"), raw)).when(raw.startswith("/"), F.concat(root, raw)).when(raw != "", F.concat(F.regexp_replace("base", "[^/]*$", ""), raw)).otherwise("")
    when = F.coalesce(T.date_in_text(F.coalesce(F.nullif(get("published_at"), F.lit("")), link)), F.when(~F.coalesce("require_published_date", F.lit(True)), F.col("fetched_at")))
    return df.select("source_id", "fetched_at", T.clean_text(get("title")).alias("title"), link.alias("link"), when.alias("published_at"), T.clean_text(get("summary")).alias("summary"))


def union_families(*families: DataFrame) -> DataFrame:
    """Rows of several source families, missing columns being null."""
    out = families[0]
    for f in families[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def read_archive(spark: SparkSession, path: str, now: str, days: int = 15) -> DataFrame:
    """The archive's last `days` days; only their partitions are read."""
    t = F.lit(now).cast("timestamp")
    return spark.read.parquet(path).where((F.col("date") >= F.to_date(t - F.expr(f"interval {days} days"))) & (F.col("date") <= F.to_date(t)))


def write_archive(df: DataFrame, path: str) -> None:
    """One partition a day; writing a day again replaces that day only. Rows are dealt by day, and a large day over several tasks."""
    df.hint("rebalance", "date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def distinct_links(links: DataFrame) -> DataFrame:
    w = W.partitionBy("source_id", "title", "link").orderBy("ord")
    return links.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
