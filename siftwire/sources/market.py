"""Market payloads: quotes, movers, sentiment, and the last good snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import scan


def payload_error(payload: Column) -> Column:
    """Whether the payload is a notice in place of data."""
    keys = F.from_json(payload, "map<string,string>")
    return F.coalesce(F.exists(F.map_keys(keys), lambda k: k.isin("Note", "Information", "Error Message")), F.lit(True))


def normalize_quotes(payloads: DataFrame) -> DataFrame:
    """symbol, status, price, change, change_percent, change_percent_value, volume, trading_day, fetched_at; status is missing where the
    payload has no price, percentage and day."""
    m = F.from_json("payload", "map<string,string>")
    inner = F.from_json(F.coalesce(F.try_element_at(m, F.lit("Global Quote")), F.try_element_at(m, F.lit("globalQuote"))), "map<string,string>")
    df = payloads.withColumn("__q", F.coalesce(inner, m))
    get = lambda *names: F.coalesce(*[F.nullif(F.try_element_at("__q", F.lit(n)), F.lit("")) for n in names])
    price, percent, day = T.number(get("05. price", "price")), get("10. change percent", "changePercent", "change_percentage"), get("07. latest trading day", "latestTradingDay", "tradingDay")
    some = (F.coalesce(price, F.lit(0.0)) != 0) | percent.isNotNull() | day.isNotNull()
    value = lambda c: F.when(F.col("status") == "available", c)
    df = df.withColumn("status", F.when(some, "available").otherwise("missing"))
    return df.select("symbol", "status", value(price).alias("price"), value(T.number(get("09. change", "change"))).alias("change"), value(percent).alias("change_percent"), value(T.number(percent)).alias("change_percent_value"), value(T.number(get("06. volume", "volume"))).alias("volume"), value(day).alias("trading_day"), "fetched_at")


def normalize_movers(payloads: DataFrame) -> DataFrame:
    """A row for each gainer, loser and active symbol; rows without a symbol go."""
    one = "array<struct<ticker:string,symbol:string,price:string,change_amount:string,changeAmount:string,change_percentage:string,changePercent:string,volume:string>>"
    parsed = payloads.withColumn("__p", F.from_json("payload", f"struct<top_gainers:{one},top_losers:{one},most_actively_traded:{one}>"))
    out = None
    for field, direction in (("top_gainers", "gainer"), ("top_losers", "loser"), ("most_actively_traded", "active")):
        e = parsed.select("fetched_at", F.explode(f"__p.{field}").alias("e"))
        pct = F.coalesce("e.change_percentage", "e.changePercent")
        rows = e.select(F.coalesce(F.nullif(F.col("e.ticker"), F.lit("")), F.col("e.symbol"), F.lit("")).alias("symbol"), T.number(F.col("e.price")).alias("price"), T.number(F.coalesce("e.change_amount", "e.changeAmount")).alias("change_amount"), pct.alias("change_percent"), T.number(pct).alias("change_percent_value"), T.number(F.col("e.volume")).alias("volume"), F.lit(direction).alias("direction"), "fetched_at")
        out = rows if out is None else out.unionByName(rows)
    return out.where("symbol <> ''")


def normalize_sentiment(payloads: DataFrame, most: int = 8) -> DataFrame:
    """The first `most` entries of each symbol's feed."""
    feed = F.from_json("payload", "struct<feed:array<struct<title:string,url:string,source:string,time_published:string,summary:string,overall_sentiment_score:string,overall_sentiment_label:string>>>")["feed"]
    e = payloads.select("symbol", F.posexplode(F.slice(feed, 1, most)).alias("ord", "e"))
    text = [T.text_or_empty(F.col(f"e.{c}")).alias(c) for c in ("title", "url", "source", "time_published", "summary", "overall_sentiment_label")]
    return e.select("symbol", "ord", *text, T.number(F.col("e.overall_sentiment_score")).alias("overall_sentiment_score"))


def market_asof(payloads: DataFrame) -> DataFrame:
    """Each payload, or the last good one of its symbol and function before it where it is an error; adds stale. The history of a symbol is scanned
    in chunks (see scan)."""
    keys = ["symbol", "function"]
    df = scan.chunked(payloads.withColumn("__bad", payload_error(F.col("payload"))), keys, ["fetched_at"])
    df = scan.last_values(df, keys, ["fetched_at"], {"__last": F.when(~F.col("__bad"), F.col("payload"))})
    df = df.withColumn("stale", F.col("__bad") & F.col("__last").isNotNull())
    return df.withColumn("payload", F.when(F.col("__bad"), F.coalesce("__last", "payload")).otherwise(F.col("payload"))).drop("__bad", "__last", scan.CHUNK)
