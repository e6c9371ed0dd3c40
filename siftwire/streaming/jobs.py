"""Structured Streaming forms of the landing side: items, late data, duplicates, sessions, windows, health and the policy machine."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.audit import next_status
from ..operators.dedupe import fit
from ..operators.storage import stored
from ..sources.records import RECORD, explode_records


def stream_records(spark: SparkSession, path: str, schema: str = RECORD, fmt: str = "json", **options) -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).options(**options).load(path)


def stream_items(records: DataFrame, max_age_hours: float = 48) -> DataFrame:
    """Items of landed records within the age limit of their fetch, with a watermark on their time."""
    items = explode_records(records)
    when = F.coalesce(T.parse_date(F.coalesce("published_at", "pub_date")), F.col("fetched_at"))
    items = items.withColumn("published_at", when).withColumn("url", T.canonical_url(F.coalesce("link", "guid")))
    return items.where((F.unix_micros("fetched_at") - F.unix_micros("published_at")) <= max_age_hours * 3.6e9).withWatermark("published_at", f"{int(max_age_hours)} hours")


def stream_dedupe(items: DataFrame, *keys: str) -> DataFrame:
    """Each key once within the watermark."""
    return items.dropDuplicatesWithinWatermark(list(keys or ("url",)))


def stream_similar(items: DataFrame, index: str, checkpoint: str, threshold: float = 0.82, days: int = 7) -> None:
    """Takes what has landed of (ord, url, title, published_at) and gives each item its group among those of the last `days` days: that of the
    earliest group with a member of its address or of a like title, as first_fit gives it over a table. ord grows as items land.

    The index at `index` holds address, tokens and group of each item, by batch and day. A micro-batch reads the days it needs and is joined with
    them on its own rarest tokens; groups that are there stay. A batch that runs again replaces its own part."""
    spark = items.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        new = batch.select(F.lit(0).alias("run_id"), "ord", T.canonical_url(F.col("url")).alias("u"), F.sort_array(T.title_tokens(F.col("title"))).alias("tokens"), F.to_date("published_at").alias("day"))
        new = stored(new)
        low = new.agg(F.min("day")).first()[0]
        kinds = f"run_id int, ord {dict(new.dtypes)['ord']}, u string, tokens array<string>, group {dict(new.dtypes)['ord']}, batch long, day date"
        old = spark.createDataFrame([], kinds)
        if number and low is not None:
            old = spark.read.schema(kinds).option("basePath", index).parquet(index).where((F.col("batch") < number) & (F.col("day") >= F.date_sub(F.lit(low), days)))
        both = old.select("run_id", "ord", "u", "tokens", "group").unionByName(new.drop("day").withColumn("group", F.lit(None).cast(dict(new.dtypes)["ord"])))
        groups = fit(stored(both), threshold, ["run_id"])
        new.join(groups, ["run_id", "ord"]).write.mode("overwrite").partitionBy("day").parquet(f"{index}/batch={number}")

    items.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def daily_counts(items: DataFrame, late: str = "48 hours") -> DataFrame:
    return items.withWatermark("published_at", late).groupBy(F.window("published_at", "1 day").alias("day"), "source").agg(F.count("*").alias("items"))


def sliding_source_metrics(runs: DataFrame, width: str = "7 days", step: str = "1 day", late: str = "1 day") -> DataFrame:
    return runs.withWatermark("generated_at", late).groupBy(F.window("generated_at", width, step).alias("window"), "source").agg(F.sum("fetched_count").alias("fetched"), F.sum("passed_count").alias("passed"), F.sum("duplicate_count").alias("duplicates"))


def cache_expiry(records: DataFrame, now: str, max_age_hours: float = 48) -> DataFrame:
    """Adds cache_expires_at (a source's own hours may only lower the limit) and expired."""
    own = T.column_or(records, "cache_ttl_hours", None, "double")
    hours = F.when(own > 0, F.least(own, F.lit(float(max_age_hours)))).otherwise(float(max_age_hours))
    at = F.timestamp_micros(F.unix_micros("fetched_at") + (hours * F.lit(3.6e9)).cast("long"))
    return records.withColumn("cache_expires_at", at).withColumn("expired", F.col("cache_expires_at") < F.lit(now).cast("timestamp"))


TTL_DAYS = 35
DAY_MS = 86_400_000


class Fold:
    """What in_order does with the rows of a key, one after the other in time. State is plain JSON."""

    def add(self, state: dict | None, at: int, row: dict) -> tuple[dict, list[dict]]:
        """The state after `row` of time `at` (milliseconds), and the rows it gives."""
        raise NotImplementedError

    def ends(self, state: dict) -> int:
        """From which watermark on the state is closed if nothing more comes."""
        return state["at"] + TTL_DAYS * DAY_MS

    def close(self, state: dict) -> list[dict]:
        """The rows that closing gives; the state is gone then."""
        return []


def in_order(rows: DataFrame, key: str, time: str, late: str, fold: Fold, out: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """A stateful fold over each key's rows in the order of time (then `ties`), however they arrive: rows wait in the key's state until the
    watermark, `late` behind the latest time seen, has passed them, so none can come before them any more; rows behind the watermark are dropped. An
    event-time timer wakes a key for its next waiting row, or to close and delete a state that has ended. State holds the waiting rows
    of one key, which `late` bounds, and the fold's own."""
    names = [f.name for f in rows.schema if f.name != key]

    def step(name, batches, state):
        import pandas as pd

        held = json.loads(state.get[0]) if state.exists else {"fold": None, "rows": []}
        mark = state.getCurrentWatermarkMs()
        if not state.hasTimedOut:
            for pdf in batches:
                for r in pdf[names].to_dict("records"):
                    at = r[time].value
                    own = {c: None if pd.isna(v) else v.item() if hasattr(v, "item") else v for c, v in r.items() if c != time}
                    held["rows"].append([at // 1000, own])
        ready = [r for r in held["rows"] if r[0] <= mark * 1000]
        held["rows"] = [r for r in held["rows"] if r[0] > mark * 1000]
        made: list[dict] = []
        for us, r in sorted(ready, key=lambda r: (r[0], [str(type(r[1][t])) for t in ties], [r[1][t] for t in ties])):
            now = held["fold"]
            if now is not None and fold.ends(now) < us // 1000:
                made += fold.close(now)
                now = None
            held["fold"], rows_ = fold.add(now, us // 1000, r | {time: us})
            made += rows_
        if held["fold"] is not None and fold.ends(held["fold"]) < mark:
            made += fold.close(held["fold"])
            held["fold"] = None
        if held["fold"] is None and not held["rows"]:
            if state.exists:
                state.remove()
        else:
            state.update((json.dumps(held),))
            due = [r[0] // 1000 for r in held["rows"]] + ([fold.ends(held["fold"])] if held["fold"] is not None else [])
            state.setTimeoutTimestamp(max(min(due), mark + 1))
        if made:
            pdf = pd.DataFrame(made)
            pdf.insert(0, key, name[0])
            for c in times:
                pdf[c] = pd.to_datetime(pdf[c], unit="us")
            yield pdf[columns]

    from pyspark.sql.types import StructType, TimestampType

    shape = StructType.fromDDL(out)
    columns, times = shape.names, [f.name for f in shape if isinstance(f.dataType, TimestampType)]
    return rows.withWatermark(time, late).groupBy(key).applyInPandasWithState(step, out, "held string", "append", "EventTimeTimeout")


class PolicyFold(Fold):
    def add(self, state, at, row):
        status, reason = next_status(state["status"] if state else "active", json.loads(row["m"]))
        return {"status": status, "at": at}, [{"generated_at": row["generated_at"], "status": status, "reason": reason}]


def stream_policy(metrics: DataFrame, late: str = "1 day") -> DataFrame:
    """The policy's transitions over a stream of (source, generated_at, m): m holds the window metrics of a run as JSON, as the batch job
    makes them. Runs that come late, but within `late`, take their place in time; a source without runs for 35 days starts anew."""
    return in_order(metrics.select("source", "generated_at", "m"), "source", "generated_at", late, PolicyFold(), "source string, generated_at timestamp, status string, reason string")


class HealthFold(Fold):
    def __init__(self, grace: int) -> None:
        self.grace = grace

    def add(self, state, at, row):
        failures, success, before = (state["failures"], state["success"], state["before"]) if state else (0, None, None)
        own = "failed" if not row["ok"] else "healthy" if (row["item_count"] or 0) > 0 else "empty"
        failures = failures + 1 if own == "failed" else 0
        success = row["fetched_at"] if own == "healthy" else success
        before = own if own != "failed" else before
        kept = before if own == "failed" and failures <= self.grace and before else own
        state = {"failures": failures, "success": success, "before": before, "at": at}
        return state, [{"fetched_at": row["fetched_at"], "status": kept, "failure_count": failures, "last_success_at": success}]


def stream_health(results: DataFrame, grace: int = 0, late: str = "1 hour") -> DataFrame:
    """Health of each result of a stream (source, fetched_at, ok, item_count, perhaps attempt_id) in time order a source, as source_health gives it
    over a table: status, failure_count, last_success_at. A source without results for 35 days starts anew."""
    ties = tuple(c for c in ("attempt_id",) if c in results.columns)
    out = "source string, fetched_at timestamp, status string, failure_count long, last_success_at timestamp"
    return in_order(results.select("source", "fetched_at", "ok", "item_count", *ties), "source", "fetched_at", late, HealthFold(grace), out, ties)


class SessionFold(Fold):
    def __init__(self, gap_ms: int) -> None:
        self.gap = gap_ms

    def add(self, state, at, row):
        state = state or {"start": row["fetched_at"], "last": {}}
        state["last"][row["source"]] = [row["attempt_id"], row["fetched_at"]]
        return state | {"at": at}, []

    def ends(self, state):
        return state["at"] + self.gap

    def close(self, state):
        return [{"session_start": state["start"], "source": s, "attempt_id": i, "fetched_at": t} for s, (i, t) in state["last"].items()]


def stream_sessions(attempts: DataFrame, minutes: int = 30, late: str = "1 hour") -> DataFrame:
    """fetch_sessions over a stream of (stream, source, attempt_id, fetched_at): attempts no more than `minutes` apart, of whatever sources, are one
    session, and it gives the last attempt of each source once the watermark has passed its end. State is one row a source of the open session."""
    rows = attempts.select("stream", "source", "attempt_id", "fetched_at")
    return in_order(rows, "stream", "fetched_at", late, SessionFold(minutes * 60_000), "stream string, session_start timestamp, source string, attempt_id long, fetched_at timestamp", ("attempt_id",))


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Takes what has landed and ends."""
    df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()
