"""Source audit: funnels, sessions, health, rolling quality and the throttling policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from . import scan

DAY = 86_400_000
STAGES = ("normalized", "filtered", "deduped", "scored", "candidates", "reviewed")


def source_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("source").agg(F.count("*").alias("items"), F.max("published_at").alias("newest_published_at"))


def stage_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """One row a run and source, a column a stage: all stages in one union, so one shuffle of counts."""
    parts = [df.select("run_id", "source", F.lit(name).alias("stage")) for name, df in stages.items()]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy("run_id", "source").agg(*[F.count_if(F.col("stage") == s).alias(s) for s in stages])


def rate(part: Column, total: Column) -> Column:
    return F.coalesce(T.half_up(F.try_divide(part, total), 4), F.lit(0.0))


def source_audit(raw: DataFrame, stages: dict[str, DataFrame], enrichment: DataFrame, reviewed: DataFrame) -> DataFrame:
    """The funnel of each run and source. raw (run_id, source, item_count), enrichment (run_id, source, attempted, failed), reviewed with
    content_density."""
    fetched = raw.groupBy("run_id", "source").agg(F.sum("item_count").alias("raw_items"))
    bodies = enrichment.groupBy("run_id", "source").agg(F.sum("attempted").alias("enrichment_attempted"), F.sum("failed").alias("enrichment_failed"))
    density = reviewed.groupBy("run_id", "source").agg(F.avg(F.when(F.col("content_density") > 0, F.col("content_density"))).alias("density"))
    keys = ["run_id", "source"]
    df = fetched.join(stage_counts(stages), keys, "full").join(bodies, keys, "left").join(density, keys, "left")
    n = lambda c: F.coalesce(F.col(c) if c in df.columns else F.lit(0), F.lit(0))
    total = F.when(n("raw_items") > 0, n("raw_items")).otherwise(n("normalized"))
    return df.select(
        *keys, total.alias("fetched_count"), n("normalized").alias("normalized_items"), (n("normalized") - n("filtered")).alias("filtered_out_items"), (n("filtered") - n("deduped")).alias("deduplicated_items"), n("scored").alias("retained_items"), n("reviewed").alias("reviewed_items"),
        rate(n("scored"), total).alias("pass_rate"), rate(F.greatest(F.lit(0), n("filtered") - n("deduped")), total).alias("duplicate_rate"), rate(n("candidates"), total).alias("high_value_rate"), n("enrichment_attempted").alias("enrichment_attempted"),
        T.half_up(F.try_divide(n("enrichment_attempted") - n("enrichment_failed"), n("enrichment_attempted")), 4).alias("body_success_rate"), F.coalesce(T.half_up(F.col("density"), 2), F.lit(0.0)).alias("average_density"),
    )


def funnel_rollup(audit: DataFrame) -> DataFrame:
    """Totals by run and source, by run, and in all."""
    sums = ("fetched_count", "normalized_items", "filtered_out_items", "deduplicated_items", "retained_items", "enrichment_attempted")
    return audit.rollup("run_id", "source").agg(F.grouping_id().alias("level"), *[F.sum(c).alias(c) for c in sums])


def performance_runs(audit: DataFrame, attempts: DataFrame) -> DataFrame:
    """The record of each attempt (run_id, source, generated_at, item_count, ok, is_probe), with counts bounded by what was fetched."""
    df = attempts.join(audit, ["run_id", "source"], "left")
    n = lambda c: F.greatest(F.lit(0), F.coalesce(F.col(c), F.lit(0)))
    got = n("item_count")
    upto = lambda c: F.least(got, c)
    tries = F.when(got > 0, n("enrichment_attempted")).otherwise(0)
    seen = F.when(got > 0, n("reviewed_items")).otherwise(0)
    high = upto(T.half_up(n("high_value_rate") * n("fetched_count")).cast("long"))
    good = F.least(tries, T.half_up(F.coalesce("body_success_rate", F.lit(0.0)) * tries).cast("long"))
    return df.select(
        "run_id", "source", "generated_at", got.alias("fetched_count"), upto(n("retained_items")).alias("passed_count"), upto(n("deduplicated_items")).alias("duplicate_count"), high.alias("high_value_count"), tries.alias("body_attempt_count"), good.alias("body_success_count"),
        (F.coalesce("average_density", F.lit(0.0)) * seen).alias("density_total"), seen.alias("density_count"), (~F.coalesce("ok", F.lit(False))).alias("fetch_failed"), F.coalesce("is_probe", F.lit(False)).alias("is_probe"),
        F.coalesce(F.try_divide(high, got), F.lit(0.0)).alias("high_value_rate"), F.try_divide(good, tries).alias("body_success_rate"),
    )


def record_runs(history: DataFrame, runs: DataFrame, audited: DataFrame, now: str, days: int = 35) -> DataFrame:
    """History with the runs of attempts newer than the source's last audited fetch, cut to the last `days` days."""
    fresh = runs.join(audited.select("source", "last_audited_fetch_at"), "source", "left").where(F.col("last_audited_fetch_at").isNull() | (F.col("fetched_at") > F.col("last_audited_fetch_at"))).drop("last_audited_fetch_at")
    new = fresh.join(history.select("source", "generated_at"), ["source", "generated_at"], "left_anti")
    return history.unionByName(new, allowMissingColumns=True).where(F.col("generated_at") >= F.lit(now).cast("timestamp") - F.expr(f"interval {days} days"))


SUMS = ("fetched_count", "passed_count", "duplicate_count", "high_value_count", "body_attempt_count", "body_success_count", "density_total", "density_count")


def _summary(total) -> list[Column]:
    """Rates of a set of runs; `total` gives the sum of a column over it."""
    f = total("fetched_count")
    return [
        F.coalesce(f, F.lit(0)).alias("metadata_count"), rate(total("passed_count"), f).alias("pass_rate"), rate(total("duplicate_count"), f).alias("duplicate_rate"), rate(total("high_value_count"), f).alias("high_value_rate"),
        T.half_up(F.try_divide(total("body_success_count"), total("body_attempt_count")), 4).alias("body_success_rate"), F.coalesce(T.half_up(F.try_divide(total("density_total"), total("density_count")), 2), F.lit(0.0)).alias("average_density"),
    ]


def summarize_runs(runs: DataFrame, *keys: str) -> DataFrame:
    return runs.groupBy(*(keys or ("source",))).agg(F.count("*").alias("run_count"), *_summary(lambda c: F.sum(c)))


def rolling_source_metrics(runs: DataFrame) -> DataFrame:
    """At each run of a source: summaries of the last 7, 14 and 30 days (d7, d14, d30), of the 14 days before (p14: over 14, at most 28
    days old), whether the last five runs all failed, and probes that went well among the last three. All windows share one sort."""
    ms = F.unix_millis("generated_at")
    df = runs.withColumn("__ms", ms)
    by = W.partitionBy("source").orderBy("__ms")
    out = df
    for name, w in {"d7": by.rangeBetween(-7 * DAY, 0), "d14": by.rangeBetween(-14 * DAY, 0), "d30": by.rangeBetween(-30 * DAY, 0), "p14": by.rangeBetween(-28 * DAY, -14 * DAY - 1)}.items():
        out = out.withColumn(name, F.struct(F.count(F.lit(1)).over(w).alias("run_count"), *_summary(lambda c, w=w: F.sum(c).over(w))))
    five = by.rowsBetween(-4, 0)
    out = out.withColumn("five_failed", (F.count(F.lit(1)).over(five) == 5) & F.bool_and("fetch_failed").over(five))
    good = (F.coalesce("high_value_rate", F.lit(0.0)) >= 0.1) | F.coalesce(F.col("body_success_rate") >= 0.6, F.lit(False))
    upto = by.rowsBetween(W.unboundedPreceding, 0)
    # A probe's two probes before it come from a window over probes alone; other runs take what the last probe saw.
    probes = W.partitionBy("source", "is_probe").orderBy("__ms")
    before = [F.lag(good, i).over(probes) for i in (1, 2)]
    out = out.withColumn("__p", F.when(F.col("is_probe"), good & F.coalesce(before[0], F.lit(False)) & F.coalesce(before[1], F.lit(False))))
    out = out.withColumn("probes_good", F.coalesce(F.last("__p", ignorenulls=True).over(upto), F.lit(False)))
    return out.drop("__p", "__ms")


def next_status(status: str, m: dict) -> tuple[str, str]:
    """One transition of a source's policy from the metrics of a run."""
    status = status if status in ("active", "reduced", "limited", "paused") else "active"
    if status == "paused":
        return ("limited", "three-successful-probes") if m["probes_good"] else ("paused", "")
    d14, d30, p14 = m["d14"], m["d30"], m["p14"]
    if d14["run_count"] < 5 or d14["metadata_count"] < 30:
        return status, "minimum-sample-not-met"
    if status == "active" and (d14["high_value_rate"] < 0.1 or d14["duplicate_rate"] > 0.7):
        return "reduced", "14d-low-high-value-rate" if d14["high_value_rate"] < 0.1 else "14d-high-duplicate-rate"
    if status == "reduced" and p14["run_count"] > 0 and ((d14["high_value_rate"] < 0.05 and p14["high_value_rate"] < 0.05) or d14["duplicate_rate"] > 0.85):
        return "limited", "two-window-low-value-or-duplicate"
    body = d30["body_success_rate"]
    if status == "limited" and (d30["high_value_rate"] < 0.02 or (body is not None and body == body and body < 0.2) or m["five_failed"]):
        return "paused", "five-consecutive-fetch-failures" if m["five_failed"] else "30d-source-quality"
    return status, "thresholds-not-triggered"


def source_policy(runs: DataFrame) -> DataFrame:
    """(source, generated_at, status, reason) at each run: a fold over a source's runs in time order, of metrics that windows have made.
    A group is one source's runs, two columns wide: a few runs a day."""
    m = rolling_source_metrics(runs).select("source", "generated_at", F.to_json(F.struct("d14", "d30", "p14", "five_failed", "probes_good"), {"ignoreNullFields": "false"}).alias("m"))

    def fold(pdf):
        import json

        pdf = pdf.sort_values("generated_at")
        status, out = "active", []
        for text in pdf["m"]:
            status, reason = next_status(status, json.loads(text))
            out.append((status, reason))
        return pdf[["source", "generated_at"]].assign(status=[s for s, _ in out], reason=[r for _, r in out])

    return m.groupBy("source").applyInPandas(fold, "source string, generated_at timestamp, status string, reason string")


def policy_limits(df: DataFrame) -> DataFrame:
    """Adds the limits of a status to rows with the configured ones."""
    base = lambda c, d: F.coalesce(T.column_or(df, c, None, "int"), F.lit(d))
    meta, body, gap = base("metadata_limit", 30), base("body_fetch_quota", 3), base("minimum_fetch_interval_hours", 6)
    s = F.col("status")
    half = lambda c: F.greatest(F.lit(1), F.ceil(c / 2)).cast("int")
    low = s.isin("limited", "paused")
    return df.withColumns({
        "metadata_limit": F.when(s == "reduced", half(meta)).when(low, F.least(meta, F.lit(5))).otherwise(meta),
        "body_fetch_quota": F.when(s == "reduced", half(body)).when(low, 1).otherwise(body),
        "minimum_fetch_interval_hours": F.when(s == "reduced", gap * 2).when(s == "limited", gap * 4).when(s == "paused", 168).otherwise(gap),
    })


def in_time(df: DataFrame) -> list[str]:
    """The order of attempts: their time, and of equal times their attempt_id where there is one."""
    return ["fetched_at", *[c for c in ("attempt_id",) if c in df.columns]]


def fetch_sessions(attempts: DataFrame, minutes: int = 30) -> DataFrame:
    """Runs of attempts no more than `minutes` apart (exactly that still joins), and in each the last attempt of every source. Adds
    session (from 1 in each stream) and session_start. A stream's attempts are scanned in chunks of time (see scan)."""
    keys, order = ["stream"], in_time(attempts)
    df = scan.last_values(scan.chunked(attempts, keys, order), keys, order, {"__last": F.col("fetched_at")}, inclusive=False)
    gap = F.unix_millis("fetched_at") - F.unix_millis("__last")
    df = df.withColumn("__new", (gap.isNull() | (gap > minutes * 60_000)).cast("int"))
    df = scan.running_sums(df, keys, order, {"session": F.col("__new")})
    one = F.struct(*attempts.columns)
    last = df.groupBy("stream", "session", "source").agg(F.max_by(one, F.struct(*order)).alias("x"))
    starts = df.groupBy("stream", "session").agg(F.min("fetched_at").alias("session_start"))
    return last.select("session", "x.*").join(starts, ["stream", "session"])


def source_health(results: DataFrame, grace: int = 0) -> DataFrame:
    """Adds status, failure_count and last_success_at to fetch results in time order a source.

    healthy: ok with items; empty: ok without; failed. failure_count counts failures since the last ok result: all so far less all at that
    result. With `grace`, up to so many failures keep the status of that result. A source's results are scanned in chunks (see scan)."""
    ok, healthy = F.coalesce("ok", F.lit(False)), F.coalesce("ok", F.lit(False)) & (F.coalesce("item_count", F.lit(0)) > 0)
    keys, order = ["source"], in_time(results)
    df = scan.chunked(results.withColumn("__own", F.when(healthy, "healthy").when(ok, "empty").otherwise("failed")), keys, order)
    df = scan.running_sums(df, keys, order, {"__failed": (F.col("__own") == "failed").cast("int")})
    fine = F.col("__own") != "failed"
    df = scan.last_values(df, keys, order, {"__then": F.when(fine, F.col("__failed")), "last_success_at": F.when(F.col("__own") == "healthy", F.col("fetched_at")), "__before": F.when(fine, F.col("__own"))})
    df = df.withColumn("failure_count", F.col("__failed") - F.coalesce("__then", F.lit(0)))
    keep = (F.col("__own") == "failed") & (F.col("failure_count") <= grace) & F.col("__before").isNotNull()
    return df.withColumn("status", F.when(keep, F.col("__before")).otherwise(F.col("__own"))).drop("__own", "__failed", "__then", "__before", scan.CHUNK)


def merge_health(previous: DataFrame, current: DataFrame, active: DataFrame) -> DataFrame:
    """Current rows, and earlier ones of active sources that are not among them."""
    kept = previous.join(current.select("source"), "source", "left_anti").join(active.select("source"), "source", "left_semi")
    return kept.unionByName(current, allowMissingColumns=True)


def health_summary(health: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s)
    return health.agg(F.count("*").alias("sources"), n("healthy").alias("healthy"), n("empty").alias("empty"), n("failed").alias("failed"), F.max("fetched_at").alias("last_checked_at")).withColumn("warning", F.col("failed") > 0)


def effective_records(records: DataFrame) -> DataFrame:
    """Each fetch with the items that stand for it: its own if ok (even none), else those of the source's last ok fetch that had any; adds
    effective_fetched_at, effective_count and stale. A source's fetches are scanned in chunks (see scan)."""
    ok, order = F.coalesce("ok", F.lit(False)), in_time(records)
    kept = F.struct("fetched_at", "item_count")
    df = scan.last_values(scan.chunked(records, ["source"], order), ["source"], order, {"__last": F.when(ok & (F.col("item_count") > 0), kept)}, inclusive=False)
    back = ~ok & F.col("__last").isNotNull()
    return df.withColumns({"effective_fetched_at": F.when(back, F.col("__last.fetched_at")).otherwise(F.col("fetched_at")), "effective_count": F.when(back, F.col("__last.item_count")).when(ok, F.col("item_count")).otherwise(0), "stale": back}).drop("__last", scan.CHUNK)


def limit_newest(items: DataFrame, max_items: int = 15, max_age_hours: float = 48) -> DataFrame:
    """The newest items of each run and source within the age limit; a source's own max_items and max_age_hours may only lower them."""
    cap = lambda c, most: F.when((F.coalesce(T.column_or(items, c, None, "double"), F.lit(0.0)) > 0), F.least(F.col(c) if c in items.columns else F.lit(most), F.lit(most))).otherwise(most)
    time = F.coalesce("published_at", "fetched_at")
    age = (F.unix_micros("fetched_at") - F.unix_micros(time)) / F.lit(3.6e9)
    df = items.where(age <= cap("max_age_hours", max_age_hours)).withColumn("__r", F.row_number().over(W.partitionBy("run_id", "source").orderBy(time.desc(), F.asc("ord")))).where(F.col("__r") <= max_items)
    return df.where(F.col("__r") <= cap("max_items", max_items)).drop("__r")


def effective_sources(sources: DataFrame, policy: DataFrame, now: str) -> DataFrame:
    """Sources with their policy (source, status, reason, next_probe_at, last_fetched_at and the limits it sets): tier, limits and quotas
    (the policy's, else the source's own, else defaults by tier), whether a probe is due, and whether fetching is on. Zero counts as unset.
    Both are dimensions with a row a source."""
    from .candidates import policy_tier

    t = F.lit(now).cast("timestamp")
    have = lambda df, c, k="int": T.column_or(df, c, None, k)
    limits = ("metadata_limit", "body_fetch_quota", "minimum_fetch_interval_hours")
    p = policy.select("source", "status", have(policy, "reason", "string").alias("__reason"), "next_probe_at", "last_fetched_at", *[have(policy, c).alias(f"__{c}") for c in limits])
    df = sources.withColumn("source_policy_tier", policy_tier(sources)).join(p, "source", "left")
    set_ = lambda c: F.when(c != 0, c)
    own = {c: [set_(F.col(f"__{c}")), set_(have(sources, c))] for c in limits}
    quota = T.lookup({"core": 5, "standard": 3, "experimental": 1}, F.col("source_policy_tier"), 1)
    due = F.coalesce(F.col("next_probe_at") <= t, F.lit(True))
    enabled = F.coalesce("enabled", F.lit(True))
    paused = enabled & F.coalesce(F.col("status") == "paused", F.lit(False)) & ~due
    gap = F.coalesce(*own["minimum_fetch_interval_hours"], F.lit(6))
    following = F.timestamp_add("HOUR", gap, F.col("last_fetched_at"))
    return df.withColumns({
        "runtime_status": F.coalesce("status", F.lit("active")), "runtime_reason": F.coalesce("__reason", F.lit("")), "probe_due": due, "next_eligible_fetch_at": following,
        "runtime_fetch_enabled": enabled & ~paused & ~F.coalesce(following > t, F.lit(False)), "metadata_limit": F.coalesce(*own["metadata_limit"], set_(have(sources, "max_items")), F.lit(30)),
        "body_fetch_quota": F.coalesce(*own["body_fetch_quota"], quota), "minimum_fetch_interval_hours": gap,
    }).drop("status", *[f"__{c}" for c in ("reason", *limits)])


def enrichment_stats(items: DataFrame) -> DataFrame:
    """Attempts, excerpts, images, failures and skips by source, and in all (source null)."""
    s = F.col("body_fetch_status")
    return items.rollup("source").agg(F.count_if(s.isin("success", "failed")).alias("attempted"), F.count_if((s == "success") & (F.length("content_excerpt") > 0)).alias("excerpt_count"), F.count_if((s == "success") & (F.length("image_url") > 0)).alias("image_count"), F.count_if(s == "failed").alias("failed"), F.count_if(s == "disabled").alias("skipped"))
