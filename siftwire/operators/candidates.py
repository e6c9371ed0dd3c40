"""Event types, candidate value, quota-bound selection."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from .classify import metadata_category
from .dedupe import assign_event_clusters
from .matching import best_match
from .storage import deleted, stored


@dataclass(frozen=True)
class SelectionRules:
    candidate_threshold: int = 60
    global_quota: int = 36
    category_quota: int = 8
    event_type_quota: int = 5
    cluster_quota: int = 3
    tier_quotas: dict = field(default_factory=lambda: {"core": 5, "standard": 3, "experimental": 1})
    blocked_patterns: tuple[str, ...] = fixed.BLOCKED_PATTERNS
    event_types: tuple = fixed.EVENT_TYPES


def policy_tier(df: DataFrame) -> Column:
    """core, standard or experimental: a given one, else by tier, authority and credibility."""
    explicit, tier = F.lower(T.clean_text(T.column_or(df, "source_policy_tier", None, "string"))), F.upper(T.clean_text(F.col("source_tier")))
    authority = F.coalesce("source_authority", F.lit(""))
    return (
        F.when(explicit.isin("core", "standard", "experimental"), explicit)
        .when((tier == "S") | authority.isin("official-agency", "official-market"), "core")
        .when(tier.isin("A", "B") | (authority == "official-media") | (F.coalesce("credibility", F.lit(0.0)) >= 80), "standard")
        .otherwise("experimental")
    )


def event_type(text: Column, rules=fixed.EVENT_TYPES) -> Column:
    return T.first_rule(text, rules, "other")


def has_fact(text: Column) -> Column:
    return T.hits(text, fixed.VERIFIABLE_FACTS)


def completeness(df: DataFrame, fact: Column) -> Column:
    summary = T.clean_text(T.first_filled(F.col("summary"), T.column_or(df, "content_excerpt", None, "string"), F.lit("")))
    dated = F.col("published_at").isNotNull() & ~F.coalesce(T.column_or(df, "published_at_inferred", False, "boolean"), F.lit(False))
    points = lambda c, n: F.when(c, n).otherwise(0)
    return points(F.length(T.clean_text(F.col("title"))) >= 12, 4) + points(F.length(summary) >= 50, 4) + points(fact, 4) + points(dated, 3)


def topic_relevance(text: Column, kind: Column, fact: Column) -> Column:
    return F.least(F.lit(20), F.when(kind.isin(*fixed.PRIORITY_EVENT_TYPES), 14).otherwise(7) + F.when(T.hits(text, fixed.TOPIC_WORDS), 4).otherwise(0) + F.when(fact, 2).otherwise(0))


def gain(similarity: Column) -> Column:
    return F.greatest(F.lit(0), T.half_up(F.lit(20) * (1 - similarity)).cast("int"))


def information_gain(items: DataFrame, recent: DataFrame) -> DataFrame:
    """(run_id, ord, information_gain): 20 * (1 - best title similarity to the run's recent items of other ids), rounded; 16 in a run
    without recent items. See best_match."""
    tokens = T.title_tokens(F.col("title"))
    mine = items.select("run_id", F.col("ord").alias("node"), "id", tokens.alias("tokens"))
    best = best_match(mine, recent.select("run_id", "id", tokens.alias("tokens")), ["run_id"])
    some = recent.select("run_id").distinct().withColumn("some", F.lit(True))
    out = items.select("run_id", "ord").join(best.withColumnRenamed("node", "ord"), ["run_id", "ord"], "left").join(some, "run_id", "left")
    return out.select("run_id", "ord", F.when(F.col("some"), gain(F.coalesce("best", F.lit(0.0)))).otherwise(16).alias("information_gain"))


def candidate_values(items: DataFrame, recent: DataFrame, rules: SelectionRules = SelectionRules()) -> DataFrame:  # noqa: B008
    """Adds event_type, source_policy_tier, candidate_category, has_fact, information_gain and candidate_value (0 to 100)."""
    df = items.withColumn("__text", T.item_text(items))
    df = df.withColumn("event_type", event_type(F.col("__text"), rules.event_types)).withColumn("source_policy_tier", policy_tier(items)).withColumn("has_fact", has_fact(F.col("__text")))
    df = metadata_category(df, "candidate_category").join(information_gain(items, recent), ["run_id", "ord"])
    kind, fact = F.col("event_type"), F.col("has_fact")
    authority = T.lookup({"core": 20, "standard": 14, "experimental": 7}, F.col("source_policy_tier"), 7)
    typed = F.when(kind.isin(*fixed.PRIORITY_EVENT_TYPES), 25).when(kind == "company_update", 11).when(kind == "commentary", 6).otherwise(8)
    blocked = F.exists(F.array(*[F.lit(p.lower()) for p in rules.blocked_patterns]), lambda p: F.contains(F.lower("__text"), p))
    value = authority + typed + topic_relevance(F.col("__text"), kind, fact) + F.col("information_gain") + completeness(df, fact)
    value = value - F.when(blocked | (kind == "promotion"), 60).otherwise(0) - F.when(kind.isin("commentary", "company_update") & ~fact, 25).otherwise(0)
    return df.withColumn("candidate_value", F.greatest(F.lit(0), F.least(F.lit(100), value)).cast("int")).drop("__text")


#: What a taken item adds to its run's state.
TAKEN = "array<struct<k:string,category:string,kind:string,cluster:string,bonus:int,seconds:double,past:array<int>,ord:bigint>>"


def frontier(pdf, taken: list[dict], rules: SelectionRules, critical: tuple[str, ...], whole: bool):
    """Goes on with one run's greedy selection over its best open items, `pdf`, and the items it has taken so far. Returns what it takes in
    order and whether the run is done.

    An item loses value only, and a refused one stays refused. So the next item is the best allowed one here as long as it is better than
    the worst of `pdf` was when `pdf` was cut; where `pdf` holds all open items (`whole`), it is right to the end. Of equal value and time
    the one that was ahead before an item was last taken stays ahead: `past` has an item's values in all earlier states, the last first."""
    rows = pdf.to_dict("records")
    sources: dict = {}
    categories: dict = {}
    kinds: dict = {}
    clusters: dict = {}

    def add(r: dict) -> None:
        sources[r["k"]] = sources.get(r["k"], 0) + 1
        categories[r["category"]] = categories.get(r["category"], 0) + 1
        kinds[r["kind"]] = kinds.get(r["kind"], 0) + 1
        clusters.setdefault(r["cluster"], set()).add(r["k"])

    def bonus(r: dict) -> int:
        return r["value"] - 3 * sources.get(r["k"], 0) - 2 * len(clusters.get(r["cluster"], ()))

    def rank(r: dict) -> tuple:
        return (-bonus(r), -r["seconds"], [-int(x) for x in r["past"]], r["ord"])

    def allowed(r: dict) -> bool:
        held = clusters.get(r["cluster"], set())
        return (
            sources.get(r["k"], 0) < r["quota"] and categories.get(r["category"], 0) < rules.category_quota and (r["kind"] in critical or kinds.get(r["kind"], 0) < rules.event_type_quota)
            and (r["k"] in held or len(held) < rules.cluster_quota)
        )

    for t in taken:
        add(t)
    limit = None if whole or not rows else max(map(rank, rows))[:2]
    new: list[dict] = []
    while len(taken) + len(new) < rules.global_quota:
        rows = [r for r in rows if allowed(r)]
        best = min(rows, key=rank, default=None)
        if best is None or (limit is not None and new and rank(best)[:2] >= limit):
            return new, best is None and whole
        new.append({"bonus": bonus(best), **{c: best[c] for c in ("k", "category", "kind", "cluster", "seconds", "past", "ord")}})
        rows.remove(best)
        before = [bonus(r) for r in rows]
        add(best)
        for r, b in zip(rows, before, strict=True):
            r["past"] = [b, *r["past"]]
    return new, True


def state_at(item: dict[str, Column], taken: Column, rules: SelectionRules, critical: tuple[str, ...]) -> Column:
    """struct(reason, bonus, past): follows the item through its run's taken items. reason is the quota that refuses it when its turn comes, before
    an item that is taken, or null; `selected` for a taken item itself. bonus is its value at the end, past those before, the last first."""
    none = F.array().cast("array<string>")
    start = F.struct(F.lit(None).cast("string").alias("reason"), F.lit(0).alias("s"), F.lit(0).alias("c"), F.lit(0).alias("t"), none.alias("m"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("past"))

    def refused(a: Column) -> Column:
        own = F.array_contains(a["m"], item["k"])
        return (
            F.when(a["n"] >= rules.global_quota, "global-quota").when(a["s"] >= item["quota"], "source-quota").when(a["c"] >= rules.category_quota, "category-quota")
            .when(~item["kind"].isin(*critical) & (a["t"] >= rules.event_type_quota), "event-type-quota").when(~own & (F.size(a["m"]) >= rules.cluster_quota), "event-cluster-quota")
        )

    def bonus(a: Column) -> Column:
        return (item["value"] - 3 * a["s"] - 2 * F.size(a["m"])).cast("int")

    def step(a: Column, x: Column) -> Column:
        b = bonus(a)
        tie = (a["past"] > x["past"]) | ((a["past"] == x["past"]) & (item["ord"] < x["ord"]))
        before = (b > x["bonus"]) | ((b == x["bonus"]) & ((item["seconds"] > x["seconds"]) | ((item["seconds"] == x["seconds"]) & tie)))
        reason = F.when(x["ord"] == item["ord"], "selected").when(before, refused(a))
        one = lambda c: F.when(c, 1).otherwise(0)
        members = F.when((x["cluster"] == item["cluster"]) & ~F.array_contains(a["m"], x["k"]), F.concat(a["m"], F.array(x["k"]))).otherwise(a["m"])
        return F.struct(
            F.coalesce(a["reason"], reason).alias("reason"), (a["s"] + one(x["k"] == item["k"])).alias("s"), (a["c"] + one(x["category"] == item["category"])).alias("c"), (a["t"] + one(x["kind"] == item["kind"])).alias("t"),
            members.alias("m"), (a["n"] + 1).alias("n"), F.concat(F.array(b), a["past"]).alias("past"),
        )

    return F.aggregate(taken, start, step, lambda a: F.struct(F.coalesce(a["reason"], refused(a)).alias("reason"), bonus(a).alias("bonus"), a["past"].alias("past")))


def selection(rest: DataFrame, rules: SelectionRules, critical: tuple[str, ...], width: int | None = None) -> DataFrame:
    """(run_id, ord, reason) of `rest` (run_id, ord, value, seconds, k, category, kind, cluster, quota), stored: each run's greedy selection under
    quotas; reason is `selected` or the quota that refuses the item.

    Rounds: of each run's open items, those that what is taken so far does not refuse, the `width` best (8 times the global quota) go to
    one small group, which takes as many as these decide (see frontier). A run needs a few rounds, one an item at most. Then each item
    follows the at most `global_quota` taken ones by itself (see state_at), so no task holds a run."""
    spark, width = rest.sparkSession, width or 8 * rules.global_quota
    item = {c: F.col(c) for c in ("ord", "value", "seconds", "k", "category", "kind", "cluster", "quota")}
    run = rest.schema["run_id"].dataType.simpleString()
    state = stored(rest.select("run_id").distinct().select("run_id", F.array().cast(TAKEN).alias("taken"), F.lit(False).alias("done")))
    shape = f"run_id {run}, taken {TAKEN}, done boolean"
    columns = ["run_id", "ord", "value", "seconds", "k", "category", "kind", "cluster", "quota"]

    def go_on(key, pdf):
        import pandas as pd

        held = pdf[pdf["ord"].isna()]
        before = [dict(zip(r.keys(), r.values(), strict=True)) for r in (held["taken"].iloc[0] if len(held) else [])]
        rows = pdf[pdf["ord"].notna()].astype({c: "int64" for c in ("ord", "value", "quota")})
        new, done = frontier(rows[[*columns[1:], "past"]], before, rules, critical, len(rows) < width)
        return pd.DataFrame({"run_id": [key[0]], "taken": [before + new], "done": [done]})

    for _ in range(rules.global_quota + 1):
        going = state.where(~F.col("done"))
        if going.isEmpty():
            break
        near = rest.join(going.select("run_id", "taken"), "run_id")
        seen = near.withColumn("z", state_at(item, F.col("taken"), rules, critical)).where(F.col("z.reason").isNull())
        best = W.partitionBy("run_id").orderBy(F.desc("z.bonus"), F.desc("seconds"), F.desc("z.past"), "ord")
        top = seen.withColumn("r", F.row_number().over(best)).where(F.col("r") <= width).select(*columns, F.col("z.past").alias("past"), F.lit(None).cast(TAKEN).alias("taken"))
        states = going.select("run_id", *[F.lit(None).cast(rest.schema[c].dataType).alias(c) for c in columns[1:]], F.lit(None).cast("array<int>").alias("past"), "taken")
        new = top.unionByName(states).groupBy("run_id").applyInPandas(go_on, shape)
        after = stored(state.where("done").unionByName(new))
        deleted(state)
        state = after
    ends = rest.join(state.select("run_id", "taken"), "run_id")
    return ends.select("run_id", "ord", state_at(item, F.col("taken"), rules, critical)["reason"].alias("reason"))


def select_candidates(items: DataFrame, recent: DataFrame, rules: SelectionRules = SelectionRules(), sources: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """Adds candidate_status and candidate_reason: each run takes the best items under quotas, an item losing 3 a selected item of its
    source and 2 a selected source of its cluster. `sources` (a row a source_id: body_fetch_quota, source_policy_tier) sets quotas and tiers.
    Items under the threshold leave first: they change no count. See selection."""
    if sources is not None:
        own = sources.select("source_id", *[F.col(c).alias(f"__{c}") for c in ("body_fetch_quota", "source_policy_tier")])
        items = items.join(own, "source_id", "left")
        for c, kind in (("body_fetch_quota", "int"), ("source_policy_tier", "string")):
            items = items.withColumn(c, F.coalesce(F.col(f"__{c}").cast(kind), T.column_or(items, c, None, kind))).drop(f"__{c}")
    df = stored(assign_event_clusters(stored(candidate_values(items, recent, rules))))
    quota = F.coalesce(F.nullif(T.column_or(df, "body_fetch_quota", None, "int"), F.lit(0)), T.lookup(rules.tier_quotas, F.col("source_policy_tier"), 1))
    key = T.first_filled(F.col("source_id"), F.col("source"), F.lit(""))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    seconds = F.coalesce(F.unix_micros("published_at") / 1e6, F.lit(0.0))
    rest = df.where(F.col("candidate_value") >= rules.candidate_threshold).select(
        "run_id", F.col("ord").cast("long").alias("ord"), F.col("candidate_value").alias("value"), seconds.alias("seconds"), key.alias("k"), text("candidate_category").alias("category"), text("event_type").alias("kind"), text("event_cluster_key").alias("cluster"),
        F.coalesce(quota, F.lit(1)).cast("int").alias("quota"),
    )
    reason = selection(stored(rest), rules, fixed.CRITICAL_EVENT_TYPES)
    out = df.join(reason.withColumnRenamed("reason", "__why"), ["run_id", "ord"], "left")
    why = F.col("__why")
    status = F.when(why == "selected", "selected").otherwise("rejected")
    return out.withColumn("candidate_status", status).withColumn("candidate_reason", F.when(why.isNull(), "below-candidate-threshold").when(why != "selected", why)).drop("__why")
