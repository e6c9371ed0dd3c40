"""Daily events from items, and rows around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import fixed
from ..functions import text as T
from .publish import ranking
from .storage import stored

NONE = "array<string>"


def item_entities(df: DataFrame) -> Column:
    """Entities, the subject and secondary tags; distinct, at most 8."""
    given = [F.coalesce(T.column_or(df, c, None, NONE), F.array().cast(NONE)) for c in ("entities", "secondary_tags")]
    subject = F.array(F.col("classification.factors.subject")) if "classification" in df.columns else F.array().cast(NONE)
    clean = F.filter(F.transform(F.concat(given[0], subject, given[1]), lambda x: T.clean_text(x)), lambda x: x != "")
    return F.slice(F.array_distinct(clean), 1, 8)


def event_key(df: DataFrame) -> Column:
    """The cluster, else category, type and subject or title."""
    subject = F.col("classification.factors.subject") if "classification" in df.columns else F.lit(None).cast("string")
    other = F.concat_ws("|", F.coalesce("category", F.lit("other")), F.coalesce(T.column_or(df, "event_type", None, "string"), F.lit("other")), T.first_filled(subject, F.col("title"), F.lit("")))
    return T.stable_id("", T.first_filled(T.column_or(df, "event_cluster_key", None, "string"), other))


def event_members(items: DataFrame) -> DataFrame:
    """The items with event_id and their rank (__r) in its event: whole membership as rows."""
    df = items.withColumn("event_id", F.concat(F.lit("daily-"), event_key(items)))
    return df.withColumn("__r", F.row_number().over(W.partitionBy("run_id", "event_id").orderBy(*ranking())))


def event_sources(members: DataFrame) -> DataFrame:
    """(run_id, event_id, url, o, name): each distinct address of an event, with the first rank that has it, as rows."""
    url = T.clean_text(F.coalesce(T.column_or(members, "original_url", None, "string"), F.col("url")))
    rows = members.select("run_id", "event_id", "__r", url.alias("url"), T.clean_text(F.col("source")).alias("n")).where("n <> '' and url <> ''")
    return rows.groupBy("run_id", "event_id", "url").agg(F.min("__r").alias("o"), F.max_by("n", "__r").alias("name"))


def daily_events(items: DataFrame, limit: int = 5, arrays: bool = True) -> DataFrame:
    """The 3 to 5 most important events of each run: items of a key, ranked.

    Facts (6), watch variables (6) and entities (8) come from the members in rank order. related_item_ids and supporting_sources are whole:
    only members of the chosen events are gathered, and event_members and event_sources give the same as rows. Each is one value of one row:
    where events may be huge, leave them out (`arrays`) and take these. source_count is exact: one count a distinct address."""
    keys = ["run_id", "event_id"]
    have = lambda c, k="string": T.column_or(items, c, None, k)
    facts_given = F.coalesce(have("confirmed_facts", NONE), F.array().cast(NONE))
    fallback = F.array(T.first_filled(have("what_happened"), have("ai_summary"), have("summary_zh"), have("content_excerpt"), F.col("summary")))
    facts = F.filter(F.transform(F.when(F.size(facts_given) > 0, facts_given).otherwise(fallback), lambda x: T.clean_text(x)), lambda x: x != "")
    df = event_members(items).withColumns({"__f": facts, "__e": item_entities(items), "__w": F.coalesce(have("watch_variables", NONE), F.array().cast(NONE))})
    df = stored(df)  # the lists come from it; what made it should run once
    src = event_sources(df)
    counts = src.groupBy(*keys).agg(F.count("*").alias("source_count"))
    head = df.where("__r = 1")
    identity = T.first_filled(F.array_join(F.slice("__e", 1, 2), "-"), F.col("category"), have("event_type"), F.lit("other"))
    kind = F.coalesce(have("event_type"), F.lit("other"))
    importance = T.first_filled(F.when(have("importance_score", "double") != 0, have("importance_score", "double")), F.col("score").cast("double"), F.lit(0.0))
    head = head.select(*keys, F.lower(F.concat_ws(":", F.coalesce("category", F.lit("other")), kind, identity)).alias("theme_key"), T.first_filled(have("title_zh"), have("translated_title"), F.col("title")).alias("title"), "category", kind.alias("event_type"), importance.alias("importance_score"), (F.coalesce(have("content_review_status"), F.lit("")) == "metadata-only").alias("metadata_only"))
    out = head.join(counts, keys, "left").withColumn("source_count", F.coalesce("source_count", F.lit(0)))
    order = W.partitionBy("run_id").orderBy(F.desc("importance_score"), F.desc("source_count"), "event_id")
    out = stored(out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= min(5, max(3, limit))))
    chosen = out.select(*keys)
    df, src = df.join(chosen, keys, "left_semi"), src.join(chosen, keys, "left_semi")
    # Distinct values by their first rank: at most so many rows a group are ever collected.
    def firsts(col: str, most: int, name: str) -> DataFrame:
        e = df.select(*keys, "__r", F.posexplode(col).alias("p", "v")).groupBy(*keys, "v").agg(F.min(F.struct("__r", "p")).alias("o"))
        e = e.withColumn("n", F.row_number().over(W.partitionBy(*keys).orderBy("o", "v"))).where(F.col("n") <= most)
        return e.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "v"))), lambda x: x["v"]).alias(name))

    sources = src.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("o", "url", "name"))), lambda x: F.struct(x["name"].alias("name"), x["url"].alias("url"))).alias("sources"))
    ids = df.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("__r", "id"))), lambda x: x["id"]).alias("related_item_ids"))
    if not arrays:
        named = F.struct(F.col("name"), F.col("url"))
        sources = src.groupBy(*keys).agg(F.array(F.min_by(named, F.struct("o", "url"))).alias("sources"))
    for part in (firsts("__f", 6, "confirmed_facts"), firsts("__e", 8, "entities"), firsts("__w", 6, "watch_variables"), sources, *([ids] if arrays else [])):
        out = out.join(part, keys, "left")
    gaps = F.array_compact(F.array(F.when(F.col("source_count") < 2, "single-source"), F.when(F.col("metadata_only"), "metadata-only")))
    every = F.coalesce("sources", F.array().cast("array<struct<name:string,url:string>>"))
    out = out.withColumns({"summary": F.coalesce(F.get("confirmed_facts", F.lit(0)), F.lit("")), "evidence_gaps": gaps, "primary_source": F.get("sources", F.lit(0)), "supporting_sources": F.slice(every, 2, F.greatest(F.size(every), F.lit(1)))})
    names = [c for c in out.columns if c not in ("sources", "metadata_only", "rank", *(() if arrays else ("supporting_sources",)))]
    return out.select(*names, "rank")


def infer_stage(text: Column) -> Column:
    return T.first_rule(text, fixed.STAGES, "uncertain")


def split_sentences(text: Column) -> Column:
    """In cleaned text the only white space is single blanks, and no tag is left, so parts need but their blanks trimmed."""
    parts = lambda t: F.when(t.rlike(r"[\x{3002}\x{ff01}\x{ff1f}]"), F.split(t, r"(?<=[.!?])\s+|(?<=[\x{3002}\x{ff01}\x{ff1f}])\s*")).otherwise(F.split(t, r"\x20(?<=[.!?]\x20)"))
    return F.filter(F.transform(T.let(T.clean_text(text), parts), lambda s: F.trim(s)), lambda s: s != "")


def lead_summary(text: Column, least: int = 24, limit: int = 240) -> Column:
    """The first sentence of `least` characters, else the first, cut to `limit`."""
    s = split_sentences(text)
    return T.truncate_text(F.coalesce(F.get(F.filter(s, lambda x: F.length(x) >= least), 0), F.get(s, F.lit(0)), F.lit("")), limit)


def extractive_summary(items: DataFrame) -> DataFrame:
    """Adds summary_short, summary_points (5 of up to 140 characters), key_data, confidence and tracking."""
    from .score import key_data

    text = T.clean_text(T.first_filled(T.column_or(items, "content_excerpt", None, "string"), F.col("summary"), T.column_or(items, "ai_summary", None, "string"), F.col("title"), F.lit("")))
    df = items.withColumn("__t", text).withColumn("__s", split_sentences(F.col("__t")))
    lead = F.coalesce(F.get(F.filter("__s", lambda x: F.length(x) >= 18), 0), F.get("__s", F.lit(0)), F.col("title"))
    df = df.withColumn("__lead", lead)
    rows = F.concat(F.array("__lead"), F.filter("__s", lambda x: x != F.col("__lead")))
    point = lambda x: T.clean_text(F.regexp_replace(T.truncate_text(x, 140), "(?i)" + "|".join(fixed.HYPE_TERMS), ""))
    track = T.column_or(items, "timeline_event_id", None, "string").isNotNull() | (F.coalesce(T.column_or(items, "event_relevance_score", None, "int"), F.lit(0)) >= 60)
    df = df.withColumns({"summary_short": T.truncate_text(F.col("__lead"), 90), "summary_points": T.distinct_ignoring_case(rows, 5, point), "key_data": key_data(F.col("__t")), "confidence": F.when(F.length("__t") >= 120, "medium").otherwise("low"), "tracking": F.when(track, "track").otherwise("observe")})
    return df.drop("__t", "__s", "__lead")


def article_brief(items: DataFrame) -> DataFrame:
    """(id, facts, participants, risks, watch, key_data, stage, limitations, sources by address) of each item, lists being distinct and short."""
    have = lambda c: F.coalesce(T.column_or(items, c, None, NONE), F.array().cast(NONE))
    listed = lambda a, n: F.slice(F.array_distinct(F.filter(F.transform(a, lambda x: T.clean_text(x)), lambda x: x != "")), 1, n)
    subject = F.array(F.col("classification.factors.subject")) if "classification" in items.columns else F.array().cast(NONE)
    text = T.clean_text(F.concat_ws(" ", *[T.text_or_empty(T.column_or(items, c, None, "string")) for c in ("title", "what_happened", "summary", "content_excerpt")]))
    missing = F.array_compact(F.array(*[F.when(T.text_or_empty(T.column_or(items, c, None, "string")) == "", F.lit(c)) for c in ("background", "location")], F.when(F.size(have("key_data")) == 0, "key_data")))
    facts = F.when(F.size(have("confirmed_facts")) > 0, have("confirmed_facts")).otherwise(have("summary_points"))
    items = items.withColumn("__text", T.sieved(text, [p for _, p in fixed.STAGES]))  # read by each rule, and made once
    return items.select("run_id", "id", listed(facts, 4).alias("facts"), listed(F.concat(subject, have("entities"), F.array("source")), 5).alias("participants"), listed(have("uncertainties"), 5).alias("risks"), listed(have("watch_variables"), 5).alias("watch"), listed(have("key_data"), 8).alias("key_data"), infer_stage(F.col("__text")).alias("stage"), missing.alias("limitations"), F.array(F.struct(T.clean_text(F.col("source")).alias("name"), F.col("url").alias("url"))).alias("sources"))


def grounding_check(texts: DataFrame, least: int = 0, most: int | None = None) -> DataFrame:
    """Adds ungrounded, grounded and fits to rows (output, input): numbers, addresses and, where the rows have lists output_ids and
    input_ids, ids of the output that the input lacks; fits: whether the output's length is within bounds."""
    numbers = lambda c: F.regexp_extract_all(T.text_or_empty(F.col(c)), F.lit(r"\d+(?:\.\d+)?%?"), 0)
    urls = lambda c: F.regexp_extract_all(T.text_or_empty(F.col(c)), F.lit(r"https?://[^\s)\"'<>]+"), 0)
    lost = F.concat(F.array_except(numbers("output"), numbers("input")), F.array_except(urls("output"), urls("input")))
    if {"output_ids", "input_ids"} <= set(texts.columns):
        lost = F.concat(lost, F.array_except("output_ids", "input_ids"))
    length = F.length(T.text_or_empty(F.col("output")))
    fits = (length >= least) & (F.lit(True) if most is None else length <= most)
    return texts.withColumn("ungrounded", lost).withColumn("grounded", F.size("ungrounded") == 0).withColumn("fits", fits)


def quality_flags(items: DataFrame) -> DataFrame:
    have = lambda c: F.size(F.coalesce(T.column_or(items, c, None, NONE), F.array().cast(NONE)))
    flags = F.array_compact(F.array(F.when(have("confirmed_facts") == 0, "missing-facts"), F.when(T.text_or_empty(F.col("url")) == "", "missing-link"), F.when(have("watch_variables") == 0, "missing-watch-variables"), F.when(have("counter_arguments") == 0, "missing-counter-arguments")))
    return items.withColumn("quality_flags", flags)


def source_bucket(df: DataFrame) -> Column:
    a, t = F.lower(T.text_or_empty(F.col("source_authority"))), F.upper(T.text_or_empty(F.col("source_tier")))
    return F.when(a.contains("official-agency") | a.contains("official-market") | (t == "S"), "official").when(a.contains("media") & t.isin("A", "B"), "media").when(t == "C", "opinion").otherwise("other")


def channel_coverage(feed: DataFrame) -> DataFrame:
    """Each channel's items, distinct sources and source mix, its best five ids, the ids of low score (under 65) among these, and flags:
    no item, or a single source."""
    df = feed.withColumn("bucket", source_bucket(feed))
    n = lambda b: F.count_if(F.col("bucket") == b).alias(f"n_{b}")
    agg = df.groupBy("run_id", "display_channel").agg(F.count("*").alias("items"), F.count_distinct("source").alias("sources"), *[n(b) for b in ("official", "media", "opinion", "other")], F.count_if(F.coalesce("score", F.lit(0.0)) < 65).alias("n_low_score"))
    best = df.withColumn("r", F.row_number().over(W.partitionBy("run_id", "display_channel").orderBy(*ranking()))).where("r <= 5")
    ids = lambda rows: F.transform(F.sort_array(rows), lambda x: x["id"])
    low = F.when(F.coalesce("score", F.lit(0.0)) < 65, F.struct("r", "id"))
    top = best.groupBy("run_id", "display_channel").agg(ids(F.collect_list(F.struct("r", "id"))).alias("top_ids"), ids(F.collect_list(low)).alias("low_confidence_ids"))
    flags = F.array_compact(F.array(F.when(F.col("items") == 0, "no-items"), F.when(F.col("sources") < 2, "single-source"), F.when(F.col("n_official") + F.col("n_media") == 0, "no-official-or-media")))
    return agg.join(top, ["run_id", "display_channel"]).withColumn("flags", flags)


def event_candidates(items: DataFrame, least: float = 85, limit: int = 12, arrays: bool = True) -> DataFrame:
    """The first `limit` events of each run in the order of their best items: timelines, and single items of importance `least` or more
    (else of that score), with the ids of all their items (their number, without `arrays`), priority (high from 90) and status."""
    timeline = T.column_or(items, "timeline_event_id", None, "string")
    weight = F.coalesce(F.when(T.column_or(items, "importance_score", None, "double") != 0, T.column_or(items, "importance_score", None, "double")), F.col("score"), F.lit(0.0))
    df = items.withColumn("__w", weight).withColumn("__k", F.coalesce(timeline, F.when(F.col("__w") >= least, F.concat(F.lit("candidate-"), "id")))).withColumn("__line", timeline.isNotNull()).where("__k is not null")
    df = stored(df.select("run_id", "id", "category", "score", "published_at", "__w", "__k", "__line"))
    df = df.withColumn("__r", F.row_number().over(W.partitionBy("run_id", "__k").orderBy(*ranking())))
    first = df.where("__r = 1").withColumn("rank", F.row_number().over(W.partitionBy("run_id").orderBy(*ranking()))).where(F.col("rank") <= limit)
    first = stored(first.select("run_id", F.col("__k").alias("event_key"), F.col("id").alias("lead_id"), "category", F.when(F.col("__w") >= 90, "high").otherwise("medium").alias("priority"), F.when(F.col("__line"), "linked").otherwise("to-confirm").alias("status"), "rank"))
    ids = df.withColumnRenamed("__k", "event_key").join(first.select("run_id", "event_key"), ["run_id", "event_key"], "left_semi")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("__r", "id"))), lambda x: x["id"]).alias("related_item_ids")
    ids = ids.groupBy("run_id", "event_key").agg(listed if arrays else F.count("*").alias("related_items"))
    return first.join(ids, ["run_id", "event_key"])


def event_brief_inputs(items: DataFrame, limit: int = 5) -> DataFrame:
    """Each run's best item of every event, the first `limit` of these: what a brief is written from."""
    key = F.coalesce(*[F.nullif(T.column_or(items, c, None, "string"), F.lit("")) for c in ("event_id", "timeline_event_id", "event_cluster_key", "id")])
    df = items.withColumn("brief_key", key).where("brief_key is not null")
    df = df.withColumn("__r", F.row_number().over(W.partitionBy("run_id", "brief_key").orderBy(*ranking()))).where("__r = 1").drop("__r")
    return df.withColumn("brief_rank", F.row_number().over(W.partitionBy("run_id").orderBy(*ranking()))).where(F.col("brief_rank") <= limit)


def theme_first_events(events: DataFrame, themes: list[list[str]], limit: int = 5) -> DataFrame:
    """The best event of each theme in turn (each event once), then the best of the rest: one pass a theme over all events, which are a few rows
    a run and day."""
    order = [F.desc("importance_score"), F.asc("event_id")]
    text = F.lower(F.concat_ws(" ", "event_id", "title", "summary", F.array_join(F.coalesce("entities", F.array().cast(NONE)), " ")))
    df = events.withColumn("__t", text)
    taken = None
    for i, words in enumerate(themes):
        match = df.where(F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(F.col("__t"), w)))
        if taken is not None:
            match = match.join(taken.select("run_id", "event_id"), ["run_id", "event_id"], "left_anti")
        best = match.withColumn("r", F.row_number().over(W.partitionBy("run_id").orderBy(*order))).where("r = 1").select("run_id", "event_id", F.lit(i).alias("pick"))
        taken = best if taken is None else taken.unionByName(best)
    rest = df.join(taken.select("run_id", "event_id"), ["run_id", "event_id"], "left_anti") if taken is not None else df
    rest = rest.withColumn("pick", F.lit(len(themes)) + F.row_number().over(W.partitionBy("run_id").orderBy(*order))).select("run_id", "event_id", "pick")
    every = taken.unionByName(rest) if taken is not None else rest
    ranked = every.withColumn("rank", F.row_number().over(W.partitionBy("run_id").orderBy("pick"))).where(F.col("rank") <= limit)
    return ranked.drop("pick").join(events, ["run_id", "event_id"])


def daily_brief_rows(events: DataFrame) -> DataFrame:
    """Each run's five lead events with their place, the categories they cover (3 at most), their distinct primary sources, complete rows
    of key data (8 at most), watch rows (8 at most) and those of these that name a day (4 at most), in the events' order. watch_variables are
    texts, or structs with variable and perhaps time_window, in which a day counts too."""
    place = F.row_number().over(W.partitionBy("run_id").orderBy(F.desc(F.coalesce("importance_score", F.lit(0.0))), "event_id"))
    top = stored(events.withColumn("brief_rank", place).where("brief_rank <= 5"))

    def firsts(rows: DataFrame, value: str, most: int, name: str) -> DataFrame:
        n = rows.where(F.col(value).isNotNull()).groupBy("run_id", value).agg(F.min("o").alias("o"))
        n = n.withColumn("n", F.row_number().over(W.partitionBy("run_id").orderBy("o", value))).where(F.col("n") <= most)
        return n.groupBy("run_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", value))), lambda x: x[value]).alias(name))

    order = lambda *more: F.struct("brief_rank", *more).alias("o")
    zero = F.lit(0).alias("p")
    out = top.join(firsts(top.select("run_id", order(zero), "category"), "category", 3, "categories"), "run_id", "left")
    out = out.join(firsts(top.select("run_id", order(zero), F.col("primary_source.url").alias("url")), "url", 5, "sources"), "run_id", "left")
    if "key_data" in events.columns:
        d = top.select("run_id", "brief_rank", F.posexplode("key_data").alias("p", "d"))
        full = F.forall(F.array(*[T.text_or_empty(F.col(f"d.{c}")) for c in ("metric", "value", "comparison", "meaning")]), lambda x: T.trim_ws(x) != "")
        out = out.join(firsts(d.where(full).select("run_id", order("p"), "d"), "d", 8, "brief_key_data"), "run_id", "left")
    if "watch_variables" in events.columns:
        kind = events.schema["watch_variables"].dataType.elementType
        named = F.col("w.variable") if isinstance(kind, StructType) else F.col("w")
        window = F.col("w.time_window") if isinstance(kind, StructType) and "time_window" in kind.names else F.lit("")
        w = top.select("run_id", "brief_rank", F.posexplode("watch_variables").alias("p", "w"))
        row = F.struct(T.clean_text(named).alias("variable"), T.clean_text(F.concat_ws(" ", window, named)).rlike(fixed.DATED).alias("dated"))
        w = w.select("run_id", order("p"), row.alias("w")).where("w.variable <> ''")
        out = out.join(firsts(w, "w", 8, "__w"), "run_id", "left")
        dated = F.slice(F.filter("__w", lambda x: x["dated"]), 1, 4)
        out = out.withColumns({"watch_rows": F.transform("__w", lambda x: x["variable"]), "dated_rows": F.transform(dated, lambda x: x["variable"])}).drop("__w")
    return out
