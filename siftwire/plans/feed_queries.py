"""Feeds, archives, audits, events, weekly review and search over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from ..operators import audit, candidates, dedupe, events, filters, publish, score, search, weekly
from ..operators.storage import folder, stored
from ..sources import records
from . import adapters, sql
from .adapters import EVENTS, ITEMS, NOW, RUNS, table
from .queries import CLASSED, COMPONENTS, DATES, DEDUPED, EVENTSQL, FEED, FILTERED, MANY, ONE, RULES, SCORED, SCORING, _summary_sql, classed, event_archive, feed_frame, query
from .text_queries import ALL_SCORED, CLUSTER, DENSE, KEY, LANG, important_sql, keywords_sql

FEEDS = f"{ONE}, {FEED}, {important_sql('scored', 'n - 1')}"
HITS = "list_filter([case when contains(hay2, 'tion') then 'tion' end, case when contains(hay2, 'heit') then 'heit' end, case when contains(hay2, 'ción') then 'ción' end, case when contains(hay2, 'ai') then 'AI' end], lambda x: x is not null)"


@query("publish_items", f"""with recursive {FEEDS}, l0 as (select *, {LANG.format(given="''", t="(title || ' ' || case when " + sql.trimmed('summary') + " <> '' then summary else '' end)")} as lang0, {keywords_sql(f'list_concat({HITS}, impact_areas)')} as words0 from important),
l1 as (select *, coalesce(nullif(lang0, ''), 'unknown') as language, ({sql.distinct_ci('words0')})[1:8] as words from l0)
select id, {sql.cut('title', 180)} as title_original, {sql.cut('summary', 500)} as summary, language, case when language = 'zh' then 'not_required' else 'pending' end as translation_status, source_category as display_channel, array_to_string(words, '|') as keywords, array_to_string(case when len(impact_areas) > 0 then impact_areas[1:4] else words[1:4] end, '|') as areas, importance_score, cast(n - 1 as int) as duplicate_count, score from l1""")
def published(spark, sf_dir):
    p = publish.publish_items(feed_frame(spark, sf_dir))
    return p.select("id", "title_original", "summary", F.col("source_language").alias("language"), "translation_status", "display_channel", F.array_join("article_keywords", "|").alias("keywords"), F.array_join("impact_areas", "|").alias("areas"), "importance_score", "duplicate_count", "score")


@query("archive_items", f"with recursive {ONE}, {FEED}, d as (select *, cast(published_at as date) as day from scored), ranked as (select cast(day as varchar) as date, category, id, substr(summary, 1, 500) as summary, array_to_string(impact_areas[1:4], '|') as areas, row_number() over (partition by day, category order by score desc, published_at desc, id) as archive_rank from d) select * from ranked where archive_rank <= 20")
def archived(spark, sf_dir):
    a = publish.archive_items(feed_frame(spark, sf_dir).withColumn("date", F.to_date("published_at")))
    return a.select(F.col("date").cast("string").alias("date"), "category", "id", "summary", F.array_join("impact_areas", "|").alias("areas"), F.col("archive_rank").cast("long").alias("archive_rank"))


@query("history_index", f"with {ONE} select cast(cast(published_at as date) as varchar) as date, count(*) as total_items, count(distinct category) as categories, bool_or(source_authority = 'official-agency') as has_brief, count(*) over () as total_archive_days from items group by 1 order by 1 desc limit 10")
def history(spark, sf_dir):
    d = adapters.items(spark, sf_dir, 1).withColumn("has_brief", F.col("source_authority") == "official-agency")
    return publish.history_index(d.withColumn("date", F.to_date("published_at").cast("string")))


@query("archive_round_trip", f"with {ONE} select id, cast(cast(published_at as date) as varchar) as date from items where cast(published_at as date) between date '2024-01-26' and date '2024-01-31'")
def round_trip(spark, sf_dir):
    """Items written by day, each day twice, and its last days read back."""
    d, path = adapters.items(spark, sf_dir, 1).select("id", F.to_date("published_at").alias("date")), folder(spark)
    for _ in range(2):
        records.write_archive(d, path)
    return records.read_archive(spark, path, NOW, 5).select("id", F.col("date").cast("string").alias("date"))


BUCKET = "case when contains(source_authority, 'official-agency') or source_tier = 'S' then 'official' when contains(source_authority, 'media') and source_tier in ('A', 'B') then 'media' when source_tier = 'C' then 'opinion' else 'other' end"


@query("channel_coverage", f"""with recursive {ONE}, {FEED}, b as (select *, {BUCKET} as bucket, row_number() over (partition by source_category order by score desc, published_at desc, id) as pl from scored),
a as (select source_category as display_channel, count(*) as items, count(distinct source) as sources, count(*) filter (where bucket = 'official') as n_official, count(*) filter (where bucket = 'media') as n_media, count(*) filter (where bucket = 'opinion') as n_opinion, count(*) filter (where bucket = 'other') as n_other, count(*) filter (where score < 65) as n_low_score,
 string_agg(id, ',' order by pl) filter (where pl <= 5) as top_ids, coalesce(string_agg(id, ',' order by pl) filter (where pl <= 5 and score < 65), '') as low_confidence_ids from b group by 1)
select *, concat_ws(',', case when sources < 2 then 'single-source' end, case when n_official + n_media = 0 then 'no-official-or-media' end) as flags from a""")
def coverage(spark, sf_dir):
    feed = feed_frame(spark, sf_dir).select("run_id", "id", "display_channel", "source", "source_authority", "source_tier", "score", "published_at")
    c = events.channel_coverage(stored(feed)).drop("run_id")  # scored once, read twice
    return c.withColumns({x: F.array_join(x, ",") for x in ("top_ids", "low_confidence_ids", "flags")})


@query("compact_archive_lookup", f"""with recursive {ONE}, {FEED}, d as (select *, cast(published_at as date) as day from scored), f as (select id, url, title, source, score, cast(null as date) as date, 0 as p from (select *, row_number() over (partition by source_category order by score desc, published_at desc, id) as pl from d) where pl <= 12),
a as (select id, url, title, source, score, day as date, 1 as p from (select *, row_number() over (partition by day, category order by score desc, published_at desc, id) as pl from d) where pl <= 20), pool as (select * from f union all select * from a),
k as (select id as key_id, cast(null as varchar) as key_url from items union all select distinct null, url from items), m as (select k.*, pool.* from k join pool on k.key_id = pool.id union all select k.*, pool.* from k join pool on k.key_id is null and k.key_url = pool.url)
select key_id, key_url, id, url, title, source, score, cast(date as varchar) as date from (select *, row_number() over (partition by key_id, key_url order by p, date desc nulls last, id) as r from m) where r = 1""")
def lookups(spark, sf_dir):
    """Every item's id, and every address, looked up in the feed and then in the archive."""
    d, all_ = stored(feed_frame(spark, sf_dir)), adapters.items(spark, sf_dir, 1)
    feed, archive = publish.channel_feed(d), publish.archive_items(d.withColumn("date", F.to_date("published_at")))
    keys = all_.select(F.col("id").alias("key_id"), F.lit(None).cast("string").alias("key_url")).unionByName(all_.select(F.lit(None).cast("string").alias("key_id"), F.col("url").alias("key_url")).distinct())
    return publish.lookup_items(keys, feed, archive).select("key_id", "key_url", "id", "url", "title", "source", "score", F.col("date").cast("string").alias("date"))


@query("latest_or_previous", f"with {ONE}, {CLASSED}, h as (select strftime(published_at, '%Y-%m-%d %H') as run_id, category from weighed), runs as (select distinct run_id from h), filled as (select distinct run_id from h where category = 'macro') select run_id, last_value(case when run_id in (select run_id from filled) then run_id end ignore nulls) over (order by run_id rows unbounded preceding) as from_run from runs")
def latest(spark, sf_dir):
    """Hours as runs; an hour's feed is what a filter keeps of it."""
    d = classed(spark, sf_dir, 1).withColumn("run_id", F.date_format("published_at", "yyyy-MM-dd HH"))
    rules = filters.FilterRules(allowed_categories=("macro",), blocked_tiers=(), blocked_terms=(), low_value_titles=(), low_value_content=(), minimum_title_length=0, max_age_hours=0)
    return publish.latest_or_previous(d, filters.filter_items(d, NOW, rules)[0])


# Audit ----------------------------------------------------------------------------------------------------------------


def audit_frame(spark, sf_dir) -> DataFrame:
    """The funnel of all documents: filtered, duplicates merged, scored with a floor, bodies reviewed; an item without text after its title
    has no body."""
    d = stored(classed(spark, sf_dir, 1))
    kept = stored(filters.filter_items(d, NOW, RULES)[0])
    unique = stored(dedupe.dedupe_items(kept))
    scored = filters.score_floor(score.score_items(unique, NOW, SCORING), 60)
    high = d.join(table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("ord")), "ord", "left_semi")
    body = unique.withColumn("body_fetch_status", F.when(T.trim_ws(F.col("summary")) == "", "failed").otherwise("success")).withColumn("body_text", F.col("summary")).withColumn("candidate_value", F.lit(0))
    reviewed = stored(filters.review_content(filters.content_density(body)).drop("summary", "body_text"))
    raw = d.groupBy("run_id", "source").agg(F.count("*").alias("item_count"))
    bodies = body.groupBy("run_id", "source").agg(F.count("*").alias("attempted"), F.count_if(F.col("body_fetch_status") == "failed").alias("failed"))
    accepted = reviewed.where("content_review_status = 'accepted'")
    return audit.source_audit(raw, {"normalized": d, "filtered": kept, "deduped": unique, "scored": scored, "candidates": high, "reviewed": accepted}, bodies, reviewed)


FOUR = "floor({0} * 10000.0::double + 0.5::double) / 10000.0::double"
BASE = ITEMS.format(runs=1).replace("\nitems as (", "\nitems0 as (").replace("from items)", "from items0)")
AUDIT = f"""{BASE}, {CLASSED}, {FILTERED}, items as (select i.* from items0 i join reasons r on i.id = r.id and len(r.r) = 0), {COMPONENTS}, {DEDUPED.format('weighed')}, kept as (select * from best where r = 1), {SCORED.format('kept', '(n - 1)')},
body as ({DENSE.replace('{0}', f"(select * exclude (r, n), {sql.cleaned('summary')} as b from kept)")}),
cn as (select source, count(*) as normalized from weighed group by 1), cf as (select source, count(*) as filtered from items group by 1), cd as (select source, count(*) as deduped, count(*) filter (where {sql.trimmed('summary')} = '') as failed from kept group by 1),
cs as (select source, count(*) as scored from scored where score >= 60 group by 1), ch as (select source, count(*) as high from weighed where ord in (select doc_id from labels where quality = 1) group by 1),
cr as (select source, count(*) filter (where {sql.trimmed('summary')} <> '' and content_density >= case when source_authority = 'official-agency' then 45 else 55 end) as reviewed, avg(content_density) filter (where content_density > 0) as density from body group by 1),
au as (select source, normalized, coalesce(filtered, 0) as filtered, coalesce(deduped, 0) as deduped, coalesce(failed, 0) as failed, coalesce(scored, 0) as scored, coalesce(high, 0) as high, coalesce(reviewed, 0) as reviewed, density from cn left join cf using (source) left join cd using (source) left join cs using (source) left join ch using (source) left join cr using (source)),
aud as (select cast(0 as bigint) as run_id, source, normalized as fetched_count, normalized as normalized_items, normalized - filtered as filtered_out_items, filtered - deduped as deduplicated_items, scored as retained_items, reviewed as reviewed_items,
 {FOUR.format('scored / normalized')} as pass_rate, {FOUR.format('greatest(0, filtered - deduped) / normalized')} as duplicate_rate, {FOUR.format('high / normalized')} as high_value_rate, deduped as enrichment_attempted,
 case when deduped > 0 then {FOUR.format('(deduped - failed) / deduped')} end as body_success_rate, coalesce({sql.half_up('density', 2)}, 0.0::double) as average_density from au)"""
SUMS = ("fetched_count", "normalized_items", "filtered_out_items", "deduplicated_items", "retained_items", "enrichment_attempted")


@query("source_audit", f"with recursive {AUDIT} select * from aud")
def audited(spark, sf_dir):
    return audit_frame(spark, sf_dir)


@query("funnel_rollup", f"with recursive {AUDIT} select cast(run_id as varchar) as run_id, source, cast(grouping(run_id) * 2 + grouping(source) as bigint) as level, {', '.join(f'cast(sum({c}) as bigint) as {c}' for c in SUMS)} from aud group by rollup (run_id, source)")
def funnel(spark, sf_dir):
    return audit.funnel_rollup(audit_frame(spark, sf_dir)).withColumn("run_id", F.col("run_id").cast("string")).withColumn("level", F.col("level").cast("long"))


@query("performance_runs", f"""with recursive {AUDIT}, {adapters.ATTEMPTS}, att as (select source, max(fetched_at) as generated_at, cast(sum(item_count) as bigint) as got, bool_or(ok) as ok from attempts group by 1),
j as (select att.*, aud.* exclude (source, run_id), case when got > 0 then coalesce(enrichment_attempted, 0) else 0 end as tries, case when got > 0 then coalesce(reviewed_items, 0) else 0 end as seen from att left join aud using (source)),
k as (select *, least(got, cast(floor(coalesce(high_value_rate, 0) * coalesce(fetched_count, 0) + 0.5::double) as bigint)) as high, least(tries, cast(floor(coalesce(body_success_rate, 0) * tries + 0.5::double) as bigint)) as good from j)
select source, generated_at, got as fetched_count, least(got, coalesce(retained_items, 0)) as passed_count, least(got, coalesce(deduplicated_items, 0)) as duplicate_count, high as high_value_count, tries as body_attempt_count, good as body_success_count, coalesce(average_density, 0.0::double) * seen as density_total, seen as density_count, not ok as fetch_failed, coalesce(high / nullif(got, 0), 0.0::double) as high_value_rate, good / nullif(tries, 0) as body_success_rate from k""")
def performance(spark, sf_dir):
    a = adapters.attempts(spark, sf_dir).groupBy("source").agg(F.lit(0).cast("long").alias("run_id"), F.max("fetched_at").alias("generated_at"), F.sum("item_count").alias("item_count"), F.bool_or("ok").alias("ok"), F.lit(False).alias("is_probe"))
    return audit.performance_runs(audit_frame(spark, sf_dir), a).drop("run_id", "is_probe")


def _window_sql(name: str, frame: str) -> str:
    w = f"over (partition by source order by generated_at range between {frame})"
    cols = ["metadata_count", "pass_rate", "duplicate_rate", "high_value_rate", "body_success_rate", "average_density"]
    made = _summary_sql("sum({0}) " + w)
    for c in cols:
        made = made.replace(f" as {c}", f" as {name}_{c}")
    return f"count(*) {w} as {name}_run_count, {made}"


@query("rolling_source_metrics", f"""with {RUNS}, p as (select *, high_value_count / nullif(fetched_count, 0) as hv, body_success_count / nullif(body_attempt_count, 0) as bs from runs) select source, generated_at, {_window_sql('d7', 'interval 7 days preceding and current row')}, {_window_sql('d14', 'interval 14 days preceding and current row')}, {_window_sql('d30', 'interval 30 days preceding and current row')}, {_window_sql('p14', 'interval 28 days preceding and interval 1209600001 milliseconds preceding')},
 count(*) over f = 5 and bool_and(body_success_count = 0) over f as five_failed from p window f as (partition by source order by generated_at rows between 4 preceding and current row)""")
def rolling(spark, sf_dir):
    m = audit.rolling_source_metrics(adapters.source_runs(spark, sf_dir))
    cols = ("run_count", "metadata_count", "pass_rate", "duplicate_rate", "high_value_rate", "body_success_rate", "average_density")
    return m.select("source", "generated_at", *[F.col(f"{w}.{c}").alias(f"{w}_{c}") for w in ("d7", "d14", "d30", "p14") for c in cols], "five_failed")


# Events ---------------------------------------------------------------------------------------------------------------
KIND = sql.first_rule("text", EVENTS, "'other'")
DAILY = f"""with {ALL_SCORED}, t0 as (select *, {KIND} as event_type, case when {sql.trimmed('title')} <> '' then title else '' end as subject from important),
mem as (select *, 'daily-' || substr(sha1(lower({sql.cleaned("category || '|' || event_type || '|' || subject")})), 1, 12) as event_id from t0), rk as (select *, row_number() over (partition by run_id, event_id order by score desc, published_at desc, id) as r from mem),
facts as (select run_id, event_id, {sql.cleaned('summary')} as f, min(r) as o from rk where {sql.cleaned('summary')} <> '' and {sql.trimmed('summary')} <> '' group by 1, 2, 3),
grp as (select run_id, event_id, string_agg(id, ',' order by r) as related, count(distinct url) as source_count from rk group by 1, 2), first as (select run_id, event_id, arg_min(f, o) as summary, least(count(*), 6) as n_facts from facts group by 1, 2),
hd as (select rk.*, case when importance_score <> 0 then importance_score::double else score end as importance from rk where r = 1),
ev as (select hd.run_id, hd.event_id, lower(category || ':' || event_type || ':' || category) as theme_key, importance as importance_score, grp.source_count, related, coalesce(first.summary, '') as fact, coalesce(n_facts, 0) as n_facts, category, url, row_number() over (partition by hd.run_id order by importance desc, grp.source_count desc, hd.event_id) as rank from hd join grp using (run_id, event_id) left join first using (run_id, event_id))"""


def daily_frame(spark, sf_dir) -> DataFrame:
    d = score.score_items(classed(spark, sf_dir), NOW, SCORING)
    return stored(d.withColumn("event_type", candidates.event_type(T.item_text(d), EVENTS)))  # read several times, scored once


@query("daily_events", f"{DAILY} select run_id, cast(rank as int) as rank, event_id, theme_key, importance_score, source_count, related, md5(fact) as summary, cast(n_facts as int) as n_facts, case when source_count < 2 then 'single-source' else '' end as gaps from ev where rank <= 5")
def daily(spark, sf_dir):
    e = events.daily_events(daily_frame(spark, sf_dir))
    return e.select("run_id", "rank", "event_id", "theme_key", "importance_score", "source_count", F.array_join("related_item_ids", ",").alias("related"), F.md5("summary").alias("summary"), F.coalesce(F.array_size("confirmed_facts"), F.lit(0)).alias("n_facts"), F.array_join("evidence_gaps", ",").alias("gaps"))


@query("daily_brief_rows", f"""{DAILY}, e5 as (select *, row_number() over (partition by run_id order by importance_score desc, event_id) as b from ev where rank <= 5), cats as (select run_id, category, min(b) as o from e5 group by 1, 2), c3 as (select *, row_number() over (partition by run_id order by o) as n from cats), urls as (select run_id, url, min(b) as o from e5 group by 1, 2)
select run_id, cast(b as int) as brief_rank, event_id, (select string_agg(category, ',' order by n) from c3 where c3.run_id = e5.run_id and n <= 3) as categories, (select string_agg(url, ',' order by o) from urls where urls.run_id = e5.run_id) as sources from e5""")
def brief_rows(spark, sf_dir):
    b = events.daily_brief_rows(events.daily_events(daily_frame(spark, sf_dir)))
    return b.select("run_id", "brief_rank", "event_id", F.array_join("categories", ",").alias("categories"), F.array_join("sources", ",").alias("sources"))


@query("theme_first_events", f"""{DAILY}, e5 as (select *, lower(event_id || ' ' || coalesce(ttl, '') || ' ' || fact) as t from (select ev.*, (select any_value(case when {sql.trimmed('title')} <> '' then title end) from rk where rk.run_id = ev.run_id and rk.event_id = ev.event_id and r = 1) as ttl from ev where rank <= 5)),
p1 as (select run_id, arg_min(event_id, (-importance_score, event_id)) as event_id from e5 where contains(t, 'heit') group by 1), p2 as (select run_id, arg_min(event_id, (-importance_score, event_id)) as event_id from e5 where (contains(t, 'tion') or contains(t, 'ment')) and (run_id, event_id) not in (select (run_id, event_id) from p1) group by 1),
al as (select run_id, event_id, 0 as pick from p1 union all select run_id, event_id, 1 from p2 union all select run_id, event_id, 2 + row_number() over (partition by run_id order by importance_score desc, event_id) from e5 where (run_id, event_id) not in (select (run_id, event_id) from p1 union all select (run_id, event_id) from p2))
select run_id, event_id, cast(rank as int) as theme_rank from (select *, row_number() over (partition by run_id order by pick) as rank from al) where rank <= 4""")
def theme_first(spark, sf_dir):
    e = events.daily_events(daily_frame(spark, sf_dir)).drop("rank")
    return events.theme_first_events(e, [["heit"], ["tion", "ment"]], 4).select("run_id", "event_id", F.col("rank").alias("theme_rank"))


LINE = "case when category = 'macro' then 't-' || source end"


@query("event_candidates", f"""with {ALL_SCORED}, c0 as (select *, {LINE} as line, case when importance_score <> 0 then importance_score::double else score end as w from important), c1 as (select *, coalesce(line, case when w >= 60 then 'candidate-' || id end) as event_key from c0),
c2 as (select *, row_number() over (partition by run_id, event_key order by score desc, published_at desc, id) as r from c1 where event_key is not null), c3 as (select *, row_number() over (partition by run_id order by score desc, published_at desc, id) as rank from c2 where r = 1), g as (select run_id, event_key, string_agg(id, ',' order by r) as related from c2 group by 1, 2)
select c3.run_id, event_key, id as lead_id, category, case when w >= 90 then 'high' else 'medium' end as priority, case when line is not null then 'linked' else 'to-confirm' end as status, cast(rank as int) as rank, related from c3 join g using (run_id, event_key) where rank <= 12""")
def event_candidates(spark, sf_dir):
    d = score.score_items(classed(spark, sf_dir), NOW, SCORING)
    d = d.withColumn("timeline_event_id", F.when(F.col("category") == "macro", F.concat(F.lit("t-"), "source")))
    return events.event_candidates(d, 60).withColumn("related", F.array_join("related_item_ids", ",")).drop("related_item_ids")


@query("event_brief_inputs", f"with {ALL_SCORED}, c0 as (select *, coalesce({LINE}, id) as brief_key from important), c1 as (select *, row_number() over (partition by run_id, brief_key order by score desc, published_at desc, id) as r from c0), c2 as (select *, row_number() over (partition by run_id order by score desc, published_at desc, id) as n from c1 where r = 1) select run_id, brief_key, id, cast(n as int) as brief_rank from c2 where n <= 5")
def brief_inputs(spark, sf_dir):
    d = score.score_items(classed(spark, sf_dir), NOW, SCORING)
    d = d.withColumn("timeline_event_id", F.when(F.col("category") == "macro", F.concat(F.lit("t-"), "source")))
    d = stored(d.select("run_id", "id", "timeline_event_id", "score", "published_at"))  # scored once: the rank and the key would each do it
    return events.event_brief_inputs(d).select("run_id", "brief_key", "id", "brief_rank")


@query("independent_sources", f"with {MANY}, {CLUSTER.replace('{0}', 'items')} select run_id, {KEY.format(sql.quoted('other'))} as k, count(distinct source) as n from clustered group by 1, 2")
def independent(spark, sf_dir):
    d = adapters.items(spark, sf_dir)
    return score.independent_sources(d.withColumn("event_cluster_key", dedupe.cluster_key(F.lit("other"), dedupe.cluster_tokens(F.col("title")))))


# Weekly review --------------------------------------------------------------------------------------------------------
CONCLUSION = sql.cut(f"case when {sql.trimmed('summary')} <> '' then summary else title end", 260)
THEMED = f"""{MANY}, {EVENTSQL.replace('select ord, ', 'select summary, ord, ')}, g as (select review_date, theme_key as theme, count(*) as event_count, count(distinct primary_url) as source_count, arg_min(title, (-importance_score, event_id)) as title, arg_min({CONCLUSION}, (-importance_score, event_id)) as conclusion from latest where win = 'current' group by 1, 2),
p as (select review_date, theme_key as theme, count(*) as previous_count from latest where win = 'previous' group by 1, 2), x as (select review_date, theme_key as theme, event_id, row_number() over (partition by review_date, theme_key order by -importance_score, event_id) as n from latest where win = 'current'), xs as (select review_date, theme, string_agg(event_id, ',' order by n) as evidence from x where n <= 5 group by 1, 2),
s as (select g.*, evidence, coalesce(previous_count, 0) as previous_count, case when event_count >= 3 and source_count >= 3 then 'strong' when event_count >= 2 or source_count >= 2 then 'medium' else 'weak' end as signal from g left join p using (review_date, theme) left join xs using (review_date, theme)),
r as (select *, row_number() over (partition by review_date order by case signal when 'strong' then 0 when 'medium' then 1 else 2 end, event_count desc, theme) as rank, 'judgment-' || substr(sha1(lower({sql.cleaned('theme')})), 1, 12) as judgment_id from s), top as (select * from r where rank <= 5)"""


@query("weekly_themes", f"with {THEMED} select cast(review_date as varchar) as review_date, theme, event_count, source_count, previous_count, signal, rank, title, md5(conclusion) as conclusion, evidence, '' as risks, false as has_conflict, judgment_id, 1 as judgment_version from top")
def themes(spark, sf_dir):
    t = weekly.weekly_themes(weekly.weekly_windows(event_archive(spark, sf_dir), list(DATES)))
    return t.select(F.col("review_date").cast("string").alias("review_date"), "theme", "event_count", "source_count", "previous_count", "signal", F.col("rank").cast("long").alias("rank"), "title", F.md5("conclusion").alias("conclusion"), F.array_join(F.transform("evidence", lambda x: x["event_id"]), ",").alias("evidence"), F.array_join("risks", ",").alias("risks"), "has_conflict", "judgment_id", "judgment_version")


@query("judgment_validation", f"""with {THEMED}, old as (select * from top where review_date = date '{DATES[0]}'), cur as (select * from top where review_date = date '{DATES[1]}')
select coalesce(cur.theme, old.theme) as theme, coalesce(cur.judgment_id, old.judgment_id) as judgment_id, case when cur.theme is null or old.theme is null then 'pending' when {sql.cleaned('cur.conclusion')} = {sql.cleaned('old.conclusion')} and cur.signal <> 'weak' then 'verified' else 'deviated' end as outcome from cur full join old on cur.theme = old.theme""")
def judged(spark, sf_dir):
    w = weekly.weekly_windows(event_archive(spark, sf_dir), list(DATES))
    old = weekly.weekly_themes(w.where(F.col("review_date") == DATES[0])).select(F.col("theme").alias("theme_key"), "judgment_id", "judgment_version", "conclusion")
    return weekly.judgment_validation(weekly.weekly_themes(w.where(F.col("review_date") == DATES[1]), old), old)


@query("weekly_key_data", f"""with {MANY}, {EVENTSQL.replace('select ord, ', 'select source, ord, ')}, k as (select cast(review_date as varchar) as review_date, event_id, source as metric, cast(cast(importance_score as int) as varchar) as value, row_number() over (partition by review_date order by event_id) as rank from latest where win = 'current' and importance_score > 70) select * from k where rank <= 10""")
def key_rows(spark, sf_dir):
    """Complete rows of key data, one an event of high importance; the others lack their comparison."""
    d = F.struct(F.col("primary_name").alias("metric"), F.col("importance_score").cast("int").cast("string").alias("value"), F.when(F.col("importance_score") > 70, "week").otherwise(" ").alias("comparison"), F.lit("0").alias("change"), F.lit("score").alias("meaning"))
    w = weekly.weekly_windows(event_archive(spark, sf_dir).withColumn("key_data", F.array(d)), list(DATES))
    return weekly.weekly_key_data(w).select(F.col("review_date").cast("string").alias("review_date"), "event_id", "metric", "value", F.col("rank").cast("long").alias("rank"))


@query("enabled_only", f"with {MANY} select ord from items where k_of(source) % 3 <> 0".replace("k_of(source)", "coalesce(try_cast(substr(source, 4) as int), 0)"))
def enabled(spark, sf_dir):
    rows = event_archive(spark, sf_dir)
    n = F.coalesce(F.substring("primary_name", 4, 9).try_cast("int"), F.lit(0))
    sources = rows.select(F.col("primary_name").alias("name"), F.concat(F.lit("id-"), "primary_name").alias("source_id"), (n % 3 != 0).alias("enabled")).distinct()
    return weekly.enabled_only(rows, sources).select("ord")


# Search ---------------------------------------------------------------------------------------------------------------
QUERYROWS = [("q1", "all", "all", "tion the", 0.0), ("q2", "tech", "all", "tion", 40.0), ("q3", "all", "src3", "heit", 0.0), ("q4", "all", "src1", "zzzz", 0.0), ("q5", "all", "all", "", 60.0), ("q6", "news", "src2", "ción", 0.0), ("q7", "all", "all", "AI", 0.0), ("q8", "all", "src4", "heit zuheit", 0.0)]


def search_frame(spark, sf_dir):
    return stored(score.score_items(classed(spark, sf_dir), NOW, SCORING)), spark.createDataFrame(QUERYROWS, "query_id string, channel string, source string, keyword string, min_score double")


def search_sql(limit: int = 20) -> str:
    """Hits of the query rows, ranked; terms are lists of a word and its aliases."""
    terms = lambda k: "[" + ", ".join(sql.listed((t, *search.ALIASES.get(t, ()))) for t in k.lower().split()) + "]::varchar[][]"
    rows = ", ".join(f"('{q}', '{c}', '{s}', {terms(k)}, {m}::double)" for q, c, s, k, m in QUERYROWS)
    some = lambda c: f"len(list_filter(terms, lambda a: len(list_filter(a, lambda x: {c})) > 0))"
    low = lambda x: f"lower({sql.cleaned(x)})"
    return f"""{ALL_SCORED}, qs(query_id, q_channel, q_source, terms, min_score) as (values {rows}),
b as (select id, source, category, published_at, score, age, source_authority, {low('title')} as t_title, {low('summary')} as t_summary, lower({sql.cleaned('source')}) as t_source, {low("category || ' ' || case when category <> source_category then source_category else '' end || ' ' || array_to_string(impact_areas, ' ')")} as t_labels from important),
hit as (select qs.*, b.*, t_title || ' ' || t_summary || ' ' || t_source || ' ' || t_labels as t_all, len(terms) > 0 as filled from b, qs where (q_channel = 'all' or q_channel = category) and score >= min_score),
got as (select *, {some('contains(t_title, x)')} as ht, {some('contains(t_labels, x)')} as hk, {some('contains(t_summary, x) or contains(t_source, x)')} as hr, case when source_authority in ('official-agency', 'official-media') then 1 else 0 end as auth, greatest(0.0::double, 20 - least(20.0::double, age / 12)) as fresh from hit where {some('contains(t_all, x)')} = len(terms)),
strict as (select *, false as relaxed from got where q_source = 'all' or q_source = source),
loose as (select *, true as relaxed from got where q_source <> 'all' and filled and query_id not in (select query_id from strict)),
ranked as (select *, case when filled then ht * 100 + hk * 70 + hr * 35 + auth * 12 + fresh + score / 5 else 0.0::double end as search_score, row_number() over (partition by query_id, relaxed order by case when filled then ht else 0 end desc, case when filled then hk else 0 end desc, case when filled then hr else 0 end desc, case when filled then auth else 0 end desc, case when filled then fresh else 0 end desc, score desc, published_at desc, id) as rank,
 case when filled then concat_ws('|', case when ht > 0 then 'title' end, case when hk > 0 then 'keyword' end, case when hr > 0 then 'summary-or-source' end, case when fresh > 0 then 'fresh' end, case when auth > 0 then 'authority' end) else '' end as labels from (select * from strict union all select * from loose)),
top as (select * from ranked where rank <= {limit})"""


@query("search_items", f"with {search_sql()} select query_id, cast(rank as int) as rank, id, search_score, labels from top where not relaxed")
def searched(spark, sf_dir):
    return search.search_items(*search_frame(spark, sf_dir), NOW).select("query_id", "rank", "id", "search_score", F.array_join("hit_labels", "|").alias("labels"))


@query("search_relaxed", f"with {search_sql()}, n as (select query_id, count(*) as total from top group by 1) select query_id, cast(rank as int) as rank, id, relaxed as source_relaxed, total, greatest(0, total - 10) as remaining from top join n using (query_id) where rank <= 10")
def relaxed(spark, sf_dir):
    return search.result_page(search.search_relaxed(*search_frame(spark, sf_dir), NOW), 10).select("query_id", "rank", "id", "source_relaxed", "total", "remaining")
