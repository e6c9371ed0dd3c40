"""Registered queries: each applies one operator to whole tables; SQL where it can express the operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit, candidates, classify, dedupe, events, filters, normalize, publish, score, search, weekly
from ..sources import html, market, records
from ..operators.storage import stored
from ..streaming import jobs
from . import adapters
from .adapters import ATTEMPTS, DERIVED, EVENTS, ITEMS, KEYWORDS, NOW, RUNS, spread, table

ONE, MANY = ITEMS.format(runs=1), ITEMS.format(runs=8)
RULES = filters.FilterRules(allowed_categories=("tech", "finance", "business"), blocked_terms=("zuheit", "ñaco"), low_value_titles=("thble",), low_value_content=("aient",), blocked_sources=("src5",), blocked_tiers=("C",), max_age_hours=100, extended_max_age_hours=200)
SCORING = score.ScoreRules(keywords=KEYWORDS)
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def classed(spark, sf_dir, runs: int = 8) -> DataFrame:
    return normalize.classify_items_basic(adapters.items(spark, sf_dir, runs), DERIVED).withColumn("id", F.col("ord").cast("string"))


TOKENS = r"list_distinct(list_filter(string_split_regex(lower(trim(regexp_replace(regexp_replace(title, '<[^>]+>', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'))), '[^a-z0-9\x{4e00}-\x{9fa5}]+'), lambda w: length(w) > 1))"
ROUND = "floor({0} + 0.5)"
TIER = "case when source_authority = 'official-agency' then 'S' when source_authority = 'official-media' then 'A' when source_authority = 'blog' then 'C' else 'B' end"
FIN = "sec|csrc|exchange|交易所|公告|披露|filing|10-k|10-q|8-k|earnings|revenue|profit|financial report|财报|营收|利润"
EVID = f"""case when regexp_matches(source || ' ' || lower(text), '{FIN}') then 'financial_report'
 when source_authority = 'official-agency' and regexp_matches(source || ' ' || lower(text), 'regulation|regulatory|rule|监管|条例|办法|政策|央行|federal reserve|sec|csrc') then 'regulatory_document'
 when source_authority = 'official-agency' or regexp_matches(lower(text), 'official announcement|press release|公告|发布|声明') then 'official_announcement'
 when regexp_matches(lower(text), 'paper|journal|arxiv|research|论文|研究') then 'research_paper' when regexp_matches(lower(text), 'data|dataset|统计|数据|cpi|gdp|inflation|employment|retail sales') then 'data_release'
 when source_authority in ('official-media', 'media') then 'reliable_media_report' when regexp_matches(lower(text), 'analysis|research note|industry|报告|分析|研报') then 'industry_analysis'
 when regexp_matches(lower(text), 'market|stock|share|yield|price|成交|股价|市场|收益率') then 'market_feedback' when regexp_matches(lower(text), 'opinion|commentary|expert|观点|评论|专家') then 'expert_opinion'
 when regexp_matches(lower(text), 'social|reddit|twitter|x\\.com|discussion|讨论') then 'social_discussion' else 'unknown' end"""
CLASSED = f"""classed as (select * exclude (category), category as source_category,
 case when regexp_matches(text, '(?i)tion') then 'macro' when regexp_matches(text, '(?i)heit') then 'international' when regexp_matches(text, '(?i)ción') then 'business' else category end as category,
 list_filter([case when regexp_matches(text, '(?i)tion') then 'M' end, case when regexp_matches(text, '(?i)heit') then 'I' end, case when regexp_matches(text, '(?i)ción') then 'B' end], lambda x: x is not null) as impact_areas,
 {TIER} as source_tier, {EVID} as evidence_type from words),
weighed as (select *, case evidence_type when 'official_announcement' then 100 when 'financial_report' then 95 when 'regulatory_document' then 95 when 'research_paper' then 90 when 'data_release' then 90 when 'reliable_media_report' then 80 when 'industry_analysis' then 70 when 'market_feedback' then 70 when 'expert_opinion' then 60 when 'social_discussion' then 40 else 20 end as evidence_weight from classed)"""


@query("normalize_items", f"with {MANY}, {CLASSED} select id, category, case when category <> source_category then source_category end as primary_category, array_to_string(impact_areas, ',') as areas, source_tier, evidence_type, evidence_weight from weighed")
def normalize_items(spark, sf_dir):
    d = classed(spark, sf_dir)
    return d.select("id", "category", "primary_category", F.array_join("impact_areas", ",").alias("areas"), "source_tier", "evidence_type", "evidence_weight")


@query("clean_text", r"select page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \t\n\x0B\f\r\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+', ' ', 'g')) as text from pages")
def clean(spark, sf_dir):
    return spread(table(spark, sf_dir, "pages")).select("page_id", T.clean_text(F.col("html")).alias("text"))


@query("canonical_url", r"""with p as (select page_id, trim(url) as u from pages), q as (select page_id, regexp_extract(u, '^(https?://[^/?#\s]+)', 1) as host, regexp_extract(u, '^https?://[^/?#\s]+([^?#]*)', 1) as path, regexp_extract(u, '^https?://[^/?#\s]+[^?#]*\?([^#]*)', 1) as query from p),
r as (select page_id, host, case when path = '' then '/' else path end as path, list_filter(string_split(query, '&'), lambda x: x <> '' and not list_contains(['utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'ref', 'ref_src', 'cmpid'], split_part(x, '=', 1))) as kept from q)
select page_id, case when host = '' then '' else regexp_replace(lower(host) || path || case when len(kept) > 0 then '?' || array_to_string(kept, '&') else '' end, '/$', '') end as url from r""")
def urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.canonical_url(F.col("url")).alias("url"))


@query("title_tokens", f"with {ONE} select ord, array_to_string(list_sort({TOKENS}), '|') as tokens from items")
def tokens(spark, sf_dir):
    return adapters.items(spark, sf_dir, 1).select("ord", F.array_join(F.sort_array(T.title_tokens(F.col("title"))), "|").alias("tokens"))


FILTERED = f"""marked as (select *, lower(title || ' ' || summary) as hay, lower(trim(regexp_replace(regexp_replace(title, '<[^>]+>', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) as low from weighed),
reasons as (select id, list_filter([case when category not in ('tech', 'finance', 'business') then 'category-not-allowed' end, case when source = 'src5' then 'blocked-source' end, case when source_tier = 'C' then 'blocked-source-tier:C' end,
 case when contains(hay, 'zuheit') then 'blocked-term:zuheit' when contains(hay, 'ñaco') then 'blocked-term:ñaco' end, case when contains(low, 'thble') then 'low-value-title:thble' end, case when contains(hay, 'aient') then 'low-value-content:aient' end,
 case when length(low) < 12 then 'title-too-short' end, case when epoch(timestamp '{NOW}' - published_at) / 3600 > case when evidence_type in ('regulatory_document', 'research_paper', 'data_release') or regexp_matches(hay, '政策|监管|研究|论文|经济数据|policy|regulation|research|paper|economic data') then 200 else 100 end then 'too-old' end], lambda x: x is not null) as r from marked)"""


@query("filter_items", f"with {MANY}, {CLASSED}, {FILTERED} select id, array_to_string(r, ';') as reasons, len(r) = 0 as kept from reasons")
def filtered(spark, sf_dir):
    d = filters.filter_reasons(classed(spark, sf_dir), NOW, RULES)
    return d.select("id", F.array_join("filter_reasons", ";").alias("reasons"), (F.size("filter_reasons") == 0).alias("kept"))


PAIRS = f"""tok as (select ord, list_sort({TOKENS}) as t, len({TOKENS}) as n from items), uniq as (select min(ord) as ord, t, min(n) as n from tok where n > 0 group by t),
pairs as (select a.ord as a, b.ord as b from uniq a join uniq b on a.ord < b.ord and a.n >= {{0}} * b.n and b.n >= {{0}} * a.n where len(list_intersect(a.t, b.t)) >= {{0}} * (a.n + b.n - len(list_intersect(a.t, b.t))))"""


@query("title_pairs", f"with {ONE}, {PAIRS.replace('{0}', '0.42')} select a, b from pairs")
def title_pairs(spark, sf_dir):
    return dedupe.title_pairs(adapters.items(spark, sf_dir, 1), 0.42).select("a", "b")


COMPONENTS = f"""{PAIRS.replace('{0}', '0.82')}, edges as (select a, b from pairs union select u.ord, t.ord from uniq u join tok t on u.t = t.t and u.ord <> t.ord union select m.m, i.ord from items i join (select url, min(ord) as m from items group by url) m on i.url = m.url and i.ord <> m.m),
both_ways as (select a, b from edges union select b, a from edges),
reach as (select ord as node, ord as root from items union select e.b, r.root from reach r join both_ways e on r.node = e.a),
comp as (select node as ord, min(root) as component from reach group by node)"""


@query("duplicate_components", f"with recursive {ONE}, {COMPONENTS} select ord, component from comp")
def components(spark, sf_dir):
    return dedupe.duplicate_components(adapters.items(spark, sf_dir, 1), 0.82).select("ord", "component")


DEDUPED = """best as (select i.*, c.component, row_number() over (partition by component order by credibility desc, published_at desc, ord) as r, count(*) over (partition by component) as n from {0} i join comp c using (ord))"""


@query("dedupe_items", f"with recursive {ONE}, {COMPONENTS}, {DEDUPED.format('items')} select id, component, cast(n - 1 as int) as duplicate_count from best where r = 1")
def deduped(spark, sf_dir):
    d = adapters.items(spark, sf_dir, 1)
    return dedupe.dedupe_items(d).join(dedupe.duplicate_groups(d).withColumnRenamed("group", "component"), ["run_id", "ord"]).select("id", "component", "duplicate_count")


@query("dedupe_first_fit")
def first_fit(spark, sf_dir):
    return dedupe.duplicate_groups(adapters.items(spark, sf_dir, 1), 0.42, "first_fit").select("ord", "group")


KEYHITS = "list_filter([case when contains(hay2, 'tion') then 8.0 end, case when contains(hay2, 'heit') then 5.0 end, case when contains(hay2, 'ción') then 6.0 end, case when contains(hay2, 'ai') then 2.0 end], lambda x: x is not null)"
RELEVANCE = r"""regexp_matches(lower(text), '\bopenai\b|\bnvidia\b|\bfederal reserve\b|\bfed\b|\bsec\b|\bcsrc\b')::int + regexp_matches(text, '英伟达|美联储|证监会|央行|国务院|国家统计局|发改委|交易所|监管')::int"""
SCORED = f"""hits as (select *, lower(title || ' ' || summary || '  ') as hay2 from {{0}}), kw as (select *, {KEYHITS} as k, {RELEVANCE} as ents from hits),
rel as (select *, greatest(0, least(100, 15 + ents * 10 + least(25, len(k) * 5) + least(20, len(impact_areas) * 8) + cast(floor(evidence_weight * 0.25::double + 0.5) as int) + case when regexp_matches(lower(text), '发布|announced|reported|data|数据|公告|披露|confirmed|批准|released') then 15 else 0 end - case when ents = 0 and len(k) > 0 then 15 else 0 end)) as relevance,
  epoch(timestamp '{NOW}' - published_at) / 3600.0::double as age from kw),
scored as (select *, greatest(0.0::double, least(100.0::double, floor(38.0::double + credibility * 0.32::double + 18.0::double * pow(0.5::double, age / 84.0::double) + coalesce(list_sum(k), 0)::double
 + case category when 'tech' then 2 when 'finance' then 3 when 'business' then 2 when 'macro' then 4 when 'international' then 2 when 'news' then 1 else 0 end + case source_authority when 'official-agency' then 5 when 'official-media' then 3 else 0 end
 + case source_tier when 'S' then 8 when 'A' then 5 when 'B' then 2 when 'C' then -18 else -50 end
 + case evidence_type when 'official_announcement' then 8 when 'financial_report' then 7 when 'regulatory_document' then 7 when 'research_paper' then 6 when 'data_release' then 6 when 'reliable_media_report' then 4 when 'industry_analysis' then 2 when 'market_feedback' then 2 when 'expert_opinion' then -5 when 'social_discussion' then -12 else -10 end
 + 1.0::double + case when source_authority = 'official-agency' and age <= 24 then 5.0 else 0.0 end::double + floor((relevance - 50) * 0.18::double * 100 + 0.5) / 100
 - {{1}} * 2.0::double - case when relevance < 45 then 10.0 else 0.0 end::double + 0.5))) as score from rel)"""


@query("score_items", f"with {MANY}, {CLASSED}, {SCORED.format('weighed', '0')} select id, cast(relevance as int) as event_relevance_score, score from scored")
def scored(spark, sf_dir):
    return score.score_items(classed(spark, sf_dir), NOW, SCORING).select("id", "event_relevance_score", "score")


def feed_frame(spark, sf_dir) -> DataFrame:
    """Kept items, duplicates merged, scored."""
    kept, _ = filters.filter_items(classed(spark, sf_dir, 1), NOW, filters.FilterRules(allowed_categories=(), minimum_title_length=1, max_age_hours=0))
    kept = stored(kept)  # it is read several times, and its rules should run once
    return score.score_items(dedupe.dedupe_items(kept), NOW, SCORING).withColumn("display_channel", F.col("source_category"))


FEED = f"""{COMPONENTS}, {CLASSED}, {DEDUPED.format('weighed')}, kept as (select * from best where r = 1), {SCORED.format('kept', '(n - 1)')}"""


@query("channel_feed", f"with recursive {ONE}, {FEED}, ranked as (select source_category as channel, row_number() over (partition by source_category order by score desc, published_at desc, id) as rank, id, score, count(*) over (partition by source_category) as channel_count from scored) select channel, rank, id, score, channel_count from ranked where rank <= 12")
def channel_feed(spark, sf_dir):
    return publish.channel_feed(feed_frame(spark, sf_dir)).select("channel", F.col("rank").cast("long").alias("rank"), "id", "score", "channel_count")


def candidate_frame(spark, sf_dir) -> DataFrame:
    """Items with their own sources as a table: those of many items may take more, and a quarter, by a hash of the name, is of the core tier."""
    d = classed(spark, sf_dir).withColumn("source_id", F.col("source"))
    recent = d.select((F.col("run_id") + 1).alias("run_id"), "id", "title")
    docs = adapters.table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("unknown")).alias("source_id"))
    tier = F.when(F.pmod(F.crc32(F.col("source_id").cast("binary")), F.lit(4)) == 0, "core")
    sources = docs.groupBy("source_id").agg(F.least(F.lit(6), F.floor(F.log10(F.count("*"))) + 1).cast("int").alias("body_fetch_quota")).withColumn("source_policy_tier", tier)
    return candidates.select_candidates(d, recent, candidates.SelectionRules(event_types=EVENTS, blocked_patterns=("zuheit",)), sources)


@query("select_candidates")
def selected(spark, sf_dir):
    return candidate_frame(spark, sf_dir).select("run_id", "id", "event_type", "candidate_category", "source_policy_tier", "candidate_value", "event_cluster_key", "candidate_status", "candidate_reason")


@query("information_gain", f"with {MANY}, tok as (select run_id, ord, id, {TOKENS} as t from items), rec as (select run_id + 1 as run_id, id, t from tok), best as (select a.run_id, a.ord, max(len(list_intersect(a.t, b.t)) / cast(len(a.t) + len(b.t) - len(list_intersect(a.t, b.t)) as double)) as m from tok a join rec b on a.run_id = b.run_id and a.id <> b.id and len(list_intersect(a.t, b.t)) > 0 group by 1, 2) select tok.run_id, tok.ord, cast(case when tok.run_id in (select run_id from rec) then greatest(0, floor(20 * (1 - coalesce(m, 0)) + 0.5)) else 16 end as int) as information_gain from tok left join best using (run_id, ord)")
def gain(spark, sf_dir):
    d = adapters.items(spark, sf_dir)
    return candidates.information_gain(d, d.select((F.col("run_id") + 1).alias("run_id"), "id", "title"))


@query("event_clusters")
def clusters(spark, sf_dir):
    d = classed(spark, sf_dir).withColumn("event_type", candidates.event_type(T.item_text(adapters.items(spark, sf_dir)), EVENTS))
    return dedupe.assign_event_clusters(d).select("run_id", "ord", "event_type", "event_cluster_key")


def event_archive(spark, sf_dir) -> DataFrame:
    """Items as archived events: those of one title are versions of one event; themes by category and source."""
    d = adapters.items(spark, sf_dir)
    return d.select("ord", F.concat(F.lit("e"), F.substring(F.md5(F.lower("title")), 1, 12)).alias("event_id"), F.concat_ws(":", "category", F.col("source")).alias("theme_key"), "title", "summary", "category", F.lit("other").alias("event_type"), "credibility", F.col("credibility").alias("importance_score"), F.col("published_at").alias("archived_at"), F.col("url").alias("primary_url"), F.col("source").alias("primary_name"), F.lit("").alias("primary_id"))


DATES = ("2024-01-24", "2024-01-31")
EVENTSQL = f"""ev as (select ord, 'e' || substr(md5(lower(title)), 1, 12) as event_id, category || ':' || source as theme_key, title, category, credibility as importance_score, published_at as archived_at, url as primary_url from items),
aged as (select ev.*, d.review_date, date_diff('day', cast(archived_at as date), d.review_date) as age from ev, (select unnest([date '{DATES[0]}', date '{DATES[1]}']) as review_date) d),
win as (select *, case when age <= 7 then 'current' else 'previous' end as win from aged where age between 1 and 14),
latest as (select * from (select *, row_number() over (partition by review_date, win, event_id order by archived_at desc, ord) as r from win) where r = 1)"""


@query("weekly_windows", f"with {MANY}, {EVENTSQL} select cast(review_date as varchar) as review_date, win as window, event_id, ord from latest")
def windows(spark, sf_dir):
    return weekly.weekly_windows(event_archive(spark, sf_dir), list(DATES)).select(F.col("review_date").cast("string").alias("review_date"), "window", "event_id", "ord")


@query("weekly_major_events", f"with {MANY}, {EVENTSQL} select cast(review_date as varchar) as review_date, event_id, rank from (select review_date, event_id, row_number() over (partition by review_date order by importance_score desc, event_id) as rank from latest where win = 'current') where rank <= 6")
def major(spark, sf_dir):
    return weekly.weekly_major_events(weekly.weekly_windows(event_archive(spark, sf_dir), list(DATES))).select(F.col("review_date").cast("string").alias("review_date"), "event_id", F.col("rank").cast("long").alias("rank"))


@query("iso_week_id", f"with {ONE} select ord, cast(extract(isoyear from published_at) as varchar) || '-W' || lpad(cast(week(published_at) as varchar), 2, '0') as week_id from items")
def weeks(spark, sf_dir):
    return adapters.items(spark, sf_dir, 1).select("ord", T.iso_week(F.col("published_at")).alias("week_id"))


@query("source_counts", f"with {ONE} select source, count(*) as items, max(published_at) as newest_published_at from items group by source")
def counts(spark, sf_dir):
    return audit.source_counts(adapters.items(spark, sf_dir, 1))


def _summary_sql(of: str) -> str:
    d = lambda a, b, k: f"floor({of.format(a)} / nullif({of.format(b)}, 0)::double * {k} + 0.5) / {k}"
    return f"coalesce(cast({of.format('fetched_count')} as bigint), 0) as metadata_count, coalesce({d('passed_count', 'fetched_count', 10000)}, 0) as pass_rate, coalesce({d('duplicate_count', 'fetched_count', 10000)}, 0) as duplicate_rate, coalesce({d('high_value_count', 'fetched_count', 10000)}, 0) as high_value_rate, {d('body_success_count', 'body_attempt_count', 10000)} as body_success_rate, coalesce({d('density_total', 'density_count', 100)}, 0) as average_density"


@query("summarize_runs", f"with {RUNS} select source, count(*) as run_count, {_summary_sql('sum({0})')} from runs group by source")
def summarized(spark, sf_dir):
    return audit.summarize_runs(adapters.source_runs(spark, sf_dir))


@query("source_policy")
def policy(spark, sf_dir):
    return audit.policy_limits(audit.source_policy(adapters.source_runs(spark, sf_dir)))


@query("fetch_sessions", f"""with {ATTEMPTS}, g as (select *, case when lag(fetched_at) over w is null or fetched_at - lag(fetched_at) over w > interval 5 minutes then 1 else 0 end as nw from attempts window w as (partition by stream order by fetched_at)),
s as (select *, sum(nw) over (partition by stream order by fetched_at) as session from g), f as (select stream, session, min(fetched_at) as session_start from s group by 1, 2),
l as (select * from (select *, row_number() over (partition by stream, session, source order by fetched_at desc, attempt_id desc) as r from s) where r = 1) select l.stream, cast(l.session as bigint) as session, l.source, l.attempt_id, f.session_start from l join f using (stream, session)""")
def sessions(spark, sf_dir):
    return audit.fetch_sessions(adapters.attempts(spark, sf_dir), 5).select("stream", "session", "source", "attempt_id", "session_start")


HEALTH = f"""with {ATTEMPTS}, a as (select *, sum(ok::int) over w as island, case when ok and item_count > 0 then 'healthy' when ok then 'empty' else 'failed' end as own from attempts window w as (partition by source order by fetched_at, attempt_id rows unbounded preceding)),
b as (select *, sum((not ok)::int) over (partition by source, island order by fetched_at, attempt_id rows unbounded preceding) as failure_count, max(case when own = 'healthy' then fetched_at end) over (partition by source order by fetched_at, attempt_id rows unbounded preceding) as last_success_at, last_value(case when own <> 'failed' then own end ignore nulls) over (partition by source order by fetched_at, attempt_id rows unbounded preceding) as before from a)
select attempt_id, source, cast(failure_count as bigint) as failure_count, last_success_at, case when own = 'failed' and failure_count <= {{0}} and before is not null then before else own end as status from b"""


def unique_attempts(spark, sf_dir) -> DataFrame:
    return adapters.attempts(spark, sf_dir)


@query("source_health", HEALTH.format(0))
def health(spark, sf_dir):
    return audit.source_health(unique_attempts(spark, sf_dir)).select("attempt_id", "source", "failure_count", "last_success_at", "status")


@query("source_health_grace", HEALTH.format(2))
def health_grace(spark, sf_dir):
    return audit.source_health(unique_attempts(spark, sf_dir), 2).select("attempt_id", "source", "failure_count", "last_success_at", "status")


@query("effective_records", f"""with {ATTEMPTS}, a as (select *, last_value(case when ok and item_count > 0 then fetched_at end ignore nulls) over w as lf, last_value(case when ok and item_count > 0 then item_count end ignore nulls) over w as lc from attempts window w as (partition by source order by fetched_at, attempt_id rows between unbounded preceding and 1 preceding))
select attempt_id, case when not ok and lf is not null then lf else fetched_at end as effective_fetched_at, case when not ok and lf is not null then lc when ok then item_count else 0 end as effective_count, not ok and lf is not null as stale from a""")
def effective(spark, sf_dir):
    return audit.effective_records(unique_attempts(spark, sf_dir)).select("attempt_id", "effective_fetched_at", "effective_count", "stale")


@query("limit_newest", f"with {MANY} select run_id, source, ord from (select *, row_number() over (partition by run_id, source order by published_at desc, ord) as r from items where published_at >= timestamp '{NOW}' - interval 96 hours) where r <= 3")
def newest(spark, sf_dir):
    return audit.limit_newest(adapters.items(spark, sf_dir), 3, 96).select("run_id", "source", "ord")


@query("source_facets", f"with {ONE} select distinct source from items")
def facets(spark, sf_dir):
    return search.source_facets(adapters.items(spark, sf_dir, 1))


@query("extract_articles")
def articles(spark, sf_dir):
    return html.extract_articles(spread(table(spark, sf_dir, "pages")))


@query("extract_page_links")
def links(spark, sf_dir):
    return html.extract_page_links(spread(table(spark, sf_dir, "pages")))


@query("enrich_items")
def enriched(spark, sf_dir):
    p = spread(table(spark, sf_dir, "pages"))
    d = p.select((F.col("page_id") % 8).alias("run_id"), F.col("page_id").alias("ord"), F.col("page_id").cast("string").alias("id"), F.when(F.col("page_id") % 5 == 0, F.lit("https://none.example/")).otherwise(F.col("url")).alias("url"), F.lit("summary of a page that was landed").alias("summary"), F.concat(F.lit("src"), (F.col("page_id") % 20).cast("string")).alias("source"))
    return audit.enrichment_stats(html.enrich_items(d, html.extract_articles(p)))


@query("weekly_top_sources", f"with {ONE}, c as (select cast(extract(isoyear from published_at) as varchar) || '-W' || lpad(cast(week(published_at) as varchar), 2, '0') as week_id, category as display_channel, source, count(*) as count from items group by 1, 2, 3) select week_id, display_channel, source, count, rank from (select *, row_number() over (partition by week_id, display_channel order by count desc, source) as rank from c) where rank <= 6")
def top_sources(spark, sf_dir):
    return publish.weekly_top_sources(adapters.items(spark, sf_dir, 1).withColumn("display_channel", F.col("category"))).withColumn("rank", F.col("rank").cast("long"))


@query("daily_counts", f"with {ONE} select cast(cast(date_trunc('day', published_at) as date) as varchar) as day, source, count(*) as items from items group by 1, 2")
def day_counts(spark, sf_dir):
    """The stream's tumbling windows, over a whole table at once."""
    return jobs.daily_counts(adapters.items(spark, sf_dir, 1)).select(F.date_format("day.start", "yyyy-MM-dd").alias("day"), "source", "items")


@query("sliding_source_metrics", f"with {RUNS} select cast(cast(generated_at - to_days(cast(k as int)) as date) as varchar) as start, source, cast(sum(fetched_count) as bigint) as fetched, cast(sum(passed_count) as bigint) as passed, cast(sum(duplicate_count) as bigint) as duplicates from runs, (select unnest(generate_series(0, 6)) as k) group by 1, 2")
def sliding(spark, sf_dir):
    return jobs.sliding_source_metrics(adapters.source_runs(spark, sf_dir)).select(F.date_format("window.start", "yyyy-MM-dd").alias("start"), "source", "fetched", "passed", "duplicates")


@query("cache_expiry", f"with {ATTEMPTS} select attempt_id, fetched_at + to_hours(cast(case when item_count > 0 then item_count else 48 end as int)) as cache_expires_at, fetched_at + to_hours(cast(case when item_count > 0 then item_count else 48 end as int)) < timestamp '{NOW}' as expired from attempts")
def expiry(spark, sf_dir):
    return jobs.cache_expiry(adapters.attempts(spark, sf_dir).withColumn("cache_ttl_hours", F.col("item_count").cast("double")), NOW).select("attempt_id", "cache_expires_at", "expired")


@query("summary_selection", f"with {MANY}, r as (select run_id, id, credibility as score, published_at, row_number() over (partition by run_id, category order by credibility desc, published_at desc, id) as a, row_number() over (partition by run_id order by credibility desc, published_at desc, id) as b from items) select distinct run_id, id from r where a <= 6 or b <= 30")
def chosen(spark, sf_dir):
    d = adapters.items(spark, sf_dir).withColumn("score", F.col("credibility")).withColumn("display_channel", F.col("category")).withColumn("translation_status", F.lit("pending"))
    return publish.summary_selection(d)


@query("policy_tier", f"with {ONE} select id, case when source_authority = 'official-agency' then 'core' when source_authority = 'official-media' or credibility >= 80 then 'standard' else 'experimental' end as tier from items")
def tiers(spark, sf_dir):
    d = adapters.items(spark, sf_dir, 1).withColumn("source_tier", F.lit(""))
    return d.select("id", candidates.policy_tier(d).alias("tier"))
