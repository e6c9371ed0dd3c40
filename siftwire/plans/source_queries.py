"""Landed records, lists, links, market payloads and the dimension of sources, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit, events, filters, normalize, publish, score
from ..operators.storage import stored
from ..sources import html, market, records
from . import adapters, sql
from .adapters import ATTEMPTS, NOW, RUNS, table
from .feed_queries import BUCKET
from .queries import CLASSED, HEALTH, MANY, ONE, SCORED, SCORING, classed, query

# Records --------------------------------------------------------------------------------------------------------------


def api_records(spark, sf_dir) -> DataFrame:
    """documents as API bodies of four shapes: a bare array, named arrays, and an object of its own."""
    d = adapters.items(spark, sf_dir, 1)
    one = F.struct("title", F.col("url").alias("link"))
    again = F.struct(F.concat("title", F.lit(" again")).alias("title"), F.col("url").alias("link"))
    shapes = [F.to_json(F.array(one)), F.to_json(F.struct(F.array(one).alias("articles"))), F.to_json(F.struct(F.array(one, again).alias("data"))), F.to_json(one)]
    return d.select(F.col("ord").alias("doc_id"), F.col("source").alias("source_id"), F.get(F.array(*shapes), (F.col("ord") % 4).cast("int")).alias("body"))


@query("explode_api_body", f"with {ONE} select ord as doc_id, source as source_id, cast(k as int) as ord, title || case when k = 1 then ' again' else '' end as title, url as link from items, (select unnest([0, 1]) as k) where k = 0 or ord % 4 = 2")
def api_items(spark, sf_dir):
    return records.explode_api_body(api_records(spark, sf_dir)).select("doc_id", "source_id", "ord", "title", "link")


@query("api_item_count", f"with {ONE} select ord as doc_id, cast(case ord % 4 when 0 then 1 when 2 then 2 else 0 end as int) as n from items")
def api_counts(spark, sf_dir):
    return api_records(spark, sf_dir).select("doc_id", records.api_item_count(F.col("body")).alias("n"))


@query("parse_feed_items", f"with {MANY} select source, id as guid, {sql.trimmed(chr(10).join(['replace(replace(replace(replace(replace(title,', chr(39) + '&amp;' + chr(39), ',', chr(39) + '&' + chr(39), '),', chr(39) + '&lt;' + chr(39), ',', chr(39) + '<' + chr(39), '),', chr(39) + '&gt;' + chr(39), ',', chr(39) + '>' + chr(39), '),', chr(39) + '&quot;' + chr(39), ',', chr(39) + chr(34) + chr(39), '),', chr(39) + '&#39;' + chr(39), ',', chr(39) * 4, ')']))} as title, url as link, 'news,' || category as categories, 'https://img.example/' || id || '.png' as image from items")
def feeds(spark, sf_dir):
    """Documents wrapped as feed XML, up to 400 ids a source and feed, parsed back."""
    d = adapters.items(spark, sf_dir)
    medium = F.when(F.col("ord") % 2 == 0, F.concat(F.lit('<media:thumbnail url="https://img.example/'), "id", F.lit('.png"/>'))).otherwise(F.concat(F.lit('<enclosure type="image/png" url="https://img.example/'), "id", F.lit('.png"/>')))
    item = F.concat(F.lit("<item><title><![CDATA["), F.col("title"), F.lit("]]></title><link>"), F.col("url"), F.lit("</link><guid>"), F.col("id"), F.lit("</guid><category>news</category><category>"), "category", F.lit("</category>"), medium, F.lit("</item>"))
    xml = d.groupBy("source", (F.floor(F.col("ord") / 400)).alias("part")).agg(F.concat(F.lit("<rss>"), F.array_join(F.sort_array(F.collect_list(item)), ""), F.lit("</rss>")).alias("xml"))
    return records.parse_feed_items(xml).select("source", "guid", "title", "link", F.array_join("categories", ",").alias("categories"), F.col("feed_image_url").alias("image"))


SHAPES = "case page_id % 4 when 0 then 'https://abs.example/' || page_id when 1 then '//host.example/' || page_id when 2 then '/path/' || page_id else 'rel' || page_id end"
DAYS = "case page_id % 3 when 0 then '2024-1-5' when 1 then '20240117' else '' end"


@query("map_json_list", f"""select 's' || page_id % 3 as source_id, 'Page ' || page_id as title, case page_id % 4 when 0 then 'https://abs.example/' || page_id when 1 then 'https://host.example/' || page_id when 2 then 'https://l' || page_id % 3 || '.example/path/' || page_id else 'https://l' || page_id % 3 || '.example/list/rel' || page_id end as link,
 case page_id % 3 when 0 then '2024-01-05' when 1 then '2024-01-17' end as day from pages""")
def mapped(spark, sf_dir):
    """Pages as listed JSON rows, each source with names of its own."""
    rows = table(spark, sf_dir, "pages").select(F.concat(F.lit("s"), (F.col("page_id") % 3).cast("string")).alias("source_id"), F.lit(NOW).cast("timestamp").alias("fetched_at"), F.expr(f"map('headline', '<b>Page</b>  ' || page_id, 'href', {SHAPES}, 'day', {DAYS})").alias("row"))
    sources = spark.createDataFrame([(f"s{i}", {"title": "headline", "url": "href", "published_at": "day"}, f"https://l{i}.example/list/index.html", True) for i in range(3)], "source_id string, mapping map<string,string>, url string, require_published_date boolean")
    return records.map_json_list(rows, sources).select("source_id", "title", "link", F.date_format("published_at", "yyyy-MM-dd").alias("day"))


def link_sources(spark, sf_dir) -> DataFrame:
    """A row a source with the rules of its lists."""
    s = adapters.items(spark, sf_dir, 1).select(F.col("source").alias("source_id")).distinct()
    n = F.coalesce(F.substring("source_id", 4, 9).try_cast("int"), F.lit(0))
    return s.select("source_id", F.when(n % 3 == 1, F.lit("/[0-7][0-9a-f]*$")).alias("include_url_pattern"), F.when(n % 4 == 1, F.lit("^[A-M]")).alias("exclude_title_pattern"), (n % 2 == 0).alias("require_published_date"), (n % 5 != 0).alias("enrichment_enabled"), F.concat(F.lit("name of "), "source_id").alias("name"))


K = "coalesce(try_cast(substr(source, 4) as int), 0)"


@query("keep_links", f"with {ONE} select id, source as source_id from items where length(title) >= 6 and ({K} % 3 <> 1 or regexp_matches(url, '/[0-7][0-9a-f]*$')) and not ({K} % 4 = 1 and regexp_matches(title, '^[A-M]')) and ({K} % 2 <> 0 or ord % 7 <> 0)")
def kept_links(spark, sf_dir):
    """Items as links; one in seven has no date, which even sources ask for."""
    d = adapters.items(spark, sf_dir, 1)
    links = d.select("id", F.col("source").alias("source_id"), "title", F.col("url").alias("link"), F.when(F.col("ord") % 7 != 0, F.col("published_at")).alias("published_at"))
    return filters.keep_links(links, link_sources(spark, sf_dir)).select("id", "source_id")


@query("distinct_links", f"with {ONE} select source as source_id, title, url as link, min(ord) as ord from items group by 1, 2, 3")
def once(spark, sf_dir):
    d = adapters.items(spark, sf_dir, 1).select(F.col("source").alias("source_id"), "title", F.col("url").alias("link"), "ord")
    return records.distinct_links(d.unionByName(d.withColumn("ord", F.col("ord") + 1_000_000_000)))


@query("union_families", f"with {ONE} select id, category, case when category = 'tech' then title end as title, case when category = 'finance' then url end as url from items")
def families(spark, sf_dir):
    d = adapters.items(spark, sf_dir, 1)
    return records.union_families(d.where("category = 'tech'").select("id", "category", "title"), d.where("category = 'finance'").select("id", "category", "url"), d.where("category not in ('tech', 'finance')").select("id", "category"))


@query("enrichment_candidates", f"with {ONE} select id from items where {K} % 5 <> 0")
def enrichable(spark, sf_dir):
    """Even items name their source by id, odd ones by name."""
    d = adapters.items(spark, sf_dir, 1)
    even = F.col("ord") % 2 == 0
    rows = d.select("id", "url", F.when(even, F.col("source")).alias("source_id"), F.when(~even, F.concat(F.lit("name of "), "source")).otherwise("").alias("source"))
    return html.enrichment_candidates(rows, link_sources(spark, sf_dir)).select("id")


@query("fill_translations", f"with {MANY}, prev as (select url, arg_max('Z ' || id, ord) as z from items where category <> 'news' group by 1) select id, case when ord % 3 = 0 then 'own ' || id else z end as title_zh from items left join prev using (url)")
def filled(spark, sf_dir):
    d = adapters.items(spark, sf_dir)
    previous = d.where("category <> 'news'").select("url", F.concat(F.lit("Z "), "id").alias("title_zh"), F.lit(None).cast("string").alias("summary_zh"), F.timestamp_seconds("ord").alias("fetched_at"))
    rows = d.select("id", "url", F.when(F.col("ord") % 3 == 0, F.concat(F.lit("own "), "id")).otherwise(" ").alias("title_zh"))
    return publish.fill_translations(rows, previous).select("id", "title_zh")


# Flags ----------------------------------------------------------------------------------------------------------------


@query("item_flags", f"""with {MANY}, {CLASSED}, {SCORED.format('weighed', '0')} select id, 'floor' as flag from scored where score >= 70 union all select id, 'summary' from scored where score >= 60 and title <> '' union all select id, 'event' from scored where source_category <> 'finance' or regexp_matches(title || ' ', '[\\x{{4e00}}-\\x{{9fff}}]')
union all select id, {BUCKET} from scored union all select id, 'missing-facts,missing-watch-variables,missing-counter-arguments' from scored""".replace("{{", "{").replace("}}", "}"))
def flags(spark, sf_dir):
    """What each item passes: score floor, summary, events; its source's bucket; what its text lacks."""
    d = stored(score.score_items(classed(spark, sf_dir), NOW, SCORING).select("id", "title", "url", "score", "source", "source_category", "source_authority", "source_tier"))  # scored once, read five times
    d = d.withColumn("translation_status", F.when(F.col("source_category") == "finance", "failed").otherwise("done")).withColumn("source_language", F.lit("en"))
    name = lambda df, c: df.select("id", c.alias("flag"))
    parts = [name(filters.score_floor(d, 70), F.lit("floor")), name(filters.summary_eligible(d, 60), F.lit("summary")), name(filters.event_eligible(d), F.lit("event")), name(d, events.source_bucket(d)), name(events.quality_flags(d), F.array_join("quality_flags", ","))]
    return records.union_families(*parts)


@query("translation_routing", f"with {ONE} select case when category = 'news' then 'not_required' when ord % 2 = 0 then 'existing' else 'needs_translation' end as route, count(*) as count from items group by 1")
def routes(spark, sf_dir):
    d = adapters.items(spark, sf_dir, 1)
    done = F.when(F.col("ord") % 2 == 0, F.lit("done"))
    return publish.translation_routing(d.select(F.when(F.col("category") == "news", "zh-CN").otherwise("en").alias("source_language"), done.alias("title_zh"), done.alias("summary_zh")))


@query("item_ids", f"with {ONE} select ord, {sql.slug('category')} || '-' || {sql.slug('source')} || '-' || substr(sha1(title || '|' || url || '|' || strftime(published_at, '%Y-%m-%dT%H:%M:%S.000Z')), 1, 10) as id from items")
def ids(spark, sf_dir):
    return adapters.items(spark, sf_dir, 1).select("ord", normalize.item_id(F.col("category"), F.col("source"), F.col("title"), F.col("url"), F.col("published_at")).alias("id"))


@query("sort_items", f"with {ONE} select id, credibility as score from items")
def ordered(spark, sf_dir):
    d = adapters.items(spark, sf_dir, 1)
    return score.sort_items(d.select("id", F.col("credibility").alias("score"), "published_at")).select("id", "score")


# Sources --------------------------------------------------------------------------------------------------------------
LAST = f"{HEALTH.format(0).replace('select attempt_id, source, cast', 'select fetched_at, item_count, attempt_id, source, cast')}"


def last_health(spark, sf_dir, which: str = "true") -> DataFrame:
    h = audit.source_health(adapters.attempts(spark, sf_dir).where(which))
    return h.withColumn("r", F.row_number().over(W.partitionBy("source").orderBy(F.desc("fetched_at"), F.desc("attempt_id")))).where("r = 1").drop("r")


LASTS = f"h as ({LAST}), last as (select * from (select *, row_number() over (partition by source order by fetched_at desc, attempt_id desc) as r from h) where r = 1)"


@query("health_summary", f"with {LASTS} select count(*) as sources, count(*) filter (where status = 'healthy') as healthy, count(*) filter (where status = 'empty') as empty, count(*) filter (where status = 'failed') as failed, max(fetched_at) as last_checked_at, count(*) filter (where status = 'failed') > 0 as warning from last")
def health_total(spark, sf_dir):
    return audit.health_summary(last_health(spark, sf_dir))


STATUS = "case when {n} % 4 = 3 then 'paused' when {n} % 4 = 2 then 'limited' when {n} % 4 = 1 then 'reduced' else 'active' end"
N = "cast(substr(source, 4) as int)"


@query("policy_limits", f"with {LASTS}, s as (select source, {STATUS.format(n=N)} as status, nullif({N} % 3, 0) * 20 as m, nullif({N} % 2, 0) * 7 as b from last) select source, status, cast(case status when 'reduced' then greatest(1, ceil(coalesce(m, 30) / 2)) when 'active' then coalesce(m, 30) else least(coalesce(m, 30), 5) end as int) as metadata_limit, cast(case status when 'reduced' then greatest(1, ceil(coalesce(b, 3) / 2)) when 'active' then coalesce(b, 3) else 1 end as int) as body_fetch_quota, cast(case status when 'reduced' then 12 when 'limited' then 24 when 'paused' then 168 else 6 end as int) as minimum_fetch_interval_hours from s")
def limits(spark, sf_dir):
    n = F.substring("source", 4, 9).cast("int")
    s = last_health(spark, sf_dir).select("source", F.expr(STATUS.format(n="cast(substr(source, 4) as int)")).alias("status"), F.nullif(n % 3, F.lit(0)).alias("m"), F.nullif(n % 2, F.lit(0)).alias("b"))
    return audit.policy_limits(s.select("source", "status", (F.col("m") * 20).alias("metadata_limit"), (F.col("b") * 7).alias("body_fetch_quota")))


@query("effective_sources", f"""with {LASTS}, s as (select source, {N} as n, fetched_at, {STATUS.format(n=N)} as status from last),
t as (select *, case when n % 5 = 0 then 'core' when n % 5 = 1 then 'core' when n % 5 in (2, 3) then 'standard' else 'experimental' end as tier, case when n % 3 = 1 then n % 3 * 4 else 6 end as gap, case when n % 7 = 0 then cast(null as timestamp) else timestamp '{NOW}' + to_days(n % 3 - 1) end as probe from s)
select source, tier as source_policy_tier, status as runtime_status, 'why ' || n as runtime_reason, coalesce(probe <= timestamp '{NOW}', true) as probe_due, fetched_at + to_hours(gap) as next_eligible_fetch_at, (n % 6 <> 0) and not (n % 6 <> 0 and status = 'paused' and not coalesce(probe <= timestamp '{NOW}', true)) and not (fetched_at + to_hours(gap) > timestamp '{NOW}') as runtime_fetch_enabled,
cast(case when n % 2 = 1 then n % 2 * 9 else 12 end as int) as metadata_limit, cast(case tier when 'core' then 5 when 'standard' then 3 else 1 end as int) as body_fetch_quota, cast(gap as int) as minimum_fetch_interval_hours from t""")
def effective(spark, sf_dir):
    """Sources of every tier with a policy each: limits of the policy (odd ones), of the source, or by tier."""
    h, n = last_health(spark, sf_dir), F.substring("source", 4, 9).cast("int")
    zero = F.lit(0)
    sources = h.select("source", F.when(n % 5 == 0, "core").otherwise("").alias("source_policy_tier"), F.when(n % 5 == 1, "S").when(n % 5 == 2, "B").otherwise("C").alias("source_tier"), F.when(n % 5 == 3, "official-media").otherwise("blog").alias("source_authority"), F.lit(50.0).alias("credibility"), (n % 6 != 0).alias("enabled"), F.lit(12).alias("max_items"), zero.alias("metadata_limit"))
    probe = F.when(n % 7 != 0, F.lit(NOW).cast("timestamp") + F.make_dt_interval(n % 3 - 1))
    policy = h.select("source", F.expr(STATUS.format(n="cast(substr(source, 4) as int)")).alias("status"), F.concat(F.lit("why "), n.cast("string")).alias("reason"), probe.alias("next_probe_at"), F.col("fetched_at").alias("last_fetched_at"), F.when(n % 2 == 1, 9).otherwise(0).alias("metadata_limit"), F.when(n % 3 == 1, 4).otherwise(0).alias("minimum_fetch_interval_hours"))
    e = audit.effective_sources(sources, policy, NOW)
    return e.select("source", "source_policy_tier", "runtime_status", "runtime_reason", "probe_due", "next_eligible_fetch_at", "runtime_fetch_enabled", "metadata_limit", "body_fetch_quota", "minimum_fetch_interval_hours")


@query("merge_health", f"with {ATTEMPTS}, c as (select source, max(fetched_at) as at, 'now' as side from attempts where stream = 1 group by 1), p as (select source, max(fetched_at) as at, 'before' as side from attempts group by 1) select * from c union all select * from p where source not in (select source from c) and {N} % 5 <> 4")
def merged(spark, sf_dir):
    """The health of one stream's sources over that of all, of which one source in five is no longer active."""
    a = adapters.attempts(spark, sf_dir)
    per = lambda df, side: df.groupBy("source").agg(F.max("fetched_at").alias("at"), F.lit(side).alias("side"))
    active = a.select("source").distinct().where(F.substring("source", 4, 9).cast("int") % 5 != 4)
    return audit.merge_health(per(a, "before"), per(a.where("stream = 1"), "now"), active)


@query("record_runs", f"with {RUNS}, b as (select min(generated_at) as t0, max(generated_at) as t1 from runs), h as (select source, generated_at from runs, b where generated_at <= t0 + interval 10 days), n as (select runs.source, runs.generated_at from runs, b where {N.replace('source', 'runs.source')} % 2 = 0 or runs.generated_at > t0 + interval 15 days) select source, generated_at from (select * from h union select * from n), b where generated_at >= t1 - interval 35 days")
def recorded(spark, sf_dir):
    """Ten days of history and all runs; odd sources were audited up to the fifteenth day."""
    runs = adapters.source_runs(spark, sf_dir).select("source", "generated_at")
    first, last = runs.agg(F.min("generated_at"), F.max("generated_at")).first()
    if first is None:
        return runs
    at = lambda days: F.lit(first) + F.make_dt_interval(F.lit(days))
    audited = runs.select("source").distinct().where(F.substring("source", 4, 9).cast("int") % 2 == 1).withColumn("last_audited_fetch_at", at(15))
    history = runs.where(F.col("generated_at") <= at(10))
    return audit.record_runs(history, runs.withColumn("fetched_at", F.col("generated_at")), audited, str(last)).select("source", "generated_at")


# Market ---------------------------------------------------------------------------------------------------------------


@query("market_quotes", "with o as (select *, o_orderkey % 11 = 0 as bare from orders) select cast(o_custkey as varchar) as symbol, case when bare then 'missing' else 'available' end as status, case when not bare then cast(o_totalprice as double) end as price, case when not bare then cast(o_orderkey % 5 - 2 as double) end as change, case when not bare then (o_orderkey % 7) || '%' end as change_percent, case when not bare then cast(o_orderkey % 7 as double) end as change_percent_value, case when not bare then cast(o_orderkey as double) end as volume, case when not bare then strftime(o_orderdate, '%Y-%m-%d') end as trading_day, cast(o_orderdate as timestamp) as fetched_at from o")
def quotes(spark, sf_dir):
    """Order prices as quote payloads of a symbol a customer; one in eleven is empty."""
    o = table(spark, sf_dir, "orders")
    s = lambda c: c.cast("string")
    cells = {"05. price": s(F.col("o_totalprice")), "09. change": s(F.col("o_orderkey") % 5 - 2), "10. change percent": F.concat(s(F.col("o_orderkey") % 7), F.lit("%")), "06. volume": s(F.col("o_orderkey")), "07. latest trading day": F.date_format("o_orderdate", "yyyy-MM-dd")}
    pay = F.to_json(F.create_map(F.lit("Global Quote"), F.create_map(*[x for k, v in cells.items() for x in (F.lit(k), v)])))
    pay = F.when(F.col("o_orderkey") % 11 == 0, "{}").otherwise(pay)
    return market.normalize_quotes(o.select(F.col("o_custkey").cast("string").alias("symbol"), pay.alias("payload"), F.col("o_orderdate").cast("timestamp").alias("fetched_at")))


@query("market_movers", "select cast(o_custkey as varchar) as symbol, cast(o_totalprice as double) as price, cast(null as double) as change_amount, '3.5%' as change_percent, 3.5::double as change_percent_value, cast(o_orderkey as double) as volume, 'gainer' as direction, o_orderkey as k from orders union all select 'L' || o_custkey, cast(o_totalprice as double), -1.0::double, '-2%', -2.0::double, cast(null as double), 'loser', o_orderkey from orders")
def movers(spark, sf_dir):
    """Orders as payloads of one gainer, one loser, and an active entry without a symbol."""
    o = table(spark, sf_dir, "orders")
    s = lambda c: F.col(c).cast("string")
    gain = F.struct(s("o_custkey").alias("ticker"), s("o_totalprice").alias("price"), F.lit("3.5%").alias("change_percentage"), s("o_orderkey").alias("volume"))
    loss = F.struct(F.concat(F.lit("L"), s("o_custkey")).alias("symbol"), s("o_totalprice").alias("price"), F.lit("-1").alias("changeAmount"), F.lit("-2%").alias("changePercent"))
    pay = F.to_json(F.struct(F.array(gain).alias("top_gainers"), F.array(loss).alias("top_losers"), F.array(F.struct(F.lit("").alias("ticker"))).alias("most_actively_traded")))
    return market.normalize_movers(o.select(pay.alias("payload"), F.col("o_orderkey").alias("fetched_at"))).withColumnRenamed("fetched_at", "k")


@query("market_sentiment", "select cast(page_id as varchar) as symbol, cast(i - 1 as int) as ord, 'news ' || i as title, url, '' as summary, cast(i as double) / 10 as overall_sentiment_score from pages, unnest(range(1, 1 + least(8, page_id % 12))) as t(i)")
def sentiment(spark, sf_dir):
    """Pages as feeds of up to eleven entries, of which eight count."""
    n = (F.col("page_id") % 12).cast("int")
    entry = lambda i: F.struct(F.concat(F.lit("news "), i.cast("string")).alias("title"), F.col("url").alias("url"), (i / 10).cast("string").alias("overall_sentiment_score"))
    feed = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), entry)).otherwise(F.array().cast("array<struct<title:string,url:string,overall_sentiment_score:string>>"))
    p = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("symbol"), F.to_json(F.struct(feed.alias("feed"))).alias("payload"))
    return market.normalize_sentiment(p).select("symbol", "ord", "title", "url", "summary", "overall_sentiment_score")


@query("market_asof", f"""with {ATTEMPTS}, p as (select attempt_id, source, fetched_at, not ok as bad, case when ok then '{{{{"price":"' || item_count || '"}}}}' else '{{{{"Note":"limit"}}}}' end as payload from attempts), l as (select *, last_value(case when not bad then payload end ignore nulls) over (partition by source order by fetched_at, attempt_id rows unbounded preceding) as good from p)
select attempt_id, bad and good is not null as stale, case when bad then coalesce(good, payload) else payload end as payload from l""".replace("{{", "{").replace("}}", "}"))
def asof(spark, sf_dir):
    """Attempts as payloads of a symbol a source; failed ones are notices."""
    a = adapters.attempts(spark, sf_dir)
    pay = F.when(F.col("ok"), F.concat(F.lit('{"price":"'), F.col("item_count").cast("string"), F.lit('"}'))).otherwise('{"Note":"limit"}')
    return market.market_asof(a.select("attempt_id", F.col("source").alias("symbol"), F.lit("quote").alias("function"), pay.alias("payload"), "fetched_at")).select("attempt_id", "stale", "payload")
