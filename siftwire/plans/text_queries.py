"""Row-wise operators over whole documents and pages: text functions, classes, keywords, summaries, candidate values."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from ..operators import candidates, classify, dedupe, events, filters, normalize, publish, score
from . import adapters, sql
from .adapters import EVENTS, NOW, spread, table
from .queries import CLASSED, MANY, SCORED, SCORING, classed, query

UNSURE = sql.quoted("uncertain")
DOC = "doc as (select doc_id, coalesce(text, '') as text, lang from documents)"
DENSE = f"""select *, cast(length(b) as int) as body_length, cast(least(100, least(35, f * 7) + least(20, n * 4) + least(20, e * 3) + case when {sql.hits('b', fixed.BODY_EVIDENCE)} then 15 else 0 end + least(10, cast({sql.half_up('length(b) / 180')} as int))) as int) as content_density, cast(least(20, f + n) as int) as new_fact_count
from (select *, {sql.count('b', fixed.BODY_FACTS)} as f, {sql.count('b', fixed.BODY_NUMBERS, False)} as n, {sql.count('b', fixed.BODY_ENTITIES, False)} as e from {{0}})"""


@query("content_density", f"with {DOC}, d as (select doc_id, {sql.cleaned('text')} as b from doc) select doc_id, body_length, content_density, new_fact_count from ({DENSE.replace('{0}', 'd')})")
def density(spark, sf_dir):
    d = filters.content_density(spread(table(spark, sf_dir, "documents")).select("doc_id", F.col("text").alias("body_text")))
    return d.select("doc_id", "body_length", "content_density", "new_fact_count")


LANG = """case when {given} <> '' then {given} when regexp_matches({t}, '[A-Za-z]') and not regexp_matches({t}, '[\\x{{4e00}}-\\x{{9fff}}]') then 'en' when regexp_matches({t}, '[\\x{{4e00}}-\\x{{9fff}}]') then 'zh' else '' end"""
COUNTS = """case when len(regexp_extract_all({t}, '[A-Za-z]{{2,}}')) >= 6 and len(regexp_extract_all({t}, '[\\x{{4e00}}-\\x{{9fff}}]')) < 6 then 'en' when len(regexp_extract_all({t}, '[\\x{{4e00}}-\\x{{9fff}}]')) >= 6 then 'zh' else 'unknown' end"""
SPLIT = r"(20\d{2})[-/.年](\d{1,2})[-/.月](\d{1,2})"
DAY = f"""case when regexp_extract({{t}}, '(20\\d{{{{2}}}}\\d{{{{2}}}}\\d{{{{2}}}})', 1) <> '' then try_strptime(regexp_extract({{t}}, '(20\\d{{{{2}}}}\\d{{{{2}}}}\\d{{{{2}}}})', 1), '%Y%m%d')
 when regexp_matches({{t}}, '{SPLIT.replace('{', '{{').replace('}', '}}')}') then try_strptime(regexp_extract({{t}}, '{SPLIT.replace('{', '{{').replace('}', '}}')}', 1) || '-' || lpad(regexp_extract({{t}}, '{SPLIT.replace('{', '{{').replace('}', '}}')}', 2), 2, '0') || '-' || lpad(regexp_extract({{t}}, '{SPLIT.replace('{', '{{').replace('}', '}}')}', 3), 2, '0'), '%Y-%m-%d') end"""


@query("text_functions", f"""with {DOC} select doc_id, md5({sql.decoded('text')}) as decoded, {sql.cut('text', 500)} as cut, 'doc-' || substr(sha1(lower({sql.cleaned('text')})), 1, 12) as stable, {sql.slug('text')} as slug,
 {LANG.format(given=f"lower(substr({sql.cleaned('coalesce(lang, chr(32))')}, 1, 8))", t='text')} as language, {LANG.format(given="''", t='text')} as guessed, {COUNTS.format(t='text')} as counted, strftime({DAY.format(t='text')}, '%Y-%m-%d') as day, try_cast(regexp_replace(regexp_extract(text, '[0-9][0-9,.]*%?', 0), '[,%]', '', 'g') as double) as number from doc""")
def text_functions(spark, sf_dir):
    """Each text function over every whole document."""
    d = spread(table(spark, sf_dir, "documents")).select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    t = F.col("text")
    return d.select(
        "doc_id", F.md5(T.decode_html(t)).alias("decoded"), T.truncate_text(t).alias("cut"), T.stable_id("doc-", t).alias("stable"), T.slug(t).alias("slug"), T.detect_language(F.col("lang"), t, F.lit("")).alias("language"), T.detect_language(F.lit(""), t, F.lit("")).alias("guessed"),
        T.detect_language_counts(t).alias("counted"), F.date_format(T.date_in_text(t), "yyyy-MM-dd").alias("day"), T.number(F.regexp_extract(t, "[0-9][0-9,.]*%?", 0)).alias("number"),
    )


@query("parse_dates", f"""with {MANY} select id, 'p' || n as form, case when n < 3 then published_at when n = 3 then date_trunc('minute', published_at) when n = 4 then date_trunc('day', published_at) end as at from items, (select unnest(range(0, 6)) as n)""")
def dates(spark, sf_dir):
    """Times written in six ways, read back; the last is no date."""
    d = adapters.items(spark, sf_dir).withColumn("published_at", F.col("published_at"))
    forms = ["d MMM yyyy HH:mm:ss 'GMT'", "EEE, d MMM yyyy HH:mm:ss 'GMT'", "yyyy-MM-dd'T'HH:mm:ss'Z'", "d MMM yyyy HH:mm 'GMT'", "yyyy-MM-dd", "'soon'"]
    rows = d.select("id", F.posexplode(F.array(*[F.date_format("published_at", f) for f in forms])).alias("n", "t"))
    return rows.select("id", F.concat(F.lit("p"), F.col("n").cast("string")).alias("form"), T.parse_date(F.col("t")).alias("at"))


@query("https_images", r"select page_id, case when regexp_matches(trim(url), '^(?i)https://[^/?#\s]+') then trim(url) else '' end as image from pages")
def images(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.https_image(F.col("url")).alias("image"))


@query("stage_of_progress", f"with {MANY} select id, {sql.first_rule('text', fixed.STAGES, UNSURE)} as stage, {COUNTS.format(t='text')} as language from words")
def stages(spark, sf_dir):
    d = adapters.items(spark, sf_dir)
    return d.select("id", events.infer_stage(T.item_text(d)).alias("stage"), T.detect_language_counts(T.item_text(d)).alias("language"))


# Classes --------------------------------------------------------------------------------------------------------------


def scores_sql(text: str, kind: str) -> str:
    out = []
    for i, (name, p) in enumerate(fixed.CATEGORY_PATTERNS):
        boosts = {k: b for k, (c, b) in fixed.EVENT_CATEGORY_BOOSTS.items() if c == name}
        boost = f"(case {kind} " + " ".join(f"when '{k}' then {b}::double" for k, b in boosts.items()) + " else 0.0::double end)" if boosts else "0.0::double"
        base = f"least(1.0::double, {sql.count(text, p)} * 0.18::double + case when {sql.hits('title', p)} then 0.35::double else 0.0::double end)"
        out.append(f"{{'minus': -({base} + {boost}), 'place': {i}, 'name': '{name}'}}")
    return "[" + ", ".join(out) + "]"


BACK = sql.lookup(fixed.SOURCE_CATEGORIES, "source_category", "'business'")
FACTORS = ", ".join(f"coalesce(nullif(regexp_extract(text, {sql.quoted(p)}, 0), ''), {sql.quoted(fixed.NO_FACTOR)}) as {k}" for k, p in fixed.FACTOR_PATTERNS.items())
NAMES = r"(?:[A-Z][A-Za-z0-9&.-]{2,}|[\x{4e00}-\x{9fff}]{2,10}(?:公司|银行|大学|委员会|部门))"
#: {0}: a table with text, title, source_category and {1}, the event type.
MADE = f"""s0 as (select *, {{1}} as kind, {BACK} as back from {{0}}), s1 as (select *, {{2}} as s from s0), s2 as (select *, list_sort(s) as r from s1),
s3 as (select *, -r[1].minus as top, -r[1].minus + r[2].minus as gap, case when -r[1].minus > 0 then r[1].name else back end as made from s2),
s4 as (select *, case when top > 0 then greatest(0.45::double, least(0.96::double, 0.55::double + top * 0.3::double + greatest(0.0::double, gap) * 0.25::double)) else 0.45::double end as conf, -s[1].minus as tech, -s[2].minus as fin, -list_filter(s, lambda x: x.name = back)[1].minus as own from s3),
made as (select *, (conf < 0.72::double) or (gap < 0.12::double) or (abs(tech - fin) < 0.12::double and greatest(tech, fin) > 0) or (back <> made and own > 0.25::double) or top = 0 as review from s4)"""


def made_sql(of: str, kind: str) -> str:
    return MADE.replace("{0}", of).replace("{1}", kind).replace("{2}", scores_sql("text", "kind"))


@query("classify_items", f"""with {MANY}, w as (select *, category as source_category from words), {made_sql('w', "'other'")},
t as (select *, list_concat({sql.all_rules('text', fixed.SECONDARY_TAGS)}, list_filter(regexp_extract_all(text, '{NAMES}'), lambda x: length(x) <= 24)) as names from made)
select id, made as category, {sql.half_up('conf', 2)} as confidence, case when review then 'review-required' else 'classified' end as status, array_to_string(({sql.distinct('names')})[1:6], '|') as tags, review as requires_review, {FACTORS} from t""")
def classified(spark, sf_dir):
    d = classify.classify_items(adapters.items(spark, sf_dir).withColumn("event_type", F.lit("other")))
    made = [F.col(f"classification.factors.{k}").alias(k) for k in fixed.FACTOR_PATTERNS]
    return d.select("id", "category", F.col("classification.confidence").alias("confidence"), F.col("classification.status").alias("status"), F.array_join("secondary_tags", "|").alias("tags"), "requires_review", *made)


# Candidates -----------------------------------------------------------------------------------------------------------
TOKENS = r"list_distinct(list_filter(string_split_regex(lower(" + sql.cleaned("title") + r"), '[^a-z0-9\x{4e00}-\x{9fa5}]+'), lambda w: length(w) > 1))"
GAIN = f"""tok as (select run_id, ord, id, {TOKENS} as t from items), rec as (select run_id + 1 as run_id, id, t from tok), best as (select a.run_id, a.ord, max(len(list_intersect(a.t, b.t)) / cast(len(a.t) + len(b.t) - len(list_intersect(a.t, b.t)) as double)) as m from tok a join rec b on a.run_id = b.run_id and a.id <> b.id and len(list_intersect(a.t, b.t)) > 0 group by 1, 2),
gain as (select tok.run_id, tok.ord, cast(case when tok.run_id in (select run_id from rec) then greatest(0, floor(20 * (1 - coalesce(m, 0)) + 0.5)) else 16 end as int) as information_gain from tok left join best using (run_id, ord))"""
PRIORITY = ", ".join(sql.quoted(k) for k in fixed.PRIORITY_EVENT_TYPES)
VALUED = f"""{GAIN}, typed as (select weighed.*, information_gain, {sql.first_rule('text', EVENTS, "'other'")} as event_type, {sql.hits('text', fixed.VERIFIABLE_FACTS)} as has_fact from weighed join gain using (run_id, ord)),
{made_sql('typed', 'event_type')},
tiered as (select *, made as candidate_category, case when source_tier = 'S' or source_authority = 'official-agency' then 'core' when source_tier in ('A', 'B') or source_authority = 'official-media' or credibility >= 80 then 'standard' else 'experimental' end as source_policy_tier from made),
summed as (select *, case source_policy_tier when 'core' then 20 when 'standard' then 14 else 7 end + case when event_type in ({PRIORITY}) then 25 when event_type = 'company_update' then 11 when event_type = 'commentary' then 6 else 8 end
 + least(20, case when event_type in ({PRIORITY}) then 14 else 7 end + case when {sql.hits('text', fixed.TOPIC_WORDS)} then 4 else 0 end + case when has_fact then 2 else 0 end) + information_gain
 + case when length({sql.cleaned('title')}) >= 12 then 4 else 0 end + case when length({sql.cleaned('summary')}) >= 50 then 4 else 0 end + case when has_fact then 4 else 0 end + 3
 - case when contains(lower(text), 'zuheit') then 60 else 0 end - case when event_type = 'commentary' and not has_fact then 25 else 0 end as total from tiered),
valued as (select *, cast(greatest(0, least(100, total)) as int) as candidate_value from summed)"""


@query("candidate_values", f"with {MANY}, {CLASSED}, {VALUED} select run_id, id, event_type, source_policy_tier, candidate_category, has_fact, information_gain, candidate_value from valued")
def values(spark, sf_dir):
    d = classed(spark, sf_dir)
    recent = d.select((F.col("run_id") + 1).alias("run_id"), "id", "title")
    v = candidates.candidate_values(d, recent, candidates.SelectionRules(event_types=EVENTS, blocked_patterns=("zuheit",)))
    return v.select("run_id", "id", "event_type", "source_policy_tier", "candidate_category", "has_fact", "information_gain", "candidate_value")


CLUSTER = f"""ct0 as (select *, lower({sql.cleaned('title')}) as low from {{0}}),
ct1 as (select *, list_concat(list_filter(string_split_regex(low, '[^a-z0-9]+'), lambda w: length(w) > 2 and not list_contains({sql.listed(fixed.CLUSTER_STOPWORDS)}, w)), list_filter(regexp_extract_all(low, '[\\x{{4e00}}-\\x{{9fff}}]{{2,10}}(?:公司|银行|大学|委员会|部门|政府)?'), lambda w: not list_contains({sql.listed(fixed.CLUSTER_STOPWORDS)}, w))) as every from ct0),
clustered as (select *, ({sql.distinct('every')})[1:12] as tokens from ct1)""".replace("{{", "{").replace("}}", "}")
KEY = "substr(sha1({0} || ':' || array_to_string(list_sort(tokens[1:6]), '|')), 1, 12)"


@query("cluster_tokens", f"with {MANY}, {CLUSTER.replace('{0}', 'items')} select id, array_to_string(tokens, '|') as tokens, {KEY.format(sql.quoted('other'))} as key from clustered")
def cluster_words(spark, sf_dir):
    t = dedupe.cluster_tokens(F.col("title"))
    return adapters.items(spark, sf_dir).select("id", F.array_join(t, "|").alias("tokens"), dedupe.cluster_key(F.lit("other"), t).alias("key"))


@query("overlap_pairs", f"""with {MANY}, {CLUSTER.replace('{0}', 'items')} select a.run_id, a.ord as a, b.ord as b from clustered a join clustered b on a.run_id = b.run_id and a.ord < b.ord and len(a.tokens) > 0 and len(b.tokens) > 0
where len(list_intersect(a.tokens, b.tokens)) >= 0.5 * least(len(a.tokens), len(b.tokens))""")
def overlaps(spark, sf_dir):
    d = adapters.items(spark, sf_dir).select("run_id", "ord", dedupe.cluster_tokens(F.col("title")).alias("cluster_tokens"))
    return dedupe.overlap_pairs(d, ["run_id"], 0.5)


# Keywords and summaries -----------------------------------------------------------------------------------------------


def keywords_sql(given: str) -> str:
    stop = sql.listed(fixed.ENGLISH_STOPWORDS)
    latin = f"(list_filter(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9+-]{{2,}}'), lambda w: not list_contains({stop}, lower(w))))[1:16]"
    every = f"list_concat({given}, {sql.all_rules('text', fixed.FINE_KEYWORDS)}, {sql.all_rules('text', [(label, p) for _, label, p in fixed.DERIVED_CATEGORIES])}, {latin}, (regexp_extract_all(text, '[\\x{{4e00}}-\\x{{9fff}}]{{2,12}}'))[1:16])"
    return f"list_filter(list_transform({every}, lambda x: {sql.trimmed('regexp_replace(x, ' + chr(39) + '^#' + chr(39) + ', ' + chr(39) * 2 + ')')}), lambda x: x <> '' and length(x) <= 30 and not list_contains({sql.listed(fixed.TECHNICAL_LABELS)}, lower(x)))"


@query("extract_keywords", f"with {MANY}, k as (select id, {keywords_sql('[]::varchar[]')} as l from words) select id, array_to_string(({sql.distinct_ci('l')})[1:8], '|') as keywords from k")
def keywords(spark, sf_dir):
    d = adapters.items(spark, sf_dir)
    return d.select("id", F.array_join(publish.extract_keywords(d), "|").alias("keywords"))


HYPE = sql.quoted("(?i)" + "|".join(fixed.HYPE_TERMS))
SUMMED = f"""e0 as (select *, {sql.cleaned("case when " + sql.trimmed('summary') + " <> '' then summary else title end")} as t from {{0}}),
e1 as (select *, list_filter(string_split(regexp_replace(regexp_replace(t, '([.!?]) +', '\\1' || chr(1), 'g'), '([。！？]) *', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') as s1 from e0), e2 as (select *, list_transform(s1, lambda x: trim(x)) as s from e1),
e3 as (select *, coalesce(list_filter(s, lambda x: length(x) >= 18)[1], s[1], title) as lead from e2),
e4 as (select *, list_filter(list_transform(list_concat([lead], list_filter(s, lambda x: x <> lead)), lambda x: trim(regexp_replace({sql.cut('x', 140)}, {HYPE}, '', 'g'))), lambda x: x <> '') as points, list_filter(list_transform(regexp_extract_all(t, {sql.pattern(score.DATA_PATTERN)}), lambda x: trim(regexp_replace(x, {HYPE}, '', 'g'))), lambda x: x <> '') as found from e3),
summed as (select *, {sql.cut('lead', 90)} as summary_short, ({sql.distinct_ci('points')})[1:5] as summary_points, ({sql.distinct_ci('found')})[1:5] as key_data, case when length(t) >= 120 then 'medium' else 'low' end as confidence from e4)"""


@query("extractive_summary", f"with {MANY}, {SUMMED.replace('{0}', 'words')} select id, summary_short, array_to_string(summary_points, '|') as points, array_to_string(key_data, '|') as key_data, confidence, 'observe' as tracking from summed")
def summaries(spark, sf_dir):
    d = events.extractive_summary(adapters.items(spark, sf_dir))
    return d.select("id", "summary_short", F.array_join("summary_points", "|").alias("points"), F.array_join("key_data", "|").alias("key_data"), "confidence", "tracking")


@query("lead_summary", f"with {MANY}, {SUMMED.replace('{0}', 'words').replace('>= 18', '>= 24')} select id, {sql.cut('lead', 240)} as lead from (select id, coalesce(list_filter(s, lambda x: length(x) >= 24)[1], s[1], '') as lead from e2)")
def leads(spark, sf_dir):
    d = adapters.items(spark, sf_dir)
    return d.select("id", events.lead_summary(T.first_filled(F.col("summary"), F.col("title"), F.lit(""))).alias("lead"))


@query("article_brief", f"""with {MANY}, {SUMMED.replace('{0}', 'words')} select run_id, id, array_to_string(({sql.distinct('summary_points')})[1:4], '|') as facts, source as participants, {sql.first_rule('text', fixed.STAGES, UNSURE)} as stage, array_to_string(key_data, '|') as key_data, case when len(key_data) = 0 then 'background|location|key_data' else 'background|location' end as limitations, url as source_url from summed""")
def brief(spark, sf_dir):
    b = events.article_brief(events.extractive_summary(adapters.items(spark, sf_dir)))
    return b.select("run_id", "id", F.array_join("facts", "|").alias("facts"), F.array_join("participants", "|").alias("participants"), "stage", F.array_join("key_data", "|").alias("key_data"), F.array_join("limitations", "|").alias("limitations"), F.get("sources", F.lit(0))["url"].alias("source_url"))


@query("grounding_check", r"""with c as (select conv_id, turn, text as output, lag(text) over (partition by conv_id order by turn) as input from conversations), n as (select *, list_filter(list_distinct(regexp_extract_all(coalesce(output, ''), '\d+(?:\.\d+)?%?')), lambda x: not list_contains(regexp_extract_all(input, '\d+(?:\.\d+)?%?'), x)) as a, list_filter(list_distinct(regexp_extract_all(coalesce(output, ''), 'https?://[^\s)"''<>]+')), lambda x: not list_contains(regexp_extract_all(input, 'https?://[^\s)"''<>]+'), x)) as b from c where input is not null)
select conv_id, turn, array_to_string(list_sort(list_concat(a, b)), '|') as ungrounded, len(a) + len(b) = 0 as grounded, length(coalesce(output, '')) between 1 and 2000 as fits from n""")
def grounded(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    prev = F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))
    d = c.withColumn("input", prev).withColumn("output", F.col("text")).where("input is not null")
    return events.grounding_check(d, least=1, most=2000).select("conv_id", "turn", F.array_join(F.array_sort("ungrounded"), "|").alias("ungrounded"), "grounded", "fits")


# Scores ---------------------------------------------------------------------------------------------------------------
AREAS = "case when len(impact_areas) > 0 then ' ' || array_to_string(impact_areas, ' ') else '' end"
#: {0}: a scored table; {1}: its number of duplicates.
IMPORTANT = f"""i0 as (select *, trim(text || {AREAS}) as itext from {{0}}),
important as (select *, cast(greatest(0, least(100, {sql.half_up('score * 0.32::double')} + case when source_authority in ('official-agency', 'official-market', 'official-media') then 24 when source_authority = 'financial-media' then 18 when source_authority = 'media' then 12 else 8 end
 + case when len(impact_areas) > 0 then 10 else 0 end + case when {sql.hits('itext', score.TOPIC_PATTERN)} then 18 else 0 end + case when {sql.hits('itext', score.DATA_PATTERN)} then 10 else 0 end + case when {sql.hits('itext', score.ACTION_PATTERN)} then 8 else 0 end + least(6, ({{1}}) * 2))) as int) as importance_score from i0)"""


def important_sql(of: str, duplicates: str = "0") -> str:
    return IMPORTANT.replace("{0}", of).replace("{1}", duplicates).replace("{{", "{").replace("}}", "}")


ALL_SCORED = f"{MANY}, {CLASSED}, {SCORED.format('weighed', '0')}, {important_sql('scored')}"


@query("importance_score", f"with {ALL_SCORED} select id, importance_score from important")
def importance(spark, sf_dir):
    return score.score_items(classed(spark, sf_dir), NOW, SCORING).select("id", "importance_score")


CLAMP = "greatest(0.0::double, least(100.0::double, floor(({0})::double + 0.5::double)))"
POOL = f"lower(title || ' ' || summary || {AREAS})"
FRESH = "case when age <= 6 then 100.0::double when age <= 24 then 92 - age * 1.5::double when age <= 72 then 62 - (age - 24) * 0.8::double else 20.0::double end"
HOT = f"""h0 as (select *, {POOL} as pool, least(24, len(impact_areas) * 8) as wide from important where source_tier not in ('C', 'D')),
h1 as (select *, {CLAMP.format("case source_tier when 'S' then 96 when 'A' then 86 else 72 end")} as trust, {CLAMP.format("45 + case when source_authority in ('official-agency', 'official-media') then 10 else 0 end")} as multi,
 {CLAMP.format("greatest(case when importance_score <> 0 then importance_score::double else score end, relevance, 52 + wide)")} as impact, {CLAMP.format(f"35 + case when category in ('finance', 'business', 'macro') then 18 else 0 end + case when {sql.hits('pool', fixed.MARKET_POOL, False)} then 22 else 0 end")} as market,
 {CLAMP.format("38 + case when len(impact_areas) >= 2 then 6 else 0 end")} as follow, {CLAMP.format(FRESH)} as fresh,
 case when {sql.hits('pool', fixed.UNCERTAIN_POOL, False)} then 8 else 0 end as doubt, case when {sql.hits('title', fixed.CLICKBAIT, False)} then 10 else 0 end as bait, case when relevance < 45 then 12 else 0 end as poor from h0),
h2 as (select *, {CLAMP.format("trust * 0.20::double + multi * 0.20::double + impact * 0.20::double + market * 0.15::double + follow * 0.15::double + fresh * 0.10::double - doubt - bait - poor")} as top_score,
 case when len(impact_areas) > 0 then lower(array_to_string(impact_areas[1:2], '|')) else substr(lower(case when {sql.trimmed('title')} <> '' then title else '未命名信息' end), 1, 24) end as hotspot_key from h1),
h3 as (select *, row_number() over (partition by run_id, hotspot_key order by top_score desc, importance_score desc, published_at desc, id) as r from h2)"""


@query("top_hotspots", f"with {ALL_SCORED}, {HOT}, h4 as (select *, row_number() over (partition by run_id order by top_score desc, importance_score desc, published_at desc, id) as n from h3 where r = 1) select run_id, cast(n as int) as hotspot_rank, id, hotspot_key, top_score from h4 where n <= 5")
def hotspots(spark, sf_dir):
    return score.top_hotspots(score.score_items(classed(spark, sf_dir), NOW, SCORING), NOW).select("run_id", "hotspot_rank", "id", "hotspot_key", "top_score")


FINAL = f"""{MANY}, {CLASSED}, {VALUED}, {CLUSTER.replace('{0}', 'valued')}, keyed as (select *, {KEY.format('event_type')} as event_cluster_key from clustered),
dense as ({DENSE.replace('{0}', f"(select *, {sql.cleaned('summary')} as b from keyed)")}),
reviewed as (select * exclude (category, s, r, f, n, e), made as category, case when {sql.trimmed('summary')} = '' then case when candidate_value >= 75 then 'metadata-only' else 'rejected' end when content_density < case when source_authority = 'official-agency' then 45 else 55 end then 'rejected' else 'accepted' end as content_review_status from dense),
{SCORED.format('reviewed', '0')}, src as (select run_id, event_cluster_key, count(distinct source) as n from scored group by 1, 2)"""


@query("final_scores", f"""with {FINAL} select run_id, id, event_cluster_key, n as independent_source_count, content_review_status, greatest(0.0::double, least(100.0::double, {sql.half_up(f"0.0::double + score + (content_density - 55) * 0.12::double + (candidate_value - 60) * 0.1::double + {sql.half_up('conf', 2)} * 5 + least(6, (n - 1) * 2) + case when content_review_status = 'metadata-only' then -8 else 0 end", 2)})) as score from scored join src using (run_id, event_cluster_key)""")
def finals(spark, sf_dir):
    """Every candidate, its cluster being that of its own tokens; items without text after the title have no body."""
    d = classed(spark, sf_dir)
    recent = d.select((F.col("run_id") + 1).alias("run_id"), "id", "title")
    v = candidates.candidate_values(d, recent, candidates.SelectionRules(event_types=EVENTS, blocked_patterns=("zuheit",)))
    v = v.withColumn("event_cluster_key", dedupe.cluster_key(F.col("event_type"), dedupe.cluster_tokens(F.col("title"))))
    v = v.withColumn("body_fetch_status", F.when(T.trim_ws(F.col("summary")) == "", "failed").otherwise("success"))
    v = filters.review_content(filters.content_density(v.withColumn("content_excerpt", F.col("summary")))).drop("content_excerpt")
    return score.final_scores(score.score_items(classify.classify_items(v), NOW, SCORING)).select("run_id", "id", "event_cluster_key", "independent_source_count", "content_review_status", "score")


@query("normalize_raw_records", f"""with {MANY}, n0 as (select *, {sql.decoded("case when " + sql.trimmed('title') + " <> '' then title else 'Untitled item' end")} as t, {sql.decoded('summary')} as s from items), n1 as (select *, {sql.cut('s', 500)} as x from n0), n2 as (select *, {sql.cleaned("t || ' ' || s || ' ' || x")} as text from n1),
n3 as (select run_id, ord, t, s, x, text, url, source, category as source_category, published_at, credibility, source_authority, {LANG.format(given="''", t="(t || ' ' || case when " + sql.trimmed('s') + " <> '' then s else '' end)")} as source_language, {sql.first_rule('text', [(label, p) for label, _, p in fixed.DERIVED_CATEGORIES], 'category')} as made, ({sql.all_rules('text', [(label, p) for _, label, p in fixed.DERIVED_CATEGORIES])})[1:4] as areas from n2)
select run_id, ord, t as title, url, source, source_category, published_at, md5(s) as summary, x as content_excerpt, credibility, source_language, made as category, array_to_string(areas, ',') as areas, {sql.slug('made')} || '-' || {sql.slug('source')} || '-' || substr(sha1(t || '|' || url || '|' || strftime(published_at, '%Y-%m-%dT%H:%M:%S.000Z')), 1, 10) as id from n3""")
def normalize_raw(spark, sf_dir):
    """Documents as landed raw records, through the whole projection."""
    d = adapters.items(spark, sf_dir)
    raw = d.select("run_id", "ord", F.col("source").alias("source_name"), F.col("category"), F.col("credibility").cast("string").alias("credibility"), "source_authority", F.col("title"), F.col("url").alias("link"), F.date_format("published_at", "d MMM yyyy HH:mm:ss 'GMT'").alias("pub_date"), F.col("summary").alias("description"), "fetched_at")
    n = normalize.normalize_items(raw)
    return n.select("run_id", "ord", "title", "url", "source", "source_category", "published_at", F.md5("summary").alias("summary"), "content_excerpt", "credibility", "source_language", "category", F.array_join("impact_areas", ",").alias("areas"), "id")

