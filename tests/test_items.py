"""Text functions, normalising, filtering, scoring, publishing, search: expected values worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from siftwire.functions import fixed
from siftwire.functions import text as T
from siftwire.operators import classify, events, filters, normalize, publish, score, search
from siftwire.sources import html, market, records

NOW = "2026-07-10 00:00:00"
ITEM = "run_id long, ord long, id string, source_id string, title string, url string, source string, source_type string, category string, source_category string, published_at timestamp, published_at_inferred boolean, summary string, content_excerpt string, credibility double, source_authority string, source_tier string, timeliness_tier string, evidence_type string, evidence_weight int, tags array<string>, impact_areas array<string>, source_language string, duplicate_count int"


def item(**k):
    base = dict(run_id=0, ord=0, id="i", source_id="s", title="A title of some length", url="https://e.com/a", source="Src", source_type="rss", category="tech", source_category="tech", published_at=dt.datetime(2026, 7, 9), published_at_inferred=False, summary="", content_excerpt="", credibility=70.0, source_authority="media", source_tier="B", timeliness_tier="daily", evidence_type="unknown", evidence_weight=20, tags=[], impact_areas=[], source_language="en", duplicate_count=0)
    return {**base, **k}


def frame(spark, *rows):
    return spark.createDataFrame([item(ord=i, id=f"i{i}", **r) if "id" not in r else item(ord=i, **r) for i, r in enumerate(rows)], ITEM)


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(("given", "want"), [
    ("https://E.com/a/?utm_source=x&b=1&ref=y#top", "https://e.com/a/?b=1"), ("http://e.com/a/", "http://e.com/a"), ("https://e.com", "https://e.com"), ("https://e.com:443/x", "https://e.com/x"),
    ("http://e.com:8080/x", "http://e.com:8080/x"), ("javascript:alert(1)", ""), ("not an address", ""), (None, ""), ("https://e.com/?Ref=1", "https://e.com/?Ref=1"),
])
def test_canonical_url(spark, given, want):
    assert one(spark, T.canonical_url(F.col("u")), u=given) == want


def test_text_functions(spark):
    assert one(spark, T.clean_text(F.col("t")), t=" <b>a</b> 　 b\n") == "a b"
    assert one(spark, T.decode_html(F.col("t")), t="A &amp;lt; B &quot;c&#39;") == "A < B \"c'"
    assert one(spark, T.truncate_text(F.col("t"), 8), t="abcd efghij") == "abcd..."
    assert one(spark, T.slug(F.col("t")), t="Top News!! 2") == "top-news-2" and one(spark, T.slug(F.col("t")), t="新闻") == "item"
    assert one(spark, T.title_tokens(F.col("t")), t="The AI, the 芯片 a") == ["the", "ai", "芯片"]
    assert one(spark, T.hits(F.col("t"), r"\bAI\b"), t="人AI人") and not one(spark, T.hits(F.col("t"), r"\bAI\b"), t="said")
    assert one(spark, T.detect_language(F.lit(None).cast("string"), F.col("a"), F.col("b")), a="Fed raises", b="x") == "en"
    assert one(spark, T.detect_language(F.lit(""), F.col("a"), F.col("b")), a="财报 x", b="") == "zh"
    assert one(spark, T.half_up(F.col("t").cast("double")), t="-2.5") == -2.0
    assert one(spark, T.distinct_ignoring_case(F.split("t", ",")), t="AI,ai,Chip,AI,x") == ["AI", "Chip", "x"]
    assert one(spark, T.iso_week(F.col("t").cast("timestamp")), t="2027-01-01") == "2026-W53"


@pytest.mark.parametrize(("given", "want"), [
    ("2026-07-09T10:00:00Z", "2026-07-09 10:00:00"), ("2026-07-09", "2026-07-09 00:00:00"), ("Thu, 09 Jul 2026 10:00:00 GMT", "2026-07-09 10:00:00"), ("9 Jul 2026 10:00:00 +0200", "2026-07-09 08:00:00"), ("soon", None), (None, None),
])
def test_parse_date(spark, given, want):
    got = one(spark, F.date_format(T.parse_date(F.col("d")), "yyyy-MM-dd HH:mm:ss"), d=given)
    assert got == want


def test_date_in_text(spark):
    day = lambda t: one(spark, F.date_format(T.date_in_text(F.col("d")), "yyyy-MM-dd"), d=t)
    assert (day("/art/20260709/x.html"), day("2026年7月9日"), day("2026-7-09"), day("none")) == ("2026-07-09", "2026-07-09", "2026-07-09", None)


def test_normalize_raw(spark):
    raw = [
        ("Reuters", None, None, "<b>Fed</b> announces rate decision", "https://e.com/a?utm_source=x", "Thu, 09 Jul 2026 10:00:00 GMT", "earnings &amp; more", dt.datetime(2026, 7, 10)),
        ("Some Blog", None, None, "An opinion", "javascript:x", None, None, dt.datetime(2026, 7, 10)),
        ("Agency", "official-agency", "business", None, "https://e.com/b", "x", "监管政策", dt.datetime(2026, 7, 10)),
    ]
    df = spark.createDataFrame(raw, "source_name string, source_authority string, category string, title string, link string, pub_date string, description string, fetched_at timestamp")
    a, b, c = normalize.normalize_items(df).orderBy("source").collect()[::-1][1], normalize.normalize_items(df).where("source = 'Some Blog'").first(), normalize.normalize_items(df).where("source = 'Agency'").first()
    assert a.source == "Reuters" and a.title == "Fed announces rate decision" and a.url == "https://e.com/a" and a.category == "macro" and a.primary_category == "news" and a.source_tier == "A" and a.evidence_type == "financial_report"
    assert not a.published_at_inferred and a.id.startswith("macro-reuters-") and len(a.id.split("-")[-1]) == 10 and a.credibility == 70.0 and a.impact_areas == ["宏观", "商业"]
    assert b.source_tier == "C" and b.url == "" and b.published_at_inferred and b.published_at == dt.datetime(2026, 7, 10)
    assert c.title == "Untitled item" and c.source_tier == "S" and c.evidence_type == "regulatory_document" and c.published_at == dt.datetime(2026, 7, 10) and not c.published_at_inferred


def test_filter_reasons(spark):
    df = frame(
        spark, {}, {"url": ""}, {"category": "sport"}, {"source_tier": "D"}, {"title": "Coupon of the day"}, {"title": "short"}, {"summary": "an affiliate link here"}, {"published_at": dt.datetime(2026, 7, 8)}, {"published_at": dt.datetime(2026, 7, 7, 23, 59, 59)},
        {"published_at": dt.datetime(2026, 7, 4), "evidence_type": "research_paper"}, {"published_at": dt.datetime(2026, 7, 4), "summary": "new policy"},
    )
    got = [r.filter_reasons for r in filters.filter_reasons(df, NOW).orderBy("ord").collect()]
    assert got == [[], ["missing-url"], ["category-not-allowed"], ["blocked-source-tier:D"], ["blocked-term:coupon", "low-value-title:coupon"], ["title-too-short"], ["low-value-content:affiliate link"], [], ["too-old"], [], []]
    kept, gone = filters.filter_items(df, NOW)
    assert kept.count() == 4 and gone.count() == 7
    assert filters.filter_items(frame(spark, {"published_at_inferred": True}), NOW, filters.FilterRules(require_published_at=True))[1].first().filter_reasons == ["missing-published-at"]


def test_review_and_density(spark):
    rows = [(80, "failed", "media", 0), (70, "failed", "media", 0), (80, "disabled", "media", 0), (90, None, "media", 90), (60, "success", "official-agency", 50), (60, "success", "media", 50)]
    df = spark.createDataFrame(rows, "candidate_value int, body_fetch_status string, source_authority string, content_density int")
    got = [(r.content_review_status, r.content_review_reason) for r in filters.review_content(df).collect()]
    assert got == [("metadata-only", "body-fetch-failed"), ("rejected", "body-fetch-failed"), ("metadata-only", "body-fetch-disabled"), ("rejected", "body-fetch-status-missing"), ("accepted", "content-density-passed"), ("rejected", "low-content-density")]
    d = filters.content_density(spark.createDataFrame([("Acme announced 3 deals and reported 5 in an official report",)], "body_text string")).first()
    # Facts announced, reported; numbers 3, 5; entity Acme; evidence official/report; 58 characters round to 0.
    assert (d.content_density, d.new_fact_count) == (14 + 8 + 3 + 15, 4)


def test_scores(spark):
    a = score.score_items(frame(spark, {"source_authority": "official-agency", "source_tier": "S", "evidence_type": "data_release", "evidence_weight": 90, "published_at": dt.datetime(2026, 7, 10), "duplicate_count": 1, "title": "Inflation data released", "credibility": 90.0, "category": "macro", "impact_areas": ["宏观"]}), NOW).first()
    # Relevance: 15 + keyword inflation 5 + area 8 + evidence round(22.5) = 23 + fact 15 - passing mention 15 = 51.
    assert a.event_relevance_score == 51 and [k.term for k in a.keyword_hits] == ["inflation"]
    want = 38 + 28.8 + 18 + 6 + 4 + 0 + 5 + 8 + 6 + 1 + 5 + 0.18 - 2
    assert a.score == min(100, int(want + 0.5)) and a.score_breakdown.official_boost == 5
    c = score.score_items(frame(spark, {"source_tier": "C", "evidence_type": "expert_opinion", "evidence_weight": 60}), NOW).first()
    assert c.score_breakdown.tier_boost == -18 and c.score_breakdown.relevance_penalty == 10 and c.score < a.score
    half = score.score_items(frame(spark, {"published_at": dt.datetime(2026, 7, 6, 12)}), NOW).first()
    assert abs(half.score_breakdown.freshness - 9) < 1e-9


def test_hotspots_one_a_key_without_low_tiers(spark):
    df = frame(spark, {"impact_areas": ["a", "b"]}, {"impact_areas": ["a", "b"], "duplicate_count": 3}, {"impact_areas": ["c"], "source_tier": "C"}, {"title": "Another thing", "impact_areas": ["d"]}).withColumn("score", F.lit(50.0)).withColumn("importance_score", F.lit(50))
    got = score.top_hotspots(df, NOW).orderBy("hotspot_rank").collect()
    assert [r.id for r in got] == ["i1", "i3"] and got[0].hotspot.multi_source_score == 45 + 40
    preset = score.hotspot_scores(df.withColumn("top_score", F.lit(99.0)), NOW).first()
    assert preset.top_score == 99


def test_classify(spark):
    df = frame(spark, {"title": "New chip software for developers", "summary": "cloud model"}, {"title": "Nothing here", "source_category": "finance"}).withColumn("event_type", F.lit("other"))
    a, b = classify.classify_items(df).orderBy("ord").collect()
    assert a.category == "technology" and a.classification.status in ("classified", "review-required") and a.classification.confidence == 0.96 and "软件与开发者" in a.secondary_tags
    assert b.category == "finance" and b.requires_review and b.classification.confidence == 0.45
    assert a.classification_scores["technology"] == 1.0


def test_publish_and_feed(spark):
    rows = [{"category": "technology", "title": f"Item number {i}"} for i in range(5)] + [{"category": "policy", "source_language": "zh", "title": "政策 发布"}]
    df = frame(spark, *rows).withColumn("score", F.col("ord").cast("double")).withColumn("importance_score", F.lit(1))
    p = publish.publish_items(df)
    got = {r.id: r for r in p.collect()}
    assert got["i0"].display_channel == "tech" and got["i0"].translation_status == "pending" and got["i5"].display_channel == "news" and got["i5"].translation_status == "not_required" and got["i5"].title_zh == "政策 发布"
    feed = [(r.channel, r.rank, r.id, r.channel_count) for r in publish.channel_feed(p, {"tech": 2}, 3).orderBy("channel", "rank").collect()]
    assert feed == [("news", 1, "i5", 1), ("tech", 1, "i4", 5), ("tech", 2, "i3", 5)]
    day = df.withColumn("date", F.to_date("published_at"))
    many = day.crossJoin(spark.range(9).withColumnRenamed("id", "n")).where("category = 'technology'").withColumn("id", F.concat("id", F.lit("-"), "n"))
    assert publish.archive_items(many).count() == 20
    runs = spark.createDataFrame([(1,), (2,), (3,), (4,)], "run_id long")
    assert [(r.run_id, r.from_run) for r in publish.latest_or_previous(runs, runs.where("run_id in (2, 4)")).orderBy("run_id").collect()] == [(1, None), (2, 2), (3, 2), (4, 4)]


def test_search(spark):
    df = frame(
        spark, {"title": "Semiconductor exports", "summary": "trade"}, {"title": "Trade talks", "summary": "a chip maker", "category": "finance"}, {"title": "Weather", "summary": "rain"}, {"title": "Chip trade", "source": "Other", "source_authority": "official-media"},
    ).withColumn("score", F.lit(50.0) - F.col("ord"))
    q = spark.createDataFrame([("and", "all", "all", "芯片 trade", 0.0), ("none", "all", "Src", "weather trade", 0.0), ("relax", "all", "Other", "weather", 0.0), ("all", "all", "all", "", 0.0), ("floor", "finance", "all", "", 49.5)], "query_id string, channel string, source string, keyword string, min_score double")
    hits = lambda f: {(r.query_id, r.rank): r.id for r in f.collect()}
    got = hits(search.search_items(df, q, NOW))
    assert [got[("and", i)] for i in (1, 2, 3)] == ["i3", "i0", "i1"] and ("none", 1) not in got and [got[("all", i)] for i in (1, 2, 3, 4)] == ["i0", "i1", "i2", "i3"] and ("floor", 1) not in got
    relaxed = search.search_relaxed(df, q, NOW).where("query_id = 'relax'").first()
    assert relaxed.id == "i2" and relaxed.source_relaxed
    page = search.result_page(search.search_items(df, q, NOW), 3).where("query_id = 'all'").collect()
    assert len(page) == 3 and page[0].total == 4 and page[0].remaining == 1


def test_feed_xml(spark):
    xml = """<rss><item><title><![CDATA[A & B]]></title><link>https://e.com/1</link><guid>g1</guid><pubDate>Thu, 09 Jul 2026 10:00:00 GMT</pubDate><description>x &lt;img src="https://i/d.png"&gt;</description><category>c1</category><category>c2</category></item>
    <entry><title>T</title><link href="https://e.com/2"/><id>g2</id><updated>2026-07-09</updated><media:content url="https://i/m.png" medium="image"/></entry></rss>"""
    a, b = records.parse_feed_items(spark.createDataFrame([("s", xml)], "source_id string, xml string")).orderBy("ord").collect()
    assert (a.title, a.link, a.guid, a.categories, a.feed_image_url) == ("A & B", "https://e.com/1", "g1", ["c1", "c2"], "https://i/d.png")
    assert (b.title, b.link, b.guid, b.pub_date, b.feed_image_url) == ("T", "https://e.com/2", "g2", "2026-07-09", "https://i/m.png")


def test_api_bodies(spark):
    bodies = ['[{"title":"a"}]', '{"items":[{"title":"b"},{"title":"c"}]}', '{"articles":[{"title":"d"}]}', '{"data":[{"title":"e"}]}', '{"title":"f"}', "", None]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "n int, body string")
    got = records.explode_api_body(df).orderBy("n", "ord").collect()
    assert [(r.n, r.title) for r in got] == [(0, "a"), (1, "b"), (1, "c"), (2, "d"), (3, "e"), (4, "f")]
    assert [r.c for r in df.select("n", records.api_item_count(F.col("body")).alias("c")).orderBy("n").collect()] == [1, 2, 0, 1, 0, 0, 0]


def test_articles(spark):
    long = "This is a paragraph that is long enough to count as an article text."
    pages = [
        (1, "https://e.com/1?utm_source=x", f'<html><head><meta name="description" content="meta text that is long enough"><meta property="og:image" content="/i.png"></head><body><nav>menu</nav><article><p>{long}</p><p>short</p></article></body></html>'),
        (2, "https://e.com/2", '<head><meta property="og:description" content="Only a description, long enough to keep"></head><body><p>x</p></body>'),
        (3, "https://e.com/3", "<article>2026-07-09</article>"), (4, "https://e.com/4", f'<script type="application/ld+json">{{"@graph":[{{"articleBody":"{long} From data."}}]}}</script><article><p>{long}</p></article>'),
        (5, "https://e.com/5", f"<div class='TRS_Editor x'>{long}, 2026-07-09</div><script>var a = 1</script>"), (6, "https://e.com/6", None),
    ]
    got = {r.page_id: r for r in html.extract_articles(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[1].body_text == long and got[1].url == "https://e.com/1" and got[1].image_url == "https://e.com/i.png" and got[1].excerpt_source == "article"
    assert got[2].content_excerpt == "Only a description, long enough to keep" and got[2].excerpt_source == "meta" and got[3].content_excerpt == "" and got[4].body_text == long + " From data."
    assert got[5].content_excerpt == long and got[5].body_text.endswith("2026-07-09") and got[6].body_text == ""
    items = frame(spark, {"url": "https://e.com/1"}, {"url": "https://e.com/none", "summary": "feed text"}, {"url": "https://e.com/2", "source_id": "off"})
    sources = spark.createDataFrame([("off", False), ("s", True)], "source_id string, enrichment_enabled boolean")
    out = html.enrich_items(items, html.extract_articles(spark.createDataFrame(pages, "page_id long, url string, html string")), sources).orderBy("ord").collect()
    assert [r.body_fetch_status for r in out] == ["success", "failed", "disabled"] and out[1].content_excerpt == "feed text"


def test_page_links(spark):
    page = [(1, "https://e.com/list/", '<a href="a/20260709/x.html">First news here</a><a href="/b">First news here</a><a href="a/20260709/x.html">First news here</a><a href="https://o.com/">更多</a>')]
    got = html.extract_page_links(spark.createDataFrame(page, "page_id long, url string, html string")).orderBy("ord").collect()
    assert [(r.title, r.link) for r in got] == [("First news here", "https://e.com/list/a/20260709/x.html"), ("First news here", "https://e.com/b"), ("更多", "https://o.com/")]
    links = spark.createDataFrame([("s", r.title, r.link, r.published_at) for r in got], "source_id string, title string, link string, published_at timestamp")
    sources = spark.createDataFrame([("s", "e\\.com", None, True)], "source_id string, include_url_pattern string, exclude_title_pattern string, require_published_date boolean")
    assert [r.link for r in filters.keep_links(links, sources).collect()] == ["https://e.com/list/a/20260709/x.html"]


def test_page_links_of_scripts_and_days_of_the_element_around(spark):
    page = """<a href="/">首页</a><ul><li><a href="./202605/t20260529_1.html">First of the list</a></li><li><a href="x.html">Second of the list</a> <span>2026-5-7</span></li><li>plain <a href="y.html">Third of the list</a>
    <script>var curHref = './t20260530_620831.html'; var curTitle ='Fourth of the list';</script>"""
    got = html.extract_page_links(spark.createDataFrame([(1, "https://e.com/l/", page), (2, None, None)], "page_id long, url string, html string")).orderBy("ord").collect()
    day = lambda *x: dt.datetime(2026, 5, *x)
    assert [(r.title, r.link, r.published_at) for r in got] == [("首页", "https://e.com/", day(7)), ("First of the list", "https://e.com/l/202605/t20260529_1.html", day(29)), ("Second of the list", "https://e.com/l/x.html", day(7)), ("Third of the list", "https://e.com/l/y.html", None), ("Fourth of the list", "https://e.com/l/t20260530_620831.html", day(30))]


def test_raw_records_are_read_whole(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"source_id": "s", "category": "tech",\n "items": [{"title": "One"}, {"title": "Two", "link": "https://e.com/2"}]}]')
    rows = records.explode_records(records.read_raw_records(spark, str(tmp_path / "*.json"))).orderBy("ord").collect()
    assert [(r.source_id, r.ord, r.title, r.link) for r in rows] == [("s", 0, "One", None), ("s", 1, "Two", "https://e.com/2")]
    assert records.read_raw_records(spark, str(tmp_path / "none")).count() == 0


def test_word_boundaries_equal_the_plain_ones(spark):
    """Patterns whose boundaries are looked at after a letter match where the plain boundary does."""
    texts = ["ai", "AI chip", "said", "the AI.", "ai2", "_ai", "gdp-war", "wars", "war", "x war", "12%", "a12", "12a", "é ai é", "日ai日"]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    for p in (r"\bAI\b|\bwar\b", r"fed\b|\bgdp", r"\b\d+%?\b"):
        plain = "(?iu)" + p.replace(r"\b", T.BOUNDARY)
        assert df.where(T.hits(F.col("t"), p) != F.col("t").rlike(plain)).count() == 0


def test_market(spark):
    pay = lambda *rows: spark.createDataFrame([("IBM", "q", p, dt.datetime(2026, 7, i + 1)) for i, p in enumerate(rows)], "symbol string, function string, payload string, fetched_at timestamp")
    q = market.normalize_quotes(pay('{"Global Quote":{"05. price":"1,234.5","09. change":"-2","10. change percent":"-0.16%","06. volume":"10,000","07. latest trading day":"2026-07-09"}}', "{}")).orderBy("fetched_at").collect()
    assert (q[0].price, q[0].change, q[0].change_percent_value, q[0].volume, q[0].status) == (1234.5, -2.0, -0.16, 10000.0, "available") and q[1].status == "missing" and q[1].price is None
    m = market.normalize_movers(pay('{"top_gainers":[{"ticker":"A","price":"1","change_percentage":"5%"},{"price":"2"}],"top_losers":[{"symbol":"B"}]}')).collect()
    assert sorted((r.symbol, r.direction) for r in m) == [("A", "gainer"), ("B", "loser")]
    s = market.market_asof(pay('{"a":1}', '{"Note":"limit"}', '{"b":2}')).orderBy("fetched_at").collect()
    assert [(r.payload, r.stale) for r in s] == [('{"a":1}', False), ('{"a":1}', True), ('{"b":2}', False)]


def test_summaries_and_grounding(spark):
    assert one(spark, events.infer_stage(F.col("t")), t="The rule took effect today") == "implemented" and one(spark, events.infer_stage(F.col("t")), t="x") == "uncertain"
    assert one(spark, score.key_data(F.col("t")), t="up 3% to 20亿元, 3% again") == ["up 3", "to 20", "3%"]
    df = spark.createDataFrame([("up 5% and 7", "5% in 2026"), ("see https://a.b/c", "https://a.b/c")], "output string, input string")
    assert [(r.grounded, r.ungrounded) for r in events.grounding_check(df).collect()] == [(False, ["7"]), (True, [])]


def test_daily_events(spark):
    df = frame(spark, {"title": "Event one", "source": "A", "url": "https://a/1", "summary": "fact one"}, {"title": "Event one again", "source": "B", "url": "https://b/1", "summary": "fact two"}, {"title": "Other", "source": "A", "url": "https://a/2", "summary": "fact three"})
    df = df.withColumn("event_cluster_key", F.when(F.col("ord") < 2, "k1").otherwise("k2")).withColumn("event_type", F.lit("other")).withColumn("score", F.lit(90.0) - F.col("ord") * 10).withColumn("importance_score", F.col("score").cast("int"))
    a, b = events.daily_events(df).orderBy("rank").collect()
    assert a.source_count == 2 and a.confirmed_facts == ["fact one", "fact two"] and a.related_item_ids == ["i0", "i1"] and a.evidence_gaps == [] and a.primary_source.url == "https://a/1"
    assert b.evidence_gaps == ["single-source"] and b.rank == 2


def test_daily_events_keep_all_members_and_sources(spark):
    df = frame(spark, *({"id": f"i{i:03}", "url": f"https://a/{i:03}"} for i in range(450)))
    df = df.withColumn("event_cluster_key", F.lit("k")).withColumn("score", F.lit(900.0) - F.col("ord"))
    (a,) = events.daily_events(df).collect()
    (b,) = events.daily_events(df, arrays=False).collect()
    assert b.primary_source == a.primary_source and b.source_count == a.source_count and "related_item_ids" not in b and "supporting_sources" not in b
    assert a.related_item_ids == [f"i{i:03}" for i in range(450)] and a.source_count == 450
    assert [a.primary_source.url, *[x.url for x in a.supporting_sources]] == [f"https://a/{i:03}" for i in range(450)]
    members = events.event_members(df)
    assert members.count() == 450 and events.event_sources(members).count() == 450


def test_daily_brief_key_data_watch_and_dated_rows(spark):
    data = "array<struct<metric:string,value:string,comparison:string,meaning:string,source_url:string>>"
    watch = "array<struct<variable:string,time_window:string>>"
    full = lambda i: (f"m{i}", "1", "2", "why", "u")
    rows = [(1, f"e{i}", 90.0 - i, "tech" if i % 2 else "news", [full(i), ("m", "", "c", "w", "u"), full(i + 50)], [(f"w{i}", None), (f" {i + 1}月2日 vote", ""), ("talks", "2026-07-10"), ("", "明日")]) for i in range(6)]
    df = spark.createDataFrame([(*r, (None, f"https://s/{r[1]}")) for r in rows], f"run_id long, event_id string, importance_score double, category string, key_data {data}, watch_variables {watch}, primary_source struct<name:string,url:string>")
    out = events.daily_brief_rows(df).orderBy("brief_rank").collect()
    assert [r.event_id for r in out] == [f"e{i}" for i in range(5)] and out[0].categories == ["news", "tech"] and len(out[0].sources) == 5
    assert [d.metric for d in out[0].brief_key_data] == ["m0", "m50", "m1", "m51", "m2", "m52", "m3", "m53"]
    assert out[0].watch_rows == ["w0", "1月2日 vote", "talks", "w1", "2月2日 vote", "w2", "3月2日 vote", "w3"]
    assert out[0].dated_rows == ["1月2日 vote", "talks", "2月2日 vote", "3月2日 vote"]
    plain = events.daily_brief_rows(df.drop("key_data").withColumn("watch_variables", F.array(F.lit("a"), F.lit("下周一 b"))))
    assert plain.first().watch_rows == ["a", "下周一 b"] and plain.first().dated_rows == ["下周一 b"] and "brief_key_data" not in plain.columns


def test_patterns_look_ahead_and_match_as_before(spark):
    import re

    rules = [p for _, p in (*fixed.CATEGORY_PATTERNS, *fixed.STAGES, *fixed.FINE_KEYWORDS)] + [fixed.VERIFIABLE_FACTS, fixed.TOPIC_WORDS, fixed.RELEVANT_FACTS, r"x\.com|ab?c", r"(a)(b|c)", r"colou?r", "ſa|b"]
    texts = ["", "A CHIP and the ſec", "K Kelvin İnc ıBM rumour", "x.com xxcom ac abc", "colr color colour", "人工智能 20日 2024 3.5%", "Plans to; plan to", "éAI AI. SAID", "a b ab", "policy" * 3, "SA Ba", "announced data show"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(1)
    for p in rules:
        plain = T.pattern(p).removeprefix(T.ahead(p))
        got = df.select(T.hits(F.col("t"), p).alias("a"), F.col("t").rlike(plain).alias("b"), T.count_hits(F.col("t"), p).alias("c"), F.regexp_count("t", F.lit(plain)).alias("d")).collect()
        assert all(r.a == r.b and r.c == r.d for r in got), p
    assert T.ahead("ab|cd") and T.ahead(r"\bfed\b|x\.com") and not T.ahead("a{2}b") and not T.ahead("(a)(b|c)|.d") and not T.ahead("ſa|b")
    assert re.fullmatch(r"\(\?=\[.*\]\[.*\]\)", T.ahead("(ab|cd)"))


def test_flags_and_daily_rows_are_scored_once(spark):
    from siftwire.plans import registry

    for name in ("item_flags", "daily_brief_rows"):
        files = registry.QUERIES[name](spark, "/root/testdata/sf0.001").inputFiles()
        assert files and not any("documents" in f for f in files), name


def test_sieved_text_has_all_matches(spark):
    rules = [p for _, p in (*fixed.CATEGORY_PATTERNS, *fixed.SECONDARY_TAGS, *fixed.STAGES, *fixed.FINE_KEYWORDS)] + [p for _, _, p in fixed.DERIVED_CATEGORIES] + ["ción", "colou?r"]
    texts = ["", "ſec Kelvin İnflation", "war" * 30, "a warm cold war. gdpx gdp xgdp " * 5, "The AI chip, aI policy; éAI AI.x" + "z" * 90 + " fed" + "q" * 60 + " feds Fed", "市场份额公司战略 融资" + "x" * 70 + "央行", "COLOR colouR la Ción rumour reportedly plans to", "in progress" * 3, "x" * 50 + "research result paper"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(1).withColumn("v", T.sieved(F.col("t"), rules))
    for p in rules:
        got = df.select(T.count_hits(F.col("t"), p).alias("a"), T.count_hits(F.col("v"), p).alias("b"), F.regexp_extract("t", T.pattern(p), 0).alias("c"), F.regexp_extract("v", T.pattern(p), 0).alias("d")).collect()
        assert all(r.a == r.b and r.c == r.d for r in got), p
    assert T.sieve(rules) and not T.sieve(["announces.*product"]) and not T.sieve([r"a\d+"]) and not T.sieve(["[ab]c"])
    long = spark.createDataFrame([("AI chip " * 40_000, "a b. " * 40_000)], "t string, u string")  # no recursion a match
    assert long.select(F.length(T.sieved(F.col("t"), rules))).first()[0] > 300_000


def test_keywords_and_sentences_of_long_texts(spark):
    import re

    words = " ".join(["from", "ab"] * 400 + [f"word{i % 30}" for i in range(60)])
    item = spark.createDataFrame([("1", "t", words, "s"), ("2", "t", "x" * 998 + " kept Kept " + "c" * 40 + " last", "s")], "id string, title string, summary string, source string")
    got = {r.id: r.k for r in item.select("id", publish.extract_keywords(item).alias("k")).collect()}
    assert got["1"] == [f"word{i}" for i in range(8)] and got["2"] == ["kept", "last"]
    text = "One. Two!  three? 四。五！ six <b>. </b> Seven"
    assert spark.range(1).select(events.split_sentences(F.lit(text))).first()[0] == ["One.", "Two!", "three?", "四。", "五！", "six .", "Seven"]
    odd = ["　 a \n b\t\t", "\n", " \u0085", "a  b <x\ny> c", "é \u0085 ", "<>a> <"]
    df = spark.createDataFrame([(t,) for t in odd], "t string")
    want = [re.sub(f"^{WS_PY}+|{WS_PY}+$", "", re.sub(f"{WS_PY}+", " ", re.sub("<[^>]+>", " ", t))) for t in odd]
    assert sorted(r[0] for r in df.select(T.clean_text(F.col("t"))).collect()) == sorted(want)


WS_PY = "[ \\t\\n\\x0b\\f\\r\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"


def test_coverage_and_brief_inputs_are_scored_once(spark):
    from siftwire.plans import registry

    for name in ("channel_coverage", "event_brief_inputs"):
        files = registry.QUERIES[name](spark, "/root/testdata/sf0.001").inputFiles()
        assert files and not any("documents" in f for f in files), name
