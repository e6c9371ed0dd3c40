"""Search over published items: many queries at once, aliases, ranking, facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from .matching import block_join
from .storage import stored


#: All aliases of a term, those of the first table first.
ALIASES = {t: tuple(dict.fromkeys((*fixed.TERM_ALIASES.get(t, ()), *fixed.DECISION_TERM_ALIASES.get(t, ())))) for t in (*fixed.TERM_ALIASES, *fixed.DECISION_TERM_ALIASES)}


def fields(df: DataFrame) -> dict[str, Column]:
    have = lambda c: T.column_or(df, c, None, "string")
    listed = lambda c: F.array_join(F.coalesce(T.column_or(df, c, None, "array<string>"), F.array().cast("array<string>")), " ")
    join = lambda *parts: F.lower(T.clean_text(F.concat_ws(" ", *parts)))
    return {
        "t_title": join(have("title_zh"), have("title_original"), F.col("title")), "t_summary": join(have("summary_zh"), F.col("summary"), have("content_excerpt"), have("ai_summary"), have("importance")),
        "t_source": join(F.col("source")), "t_labels": join(F.col("category"), have("primary_category"), listed("impact_areas"), listed("tags"), listed("article_keywords")),
    }


def expanded(keyword: Column, aliases: dict = ALIASES) -> Column:
    """array<array<string>>: each term of the keyword with its aliases."""
    terms = F.filter(F.split(F.lower(T.clean_text(keyword)), T.WS + "+"), lambda t: t != "")
    table = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*[F.lit(a) for a in x]) for kv in aliases.items() for x in kv])
    return F.transform(terms, lambda t: F.array_distinct(F.concat(F.array(t), F.coalesce(F.try_element_at(table, t), F.array().cast("array<string>")))))


def grams(text: Column, size: int) -> Column:
    """All overlapping pieces of `size` characters, in one pass over the text."""
    return F.regexp_extract_all(text, F.lit("(?s)(?=(.{%d}))" % size), 1)


def small(df: DataFrame, most: int) -> DataFrame:
    """A stored table, broadcast if it has at most `most` rows."""
    return F.broadcast(df) if df.count() <= most else df


def drivers(terms: DataFrame, texts: DataFrame, keys: list[str], most: int = 200_000) -> DataFrame:
    """(keys, n), distinct: for each query the texts that may hold its least frequent term. terms: (keys, term, x), a row an alias x of a term;
    texts: (n, t_all).

    An index of the queries' character trigrams (shorter pieces only where an alias is shorter) gives how many texts hold each. An alias stands
    in no more texts than its rarest piece, a term in no more than its aliases together; the query's term with the least such bound leads, and
    only its aliases' rarest pieces are joined with the postings. What is found is still to be verified."""
    names = stored(terms.select("x").distinct().withColumn("size", F.least(F.lit(3), F.length("x"))))
    pieces = names.select("x", F.explode(F.transform(F.sequence(F.lit(1), F.length("x") - F.col("size") + 1), lambda i: F.substr(F.col("x"), i, F.col("size")))).alias("g")).distinct()
    pieces = stored(pieces)
    sizes = [r["size"] for r in names.select("size").distinct().collect()]
    wanted = stored(pieces.select("g").distinct())
    held = small(wanted, most)
    every = F.concat(*[grams(F.col("t_all"), n) for n in sorted(sizes)]) if sizes else F.array().cast("array<string>")
    postings = stored(texts.select("n", F.explode(every).alias("g")).join(held, "g").distinct())
    rare = pieces.join(postings.groupBy("g").agg(F.count("*").alias("df")), "g", "left").groupBy("x").agg(F.min_by("g", F.coalesce("df", F.lit(0))).alias("g"), F.min(F.coalesce("df", F.lit(0))).alias("df"))
    bound = terms.join(rare, "x").groupBy(*keys, "term").agg(F.sum("df").alias("most"), F.collect_set(F.when(F.col("df") > 0, F.col("g"))).alias("gs"))
    first = bound.withColumn("r", F.row_number().over(W.partitionBy(*keys).orderBy("most", "term"))).where("r = 1")
    lead = stored(first.select(*keys, F.explode("gs").alias("g")))
    found = block_join(lead, postings, ["g"]).select(*keys, "n").distinct()
    return found


def best_of_all(plain: DataFrame, base: DataFrame, keys: list[str], limit: int, most: int = 200_000) -> DataFrame:
    """(keys, n) for queries without a term: the `limit` items of highest score, then latest, of each channel and source that is asked for. Items of a
    query's least score or more stand first in that order."""
    asked = stored(plain.select("q_channel", "q_source").distinct())
    every = F.lit("all")
    places = F.array_distinct(F.array(*[F.struct(c.alias("q_channel"), s.alias("q_source")) for c in (F.col("__channel"), every) for s in (F.col("source"), every)]))
    heat = F.coalesce("score", F.lit(0.0))
    dealt = base.select("n", heat.alias("heat"), "published_at", "id", F.explode(places).alias("p")).select("n", "heat", "published_at", "id", "p.*")
    w = W.partitionBy("q_channel", "q_source").orderBy(F.desc("heat"), F.desc_nulls_last("published_at"), "id")
    top = dealt.join(small(asked, most), ["q_channel", "q_source"]).withColumn("r", F.row_number().over(w)).where(F.col("r") <= limit)
    return plain.join(top, ["q_channel", "q_source"]).where(F.col("heat") >= F.coalesce("min_score", F.lit(0.0))).select(*keys, "n")


def ranked(items: DataFrame, queries: DataFrame, now: str, limit: int, keys: list[str]) -> DataFrame:
    """search_items of queries that `keys` tell apart."""
    if limit < 1:
        raise ValueError("limit is 1 at least")
    q = stored(queries.select(*keys, F.col("channel").alias("q_channel"), F.col("source").alias("q_source"), "min_score", expanded(F.col("keyword")).alias("terms")))
    f = fields(items)
    base = items.withColumns(f).withColumn("__channel", F.coalesce(T.column_or(items, "display_channel", None, "string"), F.col("category"))).withColumn("n", F.monotonically_increasing_id())
    base = stored(base)
    whole = F.concat_ws(" ", *f)
    each = q.select(*keys, F.posexplode("terms").alias("term", "xs")).select(*keys, "term", F.explode("xs").alias("x"))
    near = drivers(each, base.select("n", whole.alias("t_all")), keys)
    plain = q.where(F.size("terms") == 0)
    pairs = stored(near.unionByName(best_of_all(plain, base, keys, limit)))
    held = lambda c: F.aggregate("terms", F.lit(0), lambda n, a: n + F.exists(a, lambda x: F.contains(F.col(c), x)).cast("int"))
    cond = ((F.col("q_channel") == "all") | (F.col("q_channel") == F.col("__channel"))) & ((F.col("q_source") == "all") | (F.col("q_source") == F.col("source"))) & (F.coalesce("score", F.lit(0.0)) >= F.coalesce("min_score", F.lit(0.0)))
    cond = cond & F.forall("terms", lambda a: F.exists(a, lambda x: F.contains(F.col("t_all"), x)))
    df = pairs.join(q, keys).join(base.withColumn("t_all", whole), "n").where(cond)
    age = F.greatest(F.lit(0.0), (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("published_at")) / F.lit(3.6e9))
    either = F.aggregate("terms", F.lit(0), lambda n, a: n + F.exists(a, lambda x: F.contains(F.col("t_summary"), x) | F.contains(F.col("t_source"), x)).cast("int"))
    market = F.when(F.size(F.coalesce(T.column_or(items, "market_symbols", None, "array<string>"), F.array().cast("array<string>"))) > 0, 1).otherwise(0)
    df = df.withColumns({
        "hit_title": held("t_title"), "hit_keyword": held("t_labels"), "hit_relevance": either, "hit_market": market, "hit_authority": F.coalesce(F.col("source_authority").isin(*fixed.AUTHORITATIVE).cast("int"), F.lit(0)),
        "freshness": F.greatest(F.lit(0.0), 20 - F.least(F.lit(20.0), F.coalesce(age, F.lit(1e9)) / 12)), "heat": F.coalesce("score", F.lit(0.0)),
    })
    some = F.size("terms") > 0
    points = F.col("hit_title") * 100 + F.col("hit_keyword") * 70 + F.col("hit_relevance") * 35 + F.col("hit_market") * 20 + F.col("hit_authority") * 12 + F.col("freshness") + F.col("heat") / 5
    df = df.withColumn("search_score", F.when(some, points).otherwise(0.0))
    marks = (("hit_title", "title"), ("hit_keyword", "keyword"), ("hit_relevance", "summary-or-source"), ("freshness", "fresh"), ("hit_market", "market"), ("hit_authority", "authority"))
    labels = F.array_compact(F.array(*[F.when(F.col(c) > 0, F.lit(n)) for c, n in marks]))
    df = df.withColumn("hit_labels", F.when(some, labels).otherwise(F.array().cast("array<string>")))
    by = [F.desc(F.when(some, F.col(c)).otherwise(0)) for c in ("hit_title", "hit_keyword", "hit_relevance", "hit_market", "hit_authority", "freshness")]
    w = W.partitionBy(*keys).orderBy(*by, F.desc("heat"), F.desc_nulls_last("published_at"), "id")
    df = df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    return df.drop(*f, "t_all", "__channel", "q_channel", "q_source", "min_score", "terms", "n")


def search_items(items: DataFrame, queries: DataFrame, now: str, limit: int = 20) -> DataFrame:
    """Ranked hits of each query (query_id, channel, source, keyword, min_score), however many there are; `all` leaves channel or source open.

    Every term must occur, itself or as an alias, in title, summary, source or labels. Rank: terms in the title, in the labels, in summary
    or source, then market symbols, authority, freshness, score and time. An index of character pieces finds the items that may hold a query's
    rarest term (see drivers), and the whole condition is held against these alone; queries without a term are served from the best items of
    each channel and source. Each task keeps `limit` rows a query before the shuffle."""
    return ranked(items, queries, now, limit, ["query_id"])


def search_relaxed(items: DataFrame, queries: DataFrame, now: str, limit: int = 20) -> DataFrame:
    """As search_items; a query with a keyword and a source that finds nothing is answered over all sources (source_relaxed). Both forms go
    through one search, and the wider one is left out where the narrower has hits."""
    wide = queries.where((F.col("source") != "all") & (T.text_or_empty(F.col("keyword")) != "")).withColumn("source", F.lit("all"))
    both = queries.withColumn("source_relaxed", F.lit(False)).unionByName(wide.withColumn("source_relaxed", F.lit(True)))
    hits = stored(ranked(items, both, now, limit, ["query_id", "source_relaxed"]))
    some = hits.where(~F.col("source_relaxed")).select("query_id").distinct()
    return hits.where(~F.col("source_relaxed")).unionByName(hits.where("source_relaxed").join(some, "query_id", "left_anti"))


def result_page(hits: DataFrame, n: int) -> DataFrame:
    """Each query's first n hits, with how many there are and how many remain."""
    total = hits.groupBy("query_id").agg(F.count("*").alias("total"))
    return hits.where(F.col("rank") <= n).join(total, "query_id").withColumn("remaining", F.greatest(F.lit(0), F.col("total") - n))


def source_facets(items: DataFrame) -> DataFrame:
    return items.where(T.text_or_empty(F.col("source")) != "").select("source").distinct().orderBy("source")
