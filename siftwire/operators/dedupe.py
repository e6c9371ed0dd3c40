"""Similarity joins of titles, duplicates and event clusters: exact, by prefix-filtered equi-joins and DataFrame loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from . import scan
from .matching import SEP, block_join, like_pairs
from .storage import deleted, stored


#: Similarities under which candidate pairs are not shuffled.
DENSE = 0.7


def token_pairs(df: DataFrame, keys: list[str], node: str, tokens: str, threshold: float, fresh: str | None = None) -> DataFrame:
    """Pairs (keys, a, b), a < b, of rows whose token sets have Jaccard similarity of `threshold` or more. Exact. With `fresh`, a boolean column,
    only pairs with a fresh row: the others are not met.

    Tokens are ordered by how many rows have them, rarest first; two such sets share a token within their first
    n - ceil(t n) + 1 (the prefix filter). Rows with equal sets must have been joined into one before, so frequent titles do not
    meet themselves; sizes must fit before the sets are compared. Tokens that very many rows have are joined in blocks (block_join). Under
    DENSE most tokens are among the first, so rows meet in tasks, which give out like pairs only (like_pairs)."""
    new = F.col(fresh) if fresh else F.lit(True)
    if threshold < DENSE:
        return like_pairs(stored(df.where(F.size(tokens) > 0).select(*keys, F.col(node).alias("n"), F.array_join(F.array_distinct(tokens), SEP).alias("t"), new.alias("fresh"))), keys, threshold)
    base = df.select(*keys, F.col(node).alias("n"), F.array_distinct(tokens).alias("t"), new.alias("fresh")).where(F.size("t") > 0)
    ranked = base.select(*keys, "n", "fresh", F.explode("t").alias("w"))
    df_counts = ranked.groupBy(*keys, "w").count()
    order = ranked.join(df_counts, [*keys, "w"]).groupBy(*keys, "n", "fresh").agg(F.sort_array(F.collect_list(F.struct("count", "w"))).alias("s"))
    size = F.size("s")
    order = stored(order.select(*keys, "n", "fresh", F.transform("s", lambda x: x["w"]).alias("t"), size.alias("size"), (size - F.ceil(F.lit(threshold) * size - F.lit(1e-9)) + 1).cast("int").alias("prefix")))
    heads = order.select(*keys, "n", "fresh", "size", F.explode(F.slice("t", 1, F.greatest("prefix", F.lit(1)))).alias("w"))
    other = heads.select(*keys, "w", F.col("n").alias("m"), F.col("fresh").alias("fresh2"), F.col("size").alias("size2"))
    fits = ((F.col("n") < F.col("m")) | (~F.col("fresh2") & (F.col("n") != F.col("m")))) & (F.col("size") >= F.lit(threshold) * F.col("size2") - F.lit(1e-9)) & (F.col("size2") >= F.lit(threshold) * F.col("size") - F.lit(1e-9))
    found = block_join(heads.where("fresh"), other, [*keys, "w"]).where(fits)
    pairs = found.select(*keys, F.least("n", "m").alias("n"), F.greatest("n", "m").alias("m")).distinct()
    left = order.select(*keys, "n", F.col("t").alias("ta"))
    right = order.select(*keys, F.col("n").alias("m"), F.col("t").alias("tb"))
    both = pairs.join(left, [*keys, "n"]).join(right, [*keys, "m"])
    return both.where(T.jaccard(F.col("ta"), F.col("tb")) >= threshold).select(*keys, F.col("n").alias("a"), F.col("m").alias("b"))


def connected(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, component) of the nodes of `edges` (keys, a, b): the least node that edges reach.

    Large stars and small stars in turn: each node hangs its larger neighbours on the least of its neighbourhood, then itself and its
    smaller neighbours on the least of these. Edges never grow in number, and after at most log^2 of the nodes' number of turns each component
    is one star. Each turn is stored and the one before it deleted."""
    pairs = stored(edges.select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())

    def least(df: DataFrame) -> DataFrame:
        return df.groupBy(*keys, "a").agg(F.least(F.min("b"), F.first("a")).alias("m"))

    mark = None
    while True:
        both = pairs.unionByName(pairs.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.where("b > a").join(least(both), [*keys, "a"]).where("b <> m").select(*keys, F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stored(large)
        lower = least(large)
        small = large.join(lower, [*keys, "a"]).where("b <> m").select(*keys, F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lower.select(*keys, "a", F.col("m").alias("b"))).distinct()
        small = stored(small)
        deleted(pairs, large)
        pairs = small
        was, mark = mark, tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64(*keys, "a", "b"))).first())
        if mark == was:
            break
    top = pairs.select(*keys, F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return pairs.select(*keys, F.col("a").alias("node"), F.col("b").alias("component")).unionByName(top)


def title_pairs(items: DataFrame, threshold: float = 0.82, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Pairs (run_id, a, b) of items, by ord, whose titles are alike; equal token sets are represented by their first item."""
    return token_pairs(_token_classes(items, list(keys)), list(keys), "ord", "tokens", threshold)


def _token_classes(items: DataFrame, keys: list[str]) -> DataFrame:
    t = items.select(*keys, "ord", F.sort_array(T.title_tokens(F.col("title"))).alias("tokens")).where(F.size("tokens") > 0)
    return t.groupBy(*keys, "tokens").agg(F.min("ord").alias("ord"))


def duplicate_components(items: DataFrame, threshold: float = 0.82, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """(run_id, ord, component) of all items: those joined by equal address, equal title tokens or alike titles."""
    keys = list(keys)
    t = stored(items.select(*keys, "ord", T.canonical_url(F.col("url")).alias("u"), F.sort_array(T.title_tokens(F.col("title"))).alias("tokens")))
    urls = t.where("u <> ''").join(t.where("u <> ''").groupBy(*keys, "u").agg(F.min("ord").alias("a")), [*keys, "u"]).where("a <> ord").select(*keys, "a", F.col("ord").alias("b"))
    full = t.where(F.size("tokens") > 0)
    firsts = stored(full.groupBy(*keys, "tokens").agg(F.min("ord").alias("ord")))
    same = full.join(firsts.withColumnRenamed("ord", "a"), [*keys, "tokens"]).where("a <> ord").select(*keys, "a", F.col("ord").alias("b"))
    edges = urls.unionByName(same).unionByName(token_pairs(firsts, keys, "ord", "tokens", threshold))
    found = connected(edges, keys).withColumnRenamed("node", "ord")
    return t.select(*keys, "ord").join(found, [*keys, "ord"], "left").select(*keys, "ord", F.coalesce("component", "ord").alias("component"))


def chain(rows: DataFrame, keys: list[str], side: str | None = None) -> DataFrame:
    """Edges (keys, a, b) of rows (keys, ord) that follow one another in the order of ord; with `side`, only those whose sides differ. Hot keys
    are scanned in chunks."""
    got = scan.last_values(scan.chunked(rows, keys, ["ord"]), keys, ["ord"], {"__last": F.struct("ord", *([side] if side else []))}, inclusive=False)
    got = got.where(F.col("__last").isNotNull() & (F.col(f"__last.{side}") != F.col(side) if side else F.lit(True)))
    return got.select(*keys, F.col("__last.ord").alias("a"), F.col("ord").alias("b"))


def fit(t: DataFrame, threshold: float, keys: list[str]) -> DataFrame:
    """(keys, ord, group) of the rows of `t` (keys, ord, u, tokens, group; stored) whose group is null: in order each joins the earliest group
    with a member of its address u or of alike tokens, else it opens one; group is the group's first row. Rows with a group keep it.

    The earliest such group is the least among those of the earlier rows it is like. Rows of one token set see what the rows of the set before
    them saw; where two token sets are alike, the rows of both in order need an edge only where they change from one set to the other. Groups
    are found in rounds over the rows that have such an edge, or whose address rows of other sets have (least_groups); the others of a set follow
    from these."""
    ids = [*keys, "ord"]
    full = t.where(F.size("tokens") > 0)
    firsts = stored(full.groupBy(*keys, "tokens").agg(F.min("ord").alias("c"), F.bool_or(F.col("group").isNull()).alias("fresh")))
    # A row without tokens is a set of its own.
    sets = full.join(firsts, [*keys, "tokens"]).select(*ids, "c", "u", "group").unionByName(t.where(F.size("tokens") == 0).select(*ids, F.col("ord").alias("c"), "u", "group"))
    sets = scan.chunked(sets, [*keys, "c"], ["ord"]).withColumn("seen", F.coalesce("group", "ord"))
    sets = stored(scan.running_least(sets, [*keys, "c"], ["ord"], "seen"))
    like = stored(token_pairs(firsts, keys, "c", "tokens", threshold, "fresh").withColumnsRenamed({"a": "p", "b": "q"}))
    sides = [like.select(*keys, "p", "q", F.col(c).alias("c"), F.lit(c == "q").alias("side")) for c in ("p", "q")]
    mixed = block_join(sides[0].unionByName(sides[1]), sets.select(*keys, "c", "ord"), [*keys, "c"]).select(*keys, "p", "q", "side", "ord")
    across = stored(chain(mixed, [*keys, "p", "q"], "side").select(*keys, "a", "b").distinct())
    named = sets.where("u <> ''").groupBy(*keys, "u").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high")
    shared = stored(sets.where("u <> ''").join(named, [*keys, "u"], "left_semi").select(*ids, "u"))
    some = across.select(*keys, F.col("a").alias("ord")).unionByName(across.select(*keys, F.col("b").alias("ord"))).unionByName(shared.select(*ids)).distinct()
    found = least_groups(sets.join(some, ids, "left_semi"), across, shared, keys)
    found = sets.withColumnRenamed("seen", "__seen").join(found, ids, "left").select(*ids, "c", "group", scan.CHUNK, F.coalesce("seen", "__seen").alias("seen"))
    return scan.running_least(found, [*keys, "c"], ["ord"], "seen").where("group is null").select(*ids, F.col("seen").alias("group"))


def least_groups(rows: DataFrame, across: DataFrame, shared: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ord, seen) of `rows` (keys, ord, c: the token set, group or null, seen: the least group or ord of the set so far; chunked): the
    earliest group of the rows so far that those of the set are like, which is the row's own where group is null. across: edges (keys, a, b), a < b, between rows of sets that are alike;
    shared (keys, ord, u): rows whose address counts.

    In a round each row takes the least group of its edges, of all rows of its set before it and of its address, then the group of the row it
    took. So rounds count the sets on the way to a group, not the rows, and long ways are halved. Each is stored, the one before deleted."""
    ids = [*keys, "ord"]
    open_ = F.col("group").isNull()
    state = stored(rows.select(*ids, "c", "group", scan.CHUNK, F.coalesce("group", "seen").alias("own"), "seen", F.lit(True).alias("moved")))
    places = None if shared.isEmpty() else scan.chunked(shared, [*keys, "u"], ["ord"])
    while not state.where("moved").isEmpty():
        near = across.join(state.select(*keys, F.col("ord").alias("a"), "seen"), [*keys, "a"]).groupBy(*keys, F.col("b").alias("ord")).agg(F.min("seen").alias("near"))
        step = state.join(near, ids, "left")
        if places is None:
            step = step.withColumn("same", F.col("near"))
        else:
            same = scan.running_least(places.join(state.select(*ids, F.col("own").alias("same")), ids), [*keys, "u"], ["ord"], "same")
            step = step.join(same.groupBy(*ids).agg(F.min("same").alias("same")), ids, "left")
        # What a row with a group has seen, rows of its set see too, but it keeps its group, which is what those of its address see.
        step = step.withColumns({"was": F.col("own"), "had": F.col("seen"), "own": F.when(open_, F.least("own", "seen", "near", "same")).otherwise(F.col("own"))})
        step = scan.running_least(step.withColumn("seen", F.least("own", "seen", "near")), [*keys, "c"], ["ord"], "seen")
        up = state.where(open_).select(*keys, F.col("ord").alias("__own"), F.col("own").alias("up"))
        step = step.withColumn("__own", F.when(open_, F.least("own", "seen")).otherwise(F.col("own"))).join(up, [*keys, "__own"], "left")
        step = step.withColumn("own", F.when(open_, F.least("__own", "up")).otherwise(F.col("own"))).withColumn("seen", F.least("seen", "own"))
        new = stored(step.select(*ids, "c", "group", scan.CHUNK, "own", "seen", ((F.col("own") < F.col("was")) | (F.col("seen") < F.col("had"))).alias("moved")))
        deleted(state)
        state = new
    return state.select(*ids, "seen")


def first_fit(items: DataFrame, threshold: float) -> DataFrame:
    """(run_id, ord, group): in input order each item joins the earliest group with a member of its address or of a like title, else it
    opens one. See fit."""
    none = F.lit(None).cast(items.schema["ord"].dataType)
    t = items.select("run_id", "ord", T.canonical_url(F.col("url")).alias("u"), F.sort_array(T.title_tokens(F.col("title"))).alias("tokens"), none.alias("group"))
    return fit(stored(t), threshold, ["run_id"])


def duplicate_groups(items: DataFrame, threshold: float = 0.82, mode: str = "components") -> DataFrame:
    """(run_id, ord, group). `components`: free of order. `first_fit`: in input order each item joins the first group that has a
    member like it, so a bridge does not merge groups."""
    if mode == "first_fit":
        return first_fit(items, threshold)
    if mode != "components":
        raise ValueError(f"mode {mode!r}: components or first_fit")
    return duplicate_components(items, threshold).withColumnRenamed("component", "group")


def ranked_groups(items: DataFrame, threshold: float, mode: str) -> DataFrame:
    """`items` with group and __r, their place in it: credibility, then time, then input order."""
    best = W.partitionBy("run_id", "group").orderBy(F.desc(F.coalesce("credibility", F.lit(0.0))), F.desc_nulls_last("published_at"), "ord")
    return items.join(duplicate_groups(items, threshold, mode), ["run_id", "ord"]).withColumn("__r", F.row_number().over(best))


def duplicate_rows(items: DataFrame, threshold: float = 0.82, mode: str = "components") -> DataFrame:
    """(run_id, best_ord, ord, id, title, url, source, published_at): a row for each item that another stands for, but those of its own id. The
    same as `duplicates` of dedupe_items, without an array a group."""
    df = stored(ranked_groups(items, threshold, mode))
    heads = df.where("__r = 1").select("run_id", "group", F.col("ord").alias("best_ord"), F.col("id").alias("__best"))
    rest = df.where("__r > 1").join(heads, ["run_id", "group"]).where("id <> __best")
    return rest.select("run_id", "best_ord", "ord", "id", "title", "url", "source", "published_at")


def dedupe_items(items: DataFrame, threshold: float = 0.82, mode: str = "components", arrays: bool = True) -> DataFrame:
    """The best item of each group (credibility, then time, then input order), with duplicate_count and, if `arrays`, duplicates (the others, but
    those of its own id). A group's array is one value of one row: where groups may be huge, leave it out and take duplicate_rows."""
    df = ranked_groups(items, threshold, mode)
    heads = df.where("__r = 1").drop("__r")
    rest = df.where("__r > 1").join(heads.select("run_id", "group", F.col("id").alias("__best")), ["run_id", "group"]).where("id <> __best")
    if not arrays:
        counts = rest.groupBy("run_id", "group").agg(F.count("*").cast("int").alias("duplicate_count"))
        return heads.join(counts, ["run_id", "group"], "left").withColumn("duplicate_count", F.coalesce("duplicate_count", F.lit(0))).drop("group")
    lists = rest.groupBy("run_id", "group").agg(F.sort_array(F.collect_list(F.struct("ord", F.struct("id", "title", "url", "source", "published_at").alias("d")))).alias("l"))
    none = F.array().cast("array<struct<id:string,title:string,url:string,source:string,published_at:timestamp>>")
    out = heads.join(lists, ["run_id", "group"], "left").withColumn("duplicates", F.coalesce(F.transform("l", lambda x: x["d"]), none))
    return out.withColumn("duplicate_count", F.size("duplicates")).drop("l", "group")


def cluster_tokens(title: Column) -> Column:
    """Latin words of three or more letters, then Chinese names, without stop words; distinct, at most 12."""
    t = F.lower(T.clean_text(title))
    stop = F.array(*[F.lit(w) for w in fixed.CLUSTER_STOPWORDS])
    latin = F.filter(F.split(t, "[^a-z0-9]+"), lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))
    names = F.filter(F.regexp_extract_all(t, F.lit(r"[\x{4e00}-\x{9fff}]{2,10}(?:公司|银行|大学|委员会|部门|政府)?"), 0), lambda w: ~F.array_contains(stop, w))
    return F.slice(F.array_distinct(F.concat(latin, names)), 1, 12)


def cluster_key(event_type: Column, tokens: Column) -> Column:
    return F.substring(F.sha1(F.concat(event_type, F.lit(":"), F.array_join(F.sort_array(F.slice(tokens, 1, 6)), "|")).cast("binary")), 1, 12)


def overlap_pairs(rows: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Pairs (keys, a, b), a < b by ord, of rows whose cluster_tokens share `threshold` of the smaller set or more. Exact. See like_pairs."""
    sets = rows.where(F.size("cluster_tokens") > 0).select(*keys, F.col("ord").alias("n"), F.array_join("cluster_tokens", SEP).alias("t"), F.lit(True).alias("fresh"))
    return like_pairs(stored(sets), keys, threshold, overlap=True)


def leaders(rows: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ord, s), stored: in order, a row leads (1) unless an earlier neighbour leads (then 2). rows: (keys, ord); edges: (keys, a, b), a < b.

    Rounds: a row next to an earlier leader follows, one whose earlier neighbours all follow leads. An open row with one open earlier neighbour
    is what that one is not, so chains of such rows are followed by doubling their pointers, and a whole chain is settled with its first row.
    Every round settles at least the first open row of each component; random orders take few."""
    ids = [*keys, "ord"]
    state = stored(rows.select(*ids, F.lit(0).alias("s")))  # 0 open
    while not state.where("s = 0").isEmpty():
        before = edges.join(state.select(*keys, F.col("ord").alias("a"), "s"), [*keys, "a"])
        seen = before.groupBy(*keys, F.col("b").alias("ord")).agg(F.bool_or(F.col("s") == 1).alias("led"), F.count_if(F.col("s") == 0).alias("open"), F.min(F.when(F.col("s") == 0, F.col("a"))).alias("up"))
        now = F.when(F.col("s") != 0, F.col("s")).when(F.coalesce("led", F.lit(False)), 2).when(F.coalesce("open", F.lit(0)) > 0, 0).otherwise(1)
        new = stored(state.join(seen, ids, "left").select(*ids, now.alias("s"), F.when((now == 0) & (F.col("open") == 1), F.col("up")).alias("up")))
        deleted(state)
        state, links = new.select(*ids, "s"), stored(new.where(F.col("up").isNotNull()).select(*ids, "up", F.lit(True).alias("odd")))
        while True:
            ahead = links.select(*keys, F.col("ord").alias("up"), F.col("up").alias("top"), F.col("odd").alias("also"))
            if links.join(ahead, [*keys, "up"], "left_semi").isEmpty():
                break
            longer = stored(links.join(ahead, [*keys, "up"], "left").select(*ids, F.coalesce("top", "up").alias("up"), F.when(F.col("top").isNull(), F.col("odd")).otherwise(F.col("odd") != F.col("also")).alias("odd")))
            deleted(links)
            links = longer
        ends = links.join(state.where("s <> 0").select(*keys, F.col("ord").alias("up"), F.col("s").alias("z")), [*keys, "up"]).select(*ids, F.when(F.col("odd"), 3 - F.col("z")).otherwise(F.col("z")).alias("z"))
        settled = stored(state.join(ends, ids, "left").select(*ids, F.coalesce("z", "s").alias("s")))
        deleted(new, links)
        state = settled
    return state


def assign_event_clusters(items: DataFrame, title_threshold: float = 0.42, token_threshold: float = 0.5) -> DataFrame:
    """Adds cluster_tokens and event_cluster_key: in input order and within run and event type, an item joins the first leader that it is
    like (title similarity, or overlap of cluster tokens), else it leads a new cluster.

    Rows of equal sets of both kinds stand for one another: the first of them has their leader, as what is like it is like them all, and the
    others, being like it, never lead. So edges are those between such firsts (token_pairs, overlap_pairs), leaders come from rounds over them
    (leaders), and each follower takes its earliest leader."""
    keys = ["run_id", "event_type"]
    sets = {"tokens": F.sort_array(T.title_tokens(F.col("title"))), "cluster_tokens": cluster_tokens(F.col("title"))}
    rows = stored(items.select(*keys, "ord", *[c.alias(n) for n, c in sets.items()]).withColumn("bag", F.sort_array("cluster_tokens")))
    # Rows without tokens are like none.
    some = (F.size("tokens") > 0) | (F.size("bag") > 0)
    firsts = stored(rows.where(some).groupBy(*keys, "tokens", "bag").agg(F.min("ord").alias("ord")))
    titles = token_pairs(firsts, keys, "ord", "tokens", title_threshold).select(*keys, "a", "b")
    edges = stored(titles.unionByName(overlap_pairs(firsts.withColumnRenamed("bag", "cluster_tokens"), keys, token_threshold)).distinct())
    ids = ["run_id", "ord"]
    state = leaders(firsts.select(*ids), edges.select("run_id", "a", "b"), ["run_id"])
    lead = state.where("s = 1").select("run_id", F.col("ord").alias("a"))
    first = edges.join(lead, ["run_id", "a"]).groupBy("run_id", F.col("b").alias("ord")).agg(F.min("a").alias("leader"))
    # A leader has no earlier leader next to it, so its own entry stands.
    of = state.join(first, ids, "left").select(*ids, F.when(F.col("s") == 1, F.col("ord")).otherwise(F.col("leader")).alias("leader"))
    named = stored(firsts.join(of, ids).select(*keys, "tokens", "bag", "leader"))
    led = rows.where(some).join(named, [*keys, "tokens", "bag"]).select(*ids, "leader").unionByName(rows.where(~some).select(*ids, F.col("ord").alias("leader")))
    heads = rows.select("run_id", F.col("ord").alias("leader"), cluster_key(F.col("event_type"), F.col("cluster_tokens")).alias("event_cluster_key"))
    return items.join(rows.select(*ids, "cluster_tokens"), ids).join(led.join(heads, ["run_id", "leader"]).drop("leader"), ids)
