"""Operator 12: ranked lexical search, term at a time with a limited number of accumulators."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import dropped, stored, table

#: Bytes of a term as they are, A-Z lower-cased, all others as a space: letters, digits and whatever is not ASCII.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


@dataclass(frozen=True)
class Statistics:
    """Of the whole collection: documents with a term, all terms, and the number of documents of each query term."""

    documents: int
    terms: int
    df: dict[int, int]

    def weight(self, term: int) -> int:
        return math.floor(1000 * math.log((2 * self.documents + 2) / (2 * self.df.get(term, 0) + 1)))

    def length_norm(self, n: np.ndarray) -> np.ndarray:
        return 10 + (90 * n * self.documents) // max(self.terms, 1)


def postings(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, tfs): a row a document with terms, those of `vocabulary` by number with their occurrences; n counts all."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        get, kind = held.value.get, pa.int32()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                count, which, ends, tfs = [], [], [0], []
                for text in b.column("text").to_pylist():
                    words = terms_of(text)
                    count.append(len(words))
                    known = np.array([x for x in map(get, words) if x is not None], np.int32)
                    terms, tf = np.unique(known, return_counts=True)
                    which.append(terms)
                    tfs.append(tf)
                    ends.append(ends[-1] + len(terms))
                offsets = pa.array(ends, kind)
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int32), *x]).astype(np.int32))) for x in (which, tfs)]
                out = pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(count, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])
                yield out.filter(pc.greater(out.column("n"), 0))

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, n long, terms array<int>, tfs array<int>")


def limited_accumulators(lists: list[tuple[np.ndarray, np.ndarray]], size: int, k: int, floor: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of one query over `size` documents: all that can be among the k best of score above 0 and not below `floor`, with exact scores.

    `lists`: for each term, rarest first, its documents in ascending order and what the term adds to the score of each. Terms are taken one by
    one. A list makes accumulators until what the lists from it on can add at most is less than the k-th best partial score (or `floor`);
    after that lists only add to documents that have one. A document without an accumulator then ends below k others."""
    bounds = np.array([int(add.max()) if len(add) else 0 for _, add in lists], np.int64)
    ahead = bounds[::-1].cumsum()[::-1]
    score, seen, found = np.zeros(size, np.int64), np.zeros(size, bool), []
    live, open_ = np.zeros(0, np.int64), True
    for (docs, add), most in zip(lists, ahead.tolist(), strict=True):
        if open_:
            if found:
                live = np.concatenate(found)
                found = [live]
            kth = int(np.partition(score[live], len(live) - k)[len(live) - k]) if len(live) >= k else 0
            if most < max(kth, floor):
                open_ = False
                live = np.sort(live)
        if open_:
            score[docs] += add
            found.append(docs[~seen[docs]])
            seen[docs] = True
        elif len(live) and len(docs):
            at = np.searchsorted(docs, live)
            at[at == len(docs)] = 0
            both = docs[at] == live
            score[live[both]] += add[at[both]]
    if open_ and found:
        live = np.concatenate(found)
    some = score[live] > 0
    return live[some], score[live][some]


def best_of_blocks(rows: DataFrame, queries: list[tuple[int, list[int]]], stats: Statistics, k: int, block_postings: int = 1 << 22) -> DataFrame:
    """(query, doc_id, score): for each partition of `rows` (see postings) the k best documents of each query. A task inverts blocks of at most
    about `block_postings` postings and carries each query's k best from block to block, whose least score is the next block's floor."""
    held = rows.sparkSession.sparkContext.broadcast((queries, stats))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        queries, stats = held.value
        weights = np.zeros(max([t for _, ts in queries for t in ts], default=-1) + 1, np.int64)
        for t in {t for _, ts in queries for t in ts}:
            weights[t] = stats.weight(t)
        order = {q: sorted(ts, key=lambda t: (stats.df.get(t, 0), t)) for q, ts in queries}
        ids, best = None, {}

        def block(parts: list[pa.RecordBatch]) -> None:
            nonlocal ids, best
            t = pa.Table.from_batches(parts).combine_chunks()
            lengths = pc.list_value_length(t.column("terms")).to_numpy()
            terms = pc.list_flatten(t.column("terms")).to_numpy()
            tfs = pc.list_flatten(t.column("tfs")).to_numpy().astype(np.int64)
            doc = np.repeat(np.arange(t.num_rows), lengths)
            m = stats.length_norm(t.column("n").to_numpy())
            mine = terms < len(weights)
            terms, tfs, doc = terms[mine], tfs[mine], doc[mine]
            add = weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m[doc]))
            by = np.argsort(terms, kind="stable")
            terms, doc, add = terms[by], doc[by], add[by]
            cuts = np.searchsorted(terms, np.arange(len(weights) + 1))
            names = t.column("doc_id").combine_chunks()
            offset = 0 if ids is None else len(ids)
            ids = names if ids is None else pa.concat_arrays([ids, names])
            for q, ts in order.items():
                lists = [(doc[cuts[x] : cuts[x + 1]], add[cuts[x] : cuts[x + 1]]) for x in ts if cuts[x] < cuts[x + 1]]
                if lists:
                    was = best.get(q)
                    floor = int(was[1].min()) if was is not None and len(was[1]) >= k else 0
                    found, score = limited_accumulators(lists, t.num_rows, k, floor)
                    if was is not None:
                        found, score = np.r_[was[0], found + offset], np.r_[was[1], score]
                    else:
                        found = found + offset
                    best[q] = cut(found, score)
            # Only the ids that are still wanted stay.
            kept = np.unique(np.concatenate([np.zeros(0, np.int64), *[d for d, _ in best.values()]]))
            ids = ids.take(pa.array(kept))
            best = {q: (np.searchsorted(kept, d), s) for q, (d, s) in best.items()}

        def cut(found: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The k best; of those that equal the last, the least ids."""
            if len(found) > k:
                least = np.partition(score, len(score) - k)[len(score) - k]
                some = score >= least
                found, score = found[some], score[some]
            if len(found) > k:
                place = pc.rank(ids.take(pa.array(found)), sort_keys="ascending", null_placement="at_end", tiebreaker="first").to_numpy()
                some = np.lexsort((place, -score))[:k]
                found, score = found[some], score[some]
            return found, score

        parts, n = [], 0
        for b in batches:
            parts.append(b)
            n += len(b.column("terms").flatten()) + b.num_rows
            if n >= block_postings:
                block(parts)
                parts, n = [], 0
        if parts:
            block(parts)
        for q, (found, score) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array([q] * len(found), pa.int32()), ids.take(pa.array(found)), pa.array(score)], ["query", "doc_id", "score"])

    return rows.mapInArrow(run, f"query int, doc_id {kind}, score long")


def rank_documents(docs: DataFrame, queries: DataFrame, k: int = 10, most_terms: int = 200_000, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """The k best documents (item_id, rank, doc_id, score) of each row of `queries`, of score above 0.

    Terms are runs of letters, digits and all that is not ASCII, A-Z lower-cased. One pass over the documents keeps the postings of the queries'
    terms, a row a document; counts of documents and terms come from all of them. Each task then inverts its own documents and works the queries
    term by term (see limited_accumulators); its k best a query, not postings, are shuffled, and cut twice, so no task gets all of a query's.
    Queries are taken in groups of at most about `most_terms` terms (or one long query), so what is broadcast is bounded however many there
    are; each further group is another pass over the documents.

    Null and empty texts have no terms: such documents are found by nothing, such queries find nothing. Repeated rows, of either table, count and are
    ranked each; equal scores stand by id, null last. Long texts are taken whole; an empty table gives no rows; other columns are
    not read."""
    spark = docs.sparkSession
    given = stored(queries.select(F.col(query_id).alias("item_id"), F.col(query_text).cast("string").alias("text")))
    size = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-int(size) // (2 * most_terms)))  # a term takes two bytes at least
    found, tables = None, [given]
    for g in range(groups):
        some = given.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g) if groups > 1 else given
        vocabulary: dict[bytes, int] = {}
        asked, names = [], []
        for i, r in enumerate(some.toLocalIterator()):
            words = set(terms_of(r["text"].encode() if r["text"] else None))
            asked.append((i, [vocabulary.setdefault(w, len(vocabulary)) for w in sorted(words)]))
            names.append((i, r["item_id"]))
        rows = stored(postings(docs, vocabulary, id_col, text_col))
        total = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = {r["term"]: r["count"] for r in rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}  # a row a term asked for
        local = best_of_blocks(rows, [(i, ts) for i, ts in asked if ts], Statistics(total[0], total[1], df), k)
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        dealt = local.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64)))
        first = dealt.withColumn("rank", F.row_number().over(W.partitionBy("query", "part").orderBy(*order))).where(F.col("rank") <= k).drop("rank", "part")
        ranks = first.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)
        items = spark.createDataFrame(names, f"query int, item_id {given.schema['item_id'].dataType.simpleString()}")  # of one group
        out = stored(ranks.join(F.broadcast(items), "query").select("item_id", "rank", "doc_id", "score"))
        dropped(rows)
        found = out if found is None else found.unionByName(out)
    dropped(*tables)
    return found


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
with d as (select row_number() over () as r, doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as w from documents),
c as (select count(*)::bigint as nn, sum(len(w))::bigint as ll from d where len(w) > 0),
i as (select row_number() over () as q, item_id, unnest(list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')))) as t from benchmark),
v as (select distinct t from i),
p as (select e.r, e.t, count(*)::bigint as tf from (select r, unnest(w) as t from d) e semi join v on v.t = e.t group by e.r, e.t),
f as (select t, count(*)::bigint as df from p group by t),
m as (select d.r, d.doc_id, 10 + (90 * len(d.w)::bigint * c.nn) // c.ll as m from d, c where len(d.w) > 0),
g as (select f.t, floor(1000 * ln((2 * c.nn + 2)::double / (2 * f.df + 1)::double))::bigint as w from f, c),
s as (select i.q, i.item_id, m.r, m.doc_id, sum(g.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * m.m)))::bigint as score
      from i join p on i.t = p.t join g on g.t = i.t join m on m.r = p.r group by i.q, i.item_id, m.r, m.doc_id),
k as (select *, row_number() over (partition by q order by score desc, doc_id nulls last) as rank from s where score > 0)
select item_id, rank::int as rank, doc_id, score from k where rank <= 10
"""
