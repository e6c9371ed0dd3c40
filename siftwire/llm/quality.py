"""Operator 5: quality rules with thresholds from quantile sketches per language and source. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, small_join, stored, table

#: Measures that get adaptive limits, and the least distance of a limit from the median (so a constant measure rejects nothing).
MEASURES = {"mean_word_chars": 0.5, "symbols_per_word": 0.1, "dup_line_share": 0.4, "repeat_word_share": 0.2}
#: Measures with a lower limit too.
TWO_SIDED = ("mean_word_chars",)


def _repeats(df: DataFrame, words: str, size: int) -> DataFrame:
    """n_repeat_words: words inside windows of `size` words that the text has twice or more.

    Hashes of the windows show which texts have any repeat (equal windows have equal hashes); only those texts
    sort the windows themselves. Covered words are counted from the sorted starts. Each step is a column of its own,
    used twice or more, so that Spark keeps it apart and does not evaluate it inside the next step's lambda."""
    df = df.withColumn("__h", F.transform(words, lambda w: F.xxhash64(w)))
    starts = lambda a: F.when(F.size(a) >= size, F.sequence(F.lit(1), F.size(a) - size + 1)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("__w", F.transform(starts("__h"), lambda i: F.xxhash64(F.slice("__h", i, size))))
    some = F.size(F.array_distinct("__w")) < F.size("__w")
    windows = F.sort_array(F.transform(starts(words), lambda i: F.struct(F.array_join(F.slice(words, i, size), " ").alias("w"), i.alias("i"))))
    df = df.withColumn("__s", F.when(some, windows))
    same = lambda a, b: F.coalesce(a["w"] == b["w"], F.lit(False))
    marked = F.transform("__s", lambda x, k: F.struct(x["i"].alias("i"), (same(F.get(F.col("__s"), k - 1), x) | same(F.get(F.col("__s"), k + 1), x)).alias("d")))
    df = df.withColumn("__p", F.sort_array(F.transform(F.filter(marked, lambda y: y["d"]), lambda y: y["i"])))
    ahead = F.transform("__p", lambda x, k: F.least(F.coalesce(F.get(F.col("__p"), k + 1) - x, F.lit(size)), F.lit(size)))
    total = F.aggregate(ahead, F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long")))


def measure(docs: DataFrame, window: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of each whole text (null: none), with lang and source; stored, as the texts are read once only."""
    df = docs.select(F.col(id_col).alias("doc_id"), "lang", "source", F.coalesce(F.col(text_col), F.lit("")).alias("__t"))
    df = df.withColumn("__words", F.filter(F.split("__t", SPACE), lambda w: w != ""))
    df = df.withColumn("__lines", F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("n_words", F.size("__words").cast("long"))
    df = df.withColumn("word_chars", F.length(F.regexp_replace("__t", SPACE, "")).cast("long"))
    df = df.withColumn("n_symbols", (F.length("__t") - F.length(F.translate("__t", "#*$%&|<>", ""))).cast("long"))
    df = df.withColumn("n_lines", F.size("__lines").cast("long")).withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
    df = _repeats(df, "__words", window)
    return stored(df.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"))


def _shares(df: DataFrame) -> DataFrame:
    share = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b))
    return df.withColumns({"mean_word_chars": share("word_chars", "n_words"), "symbols_per_word": share("n_symbols", "n_words"), "dup_line_share": share("n_dup_lines", "n_lines"), "repeat_word_share": share("n_repeat_words", "n_words")})


def limits(measured: DataFrame, least_rows: int = 30, k: int = 4000) -> DataFrame:
    """(lang, source) with quartiles of each measure, from KLL sketches of the rows that have words.

    Sketches are built a group and merged into one a language, which stands in where a group has under `least_rows` rows
    (without limits if the language has as few). Sketches have a size bound of their own, whatever a group's size."""
    sketches = {m: F.kll_sketch_agg_double(m, F.lit(k)) for m in MEASURES}
    groups = stored(_shares(measured.where("n_words > 0")).groupBy("lang", "source").agg(F.count("*").alias("n"), *[s.alias(m) for m, s in sketches.items()]))
    langs = groups.groupBy("lang").agg(F.sum("n").alias("n_lang"), *[F.kll_merge_agg_double(m).alias(f"{m}_lang") for m in MEASURES])
    both = small_join(groups, langs, ["lang"])
    own, other = F.col("n") >= least_rows, F.col("n_lang") >= least_rows
    for m in MEASURES:
        both = both.withColumn(m, F.when(own, F.col(m)).when(other, F.col(f"{m}_lang")))
        for q in (25, 50, 75):
            both = both.withColumn(f"{m}_{q}", F.kll_sketch_get_quantile_double(F.col(m), F.lit(q / 100)))
    return both.select("lang", "source", *[f"{m}_{q}" for m in MEASURES for q in (25, 50, 75)])


def _within(m: str, margin: float, spread: float) -> Column:
    """Whether measure `m` lies within its limits: the median plus `spread` interquartile ranges plus the margin, wider for
    short texts, whose means vary more."""
    width = (F.lit(spread) * (F.col(f"{m}_75") - F.col(f"{m}_25")) + F.lit(margin)) * F.sqrt(1 + F.lit(200.0) / F.greatest(F.col("n_words"), F.lit(1)))
    off = F.col(m) - F.col(f"{m}_50")
    return F.coalesce((F.abs(off) if m in TWO_SIDED else off) <= width, F.lit(True))


def quality_rules(docs: DataFrame, window: int = 8, min_words: int = 20, max_repeat_percent: int = 30, spread: float = 4.0, least_rows: int = 30, k: int = 4000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fixed base rules and adaptive limits for each whole text.

    base_failed: fewer than `min_words` words, or over `max_repeat_percent` % of the words in repeated windows. kept: not
    failed, and every measure within the limits of its language and source. Null languages and sources are groups of
    their own; null and empty texts have no words and fail; repeated rows are judged each; an empty table gives no
    rows; other columns are not read. The limits (one row a language and source) are joined by broadcast if few, else by
    shuffle."""
    measured = measure(docs, window, id_col, text_col)
    df = small_join(_shares(measured), limits(measured, least_rows, k), ["lang", "source"])
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    fits = F.lit(True)
    for m, margin in MEASURES.items():
        fits = fits & _within(m, margin, spread)
    df = df.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & fits)
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def _sql() -> str:
    shares = {"mean_word_chars": "word_chars / n_words", "symbols_per_word": "n_symbols / n_words", "dup_line_share": "n_dup_lines / n_lines", "repeat_word_share": "n_repeat_words / n_words"}
    quart = ", ".join(f"quantile_disc({m}, {q / 100}) as {m}_{q}" for m in shares for q in (25, 50, 75))
    pick = ", ".join(f"case when g.n >= 30 then g.{m}_{q} when l.n >= 30 then l.{m}_{q} end as {m}_{q}" for m in shares for q in (25, 50, 75))
    fits = " and ".join(f"coalesce({'abs' if m in TWO_SIDED else ''}({m} - {m}_50) <= (4.0::double * ({m}_75 - {m}_25) + {margin}::double) * sqrt(1 + 200.0::double / n_words), true)" for m, margin in MEASURES.items())
    return rf"""
with d as (select row_number() over () as rid, doc_id, lang, source, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
u as (select rid, i, array_to_string(ws[i:i + 7], ' ') as win from (select rid, ws, unnest(generate_series(1, len(ws) - 7)) as i from w where len(ws) >= 8)),
r as (select rid, i from (select rid, i, count(*) over (partition by rid, win) as c from u) where c >= 2),
s as (select rid, sum(least(8, coalesce(nxt - i, 8))) as n_repeat_words from (select rid, i, lead(i) over (partition by rid order by i) as nxt from r) group by rid),
m as (select w.rid, doc_id, lang, source, cast(len(ws) as bigint) as n_words, cast(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) as bigint) as word_chars,
      cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(len(ls) as bigint) as n_lines,
      cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines, cast(coalesce(s.n_repeat_words, 0) as bigint) as n_repeat_words from w left join s on w.rid = s.rid),
q as (select *, {', '.join(f"case when n_words > 0 then cast({e.split(' / ')[0]} as double) / {e.split(' / ')[1]} end as {m}" for m, e in shares.items())} from m),
g as (select lang, source, count(*) as n, {quart} from q where n_words > 0 group by lang, source),
l as (select lang, count(*) as n, {quart} from q where n_words > 0 group by lang),
t as (select g.lang, g.source, {pick} from g join l on g.lang is not distinct from l.lang),
b as (select q.*, t.* exclude (lang, source), n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed
      from q left join t on q.lang is not distinct from t.lang and q.source is not distinct from t.source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {fits} as kept from b
"""


SQL = _sql()
