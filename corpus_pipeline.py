"""A corpus in five stages: toxic documents go, near-copies go, secrets are masked, sources are mixed, texts are encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again as the next one's docs;
all but the last return the columns of `documents`. Nulls, empty texts, repeated rows, empty tables and extra columns are allowed:
see each stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwire.llm import bpe, jaccard, mixing, secrets, toxicity
from siftwire.llm.common import bucket, dropped, stored, table


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that `docs` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def columns(docs: DataFrame) -> list:
    """The columns of `docs` by their whole names, dots included."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def packed(docs: DataFrame) -> Column:
    """All columns of a row as one, `__row`, its fields being named by their places: an operator carries it whatever they are called."""
    return F.struct(*[c.alias(f"c{i}") for i, c in enumerate(columns(docs))]).alias("__row")


def unpacked(docs: DataFrame) -> list:
    return [F.col("__row")[f"c{i}"].alias(c) for i, c in enumerate(docs.columns)]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that operator 4 does not call toxic (score under 0.7), learnt from the labels of two thirds of the ids. Documents
    without text stay."""
    labels = table(spark, sf_dir, "labels")
    model = toxicity.train(docs.select("doc_id", "text").where(bucket("doc_id", 3) != 1), labels.where(bucket("doc_id", 3) != 1))
    rows = docs.select("doc_id", "text", packed(docs))
    return toxicity.score_toxicity(rows, model, keep=("__row",)).where("predicted = 0").select(*unpacked(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that operator 8 links (five words, Jaccard similarity of 0.8 or more): the least id. Documents without
    words are in no group and stay, as do rows without an id. Of repeated rows one stays; rows that share an id but not their text are
    documents of their own."""
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        found = jaccard.jaccard_join(docs, width=5, percent=80, counted=False)
        gone = stored(found.where("component_id < doc_id").select("doc_id"))
        return docs.join(gone, docs["doc_id"] == gone["doc_id"], "left_anti")
    key, row = fresh(docs, "__key"), fresh(docs, "__row")
    rows = stored(docs.withColumn(key, F.monotonically_increasing_id()))
    own = rows.where("doc_id is not null").select(F.col(key), "text")
    found = jaccard.jaccard_join(own, width=5, percent=80, id_col=key, counted=False).where("n_shingles > 0").select(F.col("doc_id").alias("row"), "component_id")
    found = stored(found.join(rows.select(F.col(key).alias("row"), F.col("doc_id").alias("id")), "row"))
    first = found.groupBy("component_id").agg(F.min(F.struct("id", "row")).alias("first"))
    gone = stored(found.join(first, "component_id").where("row <> first.row").select(F.col("row").alias(row)))
    return rows.join(gone, rows[key] == gone[row], "left_anti").select(*columns(docs))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each span that operator 1 finds being replaced by [SECRET]; n_chars follows. Null texts stay null."""
    out = secrets.scan_secrets(docs.select("doc_id", "text", packed(docs)), secrets.train(docs.select("doc_id", "text")), redact="[SECRET]", keep=("__row",))
    row, found = dict(zip(docs.columns, unpacked(docs), strict=True)), F.col("spans") != ""
    text = F.when(row["text"].isNotNull(), F.col("redacted"))
    new = {"text": text.alias("text"), "n_chars": F.when(found, F.length(text)).otherwise(row["n_chars"]).cast("long").alias("n_chars")}
    return out.select(*[new.get(c, row[c]) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as operator 10 takes it (0 to 2 times). Null and empty texts count no words and are taken by their
    place in the sample, as all rows are. Columns of `docs` may have any names: those added here have others."""
    key, row, times, copy = (fresh(docs, f"__{c}") for c in ("key", "row", "times", "copy"))
    rows = stored(docs.withColumn(key, F.monotonically_increasing_id()))
    taken = mixing.mix_sources(rows.select("doc_id", "text", "source", key), row_col=key).where("copies > 0")
    copies = taken.select(F.col(key).alias(row), F.col("copies").cast("int").alias(times))
    out = rows.join(copies, rows[key] == copies[row])
    return out.select(*columns(docs), F.explode(F.sequence(F.lit(1), F.col(times))).alias(copy)).drop(copy)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded text of each document by operator 7. Null and empty texts have no tokens; repeated rows are
    encoded each; very long texts are encoded whole."""
    return bpe.encode_texts(docs)


STAGES = [("toxicity", drop_toxic), ("jaccard_join", drop_near_copies), ("secret_scan", mask_secrets), ("mix_sources", mix), ("bpe", encode)]

#: SQL can't express the models of the first and third stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table `documents`."""
    docs, before = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
        dropped(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
