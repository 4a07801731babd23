"""From raw documents to packed sequences: five stages, each written before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm import decontam, mil, ngram_join, packing, secrets
from annalist.llm.common import spool, table
from annalist.llm.queries import tokenizer_files

DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")


def _numbered(docs: DataFrame) -> DataFrame:
    """The documents with a ``row`` number of their own: ids may be null, or repeat with any text.

    The numbers are written with the rows, since reading the same files again may number them anew.
    """
    return spool(docs.select(*DOCUMENTS, F.monotonically_increasing_id().alias("row")), "numbered")


def _without(rows: DataFrame, dropped: DataFrame, name: str) -> DataFrame:
    """The documents whose row is not among the dropped ones.

    The dropped rows are written first, so that their real size decides how they are joined.
    """
    gone = spool(dropped.select("row").distinct(), name)
    return rows.join(gone, "row", "left_anti").select(*DOCUMENTS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    labels = table(spark, sf_dir, "labels", "doc_id", "quality").withColumnRenamed("quality", "label")
    docs = docs.select(*DOCUMENTS)
    scored = mil.add_score(docs, mil.train(docs, labels), DOCUMENTS)
    return scored.filter(F.col("score") >= mil.CUT).select(*DOCUMENTS)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays: that of the smallest id, null being the
    largest; among rows of one id the one of least hash. Texts without words are no duplicates."""
    rows = _numbered(docs)
    found = ngram_join.join(rows.select(F.col("row").alias("doc_id"), "text"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64("text", "lang", "source", "n_chars").alias("hash"), "row")
    linked = found.filter("n_links > 0").select(F.col("doc_id").alias("row"), "class_id")
    placed = spool(linked.join(rows.select("row", order.alias("place")).hint("merge"), "row"), "linked")
    first = placed.groupBy("class_id").agg(F.min("place").alias("place")).select("place.row")
    return _without(rows, placed.join(first.hint("merge"), "row", "left_anti"), "near-duplicates")


def keep_untested(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    items = table(spark, sf_dir, "benchmark", "item_id", "text")
    rows = _numbered(docs)
    found = decontam.search(rows.select(F.col("row").alias("doc_id"), "text"), items)
    return _without(rows, found.select(F.col("doc_id").alias("row")), "contaminated")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    found = secrets.scan(docs.select(*DOCUMENTS))
    clean = found.withColumn("text", secrets.redact(F.col("text"), F.col("found")))
    return clean.withColumn("n_chars", F.when(F.size("found") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*DOCUMENTS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as pieces of sequences of 2048 tokens."""
    docs = docs.select("doc_id", "text")
    return packing.pack(packing.cut(docs, tokenizer_files()), docs.count())


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram jaccard join", keep_distinct),
    ("benchmark decontamination", keep_untested),
    ("secret scans", redact_secrets),
    ("packing", pack),
]

#: SQL can't express a fitted classifier; the stages are tested one by one instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = spool(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
