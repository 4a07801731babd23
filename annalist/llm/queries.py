"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm import chat, decontam, langid, lexical, mil, ngram_join, packing, periods, quality_rules, secrets, suffix_dedup, url_filters, warc
from annalist.llm.common import table
from annalist.llm.oracles import ORACLES


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document."""
    return ngram_join.join(table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url of pages, judged by base rules, then by rules mined from the labels of page_id."""
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad")
    labelled = pages.join(labels.withColumnRenamed("doc_id", "page_id").hint("merge"), "page_id").select("url", bad)
    judged = url_filters.judge(pages, url_filters.mine_rules(labelled))
    return judged.select("page_id", "host", "path", "rule", "verdict", "mined_rule", "mined_confidence")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, written to archives and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages", "page_id", "url", "html")).drop("target_uri")


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text."""
    found = secrets.scan(table(spark, sf_dir, "documents", "doc_id", "text"))

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(secrets.joined(F.col("base")), 256).alias("base_sha256"), secrets.joined(F.col("found")).alias("spans"),
    )


def tokenizer_files() -> tuple[str, str, str]:
    """Paths of the byte-level vocabulary, as both libraries want it, and its word pattern."""
    import public_tokenizers

    path = public_tokenizers.path
    return path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality").withColumnRenamed("quality", "label")
    return mil.score(docs, mil.train(docs, labels))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as packed pieces of sequences of 2048 tokens."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return packing.pack(packing.cut(docs, tokenizer_files()), docs.count())


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of all documents under the current policy."""
    entries = quality_rules.ledger(table(spark, sf_dir, "documents", "doc_id", "text"))
    base = quality_rules.mask("v1")
    return quality_rules.apply_policy(entries).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("failure_bits").bitwiseAND(F.lit(base).cast("long")) != 0).alias("base_failed"),
        "kept", "n_lines", "n_upper", "failure_bits", "policy",
    )


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in a document."""
    return decontam.search(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes removed from, and the hash of what is left of, every document."""
    return suffix_dedup.dedup(table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted and read back."""
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    return chat.digests(chat.format_turns(chat.as_parts(rows.union(extra))))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of every document, a tenth of which get a repeated tail."""
    docs = periods.with_repetitions(table(spark, sf_dir, "documents", "doc_id", "text"))
    return periods.digests(periods.find(docs))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    labelled = langid.label(docs, langid.train(docs))
    return labelled.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_url_filters": op2_url_filters,
    "op3_warc": op3_warc,
    "op4_secret_scans": op4_secret_scans,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_packing": op6_packing,
    "op7_quality_rules": op7_quality_rules,
    "op8_decontamination": op8_decontamination,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_chat_formatting": op10_chat_formatting,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_lexical_search": op12_lexical_search,
    "op13_language_id": op13_language_id,
}

__all__ = ["ORACLES", "QUERIES", "tokenizer_files"]
