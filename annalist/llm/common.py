"""What the training-data operators share: table reads, scratch tables, words, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.scratch import components, join_groups, shared_dir, spool

#: A word is a maximal run of characters outside this class.
BLANK = r"[\x20\x09-\x0D]"
BLANK_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table, so that other columns of the input never clash."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once per row, although body uses it in lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null and blank texts."""
    inner = F.btrim(text, F.lit(BLANK_CHARS))
    return F.when(F.coalesce(inner, F.lit("")) == "", F.array().cast("array<string>")).otherwise(
        F.split(inner, BLANK + "+")
    )


__all__ = ["BLANK", "BLANK_CHARS", "components", "join_groups", "let", "shared_dir", "spool", "table", "words"]
