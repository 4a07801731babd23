"""Quality rules: a ledger of failure bits and measurements, judged by versioned policies.

Every rule is evaluated once per document into one bit of ``failure_bits``, beside the numbers
it was decided on. A policy is a bit mask, so another policy, or a policy without one of its
rules, is a bitwise operation on the ledger and never reads a text again.

Native: DataFrame functions only. Everything about one document is computed in its own row, so
nothing is shuffled and no source or group of copies can be hot.

Defined results. Null text: as the empty text (no words; fails ``few_words``). Null or repeated
doc_id: rows are judged one by one and kept apart. Empty table: empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import BLANK_CHARS, let, words


@dataclass(frozen=True)
class Rule:
    """A document fails the rule if the SQL condition over the measurements holds."""

    name: str
    fails: str


#: The position in this tuple is the bit; append only, so that old ledgers stay readable.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "100 * n_symbols > 30 * n_words"),
    Rule("shouting", "100 * n_upper > 40 * word_chars"),
    Rule("long_words", "word_chars > 25 * n_words"),
    Rule("duplicate_lines", "n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines"),
)

#: Rules each policy version applies.
POLICIES = {
    "v1": ("few_words", "repeated_windows"),
    "v2": ("few_words", "repeated_windows", "symbols", "shouting", "long_words"),
}
CURRENT = "v2"


def bit(name: str) -> int:
    return 1 << [r.name for r in RULES].index(name)


def mask(policy: str) -> int:
    return sum(bit(name) for name in POLICIES[policy])


def repeat_words(word_array: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the text.

    Windows are compared by 64-bit hash. Equal ones become neighbours by a sort of the row's own
    array; covered words are then counted over the ordered window positions.
    """

    def covered(sorted_windows: Column) -> Column:
        twice = F.filter(
            sorted_windows,
            lambda e, i: (F.get(sorted_windows, i + 1)["h"] == e["h"])
            | (F.get(sorted_windows, F.when(i > 0, i - 1))["h"] == e["h"]),
        )
        places = F.sort_array(F.transform(twice, lambda e: e["i"]))
        return F.aggregate(
            places,
            F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
            lambda acc, p: F.struct(
                p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n")
            ),
            lambda acc: acc["n"],
        )

    def counted(w: Column) -> Column:
        starts = F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0)))
        hashes = F.transform(starts, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        return let(
            hashes,
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
                let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), covered)
            ),
        )

    return let(word_array, counted)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the measurements that the rules use; the text column goes."""
    body = F.coalesce(F.col(text), F.lit(""))
    chars = F.length(body)
    lines = F.filter(F.split(body, "\n"), lambda x: F.translate(x, BLANK_CHARS, "") != "")
    w = F.col("_words")
    return (
        docs.withColumn("_words", words(F.col(text)))
        .withColumn("_lines", lines)
        .withColumns(
            {
                "n_words": F.size(w).cast("long"),
                "word_chars": F.length(F.translate(body, BLANK_CHARS, "")).cast("long"),
                "n_symbols": (chars - F.length(F.translate(body, "#*$%&|<>", ""))).cast("long"),
                "n_lines": F.size("_lines").cast("long"),
                "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
                "n_repeat_words": repeat_words(w),
                "n_upper": (chars - F.length(F.regexp_replace(body, r"\p{Lu}+", ""))).cast("long"),
            }
        )
        .drop("_words", "_lines", text)
    )


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """Measurements and ``failure_bits`` of every document."""
    bits = F.lit(0).cast("long")
    for rule in RULES:
        failed = F.when(F.expr(rule.fails), F.lit(bit(rule.name))).otherwise(0).cast("long")
        bits = bits.bitwiseOR(failed)
    return measure(docs, text).withColumn("failure_bits", bits)


def apply_policy(entries: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Adds ``policy`` and ``kept``: no rule of the policy failed."""
    return entries.withColumn("policy", F.lit(policy)).withColumn(
        "kept", F.col("failure_bits").bitwiseAND(F.lit(mask(policy)).cast("long")) == 0
    )


def ablations(entries: DataFrame, policy: str = CURRENT) -> DataFrame:
    """For each rule of a policy: documents it fails, those only it fails, those kept without it.

    One pass with map-side aggregation over the ledger's distinct bit patterns.
    """
    m = mask(policy)
    patterns = entries.groupBy(F.col("failure_bits").bitwiseAND(F.lit(m).cast("long")).alias("bits")).count()
    sums = []
    for name in POLICIES[policy]:
        b = F.lit(bit(name)).cast("long")
        hit = F.col("bits").bitwiseAND(b) != 0
        alone = F.col("bits") == b
        passed = F.col("bits").bitwiseAND(F.lit(m & ~bit(name)).cast("long")) == 0
        for label, cond in (("n_failed", hit), ("n_only", alone), ("n_kept_without", passed)):
            value = F.coalesce(F.sum(F.when(cond, F.col("count"))), F.lit(0))
            sums.append(value.alias(f"{name}__{label}"))
    one = patterns.agg(*sums)
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("rule"),
                *[F.col(f"{name}__{x}").alias(x) for x in ("n_failed", "n_only", "n_kept_without")],
            )
            for name in POLICIES[policy]
        ]
    )
    return one.select(F.inline(rows)).withColumn("policy", F.lit(policy))
