"""Secret scans: keyword, access-key and hex patterns, and windowed entropy of other tokens.

Patterns give the base spans. The method adds spans of kind ``entropy``. Candidates are maximal tokens
of the base-64 alphabet in what the base spans leave; a token is judged by the narrowest character class
that holds it (hex, base 32, lower case with digits, base 64). A window slides over it while a fold
keeps the count of each character, five bits each, and the sum of c*log2(c), both changed only for
the character that enters and the one that leaves. A token is a secret if its highest window entropy
reaches the threshold of its class and no allow-list rule suppresses it; if it is none, its parts
between ``/``, ``_`` and ``-`` are judged alone. Random tokens of 24 characters miss the
thresholds in one case of a hundred, longer ones less often.

Native: DataFrame functions only. Spark's functions give no match offsets, so a text is split at
the matches, and the lengths of pieces and matches are summed up in blocks of a square root of
their number. All work is inside a row and nearly linear in the text.

Defined results. Null text: empty, no spans. Empty spans hash as the empty string. Null or
repeated doc_id: rows are judged one by one. Very long texts and tokens are judged whole. Offsets are code
points, end exclusive. Empty table: no rows. Other columns are kept, but ``base`` and ``found``
are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import let

#: kind, pattern, and what a match must satisfy to count. Kinds sort in this order at equal starts.
ASSIGN = r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Maximal tokens that may be secrets; a token is judged by the first class that holds it.
CANDIDATE = r"[A-Za-z0-9+][A-Za-z0-9+/_-]{23,}={0,2}"
#: Parts of a token that is none as a whole.
PART = r"[A-Za-z0-9+]{24,}={0,2}"
KINDS = ("assign", "access", "hex", "entropy")


@dataclass(frozen=True)
class CharClass:
    """A token belongs to the class if the pattern matches it whole."""

    name: str
    pattern: str
    threshold: float


WINDOW = 24
#: The characters of candidates.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
#: Thresholds are values that no counts give exactly.
CLASSES = (
    CharClass("hex", r"^([0-9a-f]+|[0-9A-F]+)$", 2.99),
    CharClass("base32", r"^[A-Z2-7]+=*$", 3.49),
    CharClass("lower", r"^[a-z0-9]+=*$", 3.54),
    CharClass("base64", r"^[A-Za-z0-9+/_-]+=*$", 3.79),
)
SPAN = "struct<start:int,order:int,kind:string,stop:int,value:string>"
#: A candidate that one of these matches is no secret: words without digits or in one case, UUIDs,
#: paths, counting runs, and values that say they are examples.
ALLOW = (
    r"^[^0-9]*$",
    r"^[0-9_=+/-]*$",
    r"^([a-z]*|[A-Z]*)[0-9]{0,4}[_=-]*$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^/?([a-z0-9_-]+/)+[a-z0-9_-]*$",
    r"(?i)example|sample|placeholder|0123456789|abcdefghij|xxxxxxxx",
)


def running(values: Column, combine) -> Column:
    """The first value, the first two combined, the first three, .. of an array of ints.

    A fold that appends copies what it has, so it runs in blocks of a square root of the length.
    """

    def appended(block: Column) -> Column:
        none = F.array().cast("array<int>")
        return F.aggregate(block, none, lambda acc, x: F.concat(acc, F.array(F.coalesce(combine(F.get(acc, F.size(acc) - 1), x), x))))

    def blocked(v: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(v))).cast("int"), F.lit(1))
        starts = F.sequence(F.lit(1), F.size(v), width)
        return let(F.transform(starts, lambda a: appended(F.slice(v, a, width))), joined_up)

    def joined_up(blocks: Column) -> Column:
        ends = appended(F.transform(blocks, lambda b: F.get(b, F.size(b) - 1)))
        return let(ends, lambda e: F.flatten(F.transform(blocks, lambda b, k: F.transform(b, lambda x: F.coalesce(combine(F.get(e, k - 1), x), x)))))

    return F.when(F.size(values) > 0, let(values, blocked)).otherwise(F.array().cast("array<int>"))


def _larger(a: Column, b: Column) -> Column:
    return F.when(a > b, a).otherwise(b)


def spans_of(text: Column, kind: str, pattern: str) -> Column:
    """array<SPAN> of the leftmost non-overlapping matches."""
    pieces = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("gap"))

    def located(p: Column) -> Column:
        ends = running(F.transform(p["m"], lambda m, k: F.length(m) + F.length(F.get(p["gap"], k))), lambda a, b: a + b)

        def span(stop: Column, k: Column) -> Column:
            m = F.get(p["m"], k)
            return F.struct(
                (stop - F.length(m)).alias("start"), F.lit(KINDS.index(kind)).alias("order"), F.lit(kind).alias("kind"),
                stop.alias("stop"), m.alias("value"),
            )

        return F.transform(ends, span).cast(f"array<{SPAN}>")

    return F.when(text.rlike(pattern), let(pieces, located)).otherwise(F.array().cast(f"array<{SPAN}>"))


def _indices(token: Column) -> Column:
    """The place of each character in the alphabet."""
    return F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)


#: Counts of a window in whole numbers of five bits each.
_BITS, _PER_WORD = 5, 12
#: Characters that are looked at first in a longer token.
_FIRST = 200


def max_entropy(token: Column, window: int = WINDOW) -> Column:
    """Highest Shannon entropy, in bits a character, of any window of the token; windows of at most 31.

    The fold over positions carries the counts, the sum of c*log2(c) and the least sum seen in a
    full window; entropy = log2(w) - sum / w, so the least sum is the highest entropy.
    """
    n_words = -(-len(ALPHABET) // _PER_WORD)
    weight = F.lit([c * math.log2(c) if c > 1 else 0.0 for c in range(window + 2)])
    zero = F.lit(0).cast("long")

    def slot(k: Column, mark: str) -> list[Column]:
        """Where the count of character k is: its word, its shift there, and one of it."""
        shift = F.pmod(k, F.lit(_PER_WORD)) * _BITS
        return [
            (k / _PER_WORD).cast("int").alias(f"{mark}_word"), shift.alias(f"{mark}_shift"),
            F.call_function("shiftleft", F.lit(1).cast("long"), shift).alias(f"{mark}_one"),
        ]

    def moves(codes: Column) -> Column:
        """For each position what enters and what leaves, and whether the window is full before it."""
        pairs = F.transform(codes, lambda e, i: F.struct(e.alias("e"), F.get(codes, i - window).alias("x"), (i >= window).alias("full")))
        return F.transform(pairs, lambda p: F.struct((p["e"] == p["x"]).alias("same"), p["full"], *slot(p["e"], "e"), *slot(p["x"], "x")))

    def count(counts: Column, p: Column, mark: str) -> Column:
        word = F.get(counts, p[f"{mark}_word"])
        return F.call_function("shiftright", word, p[f"{mark}_shift"]).bitwiseAND(F.lit(31).cast("long")).cast("int")

    def step(acc: Column, p: Column) -> Column:
        up, down = count(acc["counts"], p, "e"), count(acc["counts"], p, "x")
        delta = F.get(weight, up + 1) - F.get(weight, up) + F.coalesce(F.get(weight, down - 1) - F.get(weight, down), F.lit(0.0))
        counts = F.array(*[
            F.get(acc["counts"], F.lit(k)) + F.when(p["e_word"] == k, p["e_one"]).otherwise(zero) - F.when(p["x_word"] == k, p["x_one"]).otherwise(zero)
            for k in range(n_words)
        ])
        same = F.coalesce(p["same"], F.lit(False))
        return F.struct(
            F.when(same, acc["counts"]).otherwise(counts).alias("counts"),
            F.when(same, acc["total"]).otherwise(acc["total"] + delta).alias("total"),
            F.when(p["full"], F.least(acc["least"], acc["total"])).otherwise(acc["least"]).alias("least"),
        )

    start = F.struct(F.array(*[zero] * n_words).alias("counts"), F.lit(0.0).alias("total"), F.lit(float("inf")).alias("least"))
    least = F.aggregate(let(_indices(token), moves), start, step, lambda acc: F.least(acc["least"], acc["total"]))
    return F.lit(math.log2(window)) - least / window


def is_secret(token: Column) -> Column:
    """Some window reaches the threshold of the token's class and no allow-list rule matches."""
    threshold = F.lit(None).cast("double")
    for cls in reversed(CLASSES):
        threshold = F.when(token.rlike(cls.pattern), cls.threshold).otherwise(threshold)
    # where the first windows of a long token settle it, the others needn't be seen
    views = F.when(F.length(token) > _FIRST, F.array(F.substring(token, 1, _FIRST), token)).otherwise(F.array(token))
    reached = F.exists(views, lambda t: max_entropy(t) >= threshold)
    allowed = F.lit(False)
    for pattern in ALLOW:
        allowed = allowed | token.rlike(pattern)
    return F.when(allowed | (F.length(token) < WINDOW), F.lit(False)).otherwise(reached)


def entropy_spans(text: Column) -> Column:
    """array<SPAN> of the candidates that are secrets, else of their parts that are."""

    def judged(s: Column) -> Column:
        parts = F.filter(spans_of(s["value"], "entropy", PART), lambda p: is_secret(p["value"]))
        moved = F.transform(parts, lambda p: p.withField("start", p["start"] + s["start"]).withField("stop", p["stop"] + s["start"]))
        none = F.array().cast(f"array<{SPAN}>")
        return F.when(is_secret(s["value"]), F.array(s)).when(s["value"].rlike("[/_-]"), moved).otherwise(none)

    return F.flatten(F.transform(spans_of(text, "entropy", CANDIDATE), judged))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``base`` and ``found`` (base and entropy spans), ordered by start, then kind."""
    body = F.coalesce(F.col(text), F.lit(""))
    assign = F.filter(
        spans_of(body, "assign", ASSIGN), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 1)) >= 6
    )
    base = F.concat(assign, spans_of(body, "access", ACCESS), spans_of(body, "hex", HEX))
    left = replaced(body, F.col("base"), lambda width: F.repeat(F.lit(" "), width))
    return docs.withColumn("base", F.sort_array(base)).withColumn("found", F.sort_array(F.concat("base", let(left, entropy_spans))))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined in order."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ","
    )


#: Code points of a block of text: a piece of a text is cut from the blocks that hold it.
_BLOCK = 2048


def replaced(text: Column, spans: Column, mark) -> Column:
    """The text with every span, sorted by start, replaced by mark(its width); overlapping ones together."""

    def united(s: Column) -> Column:
        """Runs of overlapping spans as (start, stop)."""

        def from_reach(reach: Column) -> Column:
            heads = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: (k == 0) | (F.get(s, k)["start"] >= F.get(reach, k - 1)))
            return let(heads, lambda h: F.transform(h, lambda k, j: F.struct(
                F.get(s, k)["start"].alias("start"), F.get(reach, F.coalesce(F.get(h, j + 1), F.size(s)) - 1).alias("stop")
            )))

        return let(running(F.transform(s, lambda x: x["stop"]), _larger), from_reach)

    def joined_up(held: Column) -> Column:
        runs, blocks = held["runs"], held["blocks"]

        def piece(first: Column, stop: Column) -> Column:
            at = (first / _BLOCK).cast("int")
            near = F.array_join(F.slice(blocks, at + 1, (stop / _BLOCK).cast("int") - at + 1), "")
            return F.substr(near, first - at * _BLOCK + 1, stop - first)

        def behind(k: Column) -> Column:
            return F.coalesce(F.get(runs, k)["stop"], F.lit(0))

        parts = F.transform(runs, lambda r, k: F.concat(piece(behind(k - 1), r["start"]), mark(r["stop"] - r["start"])))
        return F.concat(F.array_join(parts, ""), piece(behind(F.size(runs) - 1), held["size"]))

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0))
    own = F.struct(let(spans, united).alias("runs"), blocks.alias("blocks"), F.length(text).alias("size"))
    return F.when(F.size(spans) == 0, text).otherwise(let(own, joined_up))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced; overlapping spans are replaced together."""
    return replaced(text, spans, lambda _: F.lit(mark))
