"""Chat formatting of typed content parts.

A message holds an ordered list of parts: text, image, audio or document. A visitor turns each
part into text: text parts are escaped, the others become a placeholder, and their reference,
kind and expanded token count go into an attachment list in the same order. Each message becomes
one segment ``<<role>>body<</role>>``; a conversation is its segments in turn order.

Escaping: every ``<``, ``[``, ``]``, ``>``, ``|`` and backslash of a text or role is followed by
a backslash. A control string needs two of the template's own characters side by side, so none
survives inside a text, and dropping that backslash gives the text back exactly.

Segments are made row by row, so a conversation of any length is spread over all tasks. Only
the digests of a whole conversation, which are sequential by definition, read its segments in
order: as a stream from Spark's external sort, holding one segment at a time.

Very long texts are read back in a few passes, at some copies of the text in memory.

Defined results. Null text or null parts: empty. Null role: the empty role. Null or equal turns:
nulls first, ties by role, then text. Null conv_id: one conversation of its own. Unknown part
kinds: a placeholder of 0 tokens. Repeated rows are repeated turns. Empty table: no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One content part. A text has ``text``; the others have ``ref`` and their measures.
PART = (
    "struct<kind:string, text:string, ref:string, width:int, height:int, seconds:double, pages:int>"
)
#: Expanded tokens: image patches of this edge, tokens per second of audio and per document page.
PATCH, PER_SECOND, PER_PAGE = 28, 25, 512
ATTACHMENT = "struct<kind:string, ref:string, tokens:long>"
LOSS_ROLE = "assistant"

_SPECIAL = r"([<>\[\]|\\])"
_MARKS = "<>[]|"
_PLACEHOLDER = re.compile(r"<\|[a-z]+:\d+\|>")


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _SPECIAL, r"$1\\")


def unescape(text: str) -> str:
    """The text before it was escaped; ValueError if some control character was not.

    Every mark is followed by its own backslash, so marks can be put back one kind after the other;
    the backslashes left then are pairs.
    """
    for mark in _MARKS:
        if text.count(mark) != text.count(mark + "\\"):
            raise ValueError(f"bare {mark!r} inside a text")
        text = text.replace(mark + "\\", mark)
    if "\\" in text.replace("\\\\", ""):
        raise ValueError("bare backslash inside a text")
    return text.replace("\\\\", "\\")


def as_parts(rows: DataFrame) -> DataFrame:
    """Plain rows (conv_id, turn, role, text) as messages of one text part."""
    part = F.struct(F.lit("text").alias("kind"), F.col("text").alias("text")).cast("struct<kind:string, text:string>")
    fields = {x: F.lit(None) for x in ("ref", "width", "height", "seconds", "pages")}
    full = part
    for name, value in fields.items():
        full = full.withField(name, value)
    return rows.select("conv_id", "turn", "role", F.array(full.cast(PART)).alias("parts"))


def _tokens(part: Column) -> Column:
    kind = part["kind"]
    patches = F.ceil(part["width"] / PATCH) * F.ceil(part["height"] / PATCH)
    return F.coalesce(
        F.when(kind == "image", patches)
        .when(kind == "audio", F.ceil(part["seconds"] * PER_SECOND))
        .when(kind == "document", part["pages"].cast("long") * PER_PAGE),
        F.lit(0),
    ).cast("long")


def format_turns(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, parts) to (conv_id, turn, role, segment, loss, attachments).

    The visit is a fold over the parts: it carries the text so far and the attachments so far.
    A placeholder is ``<|kind:i|>`` with i the attachment's place in the message, from 0.
    """

    def visit(acc: Column, part: Column) -> Column:
        is_text = F.coalesce(part["kind"], F.lit("text")) == "text"
        kind = F.regexp_replace(F.coalesce(F.lower(part["kind"]), F.lit("")), "[^a-z]", "")
        kind = F.when(kind == "", "unknown").otherwise(kind)
        mark = F.concat(F.lit("<|"), kind, F.lit(":"), F.size(acc["found"]).cast("string"), F.lit("|>"))
        one = F.array(F.struct(kind.alias("kind"), part["ref"].alias("ref"), _tokens(part).alias("tokens")).cast(ATTACHMENT))
        return F.struct(
            F.concat(acc["body"], F.when(is_text, escape(part["text"])).otherwise(mark)).alias("body"),
            F.when(is_text, acc["found"]).otherwise(F.concat(acc["found"], one)).alias("found"),
        )

    start = F.struct(F.lit("").alias("body"), F.array().cast(f"array<{ATTACHMENT}>").alias("found"))
    parts = F.filter(F.coalesce(F.col("parts"), F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    role = F.coalesce(F.col("role"), F.lit(""))
    name = escape(role)
    return messages.withColumn("_flat", F.aggregate(parts, start, visit)).select(
        "conv_id",
        "turn",
        role.alias("role"),
        F.concat(F.lit("<<"), name, F.lit(">>"), F.col("_flat.body"), F.lit("<</"), name, F.lit(">>")).alias("segment"),
        (role == LOSS_ROLE).alias("loss"),
        F.col("_flat.found").alias("attachments"),
    )


def read_segment(segment: str) -> tuple[str, str]:
    """(role, text) of a segment; placeholders are no text.

    An escaped text has no two of the template's characters side by side, so the first ``>>`` ends the
    role, and what is between it and the closing mark is the body: some passes over the text, no more.
    """
    stop = segment.find(">>", 2)
    role = segment[2:stop]
    close = f"<</{role}>>"
    if not segment.startswith("<<") or stop < 0 or not segment.endswith(close) or len(segment) < stop + 2 + len(close):
        raise ValueError(f"not a segment: {segment[:80]!r}")
    body = _PLACEHOLDER.sub("", segment[stop + 2 : len(segment) - len(close)])
    return unescape(role), unescape(body)


DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string,"
    " formatted_chars long, n_attachments long, attachment_tokens long"
)


def digests(segments: DataFrame) -> DataFrame:
    """Reads every conversation back from its segments: one row of counts and hashes each."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
             ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_attachments", pa.int64()), ("attachment_tokens", pa.int64())]
        )
        open_id, state = None, None

        def closed(i, s) -> tuple:
            return (i, s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4], s[5], s[6])

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for b in batches:
            done = []
            for i, segment, loss, n_found, tokens in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if state is None or i != open_id:
                    if state is not None:
                        done.append(closed(open_id, state))
                    open_id, state = i, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                role, text = read_segment(segment)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                if loss:
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += len(segment)
                state[5] += n_found
                state[6] += tokens
            if done:
                yield batch(done)
        if state is not None:
            yield batch([closed(open_id, state)])

    # ties by text: the closing mark is no part of it
    body = F.substr("segment", F.lit(1), F.length("segment") - F.length(escape(F.col("role"))) - len("<</>>"))
    total = F.aggregate("attachments", F.lit(0).cast("long"), lambda acc, a: acc + a["tokens"])
    return (
        segments.select("conv_id", "turn", "role", "segment", "loss", F.size("attachments").alias("n_found"), total.alias("tokens"))
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", body)
        .select("conv_id", "segment", "loss", "n_found", "tokens")
        .mapInArrow(stream, DIGESTS)
    )
