"""Ranked lexical search: benchmark items against all documents, by one automaton scan of the texts.

All terms of a block of items make one Aho-Corasick automaton, each guarded by a blank on either side. In a document
every character that is in no term becomes a blank and A-Z lower case, as bytes, so a match of a guarded term is an
occurrence of the whole term, whatever its neighbours. Two scans, no index of the documents:

1. Documents with a term, their terms in all, and in how many documents each of the block's terms lies: a few
   numbers a task, added up by Spark.
2. Term frequencies again from the texts; the automaton's outputs are term numbers, which a list maps to the items
   that hold them. A task keeps the best ``TOP`` documents of each item and adds only what passes the item's
   last one so far. Their ranks are found in two steps, parts of an item first, so no task gets more than a
   fixed number of rows an item from each task before it.

What is sent to tasks is bounded: blocks of items have at most ``BLOCK_CHARS`` characters, or one item. More blocks are
searched one after the other, each with two scans. Scores are whole numbers, added exactly.

Defined results. Null, empty or separator-only text: no terms, counted in neither N nor L, never found. Null or empty items:
no terms, no rows. Null, repeated or equal rows: each document is one of its own; equal scores by ascending
doc_id, null last, then any order of equal rows. Repeated items get rows each. Very long texts are scanned whole.
Empty tables: no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annalist.llm.common import spool

TOP = 50
BLOCK_CHARS = 1_000_000
#: Bytes scanned together, and cells of a table of documents by items.
STEP_BYTES, STEP_CELLS = 1 << 20, 1 << 20
#: Parts into which an item's candidates are ranked first.
PARTS = 64
#: Terms an item may have for its score to be exact in a double: w is at most 1000 ln(2N + 2), the rest at most 10^6.
EXACT_TERMS = 100_000
SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_UPPER = bytes(range(0x41, 0x5B))
_PLAIN = bytes.maketrans(SEPARATORS + _UPPER, b" " * len(SEPARATORS) + _UPPER.lower())


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_PLAIN).split()


@dataclass
class Items:
    """Terms of a block of items, by number, and the items of each term."""

    terms: list[bytes]
    starts: np.ndarray
    item_of: np.ndarray
    n_items: int
    most_terms: int

    @staticmethod
    def build(texts: list[str | None]) -> Items:
        items: dict[bytes, list[int]] = {}
        sets = [set(terms_of(t)) for t in texts]
        for k, found in enumerate(sets):
            for term in found:
                items.setdefault(term, []).append(k)
        terms = sorted(items)
        starts = np.cumsum([0, *(len(items[t]) for t in terms)])
        flat = np.array([k for t in terms for k in items[t]], np.int64)
        return Items(terms, starts, flat, len(texts), max(map(len, sets), default=0))

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for k, term in enumerate(self.terms):
            found.add_word(f" {term.decode('latin-1')} ", k)
        found.make_automaton()
        return found


RANKED = "item_id long, rank int, doc_id long, score long"
_PAIR = np.dtype([("end", np.int64), ("term", np.int64)])


def scan(automaton: ahocorasick.Automaton, n_terms: int, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts: their numbers of terms; then document, term and frequency of each pair found."""
    plain = [t.translate(_PLAIN) for t in texts]
    bounds = np.cumsum([0, *(len(t) + 1 for t in plain)])
    whole = b" " + b" ".join(plain) + b" "
    letter = np.frombuffer(whole, np.uint8) != 0x20
    first = np.flatnonzero(letter[1:] & ~letter[:-1])
    n = np.diff(np.searchsorted(first, bounds))
    hits = np.fromiter(automaton.iter(whole.decode("latin-1")), _PAIR) if n_terms else np.empty(0, _PAIR)
    # a match ends on the blank behind its term, which lies one further in ``whole``
    doc = np.searchsorted(bounds, hits["end"] - 1, "left") - 1
    key, tf = np.unique(doc * max(1, n_terms) + hits["term"], return_counts=True)
    return n, key // max(1, n_terms), key % max(1, n_terms), tf


def _steps(bodies: pa.Array, most_docs: int) -> Iterator[tuple[int, list[bytes]]]:
    """Texts of at most ``STEP_BYTES``, or one, with the place of the first."""
    held, size, at = [], 0, 0
    for k, body in enumerate(bodies):
        held.append(body.as_py())
        size += len(held[-1])
        if size >= STEP_BYTES or len(held) >= most_docs:
            yield at, held
            held, size, at = [], 0, k + 1
    if held:
        yield at, held


def _bodies(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("body"))


#: Rows of the counts that are no terms: documents with a term, and terms in all documents.
_N, _L = -1, -2


def counts(docs: DataFrame, shared) -> tuple[int, int, np.ndarray]:
    """N, L and the document frequency of every term of the broadcast block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        automaton, n_terms = items.automaton(), len(items.terms)
        df, some, total = np.zeros(n_terms, np.int64), 0, 0
        for b in batches:
            for _, texts in _steps(b.column(1), 1 << 30):
                n, _, term, _ = scan(automaton, n_terms, texts)
                df += np.bincount(term, minlength=n_terms)
                some += int(np.count_nonzero(n))
                total += int(n.sum())
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(seen, [_N, _L])), pa.array(np.append(df[seen], [some, total]))], ["term", "n"]
        )

    rows = _bodies(docs).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {r.term: r.n for r in rows}
    df = np.zeros(len(shared.value.terms), np.int64)
    for term, n in found.items():
        if term >= 0:
            df[term] = n
    return found.get(_N, 0), found.get(_L, 0), df


def _add(cells: np.ndarray, values: np.ndarray, size: int, exact: bool) -> np.ndarray:
    """Sums of whole numbers by cell; in two halves where doubles could round."""
    if exact:
        return np.bincount(cells, values, size).astype(np.int64)
    low = np.bincount(cells, values & 0xFFFFF, size).astype(np.int64)
    return low + (np.bincount(cells, values >> 20, size).astype(np.int64) << 20)


class Best:
    """The best documents of each item so far: score, then smallest id, null last."""

    def __init__(self, n_items: int):
        self.least = np.ones(n_items, np.int64)
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, item: np.ndarray, score: np.ndarray, doc_id: np.ndarray, no_id: np.ndarray) -> None:
        self.held.append(np.stack([item, score, doc_id, no_id]))
        self.size += len(item)
        if self.size > max(1 << 16, 3 * TOP * len(self.least)):
            self.cut()

    def cut(self) -> np.ndarray:
        """Rows item, score, doc_id, no_id of what is kept."""
        rows = np.concatenate(self.held, axis=1) if self.held else np.empty((4, 0), np.int64)
        rows = rows[:, np.lexsort((rows[2], rows[3], -rows[1], rows[0]))]
        first = np.searchsorted(rows[0], rows[0], "left")
        place = np.arange(rows.shape[1]) - first
        rows, last = rows[:, place < TOP], rows[:, place == TOP - 1]
        self.least[last[0]] = last[1]
        self.held, self.size = [rows], rows.shape[1]
        return rows


def _best_of_tasks(docs: DataFrame, shared, n_docs: int, n_terms_all: int, weight) -> DataFrame:
    """(item, doc_id, score): at most ``TOP`` rows an item from each task."""
    names = ["item", "score", "doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, w = shared.value, weight.value
        automaton, n_terms, n_items = items.automaton(), len(items.terms), items.n_items
        per_term, best = np.diff(items.starts), Best(n_items)
        exact = items.most_terms <= EXACT_TERMS
        for b in batches:
            ids = b.column(0)
            no_id, ids = ids.is_null().to_numpy(False).astype(np.int64), ids.fill_null(0).to_numpy()
            for at, texts in _steps(b.column(1), max(1, STEP_CELLS // n_items)):
                n, doc, term, tf = scan(automaton, n_terms, texts)
                m = 50 + (50 * n * n_docs) // max(1, n_terms_all)
                part = w[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
                times = per_term[term]
                place = np.repeat(items.starts[term], times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
                cell = np.repeat(doc, times) * n_items + items.item_of[place]
                score = _add(cell, np.repeat(part, times), len(texts) * n_items, exact)
                good = np.flatnonzero(score >= np.tile(best.least, len(texts)))
                of = at + good // n_items
                best.add(good % n_items, score[good], ids[of], no_id[of])
        item, score, doc_id, null = best.cut()
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(score), pa.array(doc_id, mask=null.astype(bool))], names)

    return _bodies(docs).mapInArrow(run, "item long, score long, doc_id long")


def _search_block(docs: DataFrame, block: list) -> DataFrame:
    """(item_id, rank, doc_id, score) of the items of one block, given as rows (item_id, text)."""
    spark = docs.sparkSession
    items = Items.build([r.text for r in block])
    if not items.terms:
        return spark.createDataFrame([], RANKED)
    shared = spark.sparkContext.broadcast(items)
    n_docs, n_terms_all, df = counts(docs, shared)
    w = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(k) + 1))) for k in df]
    weight = spark.sparkContext.broadcast(np.array(w, np.int64))
    found = _best_of_tasks(docs, shared, n_docs, n_terms_all, weight)
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    parted = found.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
    by_part = F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))
    some = parted.withColumn("place", by_part).filter(F.col("place") <= TOP)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= TOP)
    ids = spark.createDataFrame([(k, r.item_id) for k, r in enumerate(block)], "item long, item_id long")
    return ranked.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The best ``TOP`` documents with a score above 0 of every item."""
    kept = items.select("item_id", "text").filter(F.col("text").isNotNull())
    total = kept.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if total <= block_chars:
        return _search_block(docs, kept.collect())
    n = math.ceil(1.5 * total / block_chars)
    number = F.pmod(F.xxhash64("item_id", "text", F.monotonically_increasing_id()), F.lit(n))
    dealt = spool(kept.withColumn("block", number), "items")
    found = [spool(_search_block(docs, block), "ranks") for k in range(n) if (block := dealt.filter(F.col("block") == k).collect())]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out
