"""Benchmark decontamination: short test items inside long documents.

Items are partitioned by the size of their n-gram sets, a power of two each. A partition has its own
k: an item is sketched by its k smallest MinHash values, half of its n-grams or so, and m, the least
number of hits, is such that a document holding the threshold share of the item has m hits with
the stated recall. A document's whole set of n-grams is probed against these minima (a sketch of
the document itself could not see an item of forty words in ten thousand). Candidates are
verified on the n-grams as words.

Documents are scanned once, whatever the size of the benchmark: no shuffle, no hot key. Items are
indexed in blocks of at most ``BLOCK_CHARS`` characters. One block is broadcast; more are made by a
job of their own and written to the shared folder, where a task reads them one after the other for
each ``GROUP_WORDS`` words of its documents.

Defined results. Null or blank text or item: no n-grams, no rows. Items of fewer than five words
are one n-gram of all their words. Null or repeated ids are carried through, repeated items are found
each. Very long texts are searched whole. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
import pickle
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import shared_dir
from annalist.llm.shingles import N_WORDS, WordHashes, ngrams

THRESHOLD = (4, 5)
RECALL = 1 - 1e-9
LEAST_SKETCH, SKETCH = 8, 32
BLOCK_CHARS = 4_000_000
#: Words of documents held together for the blocks in files, and for the one in memory.
GROUP_WORDS, HELD_WORDS = 4_000_000, 200_000
_FILTER = np.uint64((1 << 20) - 1)
FOUND = "doc_id long, item_id long, n_item_ngrams long, n_found long, containment double"


def least_hits(n: int, k: int, recall: float = RECALL) -> int:
    """The largest m such that an item of n n-grams, of which at most a fifth is missing from the
    document, has m or more of its k sampled n-grams there with the recall (hypergeometric)."""
    missing = n - math.ceil(n * THRESHOLD[0] / THRESHOLD[1])
    tail, m = 0.0, 0
    for hits in range(0, k + 1):
        lost = k - hits
        if lost <= missing and hits <= n - missing:
            tail += math.comb(missing, lost) * math.comb(n - missing, hits) / math.comb(n, k)
        if tail > 1 - recall:
            return max(1, m)
        m = hits + 1
    return max(1, min(m, k))


def size_class(n: int) -> int:
    """The partition of an item of n n-grams: the power of two at or below."""
    return 1 << (n.bit_length() - 1)


@cache
def sketch_of(size: int) -> tuple[int, int]:
    """(k, m) of a size partition: values sampled of each item, and the least hits of any of its sizes."""
    k = max(LEAST_SKETCH, min(SKETCH, size // 2))
    return k, min(least_hits(n, min(n, k)) for n in range(size, 2 * size))


@dataclass
class SizePartition:
    """Sorted minima of the items of one size, and which item each belongs to."""

    keys: np.ndarray
    owner: np.ndarray
    least: int

    def candidates(self, near: np.ndarray) -> np.ndarray:
        """Items with enough of their minima among the n-grams."""
        lo, hi = np.searchsorted(self.keys, near, "left"), np.searchsorted(self.keys, near, "right")
        count = hi - lo
        hit = np.repeat(lo, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        item, hits = np.unique(self.owner[hit], return_counts=True)
        return item[hits >= self.least]


@dataclass
class ItemIndex:
    """The items of a block with one n-gram length, by size, and what verifies them."""

    n_words: int
    parts: list[SizePartition]
    filter: np.ndarray
    item_ids: list
    grams: list[frozenset]

    @staticmethod
    def build(n_words: int, items: list[tuple[object, list[bytes]]]) -> ItemIndex:
        memo, ids, grams = WordHashes(), [], []
        by_size: dict[int, list[tuple[np.ndarray, int]]] = {}
        for item_id, words in items:
            distinct = np.unique(ngrams(memo.of(words), n_words))
            size = size_class(len(distinct))
            k = min(len(distinct), sketch_of(size)[0])
            sample = distinct[np.argsort(distinct * np.uint64(0xD6E8FEB86659FD93), kind="stable")[:k]]
            by_size.setdefault(size, []).append((sample, len(ids)))
            ids.append(item_id)
            grams.append(frozenset(tuple(words[i : i + n_words]) for i in range(len(words) - n_words + 1)))
        parts, seen = [], np.zeros(int(_FILTER) + 1, bool)
        for size, found in sorted(by_size.items()):
            key = np.concatenate([sample for sample, _ in found])
            owner = np.repeat([i for _, i in found], [len(sample) for sample, _ in found])
            order = np.argsort(key, kind="stable")
            parts.append(SizePartition(key[order], owner[order], sketch_of(size)[1]))
            seen[key & _FILTER] = True
        return ItemIndex(n_words, parts, seen, ids, grams)

    def candidates(self, grams: np.ndarray) -> list[int]:
        near = np.unique(grams[self.filter[grams & _FILTER]])
        return [int(i) for part in self.parts for i in part.candidates(near)] if len(near) else []

    def found(self, words: list[bytes], candidates: list[int]) -> Iterator[tuple[object, int, int]]:
        """(item id, its n-grams, those in the text) of the candidates that the text holds."""
        n, (num, den) = self.n_words, THRESHOLD
        own = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}
        for i in candidates:
            common = len(self.grams[i] & own)
            if den * common >= num * len(self.grams[i]):
                yield self.item_ids[i], len(self.grams[i]), common


def indexes(items: list[tuple[object, str]]) -> list[ItemIndex]:
    by_length: dict[int, list] = {}
    for item_id, text in items:
        words = (text or "").encode().split()
        if words:
            by_length.setdefault(min(N_WORDS, len(words)), []).append((item_id, words))
    return [ItemIndex.build(n, found) for n, found in sorted(by_length.items())]


def stored_blocks(items: DataFrame, n: int) -> list[str]:
    """Indexes the items in n blocks in the shared folder; the files' paths."""
    folder = f"{shared_dir(items.sparkSession)}/items-{uuid.uuid4().hex}"

    def build(block: pa.Table) -> pa.Table:
        found = indexes(list(zip(block["item_id"].to_pylist(), block["text"].to_pylist(), strict=True)))
        return pa.table({"block": pa.array([pickle.dumps(found)], pa.binary())})

    # the row's number keeps copies of one item from meeting in one block
    number = F.pmod(F.xxhash64("item_id", "text", F.monotonically_increasing_id()), F.lit(n))
    items.withColumn("_block", number).groupBy("_block").applyInArrow(build, "block binary").write.parquet(folder)
    return sorted(items.sparkSession.read.parquet(folder).inputFiles())


def _read_blocks(paths: list[str]) -> Iterator[list[ItemIndex]]:
    for path in paths:
        fs, name = pyarrow.fs.FileSystem.from_uri(path)
        with fs.open_input_file(name) as file:
            for batch in pyarrow.parquet.ParquetFile(file).iter_batches(batch_size=1):
                yield from map(pickle.loads, batch.column(0).to_pylist())


def _search(docs: DataFrame, blocks: Callable[[], Iterator[list[ItemIndex]]], by_batch: bool) -> DataFrame:
    """Probes groups of documents, of ``HELD_WORDS`` or ``GROUP_WORDS`` words, against all blocks."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_item_ngrams", pa.int64()), ("n_found", pa.int64()), ("containment", pa.float64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, held, size = WordHashes(), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            out = []
            for block in blocks():
                for doc_id, words, hashes in held:
                    for index in block:
                        candidates = index.candidates(ngrams(hashes, index.n_words))
                        if candidates:
                            out.extend((doc_id, i, n, k, k / n) for i, n, k in index.found(words, candidates))
            held.clear()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1), strict=True):
                words = (text.as_py() or b"").split()
                held.append((doc_id.as_py(), words, memo.of(words)))
                size += len(words)
                if size >= (HELD_WORDS if by_batch else GROUP_WORDS):
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    body = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    return docs.select("doc_id", body.alias("text")).mapInArrow(run, FOUND)


def search(docs: DataFrame, items: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, ...) for every item of which a document holds 0.8 or more."""
    kept = items.select("item_id", "text").filter(F.col("text").isNotNull())
    total = kept.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if total <= block_chars:
        shared = docs.sparkSession.sparkContext.broadcast(indexes([(r.item_id, r.text) for r in kept.collect()]))
        return _search(docs, lambda: iter([shared.value]), by_batch=True)
    paths = stored_blocks(kept, math.ceil(1.5 * total / block_chars))
    return _search(docs, lambda: _read_blocks(paths), by_batch=False)
