"""N-gram Jaccard self-join: texts whose sets of word 5-grams have a Jaccard of 0.8 or more.

1. One pass over the texts makes, for each document, a 128-bit key of its n-gram set and its
   MinHash band hashes. Documents of equal sets are one class from here on, a numbered row with their
   smallest id, so exact copies never meet each other.
2. Band hashes are shuffled; in each bucket every class is linked to the smallest one only.
   The components of these links are the candidate groups: a candidate pair lies in one of them.
3. Full n-gram sets of grouped classes meet in tasks. A group beyond ``BLOCK`` classes, or
   ``BLOCK_NGRAMS`` n-grams, is cut into blocks and each pair of blocks is a key of its own, so
   a group of any size is spread over tasks of bounded memory. A task multiplies 0/1 matrices to
   count common n-grams, and returns the number of links of each class and a spanning forest
   of its links: rows in proportion to classes, never to pairs.
4. Components of the verified links give the class id, the smallest one of their documents.

Bands and rows come from ``bands_for``: a pair at the threshold shares a bucket with the stated
recall. Within a candidate group every pair is verified, so it is found if any chain of buckets
joins it.

Defined results. Null, empty or blank text: no n-grams, no links, its own class. Fewer than five
words: one n-gram of all of them. Null doc_id: class and links null. Rows that repeat a doc_id are documents of
their own, with one text or several. Very long texts are compared whole. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import components, join_groups, spool
from annalist.llm.shingles import MinHash, WordHashes, bands_for, shingle_set

THRESHOLD = (4, 5)  # Jaccard 0.8 as a fraction: compared in whole numbers
RECALL = 0.99999
MOST_HASHES = 160
BLOCK = 256
BLOCK_NGRAMS = 2_000_000


def signatures(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(doc_id, set_hi, set_lo, n_grams, keys): keys are the band hashes, empty without n-grams."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("set_hi", pa.int64()), ("set_lo", pa.int64()), ("n_grams", pa.int64()), ("keys", pa.list_(pa.int64()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, minhash = WordHashes(), MinHash(bands, rows)
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                grams = shingle_set(memo.of((text.as_py() or b"").split()))
                hi, lo = _set_key(grams)
                keys = minhash.band_hashes(grams) if len(grams) else np.empty(0, np.int64)
                for column, value in zip(out, (doc_id, hi, lo, len(grams), keys), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)

    body = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    return docs.select("doc_id", body.alias("text")).mapInArrow(
        run, "doc_id long, set_hi long, set_lo long, n_grams long, keys array<long>"
    )


def candidate_groups(classes: DataFrame) -> DataFrame:
    """(number, component) of the classes (number, keys) that share a bucket with another one."""
    bands = classes.select("number", F.explode("keys").alias("key"))
    low = bands.groupBy("key").agg(F.min("number").alias("low"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    edges = join_groups(bands, spool(low, "buckets"), ["key"]).filter("number <> low").select(F.col("number").alias("a"), F.col("low").alias("b"))
    return components(edges.distinct()).withColumnRenamed("id", "number")


def blocks(groups: DataFrame, classes: DataFrame) -> DataFrame:
    """(number, component, id, set_hi, set_lo, copies, block, n_blocks): the block of each class in its group."""
    of = classes.select("number", "id", "set_hi", "set_lo", "copies", "n_grams")
    sized = spool(groups.join(of.hint("merge"), "number"), "grouped")
    total = sized.groupBy("component").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n_grams") / BLOCK_NGRAMS)).cast("int").alias("n_blocks"),
        F.count(F.lit(1)).alias("n"),
    )
    placed = join_groups(sized.drop("n_grams"), spool(total, "group-sizes"), ["component"])
    return placed.withColumn("block", F.pmod(F.xxhash64("number"), F.col("n_blocks")).cast("int"))


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of the number of n-grams that two sets share."""
    n = len(sets)
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]], np.int64)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    values, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[place] > 1
    owner, place = owner[shared], (np.cumsum(count > 1) - 1)[place[shared]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    common = np.zeros((n, n), np.int64)
    wide = max(1, (16 << 20) // n)  # columns at a time: 64 MB of float32
    for first in range(0, int((count > 1).sum()), wide):
        lo, hi = np.searchsorted(place, (first, first + wide))
        m = np.zeros((n, wide if hi > lo else 0), np.float32)
        m[owner[lo:hi], place[lo:hi] - first] = 1
        common += np.rint(m @ m.T).astype(np.int64)
    np.fill_diagonal(common, [len(s) for s in sets])
    return common


def links_within(sets: list[np.ndarray], side: np.ndarray | None) -> np.ndarray:
    """Boolean matrix of the linked pairs; with sides, only pairs across them."""
    size = np.array([len(s) for s in sets], np.int64)
    common = _common(sets)
    num, den = THRESHOLD
    linked = den * common >= num * (size[:, None] + size[None, :] - common)
    np.fill_diagonal(linked, False)
    if side is not None:
        linked &= side[:, None] != side[None, :]
    return linked


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges (child, parent) that span every component of the pairs."""
    seen, edges = np.zeros(len(linked), bool), []
    for root in range(len(linked)):
        if seen[root]:
            continue
        seen[root] = True
        front = [root]
        while front:
            node = front.pop()
            for other in np.flatnonzero(linked[node] & ~seen):
                seen[other] = True
                edges.append((int(other), node))
                front.append(int(other))
    return edges


def _set_key(grams: np.ndarray) -> tuple[int, int]:
    hi, lo = np.frombuffer(xxhash.xxh3_128_digest(grams.tobytes()), ">i8")
    return int(hi), int(lo)


def verify(placed: DataFrame, docs: DataFrame) -> DataFrame:
    """(number, links, parent) rows: partial counts of links, and one parent a forest edge."""
    schema = pa.schema([("number", pa.int64()), ("links", pa.int64()), ("parent", pa.int64())])
    carried = ["number", "copies", "component", "block", "n_blocks"]

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The n-grams of each class, from the first row of its id that has them."""
        memo, open_, seen = WordHashes(), None, set()
        for b in batches:
            keep, grams = [], []
            keys = zip(*(b.column(c).to_pylist() for c in ("id", "number", "set_hi", "set_lo")), strict=True)
            for k, ((i, number, hi, lo), text) in enumerate(zip(keys, b.column("text"), strict=True)):
                if i != open_:
                    open_, seen = i, set()
                if number in seen:
                    continue
                own = shingle_set(memo.of((text.as_py() or b"").split()))
                if _set_key(own) == (hi, lo):
                    seen.add(number)
                    keep.append(k)
                    grams.append(own.tobytes())
            rows = b.select(carried).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(grams, pa.binary())], [*carried, "grams"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, {}, []

        def flush() -> None:
            if len(held) < 2:
                return
            numbers, (copies, block, grams) = list(held), zip(*held.values(), strict=True)
            side = np.array(block) if key[1] != key[2] else None
            linked = links_within([np.frombuffer(g, np.uint64) for g in grams], side)
            counts = linked.astype(np.int64) @ np.array(copies, np.int64)
            out.extend((numbers[k], int(counts[k]), None) for k in np.flatnonzero(counts))
            out.extend((numbers[a], 0, numbers[b]) for a, b in forest(linked))

        def batch() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], schema=schema)
            out.clear()
            return got

        for b in batches:
            for component, left, right, number, copies, block, grams in zip(*b.columns, strict=True):
                here = (component.as_py(), left.as_py(), right.as_py())
                if here != key:
                    flush()
                    key, held = here, {}
                held[number.as_py()] = (copies.as_py(), block.as_py(), grams.as_py())
                if len(out) >= 10_000:
                    yield batch()
        flush()
        if out:
            yield batch()

    text = docs.select(F.col("doc_id").alias("id"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("text"))
    # sorted by id, so the rows of one id follow each other; where a hot one is split, pairs keeps one of each class
    joined = placed.hint("merge").join(text, "id").select("id", "set_hi", "set_lo", *carried, "text")
    own = joined.mapInArrow(sets, "number long, copies long, component long, block int, n_blocks int, grams binary")
    others = F.transform(
        F.sequence(F.lit(0), F.col("n_blocks") - 1),
        lambda other: F.struct(F.least("block", other).alias("left"), F.greatest("block", other).alias("right")),
    )
    dealt = own.select("component", F.explode(others).alias("pair"), "number", "copies", "block", "grams").select(
        "component", "pair.left", "pair.right", "number", "copies", "block", "grams"
    )
    return (
        dealt.repartition("component", "left", "right")
        .sortWithinPartitions("component", "left", "right")
        .mapInArrow(pairs, "number long, links long, parent long")
    )


def join(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_links): class id is the smallest id of the component of links;
    n_links counts the other documents at or above the threshold, copies included."""
    bands, rows = bands_for(THRESHOLD[0] / THRESHOLD[1], RECALL, MOST_HASHES)
    signed = spool(signatures(docs, bands, rows), "signatures")
    known = signed.filter("doc_id is not null and n_grams > 0")
    of_set = known.groupBy("set_hi", "set_lo").agg(
        F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("keys").alias("keys"), F.first("n_grams").alias("n_grams")
    )
    classes = spool(of_set.withColumn("number", F.monotonically_increasing_id()), "classes")
    placed = spool(blocks(candidate_groups(classes), classes), "placed")
    found = spool(verify(placed, docs), "links")
    links = found.groupBy("number").agg(F.sum("links").alias("links"))
    edges = found.filter("parent is not null").select(F.col("number").alias("a"), F.col("parent").alias("b"))
    merged = components(edges).withColumnRenamed("id", "number").join(classes.select("number", "id").hint("merge"), "number")
    first = merged.groupBy("component").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n"))
    named = join_groups(merged.select("number", "component"), spool(first, "class-ids"), ["component"]).select("number", "class_id")
    of_class = (
        classes.select("set_hi", "set_lo", "number", "id", F.col("copies").alias("n"))
        .join(links.hint("merge"), "number", "left")
        .join(named.hint("merge"), "number", "left")
        .select(
            "set_hi", "set_lo", "n",
            F.coalesce("class_id", "id").alias("class_id"),
            (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        )
    )
    slim = join_groups(known.select("doc_id", "set_hi", "set_lo"), spool(of_class, "link-counts"), ["set_hi", "set_lo"]).select("doc_id", "class_id", "n_links")
    rest = signed.filter("doc_id is null or n_grams = 0").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.when(F.col("doc_id").isNotNull(), F.lit(0).cast("long")).alias("n_links")
    )
    return slim.union(rest)
