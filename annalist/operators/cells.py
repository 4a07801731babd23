"""Vectors in cells around pivots: angles obey the triangle inequality, which tells what can't be near.

Pivots are the centres of a spherical k-means on a sample of at most ``SAMPLE`` vectors; every vector then
belongs to its nearest pivot. Only pivots, and a radius and a count a cell, are sent to tasks or the driver:
at most ``MOST_CELLS`` of them, whatever the input.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annalist.scratch import spool

MOST_CELLS, SAMPLE, ROUNDS = 4096, 1 << 15, 3
#: Stored vectors that a task holds, and queries that meet them there.
SLOT_ROWS, QUERY_BLOCK = 4096, 2048
#: Added to bounds of angles: what the arc cosine of a rounded cosine may be off.
SLACK = 1e-6
#: Arrow types of ids.
IDS = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def unit_rows(column: pa.Array) -> np.ndarray:
    """Vectors of length one as a matrix."""
    width = len(column[0]) if len(column) else 0
    rows = np.asarray(column.flatten(), np.float64).reshape(-1, width)
    size = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(size > 0, size, 1)


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is there, finite and not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x))
    return df.filter(F.col(vector).isNotNull() & finite & F.exists(vector, lambda x: x != 0))


def angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


def pivots(df: DataFrame, count: int, id: str = "id", vector: str = "vector") -> np.ndarray:
    """At most so many unit vectors, the centres of a sample taken by a hash; the same ones for the same rows."""
    count = max(1, min(count, MOST_CELLS))
    rows = df.select(F.xxhash64(id, vector).alias("h"), F.col(vector).alias("v")).orderBy("h", "v").limit(min(SAMPLE, 8 * count)).collect()
    if not rows:
        return np.ones((1, 1))
    own = np.array([r.v for r in rows], np.float64)
    own = np.unique(own / np.sqrt((own * own).sum(axis=1, keepdims=True)), axis=0)
    rng = np.random.default_rng(5)
    centre = own[rng.permutation(len(own))[:count]]
    for _ in range(ROUNDS):
        home = np.concatenate([(own[at : at + 2048] @ centre.T).argmax(axis=1) for at in range(0, len(own), 2048)])
        total = np.zeros_like(centre)
        np.add.at(total, home, own)
        size = np.sqrt((total * total).sum(axis=1, keepdims=True))
        centre = np.where(size > 1e-9, total / np.where(size > 1e-9, size, 1), centre)
    return centre


def _mapped(rows: DataFrame, vector: str, add: Callable[[np.ndarray], list[pa.Array]], fields: dict[str, str]) -> DataFrame:
    """Rows with columns made of their unit vectors, a batch at a time."""
    names = [*rows.columns, *fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                unit = unit_rows(b.column(vector))
                steps = [add(unit[at : at + 2048]) for at in range(0, len(unit), 2048)]
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.concat_arrays(c) for c in zip(*steps, strict=True))], names)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), *(f"`{n}` {t}" for n, t in fields.items())])
    return rows.mapInArrow(run, schema)


def _lists(held: np.ndarray, numbers: np.ndarray) -> pa.Array:
    """For each row of a boolean matrix the numbers of its columns that hold."""
    row, column = np.nonzero(held)
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(held)))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(numbers[column], pa.int32()))


def in_cells(rows: DataFrame, centre: np.ndarray) -> DataFrame:
    """Adds ``cell``, the nearest pivot, and ``far``, the angle to it, to rows with a usable ``vector``."""
    shared = rows.sparkSession.sparkContext.broadcast(centre)

    def add(unit: np.ndarray) -> list[pa.Array]:
        far = angle(unit @ shared.value.T)
        cell = far.argmin(axis=1)
        return [pa.array(cell, pa.int32()), pa.array(far[np.arange(len(far)), cell])]

    return _mapped(rows, "vector", add, {"cell": "int", "far": "double"})


@dataclass
class CellIndex:
    """A store by cells. rows: cell, slot, id, vector, written; of each cell its pivot, the largest angle
    to it, its rows, and the slots that they are dealt to."""

    rows: DataFrame
    pivots: np.ndarray
    radius: np.ndarray
    count: np.ndarray

    @property
    def slots(self) -> np.ndarray:
        return -(-self.count // SLOT_ROWS)

    @staticmethod
    def build(store: DataFrame, cells: int | None = None) -> CellIndex:
        """Of a store (id, vector); as many cells as the root of its rows unless told otherwise."""
        kept = usable(store.select("id", "vector"), "vector")
        centre = pivots(kept, cells or math.isqrt(kept.count()) or 1)
        return CellIndex.over(spool(in_cells(kept, centre), "cells"), centre)

    @staticmethod
    def over(placed: DataFrame, centre: np.ndarray) -> CellIndex:
        """An index of a written table (id, vector, cell, far), far being the angle to the cell's pivot."""
        radius, count = np.full(len(centre), -1.0), np.zeros(len(centre), np.int64)
        for r in placed.groupBy("cell").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect():
            radius[r.cell], count[r.cell] = r.far, r.n
        index = CellIndex(placed, centre, radius, count)
        slots = F.array(*[F.lit(int(n)) for n in index.slots])
        slot = F.pmod(F.xxhash64("id"), F.get(slots, F.col("cell"))).cast("int")
        index.rows = placed.select("cell", slot.alias("slot"), "id", "vector")
        return index


def with_copies(index: CellIndex, within: float) -> DataFrame:
    """The rows of an index with ``copies``, the cells before their own that may hold a vector within the angle.

    A vector y within the angle of some x of cell c is no farther from c's pivot than c's radius and the angle; and as
    x is nearer to c's pivot than to y's, no farther than from its own and twice the angle. A pair is found where
    its first cell is.
    """
    shared = index.rows.sparkSession.sparkContext.broadcast((index.pivots, index.radius))

    def add(unit: np.ndarray) -> list[pa.Array]:
        centre, radius = shared.value
        far = angle(unit @ centre.T)
        cell = far.argmin(axis=1)
        near = far <= np.minimum(radius[None, :] + within, far[np.arange(len(far)), cell][:, None] + 2 * within) + SLACK
        before = np.arange(far.shape[1])[None, :] < cell[:, None]
        return [_lists(near & before, np.arange(far.shape[1]))]

    return _mapped(index.rows.drop("slot"), "vector", add, {"copies": "array<int>"})


def _visits(asked: DataFrame, index: CellIndex, pick: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(.., cell): each query once for each cell that ``pick`` chooses by angles to the pivots and least distances."""
    return _cell_lists(asked, index, pick).select("query_id", "asked", F.explode("cells").alias("cell"))


def _cell_lists(asked: DataFrame, index: CellIndex, pick: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(.., cells): each query with the cells of ``_visits``."""
    shared = asked.sparkSession.sparkContext.broadcast((index.pivots, index.radius, index.count))
    bounded = "bound" in asked.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, radius, count = shared.value
        for b in batches:
            if b.num_rows and count.any():
                unit = unit_rows(b.column("asked"))
                bound = np.asarray(b.column("bound")) if bounded else np.zeros(len(unit))
                lists = []
                for at in range(0, len(unit), 2048):
                    far = angle(unit[at : at + 2048] @ centre.T)
                    least = np.maximum(0, far - radius - SLACK)
                    lists.append(_lists(pick(far, least, bound[at : at + 2048]) & (count > 0), np.arange(len(count))))
                yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("asked"), pa.concat_arrays(lists)], ["query_id", "asked", "cells"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.select("query_id", "asked").schema)
    return asked.mapInArrow(run, f"{fields}, cells array<int>")


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _met(visits: DataFrame, index: CellIndex, k: int | None, least: float | None, strictly: bool) -> DataFrame:
    """(query_id, id, similarity): what queries find in the cells they visit, a written table; at most k of each slot.

    A cell's slots, and parts of its own queries, meet each other in tasks of ``SLOT_ROWS`` by ``QUERY_BLOCK``.
    """
    slots = F.array(*[F.lit(int(n)) for n in index.slots])
    parts = visits.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("parts"))
    met = F.broadcast(parts)  # at most MOST_CELLS rows
    left = visits.join(met, "cell").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int")).drop("parts")
    left = left.withColumn("slot", F.explode(F.sequence(F.lit(0), F.get(slots, F.col("cell")) - 1)))
    right = index.rows.join(met, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    kinds = {"query_id": _kind(visits, "query_id"), "id": _kind(index.rows, "id")}

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        found_q, found_i, found_s = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        # a side without rows comes without columns
        a_ids, b_ids = pa.array([], IDS[kinds["query_id"]]), pa.array([], IDS[kinds["id"]])
        if a.num_rows and b.num_rows:
            b = b.take(pyarrow.compute.sort_indices(b["id"]))  # the stable sorts below break ties by id
            a_ids, b_ids = a["query_id"], b["id"]
            q, s = unit_rows(a["asked"].combine_chunks()), unit_rows(b["vector"].combine_chunks())
            for at in range(0, len(q), 256):
                for i, row in enumerate(q[at : at + 256] @ s.T):
                    hit = np.arange(len(row)) if least is None else np.flatnonzero(row > least if strictly else row >= least - 1e-12)
                    best = hit if k is None else hit[np.argsort(-np.round(row[hit], 12), kind="stable")[:k]]
                    found_q.append(np.full(len(best), at + i))
                    found_i.append(best)
                    found_s.append(row[best])
        return pa.table({
            "query_id": a_ids.take(pa.array(np.concatenate(found_q), pa.int64())), "id": b_ids.take(pa.array(np.concatenate(found_i), pa.int64())),
            "similarity": pa.array(np.concatenate(found_s), pa.float64()),
        })

    by = ("cell", "slot", "part")
    schema = f"query_id {kinds['query_id']}, id {kinds['id']}, similarity double"
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(meet, schema)


def within(queries: DataFrame, index: CellIndex, least: float, strictly: bool = False, k: int | None = None) -> DataFrame:
    """(query_id, id, similarity) of all stored vectors at or above a cosine, or at most k of each slot; queries: query_id, vector."""
    asked = usable(queries.select("query_id", F.col("vector").alias("asked")), "asked")
    most = math.acos(max(-1.0, min(1.0, least)))
    visits = spool(_visits(asked, index, lambda far, low, bound: low <= most + SLACK), "visits")
    return _met(visits, index, k, least, strictly)


def rows_sent(queries: DataFrame, index: CellIndex, least: float) -> int:
    """About how many rows ``within`` sends to tasks: queries to the slots of their cells, and slots to parts of the queries."""
    asked = usable(queries.select("query_id", F.col("vector").alias("asked")), "asked")
    most = math.acos(max(-1.0, min(1.0, least)))
    lists = _cell_lists(asked, index, lambda far, low, bound: low <= most + SLACK)
    slots = F.array(*[F.lit(int(n)) for n in index.slots])
    visits = lists.agg(F.coalesce(F.sum(F.aggregate("cells", F.lit(0).cast("long"), lambda n, c: n + F.get(slots, c))), F.lit(0))).first()[0]
    return visits + math.ceil(visits / QUERY_BLOCK) * min(SLOT_ROWS, int(index.count.max())) if visits else 0




@dataclass
class Search:
    """What a search found, (query_id, id, similarity, rank), and the (query_id, cell) it visited."""

    found: DataFrame
    visits: DataFrame


def search(queries: DataFrame, index: CellIndex, k: int, threshold: float | None = None) -> Search:
    """The k stored vectors nearest to each query, ties by id; with a threshold only those above it (strictly).

    Exact, in two rounds: a query first visits cells in the order of their least possible distance until they hold
    k rows. The k-th distance found there bounds what may be nearer, so in the second round it visits
    the other cells that reach below the bound, and no more. Ranks compare twelve digits, so that equal
    vectors tie.
    """
    asked = spool(usable(queries.select("query_id", F.col("vector").alias("asked")), "asked"), "asked")
    count = index.count
    most = math.pi if threshold is None else math.acos(max(-1.0, min(1.0, threshold)))

    def first_cells(far: np.ndarray, least: np.ndarray, bound: np.ndarray) -> np.ndarray:
        order = np.lexsort((far, np.where(count > 0, least, np.inf)), axis=1)
        rows = np.take(count, order)
        chosen = np.zeros(far.shape, bool)
        np.put_along_axis(chosen, order, np.cumsum(rows, axis=1) - rows < k, axis=1)
        return chosen & (least <= most + SLACK)

    visits = spool(_visits(asked, index, first_cells), "first-visits")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("similarity", 12).desc(), "id"))
    best = spool(_met(visits, index, k, threshold, True).withColumn("rank", rank).filter(F.col("rank") <= k), "first-found")
    last = best.filter(F.col("rank") == k).select("query_id", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "similarity"))).alias("kth"))
    bounded = asked.join(last.hint("merge"), "query_id", "left").select("query_id", "asked", F.coalesce("kth", F.lit(most)).alias("bound"))

    def other_cells(far: np.ndarray, least: np.ndarray, bound: np.ndarray) -> np.ndarray:
        return (least <= bound[:, None] + SLACK) & ~first_cells(far, least, bound)

    more = spool(_visits(bounded, index, other_cells), "more-visits")
    both = best.drop("rank").unionByName(_met(more, index, k, threshold, True))
    found = both.withColumn("rank", rank).filter(F.col("rank") <= k)
    return Search(found, visits.select("query_id", "cell").union(more.select("query_id", "cell")))
