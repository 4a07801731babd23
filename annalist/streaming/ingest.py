"""Structured Streaming forms of the incremental operators."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from annalist.functions.text import event_signature
from annalist.operators import cells
from annalist.operators.canonical import insert_in_order

#: Task states that end a task.
TERMINAL = ("completed", "failed")
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def unique_rows(stream: DataFrame, keys: list[str], stored: DataFrame | None = None) -> DataFrame:
    """The first arrival of each key, for ever: no watermark, so no key is forgotten, however late its copy comes.

    The keys seen are the state of the query, by hash over the shuffle partitions, in RocksDB files that are copied to
    the checkpoint: memory doesn't grow with them, and a restart from the checkpoint knows them all. The state
    store is set for the session; queries that were started before keep theirs. Keys of ``stored``, a table from before the
    stream, are left out as well. Of rows of one key that arrive in one batch any one is kept. Null keys are equal.
    """
    spark = stream.sparkSession
    spark.conf.set(STATE_STORE, ROCKS)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    if stored is not None:
        known = stored.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        condition = same[0]
        for more in same[1:]:
            condition &= more
        stream = stream.join(known.hint("merge"), condition, "left_anti")
    return stream.dropDuplicates(keys)


def stream_dedupe_raw_events(raw: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """The first arrival of each (document, signature); ``stored`` holds those from before."""
    signed = raw.withColumn("deduplication_signature", event_signature(F.col("source_document_id"), F.col("description"), F.col("event_date_str")))
    return unique_rows(signed, ["source_document_id", "deduplication_signature"], stored)


def stream_progress(steps: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Progress rows, one for each (viewpoint, step, message)."""
    return unique_rows(steps, ["viewpoint_id", "step_name", "message"], stored)


def stream_task_status(changes: DataFrame) -> DataFrame:
    """(task_id, status, changed_at, is_terminal): the latest status; for update mode."""
    last = changes.groupBy("task_id").agg(F.max(F.struct("changed_at", "status")).alias("last"))
    return last.select("task_id", "last.status", "last.changed_at", F.col("last.status").isin(*TERMINAL).alias("is_terminal"))


_EVENTS = "event_id long, vector array<float>, cell int, far double"
_LINKS = "raw_id long, event_id long, document_id string"


def _pivots(spark: SparkSession, path: str, rows: DataFrame, count: int) -> np.ndarray:
    """The pivots of the stored events: those of the first batch with a vector, kept with the events."""
    kept = spark.read.schema("n int, vector array<double>").parquet(path).filter("n >= 0").orderBy("n").collect()
    if kept:
        return np.array([r.vector for r in kept])
    own = cells.usable(rows, "vector")
    if own.isEmpty():
        return np.ones((1, 1))
    centre = cells.pivots(own, count)
    spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(centre)], "n int, vector array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/of=batch")
    return centre


def stream_canonicalise(
    raw: DataFrame, folder: str, checkpoint: str, name: str = "canonicalise",
    near: float = 0.80, cross: float = 0.85, same: float = 0.95, k: int = 5, n_cells: int = 1024,
) -> StreamingQuery:
    """Matches arriving raw events against the events stored so far, which grow by each batch.

    raw: id, rank, vector, document_id. Batch n writes the links and the new events to
    ``folder/links/batch=n`` and ``folder/events/batch=n`` and reads only batches before n, so a
    batch that runs again writes the same again. New events are written with their cell; a batch reads the
    cells that its raw events can be near to and pairs nothing among stored events.
    """
    spark = raw.sparkSession
    for kind, schema in (("events", _EVENTS), ("links", _LINKS), ("pivots", "n int, vector array<double>")):
        part = "of=none" if kind == "pivots" else "batch=-1"
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{folder}/{kind}/{part}")

    def one(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        rows = rows.select("id", "rank", "vector", "document_id").persist()
        before = lambda kind, schema: spark.read.schema(f"{schema}, batch long").parquet(f"{folder}/{kind}").filter(F.col("batch") < batch)
        centre = _pivots(spark, f"{folder}/pivots", rows, n_cells)
        stored = before("events", _EVENTS).filter("cell is not null").select(F.col("event_id").alias("id"), "vector", "cell", "far")
        links = before("links", _LINKS).select("event_id", "document_id")
        matched = insert_in_order(rows, cells.CellIndex.over(stored, centre), links, near, cross, same, k)
        linked = matched.join(rows.select(F.col("id").alias("raw_id"), "document_id", F.col("vector").cast("array<float>").alias("vector")).hint("merge"), "raw_id").persist()
        linked.select("raw_id", "event_id", "document_id").write.mode("overwrite").parquet(f"{folder}/links/batch={batch}")
        fresh = linked.filter("is_new").select("event_id", "vector")
        placed = cells.in_cells(cells.usable(fresh, "vector"), centre)
        others = fresh.join(placed.select("event_id").hint("merge"), "event_id", "left_anti")
        both = placed.select("event_id", "vector", "cell", "far").unionByName(others, allowMissingColumns=True)
        both.write.mode("overwrite").parquet(f"{folder}/events/batch={batch}")
        linked.unpersist()
        rows.unpersist()

    return raw.writeStream.queryName(name).foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Writes what has arrived and stops; update mode goes through a function of batches."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.foreachBatch(each).start() if each else writer.format("parquet").option("path", path).start()
