"""Ordered insertion of raw events into a store of events, by rounds over what each decision waits for.

A raw event takes the nearest of up to k events above ``near`` whose similarity reaches ``same`` if the event has a raw
event of its document by then, else ``cross``; otherwise it becomes an event itself, which later ones
may take. In sequence each decision needs all before it; here a raw event is decided as soon as what it depends on is:

* An earlier raw event nearby is *open*, an *event*, or a *member*, one that is sure to take some event, so it is none
  itself, though which one may still be open.
* A candidate is taken for sure (*yes*), refused for sure (*no*), or waits: it is open, or it is an event whose
  documents depend on an earlier open raw event of the same document.
* Candidates are in order of similarity. The first *yes* decides if nothing before it waits, and if those before it that may
  be refused are fewer than k; k refused ones before all others make an event, as does having no candidate left.

The earliest open raw event never waits, so rounds end; they are as many as the longest chain of decisions that really
need each other. Only pairs with a raw end are made, in rows of their own that are aggregated, so a cluster
of any size is spread over tasks. Decided rows, and candidates behind a sure one, leave the table. What can't be taken makes
no pair: events behind k nearer ones or behind a sure one, raw events behind these, and raw events with a sure event.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.operators import pairs
from annalist.operators.cells import CellIndex
from annalist.scratch import shared_dir, spool


def _document(column: str):
    """A document as a key, null apart from all others."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


#: Raw events without a sure candidate that are decided together.
OPEN_ROWS = 8192

_HELD = "array<struct<s:double,f:bigint>>"


def _hold(found: DataFrame, held: DataFrame | None, near: float, same: float, k: int) -> DataFrame:
    """(r, held): what of the events found, (query_id, id, similarity), and of those held before, each raw event may take, as (-score, id) in order:
    the first one if it is sure, else the first k, as k refused events before all others make an event."""
    rows = found.filter(F.col("similarity") > near).select(F.col("query_id").alias("r"), (-F.round("similarity", 12)).alias("s"), F.col("id").alias("f"))
    if held is not None:
        rows = rows.union(held.select("r", F.inline("held")))
    first = rows.groupBy("r").agg(F.slice(F.array_sort(F.collect_list(F.struct("s", "f"))), 1, k).alias("held"))
    return spool(first.select("r", F.when(F.col("held")[0]["s"] <= -same, F.slice("held", 1, 1)).otherwise(F.col("held")).cast(_HELD).alias("held")), "held")


def _candidates(batch: DataFrame, open_: DataFrame, sizes: tuple[int, int], documents: DataFrame, near: float, least: float, same: float, k: int) -> DataFrame:
    """(r, f, rank, doc, score, sure, refused, is_event): events and earlier open raw events that r may take.

    batch: raw events with what they hold; open_: those of them that may become events. documents: f, doc of all events.
    """
    last = F.when((F.get("held", F.lit(0))["s"] <= -same) | (F.size("held") == k), F.element_at("held", -1))
    ends = batch.withColumns({"s": F.coalesce(last["s"], F.lit(2.0)), "f": F.coalesce(last["f"], F.lit(0))})
    near_ones = pairs.earlier_pairs(ends, open_, sizes, least).filter(F.col("similarity") > near)
    raw_pairs = near_ones.select("r", "f", "rank", "doc", F.round("similarity", 12).alias("score"), "has", F.lit(False).alias("is_event"))
    stored = batch.select(F.col("id").alias("r"), "rank", "doc", F.inline("held"))
    known = documents.distinct().withColumn("has", F.lit(True))
    stored = stored.join(known.hint("merge"), ["f", "doc"], "left")
    stored_pairs = stored.select("r", "f", "rank", "doc", (-F.col("s")).alias("score"), F.coalesce("has", F.lit(False)).alias("has"), F.lit(True).alias("is_event"))
    sure = F.col("score") >= same
    return raw_pairs.union(stored_pairs).select(
        "r", "f", "rank", "doc", "score", sure.alias("sure"), (F.col("has") & ~sure).alias("refused"), "is_event", F.lit(None).cast("long").alias("has_from"),
    )


def _place(condition):
    """The place of the first candidate for which the condition holds: nearest first, then smallest id."""
    return F.min(F.when(condition, F.struct((-F.col("score")).alias("s"), F.col("f").alias("f"))))


def _decide(open_: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The candidates with their class, and of each raw event what is now known: (r, rank, doc, yes, decision)."""
    waiting = open_.groupBy("f", "doc").agg(F.min("rank").alias("first_open"))
    joined = open_.join(waiting.hint("merge"), ["f", "doc"])
    has = F.coalesce(F.col("has_from") < F.col("rank"), F.lit(False))
    kind = (
        F.when(F.col("refused"), F.when(F.col("is_event"), "no").otherwise("never"))
        .when(~F.col("is_event"), "waits")
        .when(F.col("sure"), "yes")
        .when(has, "no")
        .when(F.col("first_open") < F.col("rank"), "waits")
        .otherwise("yes")
    )
    classed = spool(joined.withColumn("kind", kind).drop("first_open"), "classed")
    firsts = classed.groupBy("r").agg(_place(F.col("kind") == "yes").alias("yes"), _place(F.col("kind") == "waits").alias("wait"))
    rows = classed.join(firsts.hint("merge"), "r")
    at = F.struct((-F.col("score")).alias("s"), F.col("f").alias("f"))
    before_yes, before_wait = at < F.col("yes"), F.coalesce(at < F.col("wait"), F.lit(True))
    counts = rows.groupBy("r", "rank", "doc", "yes", "wait").agg(
        F.count_if(before_yes & (F.col("kind") != "yes")).alias("may_fill"),
        F.count_if(before_yes & (F.col("kind") == "no")).alias("fill"),
        F.count_if(before_wait & (F.col("kind") == "no")).alias("fill_first"),
    )
    clear = F.col("yes").isNotNull() & F.coalesce(F.col("yes") < F.col("wait"), F.lit(True))
    decision = (
        F.when(clear & (F.col("fill") >= k), "event")
        .when(clear & (F.col("may_fill") < k), "take")
        .when(clear, "open")
        .when(F.col("wait").isNull() | (F.col("fill_first") >= k), "event")
        .when(F.col("yes").isNotNull() & (F.col("may_fill") < k), "member")
        .otherwise("open")
    )
    return classed, spool(counts.select("r", "rank", "doc", "yes", decision.alias("decision")), "decisions")


def _decide_all(open_: DataFrame, ids: DataFrame, k: int, folder: str) -> list[str]:
    """Writes (raw_id, event_id) of all raw events (id) that take an event, under their candidates; a path a round."""
    spark = open_.sparkSession
    # raw events without a candidate are events from the start
    alone = ids.join(open_.select(F.col("r").alias("id")).distinct().hint("merge"), "id", "left_anti")
    news = spool(alone.select(F.col("id").alias("f"), F.lit(True).alias("now_event")), "news")
    taken = spark.createDataFrame([], "f long, doc string, taken_from long")
    rounds = []
    while True:
        known = open_.join(news.hint("merge"), "f", "left").join(taken.hint("merge"), ["f", "doc"], "left")
        known = known.select(
            "r", "f", "rank", "doc", "score", "sure", "refused", (F.col("is_event") | F.coalesce("now_event", F.lit(False))).alias("is_event"),
            F.least("has_from", "taken_from").alias("has_from"), F.coalesce(~F.col("now_event"), F.lit(False)).alias("is_member"),
        )
        known = spool(known, "open")
        open_ = known.filter("not is_member").drop("is_member")
        if open_.isEmpty():
            break
        # whose last candidates were members is an event
        bare = known.groupBy("r").agg(F.bool_and("is_member").alias("bare")).filter("bare").select(F.col("r").alias("f"), F.lit(True).alias("now_event"))
        classed, decided = _decide(open_, k)
        rounds.append(f"{folder}/round={len(rounds)}")
        takes = decided.filter("decision = 'take'")
        takes.select(F.col("r").alias("raw_id"), F.col("yes.f").alias("event_id")).write.parquet(rounds[-1])
        news = decided.filter("decision <> 'open'").select(F.col("r").alias("f"), (F.col("decision") == "event").alias("now_event")).union(bare)
        taken = takes.groupBy(F.col("yes.f").alias("f"), "doc").agg(F.min("rank").alias("taken_from"))
        still = decided.filter("decision in ('open', 'member')").select("r", "yes")
        at = F.struct((-F.col("score")).alias("s"), F.col("f").alias("f"))
        ahead = classed.join(still.hint("merge"), "r").filter(F.coalesce(at <= F.col("yes"), F.lit(True)))
        open_ = ahead.select("r", "f", "rank", "doc", "score", "sure", "refused", "is_event", "has_from")
    return rounds


def insert_in_order(
    raw: DataFrame, index: CellIndex, documents: DataFrame, near: float = 0.80, cross: float = 0.85, same: float = 0.95, k: int = 5
) -> DataFrame:
    """(raw_id, event_id, is_new) of raw events (id, rank, vector, document_id) under an index of stored events
    and their documents (event_id, document_id). A new event has the id of its raw event.

    Raw events meet the stored ones first, of which k each are kept. Those with a sure one among them become no events; of
    the others ``OPEN_ROWS`` at a time are decided, by rank, together with all raw events before the last of them. What
    is left then meets the new events, so pairs are made with few raw events at a time, however many are near each other.
    """
    if cross > same:
        raise ValueError("cross must not exceed same")
    spark, least = raw.sparkSession, max(near, cross)
    raw = spool(raw.select("id", "rank", "vector", _document("document_id").alias("doc")), "raw-events")
    known = documents.select(F.col("event_id").alias("f"), _document("document_id").alias("doc"))
    folder, paths, schema = f"{shared_dir(spark)}/taken-{uuid.uuid4().hex}", [], "raw_id long, event_id long"
    held, rest, step = _hold(pairs.best_stored(raw, index, raw.count(), least, k), None, near, same, k), raw, 0
    while True:
        having = rest.join(held.withColumnRenamed("r", "id").hint("merge"), "id", "left")
        having = spool(having.withColumn("held", F.coalesce("held", F.array().cast(_HELD))), "having")
        open_ = having.filter(F.coalesce(F.get("held", F.lit(0))["s"] > -same, F.lit(True)))
        n_open, high = open_.filter("rank is not null").select("rank").orderBy("rank").limit(OPEN_ROWS).agg(F.count(F.lit(1)), F.max("rank")).first()
        whole = n_open < OPEN_ROWS
        batch, some = (having, open_) if whole else (having.filter(F.col("rank") <= high), open_.filter(F.col("rank") <= high))
        found = _candidates(batch, some, (batch.count(), n_open), known, near, least, same, k)
        rounds = _decide_all(spool(found, "candidates"), batch.select("id"), k, f"{folder}/step={step}")
        paths += rounds
        if whole:
            break
        step += 1
        takes = spark.read.schema(schema).parquet(*rounds) if rounds else spark.createDataFrame([], schema)
        new = spool(some.select("id", "doc", "vector").join(takes.select(F.col("raw_id").alias("id")).hint("merge"), "id", "left_anti"), "new-events")
        links = takes.join(batch.select(F.col("id").alias("raw_id"), "doc").hint("merge"), "raw_id").select(F.col("event_id").alias("f"), "doc")
        known = spool(known.union(links).union(new.select(F.col("id").alias("f"), "doc")).distinct(), "known-documents")
        rest = having.filter(F.col("rank") > high).drop("held")
        held = having.filter(F.col("rank") > high).select(F.col("id").alias("r"), "held")
        held = _hold(pairs.best_of_all(rest, new, (rest.count(), new.count()), least, k), held, near, same, k)
    targets = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    placed = raw.select(F.col("id").alias("raw_id")).join(targets.hint("merge"), "raw_id", "left")
    return placed.select("raw_id", F.coalesce("event_id", "raw_id").alias("event_id"), F.col("event_id").isNull().alias("is_new"))


def canonicalise(raw: DataFrame, store: DataFrame, near: float = 0.80, cross: float = 0.85, same: float = 0.95, k: int = 5) -> DataFrame:
    """(raw_id, event_id, is_new): raw events (id, rank, vector, document_id) inserted in the order of their rank into a
    store (event_id, vector, document_ids). Ids of raw events and stored events must differ."""
    index = CellIndex.build(store.select(F.col("event_id").alias("id"), "vector"))
    documents = store.select("event_id", F.explode("document_ids").alias("document_id"))
    return insert_in_order(raw, index, documents, near, cross, same, k)
