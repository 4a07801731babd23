"""Timelines: event dedupe, representatives, merged events, reading models, filters and orders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions.dates import chronological_value, display_start_date, display_year, parse_display_year, start_timestamp, to_date_range
from annalist.functions.text import event_signature
from annalist.scratch import running_sum, spool
from annalist.sources.tables import dedupe_first, insert_ignore

#: Entities or documents are sent to all tasks up to so many rows, behind a count.
BROADCAST_ROWS = 100_000


def dedupe_by_signature(raw: DataFrame, order: str, by_document: bool = True) -> DataFrame:
    """First raw event of each signature of (document, description, date), in the given order."""
    document = F.col("source_document_id") if by_document else F.lit("")
    signed = raw.withColumn("deduplication_signature", event_signature(document, F.col("description"), F.col("event_date_str")))
    return dedupe_first(signed, ["deduplication_signature"], [order])


def filter_articles(articles: DataFrame, scores: DataFrame, threshold: float, limit: int) -> DataFrame:
    """Per topic the best ``limit`` articles of at least the threshold; articles without a score go.

    scores: topic_id, item_id, score; articles: item_id.
    """
    joined = scores.filter(F.col("score") >= threshold).join(articles.hint("merge"), "item_id")
    rank = F.row_number().over(Window.partitionBy("topic_id").orderBy(F.desc("score"), "item_id"))
    return joined.withColumn("rank", rank).filter(F.col("rank") <= limit)


def filter_events(events: DataFrame, scores: DataFrame, threshold: float = 0.6, topic: str | None = None) -> DataFrame:
    """Events with their score, held in [0, 1], if it reaches the threshold. Unscored events go;
    with a blank topic all events pass with score 1."""
    if topic is not None and not topic.strip():
        return events.withColumn("relevance_score", F.lit(1.0))
    held = scores.filter("score is not null").select("id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))).alias("relevance_score"))
    return events.join(held.filter(F.col("relevance_score") >= threshold).hint("merge"), "id")


def relevance_stats(events: DataFrame, scores: DataFrame, threshold: float = 0.6) -> DataFrame:
    """One row: events, scored, kept, dropped, and the percentage filtered out."""
    joined = events.select("id").join(scores.select("id", "score").hint("merge"), "id", "left")
    kept = F.count_if(F.col("score") >= threshold)
    n = F.count(F.lit(1))
    return joined.agg(
        n.alias("n_events"), F.count("score").alias("n_scored"), kept.alias("n_kept"), (n - kept).alias("n_dropped"),
        F.when(n > 0, F.round(100.0 * (n - kept) / n, 2)).otherwise(0.0).alias("filter_rate"),
    )


def similarity_totals(groups: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, total): the similarities of a member to the others of its group, from pairs (a, b, similarity)."""
    both = pairs.select("a", "b", "similarity").union(pairs.select("b", "a", "similarity"))
    of, other = groups.select(F.col("id").alias("a"), "leader"), groups.select(F.col("id").alias("b"), F.col("leader").alias("leader_b"))
    inside = both.join(of.hint("merge"), "a").join(other.hint("merge"), "b").filter("leader = leader_b")
    return inside.groupBy(F.col("a").alias("id")).agg(F.sum("similarity").alias("total"))


def representative_by_similarity(groups: DataFrame, pairs: DataFrame | None, events: DataFrame, total: DataFrame | None = None) -> DataFrame:
    """(leader, representative, score) of each group.

    Score: mean similarity to the other members, plus up to 0.1 for the description's length and
    up to 0.05 for entities; a lone event has a mean of 1. Ties go to the first by rank.
    groups: id, leader; pairs: a, b, similarity of all pairs in a group (missing ones count as 0), or instead of
    them ``total``: id, total of its similarities; events: id, rank, description, n_entities.
    """
    total = similarity_totals(groups, pairs) if total is None else total
    size = groups.groupBy("leader").agg(F.count(F.lit(1)).alias("n"))
    joined = groups.join(size.hint("merge"), "leader").join(total.hint("merge"), "id", "left").join(
        events.select("id", "rank", "description", "n_entities").hint("merge"), "id"
    )
    mean = F.when(F.col("n") == 1, 1.0).otherwise(F.coalesce("total", F.lit(0.0)) / F.greatest(F.col("n") - 1, F.lit(1)))
    bonus = F.least(F.coalesce(F.length("description"), F.lit(0)) / 1000, F.lit(0.1)) + F.least(F.col("n_entities") / 10, F.lit(0.05))
    best = F.max(F.struct(F.round(mean + bonus, 9).alias("score"), (-F.col("rank")).alias("r"), "id"))
    return joined.groupBy("leader").agg(best.alias("best")).select("leader", F.col("best.id").alias("representative"), "best.score")


def representative_by_quality(groups: DataFrame, events: DataFrame, user_language: str | None = None, default_language: str = "en") -> DataFrame:
    """(leader, representative, date_info, event_date_str, score) of each group.

    Score: 100 for the user's language or 50 for the default one, 0.1 a character, and 30, 20 or
    10 for a day, month or year. A representative without an interval takes that of the first
    member with one; then without a date string that of the first member with one, then the year.
    events: id, rank, language, description, date_info, event_date_str.
    """
    own = events.select("id", "rank", "language", "description", "date_info", "event_date_str")
    e = groups.select("id", "leader").join(own.hint("merge"), "id").withColumn("_range", to_date_range(F.col("date_info")))
    language = F.when(F.col("language") == F.lit(user_language), 100).when(F.col("language") == default_language, 50).otherwise(0)
    precision = F.col("date_info.precision")
    dated = F.when(precision == "day", 30).when(precision == "month", 20).when(precision == "year", 10).otherwise(0)
    score = language + F.coalesce(F.length("description"), F.lit(0)) * 0.1 + F.when(F.col("_range").isNotNull(), dated).otherwise(0)
    has_text = F.col("event_date_str") != ""
    best = F.max_by(F.struct("id", "date_info", "_range", "event_date_str"), F.struct(F.round(score, 6), -F.col("rank")))
    some = e.groupBy("leader").agg(
        best.alias("best"), F.round(F.max(score), 6).alias("score"),
        F.min_by("date_info", F.when(F.col("_range").isNotNull(), F.col("rank"))).alias("_info"),
        F.min_by("_range", F.when(F.col("_range").isNotNull(), F.col("rank"))).alias("_any_range"),
        F.min_by("event_date_str", F.when(has_text, F.col("rank"))).alias("_text"),
    )
    lacks = F.col("best._range").isNull()
    range_ = F.coalesce("best._range", "_any_range")
    text = F.coalesce(F.nullif("best.event_date_str", F.lit("")), F.when(range_.isNotNull(), F.coalesce("_text", F.year(range_["start_date"]).cast("string"))))
    return some.select(
        "leader", F.col("best.id").alias("representative"),
        F.when(lacks, F.coalesce("_info", "best.date_info")).otherwise(F.col("best.date_info")).alias("date_info"), text.alias("event_date_str"), "score",
    )


def assemble_merged_events(groups: DataFrame, representatives: DataFrame, events: DataFrame, scores: DataFrame) -> DataFrame:
    """One event a group: the representative's description and date, distinct raw events and
    entities of all members, the highest score. A missing date string falls back to the date's
    text, then the first member's string, then the year, then ``Unknown``.

    groups: id, leader; representatives: leader, representative; events: id, rank, description,
    event_date_str, date_info, raw_event_ids, entity_ids; scores: id, score.
    """
    own = events.select("id", "rank", "event_date_str", "raw_event_ids", "entity_ids")
    members = groups.select("id", "leader").join(own.hint("merge"), "id").join(scores.select("id", "score").hint("merge"), "id", "left")
    together = members.groupBy("leader").agg(
        F.count(F.lit(1)).alias("n_events"), F.max("score").alias("relevance_score"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("raw_event_ids")))).alias("raw_event_ids"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("entity_ids")))).alias("entity_ids"),
        F.min_by("event_date_str", F.when(F.col("event_date_str") != "", F.col("rank"))).alias("_text"),
    )
    chosen = events.select(F.col("id").alias("representative"), "description", "date_info", F.col("event_date_str").alias("_own"))
    joined = together.join(representatives.select("leader", "representative").hint("merge"), "leader").join(chosen.hint("merge"), "representative")
    merged = F.col("n_events") > 1
    year = F.year(to_date_range(F.col("date_info"))["start_date"]).cast("string")
    fallback = F.coalesce(F.nullif("date_info.original_text", F.lit("")), F.col("_text"), year, F.lit("Unknown"))
    return joined.select(
        "leader", "representative", "description", F.when(merged, fallback).otherwise(F.col("_own")).alias("event_date_str"), "date_info",
        merged.alias("is_merged"), "n_events", "relevance_score", "raw_event_ids", "entity_ids",
    )


def valid_timeline_events(events: DataFrame) -> DataFrame:
    """Events that have a place: known precision and a start or end year."""
    d = F.col("date_info")
    return events.filter(d.isNotNull() & (d["precision"] != "unknown") & (d["start_year"].isNotNull() | d["end_year"].isNotNull()))


def chronological_order() -> list[Column]:
    """Signed year, then first day (events without one first), then id."""
    return [chronological_value(F.col("date_info"), F.col("event_date_str")), display_start_date(F.col("date_info")).asc_nulls_first(), F.col("id")]


def sort_chronologically(events: DataFrame) -> DataFrame:
    return valid_timeline_events(events).orderBy(*chronological_order())


def sort_by_timestamp(events: DataFrame) -> DataFrame:
    """By midnight of the first day, events without one first."""
    return events.orderBy(start_timestamp(F.col("date_info")).asc_nulls_first(), "id")


def merge_order(events: DataFrame) -> DataFrame:
    return events.orderBy(F.col("year").asc_nulls_last(), "id")


def sequence_events(events: DataFrame) -> DataFrame:
    """Events with ``sequence_order`` from 0 inside their viewpoint."""
    place = F.row_number().over(Window.partitionBy("viewpoint_id").orderBy(*chronological_order())) - 1
    return valid_timeline_events(events).withColumn("sequence_order", place)


def filter_timeline(events: DataFrame, source_title: str | None = None, min_score: float | None = None) -> DataFrame:
    """Events with a source of that title, and of at least that score; events without one go."""
    if source_title is not None:
        events = events.filter(F.exists("sources", lambda s: s["title"] == source_title))
    return events if min_score is None else events.filter(F.col("relevance_score") >= min_score)


def source_counts(events: DataFrame) -> DataFrame:
    """(title, n_events): events of each source title, most first."""
    pairs = events.select("id", F.explode(F.array_distinct(F.transform("sources", lambda s: s["title"]))).alias("title"))
    return pairs.filter("title is not null").groupBy("title").agg(F.countDistinct("id").alias("n_events")).orderBy(F.desc("n_events"), "title")


def relevance_options(events: DataFrame) -> DataFrame:
    """(score, n_events): for each distinct score the events at or above it, highest first."""
    count = events.filter("relevance_score is not null").groupBy(F.col("relevance_score").alias("score")).agg(F.count(F.lit(1)).alias("n"))
    return running_sum(count, [F.desc("score")], "n", "n_events").select("score", "n_events").orderBy(F.desc("score"))


def timeline_years(events: DataFrame) -> DataFrame:
    """Distinct display years in order."""
    shown = events.select(display_year(F.col("date_info"), F.col("event_date_str")).alias("display_year")).distinct()
    return shown.withColumn("value", parse_display_year(F.col("display_year"))).orderBy("value", "display_year")


def _sent(rows: DataFrame) -> DataFrame:
    """Rows for a join in which few of them may be met by very many: sent to all tasks if they are few, else merged."""
    few = rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return F.broadcast(rows) if few else rows.hint("merge")


def hydrate_events(
    events: DataFrame, event_entities: DataFrame | None, entities: DataFrame | None, event_raw: DataFrame, raw: DataFrame, documents: DataFrame
) -> DataFrame:
    """Events with arrays ``entities`` and ``raw_events`` (each with its document); links to rows
    that don't exist are skipped. Each side is aggregated before it is joined. Without ``event_entities`` there is no
    column ``entities``."""
    d = documents.select(F.col("id").alias("source_document_id"), "title", "language", F.col("wikipedia_url").alias("url"), "source_type")
    met = event_raw.join(raw.withColumnRenamed("id", "raw_event_id").hint("merge"), "raw_event_id")
    r = met.repartition("event_id").join(_sent(d), "source_document_id", "left")  # few documents are met behind the shuffle, which needn't carry them
    item = F.struct("raw_event_id", "source_text_snippet", "source_document_id", "title", "language", "url", "source_type")
    per_raw = r.groupBy(F.col("event_id").alias("id")).agg(F.sort_array(F.collect_list(item)).alias("raw_events"))
    if event_entities is not None:
        e = event_entities.join(_sent(entities.select(F.col("id").alias("entity_id"), "entity_name", "entity_type")), "entity_id")
        per_entity = e.groupBy(F.col("event_id").alias("id")).agg(F.sort_array(F.collect_set(F.struct("entity_id", "entity_name", "entity_type"))).alias("entities"))
        events = events.join(per_entity.hint("merge"), "id", "left")
    return events.join(per_raw.hint("merge"), "id", "left")


def event_documents(event_raw: DataFrame, raw: DataFrame) -> DataFrame:
    """Distinct (event_id, source_document_id)."""
    own = raw.select(F.col("id").alias("raw_event_id"), "source_document_id").filter("source_document_id is not null")
    return event_raw.join(own.hint("merge"), "raw_event_id").select("event_id", "source_document_id").distinct()


def viewpoint_events(viewpoints: DataFrame, links: DataFrame, document_ids: DataFrame) -> DataFrame:
    """(document_id, event_id) of the completed canonical viewpoint of each document."""
    own = viewpoints.filter("viewpoint_type = 'canonical' and status = 'completed'").select(F.col("id").alias("viewpoint_id"), F.col("canonical_source_id").alias("document_id"))
    return document_ids.join(own.hint("merge"), "document_id").join(links.hint("merge"), "viewpoint_id").select("document_id", "event_id").distinct()


def event_view(hydrated: DataFrame) -> DataFrame:
    """What ``timeline_view`` shows of an event, one row an event. Columns made of it should be made here, before the
    links: an event has many.

    The order of raw events is by id. ``is_merged``: more than one source with a snippet.
    """
    # sorted neighbours instead of a search a source
    raw = F.coalesce("raw_events", F.array().cast(hydrated.schema["raw_events"].dataType))
    ref = lambda r: F.coalesce(F.concat(F.lit("src_"), r["source_document_id"]), F.concat(F.lit("src_unknown_"), r["raw_event_id"].cast("string")))
    spoken = F.transform(raw, lambda r, i: F.struct(ref(r).alias("ref"), i.alias("place"), r["source_text_snippet"].alias("snippet")))
    spoken = F.sort_array(F.filter(spoken, lambda r: F.trim(F.coalesce(r["snippet"], F.lit(""))) != ""))
    source = lambda r: F.struct(ref(r).alias("ref"), r["title"].alias("title"), r["language"].alias("language"), r["url"].alias("url"), r["source_type"].alias("source_type"))
    named = F.sort_array(F.transform(raw, lambda r, i: F.struct(source(r).alias("source"), i.alias("place"))))
    last = lambda r, i: ~F.get("_spoken", i + 1)["ref"].eqNullSafe(r["ref"])
    first = lambda r, i: (i == 0) | ~F.get("_named", i - 1)["source"].eqNullSafe(r["source"])
    in_order = F.sort_array(F.transform(F.filter("_named", first), lambda r: F.struct(r["place"].alias("place"), r["source"].alias("source"))))
    snippets = F.transform(F.filter("_spoken", last), lambda r: F.struct(r["ref"].alias("key"), r["snippet"].alias("value")))
    people = [F.coalesce("entities", F.array().cast(hydrated.schema["entities"].dataType)).alias("main_entities")] if "entities" in hydrated.columns else []
    return (
        hydrated.withColumn("_spoken", spoken)
        .withColumn("_named", named)
        .select(
            F.col("id").alias("event_id"), "event_date_str", "description", "date_info", *people,
            F.map_from_entries(snippets).alias("source_snippets"),
            F.transform(in_order, lambda r: r["source"]).alias("sources"),
        )
        .withColumn("is_merged", F.size("source_snippets") > 1)
    )


def with_links(links: DataFrame, once: DataFrame) -> DataFrame:
    """Rows of events (event_id, ..) once for each link of a viewpoint to them, behind place and score."""
    own = links.select("viewpoint_id", "event_id", "sequence_order", "relevance_score").join(once.hint("merge"), "event_id")
    return own.select("viewpoint_id", "event_id", "sequence_order", "relevance_score", *[c for c in once.columns if c != "event_id"])


def timeline_view(links: DataFrame, hydrated: DataFrame) -> DataFrame:
    """One row an event of a viewpoint: score, ``main_entities``, ``source_snippets`` (source ref to
    snippet, the last raw event of a source wins, blank ones are skipped), ``sources``, ``is_merged``.
    """
    return with_links(links, event_view(hydrated))


def compact_result(view: DataFrame) -> DataFrame:
    """The reading model, or the view of its events before they are linked, with dates, descriptions, entity names and
    source titles only."""
    return view.select(
        *[c for c in ("viewpoint_id",) if c in view.columns], "event_id", F.col("event_date_str").alias("date"), "description",
        F.transform("main_entities", lambda e: e["entity_name"]).alias("entities"),
        F.array_distinct(F.filter(F.transform("sources", lambda s: s["title"]), lambda t: t.isNotNull())).alias("sources"),
    )


def canonical_viewpoints(
    articles: DataFrame, finished: DataFrame, extract: Callable[[DataFrame], DataFrame], canonise: Callable[[DataFrame], DataFrame]
) -> tuple[DataFrame, DataFrame]:
    """(reused, made): events of each document, taken over where it is finished, else extracted,
    deduplicated by signature and made canonical.

    articles: document_id, text; finished: document_id, event_id. ``extract`` gives (doc_id,
    position, event_date_str, description, ..), ``canonise`` adds event_id.
    """
    done = articles.select("document_id").distinct().join(finished.hint("merge"), "document_id")
    todo = articles.join(finished.select("document_id").distinct().hint("merge"), "document_id", "left_anti")
    raw = extract(todo.select(F.col("document_id").alias("doc_id"), "text")).withColumn("source_document_id", F.col("doc_id").cast("string"))
    kept = spool(dedupe_by_signature(raw, "position"), "raw-events")
    return done, canonise(kept)


def seeded_timeline(articles: DataFrame, keep: Column, events_of: Callable[[DataFrame], DataFrame], by: str) -> DataFrame:
    """Timelines of an entity or a document: the pipeline over its articles, all scores 1.0.

    (by, event_id, relevance_score, data_source_preference): sources are the distinct types in
    order, joined by commas.
    """
    own = articles.filter(keep)
    sources = own.groupBy(by).agg(F.array_join(F.sort_array(F.collect_set("source_type")), ",").alias("data_source_preference"))
    events = events_of(own).select(by, "event_id").distinct()
    return events.join(sources.hint("merge"), by).withColumn("relevance_score", F.lit(1.0))


def link_new_events(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Viewpoint links to add: pairs that exist are ignored."""
    return insert_ignore(existing, new, ["viewpoint_id", "event_id"])
