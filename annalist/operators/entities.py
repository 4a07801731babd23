"""Entities: matching by title, resolution through a page table, creation, and links to events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.sources.tables import dedupe_first, insert_ignore

UNKNOWN = "UNKNOWN"


def match_entities_by_title(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """Requests (name, language) with the ``entity_id`` of a document of that title; null if none.

    The smallest entity id of a title wins.
    """
    known = documents.filter("entity_id is not null").groupBy(F.col("title").alias("name"), "language").agg(F.min("entity_id").alias("entity_id"))
    return requests.join(known.hint("merge"), ["name", "language"], "left")


def resolve_entities(requests: DataFrame, documents: DataFrame, page_info: DataFrame, entities: DataFrame) -> DataFrame:
    """Requests (name, language, entity_type) with entity_id, kb_id, resolved_type and status.

    Status: 200 known, 201 created for a knowledge-base id, 202 known by that id, 300 ambiguous
    title, 500 no page. A known entity of unknown type takes the requested type.
    """
    by_title = match_entities_by_title(requests.select("name", "language", "entity_type").distinct(), documents)
    pages = page_info.select(F.col("title").alias("name"), "language", "kb_id", "is_disambiguation")
    pages = dedupe_first(pages, ["name", "language"], ["kb_id"])
    by_kb = entities.filter("wikibase_item is not null").groupBy(F.col("wikibase_item").alias("kb_id")).agg(F.min("id").alias("_kb_entity"))
    found = by_title.join(pages.hint("merge"), ["name", "language"], "left").join(by_kb.hint("merge"), "kb_id", "left")
    status = (
        F.when(F.col("entity_id").isNotNull(), 200)
        .when(F.coalesce("is_disambiguation", F.lit(False)), 300)
        .when(F.col("_kb_entity").isNotNull(), 202)
        .when(F.col("kb_id").isNotNull(), 201)
        .otherwise(500)
    )
    made = F.sha2(F.concat(F.lit("entity-"), "kb_id"), 256)
    typed = entities.select(F.col("id").alias("entity_id"), F.col("entity_type").alias("_known_type"))
    resolved = found.withColumn("status", status).withColumn(
        "entity_id", F.when(F.col("status") == 202, F.col("_kb_entity")).when(F.col("status") == 201, made).otherwise(F.col("entity_id"))
    )
    own = F.when(F.col("_known_type") != UNKNOWN, F.col("_known_type"))
    return resolved.join(typed.hint("merge"), "entity_id", "left").select(
        "name", "language", "entity_type", "entity_id", "kb_id", F.coalesce(own, "entity_type", F.lit(UNKNOWN)).alias("resolved_type"), "status"
    )


def get_or_create_entities(candidates: DataFrame, entities: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(all, new entities, new documents) for candidates (name, entity_type, kb_id, url, source_type, seq).

    New entities take name and type of the first candidate of their knowledge-base id; documents
    are new if no document has their url and type.
    """
    keyed = candidates.filter("kb_id is not null")
    first = dedupe_first(keyed, ["kb_id"], ["seq"], keep_null_keys=False)
    known = entities.select(F.col("wikibase_item").alias("kb_id"), F.col("id").alias("entity_id"))
    fresh = first.join(known.select("kb_id").hint("merge"), "kb_id", "left_anti").select(
        F.sha2(F.concat(F.lit("entity-"), "kb_id"), 256).alias("id"), F.col("name").alias("entity_name"), "entity_type",
        F.col("kb_id").alias("wikibase_item"), F.lit(True).alias("existence_verified"),
    )
    found = keyed.join(known.hint("merge"), "kb_id", "left_semi").join(known.hint("merge"), "kb_id").select("kb_id", "entity_id", F.lit(False).alias("is_new")).distinct()
    every = found.union(fresh.select("wikibase_item", "id", F.lit(True)))
    pages = dedupe_first(keyed, ["url", "source_type"], ["seq"], keep_null_keys=False).withColumnRenamed("url", "wikipedia_url")
    return every, fresh, insert_ignore(documents, pages, ["wikipedia_url", "source_type"])


def link_entities(events: DataFrame, resolved: DataFrame) -> DataFrame:
    """Events (event_id, language, entities array<struct<name,type>>) with distinct ``entity_ids``.

    Each distinct request is resolved once; names that are not resolved are skipped.
    """
    asked = events.select("event_id", "language", F.explode("entities").alias("e")).select(
        "event_id", F.trim("e.name").alias("name"), "language"
    ).filter("name <> ''")
    ids = resolved.filter("entity_id is not null").groupBy("name", "language").agg(F.min("entity_id").alias("entity_id"))
    linked = asked.join(ids.hint("merge"), ["name", "language"]).groupBy("event_id").agg(F.sort_array(F.collect_set("entity_id")).alias("entity_ids"))
    return events.join(linked.hint("merge"), "event_id", "left").withColumn("entity_ids", F.coalesce("entity_ids", F.array().cast("array<string>")))


def raw_event_entities(links: DataFrame, entities: DataFrame) -> DataFrame:
    """(raw_event_id, entity columns) of the links whose entity exists."""
    return links.join(entities.withColumnRenamed("id", "entity_id").hint("merge"), "entity_id")


def unknown_kb_ids(candidates: DataFrame, entities: DataFrame) -> DataFrame:
    """Knowledge-base ids that no entity has."""
    known = entities.select(F.col("wikibase_item").alias("kb_id"))
    return candidates.select("kb_id").filter("kb_id is not null").distinct().join(known.hint("merge"), "kb_id", "left_anti")
