"""Declared schemas of the domain tables and their nested types."""

from __future__ import annotations

from pyspark.sql.types import StructType

DATE_INFO = (
    "struct<original_text:string,display_text:string,precision:string,start_year:int,start_month:int,start_day:int,"
    "end_year:int,end_month:int,end_day:int,is_bce:boolean>"
)
ENTITY_REF = "struct<entity_id:string,original_name:string,entity_type:string>"
SOURCE_INFO = "struct<language:string,title:string,url:string,document_id:string,source_type:string>"
PRECISIONS = ("day", "month", "year", "season", "decade", "century", "millennium", "era", "unknown")

_STAMPS = "id string, created_at timestamp, updated_at timestamp"
#: Columns of each table; the keys are the names of the tables.
COLUMNS = {
    "tasks": f"{_STAMPS}, task_type string, topic_text string, entity_id string, source_document_id string, owner_id string,"
    " is_public boolean, status string, processing_duration double, config map<string,string>, notes string,"
    " processed_at timestamp, viewpoint_id string",
    "viewpoints": f"{_STAMPS}, status string, topic string, viewpoint_type string, data_source_preference string,"
    " canonical_source_id string",
    "events": f"{_STAMPS}, event_date_str string, description string, date_info {DATE_INFO}, description_vector array<float>",
    "raw_events": f"{_STAMPS}, deduplication_signature string, original_description string, event_date_str string,"
    f" date_info {DATE_INFO}, source_document_id string, source_text_snippet string",
    "source_documents": f"{_STAMPS}, processing_status string, source_type string, title string, wikipedia_url string,"
    " language string, wikibase_item string, wiki_pageid string, extract string, source_document_version string,"
    " source_document_timestamp timestamp, entity_id string",
    "entities": f"{_STAMPS}, entity_name string, entity_type string, wikibase_item string, existence_verified boolean",
    "event_entity_associations": "event_id string, entity_id string",
    "event_raw_event_associations": "event_id string, raw_event_id string",
    "raw_event_entity_associations": "raw_event_id string, entity_id string",
    "viewpoint_event_associations": "viewpoint_id string, event_id string, sequence_order int, relevance_score double",
    "viewpoint_progress_steps": "viewpoint_id string, step_name string, event_timestamp timestamp, message string",
    "users": f"{_STAMPS}, username string",
}
#: What is unique in each table.
KEYS = {
    "tasks": ("id",),
    "viewpoints": ("id",),
    "events": ("id",),
    "raw_events": ("source_document_id", "deduplication_signature"),
    "source_documents": ("wikipedia_url", "source_type"),
    "entities": ("wikibase_item",),
    "event_entity_associations": ("event_id", "entity_id"),
    "event_raw_event_associations": ("event_id", "raw_event_id"),
    "raw_event_entity_associations": ("raw_event_id", "entity_id"),
    "viewpoint_event_associations": ("viewpoint_id", "event_id"),
    "viewpoint_progress_steps": ("viewpoint_id", "step_name", "message"),
    "users": ("username",),
}
#: The chunk corpus and its page table.
CHUNKS = "chunk_id long, doc_id string, chunk_index int, title string, url string, chunk_text string, vector array<float>"
PAGES = "doc_id string, title string, url string"


def schema(name: str) -> StructType:
    return StructType.fromDDL(COLUMNS[name])
