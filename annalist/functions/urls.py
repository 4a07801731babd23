"""Addresses of sources, their labels, and the names of sources and tasks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Source identifiers and task types with the names shown for them.
SOURCE_NAMES = {
    "dataset_wikipedia_en": "Dataset Wikipedia (EN)",
    "online_wikipedia": "Online Wikipedia",
    "online_wikinews": "Online Wikinews",
}
TASK_NAMES = {
    "synthetic_viewpoint": "Synthetic Viewpoint",
    "entity_canonical": "Entity Timeline",
    "document_canonical": "Document Timeline",
}
ENCYCLOPEDIA = "wikipedia.org"


def page_id_from_url(url: Column) -> Column:
    """The ``curid`` parameter, null without one."""
    return F.nullif(F.regexp_extract(url, r"^[^?#]*\?(?:[^#]*&)?curid=([^&#]+)", 1), F.lit(""))


def normalise_url(url: Column, page_id: Column | None = None, language: Column | None = None) -> Column:
    """One address a page, ``https://<language>.wikipedia.org/wiki?curid=<id>``; others unchanged."""
    none = F.lit(None).cast("string")
    own_language = F.nullif(F.regexp_extract(F.trim(url), r"^[a-zA-Z]+://([a-z]{2,3})\.wikipedia\.org(?:[/?#]|$)", 1), F.lit(""))
    lang = F.coalesce(F.nullif(language if language is not None else none, F.lit("")), own_language)
    page = F.coalesce(F.nullif(page_id if page_id is not None else none, F.lit("")), page_id_from_url(F.trim(url)))
    made = F.concat(F.lit("https://"), lang, F.lit(f".{ENCYCLOPEDIA}/wiki?curid="), page)
    return F.when(url == "", url).otherwise(F.coalesce(F.when(url.isNotNull(), made), url))


def is_encyclopedia_source(source_type: Column, url: Column) -> Column:
    named = F.lower(source_type).contains("wikipedia") | F.coalesce(F.lower(url).contains(ENCYCLOPEDIA), F.lit(False))
    return F.coalesce((source_type != "") & named, F.lit(False))


def url_domain(url: Column) -> Column:
    """Host without ``www.``; ``External Source`` for what is no address."""
    host = F.nullif(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))
    return F.coalesce(F.regexp_replace(F.lower(host), r"^(.*?)www\.", "$1"), F.lit("External Source"))


def source_label(url: Column) -> Column:
    domain = url_domain(url)
    return (
        F.when(url.isNull() | (url == ""), "")
        .when(domain.contains(ENCYCLOPEDIA), "Wikipedia")
        .when(domain.contains("wikinews.org"), "Wikinews")
        .when(domain.contains("dataset") | url.contains("dataset_wikipedia_en"), "Dataset")
        .otherwise("")
    )


def source_link_text(title: Column, url: Column) -> Column:
    domain = url_domain(url)
    return (
        F.when(F.trim(title) != "", title)
        .when((url != "") & (domain != "External Source"), F.concat(F.lit("View on "), domain))
        .otherwise("View Source")
    )


def parse_source_preference(text: Column) -> Column:
    """Array of the sources of a comma list; the online encyclopedia if it names none."""
    found = F.filter(F.transform(F.split(text, ","), F.trim), lambda x: x != "")
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("online_wikipedia")))


def _named(value: Column, names: dict[str, str], otherwise: Column) -> Column:
    shown = otherwise
    for key, name in names.items():
        shown = F.when(value == key, name).otherwise(shown)
    return shown


def source_display_names(text: Column) -> Column:
    default = text.isNull() | text.isin("", "default")
    shown = F.transform(F.split(text, ","), lambda x: _named(F.trim(x), SOURCE_NAMES, F.trim(x)))
    return F.when(default, F.array(F.lit("Default Sources"))).otherwise(shown)


def task_type_name(task_type: Column) -> Column:
    return _named(task_type, TASK_NAMES, F.lit("Unknown Type"))


def task_description(task_type: Column, topic: Column, entity_id: Column, document_id: Column) -> Column:
    given = lambda c, other: F.coalesce(F.nullif(c, F.lit("")), F.lit(other))
    return (
        F.when(task_type == "synthetic_viewpoint", given(topic, "Synthetic viewpoint"))
        .when(task_type == "entity_canonical", F.concat(F.lit("Entity: "), given(entity_id, "Unknown")))
        .when(task_type == "document_canonical", F.concat(F.lit("Document: "), given(document_id, "Unknown")))
        .otherwise("Unknown source")
    )
