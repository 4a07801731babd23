"""Scores and rules for pairs of events, and classes of log rows.

Sides are structs with ``entity_ids``, ``entity_types`` (arrays), ``year``, ``date_range``,
``language`` and ``description``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from annalist.functions.dates import ranges_overlap

#: Columns of an event that these scores read.
SIDE = ("entity_ids", "entity_types", "year", "date_range", "language", "description")
MAX_YEARS, MAX_LENGTH_RATIO, MIN_OVERLAP = 2, 5, 0.75


def pair_key(a: Column, b: Column) -> Column:
    """The same key for (a, b) and (b, a)."""
    return F.concat_ws("|", F.least(a, b).cast("string"), F.greatest(a, b).cast("string"))


def _common(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def overlap_ratio(a: Column, b: Column) -> Column:
    """Common entities over the smaller set; 0 if a set is empty."""
    smaller = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(smaller > 0, _common(a, b) / smaller).otherwise(F.lit(0.0))


def rule_match(a: Column, b: Column, least: float = MIN_OVERLAP) -> Column:
    """Enough common entities, and dates that overlap or are both missing."""
    x, y = a["date_range"], b["date_range"]
    dates = F.when(x.isNotNull() & y.isNotNull(), ranges_overlap(x, y)).otherwise(x.isNull() & y.isNull())
    return (overlap_ratio(a["entity_ids"], b["entity_ids"]) >= least) & dates


def quick_exclude(a: Column, b: Column) -> Column:
    """True for pairs not worth a comparison: years apart, nothing in common, or lengths apart."""
    years = F.coalesce(F.abs(a["year"] - b["year"]) > MAX_YEARS, F.lit(False))
    nothing = (_common(a["entity_ids"], b["entity_ids"]) == 0) & (_common(a["entity_types"], b["entity_types"]) == 0)
    x, y = F.length(a["description"]), F.length(b["description"])
    uneven = F.coalesce((F.least(x, y) > 0) & (F.greatest(x, y) > MAX_LENGTH_RATIO * F.least(x, y)), F.lit(False))
    return years | nothing | uneven


def match_score(a: Column, b: Column) -> Column:
    """10 an entity, 5 a type, 30/20/10 by years apart, 10 for one language, 10 for one text."""
    gap = F.abs(a["year"] - b["year"])
    near = F.when(gap == 0, 30).when(gap == 1, 20).when(gap == 2, 10).otherwise(0)
    language = F.when(a["language"].eqNullSafe(b["language"]), 10).otherwise(0)
    text = F.when(F.coalesce(a["description"], F.lit("")) == F.coalesce(b["description"], F.lit("")), 10).otherwise(0)
    return 10 * _common(a["entity_ids"], b["entity_ids"]) + 5 * _common(a["entity_types"], b["entity_types"]) + near + language + text


def relevance_band(score: Column) -> Column:
    return F.when(score >= 0.75, "high").when(score >= 0.5, "medium").otherwise("low")


#: Retries an error class allows; classes not listed allow none.
MAX_RETRIES = {"timeout": 3, "rate_limit": 5, "server_busy": 4, "not_found": 0, "network_error": 3, "unknown": 2}


def error_class(kind: Column, status: Column, message: Column) -> Column:
    """Class of a failed request from its exception kind, HTTP status and response message."""
    k, m = F.lower(F.coalesce(kind, F.lit(""))), F.lower(F.coalesce(message, F.lit("")))
    return (
        F.when(k.contains("timeout"), "timeout")
        .when(status == 429, "rate_limit")
        .when(status.isin(502, 503, 504), "server_busy")
        .when(status == 404, "not_found")
        .when(m.contains("maxlag") | m.contains("busy"), "server_busy")
        .when(m.contains("not found") | m.contains("missing"), "not_found")
        .when(k.contains("connect") | k.contains("network"), "network_error")
        .otherwise("unknown")
    )


def may_retry(kind: Column, attempt: Column) -> Column:
    most = F.lit(0)
    for name, n in MAX_RETRIES.items():
        most = F.when(kind == name, n).otherwise(most)
    return attempt < most


def retry_delay(kind: Column, attempt: Column) -> Column:
    """Seconds before an attempt: half a second times a base to its power, 30 at most."""
    base = F.when(kind == "rate_limit", 3.0).when(kind == "server_busy", 2.0).when(kind == "timeout", 1.8).otherwise(1.5)
    return F.least(F.lit(30.0), 0.5 * F.pow(base, attempt))
