"""Task and viewpoint queries: filters, pages, visibility, reuse, and checks of inputs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.functions.vectors import is_usable

MAX_PAGE = 100


def filter_by(df: DataFrame, **equal) -> DataFrame:
    """Rows with all these values; None means null."""
    tests = [F.col(k).isNull() if v is None else F.col(k) == v for k, v in equal.items()]
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df


def filter_tuples(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose values in the columns of ``keys`` are among its rows."""
    return df.join(keys.distinct().hint("merge"), keys.columns, "left_semi")


def filter_any(df: DataFrame, sets: Sequence[dict]) -> DataFrame:
    """Rows that match any of the sets of equal values; no set matches nothing."""
    tests = [reduce(lambda a, b: a & b, [F.col(k) == v for k, v in s.items()]) for s in sets if s]
    return df.filter(reduce(lambda a, b: a | b, tests)) if tests else df.limit(0)


def page(df: DataFrame, order: Sequence[Column | str], limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of an ordered table; bounds are checked."""
    if not 1 <= limit <= MAX_PAGE or offset < 0:
        raise ValueError(f"limit must be in 1..{MAX_PAGE} and offset 0 or more")
    return df.orderBy(*order).offset(offset).limit(limit)


def visible_tasks(tasks: DataFrame, user: str | None, owned_only: bool = False) -> DataFrame:
    """Public tasks and the user's own; the own ones only if asked. No user: the public ones."""
    own = F.coalesce(F.col("owner_id") == F.lit(user), F.lit(False))
    return tasks.filter(own if owned_only else F.coalesce("is_public", F.lit(False)) | own)


def list_tasks(
    tasks: DataFrame, users: DataFrame, user: str | None = None, status: str | None = None, task_type: str | None = None,
    owned_only: bool = False, limit: int = 20, offset: int = 0,
) -> DataFrame:
    """A page of visible tasks, newest first, with the owner's name."""
    wanted = {k: v for k, v in (("status", status), ("task_type", task_type)) if v is not None}
    rows = page(filter_by(visible_tasks(tasks, user, owned_only), **wanted), [F.desc("created_at"), F.desc("id")], limit, offset)
    owners = users.select(F.col("id").alias("owner_id"), F.col("username").alias("owner_name"))
    return rows.join(owners, "owner_id", "left").orderBy(F.desc("created_at"), F.desc("id"))


def public_timelines(tasks: DataFrame, links: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of public completed tasks with events, newest first, with ``n_events``."""
    count = links.groupBy("viewpoint_id").agg(F.count(F.lit(1)).alias("n_events"))
    done = tasks.filter("is_public and status = 'completed'")
    return page(done.join(count.hint("merge"), "viewpoint_id"), [F.desc("created_at"), F.desc("id")], limit, offset)


def reusable_tasks(requests: DataFrame, tasks: DataFrame, viewpoints: DataFrame) -> DataFrame:
    """(topic, data_source_preference, task_id, viewpoint_id): the latest completed task whose
    completed viewpoint has the request's topic and sources."""
    views = viewpoints.filter("status = 'completed'").select(F.col("id").alias("viewpoint_id"), "topic", "data_source_preference")
    done = tasks.filter("status = 'completed'").select(F.col("id").alias("task_id"), "viewpoint_id", "created_at")
    keys = ["topic", "data_source_preference"]
    found = requests.select(*keys).distinct().join(views.hint("merge"), keys).join(done.hint("merge"), "viewpoint_id")
    best = found.groupBy(*keys).agg(F.max(F.struct("created_at", "task_id", "viewpoint_id")).alias("best"))
    return best.select(*keys, "best.task_id", "best.viewpoint_id")


def recent_completed(tasks: DataFrame, n: int) -> DataFrame:
    return tasks.filter("status = 'completed'").orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def recent_by_topic(records: DataFrame, topic: str) -> DataFrame:
    """Kept records of a topic, the last used first."""
    return records.filter(F.col("topic") == topic).orderBy(F.desc("last_accessed"), F.desc("id"))


#: Search modes, task types and what each type needs.
SEARCH_MODES = ("semantic", "hybrid_title_search")
REQUIRED = {"synthetic_viewpoint": "topic_text", "entity_canonical": "entity_id", "document_canonical": "source_document_id"}


def _split(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    errors = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())
    checked = df.withColumn("errors", errors)
    return checked.filter(F.size("errors") == 0).drop("errors"), checked.filter(F.size("errors") > 0)


def check_configs(configs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid with ``errors``) search settings; missing values are fine."""
    unit = lambda c: F.col(c).isNull() | F.col(c).between(0, 1)
    hybrid = F.coalesce(F.col("search_mode") == "hybrid_title_search", F.lit(False))
    zero = (F.coalesce("vector_weight", F.lit(0.6)) == 0) & (F.coalesce("bm25_weight", F.lit(0.4)) == 0)
    return _split(configs, {
        "search_mode": F.col("search_mode").isNull() | F.col("search_mode").isin(*SEARCH_MODES),
        "vector_weight": unit("vector_weight"), "bm25_weight": unit("bm25_weight"),
        "article_limit": F.col("article_limit").isNull() | F.col("article_limit").between(1, 50),
        "relevance_threshold": unit("relevance_threshold"), "weights": ~(hybrid & zero),
    })


def check_tasks(tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid with ``errors``): a known type, and the field that type needs."""
    needed = F.lit(False)
    for kind, column in REQUIRED.items():
        needed = needed | ((F.col("task_type") == kind) & (F.coalesce(F.trim(column), F.lit("")) != ""))
    return _split(tasks, {"task_type": F.col("task_type").isin(*REQUIRED), "required_field": needed})


def check_timeline_inputs(events: DataFrame, dimension: int) -> DataFrame:
    """Events with a date string and a usable vector."""
    return events.filter((F.coalesce(F.trim("event_date_str"), F.lit("")) != "") & is_usable(F.col("description_vector"), dimension))


def request_metrics(log: DataFrame) -> DataFrame:
    """One row of counts and rates of a request log, errors by type in a map."""
    failed = log.filter("not success and error_type is not null").groupBy("error_type").agg(F.count(F.lit(1)).alias("n"))
    kinds = failed.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("error_type", "n")))).alias("errors_by_type"))
    rates = log.agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.coalesce(F.round(F.avg(F.col("success").cast("int")), 3), F.lit(0.0)).alias("success_rate"),
        F.coalesce(F.round(F.avg("response_time"), 3), F.lit(0.0)).alias("average_response_time"),
        F.coalesce(F.round(F.avg(F.col("from_cache").cast("int")), 3), F.lit(0.0)).alias("cache_hit_rate"),
    )
    return rates.withColumn("_k", F.lit(1)).join(kinds.withColumn("_k", F.lit(1)), "_k").drop("_k")
