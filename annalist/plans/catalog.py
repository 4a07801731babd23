"""Every registered query of the library and the SQL it is compared with."""

from __future__ import annotations

from annalist.plans import cluster_queries, date_queries, search_queries, task_queries, timeline_queries

_PARTS = (date_queries, cluster_queries, search_queries, task_queries, timeline_queries)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
