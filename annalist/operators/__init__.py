"""Joins, clustering, retrieval, entities, timelines and task queries."""
