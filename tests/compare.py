"""Compares a query's rows with those of its SQL, whatever the order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def engine(folder: str):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for name in TABLES:
        if Path(f"{folder}/{name}.parquet").exists():
            con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value) -> str:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "-"
    if isinstance(value, float):
        return repr(round(value, 9) + 0.0)
    if isinstance(value, dict):
        return str({k: plain(v) for k, v in sorted(value.items())})
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return str(value)


def rows_of(rows, columns) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in rows)


def assert_same(df, con, sql: str) -> None:
    other = con.sql(sql)
    assert sorted(df.columns) == sorted(other.columns)
    assert rows_of(df.collect(), df.columns) == rows_of(other.fetchall(), other.columns)
