"""Small frames for tests, and comparison of query results with DuckDB."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

import duckdb
from pyspark.sql import DataFrame

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages"
          " benchmark labels conversations").split()
START = datetime(2024, 1, 1)


def at(seconds: float) -> datetime:
    return START + timedelta(seconds=seconds)


def rows(df: DataFrame, *columns: str) -> list[tuple]:
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value if isinstance(value, int) else str(value)


def same_result(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    columns = sorted(df.columns)
    ours = sorted(repr([plain(v) for v in r]) for r in df.select(*columns).collect())
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    theirs = sorted(repr([plain(r[i]) for i in places]) for r in found.fetchall())
    assert len(ours) == len(theirs)
    assert ours == theirs
