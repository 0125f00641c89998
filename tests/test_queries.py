"""Every registered query runs; those with SQL give the same rows as DuckDB."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_module
from helpers import database, same_result

SF_DIR = "/root/testdata/sf0.001"
# The optional subpackage has tests of its own.
OWN = set(entry_module.queries()) - set(entry_module.LLM_QUERIES)
QUERIES = {k: v for k, v in entry_module.queries().items() if k in OWN}
ORACLES = {k: v for k, v in entry_module.oracle_sql().items() if k in OWN}
WITHOUT_SQL = {"augment_draw"}


@pytest.fixture(scope="module")
def con():
    return database(SF_DIR)


def test_only_named_queries_lack_sql():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, con, name):
    same_result(QUERIES[name](spark, SF_DIR), con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    df = entry_module.entry(spark)
    assert {"run_id", "timestamp", "is_anomaly"} <= set(df.columns)
    assert df.count() > 0
