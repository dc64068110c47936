"""Every query of the registry that SQL can express, against DuckDB."""

from __future__ import annotations

import pytest

from waymark.plans import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_sql(same_as_duckdb, name):
    same_as_duckdb(registry.QUERIES[name], registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_runs(spark, name):
    df = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert df.count() >= 1


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
