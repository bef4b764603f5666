"""Every query with SQL gives the same rows; the others run."""

from __future__ import annotations

import pytest
from oracle import connection, rows

from passagework.plans import registry


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, sf_dir, con, name):
    got = registry.QUERIES[name](spark, sf_dir)
    cursor = con.execute(registry.SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(got.columns) == sorted(columns)
    found = rows(got.columns, [tuple(r) for r in got.collect()])
    assert found and found == rows(columns, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_runs(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_wide_columns_are_pruned_and_filters_pushed(spark, sf_dir):
    plan = registry.library_view(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull" in plan
    counts = registry.library_counts(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<source:string>" in counts
