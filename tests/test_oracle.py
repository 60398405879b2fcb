"""Every query with a SQL counterpart gives the same rows as DuckDB."""

import pytest
from compare import connect, differences

import __spark_entry__ as entry_point
from numerale.catalog.oracle import oracle
from numerale.catalog.queries import QUERIES

SQL = oracle()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf, con, name):
    assert differences(QUERIES[name](spark, sf), SQL[name], con) is None


def test_sql_only_for_known_queries():
    assert set(SQL) <= set(QUERIES) <= set(entry_point.queries())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_without_sql_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    rows = entry_point.entry(spark).collect()
    assert len(rows) == 5
    # a digit text is off by at most half a bin of the scaled value
    assert all(r.max_error <= r.scale * 0.0005 + 1e-6 for r in rows)
