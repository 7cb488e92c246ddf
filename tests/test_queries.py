"""Every registered query runs, and equals its SQL where it has one."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def connection(folder):
    return connect(folder)


def test_entry(spark, folder):
    assert entry.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, folder, connection, name):
    assert compare(QUERIES[name](spark, folder), connection, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, folder, name):
    assert not QUERIES[name](spark, folder).isEmpty()
