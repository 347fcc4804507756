"""Every registered query against its SQL on the sample tables."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.01"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    rows, error = compare(spark, con, name, FOLDER, QUERIES, SQL)
    assert error is None, error


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns[0] == "d"
