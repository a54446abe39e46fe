"""Every query with SQL gives the SQL's rows; every query runs."""

import pytest

from folioquery.plans import catalog
from tests.compare import connect, rows

SQL = catalog.oracle_sql()
QUERIES = catalog.queries()


@pytest.fixture(scope="session")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, data, con, name):
    got, want = QUERIES[name](spark, data).toPandas(), con.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).columns
    QUERIES[name](spark, data).count()


def test_entry(spark, data):
    import __spark_entry__ as entry

    assert set(catalog.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
