"""Every registered query against its SQL in DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import check, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    assert check(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), FOLDER) is None


def test_sql_keys_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
