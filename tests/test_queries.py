"""Every registered query at the smallest scale against its SQL text."""

import pytest

import __spark_entry__ as entry
from tests.compare import check, connect

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, sf, con, name):
    ok, message = check(spark, con, name, entry.queries()[name], SQL.get(name), sf)
    assert ok, message


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_sql_text_has_a_query():
    assert set(SQL) <= set(entry.queries())
