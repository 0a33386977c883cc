"""Every query with SQL against DuckDB; every other gives rows of a stable schema."""

from __future__ import annotations

import pytest

from weftline import plans

from .oracle import database, difference

QUERIES, SQL = plans.queries(), plans.oracle_sql()


@pytest.fixture(scope="module")
def db(sf):
    return database(sf)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_same_as_sql(spark, sf, db, name):
    assert not difference(QUERIES[name](spark, sf), db, SQL[name])


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_rows_and_schema(spark, sf, name):
    first, again = QUERIES[name](spark, sf), QUERIES[name](spark, sf)
    assert first.schema == again.schema
    assert sorted(map(str, first.collect())) == sorted(map(str, again.collect()))


def test_sql_has_queries():
    assert set(SQL) <= set(QUERIES)
