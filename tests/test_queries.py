"""Every named query of the core runs; those with SQL give the same rows."""

import pytest

from corpusloom.plans import queries as core
from tests.oracle import assert_same, database

QUERIES, SQL = core.queries(), core.oracle_sql()


@pytest.fixture(scope="module")
def db(data):
    return database(data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, db, name):
    frame = QUERIES[name](spark, data)
    if name in SQL:
        assert_same(frame, db, SQL[name])
    else:
        assert frame.count() >= 0


def test_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
