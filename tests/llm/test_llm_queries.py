"""Every named query of this folder runs; those with SQL give the same rows."""

import pytest

from corpusloom.llm import queries as training
from tests.oracle import assert_same, database

QUERIES, SQL = training.queries(), training.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    frame = QUERIES[name](spark, data)
    if name in SQL:
        assert_same(frame, database(data), SQL[name])
    else:
        assert frame.count() > 0
