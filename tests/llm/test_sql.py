"""The SQL of the queries that have one, over the smallest tables."""

import pytest

from plateflow.llm import queries
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_gives_the_same_rows(spark, duck, name):
    frame = queries.queries()[name](spark, SF)
    want = duck.sql(queries.oracle_sql()[name])
    assert sorted(frame.columns) == sorted(want.columns)
    rows = sorted(tuple(r[c] for c in want.columns) for r in frame.collect())
    assert rows == sorted(want.fetchall())
