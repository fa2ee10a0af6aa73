"""The operators' queries against their SQL, and the guard of the entry."""

import pytest

from helpers import DATA, rows_in, rows_of
from declgraph.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    relation = duck.sql(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(relation.columns)
    assert rows_of(df) == rows_in(relation)


def test_one_query_for_each_operator():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 11))
