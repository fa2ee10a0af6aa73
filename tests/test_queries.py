"""Each driver query against its SQL, at the smallest scale."""

import pytest

from helpers import DATA, rows_in, rows_of
from declgraph.queries import catalogue, more, store, tree  # noqa: F401  (they register their queries)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    relation = duck.sql(catalogue.ORACLES[name])
    assert sorted(df.columns) == sorted(relation.columns)
    assert rows_of(df) == rows_in(relation)
