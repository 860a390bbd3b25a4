import pytest
from oracle import same

from verdict import plans

QUERIES, SQL = plans.queries(), plans.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, small, name):
    same(spark, small, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
