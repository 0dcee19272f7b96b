import pytest

from millrace import catalog

from .oracle import compare

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf, name):
    assert compare(QUERIES[name](spark, sf), SQL[name], sf) > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_has_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
