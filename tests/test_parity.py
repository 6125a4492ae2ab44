"""Every registered query against its SQL, on the smallest tables."""

import pytest

from checks.oracles import ORACLES
from checks.parity import compare, connect
from checks.queries import QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, con, sf, name):
    assert compare(spark, con, sf, QUERIES[name], ORACLES[name]) == []


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
