import pytest
from oracle import compare, connect

from changeloom.plans import catalogue


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, con, sf, name):
    compare(spark, con, sf, catalogue.queries()[name], catalogue.oracle_sql()[name])
