import pytest
from oracle import compare, connect

from changeloom.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_matches_sql(spark, sf, name):
    compare(spark, connect(sf), sf, Q.queries()[name], Q.oracle_sql()[name])
