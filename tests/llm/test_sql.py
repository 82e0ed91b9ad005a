"""The registered queries against their SQL, over whole tables."""

import pytest
from oracle import connect, differences

from kindred.llm import queries

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert differences(queries.queries()[name](spark, DATA), connect(DATA), queries.oracle_sql()[name]) == ""
