"""The operators' queries against their SQL twins on the smallest tables."""

import pytest
from helpers import SMALL, assert_same

from codeloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(name, spark, duck):
    assert_same(queries.queries()[name](spark, SMALL), duck, queries.oracle_sql()[name])
