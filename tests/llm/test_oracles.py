"""The registered training-data queries that have SQL, on the smallest tables."""

import pytest

from termloom.llm.oracles import ORACLES
from termloom.llm.queries import QUERIES
from tests.oracle import HERE, agree


@pytest.mark.skipif(not HERE, reason="needs the given tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_and_sql_agree(spark, name):
    agree(spark, QUERIES[name], ORACLES[name])
