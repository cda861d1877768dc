"""Every registered query of the core with its SQL, on the smallest tables."""

import pytest

from termloom import queries, queries_io  # noqa: F401  both register
from tests.oracle import HERE, agree


@pytest.mark.skipif(not HERE, reason="needs the given tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_and_sql_agree(spark, name):
    agree(spark, queries.QUERIES[name], queries.ORACLES[name])
