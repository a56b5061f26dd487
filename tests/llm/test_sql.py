"""The llm queries that have SQL, against DuckDB."""

import pytest
from oracle import difference

from quillspark.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, name):
    assert difference(spark, "/root/testdata/sf0.01", queries()[name], oracle_sql()[name]) == ""
