"""The text queries that SQL can express, against DuckDB."""

from __future__ import annotations

import pytest
from oracle_check import compare, connect

from beatwatch.llm import oracles, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_query_matches_sql(spark, name):
    assert compare(spark, connect(SF), SF, queries.QUERIES[name], oracles.SQL[name]) == ""
