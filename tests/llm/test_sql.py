"""Queries that SQL can express, against DuckDB."""

import pytest

from grantweave.llm.queries import QUERIES, SQL
from tests.oracle_check import compare


@pytest.mark.parametrize("key", sorted(SQL))
def test_matches_sql(spark, duck_small, small, key):
    ok, *_, detail = compare(spark, duck_small, key, QUERIES[key], SQL[key], small)
    assert ok, detail
