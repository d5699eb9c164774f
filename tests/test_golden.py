"""Golden counts for the flagship (FIXTURES.md section 4)."""

import pytest
from pyspark.sql import functions as F

from grantweave.registry import QUERIES
from tests.conftest import SF_MID, SF_SMALL


@pytest.mark.parametrize(
    "sf_dir,total,distinct,revokes",
    [(SF_SMALL, 1751, 1558, 583), (SF_MID, 119401, 52499, 40687)],
)
def test_statement_counts(spark, sf_dir, total, distinct, revokes):
    r = QUERIES["statement_counts"](spark, sf_dir).collect()[0]
    assert (r["total"], r["distinct_statements"], r["revokes"]) == (total, distinct, revokes)
    assert r["is_empty"] is False


def test_tag_resolve_pairs(spark):
    df = QUERIES["tag_resolve"](spark, SF_MID)
    assert df.count() == 46217
    assert df.select(F.count_distinct("acl_id")).first()[0] == 371
