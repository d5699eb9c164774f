"""Every registered query against its DuckDB oracle (as the driver checks)."""

import pytest

import __spark_entry__ as ent
from grantweave.registry import QUERIES
from tests.conftest import SF_SMALL
from tests.oracle_check import compare

KEYS = sorted(QUERIES)


def test_every_key_has_an_oracle():
    missing = [k for k in KEYS if k not in ent.oracle_sql()]
    assert missing == []


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, duck_small, key):
    ok, ns, nd, _, _, detail = compare(spark, duck_small, key, ent.queries()[key], ent.oracle_sql()[key], SF_SMALL)
    assert ok, detail


def test_entry_runs(spark):
    df = ent.entry(spark)
    assert df.columns == [f.name for f in df.schema.fields]
    assert df.count() == 1751
