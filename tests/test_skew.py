"""A key holding a third of all rows: results stay whole and exact.

AQE's skew thresholds are lowered so skewed partitions really are split;
results are compared with a brute-force evaluation in plain Python.
"""

import itertools

import pytest
from pyspark.sql import functions as F

from grantweave import schemas
from grantweave.operators import ledger, resolve, upsert

SKEW_CONF = {
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
}


@pytest.fixture
def skewed(spark):
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def test_hot_tag_list(skewed):
    spark = skewed
    n = 3000
    # a third of the rules share one tag list; the rest spread over 100 lists
    rules = [(i, "HOT,SMALL" if i % 3 == 0 else f"T{i % 100}") for i in range(n)]
    stored = [(f"c{j % 3}", f"s{j}", "tier", "HOT, x" if j % 2 == 0 else f"T{j % 100},SMALL") for j in range(600)]
    r = spark.createDataFrame(rules, "acl_id long, tag_values string").withColumn("tags", F.split("tag_values", ","))
    st = spark.createDataFrame(stored, schemas.SCHEMA_TAGS)
    got = {(x["acl_id"], x["object_name"]) for x in resolve.resolve_tags(r, st).collect()}
    want = set()
    for (i, tv), (c, s, _, v) in itertools.product(rules, stored):
        if set(tv.split(",")) & set(v.split(",")):
            want.add((i, f"{c}.{s}"))
    assert got == want
    assert len(got) > n  # the hot list fans out to many schemas per rule


def test_hot_tag_list_output_is_dealt_to_several_tasks(spark):
    """At AQE's defaults no task makes more than its share of a hot list's pairs."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        rules_ = spark.range(20_000).selectExpr("id acl_id", "if(id % 3 = 0, 'HOT', concat('T', id % 900)) tag_values").withColumn("tags", F.split("tag_values", ","))
        stored = spark.range(200).selectExpr("'c' catalog_name", "concat('s', id) schema_name", "'t' tag_name", "concat('HOT,T', id % 900) tag_value")
        out = resolve.resolve_tags(rules_, stored).groupBy(F.spark_partition_id().alias("p")).count().collect()
        total, most = sum(r["count"] for r in out), max(r["count"] for r in out)
        assert total > 1_300_000 and most < 0.4 * total
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_hot_tag_item_in_many_lists_is_dealt_to_several_tasks(spark):
    """One item in a third of many distinct lists and in every stored value: complete, and no task makes it alone."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        keys = spark.range(9_000).selectExpr("if(id % 3 = 0, concat('HOT,L', id), concat('L', id)) tag_key", "1 salts")
        stored = spark.range(200).selectExpr("'c' catalog_name", "concat('s', id) schema_name", "'t' tag_name", "concat('HOT,L', id) tag_value")
        out = resolve.tag_key_pairs(keys, stored).groupBy(F.spark_partition_id().alias("p")).count().collect()
        total, most = sum(r["count"] for r in out), max(r["count"] for r in out)
        assert total == 3_000 * 200 + 200 and most < 0.4 * total
        assert resolve.resolve_tag_keys(keys, stored).count() == 3_000 * 200 + 133  # 67 of the 200 L lists hold HOT as well
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_hot_upsert_key(skewed):
    spark = skewed

    def rows(ids, hot):
        out = []
        for i in ids:
            key_i = 0 if (hot and i % 3 == 0) else i
            out.append((i, "SCHEMA", "g", None, f"raw.s{key_i}", None, "DATA_READER", "GRANT", None, "B", None, None))
        return spark.createDataFrame(out, schemas.ACL_MAPPING)

    target = rows(range(0, 3000, 2), hot=True)   # the hot key is already in the target
    incoming = rows(range(3000), hot=True)
    res = upsert.upsert(target, incoming)
    tkeys = {0 if i % 3 == 0 else i for i in range(0, 3000, 2)}
    new_keys = {0 if i % 3 == 0 else i for i in range(3000)} - tkeys
    assert res.count() == 1500 + len(new_keys)
    assert res.select("schema_names").distinct().count() == len(tkeys | new_keys)


def test_hot_ledger_key(skewed):
    spark = skewed
    # a third of 3000 statements hit one grant key; last (highest acl_id) wins
    rows = []
    for i in range(3000):
        obj = "hot.obj" if i % 3 == 0 else f"o{i}"
        rows.append((i, "SELECT", "TABLE", obj, "g", "REVOKE" if i == 2997 else "GRANT"))
    s = spark.createDataFrame(rows, "acl_id long, privilege string, object_type string, object_name string, "
                                    "user_group string, grant_type string")
    old = spark.createDataFrame([("SELECT", "TABLE", "hot.obj", "g")], "privilege string, object_type string, object_name string, user_group string")
    got = {r["object_name"] for r in ledger.apply_statements(old, s).collect()}
    assert "hot.obj" not in got  # acl_id 2997 (a hot-key row) revokes last
    assert len(got) == 2000
