"""Mask plan by parallel prefix, factored tag targets, and the jobs that fold rules into stored state."""

import random

import pytest
from pyspark.sql import functions as F

from grantweave import schemas
from grantweave.operators import masks, tags
from grantweave.plans.jobs import run_mask_job, run_tag_job
from grantweave.sources import config
from tests.test_operators import CATS


def one_by_one(rules, old):
    """What each rule does in its turn: (rule_id, action), from (rule_id, key, drop)."""
    in_force, out = set(old), []
    for rule_id, key, drop in sorted(rules, key=lambda r: (r[0], r[2])):
        out.append((rule_id, "DROP" if drop else "SKIP" if key in in_force else "CREATE"))
        in_force.discard(key) if drop else in_force.add(key)
    return sorted(out), in_force


@pytest.mark.parametrize("seed", [1, 2])
def test_mask_plan_equals_rules_one_by_one(spark, seed):
    rnd = random.Random(seed)
    n = 900
    # a third of all rules on one column, the rest on few others; ids with gaps, below zero and repeated
    ids = [rnd.randint(-300, 2_000) for _ in range(n)]
    rules = [(i, "hot" if rnd.random() < 0.34 else f"c{rnd.randint(0, 12)}", rnd.random() < 0.4) for i in ids]
    once = {}
    for i, key, drop in rules:  # one rule of a column per id
        once[i, key] = drop
    rules = [(i, key, drop) for (i, key), drop in once.items()]
    frame = spark.createDataFrame([(i, "raw.a.b", key, ["g"], "x", drop) for i, key, drop in rules], schemas.MASK_RULES).repartition(5)
    existing = spark.createDataFrame([("dev_main_raw.a.b", c, ["g"], "old") for c in ("HOT", "c1", "c2", "c99")], schemas.EXISTING_MASKS)
    cm = config.catalog_mapping(spark, CATS)
    got = masks.plan(frame, cm, "dev", existing)
    want, left = one_by_one(rules, {"hot", "c1", "c2", "c99"})
    assert sorted((r.rule_id, r.action) for r in got.collect()) == want
    assert {r.column_name.lower() for r in masks.state(frame, cm, "dev", existing).collect()} == left


def test_no_task_holds_a_hot_column(spark):
    """A third of all rules on one column: every window and carry sees a range of them at most."""
    n = 12_000
    rules = spark.range(n).selectExpr("id rule_id", "'raw.a.b' table_name", "if(id % 3 = 0, 'hot', concat('c', id % 500)) column_name", "array('g') user_group",
                                      "'x' type_of_masking", "id % 7 = 0 drop_existing")
    cm = config.catalog_mapping(spark, CATS)
    none = spark.createDataFrame([], schemas.EXISTING_MASKS)
    cut = masks.ranged(masks._resolved(rules, cm, "dev"))
    per = [r["count"] for r in cut.filter("_column_key = 'hot'").groupBy("_range").count().collect()]
    assert sum(per) == n // 3 and len(per) >= 8 and max(per) < 0.2 * n / 3
    carries = masks.carried(cut.filter("_reject is null"), none)
    assert carries.filter("_column_key = 'hot'").count() == len(per)
    plan = masks.plan(rules, cm, "dev", none)
    windows = [line for line in plan._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window [" in line]
    assert len(windows) == 2 and all("_range" in w for w in windows)  # over carries by key, over rules by key and range
    assert plan.count() == n


def test_a_product_of_targets_is_spread(spark):
    rule = [(1, "TABLE", "set", [f"xxx_s{i}" for i in range(3_000)], [f"t{i}" for i in range(300)], {"k": "v"}), (2, "SCHEMA", "set", [f"a{i}" for i in range(200)], None, {"k": "v"})]
    df = spark.createDataFrame(rule, schemas.TAG_RULES)
    out = tags.targets(df, "dev")
    per = {r["p"]: r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()}
    assert sum(per.values()) == 900_200 and max(per.values()) < 0.4 * 900_200
    got = out.filter("rule_ord = 1").agg(F.count_distinct("target_pos"), F.max("target_pos"), F.count_distinct("target")).first()
    assert tuple(got) == (900_000, 899_999, 900_000)
    assert out.filter("rule_ord = 1 and target_pos = 300 * 2999 + 17").first()["target"] == "dev_s2999.t17"
    blocks = tags.target_blocks(df, "dev").agg(F.max(F.size("schemas")), F.max(F.size("tables"))).first()
    assert blocks[0] <= tags.SCHEMAS_PER_BLOCK and blocks[1] <= tags.TABLES_PER_BLOCK


def test_targets_in_order_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(tags, "SCHEMAS_PER_BLOCK", 2)
    monkeypatch.setattr(tags, "TABLES_PER_BLOCK", 3)
    rows = [(i, "TABLE" if i % 2 else "SCHEMA", "set", [f"s{k}" for k in range(i % 6)] if i % 7 else None, [f"t{k}" for k in range(i % 8)] if i % 5 else None, {"k": "v"}) for i in range(40)]
    want = []
    for i, level, _, s, t, _ in rows:
        names = None if s is None else s if level == "SCHEMA" else None if t is None else [f"{a}.{b}" for a in s for b in t]
        want += [(i, k, x) for k, x in enumerate(names or [])]
    got = tags.targets(spark.createDataFrame(rows, schemas.TAG_RULES), "dev").collect()
    assert sorted((r.rule_ord, r.target_pos, r.target) for r in got) == sorted(want)
    missing = {r.rule_ord for r in tags.rejects(spark.createDataFrame(rows, schemas.TAG_RULES), "dev").collect() if r.reason == tags.REASON_MISSING}
    assert missing == {r[0] for r in rows} - {w[0] for w in want}


def test_jobs_write_new_state_and_dry_runs_do_not(spark):
    tr = spark.createDataFrame([(1, "SCHEMA", "set", ["xxx.a"], None, {"k": "v"}), (2, "SCHEMA", "unset", ["xxx.b"], None, {"k": None}), (3, "SCHEMA", "drop", ["xxx.b"], None, {"k": "v"})], schemas.TAG_RULES)
    old = spark.createDataFrame([("SCHEMA", "dev.b", "k", "1"), ("SCHEMA", "dev.c", "k", "2")], schemas.OBJECT_TAGS)
    for dry in (False, True):
        job = run_tag_job(tr, old, "dev", dry)
        want = {("dev.b", "1"), ("dev.c", "2")} if dry else {("dev.a", "v"), ("dev.c", "2")}
        assert {(r.target, r.tag_value) for r in job.state.collect()} == want and (job.state_path is None) == dry
        assert {(r.action, r.rules) for r in job.summary.collect()} == {("SET", 1), ("UNSET", 1), ("REJECT", 1)}
        assert [r.reason for r in job.rejects.collect()] == [tags.REASON_ACTION]
    again = run_tag_job(tr, run_tag_job(tr, old, "dev").state, "dev")  # a stored state is the next run's
    assert {(r.target, r.tag_value) for r in again.state.collect()} == {("dev.a", "v"), ("dev.c", "2")}
    mr = spark.createDataFrame([(1, "raw.a.b", "c", ["g"], "x", False), (2, "raw.a.b", "d", ["g"], "x", True), (3, "raw", "d", ["g"], "x", True)], schemas.MASK_RULES)
    had = spark.createDataFrame([("dev_main_raw.a.b", "D", ["g"], "old")], schemas.EXISTING_MASKS)
    cm = config.catalog_mapping(spark, CATS)
    for dry in (False, True):
        job = run_mask_job(mr, cm, had, "dev", dry)
        assert [r.column_name for r in job.state.collect()] == (["D"] if dry else ["c"])
        assert {(r.action, r.rules) for r in job.summary.collect()} == {("CREATE", 1), ("DROP", 1), ("REJECT", 1)}
        assert [r.reason for r in job.rejects.collect()] == [masks.REASON_BAD_REF]
