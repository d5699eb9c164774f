"""The maintained tag view and reader classes against their full forms."""

import random

import pytest
from pyspark.sql import functions as F

from grantweave import registry, schemas
from grantweave.operators import masks, resolve, tag_view
from grantweave.sources import testdata as td
from tests.conftest import SF_SMALL

RULE = "acl_id long, tag_values string, sign int"
SIGNED = "catalog_name string, schema_name string, tag_name string, tag_value string, sign int"


def relations(view):
    return [sorted(map(tuple, df.collect())) for df in (view.keys, view.items, view.pairs)]


@pytest.mark.parametrize("seed", [1, 2])
def test_refresh_equals_a_new_build(spark, seed):
    """Rounds of inserts and deletes of rules and tags, each on the view of the last."""
    rnd = random.Random(seed)
    tags = ["a", "b", "c", " c", "HOT", ""]
    rules, stored, view = [], [], None
    for _ in range(3):
        gone_r, gone_s = rnd.sample(rules, len(rules) // 2), rnd.sample(stored, len(stored) // 3)
        new_r = [(rnd.randint(0, 10**6), None if rnd.random() < 0.2 else ",".join(rnd.choices(tags, k=rnd.randint(1, 3)))) for _ in range(20)]
        new_s = [("c", f"s{rnd.randint(0, 9)}" + rnd.choice(["", "", "-x"]), "n", ",".join(rnd.choices(tags, k=rnd.randint(1, 3)))) for _ in range(12)]
        for x in gone_r:
            rules.remove(x)
        for x in gone_s:
            stored.remove(x)
        rules, stored = rules + new_r, stored + new_s
        dr = spark.createDataFrame([(*x, -1) for x in gone_r] + [(*x, 1) for x in new_r], RULE)
        ds = spark.createDataFrame([(*x, -1) for x in gone_s] + [(*x, 1) for x in new_s], SIGNED)
        view = tag_view.refresh(view or tag_view.empty(dr), dr, ds)
    now_r = spark.createDataFrame(rules, "acl_id long, tag_values string")
    now_s = spark.createDataFrame(stored, schemas.SCHEMA_TAGS)
    assert relations(view) == relations(tag_view.build(now_r, now_s))
    full = resolve.resolve_tags(now_r.withColumn("tags", F.split("tag_values", ",")), now_s)
    assert sorted(map(tuple, tag_view.rule_objects(view, now_r).collect())) == sorted(map(tuple, full.collect()))


def test_nothing_changed(spark):
    r = spark.createDataFrame([(1, "a"), (2, None)], "acl_id long, tag_values string")
    s = spark.createDataFrame([("c", "s", "n", "a,a")], schemas.SCHEMA_TAGS)
    view = tag_view.build(r, s)
    assert relations(view) == [[("a", 1)], [("a", "c.s", 2)], [("a", "c.s", 2)]]
    same = tag_view.refresh(view, spark.createDataFrame([], RULE), spark.createDataFrame([], SIGNED))
    assert relations(same) == relations(view)
    none = tag_view.refresh(view, spark.createDataFrame([(1, "a", -1)], RULE), spark.createDataFrame([("c", "s", "n", "a,a", -1)], SIGNED))
    assert relations(none) == [[], [], []]


def test_refresh_joins_changes_only(spark):
    """No stored relation is shuffled while the changes are small: every exchange is of changes."""
    old = registry.all_rules(spark, SF_SMALL).select("acl_id", "tag_values")
    view = tag_view.build(old, td.schema_tags(spark, SF_SMALL))
    dp = spark.createDataFrame([("k", "o", 1)], "tag_key string, object_name string, d long")
    from grantweave.session import materialize

    plan = tag_view._moved(view.pairs, materialize(dp, "changes"), ["tag_key", "object_name"], "support")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_classes_are_the_views_of_their_readers(spark):
    table = spark.createDataFrame([(i, f"n{i}", float(i), "x") for i in range(7)], "id long, Name string, bal double, seg string")
    state = spark.createDataFrame(
        [("c.s.t", "NAME", ["g1", "g2"], "****"), ("c.s.t", "bal", ["g2", None], "0"), ("c.s.t", "seg", None, None), ("c.s.t", "other", ["g1"], "x"), ("c.s.u", "id", ["g1"], "x")],
        schemas.EXISTING_MASKS,
    )
    users = [(f"u{i}", g) for i in range(40) for g in (f"g{i % 5}", f"g{(i + 1) % 5}")] + [("lone", "none")]
    mem = spark.createDataFrame(users, schemas.MEMBERSHIPS)
    readers = {r.reader: tuple(r.seen) for r in masks.reader_classes(mem, state, "C.S.T", table).collect()}
    assert len(readers) == 41 and set(readers.values()) == {(0,), (1,), (3,)}
    copies = masks.mask_by_class(table, "C.S.T", state, mem)
    assert copies.count() == 3 * 7 and copies.columns == ["seen", *table.columns]
    by_class = {}
    for r in copies.collect():
        by_class.setdefault(tuple(r.seen), set()).add(tuple(r)[1:])
    for u in ("u0", "u1", "u3", "lone"):
        one = masks.mask_by_reader(table, "C.S.T", state, mem, [u]).drop("reader")
        assert by_class[readers[u]] == {tuple(r) for r in one.collect()}


def test_more_masked_columns_than_a_long_has_bits(spark):
    n = masks.BITS + 8
    table = spark.createDataFrame([tuple(f"v{i}" for i in range(n))], ", ".join(f"c{i} string" for i in range(n)))
    state = spark.createDataFrame([("t", f"c{i}", [f"g{i % 3}"], "#") for i in range(n)], schemas.EXISTING_MASKS)
    mem = spark.createDataFrame([("u", "g1"), ("v", "g0"), ("v", "g2"), ("w", "x")], schemas.MEMBERSHIPS)
    readers = {r.reader: tuple(r.seen) for r in masks.reader_classes(mem, state, "t", table).collect()}
    rows = {tuple(r.seen): tuple(r)[1:] for r in masks.mask_by_class(table, "t", state, mem).collect()}
    shown = lambda gs: tuple(f"v{i}" if f"g{i % 3}" in gs else "#" for i in range(n))
    assert {u: rows[k] for u, k in readers.items()} == {"u": shown(["g1"]), "v": shown(["g0", "g2"]), "w": shown([])}
