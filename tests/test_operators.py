"""Edge cases on tiny literal frames, one per reject reason and decision."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from grantweave import schemas
from grantweave.functions import comma_items, nonblank_items, parse_statement, py_strip, render_tag_statement
from grantweave.operators import ledger, masks, rejects, rules, tags, upsert
from grantweave.plans.generate import checked_rules, generate_statements
from grantweave.sources import config, environment

PERMS = {"dev": {"DATA_READER": ["USE SCHEMA", "SELECT", "READ VOLUME"], "DATA_WRITER": ["USE SCHEMA", "SELECT", "MODIFY"]}}
CATS = {"dev": {"raw": "dev_main_raw", "curated": "dev_main_curated"}}
TS = dt.datetime(2020, 1, 1)


def mapping(spark, rows):
    full = []
    for i, r in enumerate(rows):
        base = dict(acl_id=i + 1, object_type="SCHEMA", user_group="g1", tag_values=None, schema_names=None,
                    table_names=None, permission_types="DATA_READER", grant_type="GRANT", access_until=None, bu="B",
                    processed_datetime=TS, updated_datetime=None)
        base.update(r)
        full.append(tuple(base[f.name] for f in schemas.ACL_MAPPING.fields))
    return spark.createDataFrame(full, schemas.ACL_MAPPING)


def statements_of(spark, rows, tag_rows=()):
    st = spark.createDataFrame(list(tag_rows), schemas.SCHEMA_TAGS)
    return generate_statements(
        mapping(spark, rows), st, config.permission_mapping(spark, PERMS), config.catalog_mapping(spark, CATS),
        "dev", "B", "2000-01-01",
    )


def test_strip_split(spark):
    r = spark.range(1).select(
        py_strip(F.lit("\t a b \n\x0b")).alias("s"),
        comma_items(F.lit(" a , ,b,")).alias("items"),
        nonblank_items(F.lit(" a , ,b,")).alias("groups"),
    ).first()
    assert r["s"] == "a b"
    assert r["items"] == ["a", "", "b", ""]
    assert r["groups"] == ["a", "b"]


@pytest.mark.parametrize(
    "text,expected",
    [
        ("GRANT READ VOLUME ON VOLUME a_b_raw.s.v TO `g h`", ("GRANT", "READ VOLUME", "VOLUME", "a_b_raw.s.v", "g h")),
        ("grant SELECT ON TABLE a.b.c TO `g`", None),
        ("GRANT SELECT ON TABLE a-x.b.c TO `g`", None),
        ("GRANT SELECT ON TABLE a.b.c TO g", None),
        ("  REVOKE SELECT ON TABLE a.b.c FROM `g` trailing", ("REVOKE", "SELECT", "TABLE", "a.b.c", "g")),
    ],
)
def test_parse_edge_cases(spark, text, expected):
    p = spark.range(1).select(parse_statement(F.lit(text), F.lit("t")).alias("p")).first()["p"]
    if expected is None:
        assert p is None
    else:
        assert (p["grant_type"], p["permissions"], p["object_type"], p["object_name"], p["user_group"]) == expected
        assert p["tag_values"] == "t"


def test_expiry_is_strictly_before(spark):
    m = mapping(spark, [
        {"access_until": dt.date(2000, 1, 1)},
        {"access_until": dt.date(1999, 12, 31)},
        {"access_until": None},
        {"grant_type": "REVOKE", "access_until": dt.date(1990, 1, 1)},
        {"bu": "OTHER", "access_until": dt.date(1990, 1, 1)},
    ])
    got = {r["acl_id"]: r["grant_type"] for r in rules.expire(rules.active_grants(m, "B"), "2000-01-01").collect()}
    assert got == {1: "GRANT", 2: "REVOKE", 3: "GRANT"}
    own = {r["acl_id"]: r["grant_type"] for r in upsert.expire_apply(m, "B", "2000-01-01").collect()}
    assert own == {1: "GRANT", 2: "REVOKE", 3: "GRANT", 4: "REVOKE", 5: "GRANT"}


def test_expire_keyed_follows_reference_keys(spark):
    # Same key, other BU: the reference's keys have no bu, so it flips too.
    m = mapping(spark, [
        {"access_until": dt.date(1999, 1, 1), "schema_names": "raw.s1"},
        {"bu": "OTHER", "schema_names": "raw.s1"},
    ])
    got = {r["acl_id"]: r["grant_type"] for r in upsert.expire_apply(m, "B", "2000-01-01", match="key").collect()}
    assert got == {1: "REVOKE", 2: "REVOKE"}


def test_generation_rules(spark):
    rows = [
        # groups: stripped, trailing empty dropped; DATA_READER on TABLE keeps SELECT only
        {"object_type": "TABLE", "user_group": " g1 , g2,", "table_names": "raw.s1.t1, curated.s2.t2,raw.only_two"},
        # VOLUME keeps READ VOLUME only
        {"object_type": "VOLUME", "table_names": "raw.s1.v1"},
        # schema refs: bad shape and unmapped prefix are dropped
        {"schema_names": "raw.s1, bad,nomap.s1"},
        # no privileges for this group: nothing
        {"permission_types": "UNMAPPED", "schema_names": "raw.s1"},
        # tags: stored ' SMALL' (with a space) does not match 'SMALL'
        {"tag_values": "SMALL , Brand#1"},
    ]
    tag_rows = [("dev_main_raw", "s7", "tier", "Brand#1, SMALL"), ("dev_main_raw", "s8", "tier", "x,SMALL")]
    got = sorted(r["access_statement"] for r in statements_of(spark, rows, tag_rows).collect())
    assert got == sorted([
        "GRANT SELECT ON TABLE dev_main_raw.s1.t1 TO `g1`",
        "GRANT SELECT ON TABLE dev_main_raw.s1.t1 TO `g2`",
        "GRANT SELECT ON TABLE dev_main_curated.s2.t2 TO `g1`",
        "GRANT SELECT ON TABLE dev_main_curated.s2.t2 TO `g2`",
        "GRANT READ VOLUME ON VOLUME dev_main_raw.s1.v1 TO `g1`",
        "GRANT USE SCHEMA ON SCHEMA dev_main_raw.s1 TO `g1`",
        "GRANT SELECT ON SCHEMA dev_main_raw.s1 TO `g1`",
        "GRANT READ VOLUME ON SCHEMA dev_main_raw.s1 TO `g1`",
        "GRANT USE SCHEMA ON SCHEMA dev_main_raw.s7 TO `g1`",
        "GRANT SELECT ON SCHEMA dev_main_raw.s7 TO `g1`",
        "GRANT READ VOLUME ON SCHEMA dev_main_raw.s7 TO `g1`",
        "GRANT USE SCHEMA ON SCHEMA dev_main_raw.s8 TO `g1`",
        "GRANT SELECT ON SCHEMA dev_main_raw.s8 TO `g1`",
        "GRANT READ VOLUME ON SCHEMA dev_main_raw.s8 TO `g1`",
    ])


def test_rejects_reasons(spark):
    m = mapping(spark, [
        {"permission_types": "UNMAPPED"},
        {"schema_names": "bad,nomap.s1"},
        {"object_type": "TABLE", "tag_values": "a"},
        {"user_group": None},
    ])
    pm, cm = config.permission_mapping(spark, PERMS), config.catalog_mapping(spark, CATS)
    r = checked_rules(m, pm, "dev", "B", "2000-01-01")
    none = spark.createDataFrame([], schemas.SCHEMA_TAGS)
    got = sorted((x["acl_id"], x["reason"]) for x in rejects.rule_rejects(r, none, cm, "dev").collect())
    assert got == [
        (1, rejects.REASON_NO_PRIVILEGES),
        (2, "prefix not mapped"),
        (2, "schema ref not 2 parts"),
        (3, rejects.REASON_TYPE_MISMATCH),
        (4, rejects.REASON_NULL),
    ]


def test_empty_input(spark):
    assert statements_of(spark, []).count() == 0


def test_upsert_idempotent_and_rejects(spark):
    t = mapping(spark, [{"schema_names": "raw.s1"}])
    inc = mapping(spark, [
        {"schema_names": "raw.s1"},                      # matched: no change
        {"schema_names": "raw.s2"},                      # new
        {"schema_names": "raw.s2"},                      # duplicate key in the sheet
        {"schema_names": "raw.s3", "user_group": None},  # null '=' key
    ]).withColumn("acl_id", F.col("acl_id") + 10)
    once = upsert.upsert(t, inc)
    assert sorted(r["acl_id"] for r in once.collect()) == [1, 12]
    assert upsert.upsert(once, inc).count() == once.count()
    rej = sorted((r["acl_id"], r["reason"]) for r in upsert.upsert_rejects(inc).collect())
    assert rej == [(13, "duplicate key in sheet"), (14, "null in merge key")]


def test_env_resolve(spark):
    urls = spark.createDataFrame(
        [(1, "https://adb-100.3.x.net"), (2, "https://nohost.x"), (3, "https://adb-103.x"), (4, "https://adb-1-adb-2.x")],
        "id long, url string",
    )
    em = config.env_map(spark, {"100": "dev", "1-": "odd"})
    got = {r["id"]: (r["workspace_id"], r["env"], r["status"]) for r in environment.resolve_env(urls, em).collect()}
    assert got == {
        1: ("100", "dev", "ok"),
        2: (None, None, environment.STATUS_NO_ID),
        3: ("103", None, environment.STATUS_UNMAPPED),
        4: ("1-", "odd", "ok"),
    }


def test_tag_statements_and_state(spark):
    tr = config.tag_rules(
        spark,
        [{"action": "set", "schemas": "xxx_main_raw.s1", "tags": {"k'": "v'a"}},
         {"action": "drop", "schemas": ["xxx_main_raw.s1"], "tags": {"k": "v"}},
         {"action": "UNSET", "schemas": ["xxx_main_raw.s2"], "tags": {"old": "ignored"}}],
        [{"action": "Set", "schemas": ["xxx_main_raw.s1"], "tables": ["t1", "t2"], "tags": {"a": "b"}},
         {"action": "SET", "schemas": "xxx_main_raw.s1", "tables": "t3", "tags": "not a map"}],
    )
    tg = tags.targets(tr, "dev")
    st = {(r["target"], r["statement"]) for r in tags.statements(tg).collect()}
    assert ("dev_main_raw.s1", "ALTER SCHEMA dev_main_raw.s1 SET TAGS ('k''' = 'v''a')") in st
    assert ("dev_main_raw.s2", "ALTER SCHEMA dev_main_raw.s2 UNSET TAGS ('old')") in st
    assert ("dev_main_raw.s1.t2", "ALTER TABLE dev_main_raw.s1.t2 SET TAGS ('a' = 'b')") in st
    assert len(st) == 4
    rej = sorted((r["target"], r["reason"]) for r in tags.rejects(tr, "dev").collect())
    assert rej == [("dev_main_raw.s1", tags.REASON_ACTION), ("dev_main_raw.s1.t3", tags.REASON_TAGS)]
    old = spark.createDataFrame([("SCHEMA", "dev_main_raw.s2", "old", "x"), ("SCHEMA", "dev_main_raw.s9", "z", "y")],
                                schemas.OBJECT_TAGS)
    new = {(r["target"], r["tag_name"], r["tag_value"]) for r in tags.apply_rules(old, tr, "dev").collect()}
    assert new == {("dev_main_raw.s1", "k'", "v'a"), ("dev_main_raw.s9", "z", "y"),
                   ("dev_main_raw.s1.t1", "a", "b"), ("dev_main_raw.s1.t2", "a", "b")}


FULL = "dev_main_raw.crm.customer"


def test_mask_plan_order_and_projection(spark):
    mr = config.mask_rules(spark, [
        {"table_name": "raw.crm.customer", "column_name": "c_name", "user_group": "grp_1, grp_2"},
        {"table_name": "raw.customer", "column_name": "c_name", "user_group": []},
        {"table_name": "raw.crm.customer", "column_name": "c-x", "user_group": ["g"], "drop_existing": True},
        {"table_name": "raw.crm.supplier", "column_name": "s_name", "user_group": ["g"]},
    ])
    existing = spark.createDataFrame([("DEV_MAIN_RAW.crm.supplier", "S_NAME", ["x"], "#")], schemas.EXISTING_MASKS)
    cm = config.catalog_mapping(spark, CATS)
    got = {r["rule_id"]: (r["action"], r["reason"], r["function_name"]) for r in masks.plan(mr, cm, "dev", existing).collect()}
    assert got == {
        0: ("CREATE", None, "customer_c_name_mask"),
        1: ("REJECT", "mask ref not 3 parts", None),
        2: ("DROP", None, "customer_c_x_mask"),
        3: ("SKIP", masks.REASON_EXISTS, "supplier_s_name_mask"),
    }
    state = masks.state(mr, cm, "dev", existing)
    cust = spark.createDataFrame([(1, "Alice"), (2, "Bob")], "c_custkey long, c_name string")
    seen = masks.mask_columns(cust, FULL, state, ["grp_2"])
    assert sorted(r["c_name"] for r in seen.collect()) == ["Alice", "Bob"]
    hidden = masks.mask_columns(cust, FULL, state, ["grp_9"])
    assert sorted(r["c_name"] for r in hidden.collect()) == ["****", "****"]
    mem = spark.createDataFrame([("u1", "grp_1"), ("u2", "grp_5")], schemas.MEMBERSHIPS)
    by = masks.mask_by_reader(cust, FULL, state, mem, ["u1", "u2"])
    assert sorted((r["reader"], r["c_name"]) for r in by.collect()) == [
        ("u1", "Alice"), ("u1", "Bob"), ("u2", "****"), ("u2", "****")]


@pytest.mark.parametrize(
    "steps,in_force,actions",
    [
        ("c1 c2", "1", ["CREATE", "SKIP"]),
        ("c1 d2", None, ["CREATE", "DROP"]),
        ("c1 d2 c3", "3", ["CREATE", "DROP", "CREATE"]),
        ("d1 c2 c3 d4 c5 c6", "5", ["DROP", "CREATE", "SKIP", "DROP", "CREATE", "SKIP"]),
        ("old c1", "old", ["SKIP"]),
        ("old d1", None, ["DROP"]),
        ("old d1 c2", "2", ["DROP", "CREATE"]),
        ("old", "old", []),
    ],
)
def test_mask_rules_apply_in_order(spark, steps, in_force, actions):
    """Case of table and column names never matters; a mask in force is never shown raw."""
    steps = steps.split()
    existing = spark.createDataFrame([("dev_main_raw.CRM.customer", "c_Name", ["g"], "old")] if "old" in steps else [], schemas.EXISTING_MASKS)
    rules_ = [
        {"rule_id": int(x[1:]), "table_name": "raw.crm.customer", "column_name": "C_NAME" if i % 2 else "c_name", "user_group": ["g"],
         "type_of_masking": x[1:], "drop_existing": x[0] == "d"}
        for i, x in enumerate(s for s in steps if s != "old")
    ]
    mr = config.mask_rules(spark, rules_)
    cm = config.catalog_mapping(spark, CATS)
    assert [r["action"] for r in masks.plan(mr, cm, "dev", existing).orderBy("rule_id").collect()] == actions
    state = masks.state(mr, cm, "dev", existing)
    assert [r["type_of_masking"] for r in state.collect()] == ([in_force] if in_force else [])
    cust = spark.createDataFrame([(1, "Alice")], "c_custkey long, c_name string")
    assert masks.mask_columns(cust, FULL.upper(), state, ["other"]).first()["c_name"] == (in_force or "Alice")


def test_masks_fail_closed(spark):
    """A mask whose groups or constant are not known hides the value from everyone."""
    state = spark.createDataFrame([(FULL, "c_name", None, None)], schemas.EXISTING_MASKS).withColumn("rule_id", F.lit(1))
    cust = spark.createDataFrame([(1, "Alice")], "c_custkey long, c_name string")
    assert masks.mask_columns(cust, FULL, state, ["g"]).first()["c_name"] == "****"
    odd = spark.createDataFrame([(FULL, "nope", ["g"], "x")], schemas.EXISTING_MASKS).withColumn("rule_id", F.lit(7))
    assert [tuple(r) for r in masks.unknown_columns(odd, FULL, cust).collect()] == [(7, "nope", masks.REASON_UNKNOWN_COLUMN)]


def test_mask_of_a_long_rule_history(spark):
    """Any number of rules on one column."""
    mr = spark.range(25_000).selectExpr("id rule_id", "'raw.crm.customer' table_name", "'c_name' column_name", "array('g') user_group",
                                        "cast(id as string) type_of_masking", "id % 1000 = 999 and id < 24000 drop_existing")
    state = masks.state(mr, config.catalog_mapping(spark, CATS), "dev", spark.createDataFrame([], schemas.EXISTING_MASKS)).collect()
    assert [r["type_of_masking"] for r in state] == ["24000"]


def test_outcomes_and_summary(spark):
    st = spark.createDataFrame(
        [(1, "GRANT SELECT ON TABLE c.s.t TO `g`", None), (2, "GRANT SELECT ON TABLE c.s.u TO `g`", None),
         (3, "garbage", None)],
        "acl_id long, access_statement string, tag_values string",
    )
    known = spark.createDataFrame([("c.s.t",)], "object_name string")
    out = {r["acl_id"]: (r["status"], r["error"]) for r in ledger.outcomes(st, known).collect()}
    assert out == {1: ("success", None), 2: ("failure", ledger.ERR_UNKNOWN_OBJECT), 3: ("failure", ledger.ERR_UNPARSEABLE)}
    dry = ledger.summary(ledger.outcomes(st, known, dry_run=True)).first()
    assert (dry["total"], dry["success"], dry["failure"]) == (3, 3, 0)


def sheets(spark, rows, root, with_ids=False):
    from grantweave.sources import mapping as msrc

    text = mapping(spark, rows).drop("processed_datetime", "updated_datetime")
    text = text.withColumn("access_until", F.coalesce(F.get_json_object("schema_names", "$.until"), F.date_format("access_until", "yyyy-MM-dd")))
    msrc.write_sheets(text if with_ids else text.drop("acl_id"), root)


def test_ingest_creates_then_merges(spark):
    from grantweave.plans.ingest import ingest_sheet
    from grantweave.session import scratch_path

    path = scratch_path(spark, "test_table")
    first_root, second_root, other_root = (scratch_path(spark, "test_sheets") for _ in range(3))
    sheets(spark, [{"schema_names": "raw.s1"}, {"schema_names": "raw.s2", "access_until": dt.date(2001, 2, 3)},
                   {"schema_names": "raw.s2", "access_until": dt.date(2001, 2, 3)}, {"user_group": None}], first_root)
    first = ingest_sheet(spark, first_root, "B", path, processed=TS)
    rows = first.table.collect()
    assert first.created and {(r["schema_names"], r["access_until"]) for r in rows} == {("raw.s1", None), ("raw.s2", dt.date(2001, 2, 3))}
    assert len({r["acl_id"] for r in rows}) == 2 and None not in {r["acl_id"] for r in rows}
    assert sorted(r["reason"] for r in first.rejects.collect()) == [upsert.REASON_COPIES, "null in merge key"]
    # another unit's equal rows get ids of their own, and its ingest leaves this unit's folder alone
    sheets(spark, [{"schema_names": "raw.s1", "bu": "C"}], other_root)
    other = ingest_sheet(spark, other_root, "C", path, processed=TS)
    assert not other.created and len({r["acl_id"] for r in other.table.collect()}) == 3
    sheets(spark, [{"schema_names": "raw.s1"}, {"schema_names": "raw.s9"}], second_root)
    ingest_sheet(spark, second_root, "B", path, processed=TS)
    again = ingest_sheet(spark, second_root, "B", path, processed=TS)
    assert sorted((r["bu"], r["schema_names"]) for r in again.table.collect()) == [
        ("B", "raw.s1"), ("B", "raw.s2"), ("B", "raw.s9"), ("C", "raw.s1")]


def test_ingest_counts_copies_of_a_key(spark):
    """Copies in a sheet without ids share the kept row's id; each is accounted for."""
    from grantweave.plans.ingest import ingest_sheet
    from grantweave.session import scratch_path

    path, root = scratch_path(spark, "test_table"), scratch_path(spark, "test_sheets")
    rows = [{"schema_names": "raw.hot"}] * 50 + [{"schema_names": f"raw.s{i}"} for i in range(100)] + [{"schema_names": "raw.s7"}, {"user_group": None}]
    sheets(spark, rows, root)
    for created in (True, False):  # a first load and a merge report alike
        got = ingest_sheet(spark, root, "B", path, processed=TS)
        names = {r["acl_id"]: r["schema_names"] for r in got.table.collect()}
        counted = {names[r["acl_id"]]: (r["value"], r["reason"]) for r in got.duplicates.collect()}
        assert got.created == created and len(names) == 101
        assert counted == {"raw.hot": ("49", upsert.REASON_COPIES), "raw.s7": ("1", upsert.REASON_COPIES)}
        refused = [int(r["value"]) if r["reason"] == upsert.REASON_COPIES else 1 for r in got.rejects.collect()]
        assert len(names) + sum(refused) == len(rows)


def test_copies_are_listed_or_counted_once(spark):
    inc = mapping(spark, [{"schema_names": "raw.a"}] * 4 + [{"schema_names": "raw.b"}] * 2)
    inc = inc.withColumn("acl_id", F.expr("CASE acl_id WHEN 1 THEN 10 WHEN 2 THEN 10 WHEN 3 THEN 11 END"))  # 10, 10, 11, none; none, none
    assert [(r["acl_id"], r["value"]) for r in upsert.upsert_rejects(inc).collect() if r["reason"] != upsert.REASON_COPIES] == [(11, "10")]
    assert sorted(((r["acl_id"], r["value"]) for r in upsert.uncounted_duplicates(inc).collect()), key=str) == [(10, "2"), (None, "1")]


def test_unreadable_ends_and_lines_stay_out(spark, tmp_path):
    from grantweave.sources import mapping as msrc

    head = "object_type,user_group,tag_values,schema_names,table_names,permission_types,grant_type,access_until"
    lines = ["SCHEMA,g1,,raw.s1,,DATA_READER,GRANT,2020-01-02", "SCHEMA,g1,,raw.s2,,DATA_READER,GRANT,31/12/1999",
             "SCHEMA,g1,,raw.s3,,DATA_READER,GRANT,1999", "SCHEMA,g1,,raw.s4,,DATA_READER,GRANT,2020-13-45", "SCHEMA,g1",
             "SCHEMA,g1,,raw.s5,,DATA_READER,GRANT,"]
    folder = tmp_path / "bu=B"
    folder.mkdir()
    (folder / "sheet.csv").write_text("\n".join([head, *lines]) + "\n")
    sheet = msrc.read_sheet(spark, str(folder))
    kept = msrc.stamp(sheet, "B", TS).collect()
    assert sorted(r["schema_names"] for r in kept) == ["raw.s1", "raw.s5"]
    assert sorted((r["value"], r["reason"]) for r in msrc.sheet_rejects(sheet).collect()) == sorted(
        [("31/12/1999", msrc.REASON_DATE), ("1999", msrc.REASON_DATE), ("2020-13-45", msrc.REASON_DATE), ("SCHEMA,g1", msrc.REASON_MALFORMED)])


def test_rules_without_mandatory_columns_make_nothing(spark):
    rows = [{"object_type": None, "schema_names": "raw.s1"}, {"permission_types": None, "schema_names": "raw.s1"},
            {"user_group": "ok, ba`d", "schema_names": "raw.s1"}]
    got = statements_of(spark, rows).collect()
    assert {r["access_statement"] for r in got} == {f"GRANT {p} ON SCHEMA dev_main_raw.s1 TO `ok`" for p in PERMS["dev"]["DATA_READER"]}
    pm, cm = config.permission_mapping(spark, PERMS), config.catalog_mapping(spark, CATS)
    reasons = rejects.rule_rejects(checked_rules(mapping(spark, rows), pm, "dev", "B"), spark.createDataFrame([], schemas.SCHEMA_TAGS), cm, "dev").collect()
    assert sorted((r["acl_id"], r["value"]) for r in reasons) == [(1, "object_type"), (2, "permission_types"), (3, "ba`d")]


def test_keyed_expiry_never_grants(spark):
    """An expired and a live grant on one key: the key is revoked, and no revoke is undone."""
    m = mapping(spark, [
        {"access_until": dt.date(1999, 1, 1), "schema_names": "raw.s1"},
        {"access_until": dt.date(2999, 1, 1), "schema_names": "raw.s1"},
        {"bu": "OTHER", "schema_names": "raw.s1", "grant_type": "REVOKE"},
    ])
    got = {r["acl_id"]: r["grant_type"] for r in upsert.expire_apply(m, "B", "2000-01-01", match="key").collect()}
    assert got == {1: "REVOKE", 2: "REVOKE", 3: "REVOKE"}


def test_rule_files(spark, tmp_path):
    import json

    (tmp_path / "m.json").write_text("\n".join(json.dumps(x) for x in [
        {"rule_id": 1, "table_name": "raw.a.b", "column_name": "c", "user_group": "g1, g2"},
        {"rule_id": 2, "table_name": "raw.a.b", "column_name": "d", "user_group": ["g3"], "type_of_masking": "#", "drop_existing": True},
        {"rule_id": 3, "table_name": "raw.a.b", "column_name": "e"}]))
    got = {r["rule_id"]: (r["user_group"], r["type_of_masking"], r["drop_existing"]) for r in config.read_rules(spark, str(tmp_path / "m.json"), "mask").collect()}
    assert got == {1: (["g1", "g2"], "****", False), 2: (["g3"], "#", True), 3: (None, "****", False)}
    (tmp_path / "t.json").write_text("\n".join(json.dumps(x) for x in [
        {"rule_ord": 1, "level": "SCHEMA", "action": "set", "schemas": "a", "tags": {"k": None, "l": "v"}},
        {"rule_ord": 2, "level": "TABLE", "action": "set", "schemas": ["a", "b"], "tables": "t", "tags": "no map"}]))
    got = {r["rule_ord"]: (r["schemas"], r["tables"], r["tags"]) for r in config.read_rules(spark, str(tmp_path / "t.json"), "tag").collect()}
    assert got == {1: (["a"], None, {"k": None, "l": "v"}), 2: (["a", "b"], ["t"], None)}
    text = tags.statements(tags.targets(config.read_rules(spark, str(tmp_path / "t.json"), "tag"), "dev")).first()["statement"]
    assert text == "ALTER SCHEMA a SET TAGS ('k' = 'None', 'l' = 'v')"


def test_tracking_digests_compare_name_sets(spark):
    from grantweave.operators import tracking

    parsed = spark.createDataFrame(
        [(1, "GRANT", "SELECT", "TABLE", f"a_b_raw.s.{t}", "g", None) for t in ("t1", "t2")] + [(2, "GRANT", "SELECT", "TABLE", "a_b_raw.s.t1", "h", None)],
        "acl_id long, grant_type string, permissions string, object_type string, object_name string, user_group string, tag_values string",
    )
    m = mapping(spark, [
        {"object_type": "TABLE", "user_group": "g", "table_names": "raw.s.t2, raw.s.t1,raw.s.t1"},
        {"object_type": "TABLE", "user_group": "g", "table_names": "raw.s.t1"},
        {"object_type": "TABLE", "user_group": "h", "table_names": "raw.s.t1"},
        {"object_type": "TABLE", "user_group": "h"},
    ])
    got = {r["acl_id"]: r["updated_datetime"] is not None for r in tracking.stamp_table_rows(m, parsed, TS).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False}


def test_ledger_last_statement_wins(spark):
    cols = "acl_id long, privilege string, object_type string, object_name string, user_group string, grant_type string"
    s = spark.createDataFrame(
        [
            (1, "SELECT", "SCHEMA", "c.a", "g", "GRANT"),
            (2, "SELECT", "SCHEMA", "c.a", "g", "REVOKE"),  # later rule revokes
            (3, "SELECT", "SCHEMA", "c.b", "g", "REVOKE"),
            (4, "SELECT", "SCHEMA", "c.b", "g", "GRANT"),  # later rule grants
            (None, "SELECT", "SCHEMA", "c.c", "g", "REVOKE"),  # no id: orders first
            (5, "SELECT", "SCHEMA", "c.c", "g", "GRANT"),
            (None, "SELECT", "SCHEMA", "c.d", "g", "REVOKE"),  # untouched old grant c.e stays
        ],
        cols,
    )
    old = spark.createDataFrame(
        [("SELECT", "SCHEMA", "c.a", "g"), ("SELECT", "SCHEMA", "c.d", "g"), ("SELECT", "SCHEMA", "c.e", "g")],
        "privilege string, object_type string, object_name string, user_group string",
    )
    got = {r["object_name"] for r in ledger.apply_statements(old, s).collect()}
    assert got == {"c.b", "c.c", "c.e"}


def test_ledger_takes_any_id(spark):
    top = (1 << 63) - 1
    cols = "acl_id long, privilege string, object_type string, object_name string, user_group string, grant_type string"
    rows = [(top - 1, "a", "REVOKE"), (top, "a", "GRANT"), (-top - 1, "b", "GRANT"), (-top, "b", "REVOKE"), (1 << 62, "c", "GRANT"),
            (1 << 61, "c", "REVOKE"), (5, "d", "GRANT"), (5, "d", "REVOKE"), (None, "e", "GRANT"), (None, "e", "REVOKE"),
            (None, "f", "GRANT"), (-top - 1, "f", "REVOKE")]
    s = spark.createDataFrame([(i, "P", "T", o, "g", t) for i, o, t in rows], cols)
    old = spark.createDataFrame([("P", "T", "z", "g")], cols.replace("acl_id long, ", "").replace(", grant_type string", ""))
    assert {r["object_name"] for r in ledger.apply_statements(old, s).collect()} == {"a", "c", "d", "e", "z"}


def test_default_clock(spark):
    """Without a date or stamp, today and now decide."""
    m = mapping(spark, [{"access_until": dt.date(2000, 1, 1)}, {"access_until": dt.date.today() + dt.timedelta(days=2)}, {"access_until": None}])
    flipped = {r["acl_id"]: (r["grant_type"], r["updated_datetime"]) for r in rules.expire(rules.active_grants(m, "B")).collect()}
    assert [flipped[i][0] for i in (1, 2, 3)] == ["REVOKE", "GRANT", "GRANT"]
    assert all(abs(t - dt.datetime.now()) < dt.timedelta(days=1, minutes=5) for _, t in flipped.values())
    own = {r["acl_id"]: (r["grant_type"], r["updated_datetime"] is not None) for r in upsert.expire_apply(m, "B").collect()}
    assert own == {1: ("REVOKE", True), 2: ("GRANT", False), 3: ("GRANT", False)}
