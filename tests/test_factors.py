"""Statements as factors against statements as text, and what a reference text cannot do."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from grantweave import registry, schemas
from grantweave.operators import factors, ledger, rejects, resolve, statements, tracking
from grantweave.plans.cycle import run_cycle
from grantweave.plans.generate import checked_rules, generate_statements
from grantweave.sources import config
from grantweave.sources import testdata as td
from tests.conftest import SF_SMALL
from tests.test_operators import CATS, PERMS, TS, mapping

FACTORS = "acl_id long, source string, object_type string, object_name string, grant_type string, tag_values string, groups array<string>, privileges array<string>"
TYPES = ["SCHEMA", "TABLE", "MATERIALIZED VIEW", "Täble", "", "ON", "T-X", "`x`"]
NAMES = ["c.s", "c.s.t", "c.s-5", "c.s TO `admin`", "c.s TO", "", "...", "ü.s", "c. s", "c.s FROM `a` TO", "c.s\n", "ON"]
GROUPS = ["g", "g h", "g\nh", "TO", "ON TABLE x TO", "a`b", "é"]
PRIVILEGES = ["SELECT", "USE SCHEMA", "  MODIFY ", "", "A ON B", "X ON T o TO", "X ON T o TO `g", "two\nlines", "ON", "é"]


def random_factors(n=150, seed=5):
    rnd = random.Random(seed)
    some = lambda xs: rnd.sample(xs, rnd.randint(0, min(3, len(xs))))
    return [
        (i, "tag", rnd.choice(TYPES[:2] if i % 2 else TYPES), rnd.choice(NAMES[:2] if i % 3 else NAMES), rnd.choice(["GRANT", "REVOKE"]), None,
         some(GROUPS[:3] if i % 2 else GROUPS), some(PRIVILEGES[:3] if i % 2 else PRIVILEGES))
        for i in range(n)
    ]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(random_factors(), FACTORS)


@pytest.fixture(scope="module")
def known(spark):
    return spark.createDataFrame([("c.s",), ("...",), ("c.s-5",), ("ü.s",)], "object_name string")


def key(x):
    return tuple(map(str, x))


def test_outcomes_are_those_of_the_texts(rows, known):
    """A statement succeeds if and only if its text reads back as its factors and the object is known."""
    got = factors.outcome_rows(factors.outcomes(rows, known))
    read = ledger.parsed(statements.expand(rows)).collect()
    exists = {r.object_name for r in known.collect()}
    want = []
    for r in read:
        back = r.p is not None and (r.p.grant_type, r.p.permissions, r.p.object_type, r.p.object_name, r.p.user_group) == (
            r.grant_type, r.privilege.strip(), r.object_type, r.object_name, r.user_group)
        error = ledger.ERR_UNPARSEABLE if not back else None if r.object_name in exists else ledger.ERR_UNKNOWN_OBJECT
        want.append((r.acl_id, r.access_statement, "failure" if error else "success", error))
    assert sorted(((r.acl_id, r.access_statement, r.status, r.error) for r in got.collect()), key=key) == sorted(want, key=key)
    assert {w[3] for w in want} == {None, ledger.ERR_UNPARSEABLE, ledger.ERR_UNKNOWN_OBJECT}
    lost = factors.unreadable(factors.outcomes(rows, known)).collect()
    assert sorted(r.access_statement for r in lost) == sorted(w[1] for w in want if w[3] == ledger.ERR_UNPARSEABLE)


def test_counts_and_summaries_without_texts(rows, known):
    texts = [(r.grant_type, r.access_statement) for r in statements.expand(rows).collect()]
    c = factors.counts(rows).first()
    # distinct by (grant, type, object, group, privilege); texts of two such can only agree if neither is readable
    said = {(r.grant_type, r.object_type, r.object_name, r.user_group, r.privilege) for r in statements.expand(rows).collect()}
    assert (c.total, c.grants, c.revokes, c.is_empty) == (len(texts), sum(g == "GRANT" for g, _ in texts), sum(g == "REVOKE" for g, _ in texts), False)
    assert c.distinct_statements == len(said)
    for dry in (False, True):
        out = factors.outcomes(rows, known, dry)
        s, want = factors.summary(out).first(), factors.outcome_rows(out).collect()
        assert (s.total, s.success, s.failure) == (len(want), sum(r.status == "success" for r in want), sum(r.status == "failure" for r in want))


def test_empty_counts(spark):
    none = spark.createDataFrame([], FACTORS)
    assert tuple(factors.counts(none).first()) == (0, 0, 0, 0, True)
    assert factors.summary(factors.outcomes(none, spark.createDataFrame([], "object_name string"))).collect() == []


def test_ledger_and_tracking_rows_are_those_of_the_texts(rows, known):
    out = factors.outcomes(rows, known)
    ok = factors.outcome_rows(out).filter("status = 'success'").select("acl_id", "access_statement", "tag_values")
    read = ledger.parsed(ok).select("acl_id", F.col("p.permissions").alias("privilege"), "p.object_type", "p.object_name", "p.user_group", "p.grant_type")
    applied = factors.applied(out)
    assert sorted(map(key, factors.grant_rows(applied).collect())) == sorted(map(key, read.collect()))
    by_group = factors.by_group(applied).select("acl_id", "object_type", "object_name", "user_group")
    assert {key(r) for r in by_group.collect()} == {key(r) for r in read.select("acl_id", "object_type", "object_name", "user_group").collect()}


def test_a_reference_says_no_more_than_a_name(spark):
    """Refs and stored tags that hold a direction and a group grant nothing and are rejects."""
    m = mapping(spark, [
        {"schema_names": "raw.s1 TO `admin` , raw.s2"},
        {"object_type": "TABLE", "table_names": "raw.s.t TO `admin` "},
        {"tag_values": "T"},
        {"object_type": "MATERIALIZED VIEW", "schema_names": "raw.s3"},
    ])
    st = spark.createDataFrame([("dev_main_raw", "s7", "n", "T"), ("dev_main_raw", "s8 TO `admin`", "n", "T"), ("dev-x", "s9", "n", "T")], schemas.SCHEMA_TAGS)
    pm, cm = config.permission_mapping(spark, PERMS), config.catalog_mapping(spark, CATS)
    made = generate_statements(m, st, pm, cm, "dev", "B", "2000-01-01")
    assert {(r.acl_id, r.object_name) for r in made.collect()} == {(1, "dev_main_raw.s2"), (3, "dev_main_raw.s7"), (4, "dev_main_raw.s3")}
    found = rejects.rule_rejects(checked_rules(m, pm, cm and "dev", "B", "2000-01-01"), st, cm, "dev").collect()
    assert sorted((r.acl_id, r.value) for r in found if r.reason == resolve.STATUS_BAD_NAME) == [
        (1, "raw.s1 TO `admin`"), (2, "raw.s.t TO `admin`"), (3, "dev-x.s9"), (3, "dev_main_raw.s8 TO `admin`")]
    known = made.select("object_name").distinct()
    none = spark.createDataFrame([], "privilege string, object_type string, object_name string, user_group string")
    done = run_cycle(m, st, pm, cm, known, none, "dev", "B", "2000-01-01", TS)
    assert {r.user_group for r in done.grants.collect()} == {"g1"}
    assert {r.object_name for r in done.grants.collect()} == {"dev_main_raw.s2", "dev_main_raw.s7"}
    assert {r.acl_id for r in done.mapping.collect() if r.updated_datetime is not None} == {1, 3}
    assert {(r.acl_id, r.error) for r in done.outcomes.filter("error is not null").collect()} == {(4, ledger.ERR_UNPARSEABLE)}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_write_no_texts(spark):
    out = registry.outcomes(spark, SF_SMALL)
    stamp = plan_of(tracking.stamp_exact(td.acl_mapping_rough(spark, SF_SMALL), factors.applied(out)))
    assert "regexp_replace" not in stamp and "explode(privileges" not in stamp and "concat(grant_type" not in stamp
    counts = plan_of(registry.QUERIES["statement_counts"](spark, SF_SMALL))
    assert "explode(privileges" not in counts and "access_statement" not in counts and " ON " not in counts
    summary = plan_of(registry.QUERIES["execution_summary"](spark, SF_SMALL))
    assert "explode(groups" not in summary and "explode(privileges" not in summary


def test_every_sheet_row_is_accounted_for(spark):
    """Rows of a sheet without ids are inserted, match a stored row, or are rejects with their number."""
    sheet = td.incoming_sheet(spark, SF_SMALL).filter(F.col("bu") == td.BU)
    stored = td.acl_mapping(spark, SF_SMALL)
    got = registry._ingest(spark, SF_SMALL, stored)
    new = got.table.count() - stored.count()
    by_reason = {}
    for r in got.rejects.collect():
        by_reason.setdefault(r.reason, []).append(int(r.value) if r.reason.startswith("copies") else 1)
    keys = ["object_type", "user_group", "permission_types", "grant_type", "bu", "tag_values", "schema_names", "table_names"]
    old = {tuple(r) for r in stored.select(*keys, F.col("access_until").cast("string")).collect()}
    readable = sheet.filter("access_until is null or access_until rlike '^[0-9]{4}-[0-9]{2}-[0-9]{2}$'").dropna(subset=keys[:5])
    matched = len({tuple(r) for r in readable.select(*keys, "access_until").collect()} & old)
    assert sum(itertools.chain.from_iterable(by_reason.values())) + new + matched == sheet.count()
    assert any(r.startswith("copies") for r in by_reason) and matched and new
