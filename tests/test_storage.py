"""Ids by distributed numbering, ordered chunks of names, and the expiry calendar."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from grantweave.operators import numbering, tracking
from grantweave.plans.ingest import ingest_sheet
from grantweave.session import scratch_path
from grantweave.sources import calendar, mapping as msrc
from tests.test_operators import TS, mapping, sheets


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_numbers_are_dense_and_unique(spark, parts):
    rows = spark.range(1_003).withColumn("acl_id", F.lit(None).cast("long")).repartition(parts)
    out = numbering.numbered(rows, 5)
    assert sorted(r.acl_id for r in out.collect()) == list(range(5, 1_008)) and out.columns == ["id", "acl_id"]
    assert {r.id for r in out.collect()} == set(range(1_003))
    assert numbering.numbered(rows.limit(0), 1).collect() == []


def ingest(spark, path, rows, bu="B"):
    root = scratch_path(spark, "test_sheets")
    sheets(spark, [{**r, "bu": bu} for r in rows], root)
    return ingest_sheet(spark, root, bu, path, processed=TS)


def ids(table):
    return {(r.bu, r.schema_names): r.acl_id for r in table.collect()}


def test_ids_are_unique_and_stable(spark, monkeypatch):
    """Also where every hash of a key would clash: no id is made from one."""
    path = scratch_path(spark, "test_table")
    first = ids(ingest(spark, path, [{"schema_names": f"raw.s{i}"} for i in range(500)]).table)
    other = ids(ingest(spark, path, [{"schema_names": f"raw.s{i}"} for i in range(500)], "C").table)
    again = ids(ingest(spark, path, [{"schema_names": f"raw.s{i}"} for i in range(250, 700)]).table)
    assert len(first) == 500 and len(other) == 1_000 and len(again) == 1_200
    assert len(set(again.values())) == 1_200 and first.items() <= other.items() <= again.items()
    assert None not in again.values()
    same = ids(ingest(spark, path, [{"schema_names": f"raw.s{i}"} for i in range(700)]).table)
    assert same == again


def test_an_id_is_never_given_twice(spark):
    """Not after its row is gone, and not if a run ended before its mark was stored."""
    path = scratch_path(spark, "test_table")
    first = ids(ingest(spark, path, [{"schema_names": f"raw.s{i}"} for i in range(4)]).table)
    keep = mapping(spark, [{"acl_id": v, "schema_names": k[1]} for k, v in first.items() if k[1] != "raw.s3"][:1])
    msrc.replace_units(keep, path)
    spark.catalog.refreshByPath(path)
    new = ids(ingest(spark, path, [{"schema_names": "raw.new"}]).table)
    assert new["B", "raw.new"] > max(first.values())
    lost = msrc.UnitIds(spark, path, "B")
    lost.mark = 0  # as if no mark had been stored
    stored = msrc.read_table(spark, path).filter("bu = 'B'")
    assert lost.next_id(stored) == new["B", "raw.new"] + 1
    assert msrc.UnitIds(spark, path, "D").unit == lost.unit + 1


def test_sheets_with_their_own_ids_keep_them(spark):
    path, root = scratch_path(spark, "test_table"), scratch_path(spark, "test_sheets")
    sheets(spark, [{"acl_id": 77, "schema_names": "raw.a"}, {"acl_id": None, "schema_names": "raw.b"}], root, with_ids=True)
    got = ids(ingest_sheet(spark, root, "B", path, processed=TS).table)
    assert got["B", "raw.a"] == 77 and got["B", "raw.b"] == (1 << msrc.UnitIds.BITS) + 1


@pytest.mark.parametrize("parts", [1, 9])
def test_chunks_are_the_sorted_list(spark, parts):
    """A third of all names in one group: chunks of the same ranks, whatever the ranges."""
    rows = [("T", "hot" if i % 3 == 0 else f"g{i % 40}", f"n{i:05d}é") for i in range(3_000)]
    names = spark.createDataFrame(rows, "object_type string, user_group string, n string")
    out = numbering.ordered_chunks(names, ["object_type", "user_group"], "n", 70, parts).collect()
    for group in {r.user_group for r in out}:
        own = sorted((r for r in out if r.user_group == group), key=lambda r: r.chunk)
        want = sorted(x[2] for x in rows if x[1] == group)
        assert [r.chunk for r in own] == list(range(-(-len(want) // 70))) and all(r.n <= 70 for r in own)
        whole = ",".join(want)
        assert ",".join(r.names for r in own) == whole
        assert all(whole[r.start : r.start + len(r.names)] == r.names for r in own)
    assert numbering.ordered_chunks(names.limit(0), ["object_type", "user_group"], "n").collect() == []


def test_old_keys_follow_from_chunks(spark):
    rows = [(i, "GRANT", "TABLE" if i % 2 else "SCHEMA", f"a_b_raw.s{i % 30}.t{i % 7}", f"g{i % 3}", "t" if i % 10 == 0 else None) for i in range(400)]
    parsed = spark.createDataFrame(rows, "acl_id long, grant_type string, object_type string, object_name string, user_group string, tag_values string")
    for kind, keys, column in (("SCHEMA", tracking.schema_keys, "schema_names"), ("TABLE", tracking.table_keys, "table_names")):
        old = {r.user_group: r[column] for r in keys(parsed).filter(F.col(column).isNotNull()).collect()}
        chunks = sorted(tracking.name_chunks(parsed, kind, 4).collect(), key=lambda r: r.chunk)
        assert {g: ",".join(r.names for r in chunks if r.user_group == g) for g in {r.user_group for r in chunks}} == old


AS_OF = "2000-03-15"
RULES = [
    {"schema_names": "a", "access_until": dt.date(2000, 3, 14)}, {"schema_names": "b", "access_until": dt.date(2000, 3, 15)},
    {"schema_names": "c", "access_until": dt.date(1999, 12, 31)}, {"schema_names": "d"}, {"schema_names": "e", "access_until": dt.date(2001, 1, 1)},
    {"schema_names": "f", "access_until": dt.date(1999, 12, 1), "grant_type": "REVOKE"}, {"schema_names": "g", "access_until": dt.date(1999, 1, 1), "bu": "O/T %"},
]


def state(spark, path):
    return {r.schema_names: (r.grant_type, r.updated_datetime is not None) for r in calendar.read_calendar(spark, path).collect()}


def folders(spark, path):
    return {r.f for r in calendar.read_calendar(spark, path).select(F.regexp_extract(F.input_file_name(), "(bu=.*)/", 1).alias("f")).distinct().collect()}


def test_calendar_expiry(spark):
    path = scratch_path(spark, "calendar")
    calendar.write_calendar(mapping(spark, RULES), path)
    assert calendar.expire(spark, path, "B", AS_OF, TS) == ["1999-12", "2000-03"]
    want = {"a": ("REVOKE", True), "b": ("GRANT", False), "c": ("REVOKE", True), "d": ("GRANT", False), "e": ("GRANT", False), "f": ("REVOKE", False), "g": ("GRANT", False)}
    assert state(spark, path) == want
    assert not any("grant_type=GRANT/end_month=1999" in f and f.startswith("bu=B") for f in folders(spark, path))
    assert calendar.expire(spark, path, "B", AS_OF, TS) == [] and state(spark, path) == want
    assert calendar.expire(spark, path, "O/T %", AS_OF, TS) == ["1999-01"]
    assert state(spark, path)["g"] == ("REVOKE", True) and calendar.read_calendar(spark, path).count() == len(RULES)
    assert calendar.expire(spark, path, "B", "2000-03-16", TS) == ["2000-03"] and state(spark, path)["b"] == ("REVOKE", True)


def test_a_lost_run_is_repeated(spark, monkeypatch):
    """A run that ends after the revoked rows were written, before the grants were."""
    path = scratch_path(spark, "calendar")
    calendar.write_calendar(mapping(spark, RULES), path)
    real, calls = calendar._replace, []

    def once(rows, p):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        real(rows, p)

    monkeypatch.setattr(calendar, "_replace", once)
    with pytest.raises(RuntimeError):
        calendar.expire(spark, path, "B", AS_OF, TS)
    monkeypatch.setattr(calendar, "_replace", real)
    spark.catalog.refreshByPath(path)
    calendar.expire(spark, path, "B", AS_OF, TS)
    assert calendar.read_calendar(spark, path).count() == len(RULES)
    assert state(spark, path)["a"] == ("REVOKE", True) and state(spark, path)["b"] == ("GRANT", False)


def test_a_daily_run_reads_what_can_expire(spark):
    path = scratch_path(spark, "calendar")
    calendar.write_calendar(mapping(spark, RULES), path)
    found = calendar.expirable(spark, path, "B", AS_OF)
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "bu" in filters and "grant_type" in filters and "end_month" in filters and "2000-03" in filters
    assert sorted(r.schema_names for r in found.collect()) == ["a", "c"]
    assert len(found.inputFiles()) >= 2
    assert calendar.expirable(spark, path, "B").count() >= 3  # by today's date
