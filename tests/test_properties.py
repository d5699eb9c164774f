"""Property tests (few examples each: every example is a Spark job)."""

import string

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from grantweave.functions import parse_statement, render_statement
from grantweave.operators import ledger

WORD = st.text(alphabet=string.ascii_letters + string.digits + "_", min_size=1, max_size=8)
SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(
    grant=st.sampled_from(["GRANT", "REVOKE"]),
    priv=st.sampled_from(["SELECT", "USE SCHEMA", "READ VOLUME", "ALL PRIVILEGES", "MODIFY"]),
    typ=st.sampled_from(["SCHEMA", "TABLE", "VOLUME"]),
    parts=st.lists(WORD, min_size=2, max_size=3),
    group=st.text(alphabet=string.ascii_letters + " _-", min_size=1, max_size=8).filter(lambda g: g.strip() == g),
)
def test_parse_inverts_render(spark, grant, priv, typ, parts, group):
    obj = ".".join(parts)
    row = spark.range(1).select(
        parse_statement(render_statement(F.lit(grant), F.lit(priv), F.lit(typ), F.lit(obj), F.lit(group))).alias("p")
    ).first()["p"]
    assert (row["grant_type"], row["permissions"], row["object_type"], row["object_name"], row["user_group"]) == (
        grant, priv, typ, obj, group)


KEYS = st.tuples(st.sampled_from(["SELECT", "MODIFY"]), st.sampled_from(["a.b", "a.c"]), st.sampled_from(["g1", "g2"]))


@SETTINGS
@given(
    old=st.sets(KEYS, max_size=4),
    stmts=st.lists(st.tuples(KEYS, st.sampled_from(["GRANT", "REVOKE"])), max_size=8),
    cut=st.integers(min_value=0, max_value=8),
)
def test_ledger_fold_splits(spark, old, stmts, cut):
    schema = "privilege string, object_type string, object_name string, user_group string"
    old_df = spark.createDataFrame([(p, "TABLE", o, g) for p, o, g in old], schema)
    rows = [(i, p, "TABLE", o, g, gt) for i, ((p, o, g), gt) in enumerate(stmts)]
    sschema = "acl_id long, " + schema + ", grant_type string"
    all_df = spark.createDataFrame(rows, sschema)
    first = spark.createDataFrame(rows[:cut], sschema)
    rest = spark.createDataFrame(rows[cut:], sschema)
    whole = {tuple(r) for r in ledger.apply_statements(old_df, all_df).collect()}
    split = {tuple(r) for r in ledger.apply_statements(ledger.apply_statements(old_df, first), rest).collect()}
    expect = {(p, "TABLE", o, g) for p, o, g in old}
    for _, p, t, o, g, gt in rows:
        (expect.add if gt == "GRANT" else expect.discard)((p, t, o, g))
    assert whole == split == expect
