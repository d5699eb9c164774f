"""Rejected input as a relation: (stage, acl_id, value, reason)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantweave.operators import ledger, masks, resolve
from grantweave.sources import environment

REASON_NULL = "null in mandatory column"
REASON_NO_PRIVILEGES = "no privileges for (env, group, type)"
REASON_TYPE_MISMATCH = "type_mismatch"
REASON_BACKTICK = "backtick in group name"


def _reject(df: DataFrame, stage: str, value, reason) -> DataFrame:
    return df.select(
        F.lit(stage).alias("stage"),
        F.col("acl_id").cast("long").alias("acl_id"),
        value.cast("string").alias("value"),
        (reason if not isinstance(reason, str) else F.lit(reason)).alias("reason"),
    )


def no_privileges(rule_rows: DataFrame) -> DataFrame:
    """Rules whose (env, group, type) maps to no privilege: they make nothing."""
    value = F.concat_ws("/", "permission_group", "object_type")
    return _reject(rule_rows.filter(F.size("privileges") == 0), "privileges", value, REASON_NO_PRIVILEGES)


_FOUND_T = "array<struct<stage:string,value:string,reason:string,source:string,ref:string,want:int>>"


def _found(stage: str, value, reason: str | None, source=None, want=None):
    """What is wrong with a rule; of a ref the reason is not known yet."""
    ref = F.lit(None).cast("string") if source is None else value
    parts = [F.lit(stage), value.cast("string"), F.lit(reason).cast("string"), F.lit(None).cast("string") if source is None else source, ref, F.lit(None).cast("int") if want is None else want]
    return F.struct(*[p.alias(n) for p, n in zip(parts, ("stage", "value", "reason", "source", "ref", "want"))])


def rule_rejects(rule_rows: DataFrame, schema_tags: DataFrame, catalog_mapping: DataFrame, env: str) -> DataFrame:
    """All rejects of one generation run, from the checked rules (``plans.generate.checked_rules``).

    What is wrong with a rule, or may be with its refs, is gathered as a list
    beside it, so that its own rejects take one pass: a null mandatory column
    alone, else groups that no statement can quote, no privileges, refs that do
    not resolve, and the advice on tags that resolve to schemas on other types
    (kept as coded).  Refs and advice are only reported for rules that reach
    object resolution.  Tagged objects whose name no statement can hold come
    through the tag join.
    """
    none = F.array().cast(_FOUND_T)
    whole = F.col("missing").isNull()
    makes = whole & (F.size("privileges") > 0)
    mismatch = makes & F.col("tags").isNotNull() & (F.col("object_type") != "SCHEMA")
    found = F.concat(
        F.when(~whole, F.array(_found("validate", F.col("missing"), REASON_NULL))).otherwise(none),
        F.when(whole, F.transform("bad_groups", lambda g: _found("validate", g, REASON_BACKTICK))).otherwise(none),
        F.when(whole & ~makes, F.array(_found("privileges", F.concat_ws("/", "permission_group", "object_type"), REASON_NO_PRIVILEGES))).otherwise(none),
        F.when(makes, F.transform(resolve.all_refs(), lambda x: _found("resolve", x["ref"], None, x["source"], x["want"]))).otherwise(none),
        F.when(mismatch, F.array(_found("advice", F.col("object_type"), REASON_TYPE_MISMATCH))).otherwise(none),
    )
    own = resolve.with_status(rule_rows.select("acl_id", F.inline(found)), catalog_mapping, env)
    own = own.withColumn("reason", F.coalesce("reason", "status")).filter(F.col("reason") != resolve.STATUS_OK)
    tagged = resolve.resolve_tags(rule_rows.filter(makes), schema_tags, fits=False)
    return own.select("stage", "acl_id", "value", "reason").unionByName(_reject(tagged, "resolve", F.col("object_name"), resolve.STATUS_BAD_NAME))


def mask_rejects(mask_plan: DataFrame) -> DataFrame:
    """Mask rules with a bad ref, an unmapped prefix, no column or no group."""
    rows = mask_plan.filter(F.col("action") == masks.ACTION_REJECT).withColumn("acl_id", F.lit(None).cast("long"))
    return _reject(rows, "mask", F.concat_ws(":", "rule_id", "table_name"), F.col("reason"))


def unparseable(outcome_rows: DataFrame) -> DataFrame:
    """Statements whose text the executor could not read (of ``factors.unreadable`` or ``ledger.outcomes``)."""
    rows = outcome_rows.filter(F.col("error") == ledger.ERR_UNPARSEABLE)
    return _reject(rows, "execute", F.col("access_statement"), F.col("error"))


def tag_rejects(tag_reject_rows: DataFrame) -> DataFrame:
    """Tag rules that do nothing, in whole or for one target."""
    rows = tag_reject_rows.withColumn("acl_id", F.lit(None).cast("long"))
    return _reject(rows, "tag", F.concat_ws(":", "rule_ord", "target"), F.col("reason"))


def environment_rejects(resolved_urls: DataFrame, url: str = "url") -> DataFrame:
    """URLs without a workspace id or with one that no environment has."""
    rows = resolved_urls.filter(F.col("status") != environment.STATUS_OK).withColumn("acl_id", F.lit(None).cast("long"))
    return _reject(rows, "environment", F.col(url), F.col("status"))


def all_rejects(*relations: DataFrame) -> DataFrame:
    """One relation of (stage, acl_id, value, reason) for every stage."""
    return reduce(DataFrame.unionByName, relations)
