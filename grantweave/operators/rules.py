"""Active rules, expiry and normalisation of the ACL mapping."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantweave.functions import broadcast_if_literal, comma_items, fits_group, nonblank_items, present, py_strip

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for identical results).
GRANT = "GRANT"
REVOKE = "REVOKE"
READER_GROUP = "DATA_READER"
# For DATA_READER rules the privilege list is narrowed by object type:
READER_NARROWING = {"TABLE": "SELECT", "VOLUME": "READ VOLUME"}
# Columns a rule cannot do without:
MANDATORY = ["object_type", "user_group", "permission_types", "grant_type"]
# ---------------------------------------------------------------------------


def as_of_date(as_of: _dt.date | str | None) -> Column:
    return F.current_date() if as_of is None else F.lit(str(as_of)).cast("date")


def stamp_ts(stamp: _dt.datetime | str | None) -> Column:
    return F.current_timestamp() if stamp is None else F.lit(str(stamp)).cast("timestamp")


def active_grants(mapping: DataFrame, bu: str) -> DataFrame:
    """Rows of one business unit that are still GRANT (exact, case-sensitive)."""
    return mapping.filter((F.col("bu") == F.lit(bu)) & (F.col("grant_type") == F.lit(GRANT)))


def complete(mapping: DataFrame) -> DataFrame:
    """Rows that have every mandatory column."""
    return mapping.dropna(subset=MANDATORY)


def first_missing() -> Column:
    """The first mandatory column that is null; null if none is."""
    return F.coalesce(*[F.when(F.col(c).isNull(), F.lit(c)) for c in MANDATORY])


def expired(as_of: _dt.date | str | None = None) -> Column:
    """An entry is still valid on its last day: expired means strictly before."""
    return F.col("access_until").isNotNull() & (F.col("access_until") < as_of_date(as_of))


def expire(active: DataFrame, as_of=None, stamp=None) -> DataFrame:
    """Flip expired GRANT rows to REVOKE and stamp updated_datetime."""
    return active.withColumns(
        {
            "grant_type": F.when(expired(as_of), F.lit(REVOKE)).otherwise(F.col("grant_type")),
            "updated_datetime": stamp_ts(stamp),
        }
    )


def normalize(rules: DataFrame) -> DataFrame:
    """Parse the comma lists of each rule row into arrays.

    groups: stripped, empties and names with a backtick (which would end the
    quoted name in a statement) dropped; tags/schema/table refs: stripped,
    empties kept (they fail later as refs or match empty tag items).  ``missing``
    names the first mandatory column that is null and ``bad_groups`` lists the
    dropped names; both are for the rejects.  ``tag_values`` becomes the stripped tags re-joined with ',' (null when the
    row has none); it is also the tag-resolution key.
    """
    tags = F.when(present("tag_values"), comma_items("tag_values"))
    groups = nonblank_items("user_group")
    return rules.select(
        "acl_id",
        py_strip("grant_type").alias("grant_type"),
        py_strip("object_type").alias("object_type"),
        py_strip("permission_types").alias("permission_group"),
        F.filter(groups, fits_group).alias("groups"),
        F.filter(groups, lambda g: ~fits_group(g)).alias("bad_groups"),
        first_missing().alias("missing"),
        tags.alias("tags"),
        F.array_join(tags, ",").alias("tag_values"),
        F.when(present("schema_names"), comma_items("schema_names")).alias("schema_refs"),
        F.when(present("table_names"), comma_items("table_names")).alias("table_refs"),
    )


def _narrowed(privileges: Column, group: Column, object_type: Column) -> Column:
    is_reader = group == F.lit(READER_GROUP)

    def keep(p: Column) -> Column:
        cond = None
        for typ, only in READER_NARROWING.items():
            hit = is_reader & (object_type == F.lit(typ))
            cond = F.when(hit, p == F.lit(only)) if cond is None else cond.when(hit, p == F.lit(only))
        return cond.otherwise(F.lit(True))

    return F.filter(privileges, keep)


def with_privileges(rules: DataFrame, permission_mapping: DataFrame, env: str) -> DataFrame:
    """Attach the privileges of (env, permission group), narrowed by type.

    A missing env or group gives an empty list (such rows make no statements
    and are reported by :func:`grantweave.operators.rejects.rule_rejects`).
    """
    dim = permission_mapping.filter(F.col("env") == F.lit(env)).select("permission_group", "privileges")
    joined = rules.join(broadcast_if_literal(dim, made_from=permission_mapping), "permission_group", "left")
    privs = F.coalesce(F.col("privileges"), F.array().cast("array<string>"))
    return joined.withColumn("privileges", _narrowed(privs, F.col("permission_group"), F.col("object_type")))
