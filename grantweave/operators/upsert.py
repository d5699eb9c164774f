"""Keyed state changes on the mapping table (mapping upsert, expiry write-back).

No MERGE is needed: a state change is old relation + change relation -> new
relation, written to a new snapshot by the caller.  Keys compare mandatory
columns with ``=`` and nullable ones with ``<=>``; Catalyst turns the
null-safe equalities into hashable join keys, so these stay hash/sort-merge
joins, never nested loops.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantweave.operators import rules as R

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for identical results): merge keys.
UPSERT_EQ_KEYS = ["object_type", "user_group", "permission_types", "grant_type", "bu"]
UPSERT_NULLSAFE_KEYS = ["tag_values", "schema_names", "table_names", "access_until"]
EXPIRE_EQ_KEYS = ["object_type", "user_group", "permission_types"]
EXPIRE_NULLSAFE_KEYS = ["schema_names", "table_names", "tag_values"]
# ---------------------------------------------------------------------------
_LAST_ID = (1 << 63) - 1
REASON_COPIES = "copies without an id of their own"


def key_match(eq: list[str], nullsafe: list[str], prefix: str = "_r_") -> Column:
    """Key equality between columns ``k`` (left) and ``prefix + k`` (right).

    The right side's key columns are renamed so that self-joins (both sides
    derived from one table) resolve unambiguously.
    """
    conds = [F.col(c) == F.col(prefix + c) for c in eq] + [F.col(c).eqNullSafe(F.col(prefix + c)) for c in nullsafe]
    return reduce(lambda a, b: a & b, conds)


def renamed(df: DataFrame, keys: list[str], prefix: str = "_r_") -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) if c in keys else F.col(c) for c in df.columns])


def invalid_keys(incoming: DataFrame, eq: list[str] = UPSERT_EQ_KEYS) -> Column:
    """A null in an '=' key can never match, so such rows are rejected."""
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in eq])


def upsert(target: DataFrame, incoming: DataFrame) -> DataFrame:
    """``target`` with the incoming rows whose key it does not have (:func:`new_rows`)."""
    return target.unionByName(new_rows(target, incoming))


def new_rows(target: DataFrame, incoming: DataFrame) -> DataFrame:
    """The incoming rows that an upsert inserts: those whose key is not in ``target``.

    A matched row only re-sets its key columns to equal values, so matches
    leave the target unchanged.  Incoming rows with a null '=' key are left
    out (see :func:`upsert_rejects`), and several incoming rows with one key
    insert once (the smallest acl_id wins).

    Plan: one aggregation over target keys and incoming rows together,
    grouped by the merge key (grouping treats nulls as equal, which is the
    ``<=>`` of the nullable keys; '=' keys are never null on the incoming side).
    One shuffle with partial aggregation on both inputs and no join, so a key
    holding a third of all rows is combined map-side instead of piling up in
    one join task.  Beside the keys a row holds only its id and stamps, so the
    buffers are of fixed width and the aggregation is hash-based.
    """
    keys = UPSERT_EQ_KEYS + UPSERT_NULLSAFE_KEYS
    cols = list(target.columns)
    others = [c for c in cols if c not in keys]
    valid = incoming.filter(~invalid_keys(incoming))
    order = F.coalesce(F.col("acl_id").cast("long"), F.lit(_LAST_ID))  # rows without an id come last
    t = target.select(*keys, F.lit(True).alias("_t"), F.lit(None).cast("long").alias("_ord"),
                      *[F.lit(None).cast(valid.schema[c].dataType).alias(c) for c in others])
    i = valid.select(*keys, F.lit(False).alias("_t"), order.alias("_ord"), *others)
    winner = [F.min_by(c, "_ord").alias(c) for c in others]
    g = t.unionByName(i).groupBy(*keys).agg(F.max("_t").alias("_in_target"), *winner)
    return g.filter(~F.col("_in_target")).select(*cols)


def upsert_rejects(incoming: DataFrame, copies: DataFrame | None = None) -> DataFrame:
    """Every incoming row left out of an upsert: null '=' keys and duplicate keys.

    Duplicates are listed by their own ids; those that share the kept row's id,
    or have none, are one row per merge key with their number
    (``copies``, by default :func:`uncounted_duplicates`).
    """
    keys = UPSERT_EQ_KEYS + UPSERT_NULLSAFE_KEYS
    nulls = incoming.filter(invalid_keys(incoming)).select(
        F.lit("upsert").alias("stage"), "acl_id", F.lit(None).cast("string").alias("value"),
        F.lit("null in merge key").alias("reason"),
    )
    valid = incoming.filter(~invalid_keys(incoming))
    keep = renamed(valid.groupBy(*keys).agg(F.min("acl_id").alias("_keep"), F.count("*").alias("_n")).filter("_n > 1"), keys)
    dup = valid.join(keep, key_match(UPSERT_EQ_KEYS, UPSERT_NULLSAFE_KEYS), "inner").filter(
        F.col("acl_id") != F.col("_keep")
    )
    dups = dup.select(
        F.lit("upsert").alias("stage"), "acl_id", F.col("_keep").cast("string").alias("value"),
        F.lit("duplicate key in sheet").alias("reason"),
    )
    return nulls.unionByName(dups).unionByName(uncounted_duplicates(incoming) if copies is None else copies)


def copies_of(table: DataFrame, incoming: DataFrame) -> DataFrame:
    """:func:`uncounted_duplicates` with the (smallest) id that ``table`` has for the merge key."""
    keys = UPSERT_EQ_KEYS + UPSERT_NULLSAFE_KEYS
    counted = renamed(_copies(incoming), keys).drop("acl_id")
    found = table.join(counted, key_match(UPSERT_EQ_KEYS, UPSERT_NULLSAFE_KEYS)).groupBy(*keys, "_copies").agg(F.min("acl_id").alias("acl_id"))
    return found.select(F.lit("upsert").alias("stage"), "acl_id", F.col("_copies").cast("string").alias("value"), F.lit(REASON_COPIES).alias("reason"))


def uncounted_duplicates(incoming: DataFrame) -> DataFrame:
    """Left-out rows of a key that :func:`upsert_rejects` cannot tell from the kept one, counted.

    A sheet without ids gives all rows of a merge key one id (or none), so the
    copies have no id to be listed by.  Per merge key there is one row, its
    value the number of copies beside the inserted row.  Both aggregates combine
    map-side, so a hot key costs one slim row per task.
    """
    return _copies(incoming).select(
        F.lit("upsert").alias("stage"), "acl_id", F.col("_copies").cast("string").alias("value"),
        F.lit(REASON_COPIES).alias("reason"),
    )


def _copies(incoming: DataFrame) -> DataFrame:
    """(*keys, acl_id, _copies) of the merge keys with rows that have no id of their own."""
    keys = UPSERT_EQ_KEYS + UPSERT_NULLSAFE_KEYS
    per_id = incoming.filter(~invalid_keys(incoming)).groupBy(*keys, "acl_id").agg(F.count("*").alias("_n"))
    without = F.coalesce(F.sum(F.when(F.col("acl_id").isNull(), F.col("_n"))), F.lit(0))
    kept = F.coalesce(F.min_by("_n", "acl_id"), F.lit(0))
    per_key = per_id.groupBy(*keys).agg(F.min("acl_id").alias("acl_id"), (kept + without - 1).alias("_copies"))
    return per_key.filter("_copies > 0")


def expire_apply(mapping: DataFrame, bu: str, as_of=None, stamp=None, match: str = "own") -> DataFrame:
    """Write the expiry back into the whole mapping table.

    ``match="own"`` (default): only this business unit's expired GRANT rows
    become REVOKE; a pure projection, no join.  ``match="key"``: the
    reference's merge keys (no bu, no access_until) with
    ``source.grant_type != target.grant_type``; every target row whose key
    matches a source row takes the source's grant_type.  The source has one
    row per key: an expired grant on a key revokes it, whatever else is live.
    """
    ts = R.stamp_ts(stamp)
    if match == "own":
        hit = (F.col("bu") == F.lit(bu)) & (F.col("grant_type") == F.lit(R.GRANT)) & R.expired(as_of)
        return mapping.withColumns(
            {
                "grant_type": F.when(hit, F.lit(R.REVOKE)).otherwise(F.col("grant_type")),
                "updated_datetime": F.when(hit, ts).otherwise(F.col("updated_datetime")),
            }
        )
    if match != "key":
        raise ValueError(f"match must be 'own' or 'key', not {match!r}")
    keys = EXPIRE_EQ_KEYS + EXPIRE_NULLSAFE_KEYS
    src = renamed(
        R.expire(R.active_grants(mapping, bu), as_of, stamp)
        .groupBy(*keys)
        .agg(F.max("grant_type").alias("_src_grant")),  # one source per key: REVOKE sorts after GRANT
        keys,
    )
    cond = key_match(EXPIRE_EQ_KEYS, EXPIRE_NULLSAFE_KEYS) & (F.col("_src_grant") != F.col("grant_type"))
    joined = mapping.join(src, cond, "left")
    hit = F.col("_src_grant").isNotNull()
    return joined.select(
        *[
            F.when(hit, F.col("_src_grant")).otherwise(F.col(c)).alias(c)
            if c == "grant_type"
            else F.when(hit, ts).otherwise(F.col(c)).alias(c)
            if c == "updated_datetime"
            else F.col(c)
            for c in mapping.columns
        ]
    )
