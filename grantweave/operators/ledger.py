"""Statement effects as data: outcomes, execution summary and the grant ledger.

Open-source Spark cannot run GRANT/REVOKE text, so the effect of a statement
is modelled as a keyed state change: the ledger of effective grants.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantweave.functions import parse_statements

LEDGER_KEY = ["privilege", "object_type", "object_name", "user_group"]
ERR_UNPARSEABLE = "unparseable statement"
ERR_UNKNOWN_OBJECT = "object not found"


def parsed(statements: DataFrame) -> DataFrame:
    """Add the parsed struct ``p`` (null when the text does not match)."""
    return parse_statements(statements, "access_statement", "tag_values", "p")


def outcomes(statements: DataFrame, known_objects: DataFrame, dry_run: bool = False) -> DataFrame:
    """One outcome row per statement row; a failure never stops the others.

    Dry run: every statement counts as success and nothing is applied.
    Otherwise a statement fails when it cannot be parsed or its object is not
    in ``known_objects`` (column ``object_name``).  Output keeps acl_id and the
    parsed fields for stamping.
    """
    p = parsed(statements)
    if dry_run:
        return p.select(
            "acl_id", "access_statement", "tag_values", "p",
            F.lit("success").alias("status"), F.lit(True).alias("dry_run"), F.lit(None).cast("string").alias("error"),
        )
    known = known_objects.select(F.col("object_name").alias("_known")).distinct()
    # a statement without an object meets none; a key of its own keeps such rows from one task
    name = F.coalesce("p.object_name", F.concat(F.lit("\u0000"), F.xxhash64("access_statement").cast("string")))
    j = p.join(known, name == F.col("_known"), "left")
    error = (
        F.when(F.col("p").isNull(), F.lit(ERR_UNPARSEABLE))
        .when(F.col("_known").isNull(), F.lit(ERR_UNKNOWN_OBJECT))
    )
    return j.select(
        "acl_id", "access_statement", "tag_values", "p",
        F.when(error.isNull(), F.lit("success")).otherwise(F.lit("failure")).alias("status"),
        F.lit(False).alias("dry_run"),
        error.alias("error"),
    )


def summary(outcome_rows: DataFrame) -> DataFrame:
    """total / success / failure per run mode, in one aggregate."""
    return outcome_rows.groupBy("dry_run").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "success").alias("success"),
        F.count_if(F.col("status") == "failure").alias("failure"),
    )


def applied(outcome_rows: DataFrame) -> DataFrame:
    """Parsed rows of statements that took effect (not dry run, success, parsed)."""
    ok = (~F.col("dry_run")) & (F.col("status") == "success") & F.col("p").isNotNull()
    return outcome_rows.filter(ok)


def apply_statements(old_state: DataFrame, statements: DataFrame) -> DataFrame:
    """New effective grants = old state folded with statements in acl_id order.

    Per (privilege, object_type, object_name, user_group) the statement with
    the largest acl_id decides: GRANT makes the grant present, REVOKE absent;
    keys no statement touches keep their old state.  A statement without an
    acl_id comes before all others, and on a tie a GRANT wins.

    The fold keeps the largest id of either kind and whether that kind occurs
    at all: fixed-width buffers over the whole range of ids, so the aggregation
    is hash-based and partial before the shuffle.  Both join sides are unique
    per key.
    """
    grant = F.col("grant_type") == "GRANT"
    last = statements.groupBy(*LEDGER_KEY).agg(
        F.max(F.when(grant, F.col("acl_id"))).alias("_granted"),
        F.max(F.when(~grant, F.col("acl_id"))).alias("_revoked"),
        F.max(grant).alias("_any_grant"),
        F.max(~grant).alias("_any_revoke"),
    )
    last_is_grant = F.col("_any_grant") & (
        ~F.col("_any_revoke") | F.col("_revoked").isNull() | F.coalesce(F.col("_granted") >= F.col("_revoked"), F.lit(False))
    )
    old = old_state.select(*LEDGER_KEY).distinct().withColumn("_old", F.lit(True))
    j = old.join(last, LEDGER_KEY, "full_outer")
    present = F.when(F.col("_any_grant").isNotNull(), last_is_grant).otherwise(F.col("_old").isNotNull())
    return j.filter(present).select(*LEDGER_KEY)


def grants_of(statements: DataFrame) -> DataFrame:
    """Distinct GRANT keys of a statement relation (a ledger snapshot)."""
    return statements.filter(F.col("grant_type") == "GRANT").select(*LEDGER_KEY).distinct()
