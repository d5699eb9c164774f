"""Statements as factors: one row per (rule, object), with the rule's groups and privileges as lists.

A rule's statements are the product of its objects, groups and privileges, so
everything that can be said of a product without writing it out is said here:
whether its text can be read back is a matter of each factor alone, whether the
object exists one of the pair, and counts are products of list lengths.  Texts and
(object, group, privilege) rows are made last, and only by those who need them.

Object names, types, groups and privileges are each held against the statement
grammar once.  A statement whose factors all fit reads back as exactly these
factors: neither type nor object has a blank, and the one quoted name is the
group, so no other ``ON`` in the text can be followed by two words, a direction
and a quote.  One whose factors do not fit can fail or, worse, read back as
another grant; it takes no effect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantweave.functions import fits_group, fits_name, fits_privilege, fits_type, py_strip, render_statement
from grantweave.operators.ledger import ERR_UNKNOWN_OBJECT, ERR_UNPARSEABLE

FACTOR_COLUMNS = ["acl_id", "source", "object_type", "object_name", "grant_type", "tag_values", "groups", "privileges"]


def factors(objects: DataFrame) -> DataFrame:
    """The factors of resolved objects that carry their rule's columns."""
    return objects.select(*FACTOR_COLUMNS)


def _fit(lists: str, fits) -> Column:
    return F.filter(lists, fits)


def outcomes(factor_rows: DataFrame, known_objects: DataFrame, dry_run: bool = False) -> DataFrame:
    """Factors with ``error`` (of every statement of the pair; null if none) and ``dry_run``.

    Beside that a statement fails if its own group or privilege does not fit.
    A dry run has no errors.  The join with the known objects is one of pairs,
    not of statements; pairs without a readable object meet nothing there.
    """
    if dry_run:
        return factor_rows.select(*FACTOR_COLUMNS, F.lit(None).cast("string").alias("error"), F.lit(True).alias("dry_run"))
    readable = F.col("grant_type").isin("GRANT", "REVOKE") & fits_type("object_type") & fits_name("object_name")
    # a pair without a readable object meets none; a key of its own keeps such pairs from one task
    alone = F.concat(F.lit("\u0000"), F.xxhash64("acl_id", "object_name").cast("string"))
    rows = factor_rows.select(*FACTOR_COLUMNS, F.when(readable, F.col("object_name")).otherwise(alone).alias("_name"))
    known = known_objects.select(F.col("object_name").alias("_known")).distinct()
    met = rows.join(known, F.col("_name") == F.col("_known"), "left")
    error = F.when(F.col("_name").startswith("\u0000"), F.lit(ERR_UNPARSEABLE)).when(F.col("_known").isNull(), F.lit(ERR_UNKNOWN_OBJECT))
    return met.select(*FACTOR_COLUMNS, error.alias("error"), F.lit(False).alias("dry_run"))


def _size(lists: Column | str) -> Column:
    return F.size(lists).cast("long")


def summary(outcome_factors: DataFrame) -> DataFrame:
    """total / success / failure of all statements per run mode, without writing one out."""
    total = _size("groups") * _size("privileges")
    fit = _size(_fit("groups", fits_group)) * _size(_fit("privileges", fits_privilege))
    success = F.when(F.col("dry_run"), total).when(F.col("error").isNull(), fit).otherwise(F.lit(0))
    rows = outcome_factors.select("dry_run", total.alias("total"), success.alias("success"))
    return rows.groupBy("dry_run").agg(
        F.sum("total").alias("total"), F.sum("success").alias("success"), F.sum(F.col("total") - F.col("success")).alias("failure")
    )


def applied(outcome_factors: DataFrame) -> DataFrame:
    """Factors of the statements that took effect, with the groups and privileges that fit."""
    ok = outcome_factors.filter(~F.col("dry_run") & F.col("error").isNull())
    lists = {"groups": _fit("groups", fits_group), "privileges": _fit("privileges", fits_privilege)}
    return ok.withColumns(lists).filter((F.size("groups") > 0) & (F.size("privileges") > 0)).select(*FACTOR_COLUMNS)


def by_group(factor_rows: DataFrame) -> DataFrame:
    """One row per (rule, object, group): what tracking keys are made of."""
    return factor_rows.select("acl_id", "grant_type", "object_type", "object_name", F.explode("groups").alias("user_group"), "tag_values")


def grant_rows(applied_factors: DataFrame) -> DataFrame:
    """Ledger rows (acl_id, privilege, object_type, object_name, user_group, grant_type), from the rules' own fields."""
    groups = applied_factors.select("*", F.explode("groups").alias("user_group"))
    privilege = py_strip(F.col("p")).alias("privilege")
    rows = groups.select("*", F.explode("privileges").alias("p"))
    return rows.select("acl_id", privilege, "object_type", "object_name", "user_group", "grant_type")


def _texts(rows: DataFrame, groups: Column, privileges: Column) -> DataFrame:
    said = render_statement(F.col("grant_type"), F.col("p.name"), F.col("object_type"), F.col("object_name"), F.col("g.name"))
    out = rows.select("*", F.explode(groups).alias("g")).select("*", F.explode(privileges).alias("p"))
    return out.withColumn("access_statement", said)


def _marked(lists: str, fits) -> Column:
    return F.transform(lists, lambda x: F.struct(x.alias("name"), F.coalesce(fits(x), F.lit(False)).alias("fits")))


def outcome_rows(outcome_factors: DataFrame) -> DataFrame:
    """One row per statement: acl_id, access_statement, tag_values, status, dry_run, error."""
    rows = _texts(outcome_factors, _marked("groups", fits_group), _marked("privileges", fits_privilege))
    misfit = ~F.col("dry_run") & ~(F.col("g.fits") & F.col("p.fits"))
    error = F.when(misfit, F.lit(ERR_UNPARSEABLE)).otherwise(F.col("error"))
    rows = rows.select("acl_id", "access_statement", "tag_values", "dry_run", error.alias("error"))
    status = F.when(F.col("error").isNull(), F.lit("success")).otherwise(F.lit("failure"))
    return rows.select("acl_id", "access_statement", "tag_values", status.alias("status"), "dry_run", "error")


def unreadable(outcome_factors: DataFrame) -> DataFrame:
    """The outcome rows of statements that cannot be read back; only their factors are written out."""
    misfit = F.exists("groups", lambda g: ~fits_group(g)) | F.exists("privileges", lambda p: ~fits_privilege(p))
    some = outcome_factors.filter(~F.col("dry_run") & ((F.col("error") == ERR_UNPARSEABLE) | F.coalesce(misfit, F.lit(True))))
    return outcome_rows(some).filter(F.col("error") == ERR_UNPARSEABLE)


def counts(factor_rows: DataFrame) -> DataFrame:
    """Total, distinct, GRANT/REVOKE counts and the empty flag of all statements.

    The distinct statements of one (grant type, object, group) are the union of
    its rules' privilege lists, of which there are few (those of the permission
    groups).  So groups are written out, privileges are not, and what is shuffled
    is two 64-bit hashes of the three parts, combined before.
    """
    said = ["grant_type", "object_type", "object_name", "user_group"]
    n = _size("privileges")
    keyed = factor_rows.select(*said[:3], F.explode("groups").alias("user_group"), "privileges").select(
        F.xxhash64(*said).alias("h1"), F.xxhash64(F.lit("statement"), *reversed(said)).alias("h2"), "privileges", n.alias("total"),
        F.when(F.col("grant_type") == "GRANT", n).alias("grants"), F.when(F.col("grant_type") == "REVOKE", n).alias("revokes"),
    )
    union = _size(F.array_distinct(F.flatten(F.collect_set("privileges")))).alias("distinct_statements")
    one = keyed.groupBy("h1", "h2").agg(union, *[F.sum(c).alias(c) for c in ("total", "grants", "revokes")])
    out = [F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c) for c in ("total", "distinct_statements", "grants", "revokes")]
    return one.agg(*out).withColumn("is_empty", F.col("total") == 0)
