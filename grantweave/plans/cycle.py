"""One provisioning cycle for a business unit, end to end.

generate -> outcomes -> (ledger, stamps) -> summary.  The factors of all
statements (``operators.factors``) are written once, with their outcome, as a
snapshot under the session's checkpoint folder and read back: every later step
reads it, so a lost executor re-reads files instead of recomputing tag
resolution.  Summary and stamps come from the factors alone, the ledger from the
rules' own fields; statement and outcome texts are written out only for who reads
them.  The grant ledger and the unit's part of the mapping are written to *new*
snapshot paths, never over the ones being read (``sources.mapping.replace_units``
then puts the unit's part into the stored table).  Statements are generated from
the mapping as it was before the expiry write-back, so expired rows do produce
their REVOKE statements.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantweave.operators import factors, ledger, statements, tracking, upsert
from grantweave.plans.generate import generate_factors
from grantweave.session import materialize, scratch_path


@dataclass
class CycleResult:
    factors: DataFrame  # with error and dry_run; statements and outcomes are written out from them
    statements: DataFrame
    outcomes: DataFrame
    summary: DataFrame
    grants: DataFrame
    mapping: DataFrame
    grants_path: str | None
    mapping_path: str | None


def run_cycle(
    mapping: DataFrame,
    schema_tags: DataFrame,
    permission_mapping: DataFrame,
    catalog_mapping: DataFrame,
    known_objects: DataFrame,
    old_grants: DataFrame,
    env: str,
    bu: str,
    as_of=None,
    stamp=None,
    dry_run: bool = False,
) -> CycleResult:
    spark = mapping.sparkSession
    made = generate_factors(mapping, schema_tags, permission_mapping, catalog_mapping, env, bu, as_of, stamp)
    outs = materialize(factors.outcomes(made, known_objects, dry_run), "outcomes")
    summary = factors.summary(outs)
    texts = statements.expand(outs), factors.outcome_rows(outs)
    if dry_run:
        return CycleResult(outs, *texts, summary, old_grants, mapping, None, None)
    applied = factors.applied(outs)
    grants = ledger.apply_statements(old_grants, factors.grant_rows(applied))
    grants_path = scratch_path(spark, "grants")
    grants.write.parquet(grants_path)
    # no other unit's row can change, so only the unit's partition is written anew
    expired = upsert.expire_apply(mapping.filter(F.col("bu") == F.lit(bu)), bu, as_of, stamp)
    stamped = tracking.stamp_exact(expired, applied, stamp)
    mapping_path = scratch_path(spark, "acl_mapping")
    stamped.write.partitionBy("bu").parquet(mapping_path)
    return CycleResult(
        outs,
        *texts,
        summary,
        spark.read.parquet(grants_path),
        spark.read.parquet(mapping_path),
        grants_path,
        mapping_path,
    )
