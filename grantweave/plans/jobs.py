"""The tag job and the mask job: rules folded into stored state, end to end.

Each reads the state as it is, says what every rule does and which do nothing,
and writes the state after all rules to a new snapshot, never over the one it
reads.  What a rule does is stored once, so state, rejects and summary start from
files.  A dry run reports the same and leaves the state as it is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantweave.operators import masks, rejects, tags
from grantweave.session import materialize, scratch_path


@dataclass
class JobResult:
    steps: DataFrame  # what each rule does: tag statements, or the mask plan
    rejects: DataFrame  # (stage, acl_id, value, reason)
    summary: DataFrame  # (action, rules): steps counted by what they do, rejects included
    state: DataFrame
    state_path: str | None  # null after a dry run


def _stored(state: DataFrame, old: DataFrame, name: str, dry_run: bool) -> tuple[DataFrame, str | None]:
    if dry_run:
        return old, None
    path = scratch_path(old.sparkSession, name)
    state.write.mode("errorifexists").parquet(path)
    return old.sparkSession.read.schema(state.schema).parquet(path), path


def _counted(steps: DataFrame, refused: DataFrame) -> DataFrame:
    rows = steps.select("action").unionByName(refused.select(F.lit(masks.ACTION_REJECT).alias("action")))
    return rows.groupBy("action").agg(F.count("*").alias("rules"))


def run_tag_job(tag_rules: DataFrame, old_state: DataFrame, env: str, dry_run: bool = False) -> JobResult:
    """Statements, rejects and new state of all schema and table tag rules; a step is one target of a rule."""
    steps = materialize(tags.statements(tags.targets(tag_rules, env)), "tag_statements")
    refused = materialize(rejects.tag_rejects(tags.rejects(tag_rules, env)), "tag_rejects")
    state, path = _stored(tags.apply_rules(old_state, tag_rules, env), old_state, "object_tags", dry_run)
    return JobResult(steps, refused, _counted(steps, refused), state, path)


def run_mask_job(mask_rules: DataFrame, catalog_mapping: DataFrame, old_state: DataFrame, env: str, dry_run: bool = False) -> JobResult:
    """Plan, rejects and new state of all mask rules."""
    steps = materialize(masks.plan(mask_rules, catalog_mapping, env, old_state), "mask_plan")
    refused = rejects.mask_rejects(steps)
    state, path = _stored(masks.state(mask_rules, catalog_mapping, env, old_state), old_state, "masks", dry_run)
    return JobResult(steps, refused, _counted(steps.filter(F.col("action") != masks.ACTION_REJECT), refused), state, path)
