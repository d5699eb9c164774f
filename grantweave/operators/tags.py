"""Schema and table tag rules: targets, statements, rejects and tag state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantweave.functions import render_tag_statement
from grantweave.functions.render import tag_value
from grantweave.operators.resolve import fanout_partitions

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for identical results).
ENV_TOKEN = "xxx"  # replaced by the environment name in schema references
VALID_ACTIONS = ["SET", "UNSET"]
# ---------------------------------------------------------------------------
#: Schemas and tables whose targets one row of a rule makes.
SCHEMAS_PER_BLOCK, TABLES_PER_BLOCK = 64, 1_024
REASON_ACTION = "unsupported action"
REASON_TAGS = "tags must be a map"
REASON_MISSING = "rule has no schemas/tables"


def target_blocks(tag_rules: DataFrame, env: str) -> DataFrame:
    """Rules cut into blocks of at most ``SCHEMAS_PER_BLOCK`` schemas and ``TABLES_PER_BLOCK`` tables, dealt to tasks.

    A rule's targets are the product of its schemas and tables.  It is written
    out from the two lists of a block, so a rule of any size is held by no row
    and made by no task alone, and what is dealt stays a small part of it.  A
    rule without schemas (or, for TABLE, without tables) keeps one block without.
    """
    is_table = F.col("level") == "TABLE"
    schemas = F.transform(F.col("schemas"), lambda s: F.replace(s, F.lit(ENV_TOKEN), F.lit(env)))
    rows = tag_rules.select(
        "rule_ord", "level", F.upper("action").alias("action"), "tags",
        schemas.alias("schemas"), F.when(is_table, F.col("tables")).otherwise(F.array(F.lit(None).cast("string"))).alias("tables"),
    ).withColumn("width", F.size("tables"))
    starts = lambda c, n: F.sequence(F.lit(0), F.greatest(F.size(c) - 1, F.lit(0)), F.lit(n))
    rows = rows.withColumn("s0", F.explode(F.coalesce(starts("schemas", SCHEMAS_PER_BLOCK), F.array(F.lit(0)))))
    rows = rows.withColumn("t0", F.explode(F.coalesce(starts("tables", TABLES_PER_BLOCK), F.array(F.lit(0)))))
    rows = rows.withColumns({"schemas": F.slice("schemas", F.col("s0") + 1, SCHEMAS_PER_BLOCK), "tables": F.slice("tables", F.col("t0") + 1, TABLES_PER_BLOCK)})
    return rows.repartition(fanout_partitions(tag_rules.sparkSession), "rule_ord", "s0", "t0")


def _targets(tag_rules: DataFrame, env: str, keep_missing: bool) -> DataFrame:
    explode = F.posexplode_outer if keep_missing else F.posexplode
    rows = target_blocks(tag_rules, env).select("*", explode("schemas").alias("s", "schema"))
    rows = rows.select("*", explode("tables").alias("t", "table"))
    name = F.when(F.col("level") == "TABLE", F.concat("schema", F.lit("."), F.col("table"))).otherwise(F.col("schema"))
    pos = ((F.col("s0") + F.col("s")) * F.col("width") + F.col("t0") + F.col("t")).cast("int")
    return rows.select("rule_ord", "level", "action", pos.alias("target_pos"), name.alias("target"), "tags")


def targets(tag_rules: DataFrame, env: str) -> DataFrame:
    """One row per (rule, target): SCHEMA rules target each schema, TABLE rules
    each schema x table pair, with every ``xxx`` in a schema name replaced by
    the environment; the action is upper-cased.

    Output: rule_ord, level, action, target_pos, target, tags.
    """
    return _targets(tag_rules, env, False)


def _valid() -> F.Column:
    return F.col("tags").isNotNull() & F.col("action").isin(*VALID_ACTIONS)


def statements(tag_targets: DataFrame) -> DataFrame:
    """``ALTER SCHEMA|TABLE <target> SET TAGS (...)`` / ``UNSET TAGS (...)``."""
    return tag_targets.filter(_valid()).select(
        "rule_ord", "level", "target_pos", "target", "action",
        render_tag_statement(F.col("action"), F.col("level"), F.col("target"), F.col("tags")).alias("statement"),
    )


def rejects(tag_rules: DataFrame, env: str) -> DataFrame:
    """Per target: tags not a map, else unsupported action; per rule: no targets.  One pass over the rules."""
    reason = (
        F.when(F.col("target_pos").isNull(), F.lit(REASON_MISSING))
        .when(F.col("tags").isNull(), F.lit(REASON_TAGS))
        .when(~F.coalesce(F.col("action").isin(*VALID_ACTIONS), F.lit(False)), F.lit(REASON_ACTION))
    )
    rows = _targets(tag_rules, env, True).select("rule_ord", "level", "target", "action", reason.alias("reason"))
    return rows.filter(F.col("reason").isNotNull())


def apply_rules(old_state: DataFrame, tag_rules: DataFrame, env: str) -> DataFrame:
    """New tag state = old (level, target, tag_name, tag_value) + rules.

    All SCHEMA rules run before all TABLE rules, each group in rule order;
    SET upserts each key, UNSET deletes keys whatever their value.  Since the
    level is part of the key, the last rule per key is ``max_by(rule_ord)``,
    aggregated partially before the shuffle; both join sides are unique per
    key.
    """
    t = targets(tag_rules, env).filter(_valid())
    entries = t.select("level", "target", "rule_ord", "action", F.explode("tags").alias("tag_name", "tag_value"))
    entries = entries.withColumn("tag_value", tag_value(F.col("tag_value")))
    last = entries.groupBy("level", "target", "tag_name").agg(
        F.max_by(F.struct("action", "tag_value"), F.col("rule_ord")).alias("_last")
    )
    old = old_state.select("level", "target", "tag_name", F.col("tag_value").alias("_old_value"), F.lit(True).alias("_old"))
    j = old.join(last, ["level", "target", "tag_name"], "full_outer")
    keep = F.when(F.col("_last").isNotNull(), F.col("_last.action") == "SET").otherwise(F.col("_old").isNotNull())
    value = F.when(F.col("_last").isNotNull(), F.col("_last.tag_value")).otherwise(F.col("_old_value"))
    return j.filter(keep).select("level", "target", "tag_name", value.alias("tag_value"))
