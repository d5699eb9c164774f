"""Rule sources: configuration dictionaries become small relations.

The configuration keeps the nested shapes users already write
(``{env: {group: [privileges]}}``, ``{env: {prefix: catalog}}``,
``{workspace_id: env}``, lists of mask / tag rule dicts); each becomes a
DataFrame with an explicit schema so it can be joined like any table.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from grantweave import schemas
from grantweave.functions import comma_items
from grantweave.sources.literal import literal_frame

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for identical results): what masked
# readers see by default.  Rule files use the field names of schemas.MASK_RULES
# and schemas.TAG_RULES.
DEFAULT_MASK = "****"
# ---------------------------------------------------------------------------


def permission_mapping(spark: SparkSession, config: Mapping[str, Mapping[str, Iterable[str]]]) -> DataFrame:
    rows = [(env, grp, list(privs or [])) for env, groups in config.items() for grp, privs in (groups or {}).items()]
    return literal_frame(spark, rows, schemas.PERMISSION_MAPPING)


def catalog_mapping(spark: SparkSession, config: Mapping[str, Mapping[str, str]]) -> DataFrame:
    rows = [(env, prefix, cat) for env, prefixes in config.items() for prefix, cat in (prefixes or {}).items()]
    return literal_frame(spark, rows, schemas.CATALOG_MAPPING)


def env_map(spark: SparkSession, config: Mapping[str | int, str]) -> DataFrame:
    rows = [(str(ws), env) for ws, env in config.items()]
    return literal_frame(spark, rows, schemas.ENV_MAP)


def _as_list(v):
    """A single string becomes a one-item list (scalar-or-list fields)."""
    if v is None:
        return None
    return [v] if isinstance(v, str) else list(v)


def mask_rules(spark: SparkSession, entries: Iterable[Mapping]) -> DataFrame:
    """Mask rules; a comma string of groups is split and stripped."""
    rows = []
    for i, e in enumerate(entries):
        groups = e.get("user_group")
        if isinstance(groups, str):
            groups = list(map(str.strip, groups.split(",")))
        rows.append(
            (
                int(e.get("rule_id", i)),
                e.get("table_name"),
                e.get("column_name"),
                list(groups) if groups else groups,
                e.get("type_of_masking", DEFAULT_MASK),
                bool(e.get("drop_existing", False)),
            )
        )
    return literal_frame(spark, rows, schemas.MASK_RULES)


def tag_rules(spark: SparkSession, schema_entries: Iterable[Mapping] = (), table_entries: Iterable[Mapping] = ()) -> DataFrame:
    """Schema-level then table-level tag rules, numbered in file order."""
    rows = []
    for level, entries in (("SCHEMA", schema_entries), ("TABLE", table_entries)):
        for e in entries:
            tags = e.get("tags")
            rows.append(
                (
                    len(rows),
                    level,
                    e.get("action"),
                    _as_list(e.get("schemas")),
                    _as_list(e.get("tables")) if level == "TABLE" else None,
                    dict(tags) if isinstance(tags, Mapping) else None,
                )
            )
    return literal_frame(spark, rows, schemas.TAG_RULES)


# Rule files: one JSON object per line.  Fields that may be a scalar, a list or
# (by mistake) no map are read as JSON text and told apart here.
_RULE_FILES = {
    "mask": "rule_id long, table_name string, column_name string, user_group string, type_of_masking string, drop_existing boolean",
    "tag": "rule_ord long, level string, action string, schemas string, tables string, tags string",
}


def _text_or_list(c: str):
    """A JSON array of strings as it is, any other text as a one-item list."""
    return F.when(F.col(c).startswith("["), F.from_json(c, "array<string>")).when(F.col(c).isNotNull(), F.array(c)).alias(c)


def read_rules(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """``mask`` or ``tag`` rules from JSON-lines files, as relations of any size."""
    raw = spark.read.schema(_RULE_FILES[kind]).json(path)
    if kind == "mask":
        groups = F.when(F.col("user_group").startswith("["), F.from_json("user_group", "array<string>"))
        return raw.select(
            "rule_id", "table_name", "column_name",
            groups.when(F.col("user_group").isNotNull(), comma_items("user_group")).alias("user_group"),
            F.coalesce("type_of_masking", F.lit(DEFAULT_MASK)).alias("type_of_masking"),
            F.coalesce("drop_existing", F.lit(False)).alias("drop_existing"),
        )
    tags = F.when(F.col("tags").startswith("{"), F.from_json("tags", "map<string,string>")).alias("tags")
    return raw.select("rule_ord", "level", "action", _text_or_list("schemas"), _text_or_list("tables"), tags)
