"""Expand rules x objects x groups x privileges into statement rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantweave.functions import render_statement

STATEMENT_COLUMNS = [
    "acl_id", "source", "object_type", "object_name", "user_group", "privilege", "grant_type", "tag_values",
    "access_statement",
]


def expand(objects: DataFrame) -> DataFrame:
    """One statement per (object row, group, privilege); duplicates kept.

    ``objects`` are factors (``operators.factors``): grant_type, object_type, groups,
    privileges and tag_values next to object_name.  Both explodes are narrow
    Generate nodes; nothing is shuffled here.
    """
    by_group = objects.select("*", F.explode("groups").alias("user_group"))
    by_priv = by_group.select("*", F.explode("privileges").alias("privilege"))
    return by_priv.select(
        "acl_id",
        "source",
        "object_type",
        "object_name",
        "user_group",
        "privilege",
        "grant_type",
        "tag_values",
        render_statement(
            F.col("grant_type"), F.col("privilege"), F.col("object_type"), F.col("object_name"), F.col("user_group")
        ).alias("access_statement"),
    )

