"""Stamp the mapping rows whose statements took effect.

Two paths: the reference's key matching (grouped name sets, null-safe keys)
and the exact path by ``acl_id`` (default; also covers VOLUME rows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantweave.functions import comma_items, short_object_name
from grantweave.operators.numbering import CHUNK_NAMES, ordered_chunks
from grantweave.operators.rules import stamp_ts
from grantweave.operators.upsert import key_match, renamed

def _null():
    return F.lit(None).cast("string")


def parsed_rows(applied_outcomes: DataFrame) -> DataFrame:
    """The parsed fields of applied statement texts (plus acl_id).

    The same keys come from ``factors.by_group`` without any text.
    """
    return applied_outcomes.select("acl_id", "p.*")


def tag_keys(parsed: DataFrame) -> DataFrame:
    """SCHEMA rows that carry tags: one key per (type, group, tags)."""
    return (
        parsed.filter((F.col("object_type") == "SCHEMA") & F.col("tag_values").isNotNull())
        .select("object_type", "user_group", "tag_values", _null().alias("schema_names"), _null().alias("table_names"))
        .distinct()
    )


def _name_set(parsed: DataFrame, object_type: str, out: str) -> DataFrame:
    # Names are made distinct per group before they are gathered, so the
    # per-group set holds distinct short names, never one entry per row.
    names = parsed.select("object_type", "user_group", short_object_name(F.col("object_name"), object_type).alias("n"))
    return (
        names.distinct()
        .groupBy("object_type", "user_group")
        .agg(F.concat_ws(",", F.sort_array(F.collect_list("n"))).alias(out))
    )


def name_chunks(parsed: DataFrame, object_type: str, size: int = CHUNK_NAMES) -> DataFrame:
    """The name lists of :func:`schema_keys` or :func:`table_keys` in chunks of at most ``size`` names.

    (object_type, user_group, chunk, start, n, names): a group's chunks in order,
    comma-joined, are its list; no task gathers more than a chunk, however many
    names a group has.
    """
    own = F.col("object_type") == object_type
    rows = parsed.filter(own & F.col("tag_values").isNull() if object_type == "SCHEMA" else own)
    names = rows.select("object_type", "user_group", short_object_name(F.col("object_name"), object_type).alias("n_")).distinct()
    return ordered_chunks(names, ["object_type", "user_group"], "n_", size)


def schema_keys(parsed: DataFrame) -> DataFrame:
    """Tag keys plus, for untagged SCHEMA rows, the sorted set of short names."""
    untagged = parsed.filter((F.col("object_type") == "SCHEMA") & F.col("tag_values").isNull())
    names = _name_set(untagged, "SCHEMA", "schema_names").select(
        "object_type", "user_group", _null().alias("tag_values"), "schema_names", _null().alias("table_names")
    )
    return tag_keys(parsed).unionByName(names)


def table_keys(parsed: DataFrame) -> DataFrame:
    """TABLE rows: the sorted set of short table names per (type, group)."""
    tables = parsed.filter(F.col("object_type") == "TABLE")
    return _name_set(tables, "TABLE", "table_names").select(
        "object_type", "user_group", _null().alias("tag_values"), _null().alias("schema_names"), "table_names"
    )


# A name set is compared by its size and two sums over its names' hashes, so no
# group's names are ever gathered; equal sets have equal digests, and for unequal
# ones to agree two independent 64-bit sums would have to collide at once.
_DIGEST = ["_n", "_sum", "_xor"]
_WIDE = "decimal(38,0)"


def _list_digest(c: str) -> list:
    """Digest columns of a stored comma list, read as a set; null for a null list."""
    names = F.array_distinct(comma_items(c))
    total = F.aggregate(names, F.lit(0).cast(_WIDE), lambda acc, n: (acc + F.xxhash64(n)).cast(_WIDE))
    mixed = F.aggregate(names, F.lit(0).cast("long"), lambda acc, n: acc.bitwiseXOR(F.xxhash64(F.lit("name"), n)))
    return [F.size(names).cast("long").alias("_n"), total.alias("_sum"), mixed.alias("_xor")]


def _set_digest(parsed: DataFrame, object_type: str) -> DataFrame:
    """Digest of the distinct short names per (type, group)."""
    names = parsed.select("object_type", "user_group", short_object_name(F.col("object_name"), object_type).alias("n")).distinct()
    return names.groupBy("object_type", "user_group").agg(
        F.count("n").alias("_n"),
        F.sum(F.xxhash64("n").cast(_WIDE)).cast(_WIDE).alias("_sum"),
        F.bit_xor(F.xxhash64(F.lit("name"), F.col("n"))).alias("_xor"),
    )


def _stamp_by_keys(mapping: DataFrame, keys: DataFrame, eq: list[str], nullsafe: list[str], names: str, stamp) -> DataFrame:
    cols = [*eq, *nullsafe, *_DIGEST]
    k = renamed(keys.select(*cols).distinct().withColumn("_hit", F.lit(True)), cols)
    left = mapping.select("*", *[F.when(F.col(names).isNotNull(), d).alias(n) for n, d in zip(_DIGEST, _list_digest(names))])
    j = left.join(k, key_match(eq, [*nullsafe, *_DIGEST]), "left")
    return _stamped(mapping, j, stamp)


def _stamped(mapping: DataFrame, joined: DataFrame, stamp) -> DataFrame:
    ts = stamp_ts(stamp)
    return joined.select(
        *[
            F.when(F.col("_hit").isNotNull(), ts).otherwise(F.col(c)).alias(c) if c == "updated_datetime" else F.col(c)
            for c in mapping.columns
        ]
    )


def stamp_schema_rows(mapping: DataFrame, parsed: DataFrame, stamp=None) -> DataFrame:
    """SCHEMA keys: type and group by '=', tags and schema names by '<=>'."""
    none = [F.lit(None).cast(t).alias(n) for n, t in zip(_DIGEST, ("long", _WIDE, "long"))]
    tagged = tag_keys(parsed).select("object_type", "user_group", "tag_values", *none)
    untagged = parsed.filter((F.col("object_type") == "SCHEMA") & F.col("tag_values").isNull())
    keys = tagged.unionByName(_set_digest(untagged, "SCHEMA").withColumn("tag_values", _null()))
    return _stamp_by_keys(mapping, keys, ["object_type", "user_group"], ["tag_values"], "schema_names", stamp)


def stamp_table_rows(mapping: DataFrame, parsed: DataFrame, stamp=None) -> DataFrame:
    """TABLE keys: type and group by '=', table names by '<=>'."""
    keys = _set_digest(parsed.filter(F.col("object_type") == "TABLE"), "TABLE")
    return _stamp_by_keys(mapping, keys, ["object_type", "user_group"], [], "table_names", stamp)


def stamp_exact(mapping: DataFrame, applied: DataFrame, stamp=None) -> DataFrame:
    """Stamp every mapping row with at least one applied statement (by acl_id).

    ``applied`` are factors or statements; only their ids are read.
    """
    ids = applied.select(F.col("acl_id").alias("_id")).distinct().withColumn("_hit", F.lit(True))
    return _stamped(mapping, mapping.join(ids, F.col("acl_id") == F.col("_id"), "left"), stamp)


__all__ = ["key_match", "parsed_rows", "schema_keys", "stamp_exact", "stamp_schema_rows", "stamp_table_rows", "table_keys", "tag_keys"]
