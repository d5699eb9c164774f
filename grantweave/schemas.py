"""Explicit schemas for every relation the pipeline reads or writes."""

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DateType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

S = StringType()

# The mapping sheet as it arrives (one file or folder per business unit);
# access_until is text and is parsed with try_to_date on read.
MAPPING_SHEET = StructType(
    [
        StructField("acl_id", LongType(), True),
        StructField("object_type", S, True),
        StructField("user_group", S, True),
        StructField("tag_values", S, True),
        StructField("schema_names", S, True),
        StructField("table_names", S, True),
        StructField("permission_types", S, True),
        StructField("grant_type", S, True),
        StructField("access_until", S, True),
    ]
)
# A malformed line of a sheet, kept whole beside what could be read of it.
MALFORMED = "_malformed"

# The stored ACL mapping table.
ACL_MAPPING = StructType(
    [
        StructField("acl_id", LongType(), True),
        StructField("object_type", S, True),
        StructField("user_group", S, True),
        StructField("tag_values", S, True),
        StructField("schema_names", S, True),
        StructField("table_names", S, True),
        StructField("permission_types", S, True),
        StructField("grant_type", S, True),
        StructField("access_until", DateType(), True),
        StructField("bu", S, True),
        StructField("processed_datetime", TimestampType(), True),
        StructField("updated_datetime", TimestampType(), True),
    ]
)

SCHEMA_TAGS = StructType(
    [
        StructField("catalog_name", S, True),
        StructField("schema_name", S, True),
        StructField("tag_name", S, True),
        StructField("tag_value", S, True),
    ]
)

PERMISSION_MAPPING = StructType(
    [
        StructField("env", S, False),
        StructField("permission_group", S, False),
        StructField("privileges", ArrayType(S, False), False),
    ]
)

CATALOG_MAPPING = StructType(
    [
        StructField("env", S, False),
        StructField("prefix", S, False),
        StructField("catalog", S, True),
    ]
)

ENV_MAP = StructType([StructField("workspace_id", S, False), StructField("env", S, True)])

STATEMENTS = StructType(
    [
        StructField("acl_id", LongType(), True),
        StructField("source", S, True),
        StructField("object_type", S, True),
        StructField("object_name", S, True),
        StructField("user_group", S, True),
        StructField("privilege", S, True),
        StructField("grant_type", S, True),
        StructField("tag_values", S, True),
        StructField("access_statement", S, True),
    ]
)



MASK_RULES = StructType(
    [
        StructField("rule_id", LongType(), True),
        StructField("table_name", S, True),
        StructField("column_name", S, True),
        StructField("user_group", ArrayType(S, True), True),
        StructField("type_of_masking", S, True),
        StructField("drop_existing", BooleanType(), True),
    ]
)

# Masks in force; ``masks.state`` gives the same with the rule that made each.
EXISTING_MASKS = StructType(
    [
        StructField("full_table_name", S, True),
        StructField("column_name", S, True),
        StructField("user_group", ArrayType(S, True), True),
        StructField("type_of_masking", S, True),
    ]
)

TAG_RULES = StructType(
    [
        StructField("rule_ord", LongType(), False),
        StructField("level", S, False),
        StructField("action", S, True),
        StructField("schemas", ArrayType(S, True), True),
        StructField("tables", ArrayType(S, True), True),
        StructField("tags", MapType(S, S, True), True),
    ]
)

OBJECT_TAGS = StructType(
    [
        StructField("level", S, False),
        StructField("target", S, False),
        StructField("tag_name", S, False),
        StructField("tag_value", S, True),
    ]
)



MEMBERSHIPS = StructType([StructField("user_name", S, False), StructField("user_group", S, False)])

__all__ = [n for n in dir() if n.isupper()] + ["IntegerType"]
