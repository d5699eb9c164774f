"""Inputs derived from the generated test tables (see FIXTURES.md).

Every fixture is a Spark plan over ``{sf_dir}/{table}.parquet``, so its size
grows with the scale factor; nothing here is built from literal rows except
the small configuration dictionaries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grantweave import schemas
from grantweave.sources import config
from grantweave.sources.literal import literal_frame

ENV = "dev"
BU = "BUILDING"
AS_OF = "1998-01-01"
STAMP = "1998-01-01 00:00:00"

PERMISSIONS = {
    "dev": {
        "DATA_READER": ["USE SCHEMA", "SELECT", "READ VOLUME"],
        "DATA_WRITER": ["USE SCHEMA", "SELECT", "MODIFY"],
        "DATA_ADMIN": ["ALL PRIVILEGES"],
    }
}
CATALOGS = {"dev": {"raw": "dev_main_raw", "curated": "dev_main_curated"}}
ENV_MAP = {"100": "dev", "101": "test", "102": "prod"}

def _mask_rule(rule_id, table_name, column_name, user_group, type_of_masking="****", drop_existing=False):
    return dict(rule_id=rule_id, table_name=table_name, column_name=column_name, user_group=user_group,
                type_of_masking=type_of_masking, drop_existing=drop_existing)


_CUSTOMER = "raw.crm.customer"
MASK_RULES = [
    _mask_rule(1, _CUSTOMER, "c_name", ["grp_1", "grp_2"]),
    _mask_rule(2, "raw.crm.supplier", "s_name", ["grp_3"], "HIDDEN"),
    _mask_rule(3, _CUSTOMER, "c_mktsegment", ["grp_1"], drop_existing=True),
    _mask_rule(4, "raw.customer", "c_name", ["grp_1"]),
    _mask_rule(5, "nomap.crm.customer", "c_name", ["grp_1"]),
    _mask_rule(6, _CUSTOMER, "c_acctbal", []),
    _mask_rule(7, _CUSTOMER, "C_NAME", ["grp_3"], "LATER"),  # a mask is in force: skipped
    _mask_rule(8, _CUSTOMER, "c_mktsegment", ["grp_1"], "####"),
    _mask_rule(9, _CUSTOMER, "c_mktsegment", ["grp_1"], drop_existing=True),
    _mask_rule(10, "raw.crm.CUSTOMER", "C_MKTSEGMENT", ["grp_3"], "SEG"),  # made again after the drop
    _mask_rule(11, _CUSTOMER, "c_acctbal", ["grp_3"], "1"),  # in force before: skipped
    _mask_rule(12, _CUSTOMER, "c_nationkey", ["grp_1"]),
    _mask_rule(13, _CUSTOMER, "c_nationkey", ["grp_1"], drop_existing=True),
    _mask_rule(14, _CUSTOMER, "no_such_column", ["grp_1"]),
    _mask_rule(15, _CUSTOMER, None, ["grp_1"]),
]
EXISTING_MASKS = [
    ("dev_main_raw.crm.supplier", "s_name", ["grp_3"], "HIDDEN"),
    ("dev_main_raw.crm.Customer", "c_acctbal", ["grp_9"], "0"),
]
READERS = ["Customer#000000001", "Customer#000000004"]


_READS: dict[tuple[str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; the read (file listing, footer schema) is reused per
    application, as the tables are read-only."""
    path = f"{sf_dir}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _READS:
        _READS[key] = spark.read.parquet(path)
    return _READS[key]


def _s(c: Column) -> Column:
    return c.cast("string")


# The mapping fixture's columns as SQL expressions (FIXTURES.md section 1);
# one selectExpr keeps the driver-side plan construction to a few calls.
_SHEET_EXPRS = [
    "o_orderkey AS acl_id",
    """CASE WHEN o_orderkey % 10 < 4 THEN 'SCHEMA' WHEN o_orderkey % 10 < 8 THEN 'TABLE'
       WHEN o_orderkey % 10 = 8 THEN 'VOLUME' ELSE 'SCHEMA' END AS object_type""",
    """CASE WHEN o_custkey % 3 = 0 THEN concat('grp_', CAST(o_custkey % 40 AS STRING), ' , grp_',
       CAST((o_custkey + 7) % 40 AS STRING), ',')
       ELSE concat('grp_', CAST(o_custkey % 40 AS STRING)) END AS user_group""",
    """CASE WHEN o_orderkey % 10 IN (0, 9) THEN concat('Brand#', CAST(o_custkey % 30 AS STRING),
       CASE WHEN o_custkey % 2 = 0 THEN ' , SMALL' ELSE '' END) END AS tag_values""",
    """CASE WHEN o_orderkey % 10 IN (1, 2) THEN concat('raw.s', CAST(o_custkey % 50 AS STRING))
       WHEN o_orderkey % 10 = 3 THEN concat('raw.s', CAST(o_custkey % 50 AS STRING), ', curated.s',
       CAST(o_custkey % 20 AS STRING), ',bad,nomap.s1') END AS schema_names""",
    """CASE WHEN o_orderkey % 10 IN (4, 5, 8) THEN concat('raw.s', CAST(o_custkey % 50 AS STRING), '.t',
       CAST(o_custkey % 9 AS STRING))
       WHEN o_orderkey % 10 IN (6, 7) THEN concat('raw.s1.t', CAST(o_custkey % 9 AS STRING), ', curated.s2.t',
       CAST(o_custkey % 7 AS STRING), ',raw.only_two') END AS table_names""",
    """CASE o_orderpriority WHEN '1-URGENT' THEN 'DATA_ADMIN' WHEN '2-HIGH' THEN 'DATA_WRITER'
       WHEN '4-NOT SPECIFIED' THEN 'UNMAPPED' ELSE 'DATA_READER' END AS permission_types""",
    "CASE WHEN o_orderstatus = 'P' THEN 'REVOKE' ELSE 'GRANT' END AS grant_type",
    "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS access_until",
    "c_mktsegment AS bu",
]


def acl_mapping_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mapping as a sheet would hold it (access_until as text, with bu)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).selectExpr(*_SHEET_EXPRS)


def acl_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored mapping table (engine schema, fixed stamps)."""
    return acl_mapping_sheet(spark, sf_dir).selectExpr(
        "* EXCEPT (access_until)",
        "try_to_date(access_until) AS access_until",
        f"CAST('{STAMP}' AS TIMESTAMP) AS processed_datetime",
        "CAST(NULL AS TIMESTAMP) AS updated_datetime",
    ).select(*[f.name for f in schemas.ACL_MAPPING.fields])


# The same rules with what ingest and generation must cope with: null mandatory
# columns, types, object names and groups that no statement can hold, references
# that try to say more than a name, tags on TABLE rules.
_ROUGH_EXPRS = [
    "acl_id",
    "CASE WHEN acl_id % 31 = 0 THEN NULL WHEN acl_id % 59 = 0 THEN 'MATERIALIZED VIEW' ELSE object_type END AS object_type",
    "CASE WHEN acl_id % 41 = 0 THEN NULL WHEN acl_id % 43 = 0 THEN 'grp_1, bad`grp' ELSE user_group END AS user_group",
    "CASE WHEN acl_id % 47 = 0 THEN 'Brand#12' ELSE tag_values END AS tag_values",
    """CASE WHEN acl_id % 61 = 0 THEN 'raw.s1 TO `grp_admin` , raw.s2' WHEN acl_id % 29 = 0 THEN 'raw.s-5, raw.s1, curated.s3'
       ELSE schema_names END AS schema_names""",
    """CASE WHEN acl_id % 67 = 0 THEN 'raw.s1.t1 TO `grp_admin` ' WHEN acl_id % 23 = 0 THEN 'raw.s1.t1, curated.s2.t3'
       ELSE table_names END AS table_names""",
    "CASE WHEN acl_id % 37 = 0 THEN NULL ELSE permission_types END AS permission_types",
    "grant_type", "access_until", "bu", "processed_datetime", "updated_datetime",
]

# A later sheet of every unit: changed groups, null keys, and one key that many rows share.
_INCOMING_EXPRS = [
    "acl_id + 100000000 AS acl_id",
    "CASE WHEN acl_id % 31 = 0 THEN NULL WHEN acl_id % 17 = 0 THEN 'SCHEMA' ELSE object_type END AS object_type",
    "CASE WHEN acl_id % 17 = 0 THEN 'grp_dup' WHEN acl_id % 3 = 0 THEN concat(user_group, '_n') ELSE user_group END AS user_group",
    "CASE WHEN acl_id % 17 = 0 THEN 'X' ELSE tag_values END AS tag_values",
    "CASE WHEN acl_id % 17 = 0 THEN NULL ELSE schema_names END AS schema_names",
    "CASE WHEN acl_id % 17 = 0 THEN NULL ELSE table_names END AS table_names",
    "CASE WHEN acl_id % 17 = 0 THEN 'DATA_READER' ELSE permission_types END AS permission_types",
    "CASE WHEN acl_id % 17 = 0 THEN 'GRANT' ELSE grant_type END AS grant_type",
    "CASE WHEN acl_id % 17 = 0 THEN NULL ELSE access_until END AS access_until",
    "bu",
]


def acl_mapping_rough(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acl_mapping(spark, sf_dir).selectExpr(*_ROUGH_EXPRS)


def incoming_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule once more, as a later sheet has it (engine shape)."""
    return acl_mapping(spark, sf_dir).selectExpr(*_INCOMING_EXPRS, "processed_datetime", "updated_datetime")


def incoming_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The later sheet as text, with ends that are no dates."""
    sheet = acl_mapping_sheet(spark, sf_dir).selectExpr(*_INCOMING_EXPRS)
    end = "CASE WHEN acl_id % 19 = 0 THEN '31/12/1999' WHEN acl_id % 53 = 0 THEN '1999' ELSE access_until END"
    return sheet.withColumn("access_until", F.expr(end))


def catalog_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects that the platform's catalog has (column ``object_name``)."""
    p = table(spark, sf_dir, "part").select("p_partkey")
    k = F.col("p_partkey")
    cat = F.when(k % 2 == 0, "dev_main_raw").otherwise("dev_main_curated")
    schema = F.concat(cat, F.lit(".s"), _s(k % 45))
    tbl = F.concat(F.when(k % 3 == 0, "dev_main_curated").otherwise("dev_main_raw"), F.lit(".s"), _s(k % 50), F.lit(".t"), _s(k % 9))
    return p.select(F.explode(F.array(schema, tbl)).alias("object_name")).distinct()


def stored_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of effective grants before this run."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    k = F.col("p_partkey")
    return p.select(
        F.when(F.col("p_size") % 3 == 0, "USE SCHEMA").otherwise("SELECT").alias("privilege"),
        F.lit("SCHEMA").alias("object_type"),
        F.concat(F.lit("dev_main_raw.s"), _s(k % 200)).alias("object_name"),
        F.concat(F.lit("grp_"), _s(k % 40)).alias("user_group"),
    ).distinct()


def schema_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    k = F.col("p_partkey")
    return p.select(
        F.when(k % 2 == 0, "dev_main_raw").otherwise("dev_main_curated").alias("catalog_name"),
        F.concat(F.lit("s"), _s(k % 200)).alias("schema_name"),
        F.when(F.col("p_size") % 2 == 0, "domain").otherwise("tier").alias("tag_name"),
        F.when(F.col("p_size") % 5 == 0, F.concat("p_brand", F.lit(", "), "p_type"))
        .otherwise(F.concat("p_brand", F.lit(","), "p_type")).alias("tag_value"),
    ).distinct()


def schema_tags_rough(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored tags with schemas whose name no statement can hold, or tries to say more."""
    n = F.regexp_extract("schema_name", "[0-9]+", 0).cast("int")
    name = F.when(n % 19 == 0, F.concat("schema_name", F.lit("-x"))).when(n % 23 == 0, F.concat("schema_name", F.lit(" TO `grp_admin`")))
    return schema_tags(spark, sf_dir).withColumn("schema_name", F.coalesce(name, "schema_name"))


def _changed(rows: DataFrame, column: str, later: Column) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``column`` as it is later, and the signed rows that changed: the old ones out, the new ones in."""
    both = rows.withColumn("_later", later)
    moved = both.filter(~F.col(column).eqNullSafe(F.col("_later")))
    out = moved.drop("_later").withColumn("sign", F.lit(-1))
    into = moved.withColumn(column, F.col("_later")).drop("_later").withColumn("sign", F.lit(1))
    return both.withColumn(column, F.col("_later")).drop("_later"), out.unionByName(into)


def later_tags(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rules (acl_id, tag_values) some of which lost, gained or changed their tags, and the changes."""
    k = F.col("acl_id")
    later = F.when(k % 7 == 0, F.lit(None)).when(k % 11 == 0, F.lit("LARGE,Brand#13")).when(k % 13 == 0, F.lit("Brand#999"))
    return _changed(rules, "tag_values", later.when(k % 17 == 0, F.concat("tag_values", F.lit(",ECONOMY"))).otherwise(F.col("tag_values")))


def later_schema_tags(stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored tags some of which are gone or changed, and the changes."""
    n = F.regexp_extract("schema_name", "[0-9]+", 0).cast("int")
    later = F.when(n % 5 == 0, F.concat(F.lit("LARGE,"), F.col("tag_value"))).when(n % 7 == 0, F.lit("Brand#13")).otherwise(F.col("tag_value"))
    return _changed(stored, "tag_value", later)


def tag_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag rules in engine shape: one or two schemas, tables and tags, missing
    tag values, and rules whose tags are no map (null)."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size", "p_brand")
    k = F.col("p_partkey")
    level = F.when(F.col("p_size") % 2 == 0, "SCHEMA").otherwise("TABLE")
    schema, tbl = F.concat(F.lit("xxx_main_raw.s"), _s(k % 50)), F.concat(F.lit("t"), _s(k % 9))
    one = F.create_map(F.when(k % 3 == 0, "domain").otherwise("tier"), F.col("p_type"))
    two = F.map_concat(one, F.create_map(F.lit("owner"), F.when(k % 12 != 0, F.col("p_brand"))))
    return p.select(
        k.alias("rule_ord"),
        level.alias("level"),
        F.when(k % 4 == 0, "unset").when(k % 11 == 0, "drop").otherwise("Set").alias("action"),
        F.when(k % 5 == 0, F.array(schema, F.lit("xxx_main_curated.s1"))).otherwise(F.array(schema)).alias("schemas"),
        F.when(level == "TABLE", F.when(k % 7 == 0, F.array(tbl, F.lit("tx"))).otherwise(F.array(tbl))).alias("tables"),
        F.when(k % 13 != 0, F.when(k % 6 == 0, two).otherwise(one)).alias("tags"),
    )


def tag_rule_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tag rules as JSON lines: scalars beside lists, and text where a map should be."""
    r = tag_rules(spark, sf_dir)
    full = F.to_json(F.struct("rule_ord", "level", "action", "schemas", "tables", "tags"), {"ignoreNullFields": "false"})
    scalar = F.to_json(F.struct("rule_ord", "level", "action", F.element_at("schemas", 1).alias("schemas"), "tables", "tags"))
    wrong = F.to_json(F.struct("rule_ord", "level", "action", "schemas", "tables", F.lit("not a map").alias("tags")))
    line = F.when(F.col("tags").isNull(), wrong).when(F.size("schemas") == 1, scalar).otherwise(full)
    return r.select(line.alias("value"))


def object_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Existing tag state: one value per (schema, tag name), level SCHEMA."""
    st = schema_tags(spark, sf_dir)
    return st.groupBy(F.concat("catalog_name", F.lit("."), "schema_name").alias("target"), "tag_name").agg(
        F.min("tag_value").alias("tag_value")
    ).select(F.lit("SCHEMA").alias("level"), "target", "tag_name", "tag_value")


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_name", "c_custkey")
    return c.select(
        F.col("c_name").alias("user_name"), F.concat(F.lit("grp_"), _s(F.col("c_custkey") % 40)).alias("user_group")
    )


def workspace_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    return e.select(
        "event_id",
        F.when(F.col("event_id") % 7 == 0, F.lit("https://nohost.example.net"))
        .otherwise(F.concat(F.lit("https://adb-"), _s(100 + F.col("user_id") % 5), F.lit(".3.example.net")))
        .alias("url"),
    )


def tracking_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    k = F.col("o_orderkey")
    even = k % 2 == 0
    return o.select(
        k.alias("ord"),
        F.when(even, "SCHEMA").otherwise("TABLE").alias("object_type"),
        F.concat(F.lit("dev_main_raw.s"), _s(F.col("o_custkey") % 50), F.when(even, F.lit("")).otherwise(F.lit(".t1")))
        .alias("object_name"),
    )


def mask_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The literal rules plus one generated rule per supplier.

    Generated rules target ``raw.crm.t{n}`` / ``curated.app.t{n}`` tables with
    a mix of bad refs, unmapped prefixes, missing groups and drops, so the
    plan's work grows with the data.
    """
    lit_rules = config.mask_rules(spark, MASK_RULES)
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    k = F.col("s_suppkey")
    gen = s.select(
        (k + 1000).alias("rule_id"),
        F.when(k % 13 == 0, F.concat(F.lit("raw.t"), _s(k % 50)))
        .when(k % 17 == 0, F.concat(F.lit("nomap.app.t"), _s(k % 50)))
        .when(k % 2 == 0, F.concat(F.lit("raw.crm.t"), _s(k % 50)))
        .otherwise(F.concat(F.lit("curated.app.t"), _s(k % 50))).alias("table_name"),
        F.concat(F.lit("col-"), _s(F.col("s_nationkey"))).alias("column_name"),
        F.when(k % 11 == 0, F.array().cast("array<string>"))
        .otherwise(F.array(F.concat(F.lit("grp_"), _s(k % 40)), F.concat(F.lit("grp_"), _s((k + 3) % 40))))
        .alias("user_group"),
        F.when(k % 3 == 0, F.lit("HIDDEN")).otherwise(F.lit("****")).alias("type_of_masking"),
        (k % 10 == 0).alias("drop_existing"),
    )
    return lit_rules.unionByName(gen)


def existing_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks in force before the first rule: the literal ones and one per (table, column) of all suppliers."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    k = F.col("s_suppkey")
    gen = s.groupBy(
        F.concat(F.lit("dev_main_raw.crm.t"), _s(k % 12)).alias("full_table_name"),
        F.concat(F.lit("COL-"), _s(F.col("s_nationkey"))).alias("column_name"),
    ).agg(
        F.array(F.concat(F.lit("grp_"), _s(F.min(k) % 40))).alias("user_group"),
        F.lit("OLD").alias("type_of_masking"),
    )
    literal = literal_frame(spark, EXISTING_MASKS, schemas.EXISTING_MASKS)
    return literal.unionByName(gen)


_DIMS: dict[tuple[str, str], DataFrame] = {}


def _dim(spark: SparkSession, name: str, build) -> DataFrame:
    key = (spark.sparkContext.applicationId, name)
    if key not in _DIMS:
        _DIMS[key] = build()
    return _DIMS[key]


def permission_mapping(spark: SparkSession) -> DataFrame:
    return _dim(spark, "permission_mapping", lambda: config.permission_mapping(spark, PERMISSIONS))


def catalog_mapping(spark: SparkSession) -> DataFrame:
    return _dim(spark, "catalog_mapping", lambda: config.catalog_mapping(spark, CATALOGS))


def env_map(spark: SparkSession) -> DataFrame:
    return _dim(spark, "env_map", lambda: config.env_map(spark, ENV_MAP))
