"""Resolve a rule's tags, schema refs and table refs to catalog objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantweave.functions import broadcast_if_literal, dotted, fits_name, present
from grantweave.session import materialize

SOURCE_TAG, SOURCE_SCHEMA, SOURCE_TABLE = "tag", "schema", "table"
STATUS_OK = "ok"
STATUS_BAD_SCHEMA = "schema ref not 2 parts"
STATUS_BAD_TABLE = "table ref not 3 parts"
STATUS_NO_PREFIX = "prefix not mapped"
STATUS_BAD_NAME = "object name outside the statement grammar"

# Rules that share a tag list and are joined to its objects by one task.
RULES_PER_SALT = 1_000
# Distinct tag lists that share an item and are joined to its objects by one task.
LISTS_PER_SALT = 100

_REF_T = "array<struct<source:string,pos:int,ref:string,want:int>>"


def stored_tag_items(schema_tags: DataFrame, fits: bool = True) -> DataFrame:
    """(tag, object_name): one row per comma item of each stored tag value.

    Stored items are not stripped: ``'a, b'`` holds ``'a'`` and ``' b'``.  Only
    objects whose name the statement grammar can hold; the others with ``fits``
    False (they are rejects).
    """
    named = schema_tags.select("tag_value", F.concat(F.col("catalog_name"), F.lit("."), F.col("schema_name")).alias("object_name"))
    named = named.filter(fits_name("object_name") if fits else ~fits_name("object_name"))
    return named.select(F.explode(F.split("tag_value", ",")).alias("tag"), "object_name")


def fanout_partitions(spark) -> int:
    """Partitions for a fan-out stage: the session's shuffle partition count."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        return max(n, spark.sparkContext.defaultParallelism)
    except Exception:  # no SparkContext on this client (e.g. Spark Connect)
        return n


def tag_lists(tag_keys: DataFrame) -> DataFrame:
    """One row per item of each distinct tag key, with ``item_salts``: the tasks its lists are dealt to.

    Stored once: the lists are slim, and both sides of the item join read them.
    """
    wanted = tag_keys.select("*", F.explode(F.array_distinct(F.split("tag_key", ","))).alias("tag"))
    n = wanted.groupBy("tag").agg(F.ceil(F.count("*") / F.lit(LISTS_PER_SALT)).cast("int").alias("item_salts"))
    return materialize(wanted.join(n, "tag"), "tag_lists")


def tag_key_pairs(tag_keys: DataFrame, schema_tags: DataFrame, fits: bool = True) -> DataFrame:
    """(*tag_keys, object_name) of each item that a key shares with a stored value, before they are made distinct.

    A tag key is the rule's stripped tags joined with ','; a schema matches
    when any of the key's items equals any item of a stored tag value (OR over
    the rule's tags).  The containment test becomes an equi-join on the item,
    so one shuffle join serves every rule instead of one query per rule.

    An item in n lists and m stored values makes n x m pairs.  The lists of an
    item that more than ``LISTS_PER_SALT`` hold are dealt to several salts by
    their hash, and the item's objects repeated for each.
    """
    lists = tag_lists(tag_keys)
    parts = fanout_partitions(tag_keys.sparkSession)  # a stated count: pairs, not input bytes, size these tasks
    salt = F.pmod(F.xxhash64("tag_key"), F.col("item_salts")).cast("int").alias("item_salt")
    dealt = lists.select(*tag_keys.columns, "tag", salt).repartition(parts, "tag", "item_salt")
    hot = lists.filter("item_salts > 1").select("tag", "item_salts").distinct()
    of_item = F.explode(F.sequence(F.lit(0), F.coalesce("item_salts", F.lit(1)) - 1)).alias("item_salt")
    items = stored_tag_items(schema_tags, fits).join(hot, "tag", "left").select("tag", "object_name", of_item)
    pairs = dealt.join(items.repartition(parts, "tag", "item_salt"), ["tag", "item_salt"])
    return pairs.select(*tag_keys.columns, "object_name")


def resolve_tag_keys(tag_keys: DataFrame, schema_tags: DataFrame, fits: bool = True) -> DataFrame:
    """Distinct pairs of :func:`tag_key_pairs`, with the other columns of ``tag_keys`` (unique per key)."""
    return tag_key_pairs(tag_keys, schema_tags, fits).distinct()


def salts_of(n_rules: Column) -> Column:
    """``salts``: the tasks that the rules of one list are dealt to."""
    return F.ceil(n_rules / F.lit(RULES_PER_SALT)).cast("int").alias("salts")


def to_rules(tagged: DataFrame, keys: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rules (acl_id, tag_key, ...) joined to the objects of their list: ``pairs`` (tag_key, salts, object_name).

    ``keys`` (tag_key, salts) say how many tasks a list's rules are dealt to;
    its objects are repeated for each.
    """
    repeated = pairs.select("tag_key", "object_name", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    shared = tagged.join(keys.filter("salts > 1"), "tag_key", "left")
    salt = F.coalesce(F.pmod(F.xxhash64("acl_id"), F.col("salts")), F.lit(0)).cast("int").alias("salt")
    parts = fanout_partitions(tagged.sparkSession)  # a stated count: pairs, not input bytes, size these tasks
    dealt = shared.select(*tagged.columns, salt).repartition(parts, "tag_key", "salt")
    return dealt.join(repeated.repartition(parts, "tag_key", "salt"), ["tag_key", "salt"])


def resolve_tags(rules: DataFrame, schema_tags: DataFrame, keep: list[str] | None = None, fits: bool = True) -> DataFrame:
    """Tag objects per rule: (acl_id, *keep, object_name), distinct per rule.

    Rules are first reduced to their distinct tag keys, resolved once per key
    and joined back, so many rules sharing a tag list cost one resolution.

    The join back makes n rules x m objects of a key, which AQE cannot see in
    its small input.  The rules of a list that more than ``RULES_PER_SALT`` share
    are therefore dealt to several salts and the list's objects (the catalog's
    schemas at most) repeated for each; the counts come with the distinct keys,
    which are stored once.
    """
    keep = keep or []
    held = [c for c in keep if c != "tag_values"]
    tagged = rules.filter(F.col("tags").isNotNull()).select("acl_id", *held, F.col("tag_values").alias("tag_key"))
    keys = materialize(tagged.groupBy("tag_key").agg(salts_of(F.count("*"))), "tag_keys")
    pairs = to_rules(tagged, keys, resolve_tag_keys(keys, schema_tags, fits))
    return pairs.select("acl_id", *[F.col("tag_key").alias(c) if c == "tag_values" else F.col(c) for c in keep], "object_name")


def _ref_items(source: str, refs: str, want: int) -> Column:
    one = lambda x, i: F.struct(F.lit(source).alias("source"), i.alias("pos"), x.alias("ref"), F.lit(want).alias("want"))
    return F.coalesce(F.transform(refs, one), F.array().cast(_REF_T))


def all_refs() -> Column:
    """Every schema and table ref of a rule as structs (source, pos, ref, want: its number of parts)."""
    return F.concat(_ref_items(SOURCE_SCHEMA, "schema_refs", 2), _ref_items(SOURCE_TABLE, "table_refs", 3))


def with_status(refs: DataFrame, catalog_mapping: DataFrame, env: str) -> DataFrame:
    """Rows of refs (source, ref, want) with ``object_name`` (null unless ok) and ``status``."""
    refs = refs.withColumn("_parts", dotted("ref"))
    cat = catalog_mapping.filter((F.col("env") == F.lit(env)) & present("catalog")).select(
        F.col("prefix").alias("_prefix"), F.col("catalog").alias("_catalog")
    )
    joined = refs.join(broadcast_if_literal(cat, made_from=catalog_mapping), F.get(F.col("_parts"), 0) == F.col("_prefix"), "left")
    shape_ok = F.size("_parts") == F.col("want")
    name = F.concat(F.col("_catalog"), F.lit("."), F.array_join(F.slice("_parts", 2, F.greatest(F.size("_parts") - 1, F.lit(0))), "."))
    status = (
        F.when(~shape_ok & (F.col("source") == SOURCE_SCHEMA), F.lit(STATUS_BAD_SCHEMA))
        .when(~shape_ok, F.lit(STATUS_BAD_TABLE))
        .when(F.col("_catalog").isNull(), F.lit(STATUS_NO_PREFIX))
        .when(~fits_name(name), F.lit(STATUS_BAD_NAME))
        .otherwise(F.lit(STATUS_OK))
    )
    named = joined.withColumn("status", status).withColumn("object_name", F.when(F.col("status") == STATUS_OK, name))
    return named.drop("_parts", "_prefix", "_catalog")


def resolve_refs(rules: DataFrame, catalog_mapping: DataFrame, env: str, keep: list[str] | None = None) -> DataFrame:
    """Every schema/table ref of every rule with its resolution status.

    Output: acl_id, *keep, source, pos, ref, object_name (null unless ok),
    status.  A schema ref needs exactly 2 dot parts and a table ref 3; the
    first part is a prefix looked up in the env's catalog map; the resulting
    name must be one that the statement grammar can hold, so that no reference
    can say more than an object's name.
    """
    refs = rules.select("acl_id", *(keep or []), F.inline(all_refs()))
    return with_status(refs, catalog_mapping, env).select("acl_id", *(keep or []), "source", "pos", "ref", "object_name", "status")


def resolve_objects(
    rules: DataFrame, schema_tags: DataFrame, catalog_mapping: DataFrame, env: str, keep: list[str] | None = None
) -> DataFrame:
    """Union of the three object sources per rule; duplicates kept.

    Output: acl_id, *keep, source, pos (null for tags), object_name.
    """
    keep = keep or []
    tags = resolve_tags(rules, schema_tags, keep).select(
        "acl_id", *keep, F.lit(SOURCE_TAG).alias("source"), F.lit(None).cast("int").alias("pos"), "object_name"
    )
    # a rule's refs expand to many statements: slim rules are dealt, so that their expansion needs no shuffle
    dealt = rules.repartition(fanout_partitions(rules.sparkSession), "acl_id")
    refs = resolve_refs(dealt, catalog_mapping, env, keep).filter(F.col("status") == STATUS_OK)
    return tags.unionByName(refs.select("acl_id", *keep, "source", "pos", "object_name"))
