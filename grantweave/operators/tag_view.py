"""Tag resolution as a maintained view: only what changed is joined.

Three stored relations.  ``keys`` (tag_key, n_rules) are the distinct tag lists of
all rules, ``items`` (tag, object_name, n) the comma items of all stored tag
values, and ``pairs`` (tag_key, object_name, support) is their join, where support
counts the ways in which the list meets the object.  With signed changes of
rules and stored tags, the join of sums gives

    pairs' = pairs without vanished keys + new keys x items + keys' x changed items

so a pair goes when its last support does, and is never looked for again.  Each
join has a change on its smaller side, which Catalyst may broadcast by its
size; a stored relation is read, never shuffled, while the changes are small.
The pairs of one rule are its list's pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantweave.operators.resolve import salts_of, stored_tag_items, to_rules
from grantweave.session import materialize


@dataclass
class TagView:
    keys: DataFrame
    items: DataFrame
    pairs: DataFrame


def _lists(keys: DataFrame) -> DataFrame:
    """(tag_key, tag): the distinct items of each list."""
    return keys.select("tag_key", F.explode(F.array_distinct(F.split("tag_key", ","))).alias("tag"))


def key_changes(rule_changes: DataFrame) -> DataFrame:
    """(tag_key, d) from changed rules (tag_values, sign), those without tags left out."""
    tagged = rule_changes.filter(F.col("tag_values").isNotNull())
    return tagged.groupBy(F.col("tag_values").alias("tag_key")).agg(F.sum("sign").alias("d")).filter("d <> 0")


def item_changes(tag_changes: DataFrame) -> DataFrame:
    """(tag, object_name, d) from changed stored tags (``SCHEMA_TAGS`` columns and sign)."""
    parts = [stored_tag_items(tag_changes.filter(F.col("sign") == s)).withColumn("sign", F.lit(s)) for s in (1, -1)]
    return parts[0].unionByName(parts[1]).groupBy("tag", "object_name").agg(F.sum("sign").alias("d")).filter("d <> 0")


def _moved(stored: DataFrame, changes: DataFrame, by: list[str], n: str) -> DataFrame:
    """``stored`` with the changes (by, d) added to its count ``n``; rows whose count ends are gone."""
    kept = stored.join(changes, by, "left").select(*by, (F.col(n) + F.coalesce("d", F.lit(0))).alias(n))
    met = stored.join(changes.select(*by), by, "left_semi").select(*by)
    new = changes.join(met, by, "left_anti").select(*by, F.col("d").alias(n))
    return kept.unionByName(new).filter(F.col(n) > 0)


def empty(rules: DataFrame) -> TagView:
    """The view of no rules and no tags."""
    spark = rules.sparkSession
    make = lambda ddl: spark.createDataFrame([], ddl)
    return TagView(make("tag_key string, n_rules long"), make("tag string, object_name string, n long"), make("tag_key string, object_name string, support long"))


def build(rules: DataFrame, schema_tags: DataFrame) -> TagView:
    """The view of all rules (tag_values) and stored tags: everything is a change of nothing."""
    one = F.lit(1).alias("sign")
    return refresh(empty(rules), rules.select("tag_values", one), schema_tags.select("*", one))


def refresh(view: TagView, rule_changes: DataFrame, tag_changes: DataFrame) -> TagView:
    """The view after signed changes; both are slim and stored once, as every part reads them."""
    dk = materialize(key_changes(rule_changes), "tag_view")
    dt = materialize(item_changes(tag_changes), "tag_view")
    before = view.keys.join(dk, "tag_key").select("tag_key", F.col("n_rules").alias("had"), "d")
    before = materialize(before, "tag_view")
    new_keys = dk.join(before, "tag_key", "left_anti").filter("d > 0").select("tag_key")
    gone = before.filter("had + d <= 0").select("tag_key")
    keys = materialize(_moved(view.keys, dk, ["tag_key"], "n_rules"), "tag_view")

    of_new = _lists(new_keys).join(view.items, "tag").select("tag_key", "object_name", F.col("n").alias("d"))
    of_changed = _lists(keys).join(dt, "tag").select("tag_key", "object_name", "d")
    dp = of_new.unionByName(of_changed).groupBy("tag_key", "object_name").agg(F.sum("d").alias("d")).filter("d <> 0")
    dp = materialize(dp, "tag_view")
    left = view.pairs.join(gone, "tag_key", "left_anti")
    pairs = materialize(_moved(left, dp, ["tag_key", "object_name"], "support"), "tag_view")
    return TagView(keys, materialize(_moved(view.items, dt, ["tag", "object_name"], "n"), "tag_view"), pairs)


def rule_objects(view: TagView, rules: DataFrame) -> DataFrame:
    """(acl_id, object_name) of tagged rules, as ``resolve.resolve_tags`` gives them."""
    keys = view.keys.select("tag_key", salts_of(F.col("n_rules")))
    pairs = view.pairs.join(keys, "tag_key").select("tag_key", "salts", "object_name")
    tagged = rules.filter(F.col("tag_values").isNotNull()).select("acl_id", F.col("tag_values").alias("tag_key"))
    return to_rules(tagged, keys, pairs).select("acl_id", "object_name")
