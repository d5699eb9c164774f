"""Column masks: rule plan, mask state and masked projections of a table.

A mask belongs to a (table, column), compared without regard to case.  Rules
are a sequence of changes in ``rule_id`` order: a create makes a mask only
where none is in force, a drop removes it, and a create after a drop makes a
new one.  ``plan`` says what each rule does, ``state`` what is in force after
all of them, and the projections show a column raw only if no mask is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grantweave.functions import broadcast_if_literal, dotted, mask_function_name, present
from grantweave.operators.resolve import fanout_partitions
from grantweave.session import materialize
from grantweave.sources.config import DEFAULT_MASK

ACTION_REJECT, ACTION_DROP, ACTION_SKIP, ACTION_CREATE = "REJECT", "DROP", "SKIP", "CREATE"
REASON_BAD_REF = "mask ref not 3 parts"
REASON_NO_PREFIX = "prefix not mapped"
REASON_NO_COLUMN = "mask without column"
REASON_NO_GROUP = "mask without group"
REASON_EXISTS = "mask exists"
REASON_UNKNOWN_COLUMN = "column not in table"
_KEY = ["_table_key", "_column_key"]


def _resolved(mask_rules: DataFrame, catalog_mapping: DataFrame, env: str) -> DataFrame:
    """Rules with full table name, key and reject reason (checked in the reference's order)."""
    parts = dotted("table_name")
    cat = catalog_mapping.filter((F.col("env") == F.lit(env)) & present("catalog")).select(
        F.col("prefix").alias("_prefix"), "catalog"
    )
    r = mask_rules.join(broadcast_if_literal(cat, made_from=catalog_mapping), F.get(parts, 0) == F.col("_prefix"), "left")
    schema, tbl = F.get(parts, 1), F.get(parts, 2)
    shape_ok = F.size(parts) == 3
    known = shape_ok & F.col("catalog").isNotNull()
    reason = (
        F.when(~shape_ok, REASON_BAD_REF)
        .when(F.col("catalog").isNull(), REASON_NO_PREFIX)
        .when(F.col("column_name").isNull(), REASON_NO_COLUMN)
        .when(F.col("user_group").isNull() | (F.size("user_group") == 0), REASON_NO_GROUP)
    )
    full = F.when(known, F.concat_ws(".", "catalog", schema, tbl))
    return r.select(
        "rule_id", "table_name", "column_name", "user_group",
        full.alias("full_table_name"),
        F.when(known, mask_function_name(tbl, F.col("column_name"))).alias("function_name"),
        F.coalesce("type_of_masking", F.lit(DEFAULT_MASK)).alias("type_of_masking"),
        F.coalesce("drop_existing", F.lit(False)).alias("_drop"),
        reason.alias("_reject"),
        F.lower(full).alias("_table_key"),
        F.lower("column_name").alias("_column_key"),
    )


def _in_force(existing_masks: DataFrame) -> DataFrame:
    """The masks in force before, one per key."""
    return existing_masks.select(
        F.lower("full_table_name").alias("_table_key"),
        F.lower("column_name").alias("_column_key"),
        F.struct("full_table_name", "column_name", "user_group", "type_of_masking").alias("_old"),
    ).groupBy(*_KEY).agg(F.min("_old").alias("_old"))


def ranged(resolved_rules: DataFrame) -> DataFrame:
    """Resolved rules with ``_range``, one of as many ranges of ``rule_id`` as fan-out tasks.

    Stored once: what is summed per range and what it is carried to must mean
    the same ranges.
    """
    parts = fanout_partitions(resolved_rules.sparkSession)
    cut = resolved_rules.repartitionByRange(parts, "rule_id").withColumn("_range", F.spark_partition_id())
    return materialize(cut, "mask_rules")


def carried(valid: DataFrame, existing_masks: DataFrame) -> DataFrame:
    """Per key and range of rules, whether a mask is in force when the range begins (``_there``).

    A rule is a function on {none, in force}: a create, whether it creates or
    skips, leaves a mask in force, a drop none.  Both are constant, so what a
    range does to a key is what its last rule does, whatever came before, and
    the carry into a range is the function of the last range before it that has
    rules of the key, or the state before all rules.
    """
    turn = F.struct("rule_id", "_drop")
    steps = valid.groupBy(*_KEY, "_range").agg((~F.max(turn)["_drop"]).alias("_makes"))
    before = F.lag("_makes").over(Window.partitionBy(*_KEY).orderBy("_range"))
    steps = steps.select(*_KEY, "_range", before.alias("_before"))
    old = _in_force(existing_masks)
    return steps.join(old, _KEY, "left").select(*_KEY, "_range", F.coalesce("_before", F.col("_old").isNotNull()).alias("_there"))


def plan(mask_rules: DataFrame, catalog_mapping: DataFrame, env: str, existing_masks: DataFrame) -> DataFrame:
    """What each mask rule does in its turn: REJECT, DROP, SKIP (a mask is in force) or CREATE.

    ``existing_masks`` (full_table_name, column_name, user_group,
    type_of_masking) are the masks in force before the first rule.  Rules of one
    id come creates first.  A parallel prefix over ranges of ``rule_id``: each
    range is summed per key, the sums (one slim row per key and range) give the
    carries, and inside a range a rule looks at the one before it.  So a column
    that any share of all rules concerns is spread over the ranges.  Rejected
    rules pass beside, so their missing keys never meet in one task.
    """
    r = ranged(_resolved(mask_rules, catalog_mapping, env))
    valid = r.filter(F.col("_reject").isNull())
    rules = valid.join(carried(valid, existing_masks), [*_KEY, "_range"])
    here = Window.partitionBy(*_KEY, "_range").orderBy("rule_id", "_drop")
    exists = F.coalesce(~F.lag("_drop").over(here), F.col("_there"))
    rules = rules.withColumn("_exists", exists)
    action = F.when(F.col("_drop"), ACTION_DROP).when(F.col("_exists"), ACTION_SKIP).otherwise(ACTION_CREATE)
    reason = F.when(~F.col("_drop") & F.col("_exists"), REASON_EXISTS)
    out = ["rule_id", "table_name", "column_name", "full_table_name", "function_name", "user_group", "type_of_masking"]
    rejected = r.filter(F.col("_reject").isNotNull())
    return rules.select(*out, action.alias("action"), reason.alias("reason")).unionByName(
        rejected.select(*out, F.lit(ACTION_REJECT).alias("action"), F.col("_reject").alias("reason"))
    )


def state(mask_rules: DataFrame, catalog_mapping: DataFrame, env: str, existing_masks: DataFrame) -> DataFrame:
    """Masks in force after all rules: one row per (table, column).

    The last drop of a key ends all masks before it; the first create after it
    (or, without a drop, the mask already there) holds.  Both are aggregates
    with partial sums, so a key with any number of rules stays spread.
    """
    r = _resolved(mask_rules, catalog_mapping, env).filter(F.col("_reject").isNull())
    dropped = r.filter("_drop").groupBy(*_KEY).agg(F.max("rule_id").alias("_dropped"))
    mask = F.struct("full_table_name", "column_name", "user_group", "type_of_masking")
    created = r.filter("not _drop").join(dropped, _KEY, "left").filter("_dropped is null or rule_id > _dropped")
    created = created.groupBy(*_KEY).agg(F.min(F.struct("rule_id", mask.alias("mask"))).alias("_first"))
    old = _in_force(existing_masks).join(dropped, _KEY, "left_anti")
    j = old.join(created, _KEY, "full_outer")
    return j.select(F.coalesce("_old", F.col("_first.mask")).alias("m"), F.col("_first.rule_id").alias("_rule"), "_old").select(
        "m.*", F.when(F.col("_old").isNull(), F.col("_rule")).alias("rule_id")
    )


def unknown_columns(mask_state: DataFrame, full_table_name: str, table: DataFrame) -> DataFrame:
    """Masks on columns that the table does not have: (rule_id, column_name, reason)."""
    have = [c.lower() for c in table.columns]
    own = mask_state.filter(F.lower("full_table_name") == full_table_name.lower())
    return own.filter(~F.lower("column_name").isin(have)).select("rule_id", "column_name", F.lit(REASON_UNKNOWN_COLUMN).alias("reason"))


def _table_masks(mask_state: DataFrame, full_table_name: str, table: DataFrame) -> dict:
    """The masks of the table's own columns: one row per column at most."""
    have = [c.lower() for c in table.columns]
    own = (F.lower("full_table_name") == full_table_name.lower()) & F.lower("column_name").isin(have)
    rows = mask_state.filter(own).select(F.lower("column_name").alias("key"), "user_group", "type_of_masking").collect()
    return {r["key"]: r for r in rows}


def _masked(table: DataFrame, masks: dict, member) -> list[Column]:
    """The table's columns, each masked one behind its membership test."""
    out = []
    for c in table.columns:
        m = masks.get(c.lower())
        if m is None:
            out.append(F.col(c))
        else:
            # A mask takes and returns STRING; without known groups nobody sees the value.
            hidden = F.lit(DEFAULT_MASK if m["type_of_masking"] is None else m["type_of_masking"])
            out.append(F.when(member(m["user_group"] or []), F.col(c).cast("string")).otherwise(hidden).alias(c))
    return out


def mask_columns(table: DataFrame, full_table_name: str, mask_state: DataFrame, reader_groups: Sequence[str]) -> DataFrame:
    """The table as seen by a reader whose groups are known: membership is a
    literal, so Catalyst folds each CASE to the raw column or the constant."""
    groups = set(reader_groups)
    masks = _table_masks(mask_state, full_table_name, table)
    return table.select(*_masked(table, masks, lambda gs: F.lit(bool(groups & set(gs)))))


def reader_groups(memberships: DataFrame, readers: Sequence[str], wanted: Sequence[str]) -> DataFrame:
    """(reader, groups): per listed reader the groups it has among ``wanted``.

    One row per reader, with at most ``wanted`` groups, so both are bounded.
    """
    m = memberships.filter(F.col("user_name").isin(*readers) & F.col("user_group").isin(*wanted))
    return m.groupBy(F.col("user_name").alias("_reader")).agg(F.collect_set("user_group").alias("_groups"))


def mask_by_reader(
    table: DataFrame, full_table_name: str, mask_state: DataFrame, memberships: DataFrame, readers: Sequence[str]
) -> DataFrame:
    """The masked table for each reader (column ``reader`` first).

    The table is scanned once: each row is repeated per reader by a narrow
    ``explode`` of the reader list (that is the result's size), the readers'
    groups come in through an equi-join, and each masked column shows its
    value when the reader's groups overlap the mask's groups.
    """
    masks = _table_masks(mask_state, full_table_name, table)
    wanted = sorted({g for m in masks.values() for g in (m["user_group"] or []) if g is not None})
    rg = reader_groups(memberships, readers, wanted)
    per_reader = table.select(F.explode(F.array(*[F.lit(r) for r in readers])).alias("reader"), "*")
    j = per_reader.join(rg, F.col("reader") == F.col("_reader"), "left")

    def member(gs) -> Column:
        own = [g for g in gs if g is not None]
        if not own:
            return F.lit(False)
        return F.coalesce(F.arrays_overlap(F.col("_groups"), F.array(*[F.lit(g) for g in own])), F.lit(False))

    return j.select("reader", *_masked(table, masks, member))


#: Columns whose visibility one long holds.
BITS = 62


def reader_classes(memberships: DataFrame, mask_state: DataFrame, full_table_name: str, table: DataFrame) -> DataFrame:
    """(reader, seen): per user of ``memberships`` which masked columns it sees, as one bitmap in longs.

    Every group has the bits of the columns whose mask lists it; a reader has
    those of all its groups, OR-ed in a partial aggregate.  Readers alike in
    ``seen`` see the same table, however many groups they have.
    """
    masks = _table_masks(mask_state, full_table_name, table)
    own = masked_columns(masks, table)
    words = [own[at : at + BITS] for at in range(0, len(own), BITS)]
    seen = []
    for k, word in enumerate(words):
        bits: dict[str, int] = {}
        for i, c in enumerate(word):
            for g in {g for g in (masks[c]["user_group"] or []) if g is not None}:
                bits[g] = bits.get(g, 0) | 1 << i
        of_group = F.create_map(*[F.lit(x) for g in sorted(bits) for x in (g, bits[g])]) if bits else F.create_map().cast("map<string,bigint>")
        seen.append(F.coalesce(F.bit_or(F.coalesce(F.try_element_at(of_group, F.col("user_group")).cast("long"), F.lit(0).cast("long"))), F.lit(0)))
    return memberships.groupBy(F.col("user_name").alias("reader")).agg(F.array(*seen).cast("array<bigint>").alias("seen"))


def masked_columns(masks: dict, table: DataFrame) -> list[str]:
    """The table's masked columns (lower-case), in its order: bit i of a class is the i-th."""
    return [c.lower() for c in table.columns if c.lower() in masks]


def seen_names(mask_state: DataFrame, full_table_name: str, table: DataFrame, seen: str = "seen") -> Column:
    """The masked columns that a class sees, comma-joined."""
    own = masked_columns(_table_masks(mask_state, full_table_name, table), table)
    return F.concat_ws(",", *[F.when(_bit(seen, i), F.lit(c)) for i, c in enumerate(own)])


def _bit(seen: str, i: int) -> Column:
    return F.get(F.col(seen), F.lit(i // BITS)).bitwiseAND(F.lit(1 << i % BITS)) != 0


def mask_by_class(table: DataFrame, full_table_name: str, mask_state: DataFrame, memberships: DataFrame) -> DataFrame:
    """One masked copy of the table per distinct set of visible columns (``seen`` first).

    With :func:`reader_classes` this is every reader's view: the output grows
    with classes x rows (there are at most 2^m classes for m masked columns),
    not with readers x rows.  Classes are slim; each row meets all of them in an
    equi-join on a salt that deals the rows to the fan-out tasks.
    """
    masks = _table_masks(mask_state, full_table_name, table)
    own = {c: i for i, c in enumerate(masked_columns(masks, table))}
    parts = fanout_partitions(table.sparkSession)
    classes = reader_classes(memberships, mask_state, full_table_name, table).select("seen").distinct()
    classes = classes.select("seen", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_salt"))
    salted = table.withColumn("_salt", F.pmod(F.xxhash64(*table.columns), F.lit(parts)).cast("int"))
    out = []
    for c in table.columns:
        m = masks.get(c.lower())
        if m is None:
            out.append(F.col(c))
        else:
            hidden = F.lit(DEFAULT_MASK if m["type_of_masking"] is None else m["type_of_masking"])
            out.append(F.when(_bit("seen", own[c.lower()]), F.col(c).cast("string")).otherwise(hidden).alias(c))
    return salted.join(classes, "_salt").select("seen", *out)
