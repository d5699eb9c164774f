"""

Each callable takes ``(spark, sf_dir)``, derives its inputs from the test
tables there and runs the operator over them whole.  Output columns are
aliased to the names the DuckDB oracle (``duck_oracle.py``) uses; timestamps
are reported as flags so the comparison does not depend on time zones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grantweave import schemas
from grantweave.functions import short_object_name
from grantweave.operators import factors, ledger, masks, rejects, resolve, rules, statements as stm, tag_view, tags, tracking, upsert
from grantweave.plans.cycle import run_cycle
from grantweave.plans.ingest import ingest_sheet
from grantweave.plans.jobs import run_mask_job, run_tag_job
from grantweave.plans.generate import RULE_COLUMNS, active_rules, checked_rules, generate_factors, rule_factors, statement_rules
from grantweave.session import materialize, scratch_path
from grantweave.sources import calendar, config, environment, mapping
from grantweave.sources import testdata as td

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SHEET_OUT = [
    "acl_id", "object_type", "user_group", "tag_values", "schema_names", "table_names", "permission_types",
    "grant_type",
]


def register(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return deco


def _date_text(c: str = "access_until"):
    return F.date_format(F.col(c), "yyyy-MM-dd").alias(c)


def mapping_out(df: DataFrame) -> DataFrame:
    return df.select(*SHEET_OUT, _date_text(), "bu")


# --- shared inputs ---------------------------------------------------------

def all_rules(spark, d):
    """Normalised active rules of the BU after expiry, with privileges."""
    return active_rules(td.acl_mapping(spark, d), td.permission_mapping(spark), td.ENV, td.BU, td.AS_OF, td.STAMP)


def checked_rough_rules(spark, d):
    """The same of the mapping with null columns, odd names and odd groups, incomplete rows included."""
    return checked_rules(td.acl_mapping_rough(spark, d), td.permission_mapping(spark), td.ENV, td.BU, td.AS_OF, td.STAMP)


def factor_rows(spark: SparkSession, d: str) -> DataFrame:
    return generate_factors(
        td.acl_mapping(spark, d), td.schema_tags(spark, d), td.permission_mapping(spark), td.catalog_mapping(spark),
        td.ENV, td.BU, td.AS_OF, td.STAMP,
    )


def rough_factors(spark, d):
    return generate_factors(
        td.acl_mapping_rough(spark, d), td.schema_tags_rough(spark, d), td.permission_mapping(spark), td.catalog_mapping(spark),
        td.ENV, td.BU, td.AS_OF, td.STAMP,
    )


def rough_statements(spark, d):
    return stm.expand(rough_factors(spark, d))


def outcomes(spark, d, dry_run=False):
    """Factors with their outcome."""
    return factors.outcomes(rough_factors(spark, d), td.catalog_objects(spark, d), dry_run)


def applied_by_group(spark, d):
    """(rule, object, group) rows of what took effect, stored once for keys that read them twice."""
    return materialize(factors.by_group(factors.applied(outcomes(spark, d))), "applied")


# --- 2.1 scans, sources, sinks ---------------------------------------------

# Ids of rows from a sheet without ids are hashes, so these keys show whether a row has one.
LOADED = [c for c in SHEET_OUT if c != "acl_id"]


def _sheet_root(spark, sheets):
    root = scratch_path(spark, "sheets")
    mapping.write_sheets(sheets, root)
    return root


def _loaded(df: DataFrame) -> DataFrame:
    return df.select(*LOADED, _date_text(), "bu", F.col("acl_id").isNotNull().alias("has_id"))


@register("acl_mapping_read")
def q_acl_mapping_read(spark, d):
    m = mapping.read_mapping(spark, _sheet_root(spark, td.acl_mapping_sheet(spark, d)), td.BU, processed=td.STAMP)
    return m.select(*SHEET_OUT, _date_text(), "bu", F.col("updated_datetime").isNull().alias("updated_is_null"))


def _ingest(spark, d, stored: DataFrame | None):
    """Ingest the later sheet of one unit, which comes without ids."""
    path = scratch_path(spark, "acl_mapping")
    if stored is not None:
        mapping.write_table(stored, path)
    return ingest_sheet(spark, _sheet_root(spark, td.incoming_sheet(spark, d).drop("acl_id")), td.BU, path, processed=td.STAMP)


@register("acl_first_load")
def q_acl_first_load(spark, d):
    return _loaded(_ingest(spark, d, None).table)


@register("acl_ingest")
def q_acl_ingest(spark, d):
    return _loaded(_ingest(spark, d, td.acl_mapping(spark, d)).table)


@register("acl_ingest_rejects")
def q_acl_ingest_rejects(spark, d):
    return _ingest(spark, d, td.acl_mapping(spark, d)).rejects.select(
        "stage", "reason", F.when((F.col("stage") == "read") | (F.col("reason") == upsert.REASON_COPIES), F.col("value")).alias("value")
    )


@register("acl_active_grants")
def q_acl_active_grants(spark, d):
    return mapping_out(rules.active_grants(td.acl_mapping(spark, d), td.BU))


@register("env_resolve")
def q_env_resolve(spark, d):
    return environment.resolve_env(td.workspace_urls(spark, d), td.env_map(spark))


# --- 2.2 projections, filters, predicates ----------------------------------

@register("acl_expire")
def q_acl_expire(spark, d):
    e = rules.expire(rules.active_grants(td.acl_mapping(spark, d), td.BU), td.AS_OF, td.STAMP)
    return e.select("acl_id", "grant_type", _date_text())


@register("acl_groups_exploded")
def q_acl_groups_exploded(spark, d):
    return all_rules(spark, d).select("acl_id", F.posexplode("groups").alias("group_pos", "user_group"))


@register("schema_ref_resolve")
def q_schema_ref_resolve(spark, d):
    r = resolve.resolve_refs(all_rules(spark, d), td.catalog_mapping(spark), td.ENV)
    return r.filter(F.col("source") == resolve.SOURCE_SCHEMA).select("acl_id", "pos", "ref", "object_name", "status")


@register("table_ref_resolve")
def q_table_ref_resolve(spark, d):
    r = resolve.resolve_refs(all_rules(spark, d), td.catalog_mapping(spark), td.ENV)
    return r.filter(F.col("source") == resolve.SOURCE_TABLE).select("acl_id", "pos", "ref", "object_name", "status")


@register("permission_expand")
def q_permission_expand(spark, d):
    return all_rules(spark, d).select(
        "acl_id", "permission_group", "object_type", F.posexplode("privileges").alias("priv_pos", "privilege")
    )


@register("acl_unmapped_permissions")
def q_acl_unmapped_permissions(spark, d):
    return rejects.no_privileges(all_rules(spark, d))


@register("acl_statements")
def q_acl_statements(spark, d):
    return stm.expand(factor_rows(spark, d))


@register("statement_parse")
def q_statement_parse(spark, d):
    return ledger.parsed(rough_statements(spark, d)).select("access_statement", "p.*")


@register("tag_rule_targets")
def q_tag_rule_targets(spark, d):
    return tags.targets(td.tag_rules(spark, d), td.ENV).drop("tags")


@register("tag_statements")
def q_tag_statements(spark, d):
    return tags.statements(tags.targets(td.tag_rules(spark, d), td.ENV))


@register("tag_rule_rejects")
def q_tag_rule_rejects(spark, d):
    return tags.rejects(td.tag_rules(spark, d), td.ENV)


def _mask_inputs(spark, d):
    return td.mask_rules(spark, d), td.catalog_mapping(spark), td.ENV, td.existing_masks(spark, d)


@register("mask_plan")
def q_mask_plan(spark, d):
    return masks.plan(*_mask_inputs(spark, d)).drop("user_group")


@register("mask_state")
def q_mask_state(spark, d):
    out = masks.state(*_mask_inputs(spark, d))
    return out.select("full_table_name", "column_name", F.array_join("user_group", ",").alias("user_group"), "type_of_masking", "rule_id")


CUSTOMER_FULL_NAME = "dev_main_raw.crm.customer"
MASK_READER_GROUPS = ["grp_3"]


@register("mask_columns")
def q_mask_columns(spark, d):
    return masks.mask_columns(td.table(spark, d, "customer"), CUSTOMER_FULL_NAME, masks.state(*_mask_inputs(spark, d)), MASK_READER_GROUPS)


@register("mask_unknown_columns")
def q_mask_unknown_columns(spark, d):
    return masks.unknown_columns(masks.state(*_mask_inputs(spark, d)), CUSTOMER_FULL_NAME, td.table(spark, d, "customer"))


@register("mask_by_reader")
def q_mask_by_reader(spark, d):
    return masks.mask_by_reader(
        td.table(spark, d, "customer"), CUSTOMER_FULL_NAME, masks.state(*_mask_inputs(spark, d)), td.memberships(spark, d), td.READERS
    )


def _class_inputs(spark, d):
    return masks.state(*_mask_inputs(spark, d)), CUSTOMER_FULL_NAME, td.table(spark, d, "customer")


@register("mask_reader_classes")
def q_mask_reader_classes(spark, d):
    state, name, table = _class_inputs(spark, d)
    return masks.reader_classes(td.memberships(spark, d), state, name, table).select("reader", masks.seen_names(state, name, table).alias("seen"))


@register("mask_by_class")
def q_mask_by_class(spark, d):
    state, name, table = _class_inputs(spark, d)
    out = masks.mask_by_class(table, name, state, td.memberships(spark, d))
    return out.withColumn("seen", masks.seen_names(state, name, table))


@register("rule_sources")
def q_rule_sources(spark, d):
    path = scratch_path(spark, "rule_files")
    td.tag_rule_lines(spark, d).write.text(path)
    tags_ = F.transform(F.map_entries("tags"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("<null>"))))
    return config.read_rules(spark, path, "tag").select(
        "rule_ord", "level", "action", F.array_join("schemas", ",").alias("schemas"), F.array_join("tables", ",").alias("tables"),
        F.array_join(F.array_sort(tags_), ",").alias("tags"),
    )


# --- 2.3 joins ---------------------------------------------------------------

@register("tag_resolve")
def q_tag_resolve(spark, d):
    return resolve.resolve_tags(all_rules(spark, d), td.schema_tags(spark, d))


@register("tag_resolve_incremental")
def q_tag_resolve_incremental(spark, d):
    """The tag view of the rules and tags as they were, then changed as ``later_tags`` and ``later_schema_tags`` have it."""
    old = all_rules(spark, d).select("acl_id", "tag_values")
    before = td.schema_tags(spark, d)
    rules_later, rule_changes = td.later_tags(old)
    _, tag_changes = td.later_schema_tags(before)
    view = tag_view.refresh(tag_view.build(old, before), rule_changes, tag_changes)
    return tag_view.rule_objects(view, rules_later)


# --- 2.4 aggregations, set ops -----------------------------------------------

@register("statement_counts")
def q_statement_counts(spark, d):
    return factors.counts(factor_rows(spark, d))


@register("execution_summary")
def q_execution_summary(spark, d):
    f, k = materialize(rough_factors(spark, d), "factors"), td.catalog_objects(spark, d)
    return factors.summary(factors.outcomes(f, k, False)).unionByName(factors.summary(factors.outcomes(f, k, True)))


@register("tracking_tag_keys")
def q_tracking_tag_keys(spark, d):
    return tracking.tag_keys(applied_by_group(spark, d))


@register("tracking_schema_keys")
def q_tracking_schema_keys(spark, d):
    return tracking.schema_keys(applied_by_group(spark, d))


@register("tracking_table_keys")
def q_tracking_table_keys(spark, d):
    return tracking.table_keys(applied_by_group(spark, d))


#: Names a chunk holds in the two keys below.
TRACKING_CHUNK = 5


@register("tracking_schema_chunks")
def q_tracking_schema_chunks(spark, d):
    return tracking.name_chunks(applied_by_group(spark, d), "SCHEMA", TRACKING_CHUNK)


@register("tracking_table_chunks")
def q_tracking_table_chunks(spark, d):
    return tracking.name_chunks(applied_by_group(spark, d), "TABLE", TRACKING_CHUNK)


@register("tracking_short_names")
def q_tracking_short_names(spark, d):
    t = td.tracking_names(spark, d)
    short = F.when(F.col("object_type") == "TABLE", short_object_name(F.col("object_name"), "TABLE")).otherwise(
        short_object_name(F.col("object_name"), "SCHEMA")
    )
    return t.select("ord", "object_type", short.alias("short_name"))


@register("acl_objects")
def q_acl_objects(spark, d):
    r = statement_rules(all_rules(spark, d))
    return resolve.resolve_objects(r, td.schema_tags(spark, d), td.catalog_mapping(spark), td.ENV).select(
        "acl_id", "source", "object_name"
    )


# --- 2.5 keyed state changes -------------------------------------------------

@register("acl_upsert")
def q_acl_upsert(spark, d):
    return mapping_out(upsert.upsert(td.acl_mapping(spark, d), td.incoming_mapping(spark, d)))


@register("acl_upsert_rejects")
def q_acl_upsert_rejects(spark, d):
    return upsert.upsert_rejects(td.incoming_mapping(spark, d))


def _stamped(df: DataFrame) -> DataFrame:
    return df.select("acl_id", F.col("updated_datetime").isNotNull().alias("stamped"))


@register("acl_expire_apply")
def q_acl_expire_apply(spark, d):
    x = upsert.expire_apply(td.acl_mapping(spark, d), td.BU, td.AS_OF, td.STAMP, match="own")
    return x.select("acl_id", "bu", "grant_type", F.col("updated_datetime").isNotNull().alias("stamped"))


@register("acl_expire_apply_keyed")
def q_acl_expire_apply_keyed(spark, d):
    x = upsert.expire_apply(td.acl_mapping(spark, d), td.BU, td.AS_OF, td.STAMP, match="key")
    return x.select("acl_id", "bu", "grant_type", F.col("updated_datetime").isNotNull().alias("stamped"))


@register("acl_expire_calendar")
def q_acl_expire_calendar(spark, d):
    """The same as ``acl_expire_apply``, in place in a table stored as an expiry calendar."""
    path = scratch_path(spark, "calendar")
    calendar.write_calendar(td.acl_mapping(spark, d), path)
    calendar.expire(spark, path, td.BU, td.AS_OF, td.STAMP)
    x = calendar.read_calendar(spark, path)
    return x.select("acl_id", "bu", "grant_type", F.col("updated_datetime").isNotNull().alias("stamped"))


@register("tracking_stamp_schema")
def q_tracking_stamp_schema(spark, d):
    return _stamped(tracking.stamp_schema_rows(td.acl_mapping_rough(spark, d), applied_by_group(spark, d), td.STAMP))


@register("tracking_stamp_table")
def q_tracking_stamp_table(spark, d):
    return _stamped(tracking.stamp_table_rows(td.acl_mapping_rough(spark, d), applied_by_group(spark, d), td.STAMP))


@register("tracking_stamp_exact")
def q_tracking_stamp_exact(spark, d):
    return _stamped(tracking.stamp_exact(td.acl_mapping_rough(spark, d), factors.applied(outcomes(spark, d)), td.STAMP))


# --- 2.6 statement effects ---------------------------------------------------

@register("effective_grants")
def q_effective_grants(spark, d):
    """Ids over the upper half of their range, and statements without one."""
    acl_id = F.when(F.col("acl_id") % 13 != 0, F.col("acl_id") + F.lit(1 << 62)).alias("acl_id")
    s = rough_statements(spark, d).select(acl_id, *ledger.LEDGER_KEY, "grant_type")
    return ledger.apply_statements(td.stored_grants(spark, d), s)


@register("tag_state")
def q_tag_state(spark, d):
    return tags.apply_rules(td.object_tags(spark, d), td.tag_rules(spark, d), td.ENV)


@register("execution_outcomes")
def q_execution_outcomes(spark, d):
    return factors.outcome_rows(outcomes(spark, d)).select("acl_id", "access_statement", "status", "dry_run", "error")


# --- 3.2 the whole cycle (snapshots under the checkpoint folder) -------------

def _cycle(spark, d, dry_run=False):
    return run_cycle(
        td.acl_mapping_rough(spark, d), td.schema_tags_rough(spark, d), td.permission_mapping(spark), td.catalog_mapping(spark),
        td.catalog_objects(spark, d), td.stored_grants(spark, d), td.ENV, td.BU, td.AS_OF, td.STAMP, dry_run,
    )


@register("acl_cycle_summary")
def q_acl_cycle_summary(spark, d):
    return _cycle(spark, d).summary


@register("acl_cycle_dry_run")
def q_acl_cycle_dry_run(spark, d):
    """A dry run counts every statement and leaves the ledger as it is."""
    r = _cycle(spark, d, dry_run=True)
    kept = r.grants.agg(F.lit("grants kept").alias("what"), F.count("*").alias("total"))
    return r.summary.select(F.lit("statements").alias("what"), "total").unionByName(kept)


@register("acl_cycle_grants")
def q_acl_cycle_grants(spark, d):
    return _cycle(spark, d).grants.select(*ledger.LEDGER_KEY)


@register("acl_cycle_mapping")
def q_acl_cycle_mapping(spark, d):
    return _cycle(spark, d).mapping.select(
        "acl_id", "bu", "grant_type", F.col("updated_datetime").isNotNull().alias("stamped")
    )


# --- the tag and mask jobs ----------------------------------------------------

def _tag_job(spark, d, dry_run=False):
    return run_tag_job(td.tag_rules(spark, d), td.object_tags(spark, d), td.ENV, dry_run)


def _mask_job(spark, d, dry_run=False):
    rules_, catalogs, env, existing = _mask_inputs(spark, d)
    return run_mask_job(rules_, catalogs, existing, env, dry_run)


def _job_report(job, what: str):
    """Summary, rejects and the size of the state after a job, as rows (what, name, n)."""
    parts = [
        job.summary.select(F.lit(f"{what} steps").alias("what"), F.col("action").alias("name"), F.col("rules").alias("n")),
        job.rejects.groupBy("reason").agg(F.count("*").alias("n")).select(F.lit(f"{what} rejects").alias("what"), F.col("reason").alias("name"), "n"),
        job.state.agg(F.count("*").alias("n")).select(F.lit(f"{what} state").alias("what"), F.lit("rows").alias("name"), "n"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("tag_job_state")
def q_tag_job_state(spark, d):
    return _tag_job(spark, d).state


@register("mask_job_state")
def q_mask_job_state(spark, d):
    out = _mask_job(spark, d).state
    return out.select("full_table_name", "column_name", F.array_join("user_group", ",").alias("user_group"), "type_of_masking", "rule_id")


@register("job_reports")
def q_job_reports(spark, d):
    """What both jobs report, and that a dry run of them leaves the state as it is."""
    real = _job_report(_tag_job(spark, d), "tag").unionByName(_job_report(_mask_job(spark, d), "mask"))
    dry = _job_report(_tag_job(spark, d, True), "tag dry run").unionByName(_job_report(_mask_job(spark, d, True), "mask dry run"))
    return real.unionByName(dry)


# --- 2.7 rejects -------------------------------------------------------------

@register("acl_rejects")
def q_acl_rejects(spark, d):
    """Every stage's rejects as one relation."""
    checked = materialize(checked_rough_rules(spark, d), "rules")
    tagged, catalogs = td.schema_tags_rough(spark, d), td.catalog_mapping(spark)
    outs = factors.outcomes(rule_factors(checked, tagged, catalogs, td.ENV), td.catalog_objects(spark, d))
    sheet = td.incoming_sheet(spark, d).withColumn(schemas.MALFORMED, F.lit(None).cast("string"))
    return rejects.all_rejects(
        mapping.sheet_rejects(sheet),
        upsert.upsert_rejects(td.incoming_mapping(spark, d)),
        rejects.rule_rejects(checked, tagged, catalogs, td.ENV),
        rejects.unparseable(factors.unreadable(outs)),
        rejects.mask_rejects(masks.plan(*_mask_inputs(spark, d))),
        rejects.tag_rejects(tags.rejects(td.tag_rules(spark, d), td.ENV)),
        rejects.environment_rejects(environment.resolve_env(td.workspace_urls(spark, d), td.env_map(spark))),
    )


__all__ = ["QUERIES", "RULE_COLUMNS", "register"]
