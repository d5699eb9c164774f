"""Independent DuckDB SQL for every registered query (the correctness oracle).

Each text runs on DuckDB with the test tables registered as views.  The
fixture CTEs mirror FIXTURES.md; the operator logic is written the plain SQL
way (non-equi joins, list functions) rather than the way the Spark plans do
it, so the two sides check each other.
"""

from __future__ import annotations


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def items(x: str) -> str:
    return f"list_transform(string_split({x}, ','), lambda i: {strip('i')})"


AS_OF = "DATE '1998-01-01'"

# --- fixtures -------------------------------------------------------------
ACL_SHEET = """acl_sheet AS (
SELECT o_orderkey AS acl_id,
  CASE WHEN o_orderkey % 10 < 4 THEN 'SCHEMA' WHEN o_orderkey % 10 < 8 THEN 'TABLE'
       WHEN o_orderkey % 10 = 8 THEN 'VOLUME' ELSE 'SCHEMA' END AS object_type,
  CASE WHEN o_custkey % 3 = 0 THEN concat('grp_', CAST(o_custkey % 40 AS STRING), ' , grp_', CAST((o_custkey + 7) % 40 AS STRING), ',')
       ELSE concat('grp_', CAST(o_custkey % 40 AS STRING)) END AS user_group,
  CASE WHEN o_orderkey % 10 IN (0, 9) THEN concat('Brand#', CAST(o_custkey % 30 AS STRING),
       CASE WHEN o_custkey % 2 = 0 THEN ' , SMALL' ELSE '' END) END AS tag_values,
  CASE WHEN o_orderkey % 10 IN (1, 2) THEN concat('raw.s', CAST(o_custkey % 50 AS STRING))
       WHEN o_orderkey % 10 = 3 THEN concat('raw.s', CAST(o_custkey % 50 AS STRING), ', curated.s', CAST(o_custkey % 20 AS STRING), ',bad,nomap.s1') END AS schema_names,
  CASE WHEN o_orderkey % 10 IN (4, 5, 8) THEN concat('raw.s', CAST(o_custkey % 50 AS STRING), '.t', CAST(o_custkey % 9 AS STRING))
       WHEN o_orderkey % 10 IN (6, 7) THEN concat('raw.s1.t', CAST(o_custkey % 9 AS STRING), ', curated.s2.t', CAST(o_custkey % 7 AS STRING), ',raw.only_two') END AS table_names,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'DATA_ADMIN' WHEN '2-HIGH' THEN 'DATA_WRITER'
       WHEN '4-NOT SPECIFIED' THEN 'UNMAPPED' ELSE 'DATA_READER' END AS permission_types,
  CASE WHEN o_orderstatus = 'P' THEN 'REVOKE' ELSE 'GRANT' END AS grant_type,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS access_until,
  c_mktsegment AS bu
FROM orders JOIN customer ON o_custkey = c_custkey)"""

ACL = "acl AS (SELECT * REPLACE (TRY_CAST(access_until AS DATE) AS access_until) FROM acl_sheet)"

# the rough mapping takes the clean one's place under the name acl
ROUGH = """acl AS (SELECT acl_id,
  CASE WHEN acl_id % 31 = 0 THEN NULL WHEN acl_id % 59 = 0 THEN 'MATERIALIZED VIEW' ELSE object_type END AS object_type,
  CASE WHEN acl_id % 41 = 0 THEN NULL WHEN acl_id % 43 = 0 THEN 'grp_1, bad`grp' ELSE user_group END AS user_group,
  CASE WHEN acl_id % 47 = 0 THEN 'Brand#12' ELSE tag_values END AS tag_values,
  CASE WHEN acl_id % 61 = 0 THEN 'raw.s1 TO `grp_admin` , raw.s2' WHEN acl_id % 29 = 0 THEN 'raw.s-5, raw.s1, curated.s3' ELSE schema_names END AS schema_names,
  CASE WHEN acl_id % 67 = 0 THEN 'raw.s1.t1 TO `grp_admin` ' WHEN acl_id % 23 = 0 THEN 'raw.s1.t1, curated.s2.t3' ELSE table_names END AS table_names,
  CASE WHEN acl_id % 37 = 0 THEN NULL ELSE permission_types END AS permission_types,
  grant_type, TRY_CAST(access_until AS DATE) AS access_until, bu FROM acl_sheet)"""

INCOMING_SHEET = """inc_sheet AS (SELECT acl_id + 100000000 AS acl_id,
  CASE WHEN acl_id % 31 = 0 THEN NULL WHEN acl_id % 17 = 0 THEN 'SCHEMA' ELSE object_type END AS object_type,
  CASE WHEN acl_id % 17 = 0 THEN 'grp_dup' WHEN acl_id % 3 = 0 THEN concat(user_group, '_n') ELSE user_group END AS user_group,
  CASE WHEN acl_id % 17 = 0 THEN 'X' ELSE tag_values END AS tag_values,
  CASE WHEN acl_id % 17 = 0 THEN NULL ELSE schema_names END AS schema_names,
  CASE WHEN acl_id % 17 = 0 THEN NULL ELSE table_names END AS table_names,
  CASE WHEN acl_id % 17 = 0 THEN 'DATA_READER' ELSE permission_types END AS permission_types,
  CASE WHEN acl_id % 17 = 0 THEN 'GRANT' ELSE grant_type END AS grant_type,
  CASE WHEN (acl_id + 100000000) % 19 = 0 THEN '31/12/1999' WHEN (acl_id + 100000000) % 53 = 0 THEN '1999'
       WHEN acl_id % 17 = 0 THEN NULL ELSE access_until END AS until_text,
  CASE WHEN acl_id % 17 = 0 THEN NULL ELSE TRY_CAST(access_until AS DATE) END AS access_until, bu FROM acl_sheet)"""

CATALOG_OBJECTS = """known AS (
SELECT DISTINCT concat(CASE WHEN p_partkey % 2 = 0 THEN 'dev_main_raw' ELSE 'dev_main_curated' END, '.s', CAST(p_partkey % 45 AS STRING)) AS object_name
FROM part
UNION
SELECT DISTINCT concat(CASE WHEN p_partkey % 3 = 0 THEN 'dev_main_curated' ELSE 'dev_main_raw' END, '.s', CAST(p_partkey % 50 AS STRING), '.t', CAST(p_partkey % 9 AS STRING))
FROM part)"""

STORED_GRANTS = """old AS (
SELECT DISTINCT CASE WHEN p_size % 3 = 0 THEN 'USE SCHEMA' ELSE 'SELECT' END AS privilege, 'SCHEMA' AS object_type,
  concat('dev_main_raw.s', CAST(p_partkey % 200 AS STRING)) AS object_name, concat('grp_', CAST(p_partkey % 40 AS STRING)) AS user_group
FROM part)"""

SCHEMA_TAGS = """schema_tags_fx AS (
SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN 'dev_main_raw' ELSE 'dev_main_curated' END AS catalog_name,
  concat('s', CAST(p_partkey % 200 AS STRING)) AS schema_name,
  CASE WHEN p_size % 2 = 0 THEN 'domain' ELSE 'tier' END AS tag_name,
  CASE WHEN p_size % 5 = 0 THEN concat(p_brand, ', ', p_type) ELSE concat(p_brand, ',', p_type) END AS tag_value
FROM part)"""

# Stored tags of schemas whose name no statement can hold, or tries to say more.
SCHEMA_TAGS_ROUGH = SCHEMA_TAGS.replace("schema_tags_fx AS (", "clean_tags_fx AS (") + """,
schema_tags_fx AS (
SELECT catalog_name, schema_name || CASE WHEN CAST(schema_name[2:] AS INTEGER) % 19 = 0 THEN '-x'
  WHEN CAST(schema_name[2:] AS INTEGER) % 23 = 0 THEN ' TO `grp_admin`' ELSE '' END AS schema_name, tag_name, tag_value FROM clean_tags_fx)"""

PERM = """perm(permission_group, privileges) AS (VALUES
  ('DATA_READER', ['USE SCHEMA', 'SELECT', 'READ VOLUME']),
  ('DATA_WRITER', ['USE SCHEMA', 'SELECT', 'MODIFY']),
  ('DATA_ADMIN', ['ALL PRIVILEGES']))"""

CAT = "cat(prefix, catalog) AS (VALUES ('raw', 'dev_main_raw'), ('curated', 'dev_main_curated'))"

ACTIVE = "active AS (SELECT * FROM acl WHERE bu = 'BUILDING' AND grant_type = 'GRANT')"

EXPIRED = f"""expired AS (SELECT * REPLACE (
  CASE WHEN access_until IS NOT NULL AND access_until < {AS_OF} THEN 'REVOKE' ELSE grant_type END AS grant_type)
FROM active WHERE object_type IS NOT NULL AND user_group IS NOT NULL AND permission_types IS NOT NULL AND grant_type IS NOT NULL)"""

RULES = f"""rules0 AS (
SELECT acl_id, {strip('grant_type')} AS grant_type, {strip('object_type')} AS object_type,
  {strip('permission_types')} AS permission_group,
  list_filter({items('user_group')}, lambda g: g <> '' AND NOT contains(g, '`')) AS groups,
  CASE WHEN tag_values <> '' THEN {items('tag_values')} END AS tags,
  CASE WHEN schema_names <> '' THEN {items('schema_names')} END AS schema_refs,
  CASE WHEN table_names <> '' THEN {items('table_names')} END AS table_refs
FROM expired),
rules AS (
SELECT r.*, CASE WHEN r.tags IS NOT NULL THEN array_to_string(r.tags, ',') END AS tag_values,
  list_filter(coalesce(p.privileges, []), lambda x:
    CASE WHEN r.permission_group = 'DATA_READER' AND r.object_type = 'TABLE' THEN x = 'SELECT'
         WHEN r.permission_group = 'DATA_READER' AND r.object_type = 'VOLUME' THEN x = 'READ VOLUME'
         ELSE true END) AS privileges
FROM rules0 r LEFT JOIN perm p ON p.permission_group = r.permission_group),
srules AS (SELECT * FROM rules WHERE len(privileges) > 0)"""

# Fixed value: the characters of an object name in a statement.
NAME = r"'[\w.]+'"
TAG_OBJS = f"""all_tag_objs AS (
SELECT DISTINCT r.acl_id, st.catalog_name || '.' || st.schema_name AS object_name
FROM srules r JOIN schema_tags_fx st ON list_has_any(r.tags, string_split(st.tag_value, ','))
WHERE r.tags IS NOT NULL),
tag_objs AS (SELECT * FROM all_tag_objs WHERE regexp_full_match(object_name, {NAME}))"""

REFS = f"""refs AS (
SELECT acl_id, 'schema' AS source, ref, 2 AS want FROM (SELECT acl_id, unnest(schema_refs) AS ref FROM srules)
UNION ALL
SELECT acl_id, 'table' AS source, ref, 3 AS want FROM (SELECT acl_id, unnest(table_refs) AS ref FROM srules)),
ref_objs AS (
SELECT acl_id, source, c.catalog || '.' || array_to_string(string_split(ref, '.')[2:], '.') AS object_name
FROM refs JOIN cat c ON c.prefix = string_split(ref, '.')[1]
WHERE len(string_split(ref, '.')) = want AND regexp_full_match(array_to_string(string_split(ref, '.')[2:], '.'), {NAME}))"""

OBJS = """objs AS (
SELECT acl_id, 'tag' AS source, object_name FROM tag_objs
UNION ALL SELECT acl_id, source, object_name FROM ref_objs)"""

STATEMENTS = """stmts AS (
SELECT o.acl_id, o.source, r.object_type, o.object_name, g.user_group, p.privilege, r.grant_type, r.tag_values,
  r.grant_type || ' ' || p.privilege || ' ON ' || r.object_type || ' ' || o.object_name || ' '
    || CASE WHEN r.grant_type = 'GRANT' THEN 'TO' ELSE 'FROM' END || ' `' || g.user_group || '`' AS access_statement
FROM objs o JOIN srules r ON o.acl_id = r.acl_id,
  unnest(r.groups) AS g(user_group), unnest(r.privileges) AS p(privilege))"""

BASE = [ACL_SHEET, ACL, SCHEMA_TAGS, PERM, CAT, ACTIVE, EXPIRED, RULES]
GEN = BASE + [TAG_OBJS, REFS, OBJS, STATEMENTS]
ROUGH_BASE = [ROUGH if c is ACL else c for c in BASE]
ROUGH_GEN = [{ACL: ROUGH, SCHEMA_TAGS: SCHEMA_TAGS_ROUGH}.get(c, c) for c in GEN]


def with_(ctes: list[str], body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


SQL: dict[str, str] = {}

SQL["acl_statements"] = with_(GEN, "SELECT * FROM stmts")

SHEET_OUT = "acl_id, object_type, user_group, tag_values, schema_names, table_names, permission_types, grant_type"

# --- 2.1 --------------------------------------------------------------------
SQL["acl_mapping_read"] = with_(
    [ACL_SHEET],
    f"SELECT {SHEET_OUT}, access_until, bu, true AS updated_is_null FROM acl_sheet WHERE bu = 'BUILDING'",
)
SQL["acl_active_grants"] = with_(
    [ACL_SHEET, ACL, ACTIVE], f"SELECT {SHEET_OUT}, CAST(access_until AS VARCHAR) AS access_until, bu FROM active"
)

URLS = """urls AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'https://nohost.example.net'
  ELSE concat('https://adb-', CAST(100 + user_id % 5 AS STRING), '.3.example.net') END AS url FROM events),
envm(ws, env) AS (VALUES ('100', 'dev'), ('101', 'test'), ('102', 'prod'))"""
ENV_SELECT = """SELECT event_id, url, ws_id AS workspace_id, e.env,
  CASE WHEN ws_id IS NULL THEN 'no workspace id in url'
       WHEN e.env IS NULL OR e.env = '' THEN 'workspace not in env map' ELSE 'ok' END AS status
FROM (SELECT *, CASE WHEN position('adb-' IN url) > 0 THEN split_part(split_part(url, 'adb-', 2), '.', 1) END AS ws_id
      FROM urls) u LEFT JOIN envm e ON e.ws = u.ws_id"""
SQL["env_resolve"] = with_([URLS], ENV_SELECT)

# --- 2.2 --------------------------------------------------------------------
SQL["acl_expire"] = with_(
    [ACL_SHEET, ACL, ACTIVE, EXPIRED],
    "SELECT acl_id, grant_type, CAST(access_until AS VARCHAR) AS access_until FROM expired",
)
SQL["acl_groups_exploded"] = with_(
    BASE,
    """SELECT acl_id, CAST(i - 1 AS INTEGER) AS group_pos, user_group
FROM (SELECT acl_id, unnest(groups) AS user_group, generate_subscripts(groups, 1) AS i FROM rules)""",
)

REF_STATUS = """ref_status AS (
SELECT acl_id, source, CAST(i - 1 AS INTEGER) AS pos, ref,
  CASE WHEN len(string_split(ref, '.')) = want AND c.catalog IS NOT NULL AND regexp_full_match(array_to_string(string_split(ref, '.')[2:], '.'), '[\\w.]+')
       THEN c.catalog || '.' || array_to_string(string_split(ref, '.')[2:], '.') END AS object_name,
  CASE WHEN len(string_split(ref, '.')) <> want AND source = 'schema' THEN 'schema ref not 2 parts'
       WHEN len(string_split(ref, '.')) <> want THEN 'table ref not 3 parts'
       WHEN c.catalog IS NULL THEN 'prefix not mapped'
       WHEN NOT regexp_full_match(array_to_string(string_split(ref, '.')[2:], '.'), '[\\w.]+') THEN 'object name outside the statement grammar'
       ELSE 'ok' END AS status
FROM (SELECT acl_id, 'schema' AS source, 2 AS want, unnest(schema_refs) AS ref, generate_subscripts(schema_refs, 1) AS i FROM {src}
      UNION ALL
      SELECT acl_id, 'table' AS source, 3 AS want, unnest(table_refs) AS ref, generate_subscripts(table_refs, 1) AS i FROM {src}) x
LEFT JOIN cat c ON c.prefix = string_split(x.ref, '.')[1])"""

SQL["schema_ref_resolve"] = with_(
    BASE + [REF_STATUS.format(src="rules")],
    "SELECT acl_id, pos, ref, object_name, status FROM ref_status WHERE source = 'schema'",
)
SQL["table_ref_resolve"] = with_(
    BASE + [REF_STATUS.format(src="rules")],
    "SELECT acl_id, pos, ref, object_name, status FROM ref_status WHERE source = 'table'",
)
SQL["permission_expand"] = with_(
    BASE,
    """SELECT acl_id, permission_group, object_type, CAST(i - 1 AS INTEGER) AS priv_pos, privilege
FROM (SELECT acl_id, permission_group, object_type, unnest(privileges) AS privilege,
             generate_subscripts(privileges, 1) AS i FROM rules)""",
)
SQL["acl_unmapped_permissions"] = with_(
    BASE,
    """SELECT 'privileges' AS stage, acl_id, concat_ws('/', permission_group, object_type) AS value,
  'no privileges for (env, group, type)' AS reason FROM rules WHERE len(privileges) = 0""",
)

# Fixed value: the statement grammar.
PAT = r"^(GRANT|REVOKE)\s+(.*?)\s+ON\s+(\w+)\s+([\w.]+)\s+(TO|FROM)\s+`([^`]+)`"


def _g(i: int, name: str) -> str:
    return f"CASE WHEN m THEN regexp_extract(s, '{PAT}', {i}) END AS {name}"


PARSED = f"""parsed AS (
SELECT acl_id, access_statement, tag_values AS raw_tags, m,
  {_g(1, 'grant_type')}, {_g(2, 'permissions')}, {_g(3, 'object_type')}, {_g(4, 'object_name')},
  {_g(6, 'user_group')}, CASE WHEN m THEN tag_values END AS tag_values
FROM (SELECT *, regexp_matches(s, '{PAT}') AS m
      FROM (SELECT acl_id, access_statement, tag_values, {strip('access_statement')} AS s FROM stmts)))"""

SQL["statement_parse"] = with_(
    ROUGH_GEN + [PARSED],
    "SELECT access_statement, grant_type, permissions, object_type, object_name, user_group, tag_values FROM parsed",
)

TAG_RULES = """tag_rules_fx AS (
SELECT p_partkey AS rule_ord, CASE WHEN p_size % 2 = 0 THEN 'SCHEMA' ELSE 'TABLE' END AS level,
  CASE WHEN p_partkey % 4 = 0 THEN 'unset' WHEN p_partkey % 11 = 0 THEN 'drop' ELSE 'Set' END AS action,
  CASE WHEN p_partkey % 5 = 0 THEN [concat('xxx_main_raw.s', CAST(p_partkey % 50 AS STRING)), 'xxx_main_curated.s1']
       ELSE [concat('xxx_main_raw.s', CAST(p_partkey % 50 AS STRING))] END AS schemas,
  CASE WHEN p_size % 2 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN [concat('t', CAST(p_partkey % 9 AS STRING)), 'tx']
       ELSE [concat('t', CAST(p_partkey % 9 AS STRING))] END AS tables,
  CASE WHEN p_partkey % 13 = 0 THEN NULL
       WHEN p_partkey % 6 = 0 THEN [{'k': CASE WHEN p_partkey % 3 = 0 THEN 'domain' ELSE 'tier' END, 'v': p_type},
                                    {'k': 'owner', 'v': CASE WHEN p_partkey % 12 <> 0 THEN p_brand END}]
       ELSE [{'k': CASE WHEN p_partkey % 3 = 0 THEN 'domain' ELSE 'tier' END, 'v': p_type}] END AS tags
FROM part),
names AS (
SELECT rule_ord, level, upper(action) AS action, tags,
  CASE WHEN level = 'SCHEMA' THEN list_transform(schemas, lambda s: replace(s, 'xxx', 'dev'))
       ELSE flatten(list_transform(schemas, lambda s: list_transform(tables, lambda t: replace(s, 'xxx', 'dev') || '.' || t))) END AS names
FROM tag_rules_fx),
targets AS (
SELECT rule_ord, level, action, tags, unnest(names) AS target, CAST(generate_subscripts(names, 1) - 1 AS INTEGER) AS target_pos FROM names)"""


def q(x: str) -> str:
    return f"'''' || replace({x}, '''', '''''') || ''''"


SQL["tag_rule_targets"] = with_([TAG_RULES], "SELECT rule_ord, level, action, target_pos, target FROM targets")
SQL["tag_statements"] = with_(
    [TAG_RULES],
    f"""SELECT rule_ord, level, target_pos, target, action,
  CASE WHEN action = 'SET' THEN 'ALTER ' || level || ' ' || target || ' SET TAGS ('
         || array_to_string(list_transform(tags, lambda e: {q("e.k")} || ' = ' || {q("coalesce(e.v, 'None')")}), ', ') || ')'
       ELSE 'ALTER ' || level || ' ' || target || ' UNSET TAGS (' || array_to_string(list_transform(tags, lambda e: {q("e.k")}), ', ') || ')' END AS statement
FROM targets WHERE action IN ('SET', 'UNSET') AND tags IS NOT NULL""",
)
TAG_REJECTS = """SELECT rule_ord, level, target, action,
  CASE WHEN tags IS NULL THEN 'tags must be a map' ELSE 'unsupported action' END AS reason
FROM targets WHERE tags IS NULL OR action NOT IN ('SET', 'UNSET')"""
SQL["tag_rule_rejects"] = with_([TAG_RULES], TAG_REJECTS)
SQL["rule_sources"] = with_(
    [TAG_RULES],
    """SELECT rule_ord, level, action, array_to_string(schemas, ',') AS schemas, array_to_string(tables, ',') AS tables,
  array_to_string(list_sort(list_transform(tags, lambda e: e.k || '=' || coalesce(e.v, '<null>'))), ',') AS tags FROM tag_rules_fx""",
)
_TAG_STATE = [
    """old AS (SELECT 'SCHEMA' AS level, catalog_name || '.' || schema_name AS target, tag_name, min(tag_value) AS tag_value
          FROM schema_tags_fx GROUP BY ALL)""",
    """entries AS (SELECT level, target, rule_ord, action, e.k AS tag_name, coalesce(e.v, 'None') AS tag_value
  FROM (SELECT *, unnest(tags) AS e FROM targets WHERE action IN ('SET', 'UNSET')))""",
    """last_entry AS (SELECT * FROM entries QUALIFY row_number() OVER (PARTITION BY level, target, tag_name ORDER BY rule_ord DESC) = 1)""",
]
_NEW_TAGS = """SELECT level, target, tag_name, tag_value FROM last_entry WHERE action = 'SET'
UNION ALL
SELECT o.level, o.target, o.tag_name, o.tag_value FROM old o
WHERE NOT EXISTS (SELECT 1 FROM last_entry l WHERE l.level = o.level AND l.target = o.target AND l.tag_name = o.tag_name)"""
SQL["tag_state"] = with_([SCHEMA_TAGS, TAG_RULES, *_TAG_STATE], _NEW_TAGS)

MASK_RULES = """mask_rules_fx AS (
SELECT * FROM (VALUES
  (1, 'raw.crm.customer', 'c_name', ['grp_1', 'grp_2'], '****', false),
  (2, 'raw.crm.supplier', 's_name', ['grp_3'], 'HIDDEN', false),
  (3, 'raw.crm.customer', 'c_mktsegment', ['grp_1'], '****', true),
  (4, 'raw.customer', 'c_name', ['grp_1'], '****', false),
  (5, 'nomap.crm.customer', 'c_name', ['grp_1'], '****', false),
  (6, 'raw.crm.customer', 'c_acctbal', CAST([] AS VARCHAR[]), '****', false),
  (7, 'raw.crm.customer', 'C_NAME', ['grp_3'], 'LATER', false),
  (8, 'raw.crm.customer', 'c_mktsegment', ['grp_1'], '####', false),
  (9, 'raw.crm.customer', 'c_mktsegment', ['grp_1'], '****', true),
  (10, 'raw.crm.CUSTOMER', 'C_MKTSEGMENT', ['grp_3'], 'SEG', false),
  (11, 'raw.crm.customer', 'c_acctbal', ['grp_3'], '1', false),
  (12, 'raw.crm.customer', 'c_nationkey', ['grp_1'], '****', false),
  (13, 'raw.crm.customer', 'c_nationkey', ['grp_1'], '****', true),
  (14, 'raw.crm.customer', 'no_such_column', ['grp_1'], '****', false),
  (15, 'raw.crm.customer', NULL, ['grp_1'], '****', false)
) t(rule_id, table_name, column_name, user_group, type_of_masking, drop_existing)
UNION ALL
SELECT s_suppkey + 1000,
  CASE WHEN s_suppkey % 13 = 0 THEN concat('raw.t', CAST(s_suppkey % 50 AS STRING))
       WHEN s_suppkey % 17 = 0 THEN concat('nomap.app.t', CAST(s_suppkey % 50 AS STRING))
       WHEN s_suppkey % 2 = 0 THEN concat('raw.crm.t', CAST(s_suppkey % 50 AS STRING))
       ELSE concat('curated.app.t', CAST(s_suppkey % 50 AS STRING)) END,
  concat('col-', CAST(s_nationkey AS STRING)),
  CASE WHEN s_suppkey % 11 = 0 THEN CAST([] AS VARCHAR[])
       ELSE [concat('grp_', CAST(s_suppkey % 40 AS STRING)), concat('grp_', CAST((s_suppkey + 3) % 40 AS STRING))] END,
  CASE WHEN s_suppkey % 3 = 0 THEN 'HIDDEN' ELSE '****' END,
  s_suppkey % 10 = 0
FROM supplier),
existing_fx AS (
SELECT 'dev_main_raw.crm.supplier' AS full_table_name, 's_name' AS column_name, ['grp_3'] AS user_group, 'HIDDEN' AS type_of_masking
UNION ALL SELECT 'dev_main_raw.crm.Customer', 'c_acctbal', ['grp_9'], '0'
UNION ALL
SELECT concat('dev_main_raw.crm.t', CAST(s_suppkey % 12 AS STRING)), concat('COL-', CAST(s_nationkey AS STRING)),
  [concat('grp_', CAST(min(s_suppkey) % 40 AS STRING))], 'OLD' FROM supplier GROUP BY s_suppkey % 12, s_nationkey),
mp0 AS (
SELECT r.*, string_split(table_name, '.') AS parts, len(string_split(table_name, '.')) = 3 AS shape_ok, c.catalog
FROM mask_rules_fx r LEFT JOIN cat c ON c.prefix = string_split(r.table_name, '.')[1]),
mp1 AS (
SELECT *, shape_ok AND catalog IS NOT NULL AS ok,
  CASE WHEN shape_ok AND catalog IS NOT NULL THEN catalog || '.' || parts[2] || '.' || parts[3] END AS full_table_name,
  CASE WHEN shape_ok AND catalog IS NOT NULL THEN replace(parts[3] || '_' || column_name || '_mask', '-', '_') END AS function_name,
  CASE WHEN NOT shape_ok THEN 'mask ref not 3 parts' WHEN catalog IS NULL THEN 'prefix not mapped'
       WHEN column_name IS NULL THEN 'mask without column'
       WHEN user_group IS NULL OR len(user_group) = 0 THEN 'mask without group' END AS rejected
FROM mp0),
valid AS (SELECT *, lower(full_table_name) AS tk, lower(column_name) AS ck FROM mp1 WHERE rejected IS NULL),
history AS (
SELECT v.*, (SELECT max(d.rule_id) FROM valid d WHERE d.tk = v.tk AND d.ck = v.ck AND d.drop_existing AND d.rule_id < v.rule_id) AS dropped
FROM valid v),
turns AS (
SELECT h.*, EXISTS (SELECT 1 FROM valid c WHERE c.tk = h.tk AND c.ck = h.ck AND NOT c.drop_existing AND c.rule_id < h.rule_id
                    AND (h.dropped IS NULL OR c.rule_id > h.dropped))
  OR (h.dropped IS NULL AND EXISTS (SELECT 1 FROM existing_fx e WHERE lower(e.full_table_name) = h.tk AND lower(e.column_name) = h.ck)) AS there
FROM history h),
mplan AS (
SELECT rule_id, table_name, column_name, full_table_name, function_name, user_group, coalesce(type_of_masking, '****') AS type_of_masking,
  CASE WHEN drop_existing THEN 'DROP' WHEN there THEN 'SKIP' ELSE 'CREATE' END AS action,
  CASE WHEN NOT drop_existing AND there THEN 'mask exists' END AS reason FROM turns
UNION ALL
SELECT rule_id, table_name, column_name, full_table_name, function_name, user_group, coalesce(type_of_masking, '****'),
  'REJECT', rejected FROM mp1 WHERE rejected IS NOT NULL),
drops AS (SELECT tk, ck, max(rule_id) AS at_rule FROM valid WHERE drop_existing GROUP BY ALL),
mstate AS (
SELECT e.full_table_name, e.column_name, e.user_group, e.type_of_masking, CAST(NULL AS BIGINT) AS rule_id
FROM existing_fx e WHERE NOT EXISTS (SELECT 1 FROM drops d WHERE d.tk = lower(e.full_table_name) AND d.ck = lower(e.column_name))
UNION ALL
SELECT p.full_table_name, p.column_name, p.user_group, p.type_of_masking, p.rule_id
FROM mplan p WHERE p.action = 'CREATE'
  AND NOT EXISTS (SELECT 1 FROM drops d WHERE d.tk = lower(p.full_table_name) AND d.ck = lower(p.column_name) AND d.at_rule > p.rule_id))"""

SQL["mask_plan"] = with_(
    [CAT, MASK_RULES],
    "SELECT rule_id, table_name, column_name, full_table_name, function_name, type_of_masking, action, reason FROM mplan",
)
SQL["mask_state"] = with_(
    [CAT, MASK_RULES],
    "SELECT full_table_name, column_name, array_to_string(user_group, ',') AS user_group, type_of_masking, rule_id FROM mstate",
)
CUSTOMER_COLS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
SQL["mask_unknown_columns"] = with_(
    [CAT, MASK_RULES],
    f"""SELECT rule_id, column_name, 'column not in table' AS reason FROM mstate
WHERE lower(full_table_name) = 'dev_main_raw.crm.customer' AND lower(column_name) NOT IN ({', '.join(repr(c) for c in CUSTOMER_COLS)})""",
)


def _masked(col: str, visible: str) -> str:
    """A customer column as the masks in force show it to one reader."""
    own = f"(SELECT {{}} FROM mstate WHERE lower(full_table_name) = 'dev_main_raw.crm.customer' AND lower(column_name) = '{col}')"
    seen = visible.format(groups=own.format("user_group"))
    return f"CASE WHEN {seen} THEN CAST({col} AS VARCHAR) ELSE {own.format('type_of_masking')} END AS {col}"


MASKED = ("c_name", "c_acctbal", "c_mktsegment")
SQL["mask_columns"] = with_(
    [CAT, MASK_RULES],
    "SELECT " + ", ".join(_masked(c, "list_has_any({groups}, ['grp_3'])") if c in MASKED else c for c in CUSTOMER_COLS) + " FROM customer",
)
SQL["mask_by_reader"] = with_(
    [CAT, MASK_RULES],
    "SELECT r.reader, "
    + ", ".join(
        _masked(
            c,
            "EXISTS (SELECT 1 FROM customer m WHERE m.c_name = r.reader "
            "AND list_contains({groups}, concat('grp_', CAST(m.c_custkey % 40 AS STRING))))",
        )
        if c in MASKED
        else c
        for c in CUSTOMER_COLS
    )
    + " FROM customer, (VALUES ('Customer#000000001'), ('Customer#000000004')) r(reader)",
)

TAG_STATE_CTES = [SCHEMA_TAGS, TAG_RULES, *_TAG_STATE]
SQL["tag_job_state"] = SQL["tag_state"]
SQL["mask_job_state"] = SQL["mask_state"]


def _report(what: str, state: str) -> str:
    """What a run of both jobs reports, with the state that it leaves."""
    tag_n, mask_n = ("(SELECT count(*) FROM new_tags)", "(SELECT count(*) FROM mstate)") if state == "new" else ("(SELECT count(*) FROM old)", "(SELECT count(*) FROM existing_fx)")
    return f"""SELECT 'tag{what} steps' AS what, action AS name, count(*) AS n FROM targets WHERE action IN ('SET', 'UNSET') AND tags IS NOT NULL GROUP BY action
UNION ALL SELECT 'tag{what} steps', 'REJECT', count(*) FROM tag_rejects
UNION ALL SELECT 'tag{what} rejects', reason, count(*) FROM tag_rejects GROUP BY reason
UNION ALL SELECT 'tag{what} state', 'rows', {tag_n}
UNION ALL SELECT 'mask{what} steps', action, count(*) FROM mplan GROUP BY action
UNION ALL SELECT 'mask{what} rejects', reason, count(*) FROM mplan WHERE action = 'REJECT' GROUP BY reason
UNION ALL SELECT 'mask{what} state', 'rows', {mask_n}"""


SQL["job_reports"] = with_(
    [*TAG_STATE_CTES, f"new_tags AS ({_NEW_TAGS})", f"tag_rejects AS ({TAG_REJECTS})", CAT, MASK_RULES],
    _report("", "new") + "\nUNION ALL " + _report(" dry run", "old"),
)

_SEES = {c: _masked(c, "list_has_any({groups}, own)").split(" THEN ")[0].removeprefix("CASE WHEN ") for c in MASKED}
CLASSES = f"""readers AS (
SELECT reader, concat_ws(',', {", ".join(f"CASE WHEN {seen} THEN '{c}' END" for c, seen in _SEES.items())}) AS seen
FROM (SELECT c_name AS reader, list(concat('grp_', CAST(c_custkey % 40 AS STRING))) AS own FROM customer GROUP BY c_name))"""
SQL["mask_reader_classes"] = with_([CAT, MASK_RULES, CLASSES], "SELECT reader, seen FROM readers")
SQL["mask_by_class"] = with_(
    [CAT, MASK_RULES, CLASSES],
    "SELECT k.seen, " + ", ".join(_masked(c, f"list_contains(string_split(k.seen, ','), '{c}')") if c in MASKED else c for c in CUSTOMER_COLS)
    + " FROM customer, (SELECT DISTINCT seen FROM readers) k",
)

# --- 2.3 / 2.4 --------------------------------------------------------------
SQL["tag_resolve"] = with_(
    BASE,
    """SELECT DISTINCT r.acl_id, st.catalog_name || '.' || st.schema_name AS object_name
FROM rules r JOIN schema_tags_fx st ON list_has_any(r.tags, string_split(st.tag_value, ','))
WHERE r.tags IS NOT NULL""",
)
SQL["tag_resolve_incremental"] = with_(
    BASE,
    """SELECT DISTINCT r.acl_id, st.catalog_name || '.' || st.schema_name AS object_name
FROM (SELECT acl_id, string_split(CASE WHEN acl_id % 7 = 0 THEN NULL WHEN acl_id % 11 = 0 THEN 'LARGE,Brand#13' WHEN acl_id % 13 = 0 THEN 'Brand#999'
                       WHEN acl_id % 17 = 0 THEN tag_values || ',ECONOMY' ELSE tag_values END, ',') AS tags FROM rules) r
JOIN (SELECT * REPLACE (CASE WHEN CAST(schema_name[2:] AS INTEGER) % 5 = 0 THEN 'LARGE,' || tag_value
                             WHEN CAST(schema_name[2:] AS INTEGER) % 7 = 0 THEN 'Brand#13' ELSE tag_value END AS tag_value) FROM schema_tags_fx) st
  ON list_has_any(r.tags, string_split(st.tag_value, ','))""",
)
SQL["acl_objects"] = with_(GEN, "SELECT acl_id, source, object_name FROM objs")
SQL["statement_counts"] = with_(
    GEN,
    """SELECT count(*) AS total, count(DISTINCT access_statement) AS distinct_statements,
  count(*) FILTER (WHERE grant_type = 'GRANT') AS grants, count(*) FILTER (WHERE grant_type = 'REVOKE') AS revokes,
  count(*) = 0 AS is_empty FROM stmts""",
)

OUTCOMES = """outcomes AS (
SELECT p.*,
  CASE WHEN NOT p.m THEN 'failure' WHEN k.object_name IS NULL THEN 'failure' ELSE 'success' END AS status,
  false AS dry_run,
  CASE WHEN NOT p.m THEN 'unparseable statement' WHEN k.object_name IS NULL THEN 'object not found' END AS error
FROM parsed p LEFT JOIN known k ON k.object_name = p.object_name),
applied AS (SELECT * FROM outcomes WHERE status = 'success' AND m)"""
EXEC = ROUGH_GEN + [CATALOG_OBJECTS, PARSED, OUTCOMES]

SQL["execution_outcomes"] = with_(EXEC, "SELECT acl_id, access_statement, status, dry_run, error FROM outcomes")
SQL["execution_summary"] = with_(
    EXEC,
    """SELECT false AS dry_run, count(*) AS total, count(*) FILTER (WHERE status = 'success') AS success,
  count(*) FILTER (WHERE status = 'failure') AS failure FROM outcomes
UNION ALL
SELECT true AS dry_run, count(*) AS total, count(*) AS success, CAST(0 AS BIGINT) AS failure FROM stmts""",
)


def short(x: str, kind: str) -> str:
    parts = f"string_split({x}, '.')"
    pfx = f"string_split({parts}[1], '_')[3]"
    if kind == "TABLE":
        return f"concat_ws('.', {pfx}, {parts}[2], {parts}[3])"
    return f"concat_ws('.', {pfx}, {parts}[2])"


TRACK = """tag_keys AS (
SELECT DISTINCT object_type, user_group, tag_values, CAST(NULL AS VARCHAR) AS schema_names, CAST(NULL AS VARCHAR) AS table_names
FROM applied WHERE object_type = 'SCHEMA' AND tag_values IS NOT NULL),
schema_keys AS (
SELECT * FROM tag_keys
UNION ALL
SELECT object_type, user_group, CAST(NULL AS VARCHAR) AS tag_values, string_agg(n, ',' ORDER BY n) AS schema_names,
  CAST(NULL AS VARCHAR) AS table_names
FROM (SELECT DISTINCT object_type, user_group, {sshort} AS n FROM applied
      WHERE object_type = 'SCHEMA' AND tag_values IS NULL) GROUP BY object_type, user_group),
table_keys AS (
SELECT object_type, user_group, CAST(NULL AS VARCHAR) AS tag_values, CAST(NULL AS VARCHAR) AS schema_names,
  string_agg(n, ',' ORDER BY n) AS table_names
FROM (SELECT DISTINCT object_type, user_group, {tshort} AS n FROM applied WHERE object_type = 'TABLE')
GROUP BY object_type, user_group)""".format(sshort=short("object_name", "SCHEMA"), tshort=short("object_name", "TABLE"))
TRACKING = EXEC + [TRACK]

SQL["tracking_tag_keys"] = with_(TRACKING, "SELECT * FROM tag_keys")
SQL["tracking_schema_keys"] = with_(TRACKING, "SELECT * FROM schema_keys")
SQL["tracking_table_keys"] = with_(TRACKING, "SELECT * FROM table_keys")


def _chunks(kind: str, more: str) -> str:
    return f"""SELECT object_type, user_group, chunk, CAST(coalesce(sum(length(names) + 1) OVER (PARTITION BY object_type, user_group ORDER BY chunk
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, n, names
FROM (SELECT object_type, user_group, chunk, count(*) AS n, string_agg(short, ',' ORDER BY short) AS names
      FROM (SELECT *, (row_number() OVER (PARTITION BY object_type, user_group ORDER BY short) - 1) // 5 AS chunk
            FROM (SELECT DISTINCT object_type, user_group, {short('object_name', kind)} AS short FROM applied WHERE object_type = '{kind}'{more}))
      GROUP BY ALL)"""


SQL["tracking_schema_chunks"] = with_(TRACKING, _chunks("SCHEMA", " AND tag_values IS NULL"))
SQL["tracking_table_chunks"] = with_(TRACKING, _chunks("TABLE", ""))

TRACK_FX = """tracking_fx AS (
SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 2 = 0 THEN 'SCHEMA' ELSE 'TABLE' END AS object_type,
  concat('dev_main_raw.s', CAST(o_custkey % 50 AS STRING), CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE '.t1' END) AS object_name
FROM orders)"""
SQL["tracking_short_names"] = with_(
    [TRACK_FX],
    f"""SELECT ord, object_type, CASE WHEN object_type = 'TABLE' THEN {short('object_name', 'TABLE')}
  ELSE {short('object_name', 'SCHEMA')} END AS short_name FROM tracking_fx""",
)


def norm_list(x: str) -> str:
    return f"array_to_string(list_sort(list_distinct({items(x)})), ',')"


SQL["tracking_stamp_schema"] = with_(
    TRACKING,
    f"""SELECT a.acl_id, k.hit IS NOT NULL AS stamped
FROM acl a LEFT JOIN (SELECT DISTINCT object_type, user_group, tag_values, schema_names, true AS hit FROM schema_keys) k
  ON a.object_type = k.object_type AND a.user_group = k.user_group
 AND a.tag_values IS NOT DISTINCT FROM k.tag_values
 AND {norm_list('a.schema_names')} IS NOT DISTINCT FROM k.schema_names""",
)
SQL["tracking_stamp_table"] = with_(
    TRACKING,
    f"""SELECT a.acl_id, k.hit IS NOT NULL AS stamped
FROM acl a LEFT JOIN (SELECT DISTINCT object_type, user_group, table_names, true AS hit FROM table_keys) k
  ON a.object_type = k.object_type AND a.user_group = k.user_group
 AND {norm_list('a.table_names')} IS NOT DISTINCT FROM k.table_names""",
)
SQL["tracking_stamp_exact"] = with_(
    EXEC, "SELECT a.acl_id, a.acl_id IN (SELECT acl_id FROM applied) AS stamped FROM acl a"
)

# --- 2.5 ----------------------------------------------------------------------
_MERGE_KEYS = "object_type, user_group, permission_types, grant_type, bu, tag_values, schema_names, table_names, access_until"
UPSERT = f"""inc_ok AS (SELECT * FROM inc WHERE object_type IS NOT NULL AND user_group IS NOT NULL
  AND permission_types IS NOT NULL AND grant_type IS NOT NULL AND bu IS NOT NULL),
inc_k AS (SELECT *, min(acl_id) OVER (PARTITION BY {_MERGE_KEYS}) AS keep FROM inc_ok),
fresh AS (SELECT * FROM inc_k d WHERE acl_id = keep AND NOT EXISTS (SELECT 1 FROM tgt t WHERE t.object_type = d.object_type
  AND t.user_group = d.user_group AND t.permission_types = d.permission_types AND t.grant_type = d.grant_type
  AND t.bu = d.bu AND t.tag_values IS NOT DISTINCT FROM d.tag_values
  AND t.schema_names IS NOT DISTINCT FROM d.schema_names AND t.table_names IS NOT DISTINCT FROM d.table_names
  AND t.access_until IS NOT DISTINCT FROM d.access_until))"""
ALL_IN = [ACL_SHEET, ACL, INCOMING_SHEET, "tgt AS (SELECT * FROM acl)", "inc AS (SELECT * FROM inc_sheet)", UPSERT]
# the later sheet as text, with ends that are no dates: those override the null ends of shared keys
_BAD_DATE = "until_text IS NOT NULL AND NOT regexp_matches(until_text, '^\\d{4}-\\d{2}-\\d{2}$')"
UNIT_INC = f"inc AS (SELECT * FROM inc_sheet WHERE bu = 'BUILDING' AND NOT ({_BAD_DATE}))"
UNIT_IN = [ACL_SHEET, ACL, INCOMING_SHEET, "tgt AS (SELECT * FROM acl)", UNIT_INC, UPSERT]
_OUT = f"SELECT {SHEET_OUT}, CAST(access_until AS VARCHAR) AS access_until, bu FROM"
SQL["acl_upsert"] = with_(ALL_IN, f"{_OUT} tgt UNION ALL {_OUT} fresh")
UPSERT_REJECTS = """SELECT 'upsert' AS stage, acl_id, CAST(keep AS VARCHAR) AS value, 'duplicate key in sheet' AS reason
FROM inc_k WHERE acl_id <> keep
UNION ALL
SELECT 'upsert', acl_id, NULL, 'null in merge key' FROM inc WHERE object_type IS NULL OR user_group IS NULL
  OR permission_types IS NULL OR grant_type IS NULL OR bu IS NULL
UNION ALL
SELECT 'upsert', keep, CAST(count(*) - 1 AS VARCHAR), 'copies without an id of their own'
FROM inc_k WHERE acl_id = keep GROUP BY keep, object_type, user_group, permission_types, grant_type, bu, tag_values, schema_names, table_names, access_until HAVING count(*) > 1"""
SQL["acl_upsert_rejects"] = with_(ALL_IN, UPSERT_REJECTS)
_LOADED = f"SELECT {SHEET_OUT.replace('acl_id, ', '')}, CAST(access_until AS VARCHAR) AS access_until, bu, true AS has_id FROM"
SQL["acl_ingest"] = with_(UNIT_IN, f"{_LOADED} tgt UNION ALL {_LOADED} fresh")
SQL["acl_first_load"] = with_([*UNIT_IN[:3], "tgt AS (SELECT * FROM acl WHERE false)", *UNIT_IN[4:]], f"{_LOADED} fresh")
SHEET_REJECTS = f"SELECT 'read' AS stage, acl_id, until_text AS value, 'access_until is not a date' AS reason FROM inc_sheet WHERE {_BAD_DATE}"
# rows of one key have one id there, so copies are counted
SQL["acl_ingest_rejects"] = with_(
    UNIT_IN,
    f"""SELECT stage, reason, value FROM ({SHEET_REJECTS} AND bu = 'BUILDING')
UNION ALL SELECT 'upsert', 'null in merge key', NULL FROM inc WHERE object_type IS NULL
UNION ALL SELECT 'upsert', 'copies without an id of their own', CAST(count(*) - 1 AS VARCHAR) FROM inc_ok GROUP BY {_MERGE_KEYS} HAVING count(*) > 1""",
)
SQL["acl_expire_apply"] = with_(
    [ACL_SHEET, ACL],
    f"""SELECT acl_id, bu, CASE WHEN hit THEN 'REVOKE' ELSE grant_type END AS grant_type, hit AS stamped
FROM (SELECT *, bu = 'BUILDING' AND grant_type = 'GRANT' AND access_until IS NOT NULL AND access_until < {AS_OF} AS hit
      FROM acl)""",
)
SQL["acl_expire_calendar"] = SQL["acl_expire_apply"]
SQL["acl_expire_apply_keyed"] = with_(
    [ACL_SHEET, ACL, ACTIVE, EXPIRED],
    """SELECT a.acl_id, a.bu, coalesce(s.sg, a.grant_type) AS grant_type, s.sg IS NOT NULL AS stamped
FROM acl a LEFT JOIN (SELECT object_type, user_group, permission_types, schema_names, table_names, tag_values,
                   CASE WHEN bool_or(grant_type = 'REVOKE') THEN 'REVOKE' ELSE 'GRANT' END AS sg FROM expired GROUP BY ALL) s
  ON a.object_type = s.object_type AND a.user_group = s.user_group AND a.permission_types = s.permission_types
 AND a.schema_names IS NOT DISTINCT FROM s.schema_names AND a.table_names IS NOT DISTINCT FROM s.table_names
 AND a.tag_values IS NOT DISTINCT FROM s.tag_values AND s.sg <> a.grant_type""",
)

# --- 2.6 / 2.7 ----------------------------------------------------------------
FOLD = """SELECT privilege, object_type, object_name, user_group FROM last WHERE g = 'GRANT'
UNION ALL
SELECT o.* FROM old o WHERE NOT EXISTS (SELECT 1 FROM last l WHERE l.privilege = o.privilege
  AND l.object_type = o.object_type AND l.object_name = o.object_name AND l.user_group = o.user_group)"""
SQL["effective_grants"] = with_(
    ROUGH_GEN
    + [
        STORED_GRANTS,
        "ids AS (SELECT * REPLACE (CASE WHEN acl_id % 13 <> 0 THEN acl_id + 4611686018427387904 END AS acl_id) FROM stmts)",
        """last AS (SELECT privilege, object_type, object_name, user_group, grant_type AS g FROM ids
  QUALIFY row_number() OVER (PARTITION BY privilege, object_type, object_name, user_group
                             ORDER BY acl_id DESC NULLS LAST, grant_type ASC) = 1)""",
    ],
    FOLD,
)
SQL["acl_rejects"] = with_(
    ROUGH_GEN + [REF_STATUS.format(src="srules"), CATALOG_OBJECTS, PARSED, OUTCOMES, INCOMING_SHEET, "tgt AS (SELECT * FROM acl)",
                 "inc AS (SELECT * FROM inc_sheet)", UPSERT, MASK_RULES, TAG_RULES, URLS],
    f"""SELECT 'validate' AS stage, acl_id, coalesce(CASE WHEN object_type IS NULL THEN 'object_type' END,
  CASE WHEN user_group IS NULL THEN 'user_group' END, CASE WHEN permission_types IS NULL THEN 'permission_types' END,
  CASE WHEN grant_type IS NULL THEN 'grant_type' END) AS value, 'null in mandatory column' AS reason
FROM active WHERE object_type IS NULL OR user_group IS NULL OR permission_types IS NULL OR grant_type IS NULL
UNION ALL
SELECT 'validate', acl_id, g, 'backtick in group name' FROM (SELECT acl_id, unnest({items('user_group')}) AS g FROM active
  WHERE object_type IS NOT NULL AND user_group IS NOT NULL AND permission_types IS NOT NULL) WHERE contains(g, '`')
UNION ALL
SELECT 'privileges', acl_id, concat_ws('/', permission_group, object_type), 'no privileges for (env, group, type)'
FROM rules WHERE len(privileges) = 0
UNION ALL
SELECT 'resolve', acl_id, ref, status FROM ref_status WHERE status <> 'ok'
UNION ALL
SELECT 'resolve', acl_id, object_name, 'object name outside the statement grammar'
FROM all_tag_objs WHERE NOT regexp_full_match(object_name, {NAME})
UNION ALL
SELECT 'advice', acl_id, object_type, 'type_mismatch' FROM srules WHERE tags IS NOT NULL AND object_type <> 'SCHEMA'
UNION ALL
{SHEET_REJECTS}
UNION ALL
{UPSERT_REJECTS}
UNION ALL
SELECT 'execute', acl_id, access_statement, error FROM outcomes WHERE error = 'unparseable statement'
UNION ALL
SELECT 'mask', NULL, concat_ws(':', CAST(rule_id AS VARCHAR), table_name), reason FROM mplan WHERE action = 'REJECT'
UNION ALL
SELECT 'tag', NULL, concat_ws(':', CAST(rule_ord AS VARCHAR), target), reason FROM ({TAG_REJECTS})
UNION ALL
SELECT 'environment', NULL, url, status FROM ({ENV_SELECT}) WHERE status <> 'ok'""",
)

# --- 3.2 the whole cycle ------------------------------------------------------
SQL["acl_cycle_summary"] = with_(
    EXEC,
    """SELECT false AS dry_run, count(*) AS total, count(*) FILTER (WHERE status = 'success') AS success,
  count(*) FILTER (WHERE status = 'failure') AS failure FROM outcomes""",
)
SQL["acl_cycle_dry_run"] = with_(
    ROUGH_GEN + [STORED_GRANTS],
    "SELECT 'statements' AS what, count(*) AS total FROM stmts UNION ALL SELECT 'grants kept', count(*) FROM old",
)
SQL["acl_cycle_grants"] = with_(
    EXEC
    + [
        STORED_GRANTS,
        """last AS (SELECT permissions AS privilege, object_type, object_name, user_group, arg_max(grant_type, acl_id) AS g
         FROM applied GROUP BY ALL)""",
    ],
    FOLD,
)
SQL["acl_cycle_mapping"] = with_(
    EXEC,
    f"""SELECT acl_id, bu, CASE WHEN hit THEN 'REVOKE' ELSE grant_type END AS grant_type,
  hit OR acl_id IN (SELECT acl_id FROM applied) AS stamped
FROM (SELECT *, grant_type = 'GRANT' AND access_until IS NOT NULL AND access_until < {AS_OF} AS hit
      FROM acl WHERE bu = 'BUILDING')""",
)
