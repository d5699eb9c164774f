"""Generation plan: expire -> normalise -> privileges -> objects -> factors -> statements.

The unit's rules are normalised once and stored, slim, since tag lists, refs
and rejects all start from them.  The shuffles are one of the rules and those of
the tag join (item equi-join + distinct + join back, hot lists dealt to several
tasks); schema and table refs resolve in place through the catalog map, and the
group/privilege expansion is a pair of narrow explodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantweave.operators import factors, resolve, rules, statements
from grantweave.session import materialize

RULE_COLUMNS = ["grant_type", "object_type", "groups", "privileges", "tag_values"]


def checked_rules(mapping: DataFrame, permission_mapping: DataFrame, env: str, bu: str, as_of=None, stamp=None) -> DataFrame:
    """Normalised active rules of ``bu`` after expiry, with privileges and what is wrong with each.

    Rows without a mandatory column are here with ``missing`` set; they make
    nothing and are rejects.
    """
    act = rules.expire(rules.active_grants(mapping, bu), as_of, stamp)
    return rules.with_privileges(rules.normalize(act), permission_mapping, env)


def active_rules(mapping: DataFrame, permission_mapping: DataFrame, env: str, bu: str, as_of=None, stamp=None) -> DataFrame:
    """Normalised active rules of ``bu`` after expiry, with privileges and every mandatory column."""
    return checked_rules(rules.complete(mapping), permission_mapping, env, bu, as_of, stamp)


def statement_rules(rule_rows: DataFrame) -> DataFrame:
    """Rules that can produce statements (every mandatory column, non-empty privilege list)."""
    return rule_rows.filter(F.col("missing").isNull() & (F.size("privileges") > 0))


def rule_factors(rule_rows: DataFrame, schema_tags: DataFrame, catalog_mapping: DataFrame, env: str) -> DataFrame:
    """The factors (``operators.factors``) of normalised rules, which are read several times."""
    return factors.factors(resolve.resolve_objects(statement_rules(rule_rows), schema_tags, catalog_mapping, env, keep=RULE_COLUMNS))


def generate_factors(
    mapping: DataFrame,
    schema_tags: DataFrame,
    permission_mapping: DataFrame,
    catalog_mapping: DataFrame,
    env: str,
    bu: str,
    as_of=None,
    stamp=None,
) -> DataFrame:
    """One row per (rule, object) of a business unit, with the rule's groups and privileges as lists."""
    r = materialize(statement_rules(active_rules(mapping, permission_mapping, env, bu, as_of, stamp)), "rules")
    return rule_factors(r, schema_tags, catalog_mapping, env)


def generate_statements(
    mapping: DataFrame,
    schema_tags: DataFrame,
    permission_mapping: DataFrame,
    catalog_mapping: DataFrame,
    env: str,
    bu: str,
    as_of=None,
    stamp=None,
) -> DataFrame:
    """GRANT/REVOKE statement rows for one business unit (schema ``STATEMENTS``)."""
    return statements.expand(generate_factors(mapping, schema_tags, permission_mapping, catalog_mapping, env, bu, as_of, stamp))
