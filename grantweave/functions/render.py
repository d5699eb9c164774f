"""Statement text: rendering, parsing and derived names (column expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from grantweave.functions.columns import dotted, py_strip

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for identical results).
# Statement grammar accepted by the executor; anchored at the start only,
# matched against the stripped statement, case-sensitive.
STATEMENT_PATTERN = r"(GRANT|REVOKE)\s+(.*?)\s+ON\s+(\w+)\s+([\w.]+)\s+(TO|FROM)\s+`([^`]+)`"
# Mask function names: "{table}_{column}_mask" with "-" replaced by "_".
MASK_SUFFIX = "_mask"
# How a missing tag value reads in a SET TAGS statement and in the tag state.
NULL_TAG_VALUE = "None"
# ---------------------------------------------------------------------------

# Java's \w and \s are ASCII-only by default; (?U) gives them the Unicode
# meaning Python's re module uses for text.
_ANCHORED = "(?U)^" + STATEMENT_PATTERN


def render_statement(
    grant_type: Column, privilege: Column, object_type: Column, object_name: Column, group: Column
) -> Column:
    """``{grant} {privilege} ON {type} {object} {TO|FROM} `{group}```."""
    direction = F.when(grant_type == "GRANT", F.lit("TO")).otherwise(F.lit("FROM"))
    return F.concat(
        grant_type, F.lit(" "), privilege, F.lit(" ON "), object_type, F.lit(" "), object_name,
        F.lit(" "), direction, F.lit(" `"), group, F.lit("`"),
    )


# Java's \w and \s are ASCII-only by default; (?U) gives them the Unicode
# meaning Python's re module uses for text.  On pure-ASCII text both agree, so
# the (slower) Unicode pattern only runs on rows with non-ASCII characters.
_ASCII_ANCHORED = "^" + STATEMENT_PATTERN
_NUL = "\u0000"


def _record_of_stripped(s: Column) -> Column:
    rewrite = _NUL + "$1`$3`$4`$6`$2"
    ascii_only = F.length(s) == F.octet_length(s)
    rec = F.when(ascii_only, F.regexp_replace(s, _ASCII_ANCHORED + r"[\s\S]*", rewrite)).otherwise(
        F.regexp_replace(s, _ANCHORED + r"[\s\S]*", rewrite)
    )
    # A row matched iff the rewrite starts with NUL while the input did not.
    return F.when(~s.startswith(_NUL), rec)


def statement_record(statement: Column) -> Column:
    """One regex pass: a matching statement becomes
    ``NUL grant`type`object`group`permissions``; a non-match stays as is.

    Backticks cannot occur in the grant, type, object or group captures, and
    the free-text permissions capture goes last, so splitting on the first
    four backticks is exact.
    """
    return _record_of_stripped(py_strip(statement))


def _struct_of_parts(matched: Column, parts: Column, tags: Column) -> Column:
    return F.when(
        matched,
        F.struct(
            F.get(parts, 0).alias("grant_type"),
            F.get(parts, 4).alias("permissions"),
            F.get(parts, 1).alias("object_type"),
            F.get(parts, 2).alias("object_name"),
            F.get(parts, 3).alias("user_group"),
            tags.alias("tag_values"),
        ),
    )


def record_struct(record: Column, tag_values: Column | None = None) -> Column:
    """The parsed struct from :func:`statement_record`; null for a non-match."""
    parts = F.split(F.substr(record, F.lit(2)), "`", 5)
    tags = tag_values if tag_values is not None else F.lit(None).cast("string")
    return _struct_of_parts(record.startswith(_NUL), parts, tags)


def parse_statement(statement: Column, tag_values: Column | None = None) -> Column:
    """Parse a GRANT/REVOKE text into a struct; null when it does not match.

    For whole relations prefer :func:`parse_statements`, which computes the
    regex rewrite once per row even when the struct's fields are selected
    separately.
    """
    return record_struct(statement_record(statement), tag_values)


def parse_statements(df, statement: str = "access_statement", tag_values: str | None = "tag_values", out: str = "p"):
    """Add the parsed struct column ``out`` to ``df`` (one regex pass per row).

    Each step (strip, rewrite, split) is its own projection; Catalyst does not
    inline an expensive expression that is referenced several times, so the
    regex and the split run once per row even when the struct's fields are
    selected separately.
    """
    tags = F.col(tag_values) if tag_values else F.lit(None).cast("string")
    return (
        df.withColumn("_stmt_s", py_strip(F.col(statement)))
        .withColumn("_stmt_rec", _record_of_stripped(F.col("_stmt_s")))
        .withColumn("_stmt_parts", F.split(F.substr(F.col("_stmt_rec"), F.lit(2)), "`", 5))
        .withColumn(out, _struct_of_parts(F.col("_stmt_rec").startswith(_NUL), F.col("_stmt_parts"), tags))
        .drop("_stmt_s", "_stmt_rec", "_stmt_parts")
    )


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _made_of(c: Column, chars: str) -> Column:
    """Whether a text consists of ``chars``; the slower Unicode classes only where it is not ASCII."""
    ascii_only = F.length(c) == F.octet_length(c)
    return F.when(ascii_only, c.rlike(f"^{chars}+\\z")).otherwise(c.rlike(f"(?U)^{chars}+\\z"))


def fits_type(object_type: Column | str) -> Column:
    """Whether the grammar reads the text as an object type: one word."""
    return _made_of(_c(object_type), r"\w")


def fits_name(object_name: Column | str) -> Column:
    """Whether the grammar reads the text as an object name: words and dots, no blank and no quote."""
    return _made_of(_c(object_name), r"[\w.]")


def fits_group(group: Column | str) -> Column:
    """Whether the text can stand between the quotes of a group."""
    return (_c(group) != "") & ~_c(group).contains("`")


def fits_privilege(privilege: Column | str) -> Column:
    """Whether the text can stand before ``ON``: one line without a quote."""
    return ~_c(privilege).rlike("[`\\n\\r\\u0085\\u2028\\u2029]")


def short_object_name(object_name: Column, object_type: str) -> Column:
    """``a_b_prefix.schema[.table]`` -> ``prefix.schema[.table]``.

    The catalog's third ``_`` token is the reference prefix; a missing token
    or part is skipped (``get`` yields null, ``concat_ws`` drops it).
    """
    parts = dotted(object_name)
    prefix = F.get(F.split(F.get(parts, 0), "_"), 2)
    if object_type == "TABLE":
        return F.concat_ws(".", prefix, F.get(parts, 1), F.get(parts, 2))
    return F.concat_ws(".", prefix, F.get(parts, 1))


def mask_function_name(table: Column, column: Column) -> Column:
    return F.replace(F.concat(table, F.lit("_"), column, F.lit(MASK_SUFFIX)), F.lit("-"), F.lit("_"))


def _quoted(x: Column) -> Column:
    # Quotes inside keys/values are doubled so the text stays one literal.
    return F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("''")), F.lit("'"))


def tag_value(value: Column) -> Column:
    """A tag's value as text; a missing one keeps its entry."""
    return F.coalesce(value, F.lit(NULL_TAG_VALUE))


def render_tag_statement(action: Column, target_type: Column, target: Column, tags: Column) -> Column:
    """``ALTER {type} {target} SET TAGS ('k' = 'v', ...)`` or ``UNSET TAGS ('k', ...)``."""
    set_items = F.array_join(
        F.transform(F.map_entries(tags), lambda e: F.concat(_quoted(e["key"]), F.lit(" = "), _quoted(tag_value(e["value"])))),
        ", ",
    )
    unset_items = F.array_join(F.transform(F.map_keys(tags), _quoted), ", ")
    head = F.concat(F.lit("ALTER "), target_type, F.lit(" "), target)
    return (
        F.when(action == "SET", F.concat(head, F.lit(" SET TAGS ("), set_items, F.lit(")")))
        .when(action == "UNSET", F.concat(head, F.lit(" UNSET TAGS ("), unset_items, F.lit(")")))
    )
