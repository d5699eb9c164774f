"""Comma-list and name handling as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes (str.isspace()), derived by rule.
# Spark's trim() only removes spaces; btrim with this set matches Python.
PY_WHITESPACE = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c: Column | str) -> Column:
    """Remove leading and trailing whitespace (tabs and newlines included)."""
    return F.btrim(_c(c), F.lit(PY_WHITESPACE))


def present(c: Column | str) -> Column:
    """Non-null and non-empty text (Python truthiness of a string)."""
    c = _c(c)
    return c.isNotNull() & (c != "")


def comma_items(c: Column | str) -> Column:
    """Split a comma list and strip each item; empty items are kept."""
    return F.transform(F.split(_c(c), ","), py_strip)


def nonblank_items(c: Column | str) -> Column:
    """Split a comma list, strip each item and drop the empty ones."""
    return F.filter(comma_items(c), lambda x: x != "")


def dotted(c: Column | str) -> Column:
    """Split a reference on '.', keeping empty parts (``'a.'`` has 2 parts)."""
    return F.split(_c(c), r"\.")
