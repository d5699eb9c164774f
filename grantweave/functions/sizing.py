"""Broadcast hints for literal configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A configuration relation of up to this many literal rows, each of a few short strings, is broadcast.
MAX_LITERAL_ROWS = 10_000
_ROWS_ATTR = "_grantweave_max_rows"


def mark_bounded(df: DataFrame, max_rows: int) -> DataFrame:
    """Record that ``df`` consists of at most ``max_rows`` literal rows."""
    setattr(df, _ROWS_ATTR, int(max_rows))
    return df


def known_bound(df: DataFrame | None) -> int | None:
    return getattr(df, _ROWS_ATTR, None) if df is not None else None


def broadcast_if_literal(df: DataFrame, made_from: DataFrame | None = None) -> DataFrame:
    """Hint a broadcast of ``df`` if it (or the relation it was filtered from) is literal configuration.

    Anything else is returned as it is: Catalyst and AQE choose by size in
    bytes, which no row count here could stand for.
    """
    bound = known_bound(df)
    if bound is None:
        bound = known_bound(made_from)
    return F.broadcast(df) if bound is not None and bound <= MAX_LITERAL_ROWS else df
