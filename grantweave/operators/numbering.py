"""Distributed numbering and ordered chunks: counts per range, prefix sums, places.

Both are two passes over rows that are stored in between, so that a range means
the same rows in both.  What is summed in order is one slim row per partition, or
per key and range, never the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grantweave.operators.resolve import fanout_partitions
from grantweave.session import materialize

#: Names that one chunk of an ordered list holds.
CHUNK_NAMES = 1_000
_PLACE_BITS = 33  # of monotonically_increasing_id, below the partition


def numbered(rows: DataFrame, first: int, column: str = "acl_id") -> DataFrame:
    """``rows`` with ``column`` set to first, first + 1, ...: no two alike, none left out.

    Rows are written with their place in their partition; the partitions'
    counts, one row each, give the number at which each starts.
    """
    kept = materialize(rows.drop(column).withColumn("_at", F.monotonically_increasing_id()), "numbering")
    kept = kept.withColumn("_part", F.shiftright("_at", _PLACE_BITS))
    counts = kept.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_part", (F.coalesce(before, F.lit(0)) + F.lit(first)).alias("_start"))
    place = F.col("_at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    out = kept.join(starts, "_part").withColumn(column, (F.col("_start") + place).cast("long"))
    return out.select(*[c for c in rows.columns if c != column], column)


def ordered_chunks(names: DataFrame, keys: list[str], name: str, size: int = CHUNK_NAMES, parts: int | None = None) -> DataFrame:
    """The sorted list of ``name`` per ``keys`` in chunks: (*keys, chunk, start, n, names).

    ``names`` are distinct rows without nulls in ``name``.  Ranges of (keys, name) are
    counted per key; a name's rank is its range's start plus its place there, and
    its chunk the rank by ``size``.  So chunks do not depend on the ranges, a key with
    any share of all names is spread over ranges and chunks, and no task gathers
    more than ``size`` names.  ``start`` is where the chunk begins in the whole
    comma-joined list, which is the chunks' texts in order, comma-joined.
    """
    cut = names.select(*keys, name).repartitionByRange(parts or fanout_partitions(names.sparkSession), *keys, name)
    cut = materialize(cut.withColumn("_range", F.spark_partition_id()), "ordered")
    counts = cut.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    here = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(name))
    ranked = cut.join(starts, [*keys, "_range"]).select(*keys, name, F.floor((F.col("_start") + here - 1) / size).cast("long").alias("chunk"))
    chunks = ranked.groupBy(*keys, "chunk").agg(F.count("*").alias("n"), F.concat_ws(",", F.sort_array(F.collect_list(name))).alias("names"))
    before = F.sum(F.char_length("names") + 1).over(Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    return chunks.select(*keys, "chunk", F.coalesce(before, F.lit(0)).cast("long").alias("start"), "n", "names")
