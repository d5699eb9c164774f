"""Ingest one business unit's mapping sheet into the stored mapping table.

read sheet -> reject what cannot be read -> stamp -> upsert into the unit's
rows -> replace the unit's partition.  Every row of the sheet is inserted, matches
a stored one, or is accounted for in the rejects.  Whether a table is stored at the path
decides between a first load and a merge; both leave out the same rows.  New
rows of a sheet without ids get the unit's next ones; stored rows keep theirs.  Only
the sheet's unit is read and written: ``bu`` is part of the merge key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grantweave.operators import numbering, upsert
from grantweave.session import materialize
from grantweave.sources import mapping


@dataclass
class IngestResult:
    table: DataFrame
    path: str
    rejects: DataFrame
    created: bool
    duplicates: DataFrame  # of the rejects, the copies counted per merge key


def ingest_sheet(spark: SparkSession, sheet_root: str, bu: str, table_path: str, fmt: str = "csv", processed=None) -> IngestResult:
    sheet = mapping.read_sheet(spark, mapping.sheet_path(sheet_root, bu), fmt)
    incoming = mapping.stamp(sheet, bu, processed)
    created = not mapping.table_exists(spark, table_path)
    target = None if created else mapping.read_table(spark, table_path).filter(F.col("bu") == F.lit(bu))
    fresh = materialize(upsert.new_rows(incoming.limit(0) if created else target, incoming), "new_rules")
    ids = mapping.UnitIds(spark, table_path, bu)
    unnumbered = fresh.filter(F.col("acl_id").isNull())
    n = unnumbered.count()
    given = numbering.numbered(unnumbered, ids.next_id(target)) if n else unnumbered
    fresh = fresh.filter(F.col("acl_id").isNotNull()).unionByName(given.select(*fresh.columns))
    if created:
        mapping.write_table(fresh, table_path)
    else:
        merged = materialize(target.unionByName(fresh), "acl_mapping")  # the unit is read until here
        mapping.replace_units(merged, table_path)
    if n:
        ids.raise_by(n)
    spark.catalog.refreshByPath(table_path)
    table = mapping.read_table(spark, table_path)
    duplicates = upsert.copies_of(table.filter(F.col("bu") == F.lit(bu)), incoming)
    rejects = mapping.sheet_rejects(sheet).unionByName(upsert.upsert_rejects(incoming, duplicates))
    return IngestResult(table, table_path, rejects, created, duplicates)
