"""The ACL mapping: read a business unit's sheet, stamp it, write the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from grantweave import schemas
from grantweave.operators.rules import stamp_ts

SHEET_COLUMNS = [f.name for f in schemas.MAPPING_SHEET.fields]
REASON_DATE = "access_until is not a date"
REASON_MALFORMED = "malformed line"
_DATE = r"^\d{4}-\d{2}-\d{2}$"


def sheet_path(root: str, bu: str) -> str:
    """Where a business unit's sheet lives: one folder per unit."""
    return f"{root.rstrip('/')}/bu={bu}"


def read_sheet(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """A mapping sheet with the explicit schema, plus ``_malformed``.

    A sheet may come without ``acl_id`` (its rows then have none yet).  A CSV
    needs a header; a line that does not fit it is kept in ``_malformed`` and
    rejected later, instead of stopping the batch.
    """
    if fmt != "csv":
        df = spark.read.format(fmt).load(path)
        have = set(df.columns)
        cols = [F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.MAPPING_SHEET]
        return df.select(*cols, F.lit(None).cast("string").alias(schemas.MALFORMED))
    header = spark.read.option("header", True).csv(path).columns  # reads one line
    fields = [f for f in schemas.MAPPING_SHEET.fields if f.name != "acl_id" or "acl_id" in header]
    schema = StructType([*fields, StructField(schemas.MALFORMED, StringType())])
    df = (
        spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "PERMISSIVE")
        .option("columnPruning", False)  # a pruned line is not checked whole
        .option("columnNameOfCorruptRecord", schemas.MALFORMED).csv(path)
    )
    return df if "acl_id" in header else df.select(F.lit(None).cast("long").alias("acl_id"), "*")


def _date(c: str):
    """A ``yyyy-MM-dd`` text as a date; null for anything else."""
    return F.when(F.col(c).rlike(_DATE), F.try_to_date(F.col(c)))


def _readable():
    return F.col(schemas.MALFORMED).isNull() & (F.col("access_until").isNull() | _date("access_until").isNotNull())


def stamp(sheet: DataFrame, bu: str, processed=None) -> DataFrame:
    """Engine shape of the readable rows: dates, ingest stamps, bu.

    Rows of a sheet without ids have none yet: they get one when they are
    stored (:class:`UnitIds`).

    Malformed lines and rows whose ``access_until`` is no ``yyyy-MM-dd`` date
    stay out (a grant must not become permanent because its end could not be
    read); :func:`sheet_rejects` reports them.
    """
    ok = sheet.filter(_readable()) if schemas.MALFORMED in sheet.columns else sheet
    return ok.select(
        "acl_id",
        *[c for c in SHEET_COLUMNS if c not in ("acl_id", "access_until")],
        _date("access_until").alias("access_until"),
        F.lit(bu).cast("string").alias("bu"),
        stamp_ts(processed).alias("processed_datetime"),
        F.lit(None).cast("timestamp").alias("updated_datetime"),
    ).select(*[f.name for f in schemas.ACL_MAPPING.fields])


def read_mapping(spark: SparkSession, root: str, bu: str, fmt: str = "csv", processed=None) -> DataFrame:
    return stamp(read_sheet(spark, sheet_path(root, bu), fmt), bu, processed)


def sheet_rejects(sheet: DataFrame) -> DataFrame:
    """Rows that ``stamp`` leaves out: (stage, acl_id, value, reason)."""
    broken = F.col(schemas.MALFORMED).isNotNull()
    value = F.when(broken, F.col(schemas.MALFORMED)).otherwise(F.col("access_until"))
    reason = F.when(broken, F.lit(REASON_MALFORMED)).otherwise(F.lit(REASON_DATE))
    return sheet.filter(~_readable()).select(F.lit("read").alias("stage"), "acl_id", value.alias("value"), reason.alias("reason"))


def write_sheets(sheets: DataFrame, root: str, fmt: str = "csv") -> None:
    """Write sheets of many business units in one job, one folder per unit."""
    cols = [c for c in SHEET_COLUMNS if c in sheets.columns]
    w = sheets.select(*cols, "bu").write.mode("errorifexists").partitionBy("bu").format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    w.save(root)


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether a mapping table has been stored at ``path``."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_table(mapping: DataFrame, path: str) -> None:
    """First load / new snapshot: the whole mapping, partitioned by bu so a
    later ``bu = :bu`` filter prunes to one folder."""
    mapping.write.mode("errorifexists").partitionBy("bu").parquet(path)


class UnitIds:
    """Ids of a mapping table's units: the unit's number above ``BITS`` bits, a count below.

    The table's ids of each unit have a high-water mark, stored beside the table
    and only ever raised, so an id is never given twice, even after its row is
    gone.  A run that ends between the table and the mark is made good by the
    ids in the table.  One ingest of a table at a time, as for the table itself.
    """

    BITS = 40
    SCHEMA = "bu string, unit long, mark long"

    def __init__(self, spark: SparkSession, table_path: str, bu: str):
        self.spark, self.path, self.bu = spark, f"{table_path.rstrip('/')}__ids", bu
        marks = spark.read.schema(self.SCHEMA).parquet(self.path) if table_exists(spark, self.path) else spark.createDataFrame([], self.SCHEMA)
        own = F.col("bu") == F.lit(bu)
        row = marks.agg(F.max(F.when(own, F.col("unit"))).alias("unit"), F.max(F.when(own, F.col("mark"))).alias("mark"), F.max("unit").alias("last")).first()
        self.unit = row["unit"] if row["unit"] is not None else (row["last"] or 0) + 1
        self.mark = row["mark"] or 0

    def next_id(self, stored: DataFrame | None) -> int:
        """The id after the unit's mark and all ids of its stored rows."""
        top = None
        if stored is not None:
            mine = F.shiftright("acl_id", self.BITS) == F.lit(self.unit)
            top = stored.agg(F.max(F.when(mine, F.col("acl_id").bitwiseAND(F.lit((1 << self.BITS) - 1))))).first()[0]
        self.mark = max(self.mark, top or 0)
        return (self.unit << self.BITS) + self.mark + 1

    def raise_by(self, n: int) -> None:
        """Store the mark after ``n`` more ids."""
        self.mark += n
        self.spark.createDataFrame([(self.bu, self.unit, self.mark)], self.SCHEMA).coalesce(1).write.mode("append").parquet(self.path)


def replace_units(mapping: DataFrame, path: str) -> None:
    """Replace only the business units that ``mapping`` holds.

    ``mapping`` must not read ``path`` (write it to a snapshot first).
    """
    mapping.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bu").parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.ACL_MAPPING).parquet(path)
