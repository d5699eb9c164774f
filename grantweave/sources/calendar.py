"""The mapping stored as an expiry calendar: clustered by unit, grant type and end month.

A daily expiry run reads only what can expire: the unit's grants whose end month
is not after the run's.  What has expired moves to the revoked rows of its month,
so past months hold no grants and are not read again, and grants without an end
are never read.  Writing back touches the months that lost a grant, and no others.

Each step replaces whole months by what they hold afterwards, revoked rows first,
so a run that is lost half-way is repeated with the same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from grantweave import schemas
from grantweave.operators import rules as R
from grantweave.session import materialize

MONTH = "end_month"
NO_END = "none"  # sorts after every month
_CLUSTER = ["bu", "grant_type", MONTH]
_SCHEMA = StructType([*schemas.ACL_MAPPING.fields, StructField(MONTH, StringType(), True)])


def end_month():
    return F.coalesce(F.date_format("access_until", "yyyy-MM"), F.lit(NO_END))


def _by_folder(rows: DataFrame) -> DataFrame:
    """Rows brought together by folder, so a month is few files; AQE splits a folder of many rows."""
    return rows.hint("rebalance", *[F.col(c) for c in _CLUSTER])


def write_calendar(mapping: DataFrame, path: str) -> None:
    """First load: the whole mapping, one folder per unit, grant type and end month."""
    _by_folder(mapping.withColumn(MONTH, end_month())).write.mode("errorifexists").partitionBy(*_CLUSTER).parquet(path)


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_SCHEMA).parquet(path)


def expirable(spark: SparkSession, path: str, bu: str, as_of=None) -> DataFrame:
    """The unit's expired grants; the scan is pruned to grants that end up to the run's month."""
    month = F.date_format(R.as_of_date(as_of), "yyyy-MM")
    own = (F.col("bu") == F.lit(bu)) & (F.col("grant_type") == F.lit(R.GRANT)) & (F.col(MONTH) <= month)
    return read_calendar(spark, path).filter(own & R.expired(as_of))


def _replace(rows: DataFrame, path: str) -> None:
    """Replace the folders that ``rows`` (stored elsewhere) belong to."""
    _by_folder(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*_CLUSTER).parquet(path)


def expire(spark: SparkSession, path: str, bu: str, as_of=None, stamp=None) -> list[str]:
    """Revoke the unit's expired grants in place; the end months that lost a grant, in order."""
    gone = materialize(expirable(spark, path, bu, as_of), "expired")
    months = sorted(r[MONTH] for r in gone.select(MONTH).distinct().collect())  # one row per month
    if not months:
        return []
    flips = gone.withColumns({"grant_type": F.lit(R.REVOKE), "updated_datetime": R.stamp_ts(stamp)})
    touched = read_calendar(spark, path).filter((F.col("bu") == F.lit(bu)) & F.col(MONTH).isin(months))
    before = touched.filter(F.col("grant_type") == F.lit(R.REVOKE)).join(gone.select("acl_id"), "acl_id", "left_anti")
    revoked = materialize(before.select(*flips.columns).unionByName(flips), "revoked")
    live = touched.filter((F.col("grant_type") == F.lit(R.GRANT)) & ~R.expired(as_of))
    live = materialize(live, "granted")
    left = {r[MONTH] for r in live.select(MONTH).distinct().collect()}
    _replace(revoked, path)
    _replace(live, path)
    unit = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(bu)
    for month in set(months) - left:  # nothing is granted there any more
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/bu={unit}/grant_type={R.GRANT}/{MONTH}={month}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    spark.catalog.refreshByPath(path)
    return months
