"""Small configuration rows as a JVM-side literal relation.

``createDataFrame`` over Python rows plans a Python RDD scan (a Python worker
per task); configuration relations are instead built as an ``inline`` of a
literal array, which Catalyst folds into a local scan and can broadcast.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from grantweave.functions.sizing import mark_bounded


def _lit(v, t: DataType) -> Column:
    if v is None:
        return F.lit(None).cast(t)
    if isinstance(t, ArrayType):
        return F.array(*[_lit(x, t.elementType) for x in v]).cast(t) if len(v) else F.array().cast(t)
    if isinstance(t, MapType):
        if not v:
            return F.create_map().cast(t)
        return F.create_map(*[c for k, x in v.items() for c in (_lit(k, t.keyType), _lit(x, t.valueType))])
    if isinstance(t, StructType):
        return F.struct(*[_lit(x, f.dataType).alias(f.name) for x, f in zip(v, t.fields)])
    return F.lit(v).cast(t)


def literal_frame(spark: SparkSession, rows: Iterable[Sequence], schema: StructType) -> DataFrame:
    rows = list(rows)
    t = ArrayType(schema, False)
    arr = F.array(*[_lit(tuple(r), schema) for r in rows]).cast(t) if rows else F.array().cast(t)
    df = spark.range(1).select(F.inline(arr)).select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]
    )
    return mark_bounded(df, len(rows))
