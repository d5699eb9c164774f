"""Helpers shared by the corpus operators."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Hashable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents whose crc32(doc_id as text) leaves this remainder are held out of training.
FOLDS, HELD_OUT_FOLD = 4, 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is held out; a null id is not."""
    fold = F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS))
    return F.coalesce(fold == HELD_OUT_FOLD, F.lit(False))


def text_bytes(column: str = "text") -> Column:
    """A text as UTF-8 bytes; null stays null."""
    return F.col(column).cast("binary")


def per_worker(key: Hashable, make: Callable[[], Any]) -> Any:
    """A bounded read-only model or look-up table kept by a Python worker between tasks."""
    kept = sys.modules.setdefault("grantweave_per_worker", types.ModuleType("grantweave_per_worker")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


#: Column types that ``map_texts`` can add, by their SQL names.
ADDED = {"long": (T.LongType(), pa.int64()), "double": (T.DoubleType(), pa.float64()), "boolean": (T.BooleanType(), pa.bool_()), "string": (T.StringType(), pa.string())}


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so a task holds the Python objects of a few texts only."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def map_texts(docs: DataFrame, carry: Sequence[str], make: Callable[[], Callable], added: dict[str, str], text: Column | str = "text") -> DataFrame:
    """Columns ``carry`` of ``docs`` unchanged, and the columns ``added`` (name: type) computed from its text.

    ``make`` is called once per task; what it returns gets a batch's texts (null
    as None) and returns one sequence per added column.  A carried column named
    as an added one is replaced by it.
    """
    carry = [c for c in carry if c.lower() not in {a.lower() for a in added}]
    schema = T.StructType([*(docs.schema[c] for c in carry), *(T.StructField(n, ADDED[t][0]) for n, t in added.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for b in small_batches(batches):
            found = compute(b.column("__text").to_pylist())
            new = [pa.array(values, ADDED[t][1]) for values, t in zip(found, added.values())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carry), *new], schema.names)

    source = F.col(text) if isinstance(text, str) else text
    return docs.select(*carry, source.alias("__text")).mapInArrow(run, schema)


class Scratch:
    """Numbered snapshots below the session's shared checkpoint folder.

    ``keep`` writes a frame and reads it back: lineage ends there, so a lost
    executor re-reads files.  ``drop`` removes a snapshot that no later step
    reads; the caller never drops what its result still reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = scratch_path(spark, name)

    def keep(self, df: DataFrame, *partition_by: str) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex}"
        writer = df.write.mode("errorifexists")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._snapshot = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df._snapshot)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
