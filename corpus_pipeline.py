"""The corpus pipeline: documents to packed training sequences.

``STAGES`` lists the stages in order.  Each takes (spark, docs, sf_dir), where
docs is what its predecessor kept, and returns a DataFrame; all but the last
return the columns of documents.  ``run`` writes every stage's result to the
shared checkpoint folder and hands the reread table on, so a lost executor never
costs more than the stage it was lost in.

Null ids and texts, empty and long texts, repeated rows, empty tables and extra
columns are treated as each stage's operator documents; extra columns pass all
stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grantweave.llm import line_rules, packing, quality, simhash_dedup
from grantweave.llm.common import Scratch, table
from grantweave.llm.queries import tokenizer_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine, fitted on the labelled ones among them, lets pass."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    mark = "__quality"
    return quality.score(docs, model, docs.columns, mark).filter(F.col(mark) >= quality.PASS).select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that keep enough of their text, without their failing lines."""
    return line_rules.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of close fingerprints."""
    return simhash_dedup.one_of_each(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in training sequences."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("packing", packed),
]

#: SQL has neither the classifier, XXH64 nor the tokenizer; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs, stored = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
        if stored is not None:
            scratch.drop(stored)
        stored = docs
    return docs
