"""From raw documents to packed training sequences, in five stages.

Each stage takes all rows that the one before it kept; all but the last return the columns of documents. Between stages
the rows are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhound.llm.common import documents, row_named, shared_folder, stored
from tallyhound.llm.exact_dedup import exact_dedup
from tallyhound.llm.language_id import accepted
from tallyhound.llm.near_dedup import near_dedup
from tallyhound.llm.packing import packed_documents
from tallyhound.llm.secret_scan import redacted
from tallyhound.sources.tables import passing


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in no language that is known with some probability, go."""
    return accepted(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, whatever the ids: the longest original, then the smallest id, null ids last."""
    rows = row_named(docs)
    longest = -F.coalesce(F.length("text"), F.lit(0))
    path = shared_folder(spark, "exact-copies")
    with passing(spark):
        _others(rows, exact_dedup(rows, id_col="_row").select("_row", F.col("keep_id").alias("_group")), longest).write.parquet(path)
    return _without(spark, rows, path)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of similarity 0.8 over five-word shingles tie together, one row stays: the smallest id, null ids last."""
    rows = row_named(docs)
    path = shared_folder(spark, "near-copies")
    with passing(spark):
        _others(rows, near_dedup(rows, words=5, least=80, id_col="_row").select("_row", F.col("component_id").alias("_group"))).write.parquet(path)
    return _without(spark, rows, path)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; every document stays."""
    return redacted(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each document, or piece of a long one, in a training sequence."""
    return packed_documents(docs)


def _others(rows: DataFrame, groups: DataFrame, *before: Column) -> DataFrame:
    """(_row) of all rows but one of each group (_row, _group): the first by the columns `before`, then by doc_id, then by name."""
    order = [*(c.alias(f"_{i}") for i, c in enumerate(before)), F.col("doc_id").isNull().alias("_unknown"), F.col("doc_id"), F.col("_row")]
    groups = stored(groups, "groups")
    first = groups.join(rows.select("_row", F.struct(*order).alias("_order")), "_row").groupBy("_group").agg(F.min("_order").alias("_order"))
    return groups.select("_row").join(first.select("_order._row"), "_row", "left_anti")


def _without(spark: SparkSession, rows: DataFrame, path: str) -> DataFrame:
    """rows without those named in a table. Spark broadcasts that where its size on disk is small, and shuffles otherwise."""
    return rows.join(spark.read.schema("_row string").parquet(path), "_row", "left_anti").drop("_row")


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("secret_scan", mask_secrets),
    ("best_fit_packing", pack_sequences),
]

#: Learnt weights, a signature forest and a packing heuristic are beyond SQL; the tests hold each stage to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's result is written; what a stage wrote on its way is removed after that."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        path = shared_folder(spark, name)
        with passing(spark):
            stage(spark, docs, sf_dir).select(*docs.columns).write.parquet(path)
        docs = spark.read.schema(docs.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
