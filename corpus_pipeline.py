"""From raw documents to packed training sequences, one operator a stage.

Each stage gets what the stage before kept, reread from Parquet, and works on all of it. All
but the last return the columns of ``documents``; n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from faultspark.functions.iterate import shared_folder
from faultspark.llm import line_dedup, mixing, near_join, packing, quality_rules


def _with_text(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` with clean_text as text."""
    new = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("bigint")}
    return rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail the quality rules go, then documents that the rules reject."""
    return _with_text(quality_rules.quality_rules(docs).filter("kept"), docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs go; a document of which nothing is left goes with them."""
    return _with_text(line_dedup.dedup_lines(docs).filter("n_removed_lines = 0 OR n_removed_lines < n_lines"), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return near_join.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources reach their target weights."""
    return mixing.mix_sources(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [("quality_rules", clean_lines), ("line_dedup", drop_repeated_lines), ("near_join", drop_near_duplicates), ("mix_sources", mix), ("best_fit_packing", pack)]

#: Tokenization and packing can't be stated in SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
