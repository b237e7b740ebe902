"""The corpus pipeline: documents in, packed training sequences out.

Each stage calls one operator of metawatch.llm on all that its predecessor kept.  All but the last
return the columns of documents; the last gives the pieces of the packed sequences.

Defined results: every stage takes nulls, empty texts, repeated rows and empty tables as its operator
states; a document whose text is cut away by the fourth stage goes on with an empty text and has no piece.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metawatch.llm import jaccard, langid, packing, quality, substrings
from metawatch.llm.shared import written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are near enough to a known language."""
    return langid.accepted(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose histograms are near enough to those of their language."""
    return quality.passing(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of lowest id of each group of near duplicates, and all documents in none."""
    return jaccard.one_of_each_group(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that a document of lower id has; n_chars follows the text."""
    cut = substrings.remove_repeats(docs)
    return cut.withColumn("n_chars", F.when(F.col("cut_words") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("jaccard_join", jaccard_join),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can express neither the centroids nor the packing search.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
