"""Corpus pipeline: each stage takes (spark, docs, sf_dir) and its rows, written as Parquet, are the next one's docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bucketwise.llm import decontaminate, exact_dedup, mixing, near_dedup, quality
from bucketwise.llm.textkit import table
from bucketwise.sources.scratch import materialize


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labelled ones, does not reject."""
    return quality.drop_poor(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every set of equal texts stays."""
    return exact_dedup.drop_exact(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates (five-word shingles, similarity 0.8) stays."""
    return near_dedup.drop_near(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, with the number of the copy."""
    return mixing.mix(docs)


STAGES = [
    ("quality", keep_good), ("exact_dedup", drop_exact), ("near_dedup", drop_near), ("decontaminate", drop_leaks),
    ("mix_sources", mix_sources),
]
#: the trained classifier, the sketches and the draws cannot be stated in SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
