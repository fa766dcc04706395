"""A training corpus from raw documents: five stages, each written as a table that the next one reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolex.llm import decontamination, language_id, line_dedup, minhash, mixing
from cargolex.llm.common import stored, table, without

#: Share of a text's words' probability that its language has to have.
MIN_LANGUAGE_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or of no language that the labelled ones have, go."""
    return language_id.accepted(docs, MIN_LANGUAGE_SCORE)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the boilerplate lines of their source; n_chars follows."""
    out = line_dedup.drop_boilerplate(docs)
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return without(docs, minhash.near_duplicates(docs).filter(~F.col("kept")))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return without(docs, decontamination.contamination(docs, table(spark, sf_dir, "benchmark")).filter("contaminated"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix reads, with the number of times (n_copies) and the key of their order (mix_order)."""
    return mixing.mix(docs).filter("n_copies > 0")


STAGES = [("language_id", language), ("line_dedup", lines), ("near_dedup", near_duplicates), ("decontamination", benchmark), ("source_mixing", mixture)]

#: The first stage learns its model, which SQL cannot; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
