"""The corpus pipeline: documents through the stages below, each written as Parquet
and read again as the next one's input.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tyscope.llm import decontaminate, mixing, simhash, substring, toxicity
from tyscope.session import read_table, scratch_path, scratch_scope


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier scores at the threshold or above go."""
    return toxicity.remove_toxic(docs, read_table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash near-duplicate group (4-word shingles, 4 bits)."""
    return simhash.keep_one(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 or more words that an earlier text has are cut out; rows stay."""
    return substring.remove_repeats(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a 10-word window of a benchmark item go."""
    return decontaminate.remove_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights; a row is emitted once per copy."""
    return mixing.emit(docs)


STAGES = [("drop_toxic", drop_toxic),
          ("drop_near_copies", drop_near_copies),
          ("drop_repeated_passages", drop_repeated_passages),
          ("drop_contaminated", drop_contaminated),
          ("mix_sources", mix_sources)]

#: SQL has no counterpart of the fitted and fuzzy stages; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        with scratch_scope(spark, name):  # what the stage itself wrote goes once its result is stored
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
