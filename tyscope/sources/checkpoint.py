"""Verdicts as a checkpoint (A15, C13): an append-only log of versions per repository.

Every checkpoint is a folder ``version=<n>/`` of ``{"<repo_id>": clean}`` lines, the study's
format; a folder counts once its ``_SUCCESS`` is there. The last version of a repository wins,
and repositories with a version are done, so a run that ends anywhere is resumed by
running it again. Compaction writes the last versions as one folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tyscope.operators.windows import numbered_by
from tyscope.session import delete_path, folder_names, materialize, path_exists


def versions(spark: SparkSession, path: str) -> list[int]:
    """The finished checkpoints, in order."""
    found = [int(n.partition("=")[2]) for n in folder_names(spark, path) if n.startswith("version=")]
    return sorted(v for v in found if path_exists(spark, f"{path}/version={v}/_SUCCESS"))


def append_verdicts(spark: SparkSession, verdicts: DataFrame, path: str) -> int:
    """Add (repo_id, clean) rows as the next version; its number."""
    version = max(versions(spark, path), default=0) + 1
    doc = F.to_json(F.create_map(F.col("repo_id").cast("string"), F.col("clean")))
    verdicts.select(doc.alias("value")).write.mode("overwrite").text(f"{path}/version={version}")
    return version


def verdict_versions(spark: SparkSession, path: str) -> DataFrame:
    """(repo_id, clean, version) of all finished checkpoints."""
    live = versions(spark, path)
    if not live:
        return spark.createDataFrame([], "repo_id int, clean boolean, version int")
    lines = spark.read.option("basePath", path).schema("value string, version int").text([f"{path}/version={v}" for v in live])
    kv = lines.select(F.explode(F.from_json("value", "map<string,boolean>")).alias("k", "clean"), "version")
    return kv.select(F.col("k").cast("int").alias("repo_id"), "clean", "version")


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """(repo_id, clean) by the last version of each repository."""
    return verdict_versions(spark, path).groupBy("repo_id").agg(F.max_by("clean", "version").alias("clean"))


def compact_verdicts(spark: SparkSession, path: str) -> None:
    """Write the last versions as one checkpoint and delete the earlier ones; to be run while nobody
    reads the log. Ended in between, it leaves a log with the same last versions."""
    old = versions(spark, path)
    append_verdicts(spark, read_verdicts(spark, path), path)
    for v in old:
        delete_path(spark, f"{path}/version={v}")


def run_verdicts(spark: SparkSession, repos: DataFrame, judge: Callable[[DataFrame], DataFrame], path: str,
                 repos_per_checkpoint: int = 1000, max_checkpoints: int | None = None) -> int:
    """Judge the repositories (``repo_id``) that have no verdict yet, in order of id, and write a
    checkpoint after each ``repos_per_checkpoint``. ``judge`` takes some of them and returns
    (repo_id, clean, ...) rows. Ends after ``max_checkpoints``; returns how many it wrote."""
    done = verdict_versions(spark, path).select("repo_id")
    todo = numbered_by(repos.select("repo_id").distinct().join(done, "repo_id", "left_anti"), [], ["repo_id"], "n")
    todo = materialize(todo.withColumn("part", F.floor(F.col("n") / repos_per_checkpoint)), "verdicts-to-do")
    last = todo.agg(F.max("part")).first()[0]
    parts = range(0 if last is None else last + 1)[:max_checkpoints]
    for part in parts:
        append_verdicts(spark, judge(todo.where(F.col("part") == part).select("repo_id")).select("repo_id", "clean"), path)
    return len(parts)
