"""Split the tagged extraction stream into the four fact tables.

Dedupe on load (first row per key wins, in the order of path and emission) is done
without a shuffle for almost every row: a key repeats inside one file, which the
extractor flags (``dup``), or across files that share their repository id and stored
path. Such files (long paths that truncation merges, or one path delivered twice) are
found from one row per file; only their rows go through a keyed window.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tyscope.functions.columns import base_type, truncate
from tyscope.schemas import (
    ANNOTATION_KEY,
    FUNC_VAR_KEY,
    MAX_ANNOTATION,
    MAX_BASE_TYPE,
    MAX_FVT,
    MAX_NAME,
    MAX_PATH,
    MODULE_KEY,
)


class Facts(NamedTuple):
    module: DataFrame
    func_var: DataFrame
    annotation: DataFrame
    rejects: DataFrame


FILE_KEY = ["repo_id", "path_rel"]


def colliding_files(extracted: DataFrame) -> DataFrame:
    """(repo_id, stored path) shared by more than one accepted file."""
    return (extracted.where(F.col("kind") == "module")
            .groupBy("repo_id", truncate("path_rel", MAX_PATH).alias("path_rel"))
            .agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select(*FILE_KEY))


def _keep_first(rows: DataFrame, key: list[str], colliding: DataFrame) -> DataFrame:
    """First row per key, ordered by full path, then emission order, then content."""
    rows = rows.where(~F.col("dup"))
    alone = rows.join(colliding, FILE_KEY, "left_anti")
    rest = [c for c in rows.columns if c not in (*key, "path_full", "seq", "dup")]
    w = Window.partitionBy(*key).orderBy("path_full", "seq", *rest)
    first = (rows.join(colliding, FILE_KEY, "left_semi").withColumn("_rn", F.row_number().over(w))
             .where(F.col("_rn") == 1).drop("_rn"))
    return alone.unionByName(first)


def _table(rows: DataFrame, key: list[str], colliding: DataFrame | None) -> DataFrame:
    if colliding is not None:
        rows = _keep_first(rows, key, colliding)
    return rows.drop("path_full", "seq", "dup")


def module_rows(extracted: DataFrame, colliding: DataFrame | None) -> DataFrame:
    """``colliding`` None: the rows before dedupe (the other tables likewise)."""
    m = (extracted.where(F.col("kind") == "module")
         .select(F.col("repo_id"),
                 truncate("path_rel", MAX_PATH).alias("path_rel"),
                 F.col("name"),
                 F.col("num_annotations"),
                 F.col("path_rel").alias("path_full"), "seq", "dup"))
    return _table(m, MODULE_KEY, colliding)


def func_var_rows(extracted: DataFrame, colliding: DataFrame | None) -> DataFrame:
    fv = (extracted.where(F.col("kind") == "func_var")
          .select(F.col("repo_id"),
                  truncate("path_rel", MAX_PATH).alias("path_rel"),
                  truncate("name", MAX_NAME).alias("name"),
                  "lineno", "num_var", "num_var_annotated",
                  F.col("path_rel").alias("path_full"), "seq", "dup"))
    return _table(fv, FUNC_VAR_KEY, colliding)


def annotation_rows(extracted: DataFrame, colliding: DataFrame | None) -> DataFrame:
    an = (extracted.where(F.col("kind") == "annotation")
          .select(F.col("repo_id"),
                  truncate("path_rel", MAX_PATH).alias("path_rel"),
                  truncate("name", MAX_NAME).alias("func_var_name"),
                  "lineno",
                  truncate("annot_name", MAX_NAME).alias("annot_name"),
                  truncate("func_var_type", MAX_FVT).alias("func_var_type"),
                  truncate(base_type("entire_annotation"), MAX_BASE_TYPE).alias("base_type"),
                  truncate("entire_annotation", MAX_ANNOTATION).alias("entire_annotation"),
                  "type_count",
                  F.col("path_rel").alias("path_full"), "seq", "dup"))
    return _table(an, ANNOTATION_KEY, colliding)


def reject_rows(extracted: DataFrame) -> DataFrame:
    return extracted.where(F.col("kind") == "reject").select("repo_id", "path_rel", "status")


def stored_colliding_files(extracted: DataFrame) -> DataFrame:
    """The list of colliding files (one row each, normally none), stored, so that the planner
    knows its size and nobody finds them again."""
    from tyscope.session import materialize
    return materialize(colliding_files(extracted), "colliding-files")


def fact_tables(extracted: DataFrame, colliding: DataFrame | None = None) -> Facts:
    """The four tables of a (stored) extraction stream; ``colliding``: ``stored_colliding_files``
    of it, where the caller has them."""
    if colliding is None:
        colliding = stored_colliding_files(extracted)
    return Facts(module_rows(extracted, colliding), func_var_rows(extracted, colliding),
                 annotation_rows(extracted, colliding), reject_rows(extracted))


def stored_tables(t: Facts) -> Facts:
    """The fact tables written once, deduplicated, so that every report only reads its columns."""
    return Facts(*[stored_table(t, name) for name in Facts._fields])


def stored_table(t: Facts, name: str) -> DataFrame:
    """One of the fact tables written once, for those who read no other."""
    from tyscope.session import materialize
    return materialize(getattr(t, name), f"fact-{name}")


def extracted_stream(files: DataFrame, name: str = "extracted") -> DataFrame:
    """Run the extraction job once and write its tagged stream to the shared folder.

    The stream is not partitioned by ``kind``: a partitioned write sorts every
    task's rows by kind, which cost more than it saved here (readers prune
    columns, and the columns of other kinds are mostly null)."""
    from tyscope.operators.extract import extract
    from tyscope.session import materialize
    return materialize(extract(files), name)


def extract_tables(files: DataFrame, name: str = "extracted") -> tuple[DataFrame, Facts]:
    """The stored stream (``extracted_stream``) plus the fact tables read from it."""
    stream = extracted_stream(files, name)
    return stream, fact_tables(stream)


def annotations_per_module(module: DataFrame, annotation: DataFrame) -> DataFrame:
    """Annotation rows per module, 0 when none, next to the stored count."""
    counted = annotation.groupBy("repo_id", "path_rel").agg(F.count(F.lit(1)).alias("n_rows"))
    return (module.join(counted, ["repo_id", "path_rel"], "left")
            .select("repo_id", "path_rel", "name", "num_annotations",
                    F.coalesce("n_rows", F.lit(0)).cast("bigint").alias("n_annotation_rows")))


def reconcile_module(extracted: DataFrame) -> DataFrame:
    """Files whose three annotation totals disagree (expected: none).

    Computed on the stream before dedupe, per file. All three counts come from
    the same file, so the grouping key is (repo_id, path_rel) of the full path.
    """
    per_file = (extracted.where(F.col("kind").isin("module", "func_var", "annotation"))
                .groupBy("repo_id", "path_rel")
                .agg(F.sum(F.when(F.col("kind") == "module", F.col("num_annotations"))).cast("bigint")
                     .alias("total_annotations"),
                     F.count(F.when(F.col("kind") == "annotation", F.lit(1))).alias("annotation_rows"),
                     F.sum(F.when(F.col("kind") == "func_var", F.col("num_var_annotated")))
                     .cast("bigint").alias("func_var_annotated")))
    per_file = per_file.withColumn("func_var_annotated", F.coalesce("func_var_annotated", F.lit(0)))
    return per_file.where((F.col("total_annotations") != F.col("annotation_rows"))
                          | (F.col("func_var_annotated") != F.col("annotation_rows")))


def save_fact_tables(tables: Facts, prefix: str, location: str, buckets: int) -> Facts:
    """Store the fact tables for the report workload: func_var and annotation bucketed
    on the func_var key (their joins then need no shuffle), module and
    rejects as plain parquet. ``location`` is a folder in the shared storage."""
    from tyscope.sources.interchange import save_bucketed

    spark = tables.module.sparkSession
    key = ["repo_id", "path_rel", "name", "lineno"]
    fv = save_bucketed(tables.func_var, f"{prefix}_func_var", f"{location}/func_var", key, buckets)
    an = save_bucketed(tables.annotation.withColumnRenamed("func_var_name", "name"), f"{prefix}_annotation",
                       f"{location}/annotation", key, buckets).withColumnRenamed("name", "func_var_name")
    tables.module.write.mode("overwrite").parquet(f"{location}/module")
    tables.rejects.write.mode("overwrite").parquet(f"{location}/rejects")
    return Facts(spark.read.parquet(f"{location}/module"), fv, an, spark.read.parquet(f"{location}/rejects"))
