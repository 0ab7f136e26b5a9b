"""The fully-annotated table kept up to date from appends.

``full_annot`` sums over pairs of a function and an annotation row, so it is linear in both
tables: what an append adds is new functions x new annotations, new functions x stored
annotations and stored functions x new annotations. The stored side of the last two is read
from the files whose key range can match (``keyed_table.matching_rows``), and the sums that
come out are appended to the stored result, where sums of a key add up on reading.

The result remembers which loads of the two tables it holds (``_applied/v=<n>``, valid with the
version of the same number), so that a run which ended between loading and summing is made
up for by the next, and nothing counts twice. After a compaction of a table its loads are
others, and the result is built anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tyscope.operators import reports
from tyscope.schemas import ANNOTATION, ANNOTATION_KEY, FUNC_VAR, FUNC_VAR_KEY
from tyscope.sources import keyed_table as KT
from tyscope.sources.interchange import stage_rows

FULL_KEY = ["repo_id", "path_rel", "name"]
SUMS = ["sum_num_var", "sum_num_var_annotated"]
FULL_SCHEMA = "repo_id int, path_rel string, name string, sum_num_var bigint, sum_num_var_annotated bigint"


def _applied(spark: SparkSession, path: str) -> tuple[set[int], set[int]]:
    v = KT._version(spark, path)
    if not v:
        return set(), set()
    r = spark.read.parquet(f"{path}/_applied/v={v}").first()
    return set(r.func_var), set(r.annotation)


def _summed(parts: list[DataFrame]) -> DataFrame:
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy(*FULL_KEY).agg(*[F.sum(c).cast("bigint").alias(c) for c in SUMS])


def read_full_annot(spark: SparkSession, root: str) -> DataFrame:
    """The stored fully-annotated table below ``root``."""
    schema = spark.createDataFrame([], FULL_SCHEMA).schema
    return _summed([KT.read_fact_table(spark, f"{root}/full_annot", schema)])


def update_full_annot(spark: SparkSession, root: str) -> DataFrame:
    """Bring the stored table up to the loads of ``func_var`` and ``annotation`` below ``root``."""
    fv_path, an_path, path = (f"{root}/{t}" for t in ("func_var", "annotation", "full_annot"))
    now = [set(KT.generations(spark, p)) for p in (fv_path, an_path)]
    old = _applied(spark, path)
    anew = not (old[0] <= now[0] and old[1] <= now[1])
    if anew:
        old = set(), set()
    if now == list(old):
        return read_full_annot(spark, root)
    fv_new = KT.read_fact_table(spark, fv_path, FUNC_VAR, sorted(now[0] - old[0]))
    an_new = KT.read_fact_table(spark, an_path, ANNOTATION, sorted(now[1] - old[1]))
    full = fv_new.where((F.col("num_var_annotated") > 1) & (F.col("num_var") == F.col("num_var_annotated")))
    an_old = KT.matching_rows(spark, an_path, ANNOTATION, sorted(old[1]), full.select(*FUNC_VAR_KEY), FUNC_VAR_KEY, len(ANNOTATION_KEY))
    fv_old = KT.matching_rows(spark, fv_path, FUNC_VAR, sorted(old[0]),
                              an_new.select("repo_id", "path_rel", F.col("func_var_name").alias("name"), "lineno"),
                              FUNC_VAR_KEY, len(FUNC_VAR_KEY))
    delta = _summed([reports.full_annot(fv_new, an_new), reports.full_annot(fv_new, an_old), reports.full_annot(fv_old, an_new)])
    version = KT._version(spark, path) + 1
    spark.createDataFrame([(sorted(now[0]), sorted(now[1]))], "func_var array<int>, annotation array<int>").coalesce(1).write.mode(
        "overwrite").parquet(f"{path}/_applied/v={version}")
    KT.append_rows(spark, delta, path, FULL_KEY, replace=anew)
    return read_full_annot(spark, root)


def append_facts(spark: SparkSession, func_var: DataFrame, annotation: DataFrame, root: str) -> DataFrame:
    """Load a batch of the two tables (keys once per batch) and bring the fully-annotated table up to date."""
    KT.load_fact_table(spark, stage_rows(func_var, FUNC_VAR), f"{root}/func_var", FUNC_VAR_KEY, [])
    KT.load_fact_table(spark, stage_rows(annotation, ANNOTATION), f"{root}/annotation", ANNOTATION_KEY, [])
    return update_full_annot(spark, root)
