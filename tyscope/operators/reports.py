"""Report queries over repository / module / func_var / annotation.

The study's SQL joins in "comma style" (``JOIN`` without ``ON``, keys in
``WHERE``); here every join is an explicit inner equi-join on the func_var key,
which Catalyst plans as one shuffle per side (none when both tables are
bucketed the same way, see ``facts.save_fact_tables``). Aggregates get partial
(map-side) aggregation, so a repository holding a third of all rows still
sends one row per map task into the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FV_JOIN = ["repo_id", "path_rel", "name", "lineno"]


def _fv_annotation_join(func_var: DataFrame, annotation: DataFrame, fv_filter) -> DataFrame:
    fv = func_var.where(fv_filter)
    an = annotation.withColumnRenamed("func_var_name", "name")
    return fv.join(an, FV_JOIN, "inner")


def _counted(func_var: DataFrame, annotation: DataFrame, fv_filter, *by: str) -> DataFrame:
    """The join with the annotation rows counted per key (and ``by``) first: ``n`` rows of
    the fan-out stand in one row, and the count is taken before anything is shuffled."""
    an = (annotation.withColumnRenamed("func_var_name", "name").groupBy(*FV_JOIN, *by)
          .agg(F.count(F.lit(1)).alias("n")))
    return func_var.where(fv_filter).join(an, FV_JOIN, "inner")


# ---------------------------------------------------------------- C6, H1, D8b
def partial_annotations(func_var: DataFrame) -> DataFrame:
    """Functions with more than one slot and at least one annotated slot."""
    return func_var.where((F.col("num_var") > 1) & (F.col("num_var_annotated") > 0))


def partial_annotation_complete(func_var: DataFrame, annotation: DataFrame) -> DataFrame:
    """H1: C6 joined to its annotation rows (10 columns)."""
    j = _fv_annotation_join(func_var, annotation,
                            (F.col("num_var") > 1) & (F.col("num_var_annotated") > 0))
    return j.select("repo_id", "path_rel", "name", "lineno", "num_var", "num_var_annotated",
                    "func_var_type", "base_type", "entire_annotation", "type_count")


def hist_base_type_partial(func_var: DataFrame, annotation: DataFrame) -> DataFrame:
    """Annotation count per base type over H1."""
    j = _counted(func_var, annotation, (F.col("num_var") > 1) & (F.col("num_var_annotated") > 0), "base_type")
    return j.groupBy("base_type").agg(F.sum("n").alias("total"))


# ---------------------------------------------------------------- H2 / D9, H3 / D10
def full_annot(func_var: DataFrame, annotation: DataFrame) -> DataFrame:
    """H2 + D9: fully annotated functions (> 1 slot), sums taken after the join.

    As defined, a function with n annotation rows contributes n times its
    counts, and the group key has no line number (same-named functions of a
    file merge).
    """
    j = _counted(func_var, annotation,
                 (F.col("num_var_annotated") > 1) & (F.col("num_var") == F.col("num_var_annotated")))
    return (j.groupBy("repo_id", "path_rel", "name")
            .agg(F.sum(F.col("num_var") * F.col("n")).cast("bigint").alias("sum_num_var"),
                 F.sum(F.col("num_var_annotated") * F.col("n")).cast("bigint").alias("sum_num_var_annotated")))


def full_annot_exact(func_var: DataFrame, annotation: DataFrame) -> DataFrame:
    """One row per fully annotated function (no fan-out, line number kept)."""
    fv = func_var.where((F.col("num_var_annotated") > 1)
                        & (F.col("num_var") == F.col("num_var_annotated")))
    an = annotation.select("repo_id", "path_rel", F.col("func_var_name").alias("name"), "lineno")
    return fv.join(an, FV_JOIN, "left_semi")


def hist_fvt_full(func_var: DataFrame, annotation: DataFrame) -> DataFrame:
    """H3 + D10: annotation rows of fully annotated functions per func_var_type."""
    j = _counted(func_var, annotation,
                 (F.col("num_var") > 1) & (F.col("num_var_annotated") > 0)
                 & (F.col("num_var") == F.col("num_var_annotated")), "func_var_type")
    return j.groupBy("func_var_type").agg(F.sum("n").alias("total"))


# ---------------------------------------------------------------- repository level
def annotations_per_repo(repository: DataFrame, module: DataFrame) -> DataFrame:
    """Repository rows plus ``annotations_repo`` (sum over modules, 0 when none)."""
    per_repo = (module.groupBy("repo_id")
                .agg(F.sum("num_annotations").cast("bigint").alias("annotations_repo"))
                .withColumnRenamed("repo_id", "id"))
    return (repository.join(per_repo, "id", "left")
            .withColumn("annotations_repo", F.coalesce("annotations_repo", F.lit(0).cast("bigint"))))


def hist_repo_annotations(repository_counted: DataFrame) -> DataFrame:
    """Repositories per annotation total (> 0), total descending."""
    return (repository_counted.where(F.col("annotations_repo") > 0)
            .groupBy("annotations_repo").agg(F.count("id").alias("n_repos"))
            .orderBy(F.desc("annotations_repo")))


def select_all_repositories(repository_counted: DataFrame, annotations_repo: int | None = None) -> DataFrame:
    """All repository rows (optionally the commented-out total filter)."""
    if annotations_repo is None:
        return repository_counted
    return repository_counted.where(F.col("annotations_repo") == annotations_repo)


def lookup_repo_annotations(repository_counted: DataFrame, ids: DataFrame) -> DataFrame:
    """C9 (join form): ``annotations_repo`` for each requested id, 0 when the id is absent."""
    r = repository_counted.select("id", "annotations_repo")
    return (ids.select(F.col("id").cast("int").alias("id")).join(r, "id", "left")
            .select("id", F.coalesce("annotations_repo", F.lit(0).cast("bigint")).alias("annotations_repo")))


# ---------------------------------------------------------------- module level
def hist_module_annotations(module: DataFrame) -> DataFrame:
    """Modules per annotation count, all modules."""
    return module.groupBy("num_annotations").agg(F.count(F.lit(1)).alias("n_modules"))


def hist_module_annotations_nonzero(module: DataFrame) -> DataFrame:
    """Non-null paths per annotation count (> 0), count descending."""
    return (module.where(F.col("num_annotations") > 0)
            .groupBy("num_annotations").agg(F.count("path_rel").alias("n_modules"))
            .orderBy(F.desc("num_annotations")))


def count_annotated_modules(module: DataFrame) -> DataFrame:
    """D7."""
    return module.where(F.col("num_annotations") > 0).agg(F.count(F.lit(1)).alias("n_modules"))


def lookup_module(module: DataFrame, repo_id: int, path_rel: str, name: str) -> DataFrame:
    """Equality lookup (pushed into the parquet scan)."""
    return module.where((F.col("repo_id") == repo_id) & (F.col("path_rel") == path_rel)
                        & (F.col("name") == name))


# ---------------------------------------------------------------- func_var level
def count_func_var(func_var: DataFrame) -> DataFrame:
    """D7b."""
    return func_var.agg(F.count(F.lit(1)).alias("n_func_var"))


def potential_annotations(func_var: DataFrame, lo: int, width: int = 1000) -> DataFrame:
    """Slot and annotated-slot sums for repository ids in ``[lo, lo + width)`` (one year)."""
    return (func_var.where((F.col("repo_id") >= lo) & (F.col("repo_id") < lo + width))
            .agg(F.sum("num_var").cast("bigint").alias("sum_num_var"),
                 F.sum("num_var_annotated").cast("bigint").alias("sum_num_var_annotated")))


def func_var_ordered(func_var: DataFrame, repo_id: int) -> DataFrame:
    """S3: one repository's rows ordered by (repo_id, path_rel, lineno, name)."""
    return (func_var.where(F.col("repo_id") == repo_id)
            .orderBy("repo_id", "path_rel", "lineno", "name"))


# ---------------------------------------------------------------- annotation level
def hist_base_type(annotation: DataFrame) -> DataFrame:
    """Annotations per base type."""
    return annotation.groupBy("base_type").agg(F.count(F.lit(1)).alias("total"))


def hist_base_type_functions(annotation: DataFrame) -> DataFrame:
    """Same, arguments and returns only."""
    return (annotation.where(F.col("func_var_type").isin("argument", "return"))
            .groupBy("base_type").agg(F.count(F.lit(1)).alias("total")))


def hist_func_var_type(annotation: DataFrame) -> DataFrame:
    """Annotations per func_var_type."""
    return annotation.groupBy("func_var_type").agg(F.count(F.lit(1)).alias("total"))
