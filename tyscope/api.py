"""The study's workflow in four calls.

    repo = rank_repositories(snapshots)                  # L1: snapshots -> repository table
    stream, t = extract_tree(spark, root, repo)          # L2: source tree -> fact tables
    r = report_queries(repo, t)                          # L3: every report as a DataFrame
    found = triage_functions(stream, t, diagnostics)     # L3: fully annotated -> probe status
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tyscope.operators import facts, names, ranking, reports, triage
from tyscope.session import materialize
from tyscope.sources import files


def rank_repositories(snapshots: DataFrame, top: int = ranking.TOP_PER_YEAR) -> DataFrame:
    """Snapshot records (year, iteration, pos, name, url, stars, created_at) -> repository rows."""
    return ranking.repository_rows(materialize(ranking.merge_snapshots(snapshots, top), "merged"))


def extract_tree(spark: SparkSession, root: str, repository: DataFrame | None = None,
                 name: str = "extracted", unknown: str = "fail") -> tuple[DataFrame, facts.Facts]:
    """Source tree -> (stored extraction stream, module / func_var / annotation / rejects).

    A folder without a repository row fails the job, unless ``unknown="drop"``; ``unknown_folders``
    lists such folders."""
    return facts.extract_tables(files.source_files(spark, root, repository, unknown), name)


def unknown_folders(spark: SparkSession, root: str, repository: DataFrame) -> DataFrame:
    """(year, user_name, repo) of the tree's folders that have no repository row."""
    return files.missing_repos(files.listing(spark, root), repository)


def report_queries(repository: DataFrame, t: facts.Facts, year_lo: int = 0,
                   repo_id: int = 0) -> dict[str, DataFrame]:
    """Every report of the study over the tables, by name (lazy DataFrames)."""
    fv, an, mod = t.func_var, t.annotation, t.module
    counted = reports.annotations_per_repo(repository, mod)
    return {
        "repositories": counted,
        "hist_repo_annotations": reports.hist_repo_annotations(counted),
        "hist_module_annotations": reports.hist_module_annotations(mod),
        "count_annotated_modules": reports.count_annotated_modules(mod),
        "hist_module_annotations_nonzero": reports.hist_module_annotations_nonzero(mod),
        "func_var_ordered": reports.func_var_ordered(fv, repo_id),
        "partial_annotations": reports.partial_annotations(fv),
        "potential_annotations": reports.potential_annotations(fv, year_lo),
        "count_func_var": reports.count_func_var(fv),
        "partial_annotation_complete": reports.partial_annotation_complete(fv, an),
        "hist_base_type_partial": reports.hist_base_type_partial(fv, an),
        "full_annot": reports.full_annot(fv, an),
        "hist_fvt_full": reports.hist_fvt_full(fv, an),
        "hist_base_type": reports.hist_base_type(an),
        "hist_base_type_functions": reports.hist_base_type_functions(an),
        "hist_func_var_type": reports.hist_func_var_type(an),
    }


def unannotated_names(stream: DataFrame, as_coded: bool = False) -> DataFrame:
    """Argument names of partially annotated functions with counts and shares, most frequent first."""
    return names.sort_counts(names.unannotated_name_share(names.unannotated_name_counts(stream, as_coded)))


def triage_functions(stream: DataFrame, t: facts.Facts, diagnostics: DataFrame,
                     deny: list[int] | DataFrame = triage.DENYLIST) -> DataFrame:
    """Fully annotated functions of clean repositories with their probe call and static status."""
    full = triage.exclude_repos(reports.full_annot(t.func_var, t.annotation), deny)
    full = triage.clean_repo_functions(full, triage.repo_verdict(t.module, diagnostics))
    defs = triage.function_definitions(stream, wanted=full)
    return triage.probe_status(triage.probe_arguments(triage.attach_function_definition(full, defs)))
