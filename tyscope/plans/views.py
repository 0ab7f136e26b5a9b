"""SQL surface: the tables and the study's derived views as Spark temp views.

Users who query with SQL keep doing so (``spark.sql(...)``); the views are the
DataFrame operators, so Catalyst plans them the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tyscope.operators import reports


def register_views(spark: SparkSession, repository: DataFrame, module: DataFrame,
                   func_var: DataFrame, annotation: DataFrame) -> list[str]:
    """Register ``repository`` (with ``annotations_repo``), ``module``, ``func_var``,
    ``annotation``, ``partial_annotations``, ``partial_annotation_complete`` and
    ``full_annot``; returns the view names."""
    views = {
        "repository": reports.annotations_per_repo(repository, module),
        "module": module,
        "func_var": func_var,
        "annotation": annotation,
        "partial_annotations": reports.partial_annotations(func_var),
        "partial_annotation_complete": reports.partial_annotation_complete(func_var, annotation),
        "full_annot": reports.full_annot(func_var, annotation),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return list(views)
