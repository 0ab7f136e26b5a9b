"""Argument names of partially annotated functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tyscope.functions.columns import percent_share


def unannotated_name_counts(extracted: DataFrame, as_coded: bool = False) -> DataFrame:
    """Occurrences per argument name over partially annotated functions.

    ``as_coded=False`` counts only arguments without an annotation (what the
    study documents); ``as_coded=True`` counts every argument name of such a
    function (what its code appends).
    """
    col = "arg_names_of_partial" if as_coded else "unannotated_names"
    return (extracted.where((F.col("kind") == "func_var") & F.col(col).isNotNull())
            .select(F.explode(col).alias("arg_name"))
            .groupBy("arg_name").agg(F.count(F.lit(1)).alias("n")))


def unannotated_name_share(counts: DataFrame) -> DataFrame:
    """Each name's share of all counted names, ``round(n / total * 100, 2)``.

    The grand total is a scalar subquery: computed once, no single-partition
    window and no join.
    """
    total = counts.select(F.sum("n")).scalar()
    return counts.select("arg_name", "n", total.alias("total"),
                         percent_share(F.col("n"), total).alias("share"))


def sort_counts(counts: DataFrame) -> DataFrame:
    """Count descending; ties by name (first-seen order is not defined in parallel)."""
    return counts.orderBy(F.desc("n"), F.asc("arg_name"))
