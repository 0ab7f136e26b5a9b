"""Triage of fully annotated functions (L3, second half).

Re-aimed from "run the type checker / execute the function" to tables:
checker diagnostics come in as rows (``repo_id, path, line, code``), recorded
call outcomes come in as rows (``exception type, message, return check``), and
the static part of the probe (which arguments can be built from their
annotations) is native column code over what the extraction job emitted.
No function body is compiled or executed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tyscope.functions.columns import repo_root
from tyscope.operators.facts import FILE_KEY, colliding_files
from tyscope.schemas import MAX_NAME, MAX_PATH

# The value each probe type name is instantiated with (as repr).
PROBE_VALUES = {
    "int": "10",
    "float": "2.0",
    "complex": "1j",
    "str": "'something'",
    "bool": "True",
    "None": "None",
}

# Repositories left out of the triage.
DENYLIST = [191, 2158, 2023, 5075, 5312]

# Exception classes reported as "BadError!".
BAD_ERRORS = [
    "NameError", "NotImplementedError", "ImportError", "AttributeError", "ValueError",
    "RuntimeError", "UnboundLocalError", "SyntaxError", "FileNotFoundError", "IndexError",
    "KeyError", "ZeroDivisionError", "AssertionError",
]
# Built-in subclasses of the classes above (an ``except`` clause catches them too).
BAD_ERROR_SUBCLASSES = [
    "ModuleNotFoundError", "RecursionError", "UnicodeError", "UnicodeDecodeError",
    "UnicodeEncodeError", "UnicodeTranslateError", "IndentationError", "TabError",
    "PythonFinalizationError",
]

STATUS_NOT_CREATABLE = "Arguments could not be created"
STATUS_MISSING = "Missing"
STATUS_RETURN_ERROR = "ERROR!"
STATUS_CHECKABLE = "checkable"


# ---------------------------------------------------------------- definitions
def function_definitions(extracted: DataFrame, wanted: DataFrame | None = None,
                         colliding: DataFrame | None = None) -> DataFrame:
    """The first ``def`` of each name in each file (pre-order), with its probe inputs.

    The extractor flags it, so this is a filter; only files that share a stored path
    (normally none) need a step keyed by name. ``wanted`` (``repo_id, path_rel, name``)
    keeps those functions only. ``colliding``: the stored list of such files (``facts.stored_colliding_files``);
    without it they are found again when the result is computed.
    """
    defs = (extracted.where((F.col("kind") == "func_var") & F.col("first_def"))
            .select("repo_id",
                    F.substring("path_rel", 1, MAX_PATH).alias("path_rel"),
                    F.substring("name", 1, MAX_NAME).alias("name"),
                    F.col("path_rel").alias("path_full"),
                    "seq", "lineno", "probe_args", "probe_return", "n_required_other"))
    if wanted is not None:
        defs = defs.join(wanted.select("repo_id", "path_rel", "name").distinct(), ["repo_id", "path_rel", "name"], "left_semi")
    if colliding is None:
        colliding = colliding_files(extracted)
    kept = ["repo_id", "path_rel", "name", "lineno", "probe_args", "probe_return", "n_required_other"]
    alone = defs.join(colliding, FILE_KEY, "left_anti").select(*kept)
    w = Window.partitionBy("repo_id", "path_rel", "name").orderBy("path_full", "seq", "lineno")
    first = (defs.join(colliding, FILE_KEY, "left_semi").withColumn("_rn", F.row_number().over(w))
             .where(F.col("_rn") == 1).select(*kept))
    return alone.unionByName(first)


def attach_function_definition(functions: DataFrame, definitions: DataFrame) -> DataFrame:
    """H9: keep functions whose file has a ``def`` of that name, with the first one."""
    return functions.join(definitions, ["repo_id", "path_rel", "name"], "inner")


# ---------------------------------------------------------------- probes
def _probe_value(p: Column) -> Column:
    mapping = F.create_map(*[x for kv in PROBE_VALUES.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return (F.when(p.isNull(), F.lit(None).cast("string"))
            .when(p["tag"] == "str", F.try_element_at(mapping, p["value"]))
            .when(p["tag"] == "none", F.lit("None"))
            .when(p["tag"] == "error", F.lit(None).cast("string"))
            .otherwise(p["value"]))


def probe_arguments(defs: DataFrame) -> DataFrame:
    """U16: ``probe_call`` = ``a=10;b='something'`` for annotated arguments, NULL when some
    annotated argument cannot be built (its annotation is not a basic type or literal)."""
    annotated = F.filter("probe_args", lambda a: a["annotated"])
    values = F.transform(annotated, lambda a: F.struct(a["arg"].alias("arg"),
                                                       _probe_value(a["probe"]).alias("v")))
    creatable = F.forall(values, lambda x: x["v"].isNotNull())
    call = F.array_join(F.transform(values, lambda x: F.concat(x["arg"], F.lit("="), x["v"])), ";")
    return defs.withColumn("probe_call", F.when(creatable, call))


def probe_status(defs_with_call: DataFrame) -> DataFrame:
    """The static outcome of the probe."""
    missing = (F.exists("probe_args", lambda a: ~a["annotated"] & ~a["has_default"])
               | (F.col("n_required_other") > 0))
    status = (F.when(F.col("probe_call").isNull(), F.lit(STATUS_NOT_CREATABLE))
              .when(missing, F.lit(STATUS_MISSING))
              .when(F.col("probe_return.tag") == "error", F.lit(STATUS_RETURN_ERROR))
              .otherwise(F.lit(STATUS_CHECKABLE)))
    return defs_with_call.withColumn("status", status)


# ---------------------------------------------------------------- verdicts
def repo_verdict(repos: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """A repository is clean when the checker reported nothing for it."""
    per_repo = diagnostics.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_diagnostics"))
    return (repos.select("repo_id").distinct().join(per_repo, "repo_id", "left")
            .select("repo_id", F.coalesce("n_diagnostics", F.lit(0)).cast("bigint").alias("n_diagnostics"))
            .withColumn("clean", F.col("n_diagnostics") == 0))


def clean_repo_functions(functions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """H8: functions of repositories with a clean verdict (no verdict = not clean).

    One verdict per repository. The planner broadcasts that side by its size; beyond the
    threshold it is a shuffle join, whose skewed partitions AQE splits."""
    clean = verdicts.where(F.col("clean")).select("repo_id")
    return functions.join(clean, "repo_id", "left_semi")


def exclude_repos(functions: DataFrame, deny: list[int] | DataFrame = DENYLIST) -> DataFrame:
    """C11: drop denied repositories (a list, or a table of ``repo_id``)."""
    if isinstance(deny, DataFrame):
        return functions.join(deny.select("repo_id"), "repo_id", "left_anti")
    return functions.where(~F.col("repo_id").isin(list(deny)))


def focus_functions(functions: DataFrame, keys: DataFrame) -> DataFrame:
    """Only the (repo_id, name) pairs in ``keys``."""
    return functions.join(keys.select("repo_id", "name"), ["repo_id", "name"], "left_semi")


def resume_after(functions: DataFrame, last_done: int | None = None,
                 done: DataFrame | None = None) -> DataFrame:
    """Skip repositories already handled: by id (``repo_id > last_done``) or by a
    table of handled ``repo_id`` (anti join)."""
    out = functions
    if last_done is not None:
        out = out.where(F.col("repo_id") > last_done)
    if done is not None:
        out = out.join(done.select("repo_id"), "repo_id", "left_anti")
    return out


def distinct_repos(functions: DataFrame, path_col: str, depth: int) -> DataFrame:
    """One row per repository with its folder (first path by order)."""
    return (functions.groupBy("repo_id")
            .agg(F.min_by(repo_root(path_col, depth), F.col(path_col)).alias("repo_path")))


def distinct_repo_paths(findings: DataFrame, path_col: str, depth: int) -> DataFrame:
    """The set of repository folders of the findings."""
    return findings.select(repo_root(path_col, depth).alias("repo_path")).distinct()


# ---------------------------------------------------------------- outcomes
def classify_outcome(outcomes: DataFrame) -> DataFrame:
    """Label recorded probe outcomes.

    ``outcomes``: ``exc_type`` (NULL when the call returned), ``message``,
    ``return_error`` (the return annotation has no probe type), ``matched`` (NULL when the
    result was not compared: its own label, which no filter keeps).
    """
    exc = F.col("exc_type")
    label = (F.when((exc == "TypeError") & F.col("message").contains("missing"), F.lit("Missing"))
             .when(exc == "TypeError", F.lit("MeinTypeError!"))
             .when(exc.isin(BAD_ERRORS + BAD_ERROR_SUBCLASSES), F.lit("BadError!"))
             .when(exc.isNotNull(), F.lit("Unhandled"))
             .when(F.col("return_error"), F.lit("ERROR!"))
             .when(F.col("matched").isNull(), F.lit("Unchecked"))
             .when(F.col("matched"), F.lit("True"))
             .otherwise(F.lit("False")))
    return outcomes.withColumn("label", label)


def filter_outcomes(labelled: DataFrame) -> DataFrame:
    """C14: keep wrong return values and type errors."""
    return labelled.where((F.col("label") == "False") | F.col("label").contains("MeinTypeError!"))
