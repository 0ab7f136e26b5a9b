"""Table schemas, keys and fixed limits, kept in one place.

Keys are inferred (the study's DDL is not published); comparisons are binary
(case-sensitive), which is what Spark and DuckDB do by default.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- column length caps applied before loading (code points, like str slices)
# They must equal the study's for the same rows.
MAX_PATH = 269
MAX_NAME = 134
MAX_FVT = 44
MAX_BASE_TYPE = 44
MAX_ANNOTATION = 539

# --- table keys (first row wins on duplicates)
MODULE_KEY = ["repo_id", "path_rel"]
FUNC_VAR_KEY = ["repo_id", "path_rel", "name", "lineno"]
ANNOTATION_KEY = ["repo_id", "path_rel", "func_var_name", "lineno", "annot_name"]
SNAPSHOT_KEY = ["name", "created_at"]

REPOSITORY = T.StructType([
    T.StructField("id", T.IntegerType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("user_name", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("creation_date", T.StringType()),  # "YYYY-MM-DD HH:MM:SS"
    T.StructField("stars", T.IntegerType()),
    T.StructField("clone_url", T.StringType()),
])

MODULE = T.StructType([
    T.StructField("repo_id", T.IntegerType()),
    T.StructField("path_rel", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("num_annotations", T.IntegerType()),
])

FUNC_VAR = T.StructType([
    T.StructField("repo_id", T.IntegerType()),
    T.StructField("path_rel", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("lineno", T.IntegerType()),
    T.StructField("num_var", T.IntegerType()),
    T.StructField("num_var_annotated", T.IntegerType()),
])

ANNOTATION = T.StructType([
    T.StructField("repo_id", T.IntegerType()),
    T.StructField("path_rel", T.StringType()),
    T.StructField("func_var_name", T.StringType()),
    T.StructField("lineno", T.IntegerType()),
    T.StructField("annot_name", T.StringType()),
    T.StructField("func_var_type", T.StringType()),
    T.StructField("base_type", T.StringType()),
    T.StructField("entire_annotation", T.StringType()),
    T.StructField("type_count", T.IntegerType()),
])

# One search-result record as saved per snapshot file.
SNAPSHOT_RECORD = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("stars", T.IntegerType()),
    T.StructField("created_at", T.StringType()),
])

# One page of the search API.
API_PAGE = T.StructType([
    T.StructField("items", T.ArrayType(T.StructType([
        T.StructField("full_name", T.StringType()),
        T.StructField("clone_url", T.StringType()),
        T.StructField("stargazers_count", T.IntegerType()),
        T.StructField("created_at", T.StringType()),
    ]))),
])

PROBE = T.StructType([
    T.StructField("tag", T.StringType()),    # str | none | int | float | bool | bytes | complex | ellipsis | error
    T.StructField("value", T.StringType()),  # repr of the value for non-str tags, the text for str
])

PROBE_ARG = T.StructType([
    T.StructField("arg", T.StringType()),
    T.StructField("annotated", T.BooleanType()),
    T.StructField("has_default", T.BooleanType()),
    T.StructField("probe", PROBE),
])

# Tagged output of the extraction job: one stream, split by ``kind``.
EXTRACTED = T.StructType([
    T.StructField("kind", T.StringType()),           # module | func_var | annotation | reject
    T.StructField("repo_id", T.IntegerType()),
    T.StructField("path_rel", T.StringType()),
    T.StructField("seq", T.IntegerType()),           # emission order of this kind in the file
    T.StructField("name", T.StringType()),           # module basename / func_var name / annotated func_var
    T.StructField("lineno", T.IntegerType()),
    T.StructField("num_var", T.IntegerType()),
    T.StructField("num_var_annotated", T.IntegerType()),
    T.StructField("num_annotations", T.IntegerType()),
    T.StructField("annot_name", T.StringType()),
    T.StructField("func_var_type", T.StringType()),
    T.StructField("entire_annotation", T.StringType()),
    T.StructField("type_count", T.IntegerType()),
    T.StructField("root_kind", T.StringType()),
    T.StructField("issues", T.ArrayType(T.StringType())),
    T.StructField("is_constant", T.BooleanType()),
    T.StructField("is_function", T.BooleanType()),
    T.StructField("unannotated_names", T.ArrayType(T.StringType())),
    T.StructField("arg_names_of_partial", T.ArrayType(T.StringType())),
    T.StructField("probe_args", T.ArrayType(PROBE_ARG)),
    T.StructField("probe_return", PROBE),
    T.StructField("n_required_other", T.IntegerType()),
    T.StructField("dup", T.BooleanType()),           # same truncated key seen earlier in this file
    T.StructField("first_def", T.BooleanType()),     # first ``def`` of its (truncated) name in this file
    T.StructField("status", T.StringType()),
    T.StructField("python_version", T.StringType()),  # interpreter whose grammar accepted or refused the file
])
