"""Interchange formats (A7, A8, A14-A16) and table loading.

JSON documents in the study's formats are parsed with VARIANT (``parse_json``
+ ``variant_get``), which handles their positional, mixed-type arrays. Our
writers emit JSON Lines where every line is a complete document of the same
format holding one entry, so writing is distributed and any reader of the
study's format reads them too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tyscope.schemas import ANNOTATION, FUNC_VAR, MODULE
from tyscope.sources.json_document import CHUNK_BYTES, document_rows, year_of
from tyscope.sources.keyed_table import load_fact_table, read_fact_table  # noqa: F401  (A11)

COMMIT_KEYS = {
    "module": ("module_commits", MODULE),
    "func_var": ("func_var_commits", FUNC_VAR),
    "annotation": ("annotation_commits", ANNOTATION),
}


def _js(c: Column) -> Column:
    """JSON encoding of a scalar (string, number or boolean)."""
    return F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")


def _json_array(cols: list[Column]) -> Column:
    parts: list[Column] = [F.lit("[")]
    for i, c in enumerate(cols):
        if i:
            parts.append(F.lit(","))
        parts.append(F.coalesce(_js(c), F.lit("null")))
    parts.append(F.lit("]"))
    return F.concat(*parts)


def with_year(rows: DataFrame, repository: DataFrame) -> DataFrame:
    """``rows`` with the ``year`` of their repository (NULL when it has no repository row)."""
    years = repository.select(F.col("id").alias("repo_id"), "year").distinct()
    return rows.join(years, "repo_id", "left")


# ------------------------------------------------------------------ commit log
def write_commit_log(rows: DataFrame, table: str, path: str, repository: DataFrame) -> None:
    """One commit-log document per row, JSON Lines, partitioned by the repository's year."""
    key, schema = COMMIT_KEYS[table]
    doc = F.concat(F.lit('{"' + key + '": ['), _json_array([F.col(f.name) for f in schema.fields]), F.lit("]}"))
    (with_year(rows, repository).select("year", doc.alias("value"))
     .write.mode("overwrite").partitionBy("year").text(path))


def read_commit_log(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Rows of one table from commit-log documents of one line each (ours, one row per line),
    with ``year`` if the files lie in year folders.

    A line is parsed by one task; for the study's documents, which hold a whole year on one
    line, see ``read_commit_documents``. Rows are read as arrays of texts and cast."""
    key, schema = COMMIT_KEYS[table]
    docs = spark.read.text(path)
    rows = docs.select("*", F.explode(F.from_json("value", f"{key} array<array<string>>")[key]).alias("r"))
    year = [F.col("year")] if "year" in docs.columns else []
    return rows.select(*[F.get("r", F.lit(i)).cast(f.dataType).alias(f.name) for i, f in enumerate(schema.fields)], *year)


def read_commit_documents(spark: SparkSession, path: str, table: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows of one table from the study's documents at ``path``, each cut into ranges of
    ``chunk_bytes`` that are read by tasks of their own, with the ``year`` of the file's name."""
    key, schema = COMMIT_KEYS[table]
    rows = document_rows(spark, path, key, chunk_bytes)
    rows = rows.select(F.from_json("value", "array<string>").alias("r"), year_of("file").alias("year"))
    return rows.select(*[F.get("r", F.lit(i)).cast(f.dataType).alias(f.name) for i, f in enumerate(schema.fields)], "year")


def write_commit_documents(rows: DataFrame, table: str, path: str, repository: DataFrame, docs_per_year: int) -> None:
    """The study's document format: ``docs_per_year`` one-line documents in each year's folder. Each
    is put together by one task, so their number must fit the rows."""
    key, schema = COMMIT_KEYS[table]
    line = _json_array([F.col(f.name) for f in schema.fields])
    part = F.pmod(F.xxhash64(*[f.name for f in schema.fields]), F.lit(docs_per_year))
    docs = (with_year(rows, repository).groupBy("year", part.alias("part"))
            .agg(F.concat(F.lit('{"' + key + '": ['), F.array_join(F.collect_list(line), ", "), F.lit("]}")).alias("value")))
    docs.repartition("year", "part").select("year", "value").write.mode("overwrite").partitionBy("year").text(path)


def save_fact_log(module: DataFrame, func_var: DataFrame, annotation: DataFrame, repository: DataFrame, path: str) -> None:
    """Three parquet datasets partitioned by year (the Spark-native commit log)."""
    for name, df in (("module", module), ("func_var", func_var), ("annotation", annotation)):
        with_year(df, repository).write.mode("overwrite").partitionBy("year").parquet(f"{path}/{name}")


# ------------------------------------------------------------------ JSON maps
def write_count_map(counts: DataFrame, key_col: str, value_col: str, path: str) -> None:
    """A14 out: ``{name: count}`` objects, one entry per line."""
    doc = F.to_json(F.create_map(F.col(key_col), F.col(value_col)))
    counts.select(doc.alias("value")).write.mode("overwrite").text(path)


def read_count_map(spark: SparkSession, path: str, key_col: str = "arg_name", value_col: str = "n",
                   value_type: str = "bigint") -> DataFrame:
    """A14 in: any number of ``{key: value}`` objects (one per line) -> two columns."""
    m = F.from_json("value", f"map<string,{value_type}>")
    return (spark.read.text(path).select(F.explode(m).alias(key_col, value_col)))


def write_verdict_map(verdicts: DataFrame, path: str) -> None:
    """A15 out: ``{"<repo_id>": clean}`` objects, one entry per line."""
    doc = F.to_json(F.create_map(F.col("repo_id").cast("string"), F.col("clean")))
    verdicts.select(doc.alias("value")).write.mode("overwrite").text(path)


def read_verdict_map(spark: SparkSession, path: str) -> DataFrame:
    """A15 in: repository id (string keys cast back to int) -> clean."""
    m = F.from_json("value", "map<string,boolean>")
    kv = spark.read.text(path).select(F.explode(m).alias("k", "clean"))
    return kv.select(F.col("k").cast("int").alias("repo_id"), "clean")


# ------------------------------------------------------------------ findings
def write_findings(findings: DataFrame, path: str) -> None:
    """Findings as ``[repo_id, path, function, [status, [message]]]`` arrays, one per line."""
    inner = F.concat(F.lit("["), _js(F.col("label")), F.lit(",["), _js(F.col("message")), F.lit("]]"))
    line = F.concat(F.lit("["), _js(F.col("repo_id")), F.lit(","), _js(F.col("file_path")), F.lit(","),
                    _js(F.col("name")), F.lit(","), inner, F.lit("]"))
    findings.select(line.alias("value")).write.mode("overwrite").text(path)


def read_findings(spark: SparkSession, path: str, multiline_array: bool = False) -> DataFrame:
    """Heterogeneous finding arrays -> repo_id, file_path, name, status, messages.

    ``multiline_array``: the file is one JSON array of findings (the study's file).
    """
    if multiline_array:
        docs = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("d"))
        items = docs.select(F.explode(F.variant_get("d", "$", "array<variant>")).alias("v"))
    else:
        items = spark.read.text(path).select(F.parse_json("value").alias("v"))
    return items.select(
        F.variant_get("v", "$[0]", "int").alias("repo_id"),
        F.variant_get("v", "$[1]", "string").alias("file_path"),
        F.variant_get("v", "$[2]", "string").alias("name"),
        F.try_variant_get("v", "$[3][0]", "string").alias("status"),
        F.try_variant_get("v", "$[3][1]", "array<string>").alias("messages"))


# ------------------------------------------------------------------ tables
def stage_rows(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows in the table's column order and types."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def clear_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Replace the table's content with no rows (schema kept)."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def save_bucketed(df: DataFrame, table: str, path: str, keys: list[str], buckets: int) -> DataFrame:
    """Write a fact table bucketed by its join key, so joins of two tables bucketed the
    same way on the same key run without a shuffle.

    Rows are first hash-partitioned on the key into ``buckets`` tasks (the same hash
    the bucketing uses), so each bucket is one file rather than one file per writing
    task. No ``sortBy``: bucket sort order is not used by joins by default."""
    (df.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys)
     .option("path", path).saveAsTable(table))
    return df.sparkSession.table(table)
