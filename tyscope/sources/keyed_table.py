"""Keyed fact tables (A11): append what is new, reading only what can hold it already.

Layout below the table's folder: ``gen=<n>/`` with one folder per load, whose files hold the
rows clustered by the whole key (range partitioned and sorted), and ``_ranges/v=<n>/`` with one
row per file: its smallest and largest key. A version of ``_ranges`` names all files of
the table and is what commits a load; what an ended load left behind is overwritten by the next.

A load looks up the batch's keys in the ranges and reads the keys of the files that can
hold them, so its cost follows the batch and not the table. The look-up is a sort: files and
the batch's keys stand in one order, and every key takes the last file that begins before
it (``windows.last_seen``). Neither side is collected; the driver gets the names of
the files that are then read.

One load of a table runs at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tyscope.operators.windows import last_seen, numbered_by
from tyscope.session import delete_path, folder_names, materialize, path_exists

#: Loads kept apart before ``compact_fact_table`` is due (a key is looked up in each).
MAX_GENERATIONS = 64


def _version(spark: SparkSession, path: str) -> int:
    """The last committed version, 0 for a new table."""
    found = [int(n[2:]) for n in folder_names(spark, f"{path}/_ranges") if n.startswith("v=")]
    return max((v for v in found if path_exists(spark, f"{path}/_ranges/v={v}/_SUCCESS")), default=0)


def file_ranges(spark: SparkSession, path: str) -> DataFrame | None:
    """(gen, file, lo, hi, rows) of the table's files; None for a new table."""
    v = _version(spark, path)
    return spark.read.parquet(f"{path}/_ranges/v={v}") if v else None


def _generations(ranges: DataFrame | None) -> list[int]:
    """At most about MAX_GENERATIONS numbers."""
    return [] if ranges is None else [r[0] for r in ranges.select("gen").distinct().collect()]


def generations(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the table's loads, in order."""
    return sorted(_generations(file_ranges(spark, path)))


def read_fact_table(spark: SparkSession, path: str, schema: T.StructType, gens: list[int] | None = None) -> DataFrame:
    """The rows of a keyed table, or of some of its loads."""
    live = generations(spark, path) if gens is None else list(gens)
    if not live:
        return spark.createDataFrame([], schema)
    stored = T.StructType([*schema.fields, T.StructField("gen", T.IntegerType())])
    return spark.read.schema(stored).parquet(path).where(F.col("gen").isin(live)).select(*schema.fieldNames())


def matching_files(batch: DataFrame, ranges: DataFrame, key: list[str]) -> DataFrame:
    """The rows of ``ranges`` whose files can hold a key of ``batch``.

    Keys are looked up as one stretch (smallest to largest key) per value of the first key
    column. A load's files are disjoint and in order, so a stretch meets a run of them."""
    whole = F.struct(*[F.col(c) for c in key])
    stretches = (batch.groupBy(key[0]).agg(F.min(whole).alias("lo"), F.max(whole).alias("hi"))
                 .select(F.monotonically_increasing_id().alias("stretch"), "lo", "hi"))
    stretches = materialize(stretches, "load-stretches")
    files = numbered_by(ranges, ["gen"], ["lo", "file"], "idx")
    gens = F.array(*[F.lit(g) for g in _generations(ranges)])
    points = stretches.select("stretch", "lo", "hi", F.explode(gens).alias("gen"))
    ends = F.array(F.struct(F.lit(1).alias("side"), F.col("lo").alias("key")), F.struct(F.lit(2).alias("side"), F.col("hi").alias("key")))
    points = points.select("gen", "stretch", F.inline(ends))
    events = (files.select("gen", F.lit(0).alias("side"), F.col("lo").alias("key"), F.struct("idx", "hi").alias("begun"))
              .unionByName(points, allowMissingColumns=True))
    found = last_seen(events, ["gen"], ["key", "side", "stretch"], "begun", "seen").where(F.col("side") > 0)

    def at(side, column):
        return F.max(F.when(F.col("side") == side, F.col(column)))
    runs = (found.groupBy("gen", "stretch").agg(at(1, "key").alias("lo"), at(1, "seen").alias("first"), at(2, "seen").alias("last"))
            .where(F.col("last").isNotNull())
            .withColumn("from", F.when(F.col("first").isNull(), F.lit(0))
                        .otherwise(F.col("first.idx") + F.when(F.col("first.hi") < F.col("lo"), 1).otherwise(0)))
            .where(F.col("from") <= F.col("last.idx")))
    touched = runs.select("gen", F.explode(F.sequence("from", "last.idx")).alias("idx")).distinct()
    return files.join(touched, ["gen", "idx"], "left_semi").drop("idx")


def matching_rows(spark: SparkSession, path: str, schema: T.StructType, gens: list[int], batch: DataFrame, key: list[str],
                  key_width: int) -> DataFrame:
    """Stored rows of some loads that can share the first columns of the table's key with a row of
    ``batch``; other files are not read. ``key`` names those columns in ``batch``; ``key_width`` is
    the table's number of key columns."""
    if not gens:
        return spark.createDataFrame([], schema)
    ranges = file_ranges(spark, path).where(F.col("gen").isin(list(gens)))
    if len(key) < key_width:  # an interval of whole keys lies inside the interval of their first columns
        whole = ranges.schema["lo"].dataType.fieldNames()

        def first(c):
            return F.struct(*[F.col(c)[n].alias(k) for n, k in zip(whole, key)]).alias(c)
        ranges = ranges.select("gen", "file", first("lo"), first("hi"), "rows")
    files = [f"{path}/gen={r.gen}/{r.file}" for r in matching_files(batch, ranges, key).select("gen", "file").collect()]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def append_rows(spark: SparkSession, rows: DataFrame, path: str, key: list[str], replace: bool = False) -> int:
    """Add ``rows`` as a load of their own without looking at stored keys (or in place of all
    loads); the version that holds them."""
    ranges = file_ranges(spark, path)
    gen = max(_generations(ranges), default=-1) + 1
    added = _write_generation(spark, rows, path, gen, key, None)
    _commit(spark, path, added if ranges is None or replace else ranges.unionByName(added))
    return _version(spark, path)


def _write_generation(spark: SparkSession, rows: DataFrame, path: str, gen: int, key: list[str], rows_per_file: int | None) -> DataFrame:
    """Write ``rows`` clustered by key; their files' ranges."""
    writer = rows.repartitionByRange(*key).sortWithinPartitions(*key).write.mode("overwrite")
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.parquet(f"{path}/gen={gen}")
    # a file stands in order of the key, so its first and last row are its range
    stored = (spark.read.schema(rows.schema).parquet(f"{path}/gen={gen}")
              .select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"), F.struct(*key).alias("key")))
    counts = stored.groupBy("file").agg(F.count(F.lit(1)).alias("rows"))
    ends = stored.join(F.broadcast(counts), "file").where((F.col("at") == 0) | (F.col("at") == F.col("rows") - 1))
    return (ends.groupBy("file").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.first("rows").alias("rows"))
            .select(F.lit(gen).alias("gen"), "file", "lo", "hi", "rows"))


def _commit(spark: SparkSession, path: str, ranges: DataFrame) -> None:
    ranges.write.mode("overwrite").parquet(f"{path}/_ranges/v={_version(spark, path) + 1}")


def load_fact_table(spark: SparkSession, new_rows: DataFrame, path: str, key: list[str],
                    order: list[str], rows_per_file: int | None = None) -> DataFrame:
    """Append rows whose key is not in the table yet; inside the batch the first
    row per key wins, like inserts that skip duplicate keys.

    ``order`` names the columns that tell which row was visited first; they are not stored.
    An empty list states that the batch has each key once. ``rows_per_file`` bounds the files
    (by default a task's range is one file). Keys hold no nulls: a null equals nothing.
    """
    batch = new_rows
    if order:
        w = Window.partitionBy(*key).orderBy(*order)
        batch = batch.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", *order)
    batch = materialize(batch, "load-batch")
    ranges = file_ranges(spark, path)
    gen = max(_generations(ranges), default=-1) + 1
    if ranges is not None:
        files = [f"{path}/gen={r.gen}/{r.file}" for r in matching_files(batch, ranges, key).select("gen", "file").collect()]
        if files:
            # sorted files are small for their rows, so by its size the planner would broadcast a large side
            stored = spark.read.schema(batch.schema).parquet(*files).select(*key).hint("merge")
            batch = batch.join(stored, key, "left_anti")
    added = _write_generation(spark, batch, path, gen, key, rows_per_file)
    _commit(spark, path, added if ranges is None else ranges.unionByName(added))
    return read_fact_table(spark, path, batch.schema)


def compact_fact_table(spark: SparkSession, path: str, schema: T.StructType, key: list[str],
                       rows_per_file: int | None = None, always: bool = False) -> bool:
    """Rewrite the table as one load once it has more than MAX_GENERATIONS (or ``always``) and
    delete the old files; to be run while nobody reads the table. Returns whether it did."""
    old = _generations(file_ranges(spark, path))
    if not old or not (always or len(old) > MAX_GENERATIONS):
        return False
    added = _write_generation(spark, read_fact_table(spark, path, schema), path, max(old) + 1, key, rows_per_file)
    _commit(spark, path, added)
    for gen in old:
        delete_path(spark, f"{path}/gen={gen}")
    return True
