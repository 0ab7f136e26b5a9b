"""Snapshot / search-page / ranked-list files.

Two layouts are read:

* the study's layout: one JSON array per file named
  ``github_data_<year>_<i>.json`` (snapshot) or ``github_data_<year>.json``
  (merged list). A JSON array cannot be split, so each file is parsed by one
  task; the search API caps a snapshot at 10 pages x 100 records, which bounds
  such a file. Search pages hold ``items`` as the API returns them; a record's position
  follows from the page number and its place on the page.
* our layout: JSON Lines written by Spark, partitioned by ``year=`` /
  ``iteration=`` folders (any size, split across tasks). Positions are stored
  in the record (``pos``), because a line's position is not visible to a
  parallel reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tyscope.operators.windows import numbered_in_order
from tyscope.schemas import API_PAGE, SNAPSHOT_RECORD
from tyscope.sources.files import write_tree

SNAPSHOT_FILE = r"github_data_(\d{4})_(\d+)\.json$"
YEAR_FILE = r"github_data_(\d{4})\.json$"
API_PAGE_SIZE = 100  # records per search page
API_LIMIT = 1000     # records a search returns at most


def _line_schema() -> T.StructType:
    return T.StructType(list(SNAPSHOT_RECORD.fields) + [
        T.StructField("pos", T.LongType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("iteration", T.IntegerType()),
    ])


def snapshot_paths(root: str, year: int, iterations: int = 5, ext: str = "json") -> tuple[str, list[str]]:
    """A3: the merged list's file name and the snapshot file names of one year."""
    base = root.rstrip("/")
    return (f"{base}/github_data_{year}.{ext}",
            [f"{base}/github_data_{year}_{i}.{ext}" for i in range(iterations)])


# ------------------------------------------------------------------ study layout (JSON arrays)
def read_snapshot_arrays(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """A1/A3: snapshot arrays -> year, iteration, pos, name, url, stars, created_at."""
    raw = spark.read.text(paths, wholetext=True).withColumn("_file", F.col("_metadata.file_path"))
    recs = raw.select(
        F.regexp_extract("_file", SNAPSHOT_FILE, 1).try_cast("int").alias("year"),
        F.regexp_extract("_file", SNAPSHOT_FILE, 2).try_cast("int").alias("iteration"),
        F.posexplode(F.from_json("value", T.ArrayType(SNAPSHOT_RECORD))).alias("pos", "r"))
    return recs.select("year", "iteration", F.col("pos").cast("long").alias("pos"), "r.*")


def read_year_arrays(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """A2/O1: merged yearly arrays -> year, rank, name, url, stars, created_at."""
    raw = spark.read.text(paths, wholetext=True).withColumn("_file", F.col("_metadata.file_path"))
    recs = raw.select(
        F.regexp_extract("_file", YEAR_FILE, 1).try_cast("int").alias("year"),
        F.posexplode(F.from_json("value", T.ArrayType(SNAPSHOT_RECORD))).alias("rank", "r"))
    return recs.select("year", "rank", "r.*")


# ------------------------------------------------------------------ Spark layout (JSON Lines)
def write_snapshots(snap: DataFrame, path: str) -> None:
    (snap.select("year", "iteration", "pos", "name", "url", "stars", "created_at")
     .write.mode("overwrite").partitionBy("year", "iteration").json(path))


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema(_line_schema()).json(path)
    return df.select("year", "iteration", "pos", "name", "url", "stars", "created_at")


def _record_array(pos: str) -> Column:
    rec = F.struct("name", "url", "stars", "created_at")
    rows = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), rec.alias("r"))))
    return F.to_json(F.transform(rows, lambda x: x["r"]))


def write_snapshot_arrays(snap: DataFrame, root: str) -> None:
    """Snapshots in the study's layout: one JSON array per (year, iteration) file, in the order
    of ``pos``. A file is one record, so it is for snapshots within the API's limit."""
    name = F.format_string("github_data_%d_%d.json", "year", "iteration")
    write_tree(snap.groupBy("year", "iteration").agg(_record_array("pos").alias("content"))
               .select(name.alias("rel_path"), "content"), root)


def write_year_arrays(merged: DataFrame, root: str) -> None:
    """Ranked lists in the study's layout: one JSON array per year (1000 records at most)."""
    write_tree(merged.groupBy("year").agg(_record_array("rank").alias("content"))
               .select(F.format_string("github_data_%d.json", "year").alias("rel_path"), "content"), root)


def write_api_pages(snap: DataFrame, path: str, page_size: int = API_PAGE_SIZE) -> None:
    """Store snapshot records the way the search API returns them: pages of at most
    ``page_size`` items (a bounded group per page), which hold no positions."""
    item = F.struct(F.col("name").alias("full_name"), F.col("url").alias("clone_url"),
                    F.col("stars").alias("stargazers_count"), "created_at")
    pages = (numbered_in_order(snap, ["year", "iteration"], "pos", "_nth").withColumn("page", F.floor(F.col("_nth") / page_size).cast("int") + 1)
             .groupBy("year", "iteration", "page")
             .agg(F.sort_array(F.collect_list(F.struct("_nth", item.alias("it")))).alias("items")))
    (pages.select("year", "iteration", "page", F.col("items.it").alias("items"))
     .write.mode("overwrite").partitionBy("year", "iteration").json(path))


def read_api_pages(spark: SparkSession, path: str, page_size: int = API_PAGE_SIZE) -> DataFrame:
    """A5/O3: flatten pages -> year, iteration, pos, name, url, stars, created_at; the position
    is the page's first position plus the place on the page."""
    schema = (T.StructType().add("page", T.IntegerType()).add("items", API_PAGE["items"].dataType)
              .add("year", T.IntegerType()).add("iteration", T.IntegerType()))
    pages = spark.read.schema(schema).json(path)
    flat = pages.select("year", "iteration", "page", F.posexplode("items").alias("nth", "i"))
    return flat.select("year", "iteration", ((F.col("page").cast("bigint") - 1) * page_size + F.col("nth")).alias("pos"),
                       F.col("i.full_name").alias("name"), F.col("i.clone_url").alias("url"),
                       F.col("i.stargazers_count").alias("stars"), F.col("i.created_at").alias("created_at"))


def write_ranked(merged: DataFrame, path: str) -> None:
    """Ranked lists, one folder per year; the order lives in ``rank``."""
    (merged.select("year", "rank", "name", "url", "stars", "created_at")
     .write.mode("overwrite").partitionBy("year").json(path))


def read_ranked(spark: SparkSession, path: str) -> DataFrame:
    """A2/O1: all years' ranked lists as one DataFrame."""
    schema = (T.StructType().add("rank", T.IntegerType()).add("name", T.StringType())
              .add("url", T.StringType()).add("stars", T.IntegerType())
              .add("created_at", T.StringType()).add("year", T.IntegerType()))
    return spark.read.schema(schema).json(path).select("year", "rank", "name", "url", "stars", "created_at")
