"""Repository ranking from repeated search snapshots (L1).

Snapshot rows: ``year, iteration, pos, name, url, stars, created_at`` where
``pos`` is the record's position in its snapshot file. Repository identity is
``(name, created_at)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tyscope.functions.columns import creation_year, format_created_at, split_full_name
from tyscope.operators.windows import DEFAULT_CHUNK, first_by, numbered_by, previous_in_order, top_k_per_group

TOP_PER_YEAR = 1000
PAGE_SIZE = 100
MAX_PAGES = 10
ORDER_START = 1_000_000  # value the first record is compared against in W1

FILE_KEY = ["year", "iteration"]


def dedupe_snapshot(snap: DataFrame) -> DataFrame:
    """One record per (name, created_at) inside each snapshot, the most starred
    (ties: earlier position)."""
    return first_by(snap, FILE_KEY + ["name", "created_at"],
                    [F.col("stars"), -F.col("pos")])


def sort_stars_desc(snap: DataFrame) -> DataFrame:
    """Stable star-descending order inside each snapshot file."""
    return snap.orderBy("year", "iteration", F.desc("stars"), "pos")


def star_positions(snap: DataFrame) -> DataFrame:
    """``pos`` after the star-descending rewrite of each snapshot file, from 0."""
    new = numbered_by(snap.withColumnRenamed("pos", "_old"), FILE_KEY, [F.desc("stars"), "_old"], "pos")
    return new.select(*snap.columns)


def validate_duplicates(snap: DataFrame) -> DataFrame:
    """D3: per snapshot file, rows, distinct keys (valid entries) and duplicates."""
    return (snap.groupBy(*FILE_KEY)
            .agg(F.count(F.lit(1)).alias("n_rows"),
                 F.count_distinct("name", "created_at").alias("n_valid"))
            .withColumn("n_duplicates", F.col("n_rows") - F.col("n_valid")))


def order_errors(snap: DataFrame, chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """Per snapshot file, records with more stars than the record before them."""
    x = previous_in_order(snap, FILE_KEY, "pos", "stars", "prev_stars", chunk)
    bad = F.col("stars") > F.coalesce(F.col("prev_stars"), F.lit(ORDER_START))
    return (x.groupBy(*FILE_KEY)
            .agg(F.sum(F.when(bad, 1).otherwise(0)).cast("bigint").alias("n_order_errors")))


def key_conflicts(snap: DataFrame) -> DataFrame:
    """H7: names seen with several creation dates, and dates seen with several names."""
    by_name = (snap.groupBy("name").agg(F.count_distinct("created_at").alias("n_distinct"))
               .where(F.col("n_distinct") > 1)
               .select(F.lit("same_name").alias("conflict"), F.col("name").alias("value"), "n_distinct"))
    by_date = (snap.groupBy("created_at").agg(F.count_distinct("name").alias("n_distinct"))
               .where(F.col("n_distinct") > 1)
               .select(F.lit("same_date").alias("conflict"), F.col("created_at").alias("value"), "n_distinct"))
    return by_name.unionByName(by_date)


def merge_snapshots(snap: DataFrame, top: int = TOP_PER_YEAR) -> DataFrame:
    """D2 + W2 + S2: union of the snapshots of a year, one record per repository
    (most stars; ties: earlier snapshot, earlier position), the ``top`` most starred
    per year with their rank 0..top-1.

    A year may hold a large share of all rows: the top ``top`` are taken per
    (year, hash bucket) first and then per year over at most 64 * ``top`` rows;
    both steps also get Spark's per-task group limit before their shuffle.
    """
    best = first_by(snap, ["year", "name", "created_at"],
                    [F.col("stars"), -F.col("iteration"), -F.col("pos")])
    ranked = top_k_per_group(best, ["year"], [F.desc("stars"), F.col("iteration"), F.col("pos")], top,
                             split_cols=["name", "created_at"])
    return ranked.select("year", (F.col("_rn") - 1).cast("int").alias("rank"), "name", "url", "stars",
                         "created_at")


def snapshot_match(snap: DataFrame, merged: DataFrame) -> DataFrame:
    """H6: snapshot records whose repository (name, created_at) is in the merged list."""
    keys = merged.select("year", "name", "created_at")
    return snap.join(keys, ["year", "name", "created_at"], "left_semi")


def paginate(merged: DataFrame, page_size: int = PAGE_SIZE, max_pages: int = MAX_PAGES) -> DataFrame:
    """Page number of each ranked record, pages 1..max_pages."""
    page = (F.floor(F.col("rank") / page_size) + 1).cast("int")
    return merged.withColumn("page", page).where(F.col("page").between(1, max_pages))


def filter_search(records: DataFrame, year: int, min_stars: int = 10,
                  language: str | None = "python") -> DataFrame:
    """The search predicate: language, more than ``min_stars`` stars, created in ``year``.
    Records without a ``language`` column (already searched by language) need ``language=None``."""
    cond = (F.col("stars") > min_stars) & (F.substring("created_at", 1, 4) == str(year))
    if language is not None:
        cond = cond & (F.lower("language") == language)
    return records.where(cond)


# ---------------------------------------------------------------- repository table
def year_offsets(merged: DataFrame) -> DataFrame:
    """Start id of each year: years are numbered newest first, so year y starts
    after all newer years' repositories. One row per year (a small table)."""
    counts = merged.groupBy("year").agg(F.count(F.lit(1)).alias("n"))
    # a running sum over the years: the input has one row per year, so the
    # single ordered partition holds a handful of rows
    w = Window.orderBy(F.desc("year")).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("year", F.coalesce(F.sum("n").over(w), F.lit(0)).cast("int").alias("offset"))


def repository_rows(merged: DataFrame) -> DataFrame:
    """Repository table from the merged ranking; names without exactly one
    '/' are left out (see ``rejected_names``). ``merged`` is read twice: pass it stored."""
    user, short, valid = split_full_name("name")
    created = format_created_at("created_at")
    offsets = F.broadcast(year_offsets(merged))  # one row per year, by construction
    return (merged.where(valid).join(offsets, "year")
            .select((F.col("offset") + F.col("rank")).cast("int").alias("id"),
                    creation_year(created).alias("year"),
                    user.alias("user_name"), short.alias("name"),
                    created.alias("creation_date"),
                    F.col("stars").cast("int").alias("stars"),
                    F.col("url").alias("clone_url")))


def rejected_names(merged: DataFrame) -> DataFrame:
    _, _, valid = split_full_name("name")
    return merged.where(~valid)


def lookup_repo_id(repository: DataFrame, probes: DataFrame) -> DataFrame:
    """C7 (join form): id for each (year, user_name, name) probe, -1 when absent; when
    several repositories share the triple (same name, other creation date), the first
    (lowest id) answers, like a single-row lookup."""
    r = repository.groupBy("year", "user_name", "name").agg(F.min("id").alias("id"))
    return (probes.join(r, ["year", "user_name", "name"], "left")
            .withColumn("id", F.coalesce("id", F.lit(-1))))


def lookup_repo_by_name(repository: DataFrame, names: DataFrame) -> DataFrame:
    """The first repository (lowest id) with each short name; NULL when none."""
    firsts = (repository.groupBy("name")
              .agg(F.min_by(F.struct("id", "year", "user_name", "stars", "clone_url"), F.col("id"))
                   .alias("r")))
    return (names.select("name").join(firsts, "name", "left")
            .select("name", "r.id", "r.year", "r.user_name", "r.stars", "r.clone_url"))


def _longest(repository: DataFrame, col: str) -> DataFrame:
    best = F.max_by(F.struct(F.col("year"), F.length(col).alias("length"), F.col(col).alias("value")),
                    F.struct(F.length(col), -F.col("id")))
    agg = repository.agg(best.alias("b"))
    return agg.select(F.coalesce("b.year", F.lit(0)).alias("year"),
                      F.coalesce("b.length", F.lit(0)).alias("length"),
                      F.coalesce("b.value", F.lit("")).alias("value"))


def longest_repo_name(repository: DataFrame) -> DataFrame:
    """(year, length, name) of the longest short name; the lowest id wins ties."""
    return _longest(repository, "name")


def longest_clone_url(repository: DataFrame) -> DataFrame:
    """(year, length, url) of the longest clone URL."""
    return _longest(repository, "clone_url")


def clone_plan(merged: DataFrame, base_dir: str) -> DataFrame:
    """Per ranked repository its 1-based index in the year file and target folder."""
    return merged.select("year", (F.col("rank") + 1).alias("index"), "name", "url", "created_at",
                         F.concat_ws("/", F.lit(base_dir), F.col("year").cast("string"), F.col("name"))
                         .alias("target_dir"))
