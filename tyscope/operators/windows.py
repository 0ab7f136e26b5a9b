"""Order-dependent helpers that stay distributed.

``previous_in_order`` gives each row the value of the row before it (by an
order column, inside a partition key) without gathering a whole partition key
into one task: rows are cut into fixed-width chunks of the order column, the
lag is taken inside each chunk, and the first row of a chunk takes the last
value of the nearest earlier non-empty chunk from a small per-chunk summary.

``in_order`` does without an order column of numbers: rows are range partitioned by any
order and stored with their partition and place, and ``numbered_by``, ``running_sum`` and
``last_seen`` add what the earlier partitions hold, one summary row per partition and key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tyscope.session import materialize

DEFAULT_CHUNK = 1 << 16


def previous_in_order(df: DataFrame, part_cols: list[str], order_col: str, value_col: str,
                      out_col: str = "prev", chunk: int = DEFAULT_CHUNK) -> DataFrame:
    x = df.withColumn("_chunk", F.floor(F.col(order_col) / chunk))
    w = Window.partitionBy(*part_cols, "_chunk").orderBy(order_col)
    x = (x.withColumn("_rn", F.row_number().over(w))
         .withColumn("_lag", F.lag(value_col).over(w)))
    summary = (x.groupBy(*part_cols, "_chunk")
               .agg(F.max_by(value_col, order_col).alias("_last")))
    # one row per chunk: small, ordered per partition key
    ws = Window.partitionBy(*part_cols).orderBy("_chunk")
    summary = summary.select(*part_cols, "_chunk", F.lag("_last").over(ws).alias("_carry"))
    x = x.join(summary, [*part_cols, "_chunk"], "left")
    return (x.withColumn(out_col, F.when(F.col("_rn") == 1, F.col("_carry")).otherwise(F.col("_lag")))
            .drop("_chunk", "_rn", "_lag", "_carry"))


def numbered_in_order(df: DataFrame, part_cols: list[str], order_col: str, out_col: str,
                      chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """``df`` with each row's place (from 0) by ``order_col`` inside its partition key: the
    place inside a fixed-width chunk of the order column plus the rows of the chunks before."""
    x = df.withColumn("_chunk", F.floor(F.col(order_col) / chunk))
    ahead = Window.partitionBy(*part_cols).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    # one row per chunk: small, ordered per partition key
    first = (x.groupBy(*part_cols, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
             .select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(part_cols)], F.col("_chunk").alias("_c"),
                     F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_first")))
    inside = Window.partitionBy(*part_cols, "_chunk").orderBy(order_col)
    same = F.col("_chunk").eqNullSafe(F.col("_c"))
    for i, c in enumerate(part_cols):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return (x.withColumn("_rn", F.row_number().over(inside)).join(first, same)
            .select(*[c for c in df.columns if c != out_col], (F.col("_first") + F.col("_rn") - 1).alias(out_col)))


def in_order(df: DataFrame, order: list[Column | str]) -> DataFrame:
    """``df`` range partitioned and sorted by ``order``, stored, with ``_part`` (partitions in
    order) and ``_at`` (place in the partition, from 0)."""
    x = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    x = x.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit(2 ** 33 - 1)))
    return materialize(x, "in-order")


def _with_summary(rows: DataFrame, part_cols: list[str], summary: DataFrame, value: str) -> DataFrame:
    """``rows`` with ``value`` of their key and partition (null keys are equal)."""
    s = summary.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(part_cols)], F.col("_part").alias("_p"), value)
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate(part_cols):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(s, same, "left").drop("_p", *[f"_k{i}" for i in range(len(part_cols))])


def _earlier(part_cols: list[str]):
    return Window.partitionBy(*part_cols).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)


def numbered_by(df: DataFrame, part_cols: list[str], order: list[Column | str], out_col: str) -> DataFrame:
    """``df`` with each row's place (from 0) by ``order`` (a total order of any types) inside its
    key: the place in its range partition plus the key's rows in the partitions before."""
    x = in_order(df, [*part_cols, *order])
    s = x.groupBy(*part_cols, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    s = s.withColumn("_base", F.coalesce(F.sum("_n").over(_earlier(part_cols)), F.lit(0)) - F.col("_first"))
    return (_with_summary(x, part_cols, s, "_base").withColumn(out_col, F.col("_at") + F.col("_base"))
            .drop("_base", "_part", "_at"))


def running_sum(df: DataFrame, order: list[Column | str], value_col: str, out_col: str) -> DataFrame:
    """``df`` with the sum of ``value_col`` over the rows before each row in ``order``."""
    x = in_order(df, order)
    s = x.groupBy("_part").agg(F.sum(value_col).alias("_sum"))
    s = s.withColumn("_base", F.coalesce(F.sum("_sum").over(_earlier([])), F.lit(0)))  # one row per partition
    before = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    return (_with_summary(x, [], s, "_base")
            .withColumn(out_col, F.col("_base") + F.coalesce(F.sum(value_col).over(before), F.lit(0)))
            .drop("_base", "_part", "_at"))


def last_seen(df: DataFrame, part_cols: list[str], order: list[Column | str], value_col: str, out_col: str) -> DataFrame:
    """``df`` with the last non-null ``value_col`` at or before each row in ``order``, inside its key."""
    x = in_order(df, [*part_cols, *order])
    s = x.groupBy(*part_cols, "_part").agg(F.max_by(value_col, F.when(F.col(value_col).isNotNull(), F.col("_at"))).alias("_last"))
    s = s.withColumn("_carry", F.last("_last", ignorenulls=True).over(_earlier(part_cols)))
    upto = Window.partitionBy(*part_cols, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn(out_col, F.last(value_col, ignorenulls=True).over(upto))
    return (_with_summary(x, part_cols, s, "_carry").withColumn(out_col, F.coalesce(out_col, "_carry"))
            .drop("_carry", "_part", "_at"))


def first_by(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Keep the first row per key under ``order`` (W3), as an aggregate.

    ``max_by`` over a struct with partial aggregation (Spark sorts for it on both sides, as
    the buffer is a struct): each map task sends at most one row per key into the shuffle,
    so a hot key costs one row per task.
    """
    cols = [c for c in df.columns if c not in key]
    best = F.max_by(F.struct(*[F.col(c) for c in cols]), F.struct(*order)).alias("_best")
    return df.groupBy(*key).agg(best).select(*key, *[F.col(f"_best.{c}").alias(c) for c in cols])


def top_k_per_group(df: DataFrame, group_cols: list[str], order: list[Column], k: int,
                    rank_col: str = "_rn", split_cols: list[str] | None = None,
                    buckets: int = 64) -> DataFrame:
    """The first ``k`` rows per group under ``order`` (a total order), with their
    1-based position in ``rank_col``.

    A group may hold a large share of all rows, so it is split first: top ``k``
    per (group, hash bucket of ``split_cols``), then top ``k`` per group over at
    most ``buckets * k`` rows. Each step filters on ``row_number()`` directly, so
    Spark also applies the limit per task before each shuffle.
    """
    if split_cols:
        bucket = F.pmod(F.hash(*[F.col(c) for c in split_cols]), F.lit(buckets))
        w1 = Window.partitionBy(*group_cols, "_bucket").orderBy(*order)
        df = (df.withColumn("_bucket", bucket)
              .withColumn("_rn1", F.row_number().over(w1))
              .where(F.col("_rn1") <= k)
              .drop("_bucket", "_rn1"))
    w = Window.partitionBy(*group_cols).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def numbered(df: DataFrame, cols: list[str], out_col: str, buckets: int = 256) -> DataFrame:
    """The distinct values of ``cols`` with a number from 0 without gaps, the same for the
    same set of values. Numbers run through hash buckets; only one row per bucket is
    ordered as a whole."""
    x = df.select(*cols).distinct().withColumn("_bucket", F.pmod(F.xxhash64(*cols), F.lit(buckets)))
    ahead = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = (x.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
             .select("_bucket", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_first")))
    inside = Window.partitionBy("_bucket").orderBy(*cols)
    return (x.withColumn("_rn", F.row_number().over(inside)).join(F.broadcast(first), "_bucket")
            .select(*cols, (F.col("_first") + F.col("_rn") - 1).alias(out_col)))
