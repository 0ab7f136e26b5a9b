"""Mixing sources to target weights by systematic sampling.

Every document of a source expects ``target / source_size`` copies. The documents
of a source stand in one fixed order; the prefix sum of the expected copies is
shifted by one random offset per source, and a document is emitted once for each
integer boundary its stretch of the prefix sum crosses.

The order is (size class, key, doc_id): large documents first, in classes six per cent
wide, and by a hash inside a class. Neighbours therefore have nearly equal sizes, and
the taken words stay within about one document of the target. No source is sorted in
one task: a source is cut into at most ``classes x splits`` cells whose counts give
every cell its place, and rows are numbered inside their cell only.

Cases: a null text has size 0; null sources form one source that comes last; an empty
table gives an empty result; rows that repeat in all columns are numbered in any order,
which gives the same rows either way; other columns are kept as they are, and helper
columns carry the prefix ``_mix_`` so that they clash with none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tyscope.llm.common import word_count
from tyscope.session import materialize

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
SPLITS = 64


def size_class(size: Column) -> Column:
    """Sortable text of the size's bit length and its five leading bits."""
    bits = F.bin(size)
    return F.concat(F.lpad(F.length(bits).cast("string"), 2, "0"), F.rpad(F.substring(bits, 1, 5), 5, "0"))


def _hash32(c: Column) -> Column:
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """Targets of a table (source, source_size) of one row per source.

    The weights repeat over the sources in code point order, null last. A source
    stops at ``max_copies`` times its size and the excess is shared again by weight:
    sources are taken in the order in which a rising common level would cap them, and
    the level that spends all words is read off the running sums.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy("_q", F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    t = (sizes.withColumn("_w", weight.cast("bigint"))
         .withColumn("_cap", F.col("source_size") * max_copies)
         .withColumn("_q", F.col("_cap").cast("double") / F.col("_w"))
         .withColumn("_total", F.sum("source_size").over(whole))
         .withColumn("_wall", F.sum("_w").over(whole))
         .withColumn("_spent", F.coalesce(F.sum("_cap").over(before), F.lit(0)))
         .withColumn("_wspent", F.coalesce(F.sum("_w").over(before), F.lit(0)))
         .withColumn("_level", (F.col("_total") - F.col("_spent")).cast("double") / (F.col("_wall") - F.col("_wspent"))))
    # the first source in this order that the level does not cap sets the level
    t = t.withColumn("_final", F.min_by(F.when(F.col("_q") >= F.col("_level"), F.col("_level")),
                                        F.when(F.col("_q") >= F.col("_level"), F.col("_q"))).over(whole))
    return t.select("source", "source_size",
                    F.least(F.col("_cap").cast("double"), F.col("_final") * F.col("_w")).alias("target"))


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES,
             seed: int = 7, splits: int = SPLITS) -> DataFrame:
    """``docs`` (doc_id, text, source, any others) with _mix_size, _mix_source_size,
    _mix_target and _mix_copies (how often the mix emits the row)."""
    key = F.concat_ws("|", F.col("doc_id").cast("string"), "text")
    sized = docs.select("*", word_count("text").alias("_mix_size"), _hash32(key).alias("_mix_key"),
                        F.struct(F.col("source").isNull().alias("n"), F.coalesce("source", F.lit("")).alias("s"))
                        .alias("_mix_source"))
    sized = (sized.withColumn("_mix_class", size_class(F.col("_mix_size")))
             .withColumn("_mix_split", F.shiftright(F.col("_mix_key") * splits, 32).cast("int")))
    cell = ["_mix_source", "_mix_class", "_mix_split"]
    # at most classes x splits rows per source, whatever the number of documents
    cells = materialize(sized.groupBy(*cell).agg(F.count(F.lit(1)).alias("_mix_n"), F.sum("_mix_size").alias("_mix_s")),
                        "mix-cells")
    sizes = cells.groupBy("_mix_source").agg(F.sum("_mix_s").alias("source_size")).select(
        F.when(~F.col("_mix_source.n"), F.col("_mix_source.s")).alias("source"), "source_size")
    targets = source_targets(sizes, weights, max_copies).select(
        F.struct(F.col("source").isNull().alias("n"), F.coalesce("source", F.lit("")).alias("s")).alias("_mix_source"),
        F.col("source_size").alias("_mix_source_size"), F.col("target").alias("_mix_target"))
    ahead = (Window.partitionBy("_mix_source").orderBy(F.desc("_mix_class"), "_mix_split")
             .rowsBetween(Window.unboundedPreceding, -1))
    cells = (cells.withColumn("_mix_before", F.coalesce(F.sum("_mix_n").over(ahead), F.lit(0)))
             .drop("_mix_n", "_mix_s").join(targets, "_mix_source"))
    inside = Window.partitionBy(*cell).orderBy("_mix_key", "doc_id")
    offset = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("_mix_source.n").cast("string"), F.lit("|"),
                                                F.col("_mix_source.s"))), 1, 5), 16, 10).cast("double") + 0.5) / 2 ** 20
    rate = F.coalesce(F.try_divide("_mix_target", F.col("_mix_source_size").cast("double")), F.lit(0.0))
    rank = F.col("_mix_before") + F.col("_mix_row")
    return (sized.withColumn("_mix_row", F.row_number().over(inside)).join(cells, cell)
            .withColumn("_mix_copies", (F.floor(offset + rate * rank) - F.floor(offset + rate * (rank - 1)))
                        .cast("bigint"))
            .drop("_mix_key", "_mix_class", "_mix_split", "_mix_before", "_mix_row", "_mix_source"))


def emit(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as the mix takes it, with
    ``copy`` counting from 1 (a column of that name in ``docs`` is replaced)."""
    cols = [c for c in docs.columns if c != "copy"]
    planned = plan_mix(docs, **options).where(F.col("_mix_copies") > 0)
    return planned.select(*cols, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_mix_copies"))).alias("copy"))
