"""Uniform shuffle into shards of exact sizes by a communication matrix (DataFrame functions only).

A uniformly random permutation of all rows sends some number of rows from every input
partition to every shard. Those numbers form a matrix whose rows sum to the partition
sizes and whose columns sum to the shard sizes, and whose distribution is the
multivariate hypergeometric one. The matrix is drawn first, exactly and without looking
at a row; then

1. every partition permutes its rows locally (a sort inside the task, no shuffle);
2. the first ``matrix[p][0]`` rows of partition ``p`` go to shard 0, the next
   ``matrix[p][1]`` to shard 1, and so on (the one exchange of rows);
3. every shard permutes what it received, which numbers its slots.

The matrix is drawn down a binary tree over the partitions: the column sums of a node are
split between its two halves, one hypergeometric count per shard, so that ``P``
partitions take ``log2 P`` rounds, whose nodes are rows and drawn in parallel. A count is
drawn by inversion of its distribution, built outwards from the mode with the ratio of
neighbouring probabilities; the sum runs to where no 53-bit uniform number reaches.

A shard is not numbered in one task: it is cut into cells by the leading part of the
second random key, of about ``CELL_ROWS`` rows each, and a cell's place comes from the counts
of the cells before it.

Partitions are the tasks of the scan, so another layout of the input gives another, equally
uniform shuffle; the same layout and seed give the same one. The permuted rows are written
once to the shared folder, so that a lost executor cannot deal anew.

Cases: nulls are values like any other, a null text has no bytes; repeated rows are rows
of their own; empty partitions and an empty table have no counts to draw; with fewer rows
than shards the last shards stay empty; all columns are kept, and helper columns carry the
prefix ``_hg_``. ``doc_id`` may be of any type, it is not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tyscope.session import materialize

SHARDS = 16
CELL_ROWS = 16_384
SEED = 13
#: Beyond so many standard deviations plus TAIL steps from the mode lies less than 2**-53.
SIGMAS, TAIL = 9, 40
#: From this depth of the tree on, the nodes are dealt out over tasks.
SPREAD_DEPTH = 6


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) with 53 random bits, from a hash of the parts."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") * F.lit(2.0 ** -53)


def _steps(first: Column, last: Column, step: int) -> Column:
    """The integers from first to last; none where they lie the wrong way round."""
    right = last >= first if step > 0 else last <= first
    return F.when(right, F.sequence(first, last, F.lit(step).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))


def hypergeometric(good: Column, bad: Column, draws: Column, u: Column) -> Column:
    """How many of ``draws`` rows taken without return from ``good`` + ``bad`` are good, for
    the uniform number ``u``. All are bigint columns but ``u``."""
    g, b, d = (c.cast("double") for c in (good, bad, draws))
    n = g + b
    lo, hi = F.greatest(F.lit(0).cast("bigint"), draws - bad), F.least(good, draws)
    sigma = F.when(n > 1, F.sqrt(d * (g / n) * (b / n) * (n - d) / (n - 1))).otherwise(F.lit(0.0))
    mode = F.greatest(lo, F.least(hi, F.floor((d + 1) * ((g + 1) / (n + 2))).cast("bigint")))

    def drawn(a):
        def grown(w, k):  # from the weight of k to that of k + 1
            k = k.cast("double")
            return w * ((a["g"] - k) * (a["d"] - k)) / ((k + 1) * (a["b"] - a["d"] + k + 1))

        def shrunk(w, k):  # from the weight of k to that of k - 1
            k = k.cast("double")
            return w * (k * (a["b"] - a["d"] + k)) / ((a["g"] - k + 1) * (a["d"] - k + 1))

        up = _steps(a["mode"], F.least(a["hi"], a["mode"] + a["half"]), 1)
        down = _steps(a["mode"], F.greatest(a["lo"], a["mode"] - a["half"]), -1)

        def mass(side, move):
            return F.aggregate(side, F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s")),
                               lambda s, k: F.struct(move(s["w"], k).alias("w"), (s["s"] + s["w"]).alias("s")))["s"]

        def walk(side, move, target, so_far, first):
            """The step at which the running mass passes the target (null: never), and that mass."""
            start = F.struct(F.lit(1.0).alias("w"), so_far.alias("s"), target.alias("t"), F.lit(None).cast("bigint").alias("k"))

            def merge(s, k):
                more = s["s"] + F.when(k == first, F.lit(0.0)).otherwise(s["w"])
                return F.struct(move(s["w"], k).alias("w"), more.alias("s"), s["t"].alias("t"),
                                F.when(s["k"].isNull() & (s["t"] < more), k).otherwise(s["k"]).alias("k"))
            return F.aggregate(side, start, merge)

        # the mode is the first step of both sides and counts once, on the way up
        total = mass(up, grown) + mass(down, shrunk) - 1.0
        none = F.lit(-1).cast("bigint")
        return let(walk(up, grown, a["u"] * total, F.lit(0.0), none),
                   lambda x: F.coalesce(x["k"], walk(down, shrunk, x["t"], x["s"], a["mode"])["k"], a["mode"]))

    return let(F.struct(g.alias("g"), b.alias("b"), d.alias("d"), lo.alias("lo"), hi.alias("hi"), mode.alias("mode"),
                        (F.ceil(sigma * SIGMAS) + TAIL).cast("bigint").alias("half"), u.alias("u")), drawn)


def split_counts(sums: Column, take: Column, *random: Column) -> Column:
    """How the ``take`` rows of one half share in the column sums ``sums`` of a node: the
    multivariate hypergeometric draw, one column after the other."""
    none = F.array().cast("array<bigint>")
    total = F.aggregate(sums, F.lit(0).cast("bigint"), lambda a, x: a + x)
    start = F.struct(total.alias("rows"), take.alias("take"), none.alias("out"))

    def merge(s, good):
        x = hypergeometric(good, s["rows"] - good, s["take"], uniform(*random, F.size(s["out"])))
        return let(x, lambda x: F.struct((s["rows"] - good).alias("rows"), (s["take"] - x).alias("take"),
                                         F.concat(s["out"], F.array(x)).alias("out")))
    return F.aggregate(sums, start, merge, lambda s: s["out"])


def communication_matrix(counts: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``counts`` (_hg_part, _hg_n), one row per non-empty partition, numbered from 0 ->
    (_hg_part, _hg_sends): the rows that the partition sends to each shard."""
    spark = counts.sparkSession
    top = counts.agg(F.max("_hg_part").alias("p"), F.sum("_hg_n").alias("n")).first()
    rows, depth = top.n or 0, max(top.p or 0, 0).bit_length()
    level = F.explode(F.sequence(F.lit(1), F.lit(depth))) if depth else F.explode(F.array().cast("array<int>"))
    # left halves of every level: their parents' numbers and rows
    halves = materialize(
        counts.select("_hg_part", "_hg_n", level.alias("_hg_level"))
        .withColumn("_hg_child", F.call_function("shiftright", F.col("_hg_part"), F.lit(depth) - F.col("_hg_level")))
        .where(F.col("_hg_child") % 2 == 0)
        .groupBy("_hg_level", F.shiftright("_hg_child", 1).alias("_hg_node")).agg(F.sum("_hg_n").alias("_hg_left")), "hg-halves")
    sizes = [rows // shards + (j < rows % shards) for j in range(shards)]
    nodes = spark.range(1 if rows else 0).select(
        F.col("id").alias("_hg_node"), F.lit(rows).cast("bigint").alias("_hg_rows"),
        F.array(*[F.lit(s).cast("bigint") for s in sizes]).alias("_hg_sums"))
    for at in range(1, depth + 1):
        split = (nodes.join(halves.where(F.col("_hg_level") == at).select("_hg_node", "_hg_left"), "_hg_node", "left")
                 .withColumn("_hg_left", F.coalesce("_hg_left", F.lit(0).cast("bigint")))
                 .withColumn("_hg_x", split_counts(F.col("_hg_sums"), F.col("_hg_left"), F.lit(seed), F.lit(at), F.col("_hg_node"))))
        halves_of = F.array(
            F.struct((F.col("_hg_node") * 2).alias("_hg_node"), F.col("_hg_left").alias("_hg_rows"), F.col("_hg_x").alias("_hg_sums")),
            F.struct((F.col("_hg_node") * 2 + 1).alias("_hg_node"), (F.col("_hg_rows") - F.col("_hg_left")).alias("_hg_rows"),
                     F.zip_with("_hg_sums", "_hg_x", lambda a, x: a - x).alias("_hg_sums")))
        nodes = split.select(F.inline(halves_of)).where(F.col("_hg_rows") > 0)
        if at == SPREAD_DEPTH:
            nodes = nodes.repartition(2 ** SPREAD_DEPTH, "_hg_node")
    return nodes.select(F.col("_hg_node").alias("_hg_part"), F.col("_hg_sums").alias("_hg_sends"))


def permuted_partitions(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``docs`` with _hg_part (the task that reads the row) and _hg_pos (its place in that
    task's random order), written to the shared folder."""
    placed = (docs.withColumn("_hg_key", F.xxhash64(F.lit(seed), F.lit("local"), F.monotonically_increasing_id()))
              .sortWithinPartitions("_hg_key").withColumn("_hg_at", F.monotonically_increasing_id())
              .withColumn("_hg_part", F.shiftright("_hg_at", 33))
              .withColumn("_hg_pos", F.col("_hg_at").bitwiseAND(F.lit(2 ** 33 - 1)))
              .drop("_hg_key", "_hg_at"))
    return materialize(placed, "hg-permuted")


def shuffle(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``docs`` with ``_hg_shard`` (0 to ``shards`` - 1) and ``_hg_slot`` (gapless from 0 in each
    shard): a uniformly random placement in which the shards' row counts differ by at most one."""
    placed = permuted_partitions(docs, seed)
    counts = materialize(placed.groupBy("_hg_part").agg(F.count(F.lit(1)).alias("_hg_n")), "hg-counts")
    matrix = communication_matrix(counts, shards, seed)
    ends = F.aggregate("_hg_sends", F.array().cast("array<bigint>"),
                       lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + x)))
    matrix = materialize(matrix.select("_hg_part", ends.alias("_hg_ends")), "hg-matrix")
    rows = counts.agg(F.sum("_hg_n")).first()[0] or 0
    cells = max(1, -(-rows // (shards * CELL_ROWS)))
    sent = (placed.join(matrix, "_hg_part")
            .withColumn("_hg_shard", F.size(F.filter("_hg_ends", lambda e: e <= F.col("_hg_pos"))))
            .withColumn("_hg_key", F.xxhash64(F.lit(seed), F.lit("slot"), "_hg_part", "_hg_pos"))
            .withColumn("_hg_cell", F.pmod(F.col("_hg_key"), F.lit(cells)))
            .drop("_hg_ends"))
    before = Window.partitionBy("_hg_shard").orderBy("_hg_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (sent.groupBy("_hg_shard", "_hg_cell").agg(F.count(F.lit(1)).alias("_hg_n"))
               .select("_hg_shard", "_hg_cell", F.coalesce(F.sum("_hg_n").over(before), F.lit(0)).alias("_hg_before")))
    inside = Window.partitionBy("_hg_shard", "_hg_cell").orderBy("_hg_key", "_hg_part", "_hg_pos")
    return (sent.withColumn("_hg_row", F.row_number().over(inside) - 1)
            .join(offsets, ["_hg_shard", "_hg_cell"])
            .withColumn("_hg_slot", (F.col("_hg_before") + F.col("_hg_row")).cast("bigint"))
            .select(*docs.columns, "_hg_shard", "_hg_slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """The shuffled rows as Parquet folders ``_hg_shard=0`` and so on, ordered by slot inside
    each file; a file holds one stretch of about ``CELL_ROWS`` slots."""
    out = shuffle(docs, shards, seed).withColumn("_hg_file", F.floor(F.col("_hg_slot") / CELL_ROWS))
    (out.repartition("_hg_shard", "_hg_file").sortWithinPartitions("_hg_shard", "_hg_slot").drop("_hg_file")
     .write.partitionBy("_hg_shard").parquet(path))
