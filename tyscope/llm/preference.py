"""Preference formatting of chosen and rejected conversations.

A conversation is the turns of one conv_id in the order of turn, and a pair is two
conversations with one pair id. The turns of both meet by position; the first position
at which they differ ends the common prefix, which is rendered once as prompt.
The turns after it are rendered as the two completions, with a mask of the characters
to learn from: the text and end mark of assistant turns.

The texts are shuffled once, by pair. The prefix is found by windows over sorted turns
(which spill), so no conversation is held as a list until its own output row is put
together.

Cases: rows without conv_id belong to no conversation; null turns come last, turns with
one number in the order of role and text, rows that repeat are turns of their own; a
null role or text is an empty string; equal conversations have empty completions; a
conversation without a counterpart is completed against none; an empty table gives an
empty result; columns other than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def positions(turns: DataFrame) -> DataFrame:
    """pair_id, pos (from 0), role and text of a conversation table."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first(),
                                                  F.col("text").asc_nulls_first())
    return turns.where("conv_id is not null").select(
        F.col("conv_id").alias("pair_id"), (F.row_number().over(order) - 1).alias("pos"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def format_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """pair_id, prompt_turns, prompt, chosen, rejected, chosen_mask and rejected_mask (spans
    ``start:end`` in characters of the completion, comma-joined) from two tables of
    ``positions`` columns."""
    rows = [t.select("pair_id", "pos", F.lit(side).alias("side"), "role", "text") for side, t in enumerate((chosen, rejected))]
    # dealt out by pair once; all that follows groups by the pair and more
    both = rows[0].union(rows[1]).repartition("pair_id")
    here, pair = Window.partitionBy("pair_id", "pos"), Window.partitionBy("pair_id")
    equal = ((F.count(F.lit(1)).over(here) == 2) & (F.min("role").over(here) == F.max("role").over(here))
             & (F.min("text").over(here) == F.max("text").over(here)))
    turns = (both.withColumn("equal", equal)
             .withColumn("prompt_turns", F.coalesce(F.min(F.when(~F.col("equal"), F.col("pos"))).over(pair),
                                                    F.max("pos").over(pair) + 1))
             .withColumn("part", F.when(F.col("pos") < F.col("prompt_turns"), "prompt").when(F.col("side") == 0, "chosen")
                         .otherwise("rejected"))
             .where((F.col("part") != "prompt") | (F.col("side") == 0)))
    head = F.concat(F.lit(START), "role", F.lit("\n"))
    before = Window.partitionBy("pair_id", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    shown = (turns.withColumn("shown", F.concat(head, "text", F.lit(END)))
             .withColumn("at", F.coalesce(F.sum(F.length("shown")).over(before), F.lit(0)))
             .withColumn("mask", F.when(F.col("role") == "assistant", F.concat(
                 (F.col("at") + F.length(head)).cast("string"), F.lit(":"), (F.col("at") + F.length("shown")).cast("string")))))

    def joined(value: str, part: str, by: str):
        rows = F.array_sort(F.collect_list(F.when((F.col("part") == part) & F.col(value).isNotNull(), F.struct("pos", value))))
        return F.array_join(F.transform(rows, lambda x: x[value]), by)

    return shown.groupBy("pair_id", "prompt_turns").agg(
        joined("shown", "prompt", "").alias("prompt"), joined("shown", "chosen", "").alias("chosen"),
        joined("shown", "rejected", "").alias("rejected"), joined("mask", "chosen", ",").alias("chosen_mask"),
        joined("mask", "rejected", ",").alias("rejected_mask"))


def weakened(turns: DataFrame) -> DataFrame:
    """A rejected counterpart of each conversation in ``positions`` columns: its last
    assistant turn breaks off after half of its characters, and what followed is gone."""
    pair = Window.partitionBy("pair_id")
    last = F.max(F.when(F.col("role") == "assistant", F.col("pos"))).over(pair)
    half = F.substring("text", F.lit(1), F.expr("length(text) div 2"))
    return (turns.withColumn("last", last).where(F.col("last").isNull() | (F.col("pos") <= F.col("last")))
            .select("pair_id", "pos", "role", F.when(F.col("pos") == F.col("last"), half).otherwise(F.col("text")).alias("text")))
