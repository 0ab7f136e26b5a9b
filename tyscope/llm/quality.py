"""Quality rules: an isolation forest on rule statistics.

One pass over the texts gives each document a row of counts, which is stored. A forest of
random splits over all statistics together is grown from a bounded sample of labelled rows
(``FIT_ROWS``): a node's box is cut at a random place of a random statistic, the good rows fill
the trees, and a row that few splits part from them is anomalous. Boxes span bad rows
too, so that a count which is the same in all good rows still parts rows that have it.
The anomaly is 2^(-mean path length / expected path length).

Statistics are scaled by the good rows' quantiles first: inside their range a value becomes
its rank from 0 to 1, so that no good row is rare for being far out on one scale; beyond
the range it moves away by its distance in units of the good rows' own tail, by 1 at most.

Half of the labelled rows (by a hash of doc_id) grow the forest and the other half, never seen
by it, calibrate one cut on the anomaly: of the cuts that lose at most ``MAX_LOSS`` of the
good rows, the one with the largest difference between bad and good rows found. The
anomaly that is returned is scaled so that the cut lies at 0.5.

Cases: a null or empty text has zero counts and fails the base rules; a doc_id labelled
both ways counts as good; without labelled rows nothing is judged anomalous; an empty
table gives an empty result; null ids and repeated rows are judged like any other; only
doc_id and text are read, so other columns cannot clash. ``doc_id`` may be of any type.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tyscope.llm.common import SPACE_TABLE, Words, mix64, text_runs
from tyscope.session import materialize, ship_package

SYMBOLS = b"#*$%&|<>"
FIT_ROWS = 20_000
TREES = 300
SAMPLE = 4096
KNOTS = 257
MAX_LOSS = 0.002
STEPS = 2000
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

_SYMBOL_TABLE = np.zeros(256, bool)
_SYMBOL_TABLE[list(SYMBOLS)] = True
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])


def repeated_words(words: Words) -> np.ndarray:
    """Per text, the words inside 3-word windows that occur twice or more in the text."""
    n = len(words.starts)
    if n < 3:
        return np.zeros(len(words.first) - 1, np.int64)
    h = words.hashes()
    row = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    at = np.flatnonzero(row[:-2] == row[2:])
    gram = mix64(h[at] * _ODD[0] + h[at + 1] * _ODD[1] + h[at + 2] * _ODD[2]) ^ mix64(row[at].astype(np.uint64) + _ODD[0])
    order = np.argsort(gram)
    same = gram[order[1:]] == gram[order[:-1]]
    twice = np.zeros(len(at) + 1, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(n, bool)
    found = at[twice[:-1]]
    for j in range(3):
        hit[found + j] = True
    return _per_text(hit, words.first)


def duplicate_lines(text: bytes) -> int:
    seen, n = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            n += 1
        elif line.split(None, 1):
            seen.add(line)
    return n


def _stat_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rest = [c for c in b.schema.names if c != "text"]
        for i, j, buf, off in text_runs(b.column("text")):
            words = Words(buf, off)
            chars = ((buf & 0xC0) != 0x80) & ~SPACE_TABLE[buf]
            data = buf.tobytes()
            lines = [duplicate_lines(data[off[k]:off[k + 1]]) for k in range(j - i)]
            stats = [np.diff(words.first), _per_text(chars, off), _per_text(_SYMBOL_TABLE[buf], off),
                     np.array(lines, np.int64), repeated_words(words)]
            yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i) for c in rest),
                                              *(pa.array(s.astype(np.int64)) for s in stats)], [*rest, *STATS])


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the five counts and base_failed of every row, stored."""
    ship_package(docs.sparkSession)
    rows = docs.select("doc_id", "text").mapInArrow(
        _stat_batches, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{s} bigint" for s in STATS))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return materialize(rows.withColumn("base_failed", failed), "rule-statistics")


FEATURES = STATS[1:]


def features(cols: dict[str, np.ndarray]) -> np.ndarray:
    """What the forest splits on: the counts per word, on a log scale. The size itself is
    left to the base rules, long texts are not anomalous."""
    n = np.maximum(cols["n_words"].astype(np.float64), 1)
    return np.stack([np.log1p(cols[s] / n) for s in FEATURES], axis=1)


class Scaler(NamedTuple):
    """Ranks among the good rows, per statistic."""

    knots: list[np.ndarray]  # distinct quantiles
    ranks: list[np.ndarray]
    tails: np.ndarray  # [statistic, (below, above)]

    @classmethod
    def of(cls, good: np.ndarray) -> Scaler:
        knots, ranks, tails = [], [], []
        level = np.linspace(0, 1, KNOTS)
        for x in good.T:
            q = np.quantile(x, level)
            value, first = np.unique(q, return_index=True)
            last = np.append(first[1:], len(q)) - 1
            knots.append(value)
            ranks.append((level[first] + level[last]) / 2)  # a value that many rows share: its middle rank
            low, mid, high = np.quantile(x, [0.01, 0.5, 0.99])
            tails.append([max(mid - low, 1e-9), max(high - mid, 1e-9)])
        return cls(knots, ranks, np.array(tails))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.empty_like(x)
        for i, (knots, ranks, (below, above)) in enumerate(zip(self.knots, self.ranks, self.tails)):
            v = x[:, i]
            out[:, i] = (np.interp(v, knots, ranks) - np.clip((knots[0] - v) / below, 0, 1)
                         + np.clip((v - knots[-1]) / above, 0, 1))
        return out


class Forest(NamedTuple):
    """Trees as arrays [tree, node]; feature -1 marks a leaf, whose value is its path length."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    expected: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, value, left in zip(self.feature, self.value, self.left):
            node = np.zeros(len(x), np.int64)
            todo = rows
            while len(todo):
                f = feature[node[todo]]
                todo, f = todo[f >= 0], f[f >= 0]
                at = node[todo]
                node[todo] = left[at] + (x[todo, f] >= value[at])
            total += value[node]
        return 2.0 ** (-total / len(self.feature) / self.expected)


def expected_path(n: int) -> float:
    """Mean path length of an unsuccessful search in a random tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grow(good: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int = TREES, sample: int = SAMPLE,
         seed: int = 7) -> Forest:
    """A forest over the good rows, its cuts drawn from the box between ``low`` and ``high``."""
    rng = np.random.default_rng(seed)
    sample = min(sample, len(good))
    deepest = max(1, math.ceil(math.log2(max(2, sample))))
    wide = np.flatnonzero(high > low)
    grown = []
    for _ in range(trees):
        feature, value, left = [-1], [0.0], [0]
        todo = [(0, good[rng.choice(len(good), sample, replace=False)], low, high, 0)]
        while todo:
            node, rows, lo, hi, depth = todo.pop()
            if depth >= deepest or len(rows) < 2 or not len(wide):
                value[node] = depth + expected_path(len(rows))
                continue
            f = int(rng.choice(wide))
            cut = rng.uniform(lo[f], hi[f])
            feature[node], value[node], left[node] = f, cut, len(feature)
            below = rows[:, f] < cut
            for part, side in ((below, hi), (~below, lo)):
                moved = side.copy()
                moved[f] = cut
                todo.append((len(feature), rows[part], *((lo, moved) if side is hi else (moved, hi)), depth + 1))
                feature.append(-1)
                value.append(0.0)
                left.append(0)
        grown.append((feature, value, left))
    width = max(len(f) for f, _, _ in grown)
    pad = [np.array([list(t[k]) + [0] * (width - len(t[k])) for t in grown]) for k in range(3)]
    return Forest(*pad, max(expected_path(sample), 1e-9))


def _sample(rows: DataFrame, n: int) -> DataFrame:
    """About ``n`` rows by the hash of doc_id, never more than 2n."""
    total = rows.count()
    part = min(1.0, n / max(1, total))
    return rows.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(1_000_003)) < math.ceil(part * 1_000_003)).limit(2 * n)


def calibrate(counts: list[tuple[int, int, int]], max_loss: float = MAX_LOSS) -> float:
    """The cut from (step of the score, good, n) counts: from it on a row is anomalous."""
    good = np.zeros(STEPS + 2)
    bad = np.zeros(STEPS + 2)
    for step, label, n in counts:
        (good if label else bad)[step] += n
    if not good.sum() or not bad.sum():
        return math.inf
    lost = (good.sum() - np.cumsum(good)) / good.sum()
    found = (bad.sum() - np.cumsum(bad)) / bad.sum()
    gain = np.where(lost <= max_loss, found - lost, -1)
    if gain.max() <= 0:
        return math.inf
    # the middle of the cuts that are equally good, away from the rows on either side
    best = np.flatnonzero(gain == gain.max())
    run = best[:np.argmax(np.append(np.diff(best) != 1, True)) + 1]
    return (int(run[len(run) // 2]) + 1) / STEPS


def in_growing_half(doc_id: str) -> Column:
    return F.pmod(F.xxhash64(F.col(doc_id).cast("string"), F.lit(23)), F.lit(2)) == 0


def judge(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, max_loss: float = MAX_LOSS) -> DataFrame:
    """doc_id, the counts, base_failed, anomaly (0 to 1, anomalous from 0.5 on) and kept of every row.

    ``labels`` has doc_id and quality (1 good, 0 bad)."""
    spark = docs.sparkSession
    stats = statistics(docs)
    labelled = stats.join(labels.where("quality is not null and doc_id is not null").groupBy("doc_id")
                          .agg(F.max("quality").alias("quality")), "doc_id").where("not base_failed")
    half = in_growing_half("doc_id")
    rows = _sample(labelled.where(half).select("doc_id", "quality", *STATS), fit_rows).toPandas().sort_values(["doc_id", "quality", *STATS])
    x = features({s: rows[s].to_numpy() for s in STATS})
    good = x[rows["quality"].to_numpy() == 1]
    if len(good) < 2:
        return stats.select("doc_id", *STATS, "base_failed", F.lit(0.0).alias("anomaly"), (~F.col("base_failed")).alias("kept"))
    scaler = Scaler.of(good)
    z = scaler(x)
    grown = spark.sparkContext.broadcast((scaler, grow(scaler(good), z.min(axis=0), z.max(axis=0))))

    def scores(b):
        scale, forest = grown.value
        return forest.score(scale(features({s: b.column(s).to_numpy(zero_copy_only=False) for s in STATS})))

    def steps_of(batches):
        for b in batches:
            steps = np.minimum(STEPS, np.floor(scores(b) * STEPS)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("quality"), pa.array(steps)], ["quality", "step"])

    kind = dict(labelled.dtypes)["quality"]
    counts = (labelled.where(~half).select("quality", *STATS).mapInArrow(steps_of, f"quality {kind}, step int")
              .groupBy("step", "quality").agg(F.count(F.lit(1)).alias("n")).collect())  # at most 2 x (STEPS + 1) rows
    cut = calibrate([(r.step, r.quality, r.n) for r in counts], max_loss)

    def verdict(batches):
        at = min(cut, 1.0)
        for b in batches:
            score = scores(b)
            anomalous = np.floor(score * STEPS) >= cut * STEPS - 0.5
            scaled = np.where(score < at, score / at / 2, 1 - (1 - score) / max(1 - at, 1e-9) / 2)
            anomaly = np.where(anomalous, np.maximum(scaled, 0.5), np.minimum(scaled, np.nextafter(0.5, 0)))
            failed = b.column("base_failed").to_numpy(zero_copy_only=False).astype(bool)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(anomaly), pa.array(~failed & ~anomalous)],
                                             [*b.schema.names, "anomaly", "kept"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stats.schema)
    return stats.mapInArrow(verdict, f"{kinds}, anomaly double, kept boolean").select("doc_id", *STATS, "base_failed", "anomaly", "kept")
