"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents (label 1) are the positives; all other text is unlabelled,
whatever its label. A linear classifier on words and word beginnings (present, and present
more than once: in a long text one of them may be chance) is trained with numpy on the non-negative risk estimate

    prior * mean_P loss(g, 1) + max(0, mean_U loss(g, 0) - prior * mean_P loss(g, 0))

with the logistic loss; where the second part is negative, the step goes against it.
The class prior is the share of label 1 among the labelled training rows.

The fit uses a bounded sample (``POSITIVES`` and ``UNLABELLED`` documents, whole texts);
its features are counted in Spark, and the ``FEATURES`` most telling ones make the
model, which is the only thing broadcast. Every document is scored over its whole text.

Rows whose crc32(doc_id as text) mod 4 is 2 are held out: neither labels nor text of
theirs are learned from. lang, source, doc_id and labels are no inputs of a score.

Cases: null and empty texts have no features and score the bias alone; a null doc_id is
not held out and not learned from; a doc_id labelled both ways counts as toxic, and one
with several texts lends one of them to the fit; without
positives every score is 0; an empty table gives an empty result; other columns are
kept, and helper columns carry the prefix ``_tox_``. ``doc_id`` is a whole number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tyscope.llm.common import ALNUM_SEP_TABLE, LOWER_TABLE, Words, mix64, text_runs
from tyscope.session import materialize, ship_package

POSITIVES = 4_000
UNLABELLED = 12_000
FEATURES = 4_096
MIN_PURITY = 0.65
RARE = 0.004
MIN_LLR = 8.0
THRESHOLD = 0.3
HELD_OUT = 2
BEGINNINGS = (4, 5, 6, 7)


#: The lowest bit of a feature: it occurs more than once in the text.
TWICE = np.uint64(1)


class Model(NamedTuple):
    features: np.ndarray  # sorted feature hashes
    weights: np.ndarray
    bias: float

    def score(self, feature: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """Scores of n texts from their (feature, row) pairs, repeats included."""
        g = np.full(n, self.bias)
        if len(self.features) and len(feature):
            plain = np.unique(self.features & ~TWICE)
            once, twice = np.zeros(len(plain)), np.zeros(len(plain))
            for weight, bit in ((once, 0), (twice, 1)):
                some = (self.features & TWICE) == bit
                weight[np.searchsorted(plain, self.features[some] & ~TWICE)] = self.weights[some]
            at = np.minimum(np.searchsorted(plain, feature), len(plain) - 1)
            hit = plain[at] == feature
            pair, count = np.unique(row[hit] * len(plain) + at[hit], return_counts=True)
            which = pair % len(plain)
            g += np.bincount(pair // len(plain), once[which] + twice[which] * (count > 1), n)
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(-g))


def text_features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature hash, text) of every word and of the first bytes of longer words."""
    words = Words(LOWER_TABLE[buf], offsets, ALNUM_SEP_TABLE)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(words.first))
    lens = words.ends - words.starts
    found, rows = [words.hashes()], [row]
    padded = np.concatenate([words.buf, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(words.buf) + 1,), np.dtype("<u8"), padded.data, strides=(1,))[words.starts]
    for n in BEGINNINGS:
        longer = lens > n
        found.append(mix64((eight[longer] & np.uint64((1 << 8 * n) - 1)) ^ np.uint64(n << 56)))
        rows.append(row[longer])
    return np.concatenate(found) & ~TWICE, np.concatenate(rows)


def held_out(doc_id: Column | str) -> Column:
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def _descend(sets, n_features: int, prior: float, decay: float, rare: float, steps: int, rate: float) -> np.ndarray:
    """Weights and, last, the bias that minimise the risk; ``rare`` see ``train``."""
    w = np.zeros(n_features + 1)
    w[-1] = math.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = [np.bincount(row, w[idx], n) + w[-1] for idx, row, n in sets]
        p = [1 / (1 + np.exp(-x)) for x in g]
        # loss(g, 0) = log(1 + e^g), its slope p; loss(g, 1) = log(1 + e^-g), its slope p - 1
        negative = np.logaddexp(0, g[1]).mean() - prior * np.logaddexp(0, g[0]).mean()
        if negative >= 0:
            slopes = [prior * (p[0] - 1) - prior * p[0], p[1]]
        else:
            slopes = [prior * p[0], -p[1]]
        grad = decay * w
        grad[-1] = 0
        for (idx, row, n), s in zip(sets, slopes):
            grad[:-1] += np.bincount(idx, s[row] / n, n_features)
            grad[-1] += s.mean()
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        scale = np.sqrt(v / (1 - 0.999 ** t)) + 1e-8
        w -= rate * (m / (1 - 0.9 ** t)) / scale
        w[:-1] = np.sign(w[:-1]) * np.maximum(0, np.abs(w[:-1]) - rate * rare * prior / scale[:-1])
    return w


def train(pos: list[np.ndarray], unl: list[np.ndarray], n_features: int, prior: float, prior_strength: float = 0.15,
          rare: float = RARE, steps: int = 600, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Weights and bias from the feature numbers of positive and unlabelled texts.

    Two descents. The first also pulls every weight to zero, by the slope that a feature of
    the share ``rare`` of the positives has: in long texts, many features of little weight
    would add up. The second fits what is left without that pull. In both, weights decay
    by ``prior_strength`` over the number of positives."""
    def flat(rows):
        return (np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64),
                np.repeat(np.arange(len(rows)), [len(r) for r in rows]), len(rows))

    sets = [flat(pos), flat(unl)]
    decay = prior_strength / max(1, len(pos))
    kept = np.flatnonzero(_descend(sets, n_features, prior, decay, rare, steps, rate)[:-1])
    number = np.full(n_features, -1)
    number[kept] = np.arange(len(kept))
    fewer = [(number[idx][number[idx] >= 0], row[number[idx] >= 0], n) for idx, row, n in sets]
    w = _descend(fewer, len(kept), prior, decay, 0.0, steps, rate)
    weights = np.zeros(n_features)
    weights[kept] = w[:-1]
    return weights, float(w[-1])


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, j, buf, off in text_runs(b.column("text")):
            feature, row = text_features(buf, off)
            order = np.lexsort((feature, row))
            feature, row = feature[order], row[order]
            new = np.concatenate([[True], (feature[1:] != feature[:-1]) | (row[1:] != row[:-1])]) if len(row) else row > 0
            second = np.flatnonzero(new[:-1] & ~new[1:]) + 1 if len(row) else row
            feature[second] |= TWICE
            new[second] = True
            feature, row = feature[new], row[new]
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(j - i + 1)).astype(np.int32)),
                                             pa.array(feature.view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c).slice(i, j - i) for c in ("doc_id", "_tox_p", "_tox_u")), lists],
                ["doc_id", "p", "u", "features"])


def _below(key: Column, share: float) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(5)), F.lit(1_000_003)) < math.ceil(min(1.0, share) * 1_000_003)


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED,
        n_features: int = FEATURES) -> Model:
    """The classifier from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic)."""
    ship_package(docs.sparkSession)
    known = (labels.where("doc_id is not null and toxic is not null").where(~held_out("doc_id"))
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    n_known, n_pos = known.agg(F.count(F.lit(1)), F.count_if(F.col("toxic") == 1)).first()
    if not n_pos:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -math.inf)
    prior = min(0.9, n_pos / n_known)
    open_docs = docs.where("doc_id is not null").where(~held_out("doc_id"))
    n_docs = open_docs.count()
    chosen = (known.where("toxic = 1").where(_below(F.col("doc_id"), positives / n_pos)).select("doc_id").limit(2 * positives)
              .withColumn("_tox_p", F.lit(True)))
    sample = (open_docs.select("doc_id", "text", _below(F.col("doc_id"), unlabelled / max(1, n_docs)).alias("_tox_u"))
              .join(F.broadcast(chosen), "doc_id", "left").withColumn("_tox_p", F.coalesce("_tox_p", F.lit(False)))
              .where("_tox_u or _tox_p"))
    # one text per doc_id, so that the sample is bounded even if one doc_id holds many rows,
    # and copies of a text once, so that its rare words do not pass for telling ones
    rows = sample.select("doc_id", "_tox_p", "_tox_u", "text").mapInArrow(
        _feature_batches, "doc_id bigint, p boolean, u boolean, features array<bigint>")
    first = F.min_by(F.struct("p", "u", "features"), F.xxhash64("features"))
    rows = rows.groupBy("doc_id").agg(first.alias("r")).select("r.*")
    rows = materialize(rows.groupBy(F.xxhash64("features").alias("h")).agg(
        F.max("p").alias("p"), F.max("u").alias("u"), F.first("features").alias("features")).drop("h"), "toxicity-sample")
    np_, nu = rows.agg(F.count_if("p"), F.count_if("u")).first()
    if not np_ or not nu:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -math.inf)
    # a feature is telling if the prior makes at least half of the texts that have it positive
    # (Bayes with the positives' and the unlabelled share) and chance does not explain it
    # (log-likelihood ratio of the positives' count against the count expected from the unlabelled)
    expected = (F.col("b") + 0.5) * np_ / nu
    counted = (rows.select("p", "u", F.explode("features").alias("f")).groupBy("f")
               .agg(F.count_if("p").alias("a"), F.count_if("u").alias("b")).where("a >= 3")
               .withColumn("purity", prior * F.col("a") / expected)
               .withColumn("llr", 2 * (F.col("a") * F.log(F.col("a") / expected) - (F.col("a") - expected))))
    top = (counted.where((F.col("purity") >= MIN_PURITY) & (F.col("llr") >= MIN_LLR))
           .orderBy(F.desc("llr"), "f").limit(n_features).select("f").collect())
    feats = np.sort(np.array([r.f for r in top], np.int64).view(np.uint64))
    held = docs.sparkSession.sparkContext.broadcast(feats)

    def numbered(batches):
        for b in batches:
            lists = b.column("features")
            flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            at = np.minimum(np.searchsorted(held.value, flat), max(0, len(held.value) - 1))
            hit = held.value[at] == flat if len(held.value) else np.zeros(len(flat), bool)
            out = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[hit], np.arange(len(lists) + 1)).astype(np.int32)),
                                           pa.array(at[hit].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column("p"), b.column("u"), out], ["p", "u", "at"])

    small = rows.mapInArrow(numbered, "p boolean, u boolean, at array<int>").collect()
    small.sort(key=lambda r: (r.p, r.u, r.at))  # the same sums whatever order the rows came in
    weights, bias = train([np.array(r.at, np.int64) for r in small if r.p], [np.array(r.at, np.int64) for r in small if r.u],
                          len(feats), prior)
    return Model(feats, weights, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with _tox_score."""
    ship_package(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            scores = []
            for i, j, buf, off in text_runs(b.column("text")):
                scores.append(held.value.score(*text_features(buf, off), j - i))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate([*scores, np.zeros(0)]))],
                                             [*b.schema.names, "_tox_score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("_tox_score", T.DoubleType())]))


def remove_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more."""
    model = fit(docs.select("doc_id", "text"), labels, **options)
    return score(docs, model).where(F.col("_tox_score") < threshold).select(*docs.columns)
