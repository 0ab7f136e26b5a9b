from collections import Counter
from math import comb
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from tyscope.llm import queries as Q
from tyscope.llm import sharding as S


def big(x):
    return F.lit(x).cast("bigint")


@pytest.mark.parametrize("good,bad,draws", [(5, 7, 4), (60, 900, 130), (0, 5, 3), (5, 0, 3), (3, 4, 0), (3, 4, 7), (40, 3, 20), (1, 1, 1)])
def test_counts_are_drawn_exactly(spark, good, bad, draws):
    n = 8000
    u = (F.col("id") + 0.5) / n
    got = dict(tuple(r) for r in spark.range(n).select(S.hypergeometric(big(good), big(bad), big(draws), u).alias("x"))
               .groupBy("x").count().collect())
    for k in range(draws + 1):
        want = comb(good, k) * comb(bad, draws - k) / comb(good + bad, draws)
        assert abs(got.get(k, 0) / n - want) < 2 / n + 1e-9


def test_large_counts_have_the_right_moments(spark):
    n, good, bad, draws = 200, 10 ** 8, 15 * 10 ** 8, 10 ** 6
    x = [r.x for r in spark.range(n).select(
        S.hypergeometric(big(good), big(bad), big(draws), (F.col("id") + 0.5) / n).alias("x")).collect()]
    p = good / (good + bad)
    assert abs(sum(x) / n - draws * p) < 10
    assert (sum((v - draws * p) ** 2 for v in x) / n) ** 0.5 == pytest.approx((draws * p * (1 - p)) ** 0.5, rel=0.05)


def test_split_of_a_node_is_multivariate(spark):
    """Two halves of two rows over column sums (2, 1, 1): the six placements of C(4, 2), by counts."""
    sums = F.array(*[big(x) for x in (2, 1, 1)])
    n = 12_000
    got = Counter(tuple(r.x) for r in spark.range(n).select(S.split_counts(sums, big(2), F.lit(1), F.col("id")).alias("x")).collect())
    want = {(2, 0, 0): 1, (1, 1, 0): 2, (1, 0, 1): 2, (0, 1, 1): 1}
    assert set(got) == set(want)
    assert all(abs(got[k] / n - w / 6) < 0.02 for k, w in want.items())


@pytest.mark.parametrize("sizes", [{0: 100, 1: 3, 2: 900, 5: 41, 6: 1}, {0: 7}, {3: 5, 64: 1000, 65: 2}, {}])
def test_matrix_margins(spark, sizes):
    counts = spark.createDataFrame(list(sizes.items()), "_hg_part bigint, _hg_n bigint")
    got = {r._hg_part: r._hg_sends for r in S.communication_matrix(counts, 7).collect()}
    assert {p: sum(x) for p, x in got.items()} == sizes
    total = sum(sizes.values())
    assert [sum(x[j] for x in got.values()) for j in range(7)] == ([total // 7 + (j < total % 7) for j in range(7)] if sizes else [0] * 7)
    assert all(v >= 0 for x in got.values() for v in x)


def test_shuffle_of_odd_rows(spark):
    rows = [(i % 40 if i % 11 else None, "same" if i % 3 else None, "x", i) for i in range(1003)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, _slot string, seq int").repartition(7, "seq").sortWithinPartitions("seq")
    for cell_rows in (16_384, 10):
        S.CELL_ROWS, kept = cell_rows, S.CELL_ROWS
        try:
            got, again, other = (S.shuffle(docs, seed=s).collect() for s in (1, 1, 2))
        finally:
            S.CELL_ROWS = kept
        assert sorted(r.seq for r in got) == list(range(1003))
        per = Counter(r._hg_shard for r in got)
        assert set(per) == set(range(16)) and max(per.values()) - min(per.values()) <= 1
        for s in per:
            assert sorted(r._hg_slot for r in got if r._hg_shard == s) == list(range(per[s]))
        place = {r.seq: (r._hg_shard, r._hg_slot) for r in got}
        assert place == {r.seq: (r._hg_shard, r._hg_slot) for r in again}
        assert sum(place[r.seq] == (r._hg_shard, r._hg_slot) for r in other) < 20
        assert got[0].asDict().keys() == {"doc_id", "text", "_slot", "seq", "_hg_shard", "_hg_slot"}


def test_placements_are_uniform(spark):
    """Over many seeds every row meets every shard equally often, and pairs of neighbours as well."""
    docs = spark.range(0, 6, 1, 3)
    counts = spark.createDataFrame([(0, 2), (1, 2), (2, 2)], "_hg_part bigint, _hg_n bigint")
    seen = Counter()
    for seed in range(30):
        for r in S.communication_matrix(counts, 2, seed).collect():
            seen[r._hg_part, r._hg_sends[0]] += 1
    for p in range(3):  # 2 of 6 rows to a shard of 3: 0, 1, 2 with 1/5, 3/5, 1/5
        assert 9 <= seen[p, 1] <= 26 and seen[p, 0] + seen[p, 2] == 30 - seen[p, 1]
    assert sorted(r.id for r in S.shuffle(docs, 2).collect()) == list(range(6))


def test_few_rows_and_none(spark):
    docs = spark.createDataFrame([(1, None), (None, "")], "doc_id bigint, text string")
    got = S.shuffle(docs).collect()
    assert sorted(r._hg_shard for r in got) == [0, 1] and {r._hg_slot for r in got} == {0}
    assert S.shuffle(docs.limit(0)).count() == 0


def test_written_shards(spark, tmp):
    docs = spark.range(500).withColumn("text", F.concat(F.lit("t"), "id"))
    S.write_shards(docs, f"{tmp}/out", 4)
    back = spark.read.parquet(f"{tmp}/out")
    assert {r._hg_shard: r.n for r in back.groupBy("_hg_shard").agg(F.count("*").alias("n")).collect()} == {s: 125 for s in range(4)}
    assert sorted(r.text for r in back.collect()) == sorted(f"t{i}" for i in range(500))


def test_query_columns(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = Q.op13_uniform_shards(spark, sf)
    plan = out._jdf.queryExecution().toString()
    assert "ArrowEvalPython" not in plan and "MapIn" not in plan
    for r in out.collect():
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, crc32(raw), "rows", None)
