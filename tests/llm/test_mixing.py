import random
from collections import defaultdict

import pytest

from tyscope.llm import mixing as M


def targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in fixed]
        level = (total - sum(cap * sizes[s] for s in fixed)) / max(1, sum(w[s] for s in free))
        over = [s for s in free if level * w[s] > cap * sizes[s]]
        if not over:
            return {s: cap * sizes[s] if s in fixed else level * w[s] for s in names}
        fixed |= set(over)


def rows(seed=3):
    rnd = random.Random(seed)
    out = []
    for i in range(1500):
        source = rnd.choice(["a"] * 30 + ["b", "c", "é", "", None, "z", "tiny"] * 2)
        out.append((i if i % 70 else None, " ".join(["w"] * min(900, int(rnd.paretovariate(1.1) * 10))) if i % 41 else None, source))
    return out + [out[5], out[5], (9, "", "empty")]


def test_targets_and_copies(spark):
    data = rows()
    df = spark.createDataFrame(data, "doc_id bigint, text string, source string")
    got = M.plan_mix(df.withColumn("size", M.F.lit("x")).repartition(7)).collect()
    assert len(got) == len(data)
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, t, s in data:
        sizes[s] += len((t or "").split())
    want = targets(sizes)
    for r in got:
        assert r._mix_size == len((r.text or "").split()) and r.size == "x"
        assert r._mix_source_size == sizes[r.source]
        assert r._mix_target == pytest.approx(want[r.source])
        assert 0 <= r._mix_copies <= 3
        taken[r.source] += r._mix_copies * r._mix_size
    for s, t in want.items():
        assert abs(taken[s] - t) <= 900 * 1.2
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    again = M.plan_mix(df).collect()
    assert sorted(map(str, (tuple(r[k] for k in ("doc_id", "text", "source", "_mix_copies")) for r in got))) == \
        sorted(map(str, (tuple(r[k] for k in ("doc_id", "text", "source", "_mix_copies")) for r in again)))
    out = M.emit(df)
    assert out.columns == ["doc_id", "text", "source", "copy"]
    assert out.count() == sum(r._mix_copies for r in again)


def test_caps_are_shared_again(spark):
    sizes = {"a": 10, "b": 1000, "c": 1000, "d": 5, None: 0}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r.source: r.target for r in M.source_targets(df).collect()}
    assert got == pytest.approx(targets(sizes))
    assert got["a"] == 30 and got["d"] == 15 and got[None] == 0


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert M.plan_mix(df).count() == 0 and M.emit(df).count() == 0
    df = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id bigint, text string, source string")
    assert [r._mix_target for r in M.plan_mix(df).collect()] == [0.0, 0.0]
