import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tyscope.llm import collocation as C
from tyscope.session import shuffle_files_let_go

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, max_words=3, min_count=10, top=2000):
    f, n = {}, Counter()
    for text, lang in rows:
        c = f.setdefault(lang or "und" if lang is None else lang, Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n["und" if lang is None else lang] += len(w)
            for k in range(1, max_words + 1):
                c.update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= min_count}
        covered = {q[i:i + k] for q, b in cand.items() for k in range(2, len(q)) for i in range(len(q) - k + 1)
                   if 100 * b >= 50 * c[q[i:i + k]]}
        scored = []
        for p, a in cand.items():
            if p not in covered:
                s, k = min((10 ** 6 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def texts(seed=1, n=400):
    rnd = random.Random(seed)
    words = ["the", "The", "of", "New", "york", "city", "a", "\u00c9t\u00e9", "\u00e9t\u00e9", "x\u00a0y", "w" * 300]
    seps = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "; "]
    made = ["".join(rnd.choice(words) + rnd.choice(seps) for _ in range(rnd.randrange(40))) for _ in range(n)]
    langs = ["en", "en", "en", "fr", None, "und", ""]
    return [(t, langs[i % 7]) for i, t in enumerate(made)] + [(None, "en"), ("", None), (" .,;", "de"), ("of the city " * 5000, "en"),
                                                              (made[0], "en"), (made[0], "en"), (None, None)]


@pytest.mark.parametrize("options", [{}, {"broadcast_hashes": -1}, {"partition_bytes": 3000}, {"max_words": 4, "min_count": 3}, {"top": 5}])
def test_against_brute_force(spark, options):
    rows = texts()
    df = spark.createDataFrame([(*r, 1, "p", 2) for r in rows], "text string, lang string, a int, phrase string, n int").repartition(3)
    got = sorted(tuple(r) for r in C.collocations(df, **options).select(*COLUMNS).collect())
    want = brute(rows, **{k: v for k, v in options.items() if k in ("max_words", "min_count", "top")})
    assert got == want and want


def test_empty_tables(spark):
    df = spark.createDataFrame([], "text string, lang string")
    assert C.collocations(df).count() == 0
    assert C.collocations(spark.createDataFrame([(None, None), ("", "en")], "text string, lang string")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40), min_size=1, max_size=60), min_size=1, max_size=12), st.integers(2, 9))
def test_summaries_keep_what_is_frequent(runs, threshold):
    """Merged in two halves and together: every item at the threshold survives, none is overestimated,
    and what was taken stays below threshold / SPARE."""
    mass = sum(map(len, runs))
    truth = Counter(x for r in runs for x in r)
    capacity = mass // threshold + 1

    def summary(part):
        s = C.Summary(capacity)
        for r in part:
            s.add(*(np.array(x) for x in np.unique(np.array(r, np.uint32), return_counts=True)))
        s.settle()
        return s
    halves = [summary(runs[::2]), summary(runs[1::2])]
    both = C.Summary(capacity)
    for h in halves:
        both.add(h.items, h.counts, h.taken)
    both.settle()
    left = dict(zip(both.items.tolist(), both.counts.tolist()))
    assert len(left) <= capacity and both.taken < threshold
    for x, n in truth.items():
        assert left.get(x, 0) <= n <= left.get(x, 0) + both.taken
        assert n < threshold or x in left


def test_counts_pack():
    low = np.sort(np.random.default_rng(1).integers(0, 2 ** 32, 50, dtype=np.uint32))
    for counts in (np.arange(1, 51), np.arange(1, 51) * 10 ** 6):
        a, b = C.unpack_counts(C.pack_counts(low, counts), 50)
        assert np.array_equal(a, low) and np.array_equal(b, counts)


def test_stretches_lose_no_phrase(monkeypatch):
    """A text that is counted in pieces of a few words gives the same n-grams."""
    text = "a b c. d e f g h, i j a b c d e\nf " * 9
    whole = Counter()
    for size in (1 << 20, 5, 1):
        monkeypatch.setattr(C, "CHUNK_WORDS", size)
        got = Counter()
        for s in C.stretches(pa.array([text, None, "a b", ""]), 3):
            for g in s.grams("en", 3):
                for p, n in zip(s.phrases(g.at, g.n).to_pylist(), g.count.tolist()):
                    got[p] += n
        whole = whole or got
        assert got == whole and got["a b"] == 19 and got["c d e"] == 9 and "c d" in got and "h i" not in got


def shuffled_bytes(df):
    """What the exchanges of a query write, run once."""
    df.collect()

    def walk(plan):
        name = plan.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(plan.executedPlan())
        if "QueryStage" in name:
            return walk(plan.plan())
        own = plan.metrics().get("shuffleBytesWritten").get().value() if name == "Exchange" else 0
        return own + sum(walk(plan.children().apply(i)) for i in range(plan.children().size()))
    return walk(df._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize("hashes", [100, C.FILTER_BYTES // 8])
def test_rare_phrases_do_not_travel(spark, monkeypatch, tmp, hashes):
    """Above the number of hashes that is broadcast as well as below, the second pass sends the
    n-grams that survived, not all n-grams of the texts."""
    rnd, real, sent = random.Random(3), C.materialize, {}
    often = [" ".join(f"w{rnd.randrange(60)}" for _ in range(12)) for _ in range(30)]
    rows = [(f"{often[i % 30]}. " + " ".join(f"r{rnd.randrange(10 ** 12)}" for _ in range(60)), "en") for i in range(600)]

    def measured(df, name):
        sent[name] = shuffled_bytes(df)
        return real(df, name)
    monkeypatch.setattr(C, "materialize", measured)
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")  # as for tables that are too large for it
    spark.createDataFrame(rows, "text string, lang string").repartition(2).write.parquet(f"{tmp}/docs")
    df = spark.read.parquet(f"{tmp}/docs")
    try:
        got = sorted(tuple(r) for r in C.collocations(df, broadcast_hashes=hashes).select(*COLUMNS).collect())
    finally:
        spark.conf.set(key, before)
    assert got == brute(rows) and len(got) > 100
    assert 0 < sent["phrase-counts"] < sum(len(t) for t, _ in rows) / 10


def test_shuffle_files_are_let_go(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    with shuffle_files_let_go(spark):
        assert spark.conf.get(key) == "true"
    assert spark.conf.get(key) == before


def test_filter_holds_every_survivor():
    rnd = np.random.default_rng(2)
    parts = 5
    keys = np.unique(rnd.integers(0, parts, 20_000) << 32 | rnd.integers(0, 2 ** 32, 20_000))
    others = np.setdiff1d(rnd.integers(0, parts, 20_000) << 32 | rnd.integers(0, 2 ** 32, 20_000), keys)
    for max_bytes, most in ((1 << 20, 0.01), (10_000, 0.4), (-8, 1)):
        f = C.Filter(parts, len(keys), max_bytes)
        f.table = np.frombuffer(b"".join(f.segment(keys[keys >> 32 == p]) for p in range(parts)), np.uint8)
        assert len(f.table) <= max(max_bytes, 8 * parts)
        assert np.array_equal(f.positions(keys), np.arange(len(keys))) and len(f.positions(others)) <= most * len(others)
    empty = C.Filter(parts, 0, 1 << 20)
    empty.table = np.frombuffer(b"".join(empty.segment(keys[:0]) for _ in range(parts)), np.uint8)
    assert len(empty.positions(keys)) == 0


def test_grams_pack():
    for counts in ([3, 1, 255], [3, 10 ** 12, 1]):
        phrases = pa.array(["été x", "", "w" * 300])
        groups, back, a = C.unpack_grams(*C.pack_grams([("en", 2, 1), ("ü\"", 0, 2)], phrases, np.array(counts))[::-1])
        assert groups == [["en", 2, 1], ["ü\"", 0, 2]] and back.equals(phrases) and a.tolist() == counts
    groups, back, a = C.unpack_grams(*C.pack_grams([("", 0, 1)], pa.array(["", "a"])[:1], np.array([0]))[::-1])
    assert back.to_pylist() == [""] and a.tolist() == [0]


def test_tally_adds_up_by_words(spark):
    t = C.Tally("group")
    for words in (["a b", "c"], ["c", "a b", "d"]):
        t.add(pa.array(words), np.arange(len(words)) + 1, group=np.array([t.group("en", len(w.split())) for w in words]))
    t.settle()
    t.add(pa.array(["c"]), np.array([5]), group=np.array([t.group("fr", 1)]))
    names, whole = list(t.groups), t.take().to_pylist()
    assert {(names[r["group"]], r["phrase"]): r["a"] for r in whole} == {(("en", 2), "a b"): 3, (("en", 1), "c"): 3, (("en", 1), "d"): 3, (("fr", 1), "c"): 5}
    assert len(whole) == 4 and not t.rows


@pytest.mark.parametrize("grams", [1, 5000])
def test_small_sendings_and_heavy_parts(spark, monkeypatch, grams):
    """Blocks of a few n-grams, and parts that are copied for each salt or for none, give the same phrases."""
    rows = texts(5, 150)
    monkeypatch.setattr(C, "SEND_GRAMS", grams)
    for one_in in (1, 10 ** 9):
        monkeypatch.setattr(C, "HEAVY_ONE_IN", one_in)
        df = spark.createDataFrame(rows, "text string, lang string").repartition(2)
        assert sorted(tuple(r) for r in C.collocations(df).select(*COLUMNS).collect()) == brute(rows)
