import random
import re
from collections import Counter

import numpy as np

from tyscope.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_stats(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered))


def texts():
    rnd = random.Random(3)
    out = [None, "", " \n\t ", "one", "a b c a b c", "a a a a", "x\nx\n\n \n \nx y\nx y", "é ü#*$ 𝄞𝄞 <|> &%", "long " * 40000,
           "w" * 20000 + " b", "a\x85b c\x1cd \x0b e\x0cf"]
    for _ in range(60):
        out.append(rnd.choice([" ", "\n", "  "]).join(rnd.choice("abcdé#") * rnd.randrange(1, 3) for _ in range(rnd.randrange(90))))
    return out


def test_statistics_against_brute_force(spark):
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    got = Q.statistics(df).collect()
    want = [(d, *brute_stats(t)) for d, t in rows]
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(want, key=str)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)


def test_path_lengths_match_a_walk_of_the_trees():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3))
    forest = Q.grow(x, x.min(axis=0) - 1, x.max(axis=0) + 1, trees=20, sample=64)

    def path(row, t):
        node = 0
        while forest.feature[t][node] >= 0:
            node = forest.left[t][node] + int(row[forest.feature[t][node]] >= forest.value[t][node])
        return forest.value[t][node]

    probe = np.concatenate([x[:20], x[:3] + 9])
    want = [2 ** (-np.mean([path(r, t) for t in range(20)]) / forest.expected) for r in probe]
    assert np.allclose(forest.score(probe), want)
    assert forest.score(probe)[-3:].min() > forest.score(probe)[:-3].mean()


def test_calibrated_cut_respects_the_loss():
    """The middle of the equally good cuts."""
    counts = [(100, 1, 990), (300, 1, 10), (300, 0, 5), (400, 0, 50)]
    assert Q.calibrate(counts, 0.002) == 351 / Q.STEPS
    assert Q.calibrate(counts, 0.02) == 201 / Q.STEPS
    assert Q.calibrate([(1, 1, 5)]) == np.inf
    assert Q.calibrate([(5, 1, 5), (3, 0, 5)], 0.5) == np.inf


def test_ranks_of_the_good_rows():
    good = np.array([[0.0, x] for x in range(1001)])
    scale = Q.Scaler.of(good)
    z = scale(np.array([[0, 0], [0, 500], [0, 1000], [0.001, 1245], [-1, -10_000], [9, 490]]))
    assert np.allclose(z[:, 0], [0.5, 0.5, 0.5, 1.5, -0.5, 1.5])
    assert np.allclose(z[:, 1], [0, 0.5, 1, 1.5, -1, 0.49])


def test_verdict_on_the_table(spark):
    from tyscope.session import read_table
    sf = "/root/testdata/sf0.01"
    docs, labels = read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    rows = {r.doc_id: r for r in Q.judge(docs, labels).collect()}
    assert len(rows) == docs.count()
    assert rows == {r.doc_id: r for r in Q.judge(docs.repartition(7), labels.repartition(3)).collect()}
    quality = {r.doc_id: r.quality for r in labels.collect()}
    passed = [r for r in rows.values() if not r.base_failed]
    assert all(not r.kept for r in rows.values() if r.base_failed)
    good = [r.kept for r in passed if quality.get(r.doc_id) == 1]
    bad = [r.kept for r in passed if quality.get(r.doc_id) == 0]
    assert sum(good) >= 0.99 * len(good)
    assert sum(bad) <= 0.7 * len(bad)


def test_labelled_bad_rows_go_and_good_rows_stay(spark):
    from tyscope.session import read_table
    for sf, n_bad in (("/root/testdata/sf0.01", 27), ("/root/testdata/sf0.1", 291)):
        labels = read_table(spark, sf, "labels")
        rows = Q.judge(read_table(spark, sf, "documents"), labels).where("not base_failed").join(labels, "doc_id").collect()
        assert [sum(not r.kept for r in rows if r.quality == q) for q in (0, 1)] == [n_bad, 0]
        assert sum(r.quality == 0 for r in rows) == n_bad
        assert all(r.kept == (r.anomaly < 0.5) for r in rows)


def test_held_out_rows_are_judged_right(spark):
    """The half of the labelled rows that no tree has seen."""
    from tyscope.session import read_table
    for sf in ("/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        labels = read_table(spark, sf, "labels")
        rows = (Q.judge(read_table(spark, sf, "documents"), labels).where("not base_failed").join(labels, "doc_id")
                .where(~Q.in_growing_half("doc_id")).collect())
        bad, good = ([r.kept for r in rows if r.quality == q] for q in (0, 1))
        assert len(bad) > 10 and sum(bad) <= 0.05 * len(bad) and len(good) - sum(good) <= 0.01 * len(good)


def test_no_single_statistic_separates():
    """Good rows have two statistics in proportion, bad rows have not; each statistic alone is
    spread alike. The forest over all of them finds the bad rows among new ones."""
    for seed in (1, 2):
        rng = np.random.default_rng(seed)

        def rows(n, bad):
            a = rng.gamma(2.0, size=20 * n)
            b = rng.gamma(2.0, size=20 * n) if bad else a * np.exp(rng.normal(0, 0.15, 20 * n))
            keep = np.flatnonzero(np.abs(np.log(a / b)) > 1.2 if bad else a > 0)[:n]
            return np.stack([a[keep], b[keep], rng.random(n), rng.random(n)], axis=1)

        good, bad = rows(6400, False), rows(600, True)
        for i in range(4):
            cuts = np.quantile(bad[:, i], np.linspace(0, 1, 99))[:, None]
            assert max(np.abs((bad[:, i] > cuts).mean(axis=1) - (good[:, i] > cuts).mean(axis=1))) < 0.3
        scale = Q.Scaler.of(good[:4000])
        z = scale(np.concatenate([good[:4000], bad[:300]]))
        forest = Q.grow(scale(good[:4000]), z.min(axis=0), z.max(axis=0))
        good_steps, bad_steps = (np.floor(forest.score(scale(x)) * Q.STEPS) for x in (good[4000:], bad[300:]))
        cut = Q.calibrate([(int(s), 1, 1) for s in good_steps[:1200]] + [(int(s), 0, 1) for s in bad_steps[:150]], 0.01) * Q.STEPS - 0.5
        assert (bad_steps[150:] >= cut).mean() >= 0.93 and (good_steps[1200:] >= cut).mean() <= 0.015


def test_clashing_columns_long_texts_and_text_ids(spark):
    rows = [(f"d{i}", " ".join(f"w{i}x{j}" for j in range(60 + i)) + (" # # # # # $ $ $ $ $ $ $" if i % 5 == 0 else ""), 7, "k", True)
            for i in range(200)] + [("long", "word other " * 200_000, 1, "a", False), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, n_words int, anomaly string, kept boolean")
    labels = spark.createDataFrame([(f"d{i}", int(i % 5 > 0)) for i in range(200)], "doc_id string, quality int")
    got = {r.doc_id: r for r in Q.judge(docs, labels).collect()}
    assert len(got) == 202 and got["long"].n_words == 400_000 and got["long"].base_failed and not got[None].kept
    assert sum(got[f"d{i}"].kept == (i % 5 > 0) for i in range(200)) >= 196


def test_no_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "word " + " ".join(f"w{i}" for i in range(60))), (2, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(None, 1, 0), (5, None, 1)], "doc_id bigint, quality int, toxic int")
    assert {r.doc_id: r.kept for r in Q.judge(docs, labels).collect()} == {1: True, 2: False}
    assert Q.judge(docs.limit(0), labels.limit(0)).count() == 0
