import hashlib
import random
import re

import numpy as np

from tyscope.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")))


def brute(docs, items, window=10):
    grams = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1) if n else ():
            grams.setdefault(tuple(w[k:k + n]), set()).add("" if i is None else str(i))
    sizes = {len(g) for g in grams}
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (own := grams.get(tuple(w[k:k + n]))):
                    hit.update(range(k, k + n))
                    found |= own
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(1)
    for vocabulary in (2, 9, 5000):
        s = rng.integers(0, vocabulary, 400)
        s[-1] = 0
        packed = D.Packed(s, int(vocabulary).bit_length())
        sa = D.suffix_array(s, packed, 400)
        ends = [next(j for j in range(p, 400) if s[j] == 0) for p in sa]
        suffixes = [tuple(s[p:e]) for p, e in zip(sa, ends)]
        assert suffixes == sorted(suffixes)
        assert sorted(sa) == list(np.flatnonzero(s))


def cases(rnd):
    word = lambda: rnd.choice(["a", "b", "É", "x1", "The"]) + str(rnd.randrange(4))
    items = [(i, " ".join(word() for _ in range(rnd.choice([3, 9, 10, 11, 30])))) for i in range(25)]
    items += [(30, None), (31, "?!"), (3, "other text of the same item " * 3), (None, "an item without any id but with twelve words in it right here")]
    docs = []
    for d in range(80):
        parts = []
        for _ in range(rnd.randrange(4)):
            parts += [word() for _ in range(rnd.randrange(20))]
            w = words(rnd.choice(items)[1])
            k = rnd.randrange(len(w) + 1)
            parts += w[k:k + rnd.choice([5, 10, 12, 40])]
        docs.append((d, rnd.choice([" ", "--", "\n", "*** "]).join(parts).upper()))
    docs += [(None, None), (100, ""), (101, "..."), (5, docs[6][1]), (5, docs[6][1]), (102, " ".join(["a0 b1 The2"] * 20000)),
             (103, "x" * 10000 + " " + items[-1][1])]
    return docs, items


def test_against_brute_force(spark):
    rnd = random.Random(8)
    docs, items = cases(rnd)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id bigint, text string").coalesce(1)
    want = sorted(brute(docs, items), key=str)
    assert sorted((tuple(r) for r in D.contamination(df, bench).collect()), key=str) == want
    # small shards and blocks change nothing
    assert sorted((tuple(r) for r in D.contamination(df, bench, block_bytes=200, shard_bytes=300).collect()), key=str) == want
    kept = D.remove_contaminated(df.withColumn("hits", df.doc_id), bench)
    assert kept.columns == ["doc_id", "text", "hits"]
    assert kept.count() == sum(not r[-1] for r in want)


def test_longest_matches(spark):
    docs, items = cases(random.Random(9))
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(2)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.item_id, r.item_word): r for r in D.longest_matches(df, bench, 5).collect()}
    texts = [(d, words(t)) for d, t in docs]
    by_id = {}
    for i, t in items:
        by_id.setdefault("" if i is None else str(i), []).append(words(t))
    for i, lists in by_id.items():
        if len(lists) > 1:
            continue
        w = lists[0]
        for k in range(len(w)):
            best = 0
            while best < len(w) - k and any(tuple(w[k:k + best + 1]) == tuple(x[p:p + best + 1])
                                            for _, x in texts if len(x) < 5000 for p in range(len(x))):
                best += 1
            if best >= 5 and "the2" not in w:
                r = got[i, k]
                assert r.n_words >= best
                place = [x for d, x in texts if d == r.doc_id]
                assert any(x[r.doc_word:r.doc_word + r.n_words] == w[k:k + r.n_words] for x in place)


def test_whole_table(spark):
    from tyscope.session import read_table
    sf = "/root/testdata/sf0.01"
    df, bench = read_table(spark, sf, "documents").select("doc_id", "text"), read_table(spark, sf, "benchmark")
    want = brute([tuple(r) for r in df.collect()], [tuple(r) for r in bench.select("item_id", "text").collect()])
    assert sorted(tuple(r) for r in D.contamination(df, bench).collect()) == sorted(want)
    assert any(r[-1] for r in want)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    some = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert D.contamination(none, bench).count() == 0
    assert [tuple(r)[:4] for r in D.contamination(some, bench).collect()] == [(1, 3, 0, 0)]
    assert D.longest_matches(some, bench).count() == 0


def test_one_python_operator_for_any_number_of_blocks(spark):
    docs, items = cases(random.Random(10))
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(2)
    bench = spark.createDataFrame(items * 3, "item_id bigint, text string").repartition(4)
    blocks = D.write_blocks(bench, 100)
    read = [b for b in map(blocks.read, range(blocks.count)) if b is not None]
    assert len(read) > 10
    assert sorted(i for b in read for i in b.ids) == sorted("" if i is None else str(i) for i, _ in set(items))
    assert blocks.longest == max(len(words(t)) for _, t in items)
    plan = D.with_hits(df, bench, block_bytes=100)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan.split("MapInArrow")[0] and "Broadcast" not in plan


def test_rounds_keep_the_last_block(spark):
    bench = spark.createDataFrame([(i, f"w{i} some words") for i in range(40)], "item_id bigint, text string")
    blocks = D.write_blocks(bench, 200)
    reads = []
    real = blocks.read
    blocks.read = lambda k: reads.append(k) or real(k)
    rounds = blocks.rounds()
    for _ in range(3):
        assert sorted(i for b in next(rounds) for i in b.ids) == sorted(map(str, range(40)))
    n = blocks.count
    assert n > 2 and reads == [*range(n), *range(n - 1)[::-1], *range(1, n)]
