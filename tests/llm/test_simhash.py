import random

import numpy as np
import xxhash

from tyscope.llm import simhash as S


def brute_fingerprint(text):
    words = []
    for c in (text or ""):
        words.append(c.lower() if "A" <= c <= "Z" else c)
    words = [w for w in "".join(words).encode().split()]
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    counts = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if counts[b] * 2 > len(grams))


def brute_components(fps, bits):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprint_matches_definition():
    for t in ["", "A b", "a b c d", "One two\tTHREE four\nfive  six É é seven", "x " * 50, "w" * 9000]:
        assert S.fingerprint(t.encode()) == brute_fingerprint(t)


def test_golay_ball_lists_meet_at_distance_two():
    g = S.Golay()
    rng = np.random.default_rng(3)
    for x in rng.integers(0, 1 << 21, 60):
        a = {v for v in g.near(np.array([x]), 21)[0] if v >= 0}
        assert len(a) in (1, 6) or len(a) < 6
        for _ in range(30):
            y = int(x) ^ (1 << int(rng.integers(21))) ^ (1 << int(rng.integers(21)))
            assert a & {v for v in g.near(np.array([y]), 21)[0] if v >= 0}


def test_every_link_of_four_bits_shares_a_key():
    g = S.Golay()
    rnd = random.Random(1)
    for _ in range(300):
        x = rnd.getrandbits(64)
        y = x
        for b in rnd.sample(range(64), rnd.randint(1, 4)):
            y ^= 1 << b
        key, row = S.fuzzy_keys(np.array([x, y], np.uint64), g)
        assert set(key[row == 0]) & set(key[row == 1])


def test_spanning_links_keep_components():
    rnd = random.Random(5)
    centre = [rnd.getrandbits(64) for _ in range(8)]
    fps = []
    for c in centre:
        for _ in range(700):
            x = c
            for b in rnd.sample(range(64), rnd.randint(0, 5)):
                x ^= 1 << b
            fps.append(x)
    fps = np.unique(np.array(fps, np.uint64).view(np.int64))
    assert len(fps) > S.LARGE_GROUP

    def comps(edges):
        root = {int(f): int(f) for f in fps}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in edges:
            a, b = find(int(a)), find(int(b))
            root[max(a, b)] = min(a, b)
        return [find(int(f)) for f in fps]

    fast = comps(np.concatenate(S.spanning_links(fps, 4)))
    every = []
    for i in range(len(fps)):
        near = np.flatnonzero(np.bitwise_count((fps[i + 1:] ^ fps[i]).view(np.uint64)) <= 4)
        every += [(fps[i], fps[i + 1 + j]) for j in near]
    assert fast == comps(every)


def test_near_duplicates_against_brute_force(spark):
    from tyscope.session import read_table
    docs = read_table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    extra = [(None, None), (9001, ""), (9002, "  \n"), (9003, "a b c"), (9003, "a b c"), (None, "lone text here for once"),
             (9004, "Ab " * 30000)]
    docs = docs.union(spark.createDataFrame(extra, docs.schema))
    rows = docs.collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    comp = brute_components(fps, 4)
    want = []
    for i, r in enumerate(rows):
        ids = [rows[j].doc_id for j in range(len(rows)) if comp[j] == comp[i] and rows[j].doc_id is not None]
        want.append((str(r.doc_id), fps[i], min(ids) if ids else None))
    got = [(str(r.doc_id), r.fp & (2 ** 64 - 1), r.component_id) for r in S.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = S.keep_one(docs.withColumn("component", docs.doc_id), 4, 4)
    assert kept.columns == ["doc_id", "text", "component"]
    assert kept.count() == len(set(comp))


def test_copies_of_one_template_are_dealt_out(spark):
    rnd = np.random.default_rng(4)
    low = int(rnd.integers(1 << 43))
    fps = np.unique(rnd.integers(0, 1 << 21, 9000)) << 43 | low  # 43 bits in common
    distinct = spark.createDataFrame([(int(f),) for f in fps], "fp bigint").repartition(4)
    assert S.key_rows(distinct).groupBy("key").count().agg(S.F.max("count")).first()[0] < len(fps) / 8

    def comps(edges):
        root = {int(f): int(f) for f in fps}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in edges:
            a, b = find(int(a)), find(int(b))
            root[max(a, b)] = min(a, b)
        return [find(int(f)) for f in fps]

    links = [tuple(r) for r in S.links(distinct).collect()]
    assert all(bin((a ^ b) & (2 ** 64 - 1)).count("1") <= 4 for a, b in links)
    assert comps(links) == comps(np.concatenate(S._forest(fps, 4)))


def test_dealt_keys_keep_every_link():
    rnd = random.Random(2)
    hot = np.array([5, 7, 9 << 40], np.int64)
    for _ in range(300):
        x = rnd.getrandbits(64)
        y = x
        for b in rnd.sample(range(64), 4):
            y ^= 1 << b
        key, fp = S.dealt_keys(np.array([5, 5, 6, 9 << 40]), np.array([x, y, x, y], np.uint64).view(np.int64), hot)
        assert len(key) == 16 and set(key[fp.view(np.uint64) == x]) & set(key[fp.view(np.uint64) == y])


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert S.near_duplicates(docs).count() == 0
    assert S.keep_one(docs).columns == ["doc_id", "text", "lang"]
    assert S.keep_one(docs).count() == 0


def test_hot_keys_are_spread(spark):
    rows = spark.createDataFrame([(i, 7 if i % 2 else i) for i in range(4000)], "doc_id bigint, fp bigint")
    sizes = rows.groupBy("fp").agg(S.F.count(S.F.lit(1)).alias("n"))
    labels = rows.select("fp").distinct().withColumn("name", S.F.col("fp") * 10)
    joined = S.join_spread(rows, labels, "fp", S.F.col("doc_id"), sizes)
    assert sorted(map(tuple, joined.select("doc_id", "fp", "name").collect())) == [
        (i, 7 if i % 2 else i, 70 if i % 2 else 10 * i) for i in range(4000)]
    empty = S.join_spread(rows.limit(0), labels.limit(0), "fp", S.F.col("doc_id"), sizes.limit(0))
    assert empty.count() == 0
