import hashlib
import random

from tyscope.llm import substring as S


def brute(rows, window=20):
    """rows: (doc_id, text); rows equal in both are one document; None sorts last."""
    docs = sorted({(d is None, d or 0, t or "") for d, t in rows})
    seen, out = set(), {}
    for none, d, t in docs:
        w = t.encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            g = tuple(w[i:i + window])
            if g in seen:
                gone[i:i + window] = [True] * window
            seen.add(g)
        kept = [x for x, y in zip(w, gone) if not y]
        out[none, d, t] = (len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return [(d, *out[d is None, d or 0, t or ""]) for d, t in rows]


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [tuple(r) for r in S.dedup_digest(df).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_automaton_gives_longest_earlier_match():
    rnd = random.Random(2)
    a, text = S.Automaton(), []
    for _ in range(6):
        seg = [bytes([97 + rnd.randrange(3)]) for _ in range(40)]
        got = a.add(seg)
        for i in range(len(seg)):
            best = 0
            for n in range(1, i + 2):
                gram = seg[i + 1 - n:i + 1]
                earlier = any(s[k:k + n] == gram for s in text for k in range(len(s) - n + 1))
                earlier = earlier or any(seg[k:k + n] == gram for k in range(i + 1 - n))
                best = n if earlier else best
            assert got[i] == best
        text.append(seg)
    probe = [bytes([97 + rnd.randrange(3)]) for _ in range(60)]
    got = a.match(probe)
    for i in range(len(probe)):
        best = max(n for n in range(i + 2) if n == 0 or any(
            s[k:k + n] == probe[i + 1 - n:i + 1] for s in text for k in range(len(s) - n + 1)))
        assert got[i] == best


def test_random_texts_with_shared_passages(spark):
    rnd = random.Random(4)
    word = lambda: rnd.choice(["a", "b", "é", "Ü1", "long-word-" * 3, "x.", "y", "z" * 12])
    passages = [[word() + str(rnd.randrange(50)) for _ in range(n)] for n in (19, 20, 21, 40, 90)]
    rows = []
    for d in range(60):
        w = []
        for _ in range(rnd.randrange(4)):
            w += [word() + str(rnd.randrange(500)) for _ in range(rnd.randrange(30))]
            p = rnd.choice(passages)
            k = rnd.randrange(len(p))
            w += p[k:] if rnd.random() < 0.5 else p
        rows.append((d * 3 % 61, rnd.choice([" ", "\n", " \t"]).join(w)))
    rows += [(100, "same " * 19), (101, "same " * 20), (102, "same " * 21), (103, "same " * 400), (104, None), (105, ""),
             (106, " \n\t"), (None, rows[5][1]), (None, "tail " + rows[6][1]), rows[7], rows[7], (7, rows[8][1] + " end"),
             (7, "start " + rows[8][1]), (107, "w" * 9000 + " " + rows[9][1]), (108, " ".join(str(i) for i in range(30000)))]
    check(spark, rows)


def test_periodic_text_inside_one_document(spark):
    block = [f"p{i}" for i in range(7)]
    check(spark, [(1, " ".join(block * 9)), (2, " ".join(f"q{i}" for i in range(25)) + " " + " ".join(f"q{i}" for i in range(25)))])


def test_whole_table_against_brute_force(spark):
    from tyscope.session import read_table
    df = read_table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    rows = [tuple(r) for r in df.collect()]
    got = [tuple(r) for r in S.dedup_digest(df).collect()]
    assert sorted(got) == sorted(brute(rows))


def test_large_shards_are_dealt_out(spark):
    base = [f"w{i}" for i in range(300)]
    rows = []
    for d in range(40):
        w = list(base)
        w[d * 7] = f"edit{d}"
        rows.append((d, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    prof = S.profile(df)
    want = rows_of(S.repeated_spans(df, prof))
    assert rows_of(S.repeated_spans(df, prof, shard_anchors=50)) == want
    assert rows_of(S.repeated_spans(df, prof, hot_anchor=7)) == want  # hot anchors dealt out by window
    check(spark, rows)


def rows_of(spans):
    out = {}
    for r in spans.collect():
        out[r._sub_id] = sorted({i for s in r.spans for i in range(s.start, s.start + s.n)})
    return out


def test_texts_keep_other_words_and_white_space(spark):
    p = " ".join(f"w{i}" for i in range(25))
    rows = [(1, f"one\n{p}\ntwo"), (2, f"three\n\n{p}\n four  five"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("spans", S.F.lit("x"))
    got = {r.doc_id: (r.text, r.spans) for r in S.remove_repeats(df).collect()}
    assert got == {1: (rows[0][1], "x"), 2: ("three\n\nfour  five", "x"), 3: (None, "x")}
    ref = spark.createDataFrame([(p,), (None,)], "text string")
    got = {r.doc_id: r.text for r in S.remove_against(df, ref, shard_words=22).collect()}
    assert got == {1: "one\ntwo", 2: "three\n\nfour  five", 3: None}


def test_against_a_reference_with_any_window(spark):
    rnd = random.Random(8)
    refs = [" ".join(rnd.choice("abcdefgh") * rnd.randrange(1, 4) for _ in range(400)) for _ in range(6)] * 2 + [None, "", "a b"]
    rows = [(None, None), (1, "")]
    for i in range(40):
        w = [rnd.choice("abcdefgh") * rnd.randrange(1, 4) for _ in range(150)]
        at, n = rnd.randrange(300), rnd.choice([2, 3, 19, 20, 60, 100])
        rows.append((i % 30, " ".join(w[:40] + refs[i % 6].split()[at:at + n] + w[40:])))
    rows += rows[2:4]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    ref = spark.createDataFrame([(r,) for r in refs], "text string").repartition(3)
    for window, more in ((2, {}), (3, {}), (20, {}), (50, {"shard_words": 100}), (20, {"shard_words": 100, "hot_anchor": 3})):
        grams = {tuple(w[i:i + window]) for w in ((r or "").split() for r in refs) for i in range(len(w) - window + 1)}
        want = []
        for d, t in rows:
            w = (t or "").split()
            gone = {i + k for i in range(len(w) - window + 1) if tuple(w[i:i + window]) in grams for k in range(window)}
            want.append((d, None if t is None else [x for i, x in enumerate(w) if i not in gone]))
        got = [(r.doc_id, None if r.text is None else r.text.split()) for r in S.remove_against(df, ref, window, **more).collect()]
        assert sorted(got, key=str) == sorted(want, key=str), window
    empty = ref.limit(0)
    assert S.remove_against(df, empty).count() == len(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert S.dedup_digest(df).count() == 0
    assert S.remove_repeats(df).count() == 0


def test_segments_of_a_large_group_grow_in_proportion(spark):
    """A hot passage in 500 and in 4,000 documents: eight times the rows, and no row per window."""
    import random
    rnd = random.Random(9)
    passage = [f"w{rnd.randrange(900)}" for _ in range(300)]
    made = {}
    for n in (500, 4000):
        rows = []
        for i in range(n):
            w = list(passage)
            w[rnd.randrange(300)] = f"e{i}"
            rows.append((i, " ".join(w)))
        df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
        made[n] = S.routed_segments(df, S.profile(df), hot_anchor=100).count()
    assert made[4000] <= 10 * made[500] and made[4000] < 4000 * 30, made


def test_merged_places():
    assert S.merged_places([(1, 2, 30, 5), (1, 2, 0, 20), (1, 2, 20, 9), (1, 3, 29, 4), (1, 2, 3, 4)]) == [
        (1, 2, 0, 29), (1, 2, 30, 5), (1, 3, 29, 4)]
