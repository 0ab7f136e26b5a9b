import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tyscope.llm import alignment as A


@pytest.fixture(scope="module")
def pair():
    return A.load_pair((open(A.A_FILE, "rb").read(), open(A.B_FILE, "rb").read()))


def brute(pair, rows):
    """Every row's result and the pairs' counts, token by token with the JSON's tokenizer."""
    letters = A.byte_of_letter()
    size = pair.a.get_vocab_size()
    a_bytes = [b"" if i == 50256 else bytes(letters[c] for c in pair.a.id_to_token(i)) for i in range(size)]
    b_bytes = []
    for i in range(pair.b.get_piece_size()):
        p = pair.b.id_to_piece(i)
        b_bytes.append(bytes([int(p[3:5], 16)]) if p.startswith("<0x") else p.replace("\u2581", " ").encode())
    count, docs, found = collections.Counter(), collections.Counter(), []
    for doc_id, text in rows:
        groups, links, a, b = [], [], [], []
        if text:
            a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
            want = (" " + text).encode()
            if b"".join(a_bytes[i] for i in a) != want or b"".join(b_bytes[i] for i in b) != want:
                a, b = [], []
            ends = []
            for ids, table in ((a, a_bytes), (b, b_bytes)):
                at, place = 0, {}
                for k, i in enumerate(ids):
                    at += len(table[i])
                    place[at] = k
                ends.append(place)
            from_a = from_b = 0
            for cut in sorted(set(ends[0]) & set(ends[1])):
                ka, kb = ends[0][cut], ends[1][cut]
                groups.append(",".join(map(str, a[from_a:ka + 1])) + "|" + ",".join(map(str, b[from_b:kb + 1])))
                links.append((a[ka], b[kb]))
                from_a, from_b = ka + 1, kb + 1
        count.update(links)
        docs.update(set(links))
        found.append((doc_id, len(a), len(b), groups, links))
    best = collections.Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return [(d, n_a, n_b, len(g), len(x), sum(count[p] == best[p[1]] for p in x), sum(count[p] for p in x),
             hashlib.sha256(";".join(g).encode()).hexdigest() if g else "", ";".join(g)) for d, n_a, n_b, g, x in found], count, docs, best


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]
ODD = ["", None, " ", "  two  spaces ", "a", "<|endoftext|> </s> <s> <unk>", "caf\u00e9 \u00fcber na\u00efve", "\u65e5\u672c\u8a9e \u0420\u0443\u0441 \U0001f600\U0001f468\u200d\U0001f469",
       "tab\tand\nnew\r\nlines\n\n", "x" * 5000, "ab " * 9000, "\u2581 piece mark", "\u00a0\u2003spaces", "don't we'll 12345 !!!", "\x00\x01 control", "fi \ufb01 \u2460"]


def test_odd_rows_against_brute_force(spark, pair):
    rows = [(str(i), t) for i, t in enumerate(ODD)] + [("4", "a"), (None, "same words"), (None, "same words"), (None, None)]
    docs = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id string, text string, pair int, block string").repartition(3)
    got = A.align(docs, keep_groups=True)
    want, count, docs_of, best = brute(pair, rows)
    assert sorted(map(str, (tuple(r[c] for c in COLUMNS) for r in got.collect()))) == sorted(map(str, want))
    assert sum(w[1] == 0 for w in want) >= 4  # null, empty and what a tokenizer rewrites
    table = {(r.a_id, r.b_id): (r.n_docs, r.n_links, r.is_best) for r in A.alignment_table(docs).collect()}
    assert table == {p: (docs_of[p], n, n == best[p[1]]) for p, n in count.items()}


def test_whole_table_against_brute_force(spark, pair):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want, *_ = brute(pair, [(r.doc_id, r.text) for r in docs.collect()])
    got = A.align(docs.repartition(5)).select(*COLUMNS[:-1])
    assert sorted(tuple(r) for r in got.collect()) == sorted(w[:-1] for w in want)


def test_empty_table(spark):
    assert A.align(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_ranks_give_the_ids_of_the_file(pair):
    rnd = random.Random(5)
    alphabets = ["ab c'stre.,12\n\t ", "".join(map(chr, range(1, 0x250))), "\u00e9\u00e8 \u00fc\u0153\u0160\u00a0\u0085\u00b2\u00bd"]
    texts = [" " + "".join(rnd.choice(a) for _ in range(rnd.randrange(1, 200))) for a in alphabets for _ in range(300)]
    assert pair.ranks is not None
    assert [pair.ranks.encode_ordinary(t) for t in texts] == [pair.a.encode(t, add_special_tokens=False).ids for t in texts]
    assert A._ABOVE.search("\u0250") and not A._ABOVE.search("\u024f")


def test_containers_round_trip():
    rnd = np.random.default_rng(2)
    sets = [np.unique(rnd.integers(0, A.BLOCK_DOCS, n)) for n in (1, 2, 4095, 70_000, 9, 3 * A.BLOCK_DOCS)]
    sets.insert(2, np.arange(A.DENSE_FROM))
    sets.append(np.arange(A.DENSE_FROM - 1))
    for some in (sets, [s for s in sets if len(s) < A.DENSE_FROM], sets[3:4], []):
        key = np.repeat(np.arange(len(some)) * 3, [len(s) for s in some])
        doc = np.concatenate([*some, np.zeros(0, np.int64)])
        keys, col = A.encode_containers(key, doc)
        assert keys.tolist() == [3 * i for i in range(len(some))]
        assert all(len(c.as_py()) == (A.DENSE_BYTES if len(s) >= A.DENSE_FROM else 2 * len(s)) for c, s in zip(col, some))
        row, back = A.decode_containers(col)
        assert np.array_equal(row * 3, key) and np.array_equal(back, doc)
        row, back = A.decode_containers(col.slice(1))
        assert np.array_equal(back, doc[len(some[0]):] if some else doc)


def test_planes_hold_multiplicities():
    links = [(7, 1)] * 6 + [(7, 2)] + [(9, 0)] * 5 + [(1 << 40, 3)] * 2
    pair, doc = (np.array(x, np.int64) for x in zip(*random.Random(1).sample(links, len(links))))
    got, total = collections.Counter(), collections.Counter()
    for plane, keys, bitmaps in A.planes_of(pair, doc):
        row, d = A.decode_containers(bitmaps)
        for r, x in zip(row, d):
            got[int(keys[r]), int(x)] += int(A.plane_weight(np.array([plane]))[0])
    total.update(links)
    assert got == total


def test_partial_containers_are_merged(spark):
    """Containers of one pair and block that come in parts, overlapping ones too."""
    parts = [(0, 5, 0, [1, 2, 3]), (0, 5, 0, [3, 9]), (0, 5, 1, [9]), (1, 5, 0, [1]), (0, 6, 0, list(range(0, 6000))), (0, 6, 0, [65535])]
    rows = [(b, p, pl, A.encode_containers(np.zeros(len(d), np.int64), np.array(d))[1][0].as_py()) for b, p, pl, d in parts]
    merged = A.merged_postings(spark.createDataFrame(rows, "block bigint, pair bigint, plane int, bitmap binary"))
    got = {(r.block, r.pair, r.plane): (A.decode_containers(pa.array([bytes(r.bitmap)]))[1].tolist(), r.n) for r in merged.collect()}
    assert got == {(0, 5, 0): ([1, 2, 3, 9], 4), (0, 5, 1): ([9], 1), (1, 5, 0): ([1], 1), (0, 6, 0): ([*range(6000), 65535], 6001)}
    counts = {r.pair: (r.n_docs, r.n_links) for r in A.pair_counts(merged).collect()}
    assert counts == {5: (5, 6), 6: (6001, 6001)}
