import random

from tyscope.llm import fixity as X


def pages(spark, n=300):
    rnd = random.Random(2)
    rows = [(i if i % 50 else None, f"http://h{i % 7}.org/{i}", "é<p>" * rnd.randrange(400) or None) for i in range(n)]
    rows += [rows[3], rows[3], (None, None, None), (None, None, None)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)


def test_offsets_are_running_sums(spark):
    idx = X.record_index(pages(spark), file_bytes=40_000).collect()
    files = {}
    for r in idx:
        files.setdefault(r.warc_file, []).append(r)
    assert len(files) > 2 and len(idx) == 304
    for rows in files.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.warc_offset):
            assert r.warc_offset == at
            at += r.n_bytes


def test_audit_finds_planted_damage(spark):
    p = pages(spark)
    first = X.record_index(p, file_bytes=40_000)
    record = X.warc_record()
    fate = X.F.pmod(X.F.col("page_id"), X.F.lit(40))
    held = (X.F.when(fate == 3, X.F.concat(record, X.F.lit("!"))).when(fate == 5, X.F.lit(None).cast("string"))
            .otherwise(record))
    second = X.record_index(p, held, file_bytes=40_000)
    want = {(r.page_id, r.warc_file, r.warc_offset, {3: "altered", 5: "missing"}[r.page_id % 40])
            for r in first.collect() if r.page_id is not None and r.page_id % 40 in (3, 5)}
    for options in ({}, {"range_bytes": 700, "fanout": 2}, {"range_bytes": 1 << 20, "fanout": 3}):
        got = X.audit(first, second, **options).collect()
        assert {(r.page_id, r.warc_file, r.warc_offset, r.status) for r in got} == want
        assert len(got) == len(want)
    back = X.audit(second, first).collect()
    assert {r.status for r in back} == {"altered", "extra"}
    assert X.audit(first, first).count() == 0
    assert X.root(first) != X.root(second) and X.root(first) == X.root(first.repartition(5))


def test_empty_replicas(spark):
    p = pages(spark, 20)
    some, none = X.record_index(p), X.record_index(p.limit(0))
    assert X.audit(none, none).count() == 0
    assert {r.status for r in X.audit(some, none).collect()} == {"missing"}
    assert X.audit(none, some).count() == some.count()
    assert X.root(none) is None
