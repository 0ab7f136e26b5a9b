"""The registered queries: names, columns, whole tables, SQL twins, and the pipeline."""
import duckdb
import pytest

import corpus_pipeline
from tyscope.llm import queries as Q
from tyscope.session import read_table

SF = "/root/testdata/sf0.01"
COLUMNS = {
    1: ("documents", ["doc_id", "n_words", "n_removed", "kept_sha256"]),
    2: ("pages", ["page_id", "url", "text", "n_chars"]),
    3: ("documents", ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]),
    4: ("documents", ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]),
    5: ("documents", ["doc_id", "size", "source_size", "target", "taken"]),
    6: ("documents", ["doc_id", "fingerprint", "component_id"]),
    7: ("documents", ["doc_id", "held_out", "score", "predicted"]),
    10: ("pages", ["page_id", "host", "path", "rule", "verdict"]),
    12: ("documents", ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]),
    13: ("documents", ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]),
}


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in Q.QUERIES) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["drop_toxic", "drop_near_copies", "drop_repeated_passages",
                                                     "drop_contaminated", "mix_sources"]


@pytest.mark.parametrize("name", [n for n in Q.QUERIES if int(n[2:].split("_")[0]) in COLUMNS])
def test_contract_columns_and_rows(spark, name):
    table, columns = COLUMNS[int(name[2:].split("_")[0])]
    df = Q.QUERIES[name](spark, SF)
    assert set(columns) <= set(df.columns)
    key = columns[0]
    assert sorted(r[0] for r in df.select(key).collect()) == sorted(r[0] for r in read_table(spark, SF, table).select(key).collect())


@pytest.mark.parametrize("name", Q.ORACLE_SQL)
def test_sql_twins(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = Q.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({Q.ORACLE_SQL[name]})").fetchall()
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == sorted(want, key=repr)


def test_pipeline_stages_against_their_parts(spark):
    from test_decontaminate import brute as hit
    from test_mixing import targets
    from test_simhash import brute_components, brute_fingerprint
    from test_substring import brute as cut

    from tyscope.session import materialize
    docs = read_table(spark, SF, "documents")
    columns, before = docs.columns, docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), f"test-{name}")
        after = docs.collect()
        if name == "drop_toxic":
            bad = {r.doc_id for r in Q.QUERIES["op7_toxicity_nnpu"](spark, SF).where("predicted = 1").collect()}
            assert sorted(after) == sorted(r for r in before if r.doc_id not in bad)
        elif name == "drop_near_copies":
            root = brute_components([brute_fingerprint(r.text) for r in before], 4)
            ids = {}
            for r, c in zip(before, root):
                ids[c] = min(ids.get(c, r.doc_id), r.doc_id)
            assert sorted(after) == sorted(r for r in before if r.doc_id in set(ids.values()))
        elif name == "drop_repeated_passages":
            want = {r[0]: (r[1] - r[2]) for r in cut([(r.doc_id, r.text) for r in before])}
            assert {r.doc_id: len(r.text.encode().split()) for r in after} == want
            assert all(r.n_chars == len(r.text) for r in after)
        elif name == "drop_contaminated":
            items = [tuple(r) for r in read_table(spark, SF, "benchmark").select("item_id", "text").collect()]
            bad = {r[0] for r in hit([(r.doc_id, r.text) for r in before], items) if r[-1]}
            assert sorted(after) == sorted(r for r in before if r.doc_id not in bad)
        else:
            sizes, taken = {}, {}
            for r in before:
                sizes[r.source] = sizes.get(r.source, 0) + len(r.text.encode().split())
            for r in after:
                taken[r.source] = taken.get(r.source, 0) + len(r.text.encode().split())
            longest = max(len(r.text.encode().split()) for r in before)
            for s, t in targets(sizes).items():
                assert abs(taken.get(s, 0) - t) <= longest
            assert docs.columns == [*columns, "copy"]
            continue
        assert docs.columns == columns
        before = after


def odd_documents(spark):
    """Nulls in every column, empty and long texts, repeated rows, and extra columns named like helpers."""
    extra = "fp bigint, hits string, spans string, size string, copy bigint, score double, features string, component string"
    same = "the same passage of more than twenty words that stands in several of these documents " * 3
    rows = [(1, same, "en", "a", 9), (1, same, "en", "a", 9), (2, "before " + same, None, None, None), (3, None, "en", "a", 0),
            (4, "", None, "b", 0), (None, same + "after", "en", "", 3), (None, None, None, None, None), (5, "x", "en", "b", 1),
            (6, "long " * 60_000, "en", "c", 300_000), (7, "y" * 100_000, "en", "c", 1), (7, "other text of one id", "en", "c", 1)]
    return spark.createDataFrame([(*r, *(None,) * 5, 0.5, "f", "c") for r in rows],
                                 f"doc_id bigint, text string, lang string, source string, n_chars bigint, {extra}")


def test_stages_on_odd_rows_and_on_no_rows(spark):
    sf = "/root/testdata/sf0.001"
    docs = odd_documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, docs.limit(0)):
            out = stage(spark, table, sf)
            if name != "mix_sources":
                assert out.columns == docs.columns
            else:
                assert set(docs.columns) == set(out.columns)
            n = out.count()
            assert n == 0 if table is not docs else name == "mix_sources" or 0 < n <= docs.count()
    from test_simhash import brute_components, brute_fingerprint
    from test_substring import brute as cut
    rows = docs.collect()
    kept = corpus_pipeline.drop_near_copies(spark, docs, sf).collect()
    assert len(kept) == len(set(brute_components([brute_fingerprint(r.text) for r in rows], 4)))
    assert [r.doc_id for r in kept].count(1) == 1 and [r.doc_id for r in kept].count(7) == 2
    assert 3 in [r.doc_id for r in kept] and 4 not in [r.doc_id for r in kept]  # neither has words: the smaller id stays
    out = corpus_pipeline.drop_repeated_passages(spark, docs, sf).collect()
    left = sorted((str(r.doc_id), len((r.text or "").split())) for r in out)
    assert left == sorted((str(d), n - gone) for d, n, gone, _ in cut([(r.doc_id, r.text) for r in rows]))
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out)


@pytest.mark.parametrize("name", [n for n in Q.QUERIES])
def test_queries_on_empty_tables(spark, name, tmp_path):
    """Every query on tables that have columns but no rows."""
    import os
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        read_table(spark, "/root/testdata/sf0.001", t).limit(0).coalesce(1).write.parquet(os.path.join(str(tmp_path), f"{t}.parquet"))
    assert Q.QUERIES[name](spark, str(tmp_path)).count() == 0
