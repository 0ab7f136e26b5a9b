"""Readers for the study's file formats and our writers (round trips)."""

import json
import os

from tyscope.operators import ranking
from tyscope.sources import interchange as IO
from tyscope.sources import keyed_table as KT
from tyscope.sources import repos_json
from conftest import rows


def _write(path, obj, indent=None):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(obj, f, ensure_ascii=False, indent=indent)


def test_snapshot_arrays_positions_and_names(spark, tmp):
    recs = [{"name": f"u/r{i}", "url": f"https://x/{i}.git", "stars": 50 - i,
             "created_at": "2015-03-01T10:00:00Z"} for i in range(5)]
    for it in range(2):
        _write(f"{tmp}/github_data_2015_{it}.json", recs[it:], indent=4)
    df = repos_json.read_snapshot_arrays(spark, [f"{tmp}/github_data_2015_{i}.json" for i in range(2)])
    assert rows(df, "year", "iteration", "pos", "name")[:3] == [(2015, 0, 0, "u/r0"), (2015, 0, 1, "u/r1"),
                                                                (2015, 0, 2, "u/r2")]
    merged = ranking.merge_snapshots(df)
    assert merged.count() == 5


def test_year_arrays_and_ranked_round_trip(spark, tmp):
    recs = [{"name": "a/b", "url": "u", "stars": 3, "created_at": "2022-10-17T02:58:36Z"},
            {"name": "c/d", "url": "v", "stars": 1, "created_at": "2022-10-18T02:58:36Z"}]
    _write(f"{tmp}/github_data_2022.json", recs)
    df = repos_json.read_year_arrays(spark, f"{tmp}/github_data_2022.json")
    assert rows(df, "year", "rank", "name") == [(2022, 0, "a/b"), (2022, 1, "c/d")]
    repos_json.write_ranked(df, f"{tmp}/ranked")
    back = repos_json.read_ranked(spark, f"{tmp}/ranked")
    assert rows(back) == rows(df.select(*back.columns))


def test_commit_log_study_document(spark, tmp):
    doc = {"module_commits": [[3, "pkg/a.py", "a.py", 2]],
           "func_var_commits": [[3, "pkg/a.py", "f", 1, 2, 2], [3, "pkg/a.py", "x", 4, 1, 0]],
           "annotation_commits": [[3, "pkg/a.py", "f", 1, "a", "argument", "int", "int", 1],
                                  [3, "pkg/a.py", "f", 1, "", "return", "None", "None", 0]]}
    _write(f"{tmp}/log/commit_2019.json", doc)
    fv = IO.read_commit_log(spark, f"{tmp}/log", "func_var")
    assert rows(fv) == [(3, "pkg/a.py", "f", 1, 2, 2), (3, "pkg/a.py", "x", 4, 1, 0)]
    an = IO.read_commit_log(spark, f"{tmp}/log", "annotation")
    assert an.count() == 2 and an.schema["type_count"].dataType.simpleString() == "int"
    repository = spark.createDataFrame([(3, 2019), (4, 2013)], "id int, year int")
    IO.write_commit_log(fv, "func_var", f"{tmp}/ours", repository)
    back = IO.read_commit_log(spark, f"{tmp}/ours", "func_var")
    assert rows(back.drop("year")) == rows(fv) and {r.year for r in back.collect()} == {2019}


def test_commit_log_keeps_texts_and_unknown_years(spark, tmp):
    an = spark.createDataFrame([(8, 'a "b"\\c.py', "f\n", 1, "é", "argument", "user_defined", "[1, 'x']", 1),
                                (9, "p.py", "g", 2, None, "return", "", "", 0)],
                               "repo_id int, path_rel string, func_var_name string, lineno int, annot_name string, "
                               "func_var_type string, base_type string, entire_annotation string, type_count int")
    repository = spark.createDataFrame([(8, 2014)], "id int, year int")
    IO.write_commit_log(an, "annotation", f"{tmp}/log", repository)
    back = IO.read_commit_log(spark, f"{tmp}/log", "annotation")
    assert sorted(map(tuple, back.collect())) == sorted((*r, {8: 2014}.get(r.repo_id)) for r in an.collect())


TEXTS = ["plain", "", 'a "b" [1, 2]', "], [", '"module_commits": [[', "back\\slash", '\\"', "\\\\", "é 日本 😀", "\n\t", "[" * 9, "{}:,", '": [']


def test_commit_documents_are_cut_anywhere(spark, tmp):
    """Ranges of every small size give the rows of json.load: strings full of brackets, quotes and
    escapes, several keys, pretty-printed and one-line files, empty arrays."""
    import random
    rnd = random.Random(3)
    ann = [[i, rnd.choice(TEXTS), rnd.choice(TEXTS), i % 50, rnd.choice(TEXTS), "argument", "int", rnd.choice(TEXTS), i % 3]
           for i in range(60)]
    mod = [[i, rnd.choice(TEXTS), "m.py", i] for i in range(40)]
    for name, ascii_, indent in (("2015", True, None), ("2016", False, None), ("2017", False, 2)):
        os.makedirs(f"{tmp}/d", exist_ok=True)
        with open(f"{tmp}/d/commit_{name}.json", "w", encoding="utf-8") as f:
            json.dump({"module_commits": mod, "func_var_commits": [], "annotation_commits": ann}, f, ensure_ascii=ascii_, indent=indent)
    with open(f"{tmp}/d/commit_2018.json", "w") as f:
        f.write('{"annotation_commits": []}')
    for chunk in (1 << 20, 4099, 977):
        got = IO.read_commit_documents(spark, f"{tmp}/d", "annotation", chunk)
        assert sorted(map(tuple, got.collect())) == sorted((*r, y) for y in (2015, 2016, 2017) for r in ann)
        got = IO.read_commit_documents(spark, f"{tmp}/d", "module", chunk)
        assert sorted(map(tuple, got.collect())) == sorted((*r, y) for y in (2015, 2016, 2017) for r in mod)
        assert IO.read_commit_documents(spark, f"{tmp}/d", "func_var", chunk).count() == 0
    parts = IO.read_commit_documents(spark, f"{tmp}/d/commit_2015.json", "annotation", 977).rdd.getNumPartitions()
    assert parts == -(-os.path.getsize(f"{tmp}/d/commit_2015.json") // 977)
    os.makedirs(f"{tmp}/none")
    assert IO.read_commit_documents(spark, f"{tmp}/none", "module").count() == 0


def test_ranges_of_a_document_at_every_cut():
    """Both readings of a document for each place of one cut, without Spark."""
    from tyscope.sources import json_document as D
    rows_ = [[1, t, u] for t in TEXTS for u in ("x", '"')]
    for text in (json.dumps({"a": rows_[:5], "b": rows_}), json.dumps({"a": rows_[:3], "b": rows_}, ensure_ascii=False, indent=1)):
        raw = text.encode()
        for cut in range(1, len(raw)):
            found, inside, key = [], False, None
            for start, end in ((0, cut), (cut, len(raw))):
                r = D.Range(raw, start, end, True)
                at, keys, names = r.openings(inside)
                ends = r.row_ends(at, inside)
                owner = [([key, *names])[k] for k in D.np.searchsorted(keys, at)]
                found += [(o, json.loads(t)) for o, t in zip(owner, r.texts(at, ends).to_pylist())]
                last = r.last_key(inside)
                key, inside = last if last is not None else key, inside != r.odd
            assert found == [("a", x) for x in rows_[:5 if "\n" not in text else 3]] + [("b", x) for x in rows_], cut


def test_findings_file_both_shapes(spark, tmp):
    findings = [[3031, "D:\\x\\repos\\2019\\a\\b\\p.py", "prop1", ["MeinTypeError!", ["'classmethod' object"]]],
                [9250, "/r/2013/c/d/l.py", "f", [False, [1, "int"]]]]
    _write(f"{tmp}/f.json", findings)
    df = IO.read_findings(spark, f"{tmp}/f.json", multiline_array=True)
    got = rows(df, "repo_id", "name", "status")
    assert got == [(3031, "prop1", "MeinTypeError!"), (9250, "f", "false")]
    assert df.where("repo_id = 3031").first().messages == ["'classmethod' object"]


def test_json_maps(spark, tmp):
    _write(f"{tmp}/counts/names.json", {"self": 10, "x": 3})
    assert rows(IO.read_count_map(spark, f"{tmp}/counts")) == [("self", 10), ("x", 3)]
    _write(f"{tmp}/verdicts/verdicts.json", {"7066": True, "12": False})
    assert rows(IO.read_verdict_map(spark, f"{tmp}/verdicts")) == [(12, False), (7066, True)]
    v = spark.createDataFrame([(1, True), (2, False)], "repo_id int, clean boolean")
    IO.write_verdict_map(v, f"{tmp}/v2")
    assert rows(IO.read_verdict_map(spark, f"{tmp}/v2")) == [(1, True), (2, False)]


def test_load_fact_table_skips_existing_keys(spark, tmp):
    path = f"{tmp}/t"
    a = spark.createDataFrame([(1, "k", 4, 2), (1, "k", 7, 1)], "repo_id int, path_rel string, v int, visit int")
    IO.load_fact_table(spark, a, path, ["repo_id", "path_rel"], ["visit"])
    b = spark.createDataFrame([(1, "k", 9), (2, "k", 5)], "repo_id int, path_rel string, v int")
    out = IO.load_fact_table(spark, b, path, ["repo_id", "path_rel"], [])
    assert out.columns == ["repo_id", "path_rel", "v"]
    assert rows(out) == [(1, "k", 7), (2, "k", 5)]
    assert IO.clear_table(spark, path, out.schema).count() == 0


def _keys(spark, ids, tag=""):
    return spark.createDataFrame([(r, f"{tag}p{p}", f"f{n}") for r in ids for p in range(4) for n in range(5)],
                                 "repo_id int, path_rel string, name string")


def test_a_load_reads_only_files_that_can_hold_its_keys(spark, tmp):
    path, key = f"{tmp}/t", ["repo_id", "path_rel", "name"]
    stored = KT.load_fact_table(spark, _keys(spark, range(400)), path, key, [], rows_per_file=20)
    assert stored.count() == 8000
    files = KT.file_ranges(spark, path).count()
    assert files >= 400
    for ids, tag in (([100, 101, 102, 103], ""), ([7, 390], ""), ([5], "q"), ([-3], ""), ([400, 401], ""), ([9], "o")):
        batch = _keys(spark, ids, tag)
        got = {(r.gen, r.file) for r in KT.matching_files(batch, KT.file_ranges(spark, path), key).collect()}
        first, last = (batch.selectExpr(f"{f}(struct(repo_id, path_rel, name)) k").first().k for f in ("min", "max"))
        keys = [tuple(r) for r in batch.collect()]
        need = {(r.gen, r.file) for r in KT.file_ranges(spark, path).collect() if any(tuple(r.lo) <= k <= tuple(r.hi) for k in keys)}
        assert need <= got and len(got) <= files * 0.02, (ids, len(got))
    # 1 % of the repositories again, half of their rows new
    again = _keys(spark, range(200, 204)).union(_keys(spark, range(200, 204), "new"))
    out = KT.load_fact_table(spark, again, path, key, [], rows_per_file=20)
    assert out.count() == 8080 and out.distinct().count() == 8080


def test_loads_of_any_order_equal_one_load(spark, tmp):
    import random
    rnd, path, key, want = random.Random(4), f"{tmp}/t", ["repo_id", "path_rel"], {}
    for step in range(5):
        rows_ = [(rnd.randrange(30), f"p{rnd.randrange(9)}", step, i) for i in range(60)]
        for r, p, v, i in rows_:
            want.setdefault((r, p), (v, i))
        df = spark.createDataFrame([(r, p, v * 100 + i, i) for r, p, v, i in rows_], "repo_id int, path_rel string, v int, visit int")
        out = KT.load_fact_table(spark, df, path, key, ["visit"], rows_per_file=7)
    assert rows(out) == sorted((r, p, v * 100 + i) for (r, p), (v, i) in want.items())
    schema = out.schema
    assert not KT.compact_fact_table(spark, path, schema, key)
    # a load that ended before its version was written leaves the table as it was
    spark.createDataFrame([(1, "x", 1)], schema).write.parquet(f"{path}/gen=77")
    assert KT.read_fact_table(spark, path, schema).count() == len(want)
    assert KT.compact_fact_table(spark, path, schema, key, rows_per_file=7, always=True)
    assert rows(KT.read_fact_table(spark, path, schema)) == rows(spark.createDataFrame([(r, p, v * 100 + i) for (r, p), (v, i) in want.items()], schema))
    assert {r.gen for r in KT.file_ranges(spark, path).collect()} == {5}
    empty = KT.load_fact_table(spark, out.limit(0), f"{tmp}/none", key, [])
    assert empty.count() == 0 and empty.columns == ["repo_id", "path_rel", "v"]


def test_api_pages_hold_only_what_the_api_returns(spark, tmp):
    for page, names in ((1, ["u/a", "u/b"]), (2, ["u/c"])):
        items = [{"full_name": n, "clone_url": "x", "stargazers_count": 5, "created_at": "2015-01-01T00:00:00Z", "id": 9}
                 for n in names]
        _write(f"{tmp}/pages/year=2015/iteration=0/p{page}.json", {"page": page, "total_count": 3, "items": items})
    df = repos_json.read_api_pages(spark, f"{tmp}/pages")
    assert rows(df, "pos", "name") == [(0, "u/a"), (1, "u/b"), (100, "u/c")]


def test_snapshot_paths_and_fact_log(spark, tmp):
    out, snaps = repos_json.snapshot_paths(tmp, 2017)
    assert out.endswith("github_data_2017.json") and [s[-20:] for s in snaps][0] == "github_data_2017_0.json"[-20:]
    for i, p in enumerate(snaps):
        _write(p, [{"name": f"u/r{i}", "url": "x", "stars": 10 - i, "created_at": "2017-01-01T00:00:00Z"}])
    df = repos_json.read_snapshot_arrays(spark, snaps)
    assert rows(df, "iteration", "name") == [(i, f"u/r{i}") for i in range(5)]
    mod = spark.createDataFrame([(5, "a.py", "a.py", 1), (1500, "b.py", "b.py", 0)],
                                "repo_id int, path_rel string, name string, num_annotations int")
    fv = spark.createDataFrame([(5, "a.py", "x", 1, 1, 1)],
                               "repo_id int, path_rel string, name string, lineno int, num_var int, "
                               "num_var_annotated int")
    an = spark.createDataFrame([(5, "a.py", "x", 1, "x", "variable", "int", "int", 1)],
                               "repo_id int, path_rel string, func_var_name string, lineno int, annot_name string, "
                               "func_var_type string, base_type string, entire_annotation string, type_count int")
    repository = spark.createDataFrame([(5, 2022), (1500, 2016)], "id int, year int")
    IO.save_fact_log(mod, fv, an, repository, f"{tmp}/log")
    back = spark.read.parquet(f"{tmp}/log/module")
    assert rows(back, "repo_id", "year") == [(5, 2022), (1500, 2016)]
    assert spark.read.parquet(f"{tmp}/log/annotation").where("year = 2022").count() == 1
