"""Source tree scan (prune rules, stub twins, repository ids) and the incremental stream."""

import os

import pytest

from tyscope.operators import facts
from tyscope.sources import files as tree
from tyscope.streaming.incremental import incremental_extraction
from conftest import rows


def _put(root, rel, text, raw=None):
    p = os.path.join(root, rel)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "wb") as f:
        f.write(raw if raw is not None else text.encode())


def _repo(spark):
    return spark.createDataFrame([(7, 2020, "alice", "proj"), (8, 2021, "bob", "lib")],
                                 "id int, year int, user_name string, name string")


def _tree(root):
    _put(root, "2020/alice/proj/a.py", "x: int = 1\n")
    _put(root, "2020/alice/proj/a.pyi", "x: int\n")            # twin: kept
    _put(root, "2020/alice/proj/orphan.pyi", "y: int\n")       # no twin: dropped
    _put(root, "2020/alice/proj/mypy/skip.py", "z: int = 1\n")  # ignored folder
    _put(root, "2020/alice/proj/sub/python2.6/skip.py", "z: int = 1\n")
    _put(root, "2020/alice/proj/sub/mypy.py", "def f(a: str): pass\n")  # a file may be named mypy.py
    _put(root, "2020/alice/proj/notes.txt", "not python")
    _put(root, "2020/alice/proj/bad.py", "", raw=b"\xff\xfe\x00")  # undecodable: rejected
    _put(root, "2021/bob/lib/m.py", "def g(): return 1\n")
    _put(root, "2021/carol/gone/m.py", "q = 1\n")  # no repository row


def test_tree_scan(spark, tmp):
    root = os.path.join(tmp, "repos")
    _tree(root)
    _put(root, "2020/alice/proj/__init__.py", "v: int = 1\n")  # names that Spark's own file sources skip
    _put(root, "2020/alice/proj/.hidden/_w.py", "w = 1\n")
    files = tree.source_files(spark, root, _repo(spark), unknown="drop")
    stream, t = facts.extract_tables(files, "test-tree")
    assert rows(t.module, "repo_id", "path_rel", "num_annotations") == [
        (7, ".hidden/_w.py", 0), (7, "__init__.py", 1), (7, "a.py", 1), (7, "a.pyi", 1), (7, "sub/mypy.py", 1), (8, "m.py", 0)]
    assert rows(t.rejects) == [(7, "bad.py", "UnicodeDecodeError")]
    missing = tree.missing_repos(tree.listing(spark, root), _repo(spark))
    assert rows(missing) == [(2021, "carol", "gone")]


def test_content_is_not_shuffled(spark, tmp):
    root = os.path.join(tmp, "repos")
    _tree(root)
    plan = tree.source_files(spark, root, _repo(spark), unknown="drop")._jdf.queryExecution().optimizedPlan().toString()
    # contents are read by the last step, after paths and lengths have been dealt out
    assert plan.startswith("MapInArrow") and "content#" not in plan.split("\n", 1)[1] and "Relation" in plan


def test_all_forms_of_a_root_give_the_same_rows(spark, tmp):
    root = os.path.join(tmp, "re pos+(1)%20é")
    _tree(root)
    want = rows(tree.source_files(spark, root, _repo(spark), unknown="drop"), "repo_id", "path_rel")
    assert len(want) == 5
    for form in (root + "/", "file:" + root, "file://" + root, "file://" + root + "/"):
        assert rows(tree.source_files(spark, form, _repo(spark), unknown="drop"), "repo_id", "path_rel") == want


def test_paths_outside_the_root_fail(spark, tmp):
    listed = spark.createDataFrame([("file:/a/2020/u/r/m.py",)], "path string")
    assert tree.with_layout(listed, "file:/a").count() == 1
    with pytest.raises(Exception, match="not below"):
        tree.with_layout(listed, "hdfs://elsewhere/repos").collect()


def test_listing_equals_a_walk(spark, tmp):
    """Folders of every depth, empty ones, and many in one level, against os.walk."""
    import random
    rnd, root = random.Random(2), os.path.join(tmp, "repos")
    for i in range(150):
        deep = "/".join(rnd.choice(["a", "b", "mypy", "python2.6", "_x", ".y"]) for _ in range(rnd.randrange(5)))
        _put(root, f"{2013 + i % 4}/u{i % 6}/r{i % 9}/{deep}/f{i}.{rnd.choice(['py', 'pyi', 'txt', 'PY'])}".replace("//", "/"), "x" * i)
    os.makedirs(f"{root}/2019/empty/one")
    _put(root, "top.py", "")
    got = {r.path: r.length for r in tree.tree_listing(spark, root).collect()}
    want = {}
    for folder, dirs, names in os.walk(root):
        rel = os.path.relpath(folder, root)
        if rel.count("/") >= 2:
            dirs[:] = [d for d in dirs if d not in tree.IGNORED_DIRS]
        for n in names:
            if n.endswith((".py", ".pyi")):
                want[os.path.normpath(f"{rel}/{n}")] = os.path.getsize(f"{folder}/{n}")
    assert got == want
    assert tree.tree_listing(spark, f"{tmp}/absent").count() == 0


def test_tasks_get_equal_bytes(spark, tmp):
    """One repository holds half of all bytes: no task gets more than twice the median."""
    from pyspark.sql import functions as F
    rows_ = [(f"2020/u/big/m{i}.py", 40_000) for i in range(500)] + [(f"2021/u/r{i // 10}/m{i}.py", 20_000) for i in range(1000)]
    files = spark.createDataFrame(rows_, "path string, length bigint").repartition(9)
    for share in (1 << 20, 3 << 20):
        sizes = [r.b for r in tree.balanced(files, share).groupBy(F.spark_partition_id()).agg(F.sum("length").alias("b")).collect()]
        assert len(sizes) >= 10 and sum(sizes) == 40_000_000 and max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]
    assert tree.balanced(files.limit(0)).count() == 0


def test_unknown_folders_fail_or_are_listed(spark, tmp):
    root = os.path.join(tmp, "repos")
    _tree(root)
    with pytest.raises(Exception, match="no repository row for folder 2021/carol/gone"):
        tree.source_files(spark, root, _repo(spark)).count()
    from tyscope import api
    with pytest.raises(Exception, match="no repository row"):
        api.extract_tree(spark, root, _repo(spark), "unknown-test")
    assert rows(api.unknown_folders(spark, root, _repo(spark))) == [(2021, "carol", "gone")]
    with pytest.raises(ValueError):
        tree.attach_repo_id(spark.range(1), _repo(spark), "skip")


def test_files_that_cannot_be_read_are_rejects(spark, tmp):
    root = os.path.join(tmp, "repos")
    _put(root, "2020/alice/proj/a.py", "x = 1\n")
    _put(root, "2020/alice/proj/b.py", "y = 1\n")
    files = tree.source_files(spark, root, _repo(spark))  # listed now, read below
    os.remove(os.path.join(root, "2020/alice/proj/b.py"))
    t = facts.extract_tables(files, "gone-test")[1]
    assert rows(t.module, "path_rel") == [("a.py",)] and rows(t.rejects) == [(7, "b.py", "ContentMissing")]


def test_packed_table_equals_the_tree(spark, tmp):
    root = os.path.join(tmp, "repos")
    _tree(root)
    files = []
    for folder, _, names in os.walk(root):
        for n in names:
            full = os.path.join(folder, n)
            files.append((os.path.relpath(full, root), open(full, "rb").read()))
    packed = spark.createDataFrame(files, "path string, content binary")
    cols = ("repo_id", "path_rel", "content")
    assert rows(tree.packed_source_files(packed, _repo(spark), "drop"), *cols) == rows(tree.source_files(spark, root, _repo(spark), "drop"), *cols)


def test_repositories_stay_apart_without_a_table(spark, tmp):
    root = os.path.join(tmp, "repos")
    for repo in ("a", "b", "c"):
        _put(root, f"2020/u/{repo}/setup.py", "def f(x: int) -> int: return x\n")
    _, t = facts.extract_tables(tree.source_files(spark, root), "test-no-repository")
    assert rows(t.func_var, "repo_id", "name") == [(0, "f"), (1, "f"), (2, "f")]
    from tyscope.operators import reports
    assert reports.partial_annotation_complete(t.func_var, t.annotation).count() == 6
    assert rows(reports.full_annot(t.func_var, t.annotation), "sum_num_var") == [(4,), (4,), (4,)]


def test_stub_waits_for_a_late_twin(spark, tmp):
    root, out, ckpt = (os.path.join(tmp, d) for d in ("repos", "tables", "ckpt"))
    _put(root, "2020/alice/proj/m.pyi", "x: int\n")
    _put(root, "2020/alice/proj/z.py", "z = 1\n")
    incremental_extraction(spark, root, out, ckpt, repository=_repo(spark)).awaitTermination()
    assert rows(spark.read.parquet(out + "/module"), "path_rel") == [("z.py",)]
    _put(root, "2020/alice/proj/y.py", "y = 1\n")
    incremental_extraction(spark, root, out, ckpt, repository=_repo(spark)).awaitTermination()
    _put(root, "2020/alice/proj/m.py", "x = 1\n")
    incremental_extraction(spark, root, out, ckpt, repository=_repo(spark)).awaitTermination()
    assert rows(spark.read.parquet(out + "/module"), "path_rel") == [("m.py",), ("m.pyi",), ("y.py",), ("z.py",)]
    assert not os.path.exists(out + "/_module_paths") and not os.path.exists(out + "/_pending_stubs")  # Spark's state holds them


def test_every_order_of_arrival_gives_the_batch_scan(spark, tmp):
    """Modules and stubs of several keys dealt over batches at random: what the state lets pass is what
    the scan of the whole tree accepts, each file once."""
    import random

    from tyscope.streaming import incremental as S
    names = [f"2020/u/r{k % 3}/{d}m{k}.{e}" for k in range(6) for d in ("", "sub/") for e in ("py", "pyi") if (k, e) not in ((2, "py"), (4, "pyi"))]
    kept = spark.conf.get(S.PROVIDER, None)
    spark.conf.set(S.PROVIDER, S.ROCKSDB)
    try:
        for seed in range(2):
            order = random.Random(seed).sample(names, len(names))
            root, got = os.path.join(tmp, f"in{seed}"), []
            os.makedirs(root)
            src = spark.readStream.option("maxFilesPerTrigger", "1").text(root).toDF("path")
            files = tree.with_layout(src).selectExpr("*", "0L AS length")
            for i in range(3):
                with open(f"{root}/{i}.txt", "w") as f:
                    f.write("\n".join(order[i::3]))
                os.utime(f"{root}/{i}.txt", (1_600_000_000 + i, 1_600_000_000 + i))
            S.ship_package(spark)
            q = (S.paired_files(files).writeStream.option("checkpointLocation", os.path.join(tmp, f"ck{seed}"))
                 .trigger(availableNow=True).foreachBatch(lambda b, e: got.extend(r.path for r in b.collect())).start())
            q.awaitTermination()
            assert sorted(got) == sorted(n for n in names if n.endswith(".py") or n[:-1] in names)
    finally:
        spark.conf.unset(S.PROVIDER) if kept is None else spark.conf.set(S.PROVIDER, kept)


def test_stream_without_repository_table_keeps_ids(spark, tmp):
    root, out, ckpt = (os.path.join(tmp, d) for d in ("repos", "tables", "ckpt"))
    for step, repo in enumerate(("b", "a", "b", "c")):
        _put(root, f"2020/u/{repo}/m{step}.py", "x = 1\n")
        incremental_extraction(spark, root, out, ckpt).awaitTermination()
    got = {r.path_rel: r.repo_id for r in spark.read.parquet(out + "/module").collect()}
    assert got == {"m0.py": 0, "m1.py": 1, "m2.py": 0, "m3.py": 2}


def test_incremental_stream_is_idempotent(spark, tmp):
    root = os.path.join(tmp, "repos")
    out = os.path.join(tmp, "tables")
    ckpt = os.path.join(tmp, "ckpt")
    _put(root, "2020/alice/proj/a.py", "x: int = 1\ndef f(a: int) -> int: return a\n")
    q = incremental_extraction(spark, root, out, ckpt, repository=_repo(spark))
    q.awaitTermination()
    _put(root, "2021/bob/lib/m.py", "def g(b): return b\n")
    _put(root, "2020/alice/proj/a.pyi", "x: int\n")         # twin arrived in an earlier batch
    _put(root, "2020/alice/proj/lone.pyi", "y: int\n")      # no twin
    q = incremental_extraction(spark, root, out, ckpt, repository=_repo(spark))
    q.awaitTermination()
    q = incremental_extraction(spark, root, out, ckpt, repository=_repo(spark))  # nothing new
    q.awaitTermination()
    fv = spark.read.parquet(out + "/func_var")
    assert rows(fv, "repo_id", "path_rel", "name", "num_var", "num_var_annotated") == [
        (7, "a.py", "f", 2, 2), (7, "a.py", "x", 1, 1), (7, "a.pyi", "x", 1, 1), (8, "m.py", "g", 2, 0)]
    assert spark.read.parquet(out + "/annotation").count() == 4
    assert rows(spark.read.parquet(out + "/module"), "path_rel") == [("a.py",), ("a.pyi",), ("m.py",)]


def test_api_workflow(spark, tmp):
    from tyscope import api
    from tyscope.sources import standins
    from conftest import SF_SMALL
    repo = api.rank_repositories(standins.snapshots(spark, SF_SMALL))
    assert repo.count() > 0 and repo.select("id").distinct().count() == repo.count()
    root = os.path.join(tmp, "repos")
    _tree(root)
    stream, t = api.extract_tree(spark, root, _repo(spark), "api-test", unknown="drop")
    out = api.report_queries(_repo(spark), t)
    assert len(out) == 16 and all(df.columns for df in out.values())
    assert rows(out["hist_func_var_type"]) == [("argument", 1), ("variable", 2)]  # a.py, a.pyi; sub/mypy.py
    assert api.unannotated_names(stream).count() == 0
    diag = spark.createDataFrame([(8, "m.py", 1, "error")], "repo_id int, path string, line int, code string")
    assert api.triage_functions(stream, t, diag).count() == 0
