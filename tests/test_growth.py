"""Work that must be dealt out by the size of the input, on rows of its own."""

import ast
import gc

import pyarrow as pa
from pyspark.sql import functions as F

from tyscope.operators.extract import _extract_batches, _source_text, annotation_issues, annotation_text, type_count
from tyscope.plans import registry
from tyscope.schemas import ANNOTATION, FUNC_VAR, FUNC_VAR_KEY
from tyscope.sources import files as tree
from tyscope.sources import interchange as IO
from tyscope.sources import standins
from tyscope.sources.json_document import JsonRows
from conftest import rows


def _part(spark, tmp):
    spark.range(200).select(F.col("id").alias("p_partkey"), (F.col("id") % 50).alias("p_size")).coalesce(1).write.parquet(
        f"{tmp}/part.parquet")
    return tmp


def test_texts_are_built_by_many_tasks(spark, tmp):
    """One input file is not one task."""
    sf = _part(spark, tmp)
    for build in (standins.triage_files, standins.source_tree_files, standins.odd_files, standins.source_files):
        assert build(spark, sf).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_tasks_of_texts_grow_with_the_shuffle_partitions(spark, tmp):
    sf, old = _part(spark, tmp), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "61")
    try:
        assert standins.triage_files(spark, sf).rdd.getNumPartitions() == 61
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_snapshots_are_built_by_many_tasks(spark, tmp):
    """the tasks that keep the best record of a repository sort what one task wrote."""
    spark.range(300).select(F.col("id").alias("c_custkey"), F.lit(1).alias("c_nationkey"), F.col("id").cast("string").alias("c_name"),
                            F.lit(5.0).alias("c_acctbal")).coalesce(1).write.parquet(f"{tmp}/customer.parquet")
    assert standins.snapshots(spark, tmp).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_unions_are_written_without_nested_calls():
    """the text of a long union, without the deeper stack that a nested writer needs."""
    long = ast.parse("int" + " | a.b" * 700, mode="eval").body
    assert _source_text(long) == "int" + " | a.b" * 700
    assert type_count(long) == 701 and annotation_issues(long) == []


def test_union_text_is_the_canonical_text():
    for text in ("a", "a|b", "a|b|c", "a|(b|c)", "(a,b)|c", "a.b|c[d]|e(f)|[g]|None|'x'|3", "a&b|c", "a|b&c", "-a|b", "(a|b)&c",
                 "1|2j|b'x'", "u'x'|a", "1.5.real|a", "x[a|b]", "x[a|b]|y", "...|a", "(a:=b)|c", "1e999|a", "{a}|b", "x[a,]|b",
                 "(a if b else c)|d", "a|(lambda: 1)", "a or b|c", "not a|b"):
        node = ast.parse(text, mode="eval").body
        assert annotation_text(node) == ast.unparse(node), text


def test_loads_do_not_broadcast_the_stored_keys(spark, tmp):
    """the keys of the files that match are as many as the batch's."""
    fv = spark.createDataFrame([(i % 7, "a.py", f"f{i}", i, 1, 0) for i in range(200)], FUNC_VAR)
    IO.load_fact_table(spark, fv, f"{tmp}/t", FUNC_VAR_KEY, [])
    seen = []
    from tyscope.sources import keyed_table as KT
    write = KT._write_generation
    KT._write_generation = lambda spark, rows, *more: seen.append(rows._jdf.queryExecution().sparkPlan().toString()) or write(spark, rows, *more)
    try:
        got = IO.load_fact_table(spark, fv.withColumn("lineno", F.col("lineno") + 100), f"{tmp}/t", FUNC_VAR_KEY, [])
    finally:
        KT._write_generation = write
    assert "SortMergeJoin" in seen[0] and "BroadcastHashJoin" not in seen[0]
    assert got.count() == 400
    assert rows(KT.file_ranges(spark, f"{tmp}/t").agg(F.sum("rows").alias("n"))) == [(400,)]


def test_ranges_of_files_are_their_smallest_and_largest_keys(spark, tmp):
    from tyscope.sources import keyed_table as KT
    an = [(None if i % 9 == 0 else i % 5, "a.py", f"f{i % 13}", i % 4, f"a{i}", "argument", "int", "int", 1) for i in range(300)]
    KT.append_rows(spark, spark.createDataFrame(an, ANNOTATION), f"{tmp}/t", ["repo_id", "path_rel", "func_var_name"])
    whole = F.struct("repo_id", "path_rel", "func_var_name")
    want = (spark.read.parquet(f"{tmp}/t/gen=0").groupBy(F.col("_metadata.file_name").alias("file"))
            .agg(F.min(whole).alias("lo"), F.max(whole).alias("hi"), F.count(F.lit(1)).alias("rows")))
    assert sorted(map(str, want.collect())) == sorted(map(str, KT.file_ranges(spark, f"{tmp}/t").drop("gen").collect()))


def test_ranges_of_a_document_share_tasks_and_tasks_get_only_their_ranges():
    """64 KB ranges of large documents are not a task each."""
    size, chunk = 10 << 20, 1 << 16
    options = {"files": f'[["a", {size}], ["b", 5]]', "chunk": str(chunk), "task": str(1 << 20)}
    reader = JsonRows(options).reader(None)
    parts = reader.partitions()
    assert len(parts) == 11
    assert [r[:4] for p in parts for r in p.ranges] == [(0, c, c * chunk, (c + 1) * chunk) for c in range(160)] + [(1, 0, 0, 5)]
    assert "files" not in reader.__getstate__()


def test_stored_tables_get_buckets_by_their_rows(spark, tmp, monkeypatch):
    """A bucket is sorted by one task, so it holds a bounded number of rows."""
    spark.range(60).select(F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit(7.0).alias("l_quantity"),
                           F.lit(3).alias("l_partkey")).write.parquet(f"{tmp}/lineitem.parquet")
    spark.range(60).select(F.col("id").alias("o_orderkey"), (F.col("id") % 5).alias("o_custkey")).write.parquet(f"{tmp}/orders.parquet")
    spark.range(5).select(F.col("id").alias("c_custkey"), F.lit(1).alias("c_nationkey"), F.lit("n").alias("c_name"),
                          F.lit(5.0).alias("c_acctbal")).write.parquet(f"{tmp}/customer.parquet")
    asked = []
    save = IO.save_bucketed
    monkeypatch.setattr(IO, "save_bucketed", lambda df, table, path, keys, buckets: asked.append(buckets) or save(df, table, path, keys, buckets))
    monkeypatch.setattr(registry, "BUCKET_ROWS", 3)
    assert registry._Stored(spark, tmp).func_var.count() == 60
    assert asked == [20, 20]


def test_a_reader_of_one_table_stores_one(spark, tmp, monkeypatch):
    """The other fact tables are not written."""
    from tyscope.operators import facts
    kept = []
    store = facts.stored_table
    monkeypatch.setattr(facts, "stored_table", lambda t, name: kept.append(name) or store(t, name))
    assert registry.REGISTRY["commit_log_module"].build(spark, _part(spark, tmp)).count() > 0
    assert kept == ["module"]


def test_plain_annotations_are_written_without_a_writer_object(monkeypatch):
    """F19 (F18 shares it): a writer per annotation cost more than the annotation's parse."""
    texts = ("int", "a.b", "Optional[Union[str, int]]", "typing.Dict[str, a.b]", "Tuple[int, ...]", "Literal['a', 3, b'x', True]",
             "Callable[[int, str], None]", "x[a,]", "List[a | None]", "x[0][1]", "'Foo'", "[]")
    nodes = [ast.parse(text, mode="eval").body for text in texts]
    want = [ast.unparse(node) for node in nodes]
    monkeypatch.setattr(ast, "unparse", lambda node: 1 / 0)
    assert [annotation_text(node) for node in nodes] == want


def test_text_of_any_annotation_is_the_canonical_text():
    parts = ("a", "3", "1.5", "1e999", "2j", "'x'", "u'x'", "b'x'", "...", "()", "[]", "a.b", "f(x)", "(a, b)", "(a:=b)", "(yield)", "-1",
             "a & b", "a | b", "f'{a}'", "lambda: 1", "not a", "1 if a else b", "{a}", "(a,)", "u'x'[0]")
    shapes = ("{0}[{1}]", "{0}[{1}, {0}]", "{0}[{1},]", "({0}).c", "({0})[{1}]", "[{0}, {1}]", "({0}) | {1}", "x[{0} | {1}]", "x[[{0}], *{1}]",
              "x[{0}:{1}]", "(3).c", "x[y[{0}].z, [{1}]]")
    for text in {shape.format(a, b) for shape in shapes for a in parts for b in parts}:
        try:
            node = ast.parse(text, mode="eval").body
        except SyntaxError:
            continue
        assert annotation_text(node) == ast.unparse(node), text


def test_the_cycle_collector_stays_out_of_the_extraction():
    """F19 (F18 shares it): it walked every syntax tree several times."""
    n, seen, before = 2000, [], gc.get_threshold()
    files = pa.RecordBatch.from_pydict({"repo_id": [1] * n, "path_rel": ["m.py"] * n, "content": ["def f(a: int, b: str) -> x: return 1\n"] * n})
    note = lambda phase, info: seen.append(phase)
    gc.collect()
    gc.callbacks.append(note)
    try:
        got = sum(b.num_rows for b in _extract_batches(iter([files])))
    finally:
        gc.callbacks.remove(note)
    assert got == 5 * n and not seen and gc.get_threshold() == before


def test_packed_files_are_parsed_by_many_tasks(spark):
    """neither the splits of a compressed table nor the stubs' join decide the number of long tasks."""
    packed = spark.createDataFrame([(f"2020/u/r/p{i}.py{'i' * (i % 2)}", b"x: int = 1\n") for i in range(400)]
                                   + [(f"2020/u/r/p{i}.py", b"x: int = 1\n") for i in range(1, 400, 2)], "path string, content binary").coalesce(1)
    repository = spark.createDataFrame([(7, 2020, "u", "r")], "id int, year int, user_name string, name string")
    files = tree.packed_source_files(packed, repository)
    per_task = [n for n in files.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()]
    assert sum(per_task) == 600 and len(per_task) >= 4 * spark.sparkContext.defaultParallelism and max(per_task) < 100
