"""Report operators on hand-made tables, including the defined quirks."""


from tyscope.operators import reports
from tyscope.schemas import ANNOTATION, FUNC_VAR, MODULE
from conftest import rows


def _tables(spark):
    fv = spark.createDataFrame([
        (1, "a.py", "f", 1, 2, 2),   # fully annotated, 2 slots
        (1, "a.py", "f", 9, 2, 2),   # same name, other line: merges in full_annot
        (1, "a.py", "g", 3, 3, 1),   # partial
        (2, "b.py", "x", 1, 1, 1),   # variable
        (2, "b.py", "h", 5, 1, 0),
    ], FUNC_VAR)
    an = spark.createDataFrame([
        (1, "a.py", "f", 1, "a", "argument", "int", "int", 1),
        (1, "a.py", "f", 1, "", "return", "None", "None", 1),
        (1, "a.py", "f", 9, "a", "argument", "str", "str", 1),
        (1, "a.py", "f", 9, "", "return", "user_defined", "Foo", 1),
        (1, "a.py", "g", 3, "b", "argument", "Optional", "Optional[int]", 2),
        (2, "b.py", "x", 1, "x", "variable", "int", "int", 1),
    ], ANNOTATION)
    return fv, an


def test_partial_views(spark):
    fv, an = _tables(spark)
    assert len(reports.partial_annotations(fv).collect()) == 3
    h1 = reports.partial_annotation_complete(fv, an)
    assert len(h1.columns) == 10 and h1.count() == 5


def test_full_annot_fan_out_and_merge(spark):
    fv, an = _tables(spark)
    # two functions named f, 2 annotation rows each: sums (2*2)+(2*2)
    assert rows(reports.full_annot(fv, an)) == [(1, "a.py", "f", 8, 8)]
    assert rows(reports.full_annot_exact(fv, an), "name", "lineno") == [("f", 1), ("f", 9)]
    assert rows(reports.hist_fvt_full(fv, an)) == [("argument", 2), ("return", 2)]


def test_histograms(spark):
    fv, an = _tables(spark)
    assert rows(reports.hist_base_type(an)) == [("None", 1), ("Optional", 1), ("int", 2), ("str", 1),
                                                ("user_defined", 1)]
    assert rows(reports.hist_base_type_functions(an)) == [("None", 1), ("Optional", 1), ("int", 1), ("str", 1),
                                                          ("user_defined", 1)]
    assert rows(reports.hist_func_var_type(an)) == [("argument", 3), ("return", 2), ("variable", 1)]
    assert rows(reports.potential_annotations(fv, 0)) == [(9, 6)]
    empty = reports.potential_annotations(fv, 9000).first()
    assert empty[0] is None and empty[1] is None


def test_repository_counts(spark):
    repo = spark.createDataFrame([(1, 2022, "u", "r1", "2022-01-01 00:00:00", 5, "x"),
                                  (2, 2022, "u", "r2", "2022-01-01 00:00:00", 5, "y"),
                                  (3, 2022, "u", "r3", "2022-01-01 00:00:00", 5, "z")],
                                 "id int, year int, user_name string, name string, creation_date string, "
                                 "stars int, clone_url string")
    mod = spark.createDataFrame([(1, "a.py", "a.py", 3), (1, "c.py", "c.py", 2), (2, "b.py", "b.py", 0)], MODULE)
    counted = reports.annotations_per_repo(repo, mod)
    assert rows(counted, "id", "annotations_repo") == [(1, 5), (2, 0), (3, 0)]
    assert rows(reports.hist_repo_annotations(counted)) == [(5, 1)]
    ids = spark.createDataFrame([(1,), (4,)], "id int")
    assert rows(reports.lookup_repo_annotations(counted, ids)) == [(1, 5), (4, 0)]
    assert rows(reports.hist_module_annotations_nonzero(mod)) == [(2, 1), (3, 1)]
    assert reports.count_annotated_modules(mod).first()[0] == 2
    assert rows(reports.lookup_module(mod, 1, "c.py", "c.py")) == [(1, "c.py", "c.py", 2)]


def test_filters_reach_parquet_scan(spark, tmp):
    fv, _ = _tables(spark)
    fv.write.parquet(tmp + "/fv")
    df = reports.func_var_ordered(spark.read.parquet(tmp + "/fv"), 1)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(repo_id), EqualTo(repo_id,1)]" in plan
