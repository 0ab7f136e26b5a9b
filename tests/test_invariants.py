"""Invariants on derived data, and generated signatures (property test)."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tyscope.operators import facts, ranking
from tyscope.operators.extract import _IDX, extract_file
from tyscope.plans.registry import _extracted
from tyscope.sources import standins
from conftest import SF_SMALL


def test_extraction_invariants(spark):
    stream = _extracted(spark, SF_SMALL)
    t = facts.fact_tables(stream)
    assert facts.reconcile_module(stream).count() == 0                       # D15
    assert t.func_var.where(F.col("num_var_annotated") > F.col("num_var")).count() == 0
    per = facts.annotations_per_module(t.module, t.annotation)
    assert per.where(F.col("num_annotations") != F.col("n_annotation_rows")).count() == 0   # D12
    for table, key in ((t.func_var, ["repo_id", "path_rel", "name", "lineno"]),
                       (t.annotation, ["repo_id", "path_rel", "func_var_name", "lineno", "annot_name"])):
        assert table.groupBy(*key).count().where("count > 1").count() == 0  # D4: keys unique


def test_merge_invariants(spark):
    merged = ranking.merge_snapshots(standins.snapshots(spark, SF_SMALL))
    assert merged.groupBy("year", "name", "created_at").count().where("count > 1").count() == 0
    errs = ranking.order_errors(merged.withColumn("iteration", F.lit(0)).withColumnRenamed("rank", "pos"))
    assert errs.where("n_order_errors > 0").count() == 0                       # W1 = 0
    assert merged.groupBy("year").count().where("count > 1000").count() == 0


ANNOTATIONS = st.sampled_from(["int", "str", "Optional[int]", "List[str]", "'Foo'", "a.b", "None",
                               "Callable[[int], str]", "int | None", "..."])
NAMES = st.sampled_from(["a", "b", "c", "d", "e", "self", "x"])


@st.composite
def signature(draw):
    names = draw(st.lists(NAMES, min_size=0, max_size=5, unique=True))
    anns = [draw(st.one_of(st.none(), ANNOTATIONS)) for _ in names]
    ret = draw(st.one_of(st.none(), ANNOTATIONS))
    body = draw(st.sampled_from(["pass", "return 1", "return", "return None", "if x:\n        return 1"]))
    return names, anns, ret, body


@settings(max_examples=150, deadline=None)
@given(signature())
def test_generated_signatures(sig):
    names, anns, ret, body = sig
    params = ", ".join(n if a is None else f"{n}: {a}" for n, a in zip(names, anns))
    src = f"def f({params})" + (f" -> {ret}" if ret else "") + f":\n    {body}\n"
    rows = extract_file(1, "g.py", src.encode())
    fv = [r for r in rows if r[_IDX["kind"]] == "func_var"]
    an = [r for r in rows if r[_IDX["kind"]] == "annotation"]
    n_ann = sum(a is not None for a in anns)
    returns_value = body == "return 1"
    assert len(fv) == 1
    assert fv[0][_IDX["num_var"]] == len(names) + (1 if ret or returns_value else 0)
    assert fv[0][_IDX["num_var_annotated"]] == n_ann + (1 if ret else 0) == len(an)
    partial = 0 < fv[0][_IDX["num_var_annotated"]] < fv[0][_IDX["num_var"]]
    assert (fv[0][_IDX["unannotated_names"]] is not None) == partial
    if partial:
        assert fv[0][_IDX["unannotated_names"]] == [n for n, a in zip(names, anns) if a is None]
    module = [r for r in rows if r[_IDX["kind"]] == "module"][0]
    assert module[_IDX["num_annotations"]] == len(an)
