"""Results kept up to date: the fully-annotated table from appends, verdict checkpoints."""

import os
import random

from pyspark.sql import functions as F

from tyscope.operators import increments, reports, triage
from tyscope.schemas import ANNOTATION, ANNOTATION_KEY, FUNC_VAR, FUNC_VAR_KEY
from tyscope.sources import checkpoint
from tyscope.sources import keyed_table as KT
from conftest import rows


def _batches(seed=1, repos=12, parts=3):
    rnd = random.Random(seed)
    fv, an = [], []
    for r in range(repos):
        for p in range(3):
            for f in range(4):
                n = rnd.randrange(4)
                for line in (1, 9):
                    fv.append((r, f"m{p}.py", f"f{f}", line, n, n if rnd.random() < 0.7 else 0))
                    an += [(r, f"m{p}.py", f"f{f}", line, f"a{k}", "argument", "int", "int", 1) for k in range(rnd.randrange(3))]
    return [(fv[i::parts], an[i::parts]) for i in range(parts)], fv, an


def test_three_appends_equal_a_rebuild(spark, tmp):
    batches, fv, an = _batches()
    for f, a in batches:
        got = increments.append_facts(spark, spark.createDataFrame(f, FUNC_VAR), spark.createDataFrame(a, ANNOTATION), tmp)
    want = rows(reports.full_annot(spark.createDataFrame(fv, FUNC_VAR), spark.createDataFrame(an, ANNOTATION)))
    assert rows(got) == want and want
    assert rows(increments.update_full_annot(spark, tmp)) == want  # nothing new
    # a run that ended between loading and summing: the next one sums what it left
    more_fv, more_an = [(90, "m.py", "f", 1, 2, 2)], [(90, "m.py", "f", 1, k, "argument", "int", "int", 1) for k in "abc"]
    KT.load_fact_table(spark, spark.createDataFrame(more_fv, FUNC_VAR), f"{tmp}/func_var", FUNC_VAR_KEY, [])
    KT.load_fact_table(spark, spark.createDataFrame(more_an, ANNOTATION), f"{tmp}/annotation", ANNOTATION_KEY, [])
    want = sorted([*want, (90, "m.py", "f", 6, 6)])
    assert rows(increments.read_full_annot(spark, tmp)) != want
    assert rows(increments.update_full_annot(spark, tmp)) == want
    # rows that are stored already add nothing
    assert rows(increments.append_facts(spark, spark.createDataFrame(more_fv, FUNC_VAR), spark.createDataFrame(more_an, ANNOTATION), tmp)) == want
    # a compacted table has other loads: built anew
    KT.compact_fact_table(spark, f"{tmp}/annotation", ANNOTATION, ANNOTATION_KEY, always=True)
    assert rows(increments.update_full_annot(spark, tmp)) == want
    empty = increments.append_facts(spark, spark.createDataFrame([], FUNC_VAR), spark.createDataFrame([], ANNOTATION), f"{tmp}/none")
    assert empty.count() == 0


def test_unchanged_files_are_not_read(spark, tmp):
    _, fv, an = _batches(repos=40)
    KT.load_fact_table(spark, spark.createDataFrame(an, ANNOTATION), f"{tmp}/annotation", ANNOTATION_KEY, [], rows_per_file=10)
    new = spark.createDataFrame([x for x in fv if x[0] == 17], FUNC_VAR)
    files = KT.file_ranges(spark, f"{tmp}/annotation")
    old = KT.matching_rows(spark, f"{tmp}/annotation", ANNOTATION, [0], new, FUNC_VAR_KEY, len(ANNOTATION_KEY))
    assert {x for x in an if x[0] == 17} <= {tuple(r) for r in old.collect()}
    assert old.count() < len(an) / 15 and len(old.inputFiles()) < files.count() / 15


def test_a_run_resumes_at_its_checkpoint(spark, tmp):
    repos = spark.createDataFrame([(i % 50,) for i in range(70)], "repo_id int")
    diagnostics = spark.createDataFrame([(i, "m.py", 1, "error") for i in range(0, 50, 3)], "repo_id int, path string, line int, code string")
    judged = []

    def judge(some):
        judged.extend(r.repo_id for r in some.collect())
        return triage.repo_verdict(some, diagnostics)
    path = f"{tmp}/log"
    assert checkpoint.read_verdicts(spark, path).count() == 0
    assert checkpoint.run_verdicts(spark, repos, judge, path, 8, max_checkpoints=3) == 3
    assert sorted(judged) == list(range(24)) and checkpoint.read_verdicts(spark, path).count() == 24
    os.makedirs(f"{path}/version=4")  # a checkpoint that was being written
    with open(f"{path}/version=4/part-0.txt", "w") as f:
        f.write('{"24": tr')
    assert checkpoint.read_verdicts(spark, path).count() == 24
    assert checkpoint.run_verdicts(spark, repos, judge, path, 8) == 4
    want = [(i, i % 3 != 0) for i in range(50)]
    assert rows(checkpoint.read_verdicts(spark, path)) == want and sorted(judged) == list(range(50))
    assert checkpoint.run_verdicts(spark, repos, judge, path, 8) == 0
    checkpoint.append_verdicts(spark, spark.createDataFrame([(3, True), (4, False)], "repo_id int, clean boolean"), path)
    want = [(i, {3: True, 4: False}.get(i, c)) for i, c in want]
    assert rows(checkpoint.read_verdicts(spark, path)) == want
    checkpoint.compact_verdicts(spark, path)
    assert rows(checkpoint.read_verdicts(spark, path)) == want and len(checkpoint.versions(spark, path)) == 1
    from tyscope.sources import interchange as IO
    assert rows(IO.read_verdict_map(spark, path)) == want  # the study's format


def test_triage_and_reports_start_no_job_before_their_action(spark):
    """The queries on stored tables, and the shuffles of the histograms."""
    from conftest import SF_SMALL
    from tyscope.plans.registry import REGISTRY
    names = ("probe_status", "triage_candidates", "attach_function_definition", "hist_base_type", "hist_func_var_type")
    for n in names:
        REGISTRY[n].build(spark, SF_SMALL)  # stores what they read
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("build-only", "")
    try:
        built = {n: REGISTRY[n].build(spark, SF_SMALL) for n in names}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not tracker.getJobIdsForGroup("build-only")
    for n in ("hist_base_type", "hist_func_var_type"):
        plan = built[n]._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Window" not in plan and "Join" not in plan
    assert built["probe_status"].where(F.col("status").isNull()).count() == 0
