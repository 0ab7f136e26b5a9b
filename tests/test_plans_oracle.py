"""Plan shape, DuckDB oracle on a subset of registered queries, determinism, entry()."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from tyscope.operators import reports
from tyscope.plans.registry import REGISTRY
from tyscope.sources import interchange as IO
from tyscope.sources import standins
from conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _norm(v):
    if isinstance(v, float):
        return round(v, 6) if not math.isnan(v) else "nan"
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _sorted(cols, rs):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rs), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SF_SMALL, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def test_every_query_has_oracle_and_matching_keys():
    assert all(q.sql for q in REGISTRY.values())
    assert set(REGISTRY) <= set(E.queries()) and set(REGISTRY) <= set(E.oracle_sql())
    assert len(REGISTRY) >= 79


def test_building_a_stored_query_starts_no_job(spark):
    """Once the shared inputs are stored, building a query plans it and runs nothing."""
    tracker = spark.sparkContext.statusTracker()
    # (the two lookups read the schema of one more table, which Spark does in a job)
    quiet = ["repository_rows", "snapshot_match", "longest_repo_name", "full_annot", "hist_fvt_full",
             "clean_repo_functions", "resume_after", "exclude_repos", "extract_func_var", "odd_annotation"]
    from tyscope.operators import ranking
    from tyscope.plans.registry import _repository
    probes = spark.createDataFrame([(2020, "u", "r")], "year int, user_name string, name string")
    for name in quiet:
        REGISTRY[name].build(spark, SF_SMALL)
    spark.sparkContext.setJobGroup("build-only", "build-only")
    try:
        for name in quiet:
            REGISTRY[name].build(spark, SF_SMALL)
        ranking.lookup_repo_id(_repository(spark, SF_SMALL), probes)
        ranking.lookup_repo_by_name(_repository(spark, SF_SMALL), probes)
        assert list(tracker.getJobIdsForGroup("build-only")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


SUBSET = ["hist_base_type", "extract_func_var", "partial_annotation_complete", "full_annot",
          "merge_snapshots", "order_errors", "probe_status", "classify_outcome", "repository_rows",
          "unannotated_name_share", "annotations_per_repo", "key_conflicts", "scan_api_pages",
          "commit_log_annotation", "findings_roundtrip", "scan_source_tree", "lookup_repo_id",
          "validate_duplicates", "load_fact_table", "odd_rejects", "odd_module", "odd_func_var", "odd_annotation",
          "reconcile_module", "scan_packed_tree", "scan_tree_without_repositories", "scan_snapshot_arrays",
          "scan_year_arrays", "filter_search", "order_errors_chunked", "lookup_default", "exclude_repos", "repo_verdict"]


@pytest.mark.parametrize("name", SUBSET)
def test_oracle_subset(spark, duck, name):
    df = REGISTRY[name].build(spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    cur = duck.execute(REGISTRY[name].sql)
    dcols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _sorted(df.columns, srows) == _sorted(dcols, cur.fetchall())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["base_type", "total"]
    assert df.count() > 0


def test_same_result_for_1_and_8_partitions(spark):
    res = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        r = REGISTRY["merge_snapshots"].build(spark, SF_SMALL)
        res.append(sorted(tuple(x) for x in r.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")  # the session fixture's value
    assert res[0] == res[1]


def test_bucketed_join_needs_no_shuffle(spark, tmp):
    saved = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        r = standins.Relational(spark, SF_SMALL)
        key = ["repo_id", "path_rel", "name", "lineno"]
        fv = IO.save_bucketed(r.func_var, "t_fv", tmp + "/fv", key, 4)
        an = IO.save_bucketed(r.annotation.withColumnRenamed("func_var_name", "name"), "t_an", tmp + "/an", key, 4)
        df = reports.partial_annotation_complete(fv, an.withColumnRenamed("name", "func_var_name"))
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan, plan
        assert df.count() > 0
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)


def test_stored_reports_count_before_the_join_and_do_not_shuffle(spark):
    saved = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for name in ("full_annot", "hist_fvt_full", "hist_base_type_partial"):
            plan = REGISTRY[name].build(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
            below = plan[plan.index("SortMergeJoin"):]
            assert "Exchange" not in below, plan
            assert "HashAggregate" in below, plan
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)


def test_names_are_numbered_without_gaps(spark):
    from tyscope.operators.windows import numbered
    df = spark.range(500).selectExpr("id % 211 AS a", "cast(id % 3 AS string) AS b").union(
        spark.createDataFrame([(None, "x")], "a bigint, b string"))
    got = numbered(df, ["a", "b"], "n", buckets=16).collect()
    assert sorted(r.n for r in got) == list(range(df.distinct().count()))
    again = numbered(df.repartition(9), ["a", "b"], "n", buckets=16).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_checkpoint_folder_is_required_on_a_cluster():
    from tyscope.session import checkpoint_dir

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(RuntimeError):
        checkpoint_dir(Session())


def test_scratch_is_released(spark):
    from tyscope.session import delete_path, materialize, path_exists, scratch_path, scratch_scope
    p = scratch_path(spark, "gone")
    spark.range(3).write.parquet(p)
    assert path_exists(spark, p)
    delete_path(spark, p)
    assert not path_exists(spark, p)
    with scratch_scope(spark, "scope"):
        inside = scratch_path(spark, "inside")
        assert materialize(spark.range(3), "kept").count() == 3
        spark.range(3).write.parquet(inside)
    assert not path_exists(spark, inside)
    assert materialize(spark.range(3), "kept").count() == 3


def test_merge_uses_group_limit_before_shuffle(spark):
    df = REGISTRY["merge_snapshots"].build(spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_checkpoint_dir_from_session(spark):
    from tyscope.session import checkpoint_dir
    d = checkpoint_dir(spark)
    assert d and spark.conf.get("spark.checkpoint.dir") == d


def test_sql_views_match_operators(spark):
    from tyscope.plans.views import register_views
    r = standins.Relational(spark, SF_SMALL)
    register_views(spark, r.repository, r.module, r.func_var, r.annotation)
    a = spark.sql("SELECT base_type, count(*) AS total FROM partial_annotation_complete GROUP BY base_type")
    b = reports.hist_base_type_partial(r.func_var, r.annotation)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    lo = spark.sql("SELECT sum(num_var) AS s FROM func_var WHERE repo_id >= :lo AND repo_id < :lo + 1000",
                   args={"lo": 0}).first()[0]
    assert lo == reports.potential_annotations(r.func_var, 0).first()[0]
    assert spark.sql("SELECT count(*) FROM full_annot").first()[0] == reports.full_annot(r.func_var, r.annotation).count()


def test_hot_repository_is_not_shuffled_by_key(spark):
    from pyspark.sql import functions as F
    from tyscope.operators import triage
    n = 30000
    funcs = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise((F.col("id") % 500).cast("int")).alias("repo_id"),
        F.concat(F.lit("p"), (F.col("id") % 97).cast("string"), F.lit(".py")).alias("path_rel"),
        F.concat(F.lit("f"), F.col("id").cast("string")).alias("name"))
    verdicts = spark.range(500).select(F.col("id").cast("int").alias("repo_id"),
                                       (F.col("id") % 2 == 1).alias("clean"))
    deny = spark.range(3, 7, 2).select(F.col("id").cast("int").alias("repo_id"))
    out = triage.exclude_repos(triage.clean_repo_functions(funcs, verdicts), deny)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(repo_id" not in plan, plan
    assert plan.count("BroadcastHashJoin") == 2
    assert out.count() == funcs.where("repo_id % 2 = 1 AND repo_id NOT IN (3, 5)").count()


def test_save_fact_tables_round_trip(spark, tmp):
    from tyscope.operators import facts
    from tyscope.plans.registry import _facts
    t = _facts(spark, SF_SMALL)
    stored = facts.save_fact_tables(t, "tst_facts", tmp + "/facts", 4)
    for a, b in zip(t, stored):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect()))
