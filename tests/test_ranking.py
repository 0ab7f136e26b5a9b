"""Ranking: dedupe, merge/top-k, validation, ids."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tyscope.operators import ranking
from tyscope.operators.windows import numbered_in_order, previous_in_order
from tyscope.sources import standins
from conftest import rows

SNAP = "year int, iteration int, pos long, name string, url string, stars int, created_at string"


def test_dedupe_keeps_most_starred_first(spark):
    df = spark.createDataFrame([
        (2020, 0, 0, "u/a", "x", 5, "2020-01-01T00:00:00Z"),
        (2020, 0, 1, "u/a", "y", 7, "2020-01-01T00:00:00Z"),
        (2020, 0, 2, "u/a", "z", 7, "2020-01-01T00:00:00Z"),
        (2020, 0, 3, "u/a", "w", 9, "2020-02-01T00:00:00Z"),  # same name, other date: another repo
    ], SNAP)
    got = rows(ranking.dedupe_snapshot(df), "pos", "url")
    assert got == [(1, "y"), (3, "w")]
    v = ranking.validate_duplicates(df).first()
    assert (v.n_rows, v.n_valid, v.n_duplicates) == (4, 2, 2)
    kc = rows(ranking.key_conflicts(df))
    assert kc == [("same_name", "u/a", 2)]


def test_merge_top_k_and_ties(spark):
    data = []
    for it in range(5):
        for i in range(30):
            data.append((2019, it, i, f"u/r{i}", "x", 100 - i + (it % 2), "2019-05-05T00:00:00Z"))
    df = spark.createDataFrame(data, SNAP)
    m = ranking.merge_snapshots(df, top=10)
    got = [(r["rank"], r["name"], r["stars"]) for r in m.orderBy("rank").collect()]
    assert [g[1] for g in got] == [f"u/r{i}" for i in range(10)]
    assert [g[0] for g in got] == list(range(10))
    assert all(g[2] == 101 - i for i, g in enumerate(got))
    # invariant: unique per key, non-increasing stars
    assert m.select("name").distinct().count() == 10
    assert ranking.order_errors(m.withColumn("iteration", F.lit(0)).withColumnRenamed("rank", "pos")).first()[
        "n_order_errors"] == 0


def test_distributed_lag_matches_single_window(spark):
    df = spark.range(0, 2000).select(
        (F.col("id") % 3).cast("int").alias("g"), (F.col("id") * 7 % 2001).alias("pos"),
        ((F.col("id") * 37) % 101).cast("int").alias("v"))
    ours = previous_in_order(df, ["g"], "pos", "v", "prev", chunk=50)
    ref = df.withColumn("prev", F.lag("v").over(Window.partitionBy("g").orderBy("pos")))
    assert rows(ours, "g", "pos", "prev") == rows(ref, "g", "pos", "prev")


def test_ids_and_lookups(spark):
    merged = spark.createDataFrame([
        (2022, 0, "a/x", "u0", 9, "2022-01-01T00:00:00Z"), (2022, 1, "a/yy", "u1", 8, "2022-01-01T00:00:00Z"),
        (2021, 0, "b/x", "u2", 9, "2021-01-01T00:00:00Z"), (2021, 1, "b/z/q", "u3", 3, "2021-01-01T00:00:00Z"),
    ], "year int, rank int, name string, url string, stars int, created_at string")
    repo = ranking.repository_rows(merged)
    assert rows(repo, "id", "year", "user_name", "name") == [(0, 2022, "a", "x"), (1, 2022, "a", "yy"),
                                                             (2, 2021, "b", "x")]
    assert rows(ranking.rejected_names(merged), "name") == [("b/z/q",)]
    assert ranking.longest_repo_name(repo).first().asDict() == {"year": 2022, "length": 2, "value": "yy"}
    probes = spark.createDataFrame([(2021, "b", "x"), (2030, "b", "x")], "year int, user_name string, name string")
    assert rows(ranking.lookup_repo_id(repo, probes), "year", "id") == [(2021, 2), (2030, -1)]
    first = ranking.lookup_repo_by_name(repo, spark.createDataFrame([("x",), ("nope",)], "name string"))
    assert rows(first, "name", "id") == [("nope", None), ("x", 0)]
    empty = ranking.longest_clone_url(repo.where("id < 0")).first()
    assert tuple(empty) == (0, 0, "")
    pages = ranking.paginate(merged.withColumn("rank", F.col("rank") * 600))
    assert rows(pages, "rank", "page") == [(0, 1), (0, 1), (600, 7), (600, 7)]


def test_top_k_split_equals_plain_top_k(spark):
    from tyscope.operators.windows import top_k_per_group
    df = spark.range(20000).select((F.col("id") % 3).alias("g"), F.col("id"),
                                   ((F.col("id") * 7919) % 1000).alias("v"))
    order = [F.desc("v"), F.col("id")]
    a = top_k_per_group(df, ["g"], order, 50, split_cols=["id"], buckets=16)
    w = Window.partitionBy("g").orderBy(*order)
    b = df.withColumn("_rn", F.row_number().over(w)).where("_rn <= 50")
    assert rows(a, "g", "id", "_rn") == rows(b, "g", "id", "_rn")


def test_places_in_order_by_chunks(spark):
    data = [(2013 + i % 2 if i % 5 else None, i % 3, (i * 7919) % 1000 - 300, i) for i in range(400)] + [(2013, 0, None, -1)]
    df = spark.createDataFrame(data, "year int, iteration int, pos long, x int").repartition(4)
    w = Window.partitionBy("year", "iteration").orderBy("pos")
    want = sorted((tuple(r) for r in df.withColumn("nth", F.row_number().over(w) - 1).collect()), key=str)
    for chunk in (1, 16, 1 << 16):
        got = numbered_in_order(df, ["year", "iteration"], "pos", "nth", chunk)
        assert got.columns == ["year", "iteration", "pos", "x", "nth"]
        assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_study_snapshots_limit_each_task(spark):
    df = spark.range(3000).selectExpr("2013 AS year", "cast(id % 2 AS int) AS iteration", "3 * id AS pos", "id AS x").repartition(4)
    got = standins.study_snapshots(df, 100)
    assert "WindowGroupLimit" in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.iteration, r.pos, r.x) for r in got.collect()) == sorted((i, k, 2 * k + i) for i in range(2) for k in range(100))


def test_order_helpers_over_many_range_partitions(spark):
    """Places, running sums and carried values by any order, against a sort on the driver."""
    import random

    from pyspark.sql import functions as F

    from tyscope.operators import windows as W
    rnd = random.Random(8)
    data = [(rnd.choice(["a", "a", "a", "b", None]), rnd.choice(["x", "é", "", "zz"]), i, rnd.choice([None, i])) for i in range(3000)]
    df = spark.createDataFrame(data, "k string, o string, i int, v int").repartition(5)
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        place = {r.i: r.n for r in W.numbered_by(df, ["k"], [F.desc("o"), "i"], "n").collect()}
        ahead = {r.i: r.s for r in W.running_sum(df, ["o", "i"], "i", "s").collect()}
        seen = {r.i: r.w for r in W.last_seen(df, ["k"], ["o", "i"], "v", "w").collect()}
        parts = W.in_order(df, ["o", "i"]).select("_part").distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)
    assert parts > 1
    by_o = sorted(data, key=lambda r: (r[1].encode(), r[2]))
    total, last = 0, {}
    for k, o, i, v in by_o:
        assert ahead[i] == total
        total += i
        last[k] = v if v is not None else last.get(k)
        assert seen[i] == last[k]
    down = sorted(sorted(data, key=lambda r: r[2]), key=lambda r: r[1].encode(), reverse=True)
    count = {}
    for k, o, i, v in down:
        assert place[i] == count.get(k, 0)
        count[k] = count.get(k, 0) + 1
