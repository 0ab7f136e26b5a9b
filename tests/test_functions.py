"""Column functions with the study's documented examples."""

from pyspark.sql import functions as F

from tyscope.functions.columns import (
    base_type, creation_year, format_created_at, percent_share, repo_root, split_full_name, truncate,
)


def test_base_type_examples(spark):
    cases = [(None, ""), ("", ""), ("int", "int"), ("Optional[Union[str, int]]", "Optional"),
             ("Callable[]", "Callable"), ("ImportedClass", "user_defined"), ("...", "ellipsis"),
             ("List[int]", "user_defined"), ("typing.Optional[int]", "user_defined"),
             ("'Foo'", "user_defined"), ("str | None", "str"), ("(int", "user_defined"),
             ("Dict,x", "user_defined"), ("NoneType", "NoneType"), ("AbstractSet[int]", "AbstractSet")]
    df = spark.createDataFrame(cases, "a string, expected string")
    got = df.select(base_type("a").alias("b"), "expected").collect()
    assert all(r["b"] == r["expected"] for r in got), got


def test_dates_and_year(spark):
    df = spark.createDataFrame([("2013-10-28T13:19:39Z",), ("2022-10-17T02:58:36Z",)], "d string")
    got = df.select(format_created_at("d").alias("f")).select("f", creation_year("f").alias("y")).collect()
    assert [(r.f, r.y) for r in got] == [("2013-10-28 13:19:39", 2013), ("2022-10-17 02:58:36", 2022)]


def test_split_full_name(spark):
    df = spark.createDataFrame([("audreyfeldroy/cookiecutter-pypackage",), ("a/b/c",), ("noslash",)], "n string")
    u, n, ok = split_full_name("n")
    got = df.select(u.alias("u"), n.alias("n"), ok.alias("ok")).collect()
    assert [tuple(r) for r in got] == [("audreyfeldroy", "cookiecutter-pypackage", True),
                                       ("a", "b", False), ("noslash", None, False)]


def test_truncate_code_points(spark):
    df = spark.createDataFrame([("é" * 300,)], "s string")
    assert df.select(F.length(truncate("s", 269))).first()[0] == 269


def test_repo_root_and_percent(spark):
    df = spark.createDataFrame([("/a/b/c/d/e.py", 1, 8)], "p string, n long, t long")
    r = df.select(repo_root("p", 4).alias("r"), percent_share("n", "t").alias("s")).first()
    assert r.r == "/a/b/c" and r.s == 12.5


def test_lookup_default(spark):
    from tyscope.functions.columns import lookup_default
    df = spark.createDataFrame([("7066",), ("12",)], "k string").withColumn(
        "m", F.create_map(F.lit("7066"), F.lit(True)))
    assert [r[0] for r in df.select(lookup_default("m", "k", False)).collect()] == [True, False]
