"""Stand-in tables derived from the benchmark tables.

The study's own inputs (search snapshots, cloned source trees, its MySQL
tables) are not available, so each input is derived by Spark from the given
tables; every derived table grows with them. The same derivations are written
in DuckDB SQL in ``tyscope.plans.oracle`` so results can be checked
independently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tyscope.functions.columns import base_type, basename
from tyscope.session import read_table

# Annotations of the templated module, chosen by p_size (their expected rows are written
# out in ``tyscope.plans.oracle``).
TEMPLATE_ANNOTATIONS = [
    'int',
    'Optional[Union[str, int]]',
    'typing.Optional[int]',
    'Callable[[int], str]',
    '"Foo"',
    'str | None',
    'Tuple[int, ...]',
    'Literal["a", "b"]',
    '...',
    'Dict[str, Any]',
    '-1',
    'None',
    'list[int]',
]

# Files with p_size % BROKEN_EVERY == 0 end in a syntax error (whole file rejected).
BROKEN_EVERY = 17


def _s(c) -> F.Column:
    return c.cast("string")


# ------------------------------------------------------------------ repository
def repository(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One repository per customer; year owns ids [(2022 - year) * 1000, +1000)."""
    c = read_table(spark, sf_dir, "customer")
    year = (F.lit(2022) - F.floor(F.col("c_custkey") / 1000)).cast("int")
    user = F.concat(F.lit("u"), _s(F.col("c_nationkey")))
    return c.select(
        F.col("c_custkey").cast("int").alias("id"),
        year.alias("year"),
        user.alias("user_name"),
        F.col("c_name").alias("name"),
        F.concat(_s(year), F.lit("-10-28 13:19:39")).alias("creation_date"),
        F.floor("c_acctbal").cast("int").alias("stars"),
        F.concat(F.lit("https://example.com/"), user, F.lit("/"), F.col("c_name"), F.lit(".git"))
        .alias("clone_url"),
    )


# ------------------------------------------------------------------ func_var / annotation / module
def func_var(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (order, line number); the order's customer is the repository."""
    li = (read_table(spark, sf_dir, "lineitem")
          .groupBy("l_orderkey", "l_linenumber")
          .agg(F.max("l_quantity").alias("q"), F.max("l_partkey").alias("p")))
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    j = li.join(o, li.l_orderkey == o.o_orderkey, "inner")
    nv = F.col("q").cast("int") % 5
    return j.select(
        F.col("o_custkey").cast("int").alias("repo_id"),
        F.concat(F.lit("pkg/m"), _s(F.col("l_orderkey") % 10), F.lit(".py")).alias("path_rel"),
        F.concat(F.lit("f"), _s(F.col("l_orderkey"))).alias("name"),
        F.col("l_linenumber").cast("int").alias("lineno"),
        nv.alias("num_var"),
        F.least(nv, (F.col("p") % 5).cast("int")).alias("num_var_annotated"),
    )


# One annotation per built-in base type, and some that are none; with their type counts.
_STANDIN_TEXTS = [
    "None", "bool", "int", "float", "complex", "str", "bytes", "bytearray", "memoryview", "range", "tuple[int]", "list",
    "set[str]", "frozenset", "dict[str, int]", "ellipsis", "...", "type", "object", "NoneType", "Any", "Union[int, str]",
    "Optional[str]", "Callable", "TypeVar", "Generic", "ClassVar[int]", "Final", "Literal[1]", "Annotated[int, x]",
    "TypedDict", "Protocol", "runtime_checkable", "AbstractSet", "List[int]", "str | None", "np.ndarray", "Foo",
]
_STANDIN_COUNTS = [t.count("[") + t.count(",") + t.count("|") + 1 for t in _STANDIN_TEXTS]


def annotation(func_var_df: DataFrame) -> DataFrame:
    """Exactly ``num_var_annotated`` rows per func_var (the last is the return when full)."""
    k = F.col("k")
    order = F.substring("name", 2, 20).cast("bigint")
    idx = ((order + F.col("lineno") + k) % len(_STANDIN_TEXTS)).cast("int") + 1
    text = F.element_at(F.array(*[F.lit(t) for t in _STANDIN_TEXTS]), idx)
    cnt = F.element_at(F.array(*[F.lit(n) for n in _STANDIN_COUNTS]), idx)
    rows = (func_var_df.where(F.col("num_var_annotated") > 0)
            .withColumn("k", F.explode(F.sequence(F.lit(1), F.col("num_var_annotated")))))
    return rows.select(
        "repo_id", "path_rel", F.col("name").alias("func_var_name"), "lineno",
        F.when(k == F.col("num_var"), F.lit("")).otherwise(F.concat(F.lit("a"), _s(k))).alias("annot_name"),
        F.when(k == F.col("num_var"), F.lit("return")).otherwise(F.lit("argument")).alias("func_var_type"),
        base_type(text).alias("base_type"),
        text.alias("entire_annotation"),
        cnt.alias("type_count"),
    )


def module(func_var_df: DataFrame) -> DataFrame:
    """Modules of the func_var stand-in; the annotation count equals the annotation rows."""
    return (func_var_df.groupBy("repo_id", "path_rel")
            .agg(F.sum("num_var_annotated").cast("int").alias("num_annotations"))
            .select("repo_id", "path_rel", basename("path_rel").alias("name"), "num_annotations"))


class Relational:
    """The three stand-in fact tables plus repository, built lazily from one sf folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.repository = repository(spark, sf_dir)
        self.func_var = func_var(spark, sf_dir)
        self.annotation = annotation(self.func_var)
        self.module = module(self.func_var)


# ------------------------------------------------------------------ templated source files
def template_content(pk: F.Column, sz: F.Column) -> F.Column:
    """Text of the templated module for one part (see ``source_files``)."""
    pks = _s(pk)
    ann = F.element_at(F.array(*[F.lit(src) for src in TEMPLATE_ANNOTATIONS]),
                       (sz % len(TEMPLATE_ANNOTATIONS)).cast("int") + 1)
    p_ann = F.when(sz % 2 == 0, F.lit(": str")).otherwise(F.lit(""))
    ret = F.when(sz % 3 == 0, F.lit(" -> int")).otherwise(F.lit(""))
    broken = F.when(sz % BROKEN_EVERY == 0, F.lit("def broken(:\n")).otherwise(F.lit(""))
    return F.concat(
        F.lit("import typing\n"),
        F.lit("X"), pks, F.lit(" = "), _s(sz), F.lit("\n"),
        F.lit("a, b.c, d[0] = 1, 2, 3\n"),
        F.lit("y: "), ann, F.lit(" = None\n"),
        F.lit("class C"), pks, F.lit(":\n"),
        F.lit("    z: int\n"),
        F.lit("    def m(self, p"), p_ann, F.lit(", *args, k: int = 1, **kw)"), ret, F.lit(":\n"),
        F.lit("        def inner(q: float) -> None:\n"),
        F.lit("            pass\n"),
        F.lit("        return p\n"),
        F.lit("async def g"), pks, F.lit("(u: int):\n"),
        F.lit("    def h(v"), _s(sz % 40), F.lit(", w: str):\n"),  # many names, of different frequency
        F.lit("        return v"), _s(sz % 40), F.lit("\n"),
        F.lit("    return u\n"),
        F.lit("[e, f] = g = 0, 1\n"),
        broken,
    )


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Python module per part; its expected rows depend on p_size only.

    ``(repo_id int, path_rel string, content string)``
    """
    p = _spread(read_table(spark, sf_dir, "part").select("p_partkey", "p_size"))
    pk, sz = F.col("p_partkey"), F.col("p_size")
    return p.select(sz.cast("int").alias("repo_id"),
                    F.concat(F.lit("pkg/p"), _s(pk), F.lit(".py")).alias("path_rel"),
                    template_content(pk, sz).alias("content"))


# Repositories whose folder has no repository row: p_size % TREE_UNKNOWN_EVERY == 0.
TREE_UNKNOWN_EVERY = 11


def _tree_folder(sz: F.Column) -> tuple[F.Column, F.Column, F.Column]:
    return ((F.lit(2013) + sz % 10).cast("int"),
            F.concat(F.lit("u"), _s(sz % 7)),
            F.concat(F.lit("r"), _s(sz)))


def _spread(narrow: DataFrame) -> DataFrame:
    """The narrow rows the texts are made from, over four tasks per core, or as many as a
    shuffle has (the texts themselves are never moved)."""
    spark = narrow.sparkSession
    return narrow.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))


# Kinds of odd files, by p_partkey % ODD_KINDS (see ``odd_files``).
ODD_KINDS = 10


def odd_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules that real corpora have and templates lack, one or two per part:

    0 a lone surrogate in an annotation; 1 a byte that is no UTF-8, and a file that was not
    read (null); 2 too deep nesting; 3 an
    expression of 900 terms and a union of 300 types; 4 keys repeated inside the file; 5 one
    path delivered twice; 6 two paths equal in their first 269 characters; 7 names and
    annotations beyond every length limit; 8 a null byte; 9 old line ends.
    ``(repo_id int, path_rel string, content binary)``
    """
    p = _spread(read_table(spark, sf_dir, "part").select("p_partkey"))
    pk = F.col("p_partkey")
    kind = pk % ODD_KINDS
    path = F.concat(F.lit("odd/o"), _s(pk), F.lit(".py"))
    long_path = F.concat(F.lit("odd/"), F.repeat(F.lit("p"), 270))

    def text(*parts) -> F.Column:
        return F.encode(F.concat(*[x if isinstance(x, F.Column) else F.lit(x) for x in parts]), "utf-8")

    def one(content: F.Column, at: F.Column = path) -> F.Column:
        return F.struct(at.alias("path_rel"), content.alias("content"))

    def n(letter: str, more: int) -> F.Column:
        return F.repeat(F.lit(letter), (pk % 7 + more).cast("int"))

    files = (F.when(kind == 0, F.array(one(text('def f(a: "\\ud800", b: Literal["\\ud801x"]) -> int:\n    return 1\n'))))
             .when(kind == 1, F.array(one(F.concat(text("x = 1  # "), F.unhex(F.lit("FF")), text("\n"))),
                                      one(F.lit(None).cast("binary"), F.concat(path, F.lit("i")))))
             .when(kind == 2, F.array(one(text("x = ", F.repeat(F.lit("("), 300), "1", F.repeat(F.lit(")"), 300), "\n"))))
             .when(kind == 3, F.array(one(text("x = a", F.repeat(F.lit(" + a"), 899), "\ny: int",
                                               F.repeat(F.lit(" | int"), 299), " = 1\n"))))
             .when(kind == 4, F.array(one(text("a, a = 1, 2\nb: int = 1; b: str = 2\ndef g(): pass\ndef g(x): pass\n"))))
             .when(kind == 5, F.array(one(text("v: int = 1\n")), one(text("v = 1\nw = 2\n"))))
             .when(kind == 6, F.array(one(text("k: int = 1\n"), F.concat(long_path, F.lit("b.py"))),
                                      one(text("k = 1\nonly_in_a = 2\n"), F.concat(long_path, F.lit("a.py")))))
             .when(kind == 7, F.array(one(text("def ", n("n", 130), "(", n("q", 131), ": ", n("T", 536), "): pass\n"))))
             .when(kind == 8, F.array(one(F.concat(text("x = 1"), F.unhex(F.lit("00")), text("\n")))))
             .otherwise(F.array(one(text("x = 1\rdef h(a, b: int):\r\n    return a\n")))))
    return p.select(pk.cast("int").alias("repo_id"), F.explode(files).alias("f")).select("repo_id", "f.*")


def source_tree_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a source tree ``<year>/<user>/<repo>/...`` built from part rows.

    By ``p_partkey % 6``: a module plus a non-Python file; a module below a
    ``mypy`` folder; a module below ``python2.6``; a module with its stub; an
    orphan stub; a module named ``mypy.py`` in an ordinary folder.
    ``(rel_path string, content string)``
    """
    p = _spread(read_table(spark, sf_dir, "part").select("p_partkey", "p_size"))
    pk, sz = F.col("p_partkey"), F.col("p_size")
    pks = _s(pk)
    year, user, repo = _tree_folder(sz)
    v = pk % 6
    rels = (F.when(v == 0, F.array(F.concat(F.lit("pkg/p"), pks, F.lit(".py")),
                                   F.concat(F.lit("pkg/p"), pks, F.lit(".txt"))))
            .when(v == 1, F.array(F.concat(F.lit("pkg/mypy/p"), pks, F.lit(".py"))))
            .when(v == 2, F.array(F.concat(F.lit("python2.6/p"), pks, F.lit(".py"))))
            .when(v == 3, F.array(F.concat(F.lit("pkg/p"), pks, F.lit(".py")),
                                  F.concat(F.lit("pkg/p"), pks, F.lit(".pyi"))))
            .when(v == 4, F.array(F.concat(F.lit("pkg/s"), pks, F.lit(".pyi"))))
            .otherwise(F.array(F.concat(F.lit("pkg/p"), pks, F.lit("/mypy.py")))))
    return (p.select(F.concat_ws("/", _s(year), user, repo).alias("folder"), F.explode(rels).alias("rel"),
                     template_content(pk, sz).alias("content"))
            .select(F.concat_ws("/", "folder", "rel").alias("rel_path"), "content"))


def tree_repository(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repository rows for the tree's folders (one per p_size), some folders left out."""
    sz = F.col("p_size")
    year, user, repo = _tree_folder(sz)
    p = read_table(spark, sf_dir, "part").select("p_size").distinct()
    return (p.where(sz % TREE_UNKNOWN_EVERY != 0)
            .select((sz * 100).cast("int").alias("id"), year.alias("year"), user.alias("user_name"),
                    repo.alias("name")))


def folder_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repository rows (id, year) of the templated modules; some ids have none."""
    sz = F.col("p_size")
    return (read_table(spark, sf_dir, "part").select("p_size").distinct().where(sz % 9 != 4)
            .select(sz.cast("int").alias("id"), (F.lit(2013) + sz * 7 % 10).cast("int").alias("year")))


# ------------------------------------------------------------------ search snapshots
def study_snapshots(snap: DataFrame, limit: int) -> DataFrame:
    """Snapshots as the search returns them: the first ``limit`` records, counted from 0."""
    w = Window.partitionBy("year", "iteration").orderBy("pos")
    # the limit is put on row_number() itself, so that each task keeps no more before the shuffle
    first = snap.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit)
    return first.withColumn("pos", F.col("_rn").cast("bigint") - 1).drop("_rn")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five overlapping snapshots per year with slightly moving stars.

    Every 11th customer appears twice inside a snapshot (second copy: one star
    less, next position); every 13th changes its creation day in the last
    snapshot (a name seen with two dates); every 97th has a malformed full
    name (two slashes).
    ``year, iteration, pos, name, url, stars, created_at``
    """
    c = _spread(read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_name", "c_acctbal"))
    ck = F.col("c_custkey")
    x = (c.withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit(4))))
         .where((ck + F.col("iteration")) % 7 != 0)
         .withColumn("dup", F.explode(F.sequence(F.lit(0), F.when(ck % 11 == 0, 1).otherwise(0)))))
    user = F.concat(F.lit("u"), _s(F.col("c_nationkey")))
    name = (F.when(ck % 97 == 0, F.concat(user, F.lit("/x/"), F.col("c_name")))
            .otherwise(F.concat(user, F.lit("/"), F.col("c_name"))))
    day = F.when((F.col("iteration") == 4) & (ck % 13 == 0), F.lit("29")).otherwise(F.lit("28"))
    return x.select(
        (F.lit(2013) + ck % 10).cast("int").alias("year"),
        F.col("iteration").cast("int").alias("iteration"),
        (ck * 2 + F.col("dup")).cast("long").alias("pos"),
        name.alias("name"),
        F.concat(F.lit("https://example.com/"), name, F.lit(".git")).alias("url"),
        (F.floor("c_acctbal") + (ck * F.col("iteration")) % 3 - F.col("dup")).cast("int").alias("stars"),
        F.concat(F.lit("20"), _s(F.lit(13) + ck % 10), F.lit("-10-"), day, F.lit("T13:19:39Z"))
        .alias("created_at"),
    )


# ------------------------------------------------------------------ triage module (one shape per rule)
# Annotations of the triage module: arguments a, b and the return take cases by p_partkey
# (their expected probes and shapes are written out in ``tyscope.plans.oracle``).
TRIAGE_CASES = [
    'int',
    'float',
    'Optional[str]',
    'Union[int, str]',
    'Union[List[int], bool]',
    'Union[List[int], Dict[str, int]]',
    'Literal[3]',
    'Literal["int"]',
    '"dict[str, int]"',
    '"str"',
    'typing.Optional[int]',
    'int | None',
    'List[int]',
    'None',
    '0',
    '3j',
    '-1',
    'not int',
    'int or str',
    '{str: int}',
    '[x for x in y]',
    'complex',
    'bool',
    'Literal[True]',
    'Literal[b"x"]',
    '"ERROR"',
    '""',
    'int if x else str',
    '"None"',
]

# case index of each slot, as a function of p_partkey
TRIAGE_A = (1, 0)    # a: (pk * 1 + 0) % n
TRIAGE_B = (7, 3)    # b: (pk * 7 + 3) % n
TRIAGE_R = (5, 1)    # return: (pk * 5 + 1) % n
TRIAGE_EXTRA_EVERY = 5  # pk % 5 == 0: one more required, unannotated argument ``c``


def triage_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One module per part with a fully annotated function whose annotations cycle
    through ``TRIAGE_CASES``; a method of the same name follows it.
    ``(repo_id int, path_rel string, content string)``"""
    p = _spread(read_table(spark, sf_dir, "part").select("p_partkey", "p_size"))
    pk = F.col("p_partkey")
    n = len(TRIAGE_CASES)
    texts = F.array(*[F.lit(c) for c in TRIAGE_CASES])

    def pick(mul_add):
        mul, add = mul_add
        return F.element_at(texts, ((pk * mul + add) % n).cast("int") + 1)

    extra = F.when(pk % TRIAGE_EXTRA_EVERY == 0, F.lit(", c")).otherwise(F.lit(""))
    content = F.concat(
        F.lit("def t"), _s(pk), F.lit("(a: "), pick(TRIAGE_A), extra, F.lit(", b: "), pick(TRIAGE_B),
        F.lit(" = None) -> "), pick(TRIAGE_R), F.lit(":\n"),
        F.lit("    return a\n"),
        F.lit("class K"), _s(pk), F.lit(":\n"),
        F.lit("    def t"), _s(pk), F.lit("(self):\n"),
        F.lit("        return 1\n"),
    )
    return p.select(F.col("p_size").cast("int").alias("repo_id"),
                    F.concat(F.lit("tri/t"), _s(pk), F.lit(".py")).alias("path_rel"),
                    content.alias("content"))


def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checker findings: all error events; a user's repository is three times the user id, so
    the repositories between are clean."""
    e = read_table(spark, sf_dir, "events")
    return (e.where(F.col("event_type") == "error")
            .select((F.col("user_id") * 3).cast("int").alias("repo_id"),
                    F.concat(F.lit("tri/t"), _s(F.col("event_id") % 97), F.lit(".py")).alias("path"),
                    F.floor("value").cast("int").alias("line"),
                    F.col("event_type").alias("code")))


OUTCOME_CLASSES = [
    "TypeError", "NameError", "NotImplementedError", "ImportError", "AttributeError", "ValueError", "RuntimeError",
    "UnboundLocalError", "SyntaxError", "FileNotFoundError", "IndexError", "KeyError", "ZeroDivisionError", "AssertionError",
    "ModuleNotFoundError", "RecursionError", "UnicodeError", "UnicodeDecodeError", "UnicodeEncodeError",
    "UnicodeTranslateError", "IndentationError", "TabError", "PythonFinalizationError", "OSError", "KeyboardInterrupt",
    "StopIteration", "MemoryError", "CustomError",
]


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded probe outcomes, one per event: every second one raised, by event_id one of
    the classes below; some that returned were not compared."""
    e = read_table(spark, sf_dir, "events")
    et, v, ev = F.col("event_type"), F.col("value"), F.col("event_id")
    classes = F.array(*[F.lit(c) for c in OUTCOME_CLASSES])
    exc = F.when(ev % 2 == 0, F.element_at(classes, ((ev / 2).cast("bigint") % len(OUTCOME_CLASSES)).cast("int") + 1))
    msg = F.when(v > 25, F.lit("t() missing 1 required positional argument: 'c'")) \
        .otherwise(F.lit("unsupported operand type(s)"))
    return e.select(
        F.col("event_id"),
        F.col("user_id").cast("int").alias("repo_id"),
        F.concat(F.lit("/srv/repos/u"), _s(F.col("user_id")), F.lit("/r"), _s(F.col("user_id")),
                 F.lit("/tri/t"), _s(F.col("event_id") % 97), F.lit(".py")).alias("file_path"),
        F.concat(F.lit("t"), _s(F.col("event_id") % 97)).alias("name"),
        exc.alias("exc_type"), msg.alias("message"),
        ((et == "view") & (v < 10)).alias("return_error"),
        F.when(ev % 9 != 1, v > 10).alias("matched"))
