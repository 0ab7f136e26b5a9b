"""Source files (A4, B6, C2-C4, H4, H5): a loose tree or a packed table.

Layout of the paths: ``<year>/<user>/<repo>/**/*.py|*.pyi``, below a root folder, or as
the ``path`` column of a packed table (``path, content``).

Plan shape of a tree:

* Folders are listed by tasks, level by level: a level's folders are the next level's
  input, and only whether there are more is known to the driver. Ignored folders are
  not entered.
* Paths and lengths pass the rules: ignored-folder filter, repository id by a join with the
  repository table, ``.pyi`` stubs by a semi join with the module paths.
* The files that are left stand in path order and are cut by the running sum of their bytes
  into tasks of equal size; only then contents are read, by the task that parses them.

Nothing vanishes silently: a file that cannot be read has null content (a reject), and a
folder without a repository row fails the job unless ``unknown="drop"`` is asked for
(``missing_repos`` lists those folders).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tyscope.operators.windows import numbered, running_sum
from tyscope.session import materialize, qualified_path, ship_package
from tyscope.sources.json_document import open_store

# Folders skipped at any depth below a repository root.
IGNORED_DIRS = ["mypy", "python2.6"]

#: Folders between the root and a repository's own files: year, user, repository.
REPO_DEPTH = 3
#: Bytes of source text per extraction task at most, and what opening a file counts for.
TASK_BYTES = 32 << 20
OPEN_BYTES = 16 << 10
#: Bytes of contents in one Arrow batch.
BATCH_BYTES = 8 << 20


# ------------------------------------------------------------------ listing by tasks (A4)
def _lister(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_store(root)
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                at = f"{base.rstrip('/')}/{folder}" if folder else base
                found = fs.get_file_info(pafs.FileSelector(at, recursive=False, allow_not_found=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"{folder}/{f.base_name}" if folder else f.base_name for f in found], pa.string()),
                     pa.array([f.type == pafs.FileType.Directory for f in found], pa.bool_()),
                     pa.array([f.size or 0 for f in found], pa.int64())], names=["path", "is_dir", "length"])
    return run


def tree_listing(spark: SparkSession, root: str) -> DataFrame:
    """``(path, length)`` of the Python files below ``root``, paths relative to it, listed by tasks;
    hidden files and names that begin with an underscore count like any other."""
    ship_package(spark)
    run = _lister(qualified_path(spark, root))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    level, depth, levels = spark.range(1).select(F.lit("").alias("path")), 0, []
    while True:
        found = materialize(level.mapInArrow(run, "path string, is_dir boolean, length bigint"), f"tree-level-{depth}")
        levels.append(found.where(~F.col("is_dir") & (F.col("path").endswith(".py") | F.col("path").endswith(".pyi"))))
        depth += 1
        level = found.where("is_dir")
        if depth > REPO_DEPTH:
            level = level.where(~F.substring_index("path", "/", -1).isin(IGNORED_DIRS))
        if level.isEmpty():
            break
        # a level comes from few tasks when the one above had few folders: deal it out
        level = level.select("path").repartition(tasks, "path")
    listed = levels[0]
    for found in levels[1:]:
        listed = listed.unionByName(found)
    return listed.select("path", "length")


def balanced(files: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """``files`` (path, length, ...) dealt out in path order over tasks of about equal bytes: a task
    begins where the running sum of the lengths passes a multiple of its share."""
    spark = files.sparkSession
    weighed = files.withColumn("_bytes", F.col("length") + OPEN_BYTES)
    placed = running_sum(weighed, ["path"], "_bytes", "_before")
    total = placed.agg(F.max(F.col("_before") + F.col("_bytes"))).first()[0] or 1
    share = max(1, min(task_bytes, -(-total // spark.sparkContext.defaultParallelism)))
    # the middle of a file decides, so that a large file pulls its neighbours neither way
    task = F.floor((F.col("_before") + F.col("_bytes") / 2) / share).cast("int")
    return placed.withColumn("_task", task).repartitionById(-(-total // share), "_task").drop("_task", "_before", "_bytes")


def _reader(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_store(root)
        for batch in batches:
            repo, rel, path = (batch.column(c) for c in ("repo_id", "path_rel", "path"))
            first, held, contents = 0, 0, []
            for i, name in enumerate(path.to_pylist()):
                try:
                    with fs.open_input_file(f"{base.rstrip('/')}/{name}") as f:
                        contents.append(f.read())
                except OSError:  # gone or not readable: a reject
                    contents.append(None)
                held += len(contents[-1] or b"")
                if held >= BATCH_BYTES or i + 1 == batch.num_rows:
                    n = len(contents)
                    yield pa.RecordBatch.from_arrays([repo.slice(first, n), rel.slice(first, n), pa.array(contents, pa.binary())],
                                                     names=["repo_id", "path_rel", "content"])
                    first, held, contents = first + n, 0, []
    return run


def with_layout(files: DataFrame, root: str | None = None) -> DataFrame:
    """B6 + path split: year, user_name, repo, path_rel, file, dirs (folders below the repo).

    ``root``: the folder as the file system lists it (``qualified_path``); a path that is
    not below it fails the job. None: the paths are relative already (packed tables)."""
    rel = F.col("path")
    if root is not None:
        rel = (F.when(F.startswith("path", F.lit(root + "/")), F.substring("path", F.lit(len(root) + 2), F.length("path")))
               .otherwise(F.raise_error(F.concat(F.lit(f"not below {root}: "), F.col("path")))))
    n = F.size("_parts")
    return (files
            .withColumn("_parts", F.split(rel, "/"))
            .withColumn("year", F.element_at("_parts", 1).try_cast("int"))
            .withColumn("user_name", F.get("_parts", F.lit(1)))
            .withColumn("repo", F.get("_parts", F.lit(2)))
            .withColumn("path_rel", F.array_join(F.slice("_parts", 4, F.greatest(n - 3, F.lit(0))), "/"))
            .withColumn("file", F.element_at("_parts", -1))
            .withColumn("dirs", F.slice("_parts", 4, F.greatest(n - 4, F.lit(0))))
            .where(n >= 4)
            .drop("_parts"))


def python_file(file_col: str = "file"):
    """Case-sensitive ``.py`` / ``.pyi`` suffix."""
    return F.col(file_col).endswith(".py") | F.col(file_col).endswith(".pyi")


def not_ignored(dirs_col: str = "dirs"):
    """No folder below the repository root is named exactly like an ignored one."""
    return ~F.arrays_overlap(F.col(dirs_col), F.array(*[F.lit(d) for d in IGNORED_DIRS]))


def keep_stubs_with_twin(stubs: DataFrame, py_paths: DataFrame, kind: str = "left_semi") -> DataFrame:
    """H5: a ``.pyi`` stays only if ``<stem>.py`` exists in the same folder
    (``left_anti``: the others)."""
    twin = F.expr("substring(path, 1, length(path) - 1)")
    return (stubs.withColumn("_twin", twin)
            .join(py_paths.select(F.col("path").alias("_twin")), "_twin", kind).drop("_twin"))


FOLDER = ["year", "user_name", "repo"]


def attach_repo_id(files: DataFrame, repository: DataFrame, unknown: str = "fail") -> DataFrame:
    """H4: repository id of each file's (year, user, repo) folder. A folder without a repository
    row fails the job (``unknown="fail"``) or drops out (``"drop"``)."""
    if unknown not in ("fail", "drop"):
        raise ValueError(f"unknown: 'fail' or 'drop', not {unknown!r}")
    r = (repository.groupBy("year", "user_name", F.col("name").alias("repo"))
         .agg(F.min("id").alias("repo_id")))  # one id per folder: the first repository row
    if unknown == "drop":
        return files.join(r, FOLDER, "inner")
    folder = F.concat_ws("/", F.col("year").cast("string"), "user_name", "repo")
    found = F.when(F.col("repo_id").isNotNull(), F.col("repo_id")).otherwise(
        F.raise_error(F.concat(F.lit("no repository row for folder "), folder)).cast("int"))
    return files.join(r, FOLDER, "left").withColumn("repo_id", found)


def folder_ids(files: DataFrame) -> DataFrame:
    """A repository table for files that have none: ids from 0 over their folders."""
    ids = numbered(files.select(*FOLDER), FOLDER, "id")
    return ids.select(F.col("id").cast("int").alias("id"), "year", "user_name", F.col("repo").alias("name"))


def missing_repos(files: DataFrame, repository: DataFrame) -> DataFrame:
    """H4 report: repository folders with no repository row (the study aborts on these)."""
    r = repository.select("year", "user_name", F.col("name").alias("repo"))
    return files.select(*FOLDER).distinct().join(r, FOLDER, "left_anti")


def select_sources(raw: DataFrame, repository: DataFrame | None = None, unknown: str = "fail",
                   carry: tuple[str, ...] = ("content",)) -> DataFrame:
    """``repo_id``, ``path_rel`` and the ``carry`` columns of the accepted files among ``with_layout`` rows."""
    # the suffix is asked of the path, so that other rows go before their path is split
    py = raw.where(F.col("path").endswith(".py")).where(not_ignored())
    stubs = keep_stubs_with_twin(raw.where(F.col("path").endswith(".pyi")).where(not_ignored()), py.select("path"))
    cols = [*FOLDER, "path_rel", *carry]
    files = py.select(*cols).unionByName(stubs.select(*cols))
    if repository is None:
        repository = folder_ids(raw.where(python_file("path")).where(not_ignored()))
    return attach_repo_id(files, repository, unknown).select("repo_id", "path_rel", *carry)


def source_files(spark: SparkSession, root: str, repository: DataFrame | None = None, unknown: str = "fail",
                 task_bytes: int = TASK_BYTES) -> DataFrame:
    """A4: ``(repo_id, path_rel, content)`` for every accepted file under ``root``, in tasks of equal bytes.

    Without a repository table each (year, user, repo) folder gets an id of its own.
    """
    chosen = select_sources(with_layout(tree_listing(spark, root)), repository, unknown, ("path", "length"))
    return with_contents(chosen, root, task_bytes)


def with_contents(files: DataFrame, root: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """``(repo_id, path_rel, content)`` of files (repo_id, path_rel, path, length), read by tasks of equal bytes."""
    spark = files.sparkSession
    ship_package(spark)
    return balanced(files, task_bytes).mapInArrow(_reader(qualified_path(spark, root)),
                                                  "repo_id int, path_rel string, content binary")


def packed_source_files(packed: DataFrame, repository: DataFrame | None = None, unknown: str = "fail") -> DataFrame:
    """A4 over a packed table: ``path`` (relative to the root) and ``content``.

    The accepted files are dealt out over four tasks per core, or as many as a shuffle has: texts
    compress well, so a split of the table, and what the stubs' join leaves in a partition, would be
    few tasks of long parses."""
    spark = packed.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return select_sources(with_layout(packed.select("path", "content")), repository, unknown).repartition(tasks, "repo_id", "path_rel")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """Paths and sizes only (no content is read)."""
    return with_layout(tree_listing(spark, root))


# ------------------------------------------------------------------ writing a tree (test data)
def _writer(root: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_store(root)
        for batch in batches:
            d = batch.to_pydict()
            sizes = []
            for rel, text in zip(d["rel_path"], d["content"]):
                data = text.encode("utf-8") if isinstance(text, str) else bytes(text)
                target = f"{base.rstrip('/')}/{rel}"
                fs.create_dir(target.rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(target) as f:
                    f.write(data)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(d["rel_path"], pa.string()),
                                              pa.array(sizes, pa.int64())], ["rel_path", "bytes"])

    return write


def write_tree(files: DataFrame, root: str) -> int:
    """Write ``(rel_path, content)`` rows as files below ``root`` from the executors
    (Arrow file systems: local, HDFS, S3, GCS). Returns the number of files."""
    ship_package(files.sparkSession)
    uri = qualified_path(files.sparkSession, root)
    out = files.select("rel_path", "content").mapInArrow(_writer(uri), "rel_path string, bytes long")
    return out.count()
