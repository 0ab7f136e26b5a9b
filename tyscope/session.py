"""Session helpers.

The cluster names its shared checkpoint folder in ``spark.checkpoint.dir``;
we read it from the session and only fall back to a scratch folder of our
own when it is unset and the master is local (tests).
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

# Defaults for a local run; on a cluster the submitter's values win because
# ``getOrCreate`` keeps an existing session untouched.
_LOCAL_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # source files are small and many: pack more of them per scan task
    "spark.sql.files.openCostInBytes": str(64 * 1024),
    # whole source files travel in Arrow batches: keep batches small
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
}


def get_session(master: str | None = None, app: str = "tyscope",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """The active session untouched if there is one (a cluster submitter's settings
    win); otherwise a new session with the local defaults above."""
    active = SparkSession.getActiveSession()
    if active is not None:
        checkpoint_dir(active)
        return active
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(_LOCAL_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: ``spark.checkpoint.dir``, else what the application set
    with ``setCheckpointDir``. A local master gets a scratch folder of its own; on a cluster
    an unset folder is an error, since executors would write to their own disks."""
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        d = sc.getCheckpointDir()
    if not d:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="tyscope-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


_SCOPE = threading.local()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder (never machine-local on a cluster)."""
    folder = getattr(_SCOPE, "folder", None) or f"{checkpoint_dir(spark).rstrip('/')}/tyscope/{spark.sparkContext.applicationId}"
    return f"{folder}/{name}-{uuid.uuid4().hex[:12]}"


@contextlib.contextmanager
def scratch_scope(spark: SparkSession, name: str):
    """Intermediate tables made inside are deleted at the end; what they were made for must
    have been written by then."""
    outer, folder = getattr(_SCOPE, "folder", None), scratch_path(spark, name)
    _SCOPE.folder = folder
    try:
        yield
    finally:
        _SCOPE.folder = outer
        delete_path(spark, folder)


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file_system(spark, path)
    return fs.exists(p)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names directly below a folder; none if it does not exist."""
    fs, p = _file_system(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def list_files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Path and bytes of the files at or below a path, in order of path (a driver listing, for
    folders of few large files); hidden ones (``_`` or ``.`` first) are left out."""
    fs, p = _file_system(spark, path)
    found, walk = [], fs.listFiles(p, True)
    while walk.hasNext():
        f = walk.next()
        if f.getPath().getName()[0] not in "_.":
            found.append((f.getPath().toString(), f.getLen()))
    return sorted(found)


def qualified_path(spark: SparkSession, path: str) -> str:
    """A path as the file system lists it, with scheme and host, without a final slash."""
    fs, p = _file_system(spark, path)
    return fs.makeQualified(p).toString().rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    fs, p = _file_system(spark, path)
    fs.delete(p, True)


def release_scratch(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application. Results that are still to be
    read must have been read or written elsewhere before."""
    base = checkpoint_dir(spark).rstrip("/")
    delete_path(spark, f"{base}/tyscope/{spark.sparkContext.applicationId}")


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Cut lineage by writing ``df`` as parquet to the shared folder and reading it back.

    Survives executor loss (unlike caching or local checkpoints) and lets later
    stages start from a compact columnar copy. ``partition_by`` folders let
    readers that filter on those columns skip the other folders entirely.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.parquet(path)


@contextlib.contextmanager
def shuffle_files_let_go(spark: SparkSession):
    """Shuffle files of the queries run inside go as soon as each query has ended, not when the
    driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tyscope`` importable in executor Python workers (once per application).

    Operators that run Python on executors (the extraction job, the tree writer)
    call this; the package is zipped on the driver and distributed by Spark
    like ``--py-files``.
    """
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    parent = os.path.dirname(pkg_dir)
    zip_path = os.path.join(tempfile.mkdtemp(prefix="tyscope-pyfiles-"), "tyscope.zip")
    with zipfile.ZipFile(zip_path, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, names in os.walk(pkg_dir):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(root, n)
                    z.write(full, os.path.relpath(full, parent))
    sc.addPyFile(zip_path)
    _SHIPPED.add(sc.applicationId)
