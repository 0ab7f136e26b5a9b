"""Incremental extraction of a growing source tree (Structured Streaming).

The study commits each year's rows in one batch, skips rows whose key is
already stored, and resumes after the last handled repository. Here a file
stream over the tree does the same: every micro-batch extracts only files not
seen before (the stream checkpoint records which), writes the extraction once,
and appends fact rows whose key is not in the tables yet. A retried batch
therefore adds nothing twice.

Stubs and modules meet in Spark's own state: paths are keyed by the module's path (folder
and stem); the state of a key is whether its module has come, and the stubs that wait
for it. A batch costs what its files cost, however many came before. Only paths and lengths
go through the stream; contents are read by the extraction tasks.

The file stream does not show names that begin with ``_`` or ``.`` (Spark's file sources hide
them); ``files.source_files`` does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from tyscope.operators.facts import extract_tables
from tyscope.schemas import ANNOTATION, ANNOTATION_KEY, FUNC_VAR, FUNC_VAR_KEY, MODULE, MODULE_KEY
from tyscope.sources import files as F_
from tyscope.session import delete_path, materialize, path_exists, qualified_path, scratch_scope, ship_package
from tyscope.sources.interchange import stage_rows
from tyscope.sources.keyed_table import compact_fact_table, load_fact_table

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_FILE = "path string, year int, user_name string, repo string, path_rel string, length bigint"
_COLUMNS = [c.split()[0] for c in _FILE.split(", ")]
BINARY_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def _previous(spark: SparkSession, folder: str, epoch: int) -> DataFrame | None:
    """What the batch before wrote below ``folder`` (a retried batch sees the same)."""
    path = f"{folder}/epoch={epoch - 1}"
    return spark.read.parquet(path) if epoch and path_exists(spark, path) else None


def _repositories(files: DataFrame, table_root: str, epoch: int) -> DataFrame:
    """Ids of all folders seen so far: known ones keep theirs, new ones follow."""
    spark, folder = files.sparkSession, f"{table_root}/_repositories"
    known = _previous(spark, folder, epoch)
    new = files.select(*F_.FOLDER).distinct()
    if known is not None:
        new = new.join(known.withColumnRenamed("name", "repo"), F_.FOLDER, "left_anti")
    last = None if known is None else known.agg(F.max("id")).first()[0]
    first = 0 if last is None else last + 1
    table = F_.folder_ids(new).withColumn("id", (F.col("id") + first).cast("int"))
    if known is not None:
        table = known.unionByName(table)
    table.write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")
    return spark.read.parquet(f"{folder}/epoch={epoch}")


class StubTwins(StatefulProcessor):
    """H5 as a state machine per module path: modules pass; stubs pass once their module came."""

    def init(self, handle):
        self.seen = handle.getValueState("seen", "came boolean")
        self.waiting = handle.getListState("waiting", _FILE)

    def handleInputRows(self, key, rows, timerValues):
        stubs, came = [], self.seen.exists()
        before = came
        for r in rows:
            row = Row(**{c: r[c] for c in _COLUMNS})
            if r["path"] == key[0]:
                came = True
                yield row
            else:
                stubs.append(row)
        if not came:
            if stubs:
                self.waiting.appendList([tuple(x) for x in stubs])
            return
        if not before:
            self.seen.update((True,))
            if self.waiting.exists():
                stubs = [Row(**dict(zip(_COLUMNS, x))) for x in self.waiting.get()] + stubs
                self.waiting.clear()
        yield from stubs

    def close(self):
        pass


def paired_files(files: DataFrame) -> DataFrame:
    """The files of a stream (columns of ``_FILE``) that H5 accepts, each once, when it can be accepted."""
    module = F.when(F.col("path").endswith(".pyi"), F.expr("substring(path, 1, length(path) - 1)")).otherwise(F.col("path"))
    return (files.select(*_COLUMNS, module.alias("module")).groupBy("module")
            .transformWithState(StubTwins(), _FILE, "append", "none"))


def _batch_handler(root: str, repository: DataFrame | None, table_root: str, unknown: str):
    def handle(batch: DataFrame, epoch: int) -> None:
        with scratch_scope(batch.sparkSession, f"stream-batch-{epoch}"):
            _load(batch, epoch)

    def _load(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        files = materialize(batch, "files")
        known = repository if repository is not None else _repositories(files, table_root, epoch)
        chosen = F_.attach_repo_id(files, known, unknown).select("repo_id", "path_rel", "path", "length")
        _, t = extract_tables(F_.with_contents(chosen, root))
        for name, df, schema, key in (("module", t.module, MODULE, MODULE_KEY),
                                      ("func_var", t.func_var, FUNC_VAR, FUNC_VAR_KEY),
                                      ("annotation", t.annotation, ANNOTATION, ANNOTATION_KEY)):
            load_fact_table(spark, stage_rows(df, schema), f"{table_root}/{name}", key, order=[])
            compact_fact_table(spark, f"{table_root}/{name}", schema, key)
        delete_path(spark, f"{table_root}/_repositories/epoch={epoch - 2}")

    return handle


def incremental_extraction(spark: SparkSession, root: str, table_root: str, checkpoint: str,
                           repository: DataFrame | None = None, max_files_per_trigger: int = 100_000,
                           available_now: bool = True, unknown: str = "fail") -> StreamingQuery:
    """Start the stream; with ``available_now`` it handles every new file and stops. ``unknown``: what
    a folder without a repository row does (``files.attach_repo_id``)."""
    reader = (spark.readStream.format("binaryFile").schema(BINARY_SCHEMA)
              .option("recursiveFileLookup", "true")
              .option("pathGlobFilter", "*.{py,pyi}"))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    ship_package(spark)
    base = qualified_path(spark, root)
    files = F_.with_layout(reader.load(root).select("path", "length"), base).where(F_.python_file() & F_.not_ignored())
    files = files.withColumn("path", F.substring("path", F.lit(len(base) + 2), F.length("path")))  # below the root
    writer = (paired_files(files).writeStream.foreachBatch(_batch_handler(root, repository, table_root, unknown))
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    # the state needs this provider; a query keeps the settings it was started with
    kept = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return writer.start()
    finally:
        if kept is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, kept)
