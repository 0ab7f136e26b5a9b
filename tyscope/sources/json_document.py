"""Commit-log documents of any size (A8), read by many tasks.

A study document is one JSON object, usually on one line, whose keys each hold an array of
flat rows: ``{"module_commits": [[3, "a.py", "a.py", 2], ...], ...}``. A byte range of it does
not say whether it begins inside a string, nor below which key. So the documents are read
twice, in ranges that are planned by a Python data source:

1. every range reports the parity of its quotes, and the last key it opens, for both cases
   of beginning inside or outside a string;
2. the reports of the ranges before (a few bytes each, combined on the driver) say how a range
   begins; it then returns the rows that begin in it, reading on to the end of the last.

A row leaves Python as its JSON text, cut out of the bytes by array operations; Spark
parses it. Rows are flat; strings may hold any characters, quotes, brackets and escapes.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tyscope.session import list_files, ship_package

CHUNK_BYTES = 16 << 20
#: Bytes before a range that are read for escapes, key names and white space.
CONTEXT = 1 << 10
TAIL = 1 << 16
_QUOTE, _BACKSLASH, _OPEN, _CLOSE, _COLON = b'"\\[]:'
_WHITE = np.isin(np.arange(256), [9, 10, 13, 32])


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a folder or file as Spark lists it, and the path in it."""
    if uri.startswith("file:") or "://" not in uri:
        return pafs.LocalFileSystem(), re.sub("^file:/+", "/", uri)
    scheme, rest = uri.split("://", 1)
    host, _, path = rest.partition("/")
    fs, base = pafs.FileSystem.from_uri(f"{scheme}://{host}/")
    return fs, f"{base.rstrip('/')}/{path}"


class Range:
    """The bytes ``start`` to ``end`` of a document with some before and after."""

    def __init__(self, data: bytes, begin: int, end: int, whole_context: bool):
        #: begin and end of the range in ``data``; ``whole_context``: data begins with the document
        self.data = np.frombuffer(data, np.uint8)
        self.begin, self.end = begin, end
        q = np.flatnonzero(self.data == _QUOTE)
        back = np.flatnonzero(self.data == _BACKSLASH)
        if len(back) and len(q):
            first = np.concatenate([[True], np.diff(back) != 1])
            run_start = back[np.maximum.accumulate(np.where(first, np.arange(len(back)), 0))]
            at = np.searchsorted(back, q - 1)
            after = (at < len(back)) & (back[np.minimum(at, len(back) - 1)] == q - 1)
            length = np.where(after, q - run_start[np.minimum(at, len(back) - 1)], 0)
            q = q[length % 2 == 0]
        self.quotes = q

    @property
    def odd(self) -> bool:
        """Whether the range holds an odd number of quotes that begin or end strings."""
        return bool((np.searchsorted(self.quotes, self.end) - np.searchsorted(self.quotes, self.begin)) % 2)

    def _outside(self, pos: np.ndarray, inside_at_begin: bool) -> np.ndarray:
        before = np.searchsorted(self.quotes, pos) - np.searchsorted(self.quotes, self.begin)
        return (before + inside_at_begin) % 2 == 0

    def _before(self, pos: np.ndarray) -> np.ndarray:
        """The place of the last byte before each place that is no white space (-1: none)."""
        at = pos - 1
        while True:
            white = (at >= 0) & _WHITE[self.data[np.maximum(at, 0)]]
            if not white.any():
                return at
            at = at - white

    def openings(self, inside_at_begin: bool) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Where rows begin; where keys open their arrays, and the keys' names."""
        at = np.flatnonzero(self.data[self.begin:self.end] == _OPEN) + self.begin
        at = at[self._outside(at, inside_at_begin)]
        before = self._before(at)
        is_key = (before >= 0) & (self.data[np.maximum(before, 0)] == _COLON)
        names = []
        for colon in before[is_key].tolist():
            close = int(self._before(np.array([colon]))[0])
            k = int(np.searchsorted(self.quotes, close)) - 1
            names.append(self.data[self.quotes[k] + 1:close].tobytes().decode("utf-8", "replace") if k >= 0 else "")
        # before the first array of a document stands a key, so an opening without one begins a row
        return at[~is_key], at[is_key], names

    def last_key(self, inside_at_begin: bool) -> str | None:
        names = self.openings(inside_at_begin)[2]
        return names[-1] if names else None

    def row_ends(self, rows: np.ndarray, inside_at_begin: bool) -> np.ndarray:
        """The place after each row's closing bracket; 0 where the bytes end before it."""
        close = np.flatnonzero(self.data[self.begin:] == _CLOSE) + self.begin
        close = close[self._outside(close, inside_at_begin)]
        k = np.searchsorted(close, rows)
        return np.where(k < len(close), close[np.minimum(k, len(close) - 1)] + 1, 0) if len(close) else np.zeros(len(rows), np.int64)

    def texts(self, rows: np.ndarray, ends: np.ndarray) -> pa.Array:
        step = np.zeros(len(self.data) + 1, np.int8)
        step[rows] += 1
        step[ends] -= 1
        data = self.data[np.cumsum(step, dtype=np.int8)[:-1].astype(bool)]
        offsets = np.concatenate([[0], np.cumsum(ends - rows)]).astype(np.int32)
        return pa.Array.from_buffers(pa.string(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def read_range(uri: str, size: int, start: int, end: int, tail: int) -> Range:
    """A range with its context; the context grows until it holds a byte that is no backslash."""
    fs, path = open_store(uri)
    with fs.open_input_file(path) as f:
        context = CONTEXT
        while True:
            begin = max(0, start - context)
            data = f.read_at(min(size, end + tail) - begin, begin)
            if begin == 0 or data[:start - begin].strip(b"\\ \t\r\n"):
                return Range(data, start - begin, end - begin, begin == 0)
            context *= 8


class _Part(InputPartition):
    def __init__(self, ranges):
        super().__init__(0)
        self.ranges = ranges


class JsonRows(DataSource):
    """Options: ``files`` (JSON, [[uri, bytes], ...]), ``chunk`` (bytes of a range), ``task`` (bytes of
    a task's ranges), and for the second reading ``begins`` (JSON, per file and range: inside a
    string, last key) and ``key``."""

    @classmethod
    def name(cls):
        return "json_document_rows"

    def schema(self):
        if "begins" in self.options:
            return "file string, value string"
        return "file int, chunk int, odd boolean, key_if_outside string, key_if_inside string"

    def reader(self, schema):
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.files = json.loads(options["files"])
        self.chunk = int(options["chunk"])
        self.task = int(options["task"])
        self.begins = json.loads(options["begins"]) if "begins" in options else None
        self.key = options.get("key")

    def partitions(self):
        """Tasks of about equal bytes: a task takes ranges in order, of one file or several. It gets
        with each range what it needs, so that no list of all files or ranges goes to the tasks."""
        parts, now, held = [], [], 0
        for i, (uri, size) in enumerate(self.files):
            for c, start in enumerate(range(0, size, self.chunk)):
                end = min(size, start + self.chunk)
                if now and held + end - start > self.task:
                    parts.append(_Part(now))
                    now, held = [], 0
                now.append((i, c, start, end, uri, size, self.begins and self.begins[i][c]))
                held += end - start
        return parts + [_Part(now)]

    def __getstate__(self):
        return {"key": self.key}

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        for i, c, start, end, uri, size, begin in partition.ranges:
            if begin is None:
                r = read_range(uri, size, start, end, 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i], pa.int32()), pa.array([c], pa.int32()), pa.array([r.odd]),
                     pa.array([r.last_key(False)], pa.string()), pa.array([r.last_key(True)], pa.string())],
                    names=["file", "chunk", "odd", "key_if_outside", "key_if_inside"])
                continue
            inside, key = begin
            tail = TAIL
            while True:
                r = read_range(uri, size, start, end, tail)
                rows, keys, names = r.openings(inside)
                ends = r.row_ends(rows, inside)
                if not len(rows) or ends[-1] or end + tail >= size:
                    break
                tail *= 8
            named = np.array([key, *names], object)[np.searchsorted(keys, rows)]
            keep = np.flatnonzero((named == self.key) & (ends > 0))
            rows, ends = rows[keep], ends[keep]
            if len(rows):
                values = r.texts(rows, ends)
                yield pa.RecordBatch.from_arrays([pa.array([uri] * len(rows)), values], names=["file", "value"])


def document_rows(spark: SparkSession, path: str, key: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(file, value): the rows below ``key`` of all documents at ``path``, as JSON texts."""
    ship_package(spark)
    spark.dataSource.register(JsonRows)
    files = [f for f in list_files(spark, path) if f[1]]
    if not files:
        return spark.createDataFrame([], "file string, value string")
    # small ranges are put together, but never so many that cores are left without
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    task_bytes = max(chunk_bytes, min(CHUNK_BYTES, -(-sum(size for _, size in files) // tasks)))
    reader = (spark.read.format("json_document_rows").option("files", json.dumps(files)).option("chunk", str(chunk_bytes))
              .option("task", str(task_bytes)))
    begins = [[None] * -(-size // chunk_bytes) for _, size in files]
    inside, key_now, last = False, None, -1
    # one short row per range
    for r in reader.load().orderBy("file", "chunk").collect():
        if r.file != last:
            inside, key_now, last = False, None, r.file
        begins[r.file][r.chunk] = (inside, key_now)
        found = r.key_if_inside if inside else r.key_if_outside
        key_now, inside = found if found is not None else key_now, inside != r.odd
    return reader.option("begins", json.dumps(begins)).option("key", key).load()


def year_of(file: str):
    """The year in the name of a document's folder or file."""
    return F.regexp_extract(file, r"(?:year=|_)(\d{4})(?:/|\.json)", 1).try_cast("int")
