"""Benchmark decontamination with suffix arrays of the training text.

Every Spark task cuts its documents into shards of bounded size and sorts the suffixes
of each shard (prefix doubling over word symbols). Every suffix of every benchmark item
is binary-searched in the shard; its neighbours give the longest verbatim match and its
place. Where the match reaches a window (``window`` consecutive words of the item, or
the whole of a shorter item), the range of suffixes that begin with the window gives
all its places, and the words there are hit.

Words are compared by a 64-bit hash. A shard's symbols are the places of its own words, so
its suffixes are sorted once, whatever it is searched for. A test word that the shard does
not have matches nothing, so that a test suffix ends there.

The benchmark is a stated query set. Spark deals its items out over blocks of about
``block_bytes`` and writes each block's words to the shared folder; a task reads one block
after the other for every shard it sorts. No part of the benchmark passes through the
driver, none is broadcast, and the documents are not shuffled.

Cases: null or empty texts have no words; items without words have no window; items
with one item_id count as one item (repeated rows of it are read once), a null item_id is written as an empty string; an
empty benchmark hits nothing; an empty table gives an empty result; rows are judged one
by one, so repeated rows and null ids need no care; other columns are kept, and helper
columns carry the prefix ``_hit_``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tyscope.llm.common import ALNUM_SEP_TABLE, LOWER_TABLE, Words, concat_ranges, text_buffer, text_runs
from tyscope.session import qualified_path, scratch_path, ship_package
from tyscope.sources.json_document import open_store

WINDOW = 10
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 3 << 20


class Block(NamedTuple):
    """Some items: their vocabulary and the symbols of their words, each item closed by 0."""

    vocabulary: np.ndarray  # sorted word hashes; the symbol is the position plus 1
    symbols: np.ndarray
    item: np.ndarray        # item number of every symbol
    left: np.ndarray        # words from the symbol to its item's end
    first: np.ndarray       # whether the symbol begins its item
    ids: list[str]


def _closed(words: Words, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols with a 0 after each text, and the text of every symbol."""
    counts = np.diff(words.first)
    text = np.repeat(np.arange(len(counts)), counts)
    out = np.zeros(len(symbols) + len(counts), np.int64)
    out[np.arange(len(symbols)) + text] = symbols
    return out, np.repeat(np.arange(len(counts)), counts + 1)


#: A block as written: the numpy arrays' bytes, and the words of its longest item.
BLOCK_SCHEMA = "block int, ids array<string>, vocabulary binary, symbols binary, words binary, longest bigint"


def _block_row(group: pa.Table) -> pa.Table:
    """The row of a block's items (block, item_id, text)."""
    buf, off = text_buffer(group.column("text").combine_chunks())
    words = Words(LOWER_TABLE[buf], off, ALNUM_SEP_TABLE)
    vocabulary, symbols = np.unique(words.hashes(), return_inverse=True)
    counts = np.diff(words.first).astype(np.int64)
    symbols, _ = _closed(words, symbols + 1)
    return pa.table({"block": pa.array([group.column("block")[0].as_py()], pa.int32()),
                     "ids": pa.array([group.column("item_id").to_pylist()], pa.list_(pa.string())),
                     "vocabulary": pa.array([vocabulary.astype("<u8").tobytes()], pa.binary()),
                     "symbols": pa.array([symbols.astype("<i4").tobytes()], pa.binary()),
                     "words": pa.array([counts.astype("<i8").tobytes()], pa.binary()),
                     "longest": pa.array([int(counts.max())], pa.int64())})


class Blocks:
    """The benchmark's blocks in the shared folder, as a task reads them."""

    def __init__(self, folder: str, count: int, longest: int):
        self.folder, self.count, self.longest = folder, count, longest

    def read(self, number: int) -> Block | None:
        fs, base = open_store(f"{self.folder}/block={number}")
        for f in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)):
            if f.is_file and f.base_name.endswith(".parquet"):
                with fs.open_input_file(f.path) as source:
                    row = pq.ParquetFile(source).read().to_pylist()[0]
                counts = np.frombuffer(row["words"], "<i8")
                item = np.repeat(np.arange(len(counts)), counts + 1)
                end = np.cumsum(counts + 1) - 1  # of each item, its closing 0
                at = np.arange(len(item))
                return Block(np.frombuffer(row["vocabulary"], "<u8"), np.frombuffer(row["symbols"], "<i4").astype(np.int64),
                             item, end[item] - at, at == (end - counts)[item], row["ids"])
        return None  # no item fell into it

    def rounds(self) -> Iterator[Iterator[Block]]:
        """All blocks, again and again; every other time from the last one, which is still there."""
        held: tuple[int, Block | None] = (-1, None)
        order = range(self.count)

        def one_round():
            nonlocal held
            for number in order:
                if held[0] != number:
                    held = (number, self.read(number))
                if held[1] is not None:
                    yield held[1]

        while True:
            yield one_round()
            order = order[::-1]


def write_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Blocks:
    """The items (item_id, text) dealt out by hash over blocks of about ``block_bytes``, written to
    the shared folder. The driver learns the number of blocks and the longest item's words."""
    spark = benchmark.sparkSession
    ship_package(spark)
    size, rows = benchmark.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    if not rows:
        return Blocks("", 0, 0)
    count = 1 + (size or 0) // block_bytes
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").distinct()
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(count)).cast("int"))
    path = scratch_path(spark, "benchmark-blocks")
    dealt.groupBy("block").applyInArrow(_block_row, BLOCK_SCHEMA).write.partitionBy("block").parquet(path)
    return Blocks(qualified_path(spark, path), count, spark.read.parquet(path).agg(F.max("longest")).first()[0])


class Packed:
    """Symbols packed several to a number, so that comparing numbers compares runs of
    symbols; what follows a 0 counts as 0."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.per, self.bits = max(1, 63 // bits), bits
        n = len(symbols)
        zero = np.flatnonzero(symbols == 0)
        self.end = zero[np.searchsorted(zero, np.arange(n))] if n else zero
        padded = np.concatenate([symbols, np.zeros(self.per, np.int64)])
        self.key = np.zeros(n + self.per, np.int64)
        alive = np.ones(n, bool)
        for j in range(self.per):
            s = padded[j:n + j]
            alive &= s > 0
            self.key[:n] = self.key[:n] << bits | np.where(alive, s, 0)

    def mask(self, words: np.ndarray) -> np.ndarray:
        """Bits of the first ``words`` symbols of a packed number."""
        return -1 << ((self.per - np.minimum(words, self.per)) * self.bits)


def suffix_array(symbols: np.ndarray, packed: Packed, depth: int) -> np.ndarray:
    """Suffixes that begin with a symbol, ordered by their first ``depth`` symbols at least."""
    n = len(symbols)
    pos = np.flatnonzero(symbols)
    sa = pos[np.argsort(packed.key[pos], kind="stable")]
    key = packed.key[sa]
    new = np.concatenate([[True], key[1:] != key[:-1]]) if len(sa) else np.zeros(0, bool)
    rank = np.zeros(n + 1, np.int64)
    d = packed.per
    while d < depth:
        tied = ~new
        tied[:-1] |= ~new[1:]
        if not tied.any():
            break
        rank[sa] = np.cumsum(new)
        sub = sa[tied]
        after = np.where(sub + d < packed.end[sub], rank[np.minimum(sub + d, n)], 0)
        key = rank[sub] * (n + 2) + after
        order = np.argsort(key, kind="stable")
        sa[tied] = sub[order]
        key = key[order]
        new[tied] = np.concatenate([[True], key[1:] != key[:-1]])
        d *= 2
    return sa


def _compare(a: Packed, at: np.ndarray, b: Packed, bt: np.ndarray, words: np.ndarray | None) -> np.ndarray:
    """Sign of suffix ``at`` of a against suffix ``bt`` of b, over ``words`` symbols if given."""
    sign = np.zeros(len(at), np.int8)
    todo = np.arange(len(at))
    low = (1 << a.bits) - 1
    while len(todo):
        x, y = a.key[at], b.key[bt]
        if words is not None:
            m = a.mask(words)
            x, y = x & m, y & m
        s = (x > y).astype(np.int8) - (x < y).astype(np.int8)
        sign[todo] = s
        on = (s == 0) & (x & low != 0)
        if words is not None:
            on &= words > a.per
            words = words[on] - a.per
        todo, at, bt = todo[on], at[on] + a.per, bt[on] + a.per
    return sign


def _search(a: Packed, at: np.ndarray, b: Packed, sa: np.ndarray, words: np.ndarray | None, past_equal: bool) -> np.ndarray:
    """Place of each suffix of a among the sorted suffixes of b."""
    lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(sa), np.int64)
    while True:
        todo = np.flatnonzero(lo < hi)
        if not len(todo):
            return lo
        mid = (lo[todo] + hi[todo]) >> 1
        sign = _compare(a, at[todo], b, sa[mid], None if words is None else words[todo])
        right = sign >= 0 if past_equal else sign > 0
        lo[todo[right]] = mid[right] + 1
        hi[todo[~right]] = mid[~right]


def _common(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of suffixes (both texts end in 0)."""
    n = np.zeros(len(at), np.int64)
    todo = np.arange(len(at))
    while len(todo):
        same = a[at[todo] + n[todo]] == b[bt[todo] + n[todo]]
        same &= a[at[todo] + n[todo]] != 0
        todo = todo[same]
        n[todo] += 1
    return n


class Shard:
    """The suffix array of a run of texts, in symbols of its own; suffixes that agree in their
    first ``depth`` words stand in any order."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, depth: int):
        self.words = Words(LOWER_TABLE[buf], offsets, ALNUM_SEP_TABLE)
        self.vocabulary, symbols = np.unique(self.words.hashes(), return_inverse=True)
        self.symbols, self.text = _closed(self.words, symbols + 1)
        self.bits = max(1, int(len(self.vocabulary)).bit_length())
        self.packed = Packed(self.symbols, self.bits)
        self.sa = suffix_array(self.symbols, self.packed, depth)

    def position(self, place: np.ndarray) -> np.ndarray:
        """Word position inside its text of positions in symbols."""
        return place - self.text[place] - self.words.first[self.text[place]]


class Search:
    """Every suffix of a block's items in a shard: its longest match, and a place of it."""

    def __init__(self, shard: Shard, block: Block):
        self.shard, self.block = shard, block
        voc = shard.vocabulary
        at = np.minimum(np.searchsorted(voc, block.vocabulary), max(0, len(voc) - 1))
        known = np.where(voc[at] == block.vocabulary, at + 1, 0) if len(voc) else np.zeros(len(block.vocabulary), np.int64)
        symbols = np.concatenate([[0], known])[block.symbols]
        self.query = Packed(symbols, shard.bits)
        self.suffix = np.flatnonzero(symbols)
        self.length = np.zeros(len(self.suffix), np.int64)
        self.match = np.zeros(len(self.suffix), np.int64)
        if len(self.suffix):
            sa = shard.sa
            place = _search(self.query, self.suffix, shard.packed, sa, None, False)
            for near in (place - 1, place):
                ok = np.flatnonzero((near >= 0) & (near < len(sa)))
                n = _common(symbols, self.suffix[ok], shard.symbols, sa[near[ok]])
                up = n > self.length[ok]
                self.length[ok[up]] = n[up]
                self.match[ok[up]] = sa[near[ok[up]]]

    def hits(self, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All places of all windows: position in symbols, words, item."""
        b, sa = self.block, self.shard.sa
        left = b.left[self.suffix]
        # a window: ``window`` words ahead, or a whole shorter item
        need = np.where(left >= window, window, np.where(b.first[self.suffix], left, np.iinfo(np.int64).max))
        found = np.flatnonzero(self.length >= need)
        at, need = self.suffix[found], need[found]
        lo = _search(self.query, at, self.shard.packed, sa, need, False)
        hi = _search(self.query, at, self.shard.packed, sa, need, True)
        places = sa[concat_ranges(lo, hi - lo)]
        return places, np.repeat(need, hi - lo), np.repeat(b.item[at], hi - lo)


def _add_hits(shard: Shard, block: Block, window: int, starts: list[list], ends: list[list], items: list[list]) -> None:
    """Adds a block's hits to the lists of the shard's texts: touching stretches as one, and item ids."""
    place, need, item = Search(shard, block).hits(window)
    if not len(place):
        return
    row, pos = shard.text[place], shard.position(place)
    order = np.lexsort((pos, row))
    r, s, e = row[order], pos[order], pos[order] + need[order]
    key = r * (int(e.max()) + 1)
    reach = np.maximum.accumulate(key + e)
    cut = np.flatnonzero(np.concatenate([[True], key[1:] + s[1:] > reach[:-1]]))
    last = np.append(cut[1:], len(r)) - 1
    for k, x, y in zip(r[cut].tolist(), s[cut].tolist(), (reach[last] - key[last]).tolist()):
        starts[k].append(x)
        ends[k].append(y)
    pairs = np.unique(row * len(block.ids) + item)
    for k, t in zip((pairs // len(block.ids)).tolist(), (pairs % len(block.ids)).tolist()):
        if block.ids[t] not in items[k]:
            items[k].append(block.ids[t])


def _hit_batches(batches: Iterator[pa.RecordBatch], blocks: Blocks, window: int, shard_bytes: int) -> Iterator[pa.RecordBatch]:
    """Adds the hit columns to batches with a column text."""
    rounds = blocks.rounds()
    ints = pa.list_(pa.int32())
    for b in batches:
        for i, j, buf, off in text_runs(b.column("text"), shard_bytes):
            shard = Shard(buf, off, blocks.longest)
            starts, ends, items = ([[] for _ in range(j - i)] for _ in range(3))
            for block in next(rounds):
                _add_hits(shard, block, window, starts, ends, items)
            yield pa.RecordBatch.from_arrays(
                [*(c.slice(i, j - i) for c in b.columns), pa.array(starts, ints), pa.array(ends, ints),
                 pa.array(items, pa.list_(pa.string())), pa.array(np.diff(shard.words.first))],
                [*b.schema.names, "_hit_starts", "_hit_ends", "_hit_items", "_hit_words"])


def with_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
              shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` with _hit_words (words of the text), _hit_starts and _hit_ends (hit stretches
    in words; those of different blocks may overlap) and _hit_items (ids of the items hit)."""
    blocks = write_blocks(benchmark, block_bytes)
    added = (("_hit_starts", T.ArrayType(T.IntegerType())), ("_hit_ends", T.ArrayType(T.IntegerType())),
             ("_hit_items", T.ArrayType(T.StringType())), ("_hit_words", T.LongType()))
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema]
                          + [T.StructField(name, kind, True) for name, kind in added])
    return docs.mapInArrow(lambda it: _hit_batches(it, blocks, window, shard_bytes), schema)


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n_hit, n_items, sha = [], [], []
        for starts, ends, items in zip(*(b.column(f"_hit_{c}").to_pylist() for c in ("starts", "ends", "items"))):
            reach = total = 0
            for s, e in sorted(zip(starts, ends)):
                total += max(0, e - max(s, reach))
                reach = max(reach, e)
            n_hit.append(total)
            n_items.append(len(items))
            sha.append(hashlib.sha256(",".join(sorted(items)).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("_hit_words"), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()),
             pa.array(sha, pa.string()), pa.array([n > 0 for n in n_hit], pa.bool_())],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row."""
    return with_hits(docs.select("doc_id", "text"), benchmark, **options).drop("text").mapInArrow(
        _digest_batches, "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that hold a window of the benchmark."""
    return with_hits(docs, benchmark, **options).where(F.size("_hit_starts") == 0).select(*docs.columns)


def longest_matches(docs: DataFrame, benchmark: DataFrame, min_words: int = WINDOW, block_bytes: int = BLOCK_BYTES,
                    shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """For every test suffix (item_id, item_word) whose longest verbatim match has
    ``min_words`` or more: n_words and one place (doc_id, doc_word; the smallest doc_id of
    those the shards report)."""
    blocks = write_blocks(benchmark, block_bytes)

    def search(batches):
        rounds = blocks.rounds()
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            for i, _, buf, off in text_runs(b.column("text"), shard_bytes):
                shard = Shard(buf, off, blocks.longest)
                for block in next(rounds):
                    found = Search(shard, block)
                    k = np.flatnonzero(found.length >= min_words)
                    at, place = found.suffix[k], found.match[k]
                    item = block.item[at]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([block.ids[t] for t in item], pa.string()), pa.array(at - np.flatnonzero(block.first)[item]),
                         pa.array(found.length[k]), pa.array([ids[i + r] for r in shard.text[place]], pa.int64()),
                         pa.array(shard.position(place))], ["item_id", "item_word", "n_words", "doc_id", "doc_word"])

    found = docs.select("doc_id", "text").mapInArrow(search, "item_id string, item_word bigint, n_words bigint, doc_id bigint, doc_word bigint")
    best = F.max_by(F.struct("doc_id", "doc_word"), F.struct("n_words", -F.col("doc_id"), -F.col("doc_word")))
    return (found.groupBy("item_id", "item_word").agg(F.max("n_words").alias("n_words"), best.alias("p"))
            .select("item_id", "item_word", "n_words", "p.doc_id", "p.doc_word"))
