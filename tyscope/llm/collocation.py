"""Phrase collocation mining in two passes, with mergeable Misra-Gries summaries per hash partition.

All n-grams of up to ``max_words`` words are dealt by a hash over partitions whose number grows
with the text, so that each has a bounded mass (number of occurrences).

1. Tasks count the n-grams of a run of text exactly and send every hash partition its hashes
   with counts. A partition merges what arrives into a Misra-Gries summary: when it has more
   than its capacity of counters, the largest count beyond the capacity is taken off all of
   them. With a capacity of ``SPARE`` times mass / threshold, less than threshold / SPARE is
   ever taken off a counter, so every n-gram that occurs ``min_count`` times survives; counters
   that cannot have reached it, what was taken off included, are let go.
2. The n-grams of the texts that survived are counted exactly, as words: tasks count runs of
   text and send every hash partition its n-grams with counts, as compressed blocks, which the
   partition adds up. Hashes that collide can only let more n-grams through to it.

Tasks know the survivors by a Bloom filter of bounded size, 16 bits for a survivor up to
``FILTER_BYTES``; the more survivors share those, the more other n-grams travel as well, with
the same result. The shuffle files of a pass are let go when its result is stored.

Scores take place on phrases with their exact counts, in DataFrame functions: decimals of
38 digits for the products, one join with the counts of the parts (salted, since a frequent
word is part of many phrases), and a window that keeps the first of each language.

Cases: a null or empty text has no words; a null language is ``und``; repeated rows count
each time; an empty table gives an empty result; ties in the score go to the more frequent,
then to the smaller phrase in byte order; only ``text`` and ``lang`` are read, so other
columns cannot clash. A text longer than a run is cut between words, with the last words
of a cut looked at again, so no phrase is lost.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tyscope.llm.common import LOWER_TABLE, Words, concat_ranges, mix64, text_buffer, text_runs
from tyscope.operators.windows import top_k_per_group
from tyscope.session import materialize, ship_package, shuffle_files_let_go

MAX_WORDS = 3
MIN_COUNT = 10
COVER_SHARE = 50
TOP = 2000
#: Capacity of a summary in units of mass / threshold.
SPARE = 4
#: Bytes of text per hash partition.
PARTITION_BYTES = 4 << 20
RUN_TEXT = 1 << 20
#: Word positions that are counted in one go.
CHUNK_WORDS = 1 << 20
#: Bytes of the filter of survivors that is broadcast, at most.
FILTER_BYTES = 32 << 20
#: N-grams, and bytes of them as words, that a task gathers before it sends them.
SEND_GRAMS = 1 << 19
SEND_BYTES = 4 << 20
#: Hash partitions of the first pass that are one of the second.
TOGETHER = 2
#: Counters that a summary lets wait at least before it merges them.
WAITING = 125_000
#: A part that is one in so many of the words, or more, is dealt out by salt.
HEAVY_ONE_IN = 20_000
SALTS = 8
#: Parts of a language whose first phrases are taken before the language's.
BUCKETS = 8

#: A phrase does not reach across these bytes.
BREAKS = np.zeros(256, bool)
BREAKS[[*b".,;:!?", 10, 11, 12, 13]] = True
SEPARATORS = BREAKS.copy()
SEPARATORS[[32, 9]] = True

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Grams:
    """The distinct n-grams of one length in a stretch of words: where each begins, how often
    it occurs, and its hash."""

    __slots__ = ("n", "at", "count", "hash")

    def __init__(self, n, at, count, hashes):
        self.n, self.at, self.count, self.hash = n, at, count, hashes


class Stretch:
    """Words that follow each other, and the n-grams that begin at the first ``own`` of them."""

    def __init__(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, joined: np.ndarray, own: int):
        self.buf, self.starts, self.ends, self.joined, self.own = buf, starts, ends, joined, own

    def words(self) -> pa.Array:
        return self._strings(self.starts, self.ends)

    def _strings(self, starts, ends):
        lens = ends - starts
        offsets = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
        data = self.buf[concat_ranges(starts, lens)]
        return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])

    def grams(self, lang: str, max_words: int) -> Iterator[Grams]:
        coded = self.words().dictionary_encode()  # exact: equal words, equal ids
        ids, size = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
        first = np.full(size, len(ids), np.int64)
        np.minimum.at(first, ids, np.arange(len(ids)))
        hashes = _word_hashes(self.buf, self.starts[first], self.ends[first])[ids]
        salt = np.frombuffer(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "<u8")[0]
        whole = np.ones(self.own, bool)
        cur = ids[:self.own]
        for n in range(1, max_words + 1):
            if n > 1:  # the n-gram that begins at i also holds word i + n - 1
                last = np.arange(self.own) + n - 1
                inside = last < len(ids)
                whole[~inside] = False
                whole[inside] &= self.joined[last[inside] - 1]
            pos = np.flatnonzero(whole)
            if not len(pos):
                return
            key = cur[pos] if n == 1 else cur[pos] * size + ids[pos + n - 1]
            _, at, inverse, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            cur = np.zeros(self.own, np.int64)
            cur[pos] = inverse
            at = pos[at]
            with np.errstate(over="ignore"):
                h = np.full(len(at), salt + np.uint64(n), np.uint64)
                for k in range(n):
                    h = mix64(h * _M1 + hashes[at + k] * _M2)
            yield Grams(n, at, count, h)

    def phrases(self, at: np.ndarray, n: int) -> pa.Array:
        """The n-grams that begin at ``at`` with one space between words."""
        word = (at[:, None] + np.arange(n)).ravel()
        lens = self.ends[word] - self.starts[word]
        out_lens = lens + 1
        out_lens[n - 1::n] -= 1
        ends = np.cumsum(out_lens)
        data = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8)
        data[concat_ranges(ends - out_lens, lens)] = self.buf[concat_ranges(self.starts[word], lens)]
        offsets = np.concatenate([[0], ends[n - 1::n]]).astype(np.int32)
        return pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def _word_hashes(buf, starts, ends) -> np.ndarray:
    w = Words.__new__(Words)
    w.buf, w.starts, w.ends = buf, starts, ends
    return w.hashes()


def stretches(texts: pa.Array, max_words: int) -> Iterator[Stretch]:
    """Bounded stretches of the texts' words, A-Z lower-cased."""
    for _, _, buf, offsets in text_runs(texts, RUN_TEXT):
        buf = LOWER_TABLE[buf]
        words = Words(buf, offsets, SEPARATORS)
        n = len(words.starts)
        if not n:
            continue
        piece = np.cumsum(BREAKS[buf])[words.starts] + 0
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(words.first))
        joined = (np.diff(piece) == 0) & (np.diff(text) == 0)
        for s in range(0, n, CHUNK_WORDS):
            own = min(CHUNK_WORDS, n - s)
            e = min(n, s + own + max_words - 1)
            yield Stretch(buf, words.starts[s:e], words.ends[s:e], joined[s:e - 1], own)


def by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array]]:
    lang = batch.column("lang").fill_null("und").dictionary_encode()
    codes, texts = lang.indices.to_numpy(), batch.column("text")
    for i, name in enumerate(lang.dictionary.to_pylist()):
        rows = np.flatnonzero(codes == i)
        yield name, texts if len(rows) == len(codes) else texts.take(pa.array(rows))


def _address(h: np.ndarray, parts: int) -> np.ndarray:
    """Hash partition in the upper and 32 bits of the hash in the lower half."""
    return ((h >> np.uint64(32)) % np.uint64(parts) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, each with the sum of its counts."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def pack_counts(low: np.ndarray, count: np.ndarray) -> bytes:
    """Sorted 32-bit numbers and their counts as byte planes, which Spark's compression shrinks."""
    planes = low.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return planes + (count.astype(np.uint8) if count.max() < 256 else count.astype("<u4")).tobytes()


def unpack_counts(body, n: int) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(body, np.uint8)
    low = np.ascontiguousarray(data[:4 * n].reshape(4, n).T).view("<u4").ravel()
    return low, data[4 * n:].astype(np.int64) if len(data) == 5 * n else data[4 * n:].view("<u4").astype(np.int64)


class Summary:
    """A Misra-Gries summary: at most ``capacity`` counters; ``taken`` is what has been taken
    off every counter at most. ``add`` merges another summary or counts of distinct items."""

    def __init__(self, capacity: int):
        self.capacity, self.taken = capacity, 0
        self.items, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self._items, self._counts, self._waiting = [], [], 0

    def add(self, items: np.ndarray, counts: np.ndarray, taken: int = 0) -> None:
        self._items.append(items)
        self._counts.append(counts)
        self._waiting += len(items)
        self.taken += taken
        if self._waiting > min(self.capacity, max(WAITING, len(self.items))):
            self.settle()

    def settle(self) -> None:
        items = np.concatenate([self.items, *self._items])
        counts = np.concatenate([self.counts, *self._counts])
        self._items, self._counts, self._waiting = [], [], 0
        order = np.argsort(items, kind="stable")
        items, counts = items[order], counts[order]
        first = np.flatnonzero(np.diff(items, prepend=items[:1] + np.uint32(1)) != 0) if len(items) else np.zeros(0, np.int64)
        self.items, self.counts = items[first], np.add.reduceat(counts, first) if len(first) else counts
        if len(self.items) > self.capacity:
            at = len(self.counts) - self.capacity - 1
            off = int(np.partition(self.counts, at)[at])
            keep = self.counts > off
            self.items, self.counts = self.items[keep], self.counts[keep] - off
            self.taken += off


def frequent_hashes(docs: DataFrame, parts: int, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT) -> DataFrame:
    """First pass: (part, mass, taken, keys) per hash partition; ``keys`` holds the addresses of all
    n-grams that can have ``min_count`` occurrences."""
    ship_package(docs.sparkSession)

    def sent_rows(keys, counts, mass):
        key, count = _summed(np.concatenate(keys), np.concatenate(counts))
        part = (key >> np.uint64(32)).astype(np.int64)
        cuts = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), len(part)]
        rows = [(int(part[i]), int(count[i:j].sum()), j - i, pack_counts(key[i:j].astype(np.uint32), count[i:j]))
                for i, j in zip(cuts, cuts[1:])]
        for p, m, _, _ in rows:
            mass[p] = mass.get(p, 0) + m
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([1] * len(rows), pa.int32()),
             pa.array([0] * len(rows), pa.int64()), pa.array([r[2] for r in rows], pa.int64()),
             pa.array([r[3] for r in rows], pa.binary())], names=names)

    names = ["part", "is_body", "mass", "n", "body"]

    def count_runs(batches):
        mass: dict = {}
        keys, counts, size = [], [], 0
        for batch in batches:
            for lang, texts in by_language(batch):
                for stretch in stretches(texts, max_words):
                    for g in stretch.grams(lang, max_words):
                        keys.append(_address(g.hash, parts))
                        counts.append(g.count)
                        size += len(g.count)
                    if size >= SEND_GRAMS:
                        yield sent_rows(keys, counts, mass)
                        keys, counts, size = [], [], 0
        if size:
            yield sent_rows(keys, counts, mass)
        if mass:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(mass), pa.int64()), pa.array([0] * len(mass), pa.int32()), pa.array(list(mass.values()), pa.int64()),
                 pa.array([0] * len(mass), pa.int64()), pa.nulls(len(mass), pa.binary())], names=names)

    def merge(batches):
        now, mass, summary = None, 0, None

        def finished():
            summary.settle()
            keep = summary.items[summary.counts + summary.taken >= min_count]
            keys = (np.int64(now) << np.int64(32)) | keep.astype(np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array([now], pa.int64()), pa.array([mass], pa.int64()), pa.array([summary.taken], pa.int64()),
                 pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), pa.array(keys))], names=["part", "mass", "taken", "keys"])

        for batch in batches:
            bodies = batch.column("body")
            for i, (p, is_body, m, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("part", "is_body", "mass", "n")))):
                if p != now:
                    if summary is not None:
                        yield finished()
                    now, mass, summary = p, 0, None
                if not is_body:  # the masses come first
                    mass += m
                    continue
                if summary is None:
                    summary = Summary(SPARE * mass // min_count + 1)
                summary.add(*unpack_counts(bodies[i].as_buffer(), n))
        if summary is not None:
            yield finished()

    sent = docs.select("text", "lang").mapInArrow(count_runs, "part bigint, is_body int, mass bigint, n bigint, body binary")
    merged = sent.repartition(parts, "part").sortWithinPartitions("part", "is_body").mapInArrow(
        merge, "part bigint, mass bigint, taken bigint, keys array<bigint>")
    with shuffle_files_let_go(docs.sparkSession):
        return materialize(merged, "phrase-survivors")


class Filter:
    """A Bloom filter of addresses, with bits of its own for every hash partition."""

    def __init__(self, parts: int, total: int, max_bytes: int):
        self.width = max(8, min(2 * total, max_bytes) // parts)  # bytes of a partition
        self.probes = max(1, min(4, 8 * self.width * parts * 2 // (3 * max(1, total))))
        self.table = np.zeros(0, np.uint8)

    def _bits(self, keys: np.ndarray, probe: int) -> np.ndarray:
        h = mix64(keys.astype(np.uint64))
        step = h >> np.uint64(32) | np.uint64(1)
        return (((h & np.uint64(0xFFFFFFFF)) + step * np.uint64(probe)) % np.uint64(8 * self.width)).astype(np.int64)

    def segment(self, keys: np.ndarray) -> bytes:
        """The bits of one partition's addresses."""
        bits = np.zeros(8 * self.width, bool)
        for probe in range(self.probes):
            bits[self._bits(keys, probe)] = True
        return np.packbits(bits, bitorder="little").tobytes()

    def positions(self, keys: np.ndarray) -> np.ndarray:
        """Where ``keys`` has addresses that the filter holds."""
        found = np.arange(len(keys))
        first = (keys.astype(np.uint64) >> np.uint64(32)).astype(np.int64) * self.width
        for probe in range(self.probes):
            at = self._bits(keys[found], probe)
            found = found[self.table[first[found] + (at >> 3)] >> (at & 7).astype(np.uint8) & 1 == 1]
        return found


def survivor_filter(survivors: DataFrame, parts: int, max_bytes: int = FILTER_BYTES) -> Filter:
    """The survivors of all partitions as one filter. Tasks make the bits; the driver puts them together."""
    known = Filter(parts, survivors.agg(F.sum(F.size("keys"))).first()[0] or 0, max_bytes)

    def segments(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("part"), pa.array([known.segment(np.asarray(keys.values, np.int64)) for keys in batch.column("keys")], pa.binary())],
                names=["part", "bits"])

    table = np.zeros(parts * known.width, np.uint8)
    for r in survivors.select("part", "keys").mapInArrow(segments, "part bigint, bits binary").collect():
        table[r["part"] * known.width:(r["part"] + 1) * known.width] = np.frombuffer(r["bits"], np.uint8)
    known.table = table
    return known


def _plane(v: np.ndarray) -> bytes:
    kind = np.uint8 if not len(v) or v.max() < 1 << 8 else np.int64
    return bytes([np.dtype(kind).itemsize]) + v.astype(kind).tobytes()


def pack_grams(groups: list[tuple[str, int, int]], phrases: pa.Array, counts: np.ndarray) -> tuple[int, bytes]:
    """Phrases with counts as a compressed block, and its size before; ``groups`` has language,
    words of a phrase and number of phrases, one group after the other."""
    buf, off = text_buffer(phrases)
    head = json.dumps(groups).encode()
    body = b"".join([len(head).to_bytes(4, "little"), head, _plane(np.diff(off)), _plane(counts), buf.tobytes()])
    return len(body), pa.compress(body, "zstd", asbytes=True)


def unpack_grams(body, size: int) -> tuple[list, pa.Array, np.ndarray]:
    data = np.frombuffer(pa.decompress(body, size, "zstd"), np.uint8)
    at = 4 + int.from_bytes(data[:4].tobytes(), "little")
    groups = json.loads(data[4:at].tobytes())
    m, planes = sum(g[2] for g in groups), []
    for _ in range(2):
        kind = np.dtype(np.uint8 if data[at] == 1 else np.int64)
        end = at + 1 + m * kind.itemsize
        planes.append(np.frombuffer(data[at + 1:end].tobytes(), kind).astype(np.int64))
        at = end
    offsets = np.concatenate([[0], np.cumsum(planes[0])]).astype(np.int32)
    return groups, pa.Array.from_buffers(pa.string(), m, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[at:].tobytes())]), planes[1]


class Tally:
    """Counts of phrases by words, added up exactly; a row has the group (language and number of
    words) by number."""

    def __init__(self, *keys: str):
        self.keys, self.groups = keys, {}
        self._new()

    def _new(self):
        self.rows, self.bytes, self.settled, self._tables = 0, 0, 0, []

    def group(self, lang: str, n: int) -> int:
        return self.groups.setdefault((lang, n), len(self.groups))

    def add(self, phrase: pa.Array, a: np.ndarray, **keys: np.ndarray) -> None:
        self._tables.append(pa.table({k: pa.array(keys[k], pa.int64()) for k in self.keys} | {"phrase": phrase, "a": pa.array(a, pa.int64())}))
        self.rows += len(phrase)
        self.bytes += phrase.nbytes

    def settle(self) -> pa.Table:
        whole = pa.concat_tables(self._tables).group_by([*self.keys, "phrase"], use_threads=False).aggregate([("a", "sum")])
        whole = whole.select([*self.keys, "phrase", "a_sum"]).rename_columns([*self.keys, "phrase", "a"])
        self._tables, self.rows, self.settled = [whole], len(whole), len(whole)
        return whole

    def take(self) -> pa.Table:
        whole = self.settle()
        self._new()
        pa.default_memory_pool().release_unused()
        return whole


def exact_counts(docs: DataFrame, survivors: DataFrame, parts: int, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT,
                 filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """Second pass: (lang, n, phrase, a) of all n-grams with ``min_count`` occurrences, and a row
    with n = 0 for each language's number of words."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(survivor_filter(survivors, parts, filter_bytes))

    def sent_rows(tally):
        whole = tally.take()
        part, group = whole["part"].to_numpy(), whole["group"].to_numpy()
        order = np.lexsort([group, part])
        part, group, count = part[order], group[order], whole["a"].to_numpy()[order]
        phrase, names = whole["phrase"].combine_chunks().take(pa.array(order)), list(tally.groups)
        cuts, out = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), len(part)], []
        for i, j in zip(cuts, cuts[1:]):
            numbers, sizes = np.unique(group[i:j], return_counts=True)
            out.append(pack_grams([(*names[g], m) for g, m in zip(numbers.tolist(), sizes.tolist())], phrase[i:j], count[i:j]))
        return pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]]), pa.array([x[0] for x in out], pa.int64()),
                                           pa.array([x[1] for x in out], pa.binary())], names=["part", "size", "body"])

    def count_runs(batches):
        tally = Tally("part", "group")
        for batch in batches:
            for lang, texts in by_language(batch):
                words = 0
                for stretch in stretches(texts, max_words):
                    words += stretch.own
                    for g in stretch.grams(lang, max_words):
                        key = _address(g.hash, parts)
                        keep = known.value.positions(key)
                        if len(keep):
                            tally.add(stretch.phrases(g.at[keep], g.n), g.count[keep], part=(key[keep] >> np.uint64(32)).astype(np.int64) // TOGETHER,
                                      group=np.full(len(keep), tally.group(lang, g.n)))
                    if tally.rows >= SEND_GRAMS or tally.bytes >= SEND_BYTES:
                        yield sent_rows(tally)
                tally.add(pa.array([""]), np.array([words]), part=np.zeros(1, np.int64), group=np.full(1, tally.group(lang, 0)))
        if tally.rows:
            yield sent_rows(tally)

    def finished(tally):
        whole = tally.take()
        group, count = whole["group"].to_numpy(), whole["a"].to_numpy()
        names = list(tally.groups)
        n = np.array([x[1] for x in names], np.int32)[group]
        keep = pa.array(np.flatnonzero((n == 0) | (count >= min_count)))
        lang = pa.DictionaryArray.from_arrays(pa.array(group.astype(np.int32)), pa.array([x[0] for x in names])).cast(pa.string())
        found = pa.table({"lang": lang, "n": pa.array(n), "phrase": whole["phrase"], "a": pa.array(count)}).take(keep)
        return found.combine_chunks().to_batches(max_chunksize=1 << 16)

    def add_up(batches):
        now, tally = None, None
        for batch in batches:
            bodies = batch.column("body")
            for i, (p, size) in enumerate(zip(batch.column("part").to_pylist(), batch.column("size").to_pylist())):
                if p != now:
                    if tally is not None:
                        yield from finished(tally)
                    now, tally = p, Tally("group")
                groups, phrase, count = unpack_grams(bodies[i].as_buffer(), size)
                tally.add(phrase, count, group=np.repeat([tally.group(lang, n) for lang, n, _ in groups], [m for _, _, m in groups]))
                if tally.rows - tally.settled > max(WAITING, tally.settled):
                    tally.settle()
        if tally is not None:
            yield from finished(tally)

    sent = docs.select("text", "lang").mapInArrow(count_runs, "part bigint, size bigint, body binary")
    counts = sent.repartition(-(-parts // TOGETHER), "part").sortWithinPartitions("part").mapInArrow(
        add_up, "lang string, n int, phrase string, a bigint")
    with shuffle_files_let_go(spark):
        return materialize(counts, "phrase-counts")


def _slice(words, start, length):
    return F.array_join(F.slice(words, start, length), " ")


def scored(counts: DataFrame, max_words: int = MAX_WORDS, cover_share: int = COVER_SHARE) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the candidates that no longer one covers, by exact counts."""
    words = F.split("phrase", " ")
    cand = counts.where((F.col("n") >= 2) & (F.col("n") <= max_words)).withColumn("w", words)
    # covered: inside a longer candidate that occurs at least half as often
    inner = (cand.where(F.col("n") > 2)
             .withColumn("m", F.explode(F.sequence(F.lit(2), F.col("n") - 1)))
             .withColumn("s", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("m") + 1)))
             .groupBy("lang", _slice("w", F.col("s"), F.col("m")).alias("phrase")).agg(F.max("a").alias("longer")))
    cand = (cand.join(inner, ["lang", "phrase"], "left")
            .where(F.col("longer").isNull() | (100 * F.col("longer") < cover_share * F.col("a"))).drop("longer"))
    cut = cand.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n") - 1)))
    sides = cut.select("lang", "phrase", "a", "k", F.inline(F.array(
        F.struct(F.lit(0).alias("side"), _slice("w", F.lit(1), F.col("k")).alias("part")),
        F.struct(F.lit(1).alias("side"), _slice("w", F.col("k") + 1, F.col("n") - F.col("k")).alias("part")))))
    # a part of many phrases has a copy for each salt; there are (max_words - 1) * HEAVY_ONE_IN of them at most
    heavy = F.col("f") >= (counts.where("n = 0").agg(F.sum("a")).first()[0] or 0) // HEAVY_ONE_IN + 1
    parts = counts.where((F.col("n") >= 1) & (F.col("n") < max_words)).select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    dealt = parts.where(heavy).select("lang", "part", F.lit(True).alias("heavy"))
    sides = (sides.join(F.broadcast(dealt), ["lang", "part"], "left")
             .withColumn("salt", F.when(F.col("heavy"), F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).otherwise(F.lit(0).cast("bigint"))))
    last = F.when(heavy, F.lit(SALTS - 1)).otherwise(F.lit(0)).cast("bigint")
    parts = parts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    found = (sides.join(parts, ["lang", "part", "salt"])
             .groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.collect_list(F.struct("k", "side", "f")).alias("f")))

    def side(k, s):
        return F.filter("f", lambda x: (x["k"] == k) & (x["side"] == s))[0]["f"]

    def cut_score(k):
        number = [c.cast("decimal(38,0)") for c in (F.col("a"), side(k, 0), side(k, 1))]
        score = F.call_function("div", number[0] * number[0] * F.lit(1_000_000).cast("decimal(7,0)"), number[1] * number[2])
        return F.struct(score.cast("bigint").alias("score"), k.alias("k"), side(k, 0).alias("l"), side(k, 1).alias("r"))

    best = F.array_min(F.transform(F.array_distinct(F.transform("f", lambda x: x["k"])), cut_score))
    return (found.withColumn("best", best)
            .select("lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), F.col("best.score").alias("score")))


def phrase_counts(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT,
                  broadcast_hashes: int = FILTER_BYTES // 8, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Exact counts of the n-grams with ``min_count`` occurrences, per language (see ``exact_counts``).
    The filter of survivors takes no more than ``broadcast_hashes`` times 8 bytes, and 8 for each partition at least."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // partition_bytes))
    return exact_counts(docs, frequent_hashes(docs, parts, max_words, min_count), parts, max_words, min_count, 8 * broadcast_hashes)


def collocations(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, cover_share: int = COVER_SHARE,
                 top: int = TOP, **options) -> DataFrame:
    """The ``top`` phrases of every language of ``docs`` (text, lang): lang, rank, phrase, a, l, r, n, score."""
    counts = phrase_counts(docs, max_words, min_count, **options)
    # the first of every language and bucket, then of every language: a bounded number of rows meets
    ranked = top_k_per_group(scored(counts, max_words, cover_share), ["lang"], [F.desc("score"), F.desc("a"), F.col("phrase")],
                             top, rank_col="rank", split_cols=["phrase"], buckets=BUCKETS)
    sizes = counts.where("n = 0").select("lang", F.col("a").alias("n"))
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
