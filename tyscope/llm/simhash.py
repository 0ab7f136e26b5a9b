"""SimHash near-dedup with Golay-code fuzzy hashing.

A document's 64-bit fingerprint is the bitwise majority of its shingles' XXH64 values.
Fingerprints link at ``max_bits`` (4) or fewer differing bits. To find all links without
comparing all fingerprints, a fingerprint is cut into three segments (22, 21 and 21
bits). A segment, padded to the 23 bits of the perfect binary Golay code, is decoded to
the index of its codeword, and so are the words one flipped bit away: one or six
distinct indices. Two words two or fewer bits apart share an index, because the word
between them belongs to both lists.

Pigeonhole of at most four errors over three segments:

* a segment is equal: the other two hold at most four errors, so one of them holds at
  most two. Key: the equal segment and an index of another one (six families);
* no segment is equal: the errors are 1+1+1 or 1+1+2, so every segment holds at most
  two. Key: an index of the first and one of the second segment (one family).

Distinct fingerprints are joined on these keys and verified by bit distance. A key's
group emits no more than links of a spanning forest once it is larger than
``SMALL_GROUP``; components over all links follow by alternating star steps.

A key that more than ``LARGE_GROUP`` fingerprints share (many slightly different copies of
one template) is dealt out further: the 64 bits are dealt to five blocks in turn, so that
each block has bits of every segment, and a fingerprint takes the key with each block's
value. At four errors one of the five blocks is equal, so no link is lost. Such keys are
found in a sample of the fingerprints; one that the sample misses stays whole.

A component's id reaches its fingerprints, and a fingerprint's component its documents, by
joins in which a key with more than one in ``HOT_PARTS`` of all rows (there are fewer than
``HOT_PARTS`` of them) is dealt out over ``SALTS`` parts.

Cases: no words (null or empty text) gives fingerprint zero, linked like any other;
equal fingerprints are compared once, however many documents share them; a null doc_id
takes part but is never a component's id unless it has no other; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tyscope.llm.common import mix64, text_runs
from tyscope.session import materialize, ship_package

SHINGLE = 4
MAX_BITS = 4
SEED = 42
SMALL_GROUP = 32
LARGE_GROUP = 4096
SAMPLE = 64
MAX_HOT = 100_000
HOT_PARTS = 1000
SALTS = 128

#: Generator polynomial of the [23,12] binary Golay code (fixed value).
GOLAY_POLY = 0b110001110101

SEGMENTS = ((0, 22), (22, 21), (43, 21))
BLOCKS = [np.uint64(sum(1 << i for i in range(b, 64, 5))) for b in range(5)]


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Majority fingerprint of a UTF-8 text (A-Z lower-cased)."""
    words = text.lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[:len(words) - shingle + 1].tolist()
    ends = (ends[shingle - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        part = h[i:i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rest = [c for c in b.schema.names if c != "text"]
        for i, j, buf, off in text_runs(b.column("text")):
            fps = np.fromiter((fingerprint(buf[x:y].tobytes(), shingle) for x, y in zip(off[:-1], off[1:])), np.uint64, j - i)
            yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i) for c in rest), pa.array(fps.view(np.int64))],
                                             [*rest, "fp"])


def fingerprints(rows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``rows`` with column text replaced by fp, the fingerprint as a signed 64-bit number."""
    ship_package(rows.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(lambda it: _fingerprint_batches(it, shingle), f"{schema}, fp long")


class Golay:
    """Decoding of 23-bit words to the index (upper 12 bits) of the nearest codeword."""

    def __init__(self):
        def remainder(x: int) -> int:
            for i in range(22, 10, -1):
                if x >> i & 1:
                    x ^= GOLAY_POLY << (i - 11)
            return x

        self.flip = np.array([remainder(1 << i) for i in range(23)], np.int32)
        self.high = np.zeros(1 << 12, np.int32)
        for i in range(12):
            self.high[1 << i:2 << i] = self.high[:1 << i] ^ self.flip[11 + i]
        # the code is perfect: each of the 2^11 syndromes has one error of weight 3 or less
        self.error = np.zeros(1 << 11, np.int32)
        for i in range(23):
            self.error[self.flip[i]] = 1 << i
            for j in range(i):
                self.error[self.flip[i] ^ self.flip[j]] = 1 << i | 1 << j
                for k in range(j):
                    self.error[self.flip[i] ^ self.flip[j] ^ self.flip[k]] = 1 << i | 1 << j | 1 << k

    def index(self, word: np.ndarray, syndrome: np.ndarray) -> np.ndarray:
        return (word ^ self.error[syndrome]) >> 11

    def near(self, word: np.ndarray, bits: int) -> np.ndarray:
        """Indices of a word and of its neighbours over the lower ``bits`` bits, one row per
        word in ascending order, repeats replaced by -1."""
        word = word.astype(np.int32)
        syn = self.high[word >> 11] ^ (word & 0x7FF)
        out = np.empty((len(word), bits + 1), np.int32)
        out[:, bits] = self.index(word, syn)
        for i in range(bits):
            out[:, i] = self.index(word ^ (1 << i), syn ^ self.flip[i])
        out.sort(axis=1)
        out[:, 1:][out[:, 1:] == out[:, :-1]] = -1
        return out


def fuzzy_keys(fps: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) pairs of unsigned fingerprints."""
    segs = [(fps >> np.uint64(at)).astype(np.int64) & ((1 << bits) - 1) for at, bits in SEGMENTS]
    lists = []
    for seg, (_, bits) in zip(segs, SEGMENTS):
        near = golay.near(seg, bits)
        row, col = np.nonzero(near >= 0)
        lists.append((row, near[row, col].astype(np.int64)))
    keys, rows = [], []
    for i in range(3):
        for j in range(3):
            if i != j:
                row, code = lists[j]
                keys.append((i * 3 + j) << 40 | segs[i][row] << 12 | code)
                rows.append(row)
    (row0, code0), (row1, code1) = lists[0], lists[1]
    first1 = np.searchsorted(row1, np.arange(len(fps) + 1))
    width = np.diff(first1)[row0]
    at = np.repeat(first1[row0] - np.cumsum(width) + width, width) + np.arange(width.sum())
    keys.append(np.int64(9) << 40 | np.repeat(code0, width) << 12 | code1[at])
    rows.append(np.repeat(row0, width))
    return np.concatenate(keys), np.concatenate(rows)


def dealt_keys(key: np.ndarray, fp: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, fp) pairs in which each key of the sorted ``hot`` is replaced by one key per block.
    Block keys are hashes; should two meet, their fingerprints are compared in vain."""
    if not len(hot):
        return key, fp
    found = hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key
    if not found.any():
        return key, fp
    k, f = key[found].astype(np.uint64), fp[found]
    parts = [mix64((f.view(np.uint64) & bits) ^ mix64(k * np.uint64(5) + np.uint64(b))).view(np.int64)
             for b, bits in enumerate(BLOCKS)]
    return np.concatenate([key[~found], *parts]), np.concatenate([fp[~found], *[f] * 5])


def _key_batches(batches: Iterator[pa.RecordBatch], hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    golay = Golay()
    for b in batches:
        fps = b.column("fp").to_numpy(zero_copy_only=False)
        for i in range(0, len(fps), 4096):
            part = fps[i:i + 4096]
            key, row = fuzzy_keys(part.view(np.uint64), golay)
            key, fp = dealt_keys(key, part[row], hot)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp)], ["key", "fp"])


def hot_keys(distinct: DataFrame) -> np.ndarray:
    """The keys of about ``LARGE_GROUP`` fingerprints or more, by a sample; at most ``MAX_HOT``, the largest."""
    some = distinct.select("fp").where(F.pmod(F.xxhash64("fp", F.lit(5)), F.lit(SAMPLE)) == 0)
    keys = some.mapInArrow(lambda it: _key_batches(it, np.empty(0, np.int64)), "key long, fp long")
    found = (keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LARGE_GROUP // SAMPLE // 2)
             .orderBy(F.desc("n"), "key").limit(MAX_HOT).collect())
    return np.sort(np.array([r.key for r in found], np.int64))


def key_rows(distinct: DataFrame) -> DataFrame:
    """(key, fp): the rows that meet by key, large groups dealt out."""
    ship_package(distinct.sparkSession)
    hot = distinct.sparkSession.sparkContext.broadcast(hot_keys(distinct))
    return distinct.select("fp").mapInArrow(lambda it: _key_batches(it, hot.value), "key long, fp long")


def spanning_links(fps: np.ndarray, max_bits: int) -> list[np.ndarray]:
    """Links that join whatever the links among these fingerprints join: a breadth-first
    forest, which compares a fingerprint only with those not reached yet."""
    if len(fps) > LARGE_GROUP and max_bits < 5:
        # of five blocks one is equal between any linked two: search inside equal blocks
        out = []
        for bits in BLOCKS:
            block = fps.view(np.uint64) & bits
            order = np.argsort(block, kind="stable")
            for part in np.split(fps[order], np.flatnonzero(np.diff(block[order])) + 1):
                if len(part) > 1:
                    out += _forest(part, max_bits)
        return out
    return _forest(fps, max_bits)


def _forest(fps: np.ndarray, max_bits: int) -> list[np.ndarray]:
    out, rest = [], fps
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            near = np.bitwise_count((rest ^ x).view(np.uint64)) <= max_bits
            if near.any():
                found, rest = rest[near], rest[~near]
                out.append(np.stack([np.full(len(found), x), found], axis=1))
                todo.extend(found.tolist())
    return out


def _links(key: np.ndarray, fp: np.ndarray, max_bits: int) -> np.ndarray:
    """Links inside the groups of a run of whole, sorted groups."""
    if len(key) < 2:
        return np.empty((0, 2), np.int64)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(first, len(key)))
    out = []
    for i in np.flatnonzero(sizes > SMALL_GROUP):
        out += spanning_links(np.unique(fp[first[i]:first[i] + sizes[i]]), max_bits)
    use = np.repeat((sizes > 1) & (sizes <= SMALL_GROUP), sizes)
    key, fp = key[use], fp[use]
    for d in range(1, min(SMALL_GROUP, len(key))):
        same = np.flatnonzero(key[d:] == key[:-d])
        if not len(same):
            break
        a, b = fp[same], fp[same + d]
        near = (np.bitwise_count((a ^ b).view(np.uint64)) <= max_bits) & (a != b)
        out.append(np.stack([a[near], b[near]], axis=1))
    if not out:
        return np.empty((0, 2), np.int64)
    links = np.concatenate(out)
    links.sort(axis=1)
    return np.unique(links, axis=0)


def _link_batches(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []  # the last key's rows so far, which may go on

    def out(links: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp"))
        if held and key[0] == key[-1] == held[0][0][0]:
            held.append((key, fp))
            continue
        if held:
            key, fp = (np.concatenate([*(h[k] for h in held), x]) for k, x in enumerate((key, fp)))
        cut = np.searchsorted(key, key[-1])
        held = [(key[cut:], fp[cut:])]
        yield out(_links(key[:cut], fp[:cut], max_bits))
    if held:
        yield out(_links(*(np.concatenate([h[k] for h in held]) for k in (0, 1)), max_bits))


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) between the distinct fingerprints (column fp): every verified link of a
    small key group, a spanning forest of a larger one."""
    if max_bits > 4:
        raise ValueError("the segment keys cover four differing bits")
    grouped = key_rows(distinct).repartition("key").sortWithinPartitions("key")
    return grouped.mapInArrow(lambda it: _link_batches(it, max_bits), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the connected components of an edge table (a, b): large-star and
    small-star steps until nothing moves. Each step is a minimum per node and a join, so
    a node with very many links is no group of its own; each is written to the shared folder."""
    edges = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                        .where("u != v").distinct(), "links")
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        edges = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u != v").distinct())
        edges = materialize(edges, "large-star")
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        small = (edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v"))).where("u != v").distinct())
        edges = materialize(small, "small-star")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def join_spread(rows: DataFrame, labels: DataFrame, key: str, place: Column, sizes: DataFrame) -> DataFrame:
    """``rows`` joined by ``key`` with ``labels``, which has one row per key. ``sizes`` (key, n) counts
    the rows of a key: keys with more than one in ``HOT_PARTS`` of them are spread by ``place``, a
    number that tells their rows apart, and their label travels to each part."""
    total = sizes.agg(F.sum("n")).first()[0] or 0
    hot = [r[0] for r in sizes.where(F.col("n") * HOT_PARTS > total).select(key).collect()]  # fewer than HOT_PARTS
    is_hot = F.col(key).isin(hot) if hot else F.lit(False)
    salted = rows.withColumn("_salt", F.when(is_hot, F.pmod(place, F.lit(SALTS)).cast("int")).otherwise(0))
    copies = labels.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return salted.join(copies, [key, "_salt"]).drop("_salt")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """Every document row as (doc_id, th, fp, component, component_id): th is a hash of the
    text, component the group's root fingerprint, component_id its smallest doc_id."""
    rows = materialize(fingerprints(docs.select("doc_id", F.xxhash64("text").alias("th"), "text"), shingle), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")),
                           "distinct-fingerprints")
    roots = components(links(distinct, max_bits))
    named = materialize(distinct.select("fp", "first_id").join(roots.withColumnRenamed("node", "fp"), "fp", "left")
                        .select("fp", "first_id", F.coalesce("root", "fp").alias("component")), "named-fingerprints")
    ids = named.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    labels = join_spread(named.select("fp", "component"), ids.drop("n"), "component", F.xxhash64("fp"), ids)
    # the stored rows are read by the same tasks again, so that a row's number is the same in every attempt
    found = join_spread(rows, labels, "fp", F.monotonically_increasing_id(), distinct)
    return found.select("doc_id", "th", "fp", "component", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` without all but one row of each near-duplicate group: the smallest doc_id
    stays (null last, then the smaller text hash); of rows equal in both, one."""
    found = near_duplicates(docs, shingle, max_bits)
    reps = (found.groupBy("component")
            .agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "th")).alias("r"))
            .select(F.coalesce(F.col("r.doc_id").cast("string"), F.lit("")).alias("_near_id"), F.col("r.th").alias("_near_th"))
            .distinct())
    keyed = docs.select("*", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_near_id"),
                        F.xxhash64("text").alias("_near_th"))
    one = Window.partitionBy("_near_id", "_near_th").orderBy("_near_id")
    return (keyed.join(reps, ["_near_id", "_near_th"]).withColumn("_near_row", F.row_number().over(one))
            .where("_near_row = 1").select(*docs.columns))
