"""Cross-tokenizer alignment with inverted pair bitmaps.

Every text is encoded by a byte-level BPE (A, over a space and the text) and by a
sentencepiece model (B, which adds that space itself). Byte offsets at which tokens of both
end cut the tokens into groups; the two tokens that end at a cut are a link.

The index maps a pair (A id, B id) to compressed bitmaps over documents. Documents are
numbered inside blocks of up to 65,536; a container holds the documents of one pair,
block and plane. Plane 0 has every document with the pair, plane j the documents
whose number of further links of the pair has bit j - 1 set. A container is a sorted list of
16-bit numbers, or a bitmap of 8,192 bytes from 4,096 documents on.

1. One pass encodes the texts. A task collects the links of some documents and writes their
   partial containers and one row per document. Texts are encoded this once.
2. Partial containers of the same pair, block and plane are OR-merged; popcounts,
   weighted by plane, give a pair's documents and links, summed over blocks by Spark.
3. Postings return scores: containers meet their pair's counts, travel to their block, and
   add count and best-of-B flag to their documents.

Nothing is grouped by pair or by B id but numbers that are pre-aggregated, so a frequent
pair costs one row per block. The table of best counts per B id is bounded by B's
vocabulary and is broadcast. Tokenizer files are read by the driver from paths that are
parameters and reach the tasks as a Spark broadcast of their (fixed) size.

A's ids are those of the JSON file's tokenizer. Where its merges are ranked by id and a text
stays below U+0250, where letter and space classes do not depend on a library's version,
the same vocabulary is run as ranks, which is several times faster.

Cases: null and empty texts, and texts whose joined token bytes differ from space+text,
have no tokens (zeros, digest ''); repeated rows and ids are rows of their own; ``doc_id`` may
have any type and be null; an empty table gives an empty result; only ``doc_id`` and ``text``
are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tyscope.llm.common import concat_ranges, text_runs
from tyscope.session import materialize, scratch_path, ship_package

A_FILE = "/opt/tokenizers/byte_bpe_50k.json"
B_FILE = "/opt/tokenizers/piece_bpe_32k.model"

BLOCK_DOCS = 1 << 16
DENSE_FROM = 4096
DENSE_BYTES = BLOCK_DOCS // 8
#: Links that a task holds before it writes their containers.
FLUSH_LINKS = 2_000_000
#: Bytes of text that are encoded in one go.
ENCODE_BYTES = 1 << 20

#: Fixed value: the pattern that cuts text before the merges of this family of vocabularies.
CUT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ABOVE = re.compile("[^\x00-ɏ]")


def byte_of_letter() -> dict[str, int]:
    """Byte-level BPE writes a byte as a letter: printable Latin-1 as itself, the others from
    U+0100 on in byte order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteTable:
    """The bytes of every token id."""

    def __init__(self, tokens: list[bytes]):
        self.lens = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lens)])[:-1]
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.data[concat_ranges(self.starts[ids], self.lens[ids])]


class Pair:
    """The two tokenizers."""

    def __init__(self, a_json: bytes, b_model: bytes):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json.decode())
        self.a.encode_special_tokens = True
        letters = byte_of_letter()
        spec = json.loads(a_json)
        added = {t["content"] for t in spec.get("added_tokens", [])}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in added}
        tokens = [b""] * (max([*vocab.values(), *(t["id"] for t in spec.get("added_tokens", []))]) + 1)
        for t, i in vocab.items():
            tokens[i] = bytes(letters[c] for c in t)
        self.a_bytes = ByteTable(tokens)
        self.ranks = self._as_ranks(spec, vocab, tokens)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        n = self.b.get_piece_size()
        self.b_bytes = ByteTable([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                                  for i, p in ((i, self.b.id_to_piece(i)) for i in range(n))])

    @staticmethod
    def _as_ranks(spec: dict, vocab: dict, tokens: list[bytes]):
        """The vocabulary as a rank tokenizer, if merging by id is merging in the file's order."""
        pre = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            return None
        merged = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m)) for m in spec["model"]["merges"]]
        if merged != list(range(256, 256 + len(merged))) or spec["model"].get("ignore_merges"):
            return None
        import tiktoken

        return tiktoken.Encoding("a", pat_str=CUT_PATTERN, special_tokens={},
                                 mergeable_ranks={tokens[i]: i for i in vocab.values()})

    def encode_a(self, texts: list[str]) -> list:
        if self.ranks is None:
            return [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        return [self.ranks.encode_ordinary(t) if not _ABOVE.search(t) else self.a.encode(t, add_special_tokens=False).ids
                for t in texts]

    def encode_b(self, texts: list[str]) -> list:
        return self.b.encode(texts, num_threads=1)


_LOADED: dict = {}


def load_pair(files: tuple[bytes, bytes]) -> Pair:
    """The tokenizers of these files, once per worker."""
    key = tuple(hashlib.sha256(f).digest() for f in files)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Pair(*files)
    return _LOADED[key]


class Aligned:
    """Tokens, groups and links of some texts; rows are those of the list given."""

    def __init__(self, pair: Pair, texts: list[str | None]):
        n = len(texts)
        rows = [i for i, t in enumerate(texts) if t]
        full = [" " + texts[i] for i in rows]
        raw = [t.encode() for t in full]
        ids_a = [np.asarray(x, np.int64) for x in pair.encode_a(full)]
        ids_b = [np.asarray(x, np.int64) for x in pair.encode_b([texts[i] for i in rows])]
        ok = [k for k in range(len(rows)) if
              pair.a_bytes.lens[ids_a[k]].sum() == len(raw[k]) == pair.b_bytes.lens[ids_b[k]].sum()]
        if ok:
            want = np.frombuffer(b"".join(raw[k] for k in ok), np.uint8)
            at = np.cumsum([0] + [len(raw[k]) for k in ok])[:-1]
            wrong = ((pair.a_bytes.joined(np.concatenate([ids_a[k] for k in ok])) != want)
                     | (pair.b_bytes.joined(np.concatenate([ids_b[k] for k in ok])) != want))
            ok = [k for k, bad in zip(ok, np.add.reduceat(wrong, at)) if not bad]
        self.n_a, self.n_b, self.n_groups = (np.zeros(n, np.int64) for _ in range(3))
        self.rows = np.array([rows[k] for k in ok], np.int64)
        empty = np.zeros(0, np.int64)
        self.a = np.concatenate([ids_a[k] for k in ok]) if ok else empty
        self.b = np.concatenate([ids_b[k] for k in ok]) if ok else empty
        self.doc_ends = np.cumsum([len(raw[k]) for k in ok]) if ok else empty
        ends_a, ends_b = np.cumsum(pair.a_bytes.lens[self.a]), np.cumsum(pair.b_bytes.lens[self.b])
        self.cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        #: the tokens that end at each cut, and the text of the cut
        self.last_a, self.last_b = np.searchsorted(ends_a, self.cuts), np.searchsorted(ends_b, self.cuts)
        self.cut_text = np.searchsorted(self.doc_ends, self.cuts)
        if ok:
            self.n_a[self.rows] = [len(ids_a[k]) for k in ok]
            self.n_b[self.rows] = [len(ids_b[k]) for k in ok]
            self.n_groups[self.rows] = np.bincount(self.cut_text, minlength=len(ok))

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, A id and B id of every link."""
        return self.rows[self.cut_text], self.a[self.last_a], self.b[self.last_b]

    def groups(self) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of every text with tokens, in the order of ``rows``."""
        if not len(self.rows):
            return []
        n_a, n_b = np.diff(self.last_a, prepend=-1), np.diff(self.last_b, prepend=-1)
        start = np.cumsum(n_a + n_b) - (n_a + n_b)
        total = int((n_a + n_b).sum())
        ids, seps = np.empty(total, np.int64), np.full(total, ord(","), np.uint8)
        ids[concat_ranges(start, n_a)] = self.a
        ids[concat_ranges(start + n_a, n_b)] = self.b
        seps[start + n_a - 1] = ord("|")
        seps[start + n_a + n_b - 1] = ord(";")
        digits = np.ones(total, np.int64)
        power = 10
        while power <= (ids.max() if total else 0):
            digits += ids >= power
            power *= 10
        ends = np.cumsum(digits + 1)
        out = np.empty(int(ends[-1]), np.uint8)
        out[ends - 1] = seps
        rest = ids
        for d in range(int(digits.max())):
            has = digits > d
            out[(ends - 2 - d)[has]] = 48 + (rest % 10)[has]
            rest = rest // 10
        last_cut = np.flatnonzero(np.diff(self.cut_text, append=len(self.rows)))
        doc_end = ends[(start + n_a + n_b - 1)[last_cut]]
        data = out.tobytes()
        return [data[s:e - 1] for s, e in zip([0, *doc_end[:-1].tolist()], doc_end.tolist())]


def encode_containers(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Sorted (key, document) entries -> the distinct keys and one container for each."""
    first = np.flatnonzero(np.diff(key, prepend=key[0] - 1)) if len(key) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(first, len(key)))
    dense = np.flatnonzero(sizes >= DENSE_FROM)
    lens = np.where(sizes >= DENSE_FROM, DENSE_BYTES, sizes * 2)
    offsets = np.concatenate([[0], np.cumsum(lens)])
    data = np.zeros(int(offsets[-1]), np.uint8)
    if len(dense):
        flat = np.repeat(sizes < DENSE_FROM, sizes)
        short = sizes < DENSE_FROM
        data.view("<u2")[concat_ranges(offsets[:-1][short] // 2, sizes[short])] = doc[flat]
        for i in dense:
            bits = np.zeros(BLOCK_DOCS, bool)
            bits[doc[first[i]:first[i] + sizes[i]]] = True
            data[offsets[i]:offsets[i + 1]] = np.packbits(bits, bitorder="little")
    else:
        data = doc.astype("<u2").view(np.uint8)
    bufs = [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())]
    return key[first], pa.Array.from_buffers(pa.binary(), len(first), bufs)


def decode_containers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Containers -> (row, document) entries, rows ascending."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if not len(col):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    wide = pa.types.is_large_binary(col.type)
    off = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8)[off[0]:off[-1]]
    off = off - off[0]
    lens = np.diff(off)
    dense = lens == DENSE_BYTES
    if not dense.any():
        return np.repeat(np.arange(len(col)), lens // 2), data.view("<u2").astype(np.int64)
    found = {int(i): np.flatnonzero(np.unpackbits(data[off[i]:off[i + 1]], bitorder="little")) for i in np.flatnonzero(dense)}
    sizes = lens // 2
    for i, docs in found.items():
        sizes[i] = len(docs)
    first = np.cumsum(sizes) - sizes
    doc = np.empty(int(sizes.sum()), np.int64)
    doc[concat_ranges(first[~dense], sizes[~dense])] = data.view("<u2")[concat_ranges(off[:-1][~dense] // 2, sizes[~dense])]
    for i, docs in found.items():
        doc[first[i]:first[i] + sizes[i]] = docs
    return np.repeat(np.arange(len(col)), sizes), doc


def planes_of(pair: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, np.ndarray, pa.Array]]:
    """Links (pair, document) -> (plane, pairs, containers), one plane after the other."""
    entry, links = np.unique((pair << np.int64(16)) | doc, return_counts=True)
    more, plane = links - 1, 0
    keep = np.ones(len(entry), bool)
    while keep.any():
        keys, bitmaps = encode_containers(entry[keep] >> 16, entry[keep] & 0xFFFF)
        yield plane, keys, bitmaps
        rest = more >> plane
        if not rest.any():
            return
        plane += 1
        keep = (rest & 1).astype(bool)
        while not keep.any():  # a plane that no document has
            plane += 1
            keep = ((more >> (plane - 1)) & 1).astype(bool)


def plane_weight(plane):
    """Links that a document in this plane stands for."""
    return np.where(plane == 0, 1, np.int64(1) << np.maximum(plane - 1, 0))


_POSTING = "block bigint, pair bigint, plane int, bitmap binary"


def encode_corpus(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, keep_groups: bool = False) -> tuple[DataFrame, DataFrame]:
    """The document rows (doc_id, block, idx, counts, digest, and with ``keep_groups`` the groups
    as text) and the partial containers (block, pair, plane, bitmap) of a corpus, stored."""
    spark = docs.sparkSession
    ship_package(spark)
    with open(a_file, "rb") as a, open(b_file, "rb") as b:
        files = spark.sparkContext.broadcast((a.read(), b.read()))
    kept = [StructField("groups", docs.schema["text"].dataType)] if keep_groups else []
    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType)] + kept).fields
    rest = spark.createDataFrame([], "kind string, idx int, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
                                     f"groups_sha256 string, {_POSTING}").schema.fields
    schema = StructType(schema + rest)

    def run(batches):
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        pair = load_pair(files.value)
        out = to_arrow_schema(schema)
        base = TaskContext.get().partitionId() << 24
        block, next_doc, held = 0, 0, 0
        links: list = []

        def table(n, **cols):
            return pa.RecordBatch.from_arrays(
                [cols[f.name].cast(f.type) if f.name in cols else pa.nulls(n, f.type) for f in out], schema=out)

        def flushed():
            nonlocal links, held
            if held:
                p, d = (np.concatenate(x) for x in zip(*links))
                links, held = [], 0
                for plane, keys, bitmaps in planes_of(p, d):
                    m = len(keys)
                    yield table(m, kind=pa.array(["post"] * m), block=pa.array(np.full(m, base + block)), pair=pa.array(keys),
                                plane=pa.array(np.full(m, plane, np.int32)), bitmap=bitmaps)

        for batch in batches:
            texts = batch.column("text")
            for i, j, _, _ in text_runs(texts, ENCODE_BYTES):
                while i < j:
                    k = min(j, i + BLOCK_DOCS - next_doc)
                    found = Aligned(pair, texts.slice(i, k - i).to_pylist())
                    row, a, b = found.links()
                    links.append(((a << np.int64(24)) | b, row + next_doc))
                    held += len(row)
                    groups = found.groups()
                    digest = [""] * (k - i)
                    for r, g in zip(found.rows.tolist(), groups):
                        digest[r] = hashlib.sha256(g).hexdigest()
                    cols = {}
                    if keep_groups:
                        shown = [""] * (k - i)
                        for r, g in zip(found.rows.tolist(), groups):
                            shown[r] = g.decode()
                        cols["groups"] = pa.array(shown)
                    n = pa.array(found.n_groups)
                    yield table(k - i, doc_id=batch.column("doc_id").slice(i, k - i), kind=pa.array(["doc"] * (k - i)),
                                block=pa.array(np.full(k - i, base + block)),
                                idx=pa.array(np.arange(next_doc, next_doc + k - i, dtype=np.int32)),
                                n_a=pa.array(found.n_a), n_b=pa.array(found.n_b), n_groups=n, n_links=n,
                                groups_sha256=pa.array(digest), **cols)
                    next_doc += k - i
                    i = k
                    if held >= FLUSH_LINKS or next_doc == BLOCK_DOCS:
                        yield from flushed()
                    if next_doc == BLOCK_DOCS:
                        block, next_doc = block + 1, 0
        yield from flushed()

    path = scratch_path(spark, "aligned")
    docs.select("doc_id", "text").mapInArrow(run, schema).write.partitionBy("kind").parquet(path)
    stored = spark.read.schema(schema).parquet(path)
    post = [f.name for f in spark.createDataFrame([], _POSTING).schema.fields]
    return (stored.where("kind = 'doc'").drop("kind", "pair", "plane", "bitmap"),
            stored.where("kind = 'post'").select(*post))


def merged_postings(partial: DataFrame) -> DataFrame:
    """Containers of the same block, pair and plane OR-merged, with their popcount ``n``."""
    ship_package(partial.sparkSession)

    def run(batches):
        for batch in batches:
            lists = batch.column("parts")
            bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            row, doc = decode_containers(lists.flatten())
            group = (np.searchsorted(bounds, row, "right") - 1).astype(np.int64)
            entry = (group << np.int64(16)) | doc
            if (np.diff(bounds) > 1).any():
                entry = np.unique(entry)
            _, bitmaps = encode_containers(entry >> 16, entry & 0xFFFF)
            yield pa.RecordBatch.from_arrays(
                [batch.column("block"), batch.column("pair"), batch.column("plane"), bitmaps,
                 pa.array(np.bincount(entry >> 16, minlength=batch.num_rows).astype(np.int64))],
                names=["block", "pair", "plane", "bitmap", "n"])

    parts = partial.groupBy("block", "pair", "plane").agg(F.collect_list("bitmap").alias("parts"))
    return materialize(parts.mapInArrow(run, f"{_POSTING}, n bigint"), "pair-postings")


def pair_counts(postings: DataFrame) -> DataFrame:
    """(pair, a_id, b_id, n_docs, n_links, is_best) of every linked pair: the documents and links
    that have it, and whether no pair of its B id has more links."""
    weight = F.when(F.col("plane") == 0, F.lit(1)).otherwise(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("plane") - 1))
    counts = (postings.groupBy("pair")
              .agg(F.sum(F.when(F.col("plane") == 0, F.col("n")).otherwise(0)).alias("n_docs"),
                   F.sum(F.col("n") * weight).alias("n_links"))
              .withColumn("a_id", F.shiftright("pair", 24)).withColumn("b_id", F.col("pair").bitwiseAND(F.lit(2 ** 24 - 1))))
    counts = materialize(counts, "pair-counts")
    best = counts.groupBy("b_id").agg(F.max("n_links").alias("top"))  # at most one row per entry of B's vocabulary
    return (counts.join(F.broadcast(best), "b_id")
            .select("pair", "a_id", "b_id", "n_docs", "n_links", (F.col("n_links") == F.col("top")).alias("is_best")))


def scored_documents(documents: DataFrame, postings: DataFrame, counts: DataFrame) -> DataFrame:
    """``documents`` with n_best and count_sum, returned by the postings of their block."""
    ship_package(documents.sparkSession)
    scored = (postings.join(counts.select("pair", "n_links", "is_best"), "pair")
              .select("block", F.lit(0).alias("is_doc"), "plane", "bitmap", "n_links", "is_best"))
    plain = [c for c in documents.columns if c != "block"]
    events = scored.withColumns({f"d_{c}": F.lit(None).cast(documents.schema[c].dataType) for c in plain}).unionByName(
        documents.select("block", F.lit(1).alias("is_doc"), *[F.col(c).alias(f"d_{c}") for c in plain]), allowMissingColumns=True)
    shown = [c for c in plain if c != "idx"]
    schema = StructType([documents.schema[c] for c in shown] + [StructField("n_best", LongType()), StructField("count_sum", LongType())])

    def run(batches):
        now, best, total = None, None, None
        for batch in batches:
            block = batch.column("block").to_numpy()
            is_doc = batch.column("is_doc").to_numpy()
            cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(is_doc) != 0)) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(block)]):
                if i == j:
                    continue
                if now != block[i]:
                    now, best, total = block[i], np.zeros(BLOCK_DOCS, np.int64), np.zeros(BLOCK_DOCS, np.int64)
                part = batch.slice(i, j - i)
                if not is_doc[i]:
                    row, doc = decode_containers(part.column("bitmap"))
                    weight = plane_weight(part.column("plane").to_numpy())
                    np.add.at(total, doc, (weight * part.column("n_links").to_numpy())[row])
                    np.add.at(best, doc, (weight * part.column("is_best").to_numpy(zero_copy_only=False))[row])
                else:
                    idx = part.column("d_idx").to_numpy()
                    yield pa.RecordBatch.from_arrays([*(part.column(f"d_{c}") for c in shown), pa.array(best[idx]), pa.array(total[idx])],
                                                     names=[f.name for f in schema.fields])

    return events.repartition("block").sortWithinPartitions("block", "is_doc").mapInArrow(run, schema)


def align(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, keep_groups: bool = False) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum,
    and with ``keep_groups`` the groups as text."""
    documents, partial = encode_corpus(docs, a_file, b_file, keep_groups)
    postings = merged_postings(partial)
    return scored_documents(documents, postings, pair_counts(postings))


def alignment_table(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """The linked pairs of a corpus with their document and link counts."""
    _, partial = encode_corpus(docs, a_file, b_file)
    return pair_counts(merged_postings(partial)).drop("pair")
