"""Substring dedup with suffix automata.

A window is ``window`` (20) consecutive words of one document. A word is removed if a
window that covers it has the same words as a window that starts earlier (smaller
doc_id, or the same document and an earlier start). Windows are judged on the input.

``remove_against`` takes a reference table: stretches of both tables' windows whose anchors
(see below) occur on both sides meet in shards of bounded length, where the documents' are
streamed through the suffix automaton of the reference's for their matching statistics (the
longest match that ends at each word); maximal spans of at least ``window`` matched words go.

``repeated_spans`` deduplicates a corpus against itself. There the reference is all
earlier text, so its shards must not meet every document. They are routed:

* the smallest hash of the 4-word grams of a window is its anchor; equal windows have
  equal anchors, and a document has about one anchor for nine words;
* anchors are counted in Spark; windows whose anchor occurs once cannot repeat;
* an anchor that occurs twice or more belongs to the shard of the smallest document
  key that holds it, so near copies of one text meet in one shard; a shard with more
  anchors than ``SHARD_ANCHORS`` is dealt out further by anchor, and an anchor that more
  than ``HOT_ANCHOR`` documents hold is dealt out by a second anchor, the smallest gram in
  another order. A stretch of windows of one shard travels there as one segment. Of equal
  segments of a batch only the first does; the others are repeats already, and what
  touches in one document is one row;
* a shard's segments stream through its automaton in document order. Extending the
  automaton by a word gives the longest suffix seen before, that is the matching
  statistic against all earlier text of the shard; windows with 20 or more go.

Hashes choose the shard only; words are compared as they are.

Cases: a null text has no words; a null doc_id sorts last (as the largest number); rows equal
in doc_id and text count as one document; rows with one doc_id and different texts are
ordered by a hash of the text; an empty table gives an empty result; other columns are
kept, and helper columns carry the prefix ``_sub_``. ``doc_id`` is a whole number: the order of
documents is its order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tyscope.llm.common import Words, mix64, sliding_min, text_runs
from tyscope.session import materialize, ship_package

WINDOW = 20
GRAM = 4
SHARD_ANCHORS = 4_000
HOT_ANCHOR = 1_000
SHARD_WORDS = 200_000
LAST_ID = 2 ** 63 - 1

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


class Automaton:
    """Suffix automaton of words that grows a segment at a time."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, words: list[bytes]) -> list[int]:
        """Append a segment; for each of its words, the length of the longest match that
        ends there and also ended earlier (in this segment or before it)."""
        nxt, link, length = self.next, self.link, self.length
        last, seen = 0, []
        for c in words:
            q = nxt[last].get(c)
            if q is not None:
                if length[q] != length[last] + 1:
                    q = self._clone(last, c, q)
                last = q
                seen.append(length[q])
                continue
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0:
                q = nxt[p].get(c)
                if q is not None:
                    link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
                    break
                nxt[p][c] = cur
                p = link[p]
            last = cur
            seen.append(length[link[cur]])
        return seen

    def _clone(self, p: int, c: bytes, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(nxt[q].copy())
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = new
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def match(self, words: list[bytes]) -> list[int]:
        """Matching statistics of words that are not added."""
        nxt, link, length = self.next, self.link, self.length
        state, have, seen = 0, 0, []
        for c in words:
            while state and c not in nxt[state]:
                state = link[state]
                have = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                have += 1
            seen.append(have)
        return seen


def spans_of(seen: list[int], window: int) -> list[tuple[int, int]]:
    """Maximal spans [a, b) covered by windows that end where ``seen`` reaches ``window``."""
    spans: list[list[int]] = []
    for i, n in enumerate(seen):
        if n >= window:
            a = i + 1 - window
            if spans and a <= spans[-1][1]:
                spans[-1][1] = i + 1
            else:
                spans.append([a, i + 1])
    return [(a, b) for a, b in spans]


def window_anchors(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor of every window, whether the window is inside one text, gram hashes); the
    lowest bit of an anchor is 0."""
    n = len(words.starts)
    if n < window:
        return np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, np.uint64)
    w = words.hashes()
    size = min(GRAM, window)
    gram = np.zeros(n - size + 1, np.uint64)
    for j in range(size):
        gram += w[j:n - size + 1 + j] * _ODD[j]
    gram = mix64(gram) & ~np.uint64(1)
    lowest = sliding_min(gram, window - size + 1)
    end = np.repeat(words.first[1:], np.diff(words.first))[:len(lowest)]
    return lowest, np.arange(len(lowest)) + window <= end, gram


def _profile_batches(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """text -> n_words, sha256 of the words, the distinct anchors (lowest bit: the gram
    occurs twice or more in this very text)."""
    for b in batches:
        rest = [c for c in b.schema.names if c != "text"]
        for i, j, buf, off in text_runs(b.column("text")):
            words = Words(buf, off)
            anchor, inside, gram = window_anchors(words, window)
            row = np.repeat(np.arange(j - i), np.diff(words.first))
            at = np.flatnonzero(inside)
            if len(at):
                new = np.concatenate([[True], (anchor[at[1:]] != anchor[at[:-1]]) | (row[at[1:]] != row[at[:-1]])])
                at = at[new]
            order = np.lexsort((anchor[at], row[at]))
            a, r = anchor[at][order], row[at][order]
            keep = np.concatenate([[True], (a[1:] != a[:-1]) | (r[1:] != r[:-1])]) if len(a) else np.zeros(0, bool)
            a, r = a[keep], r[keep]
            if len(a):
                salt = mix64(np.arange(1, j - i + 1, dtype=np.uint64) * _ODD[0])
                own = np.sort(gram ^ salt[row[:len(gram)]])
                probe = a ^ salt[r]
                a = a | (np.searchsorted(own, probe, "right") - np.searchsorted(own, probe) > 1).astype(np.uint64)
            data = buf.tobytes()
            sha = [hashlib.sha256(b" ".join(data[off[k]:off[k + 1]].split())).hexdigest() for k in range(j - i)]
            anchors = pa.ListArray.from_arrays(pa.array(np.searchsorted(r, np.arange(j - i + 1)).astype(np.int32)),
                                               pa.array(a.view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c).slice(i, j - i) for c in rest), pa.array(np.diff(words.first)), pa.array(sha), anchors],
                [*rest, "n_words", "sha", "anchors"])


def _hot_shard(gram: np.ndarray, at: np.ndarray, shard: np.ndarray, window: int) -> np.ndarray:
    """The part of a hot anchor's shard that a window goes to: by a second anchor, the smallest of
    its grams in another order. Neighbouring windows mostly share it, equal windows always."""
    second = sliding_min(mix64(gram ^ _ODD[2]), window - min(GRAM, window) + 1)[at]
    return mix64(shard.view(np.uint64) + mix64(second) * _ODD[1]).view(np.int64)


def merged_places(places: list[tuple]) -> list[tuple]:
    """(id, th, start, n) spans with those of a document that overlap or touch put together."""
    out: list[tuple] = []
    for i, t, start, n in sorted(places):
        if out and out[-1][:2] == (i, t) and start <= out[-1][2] + out[-1][3]:
            out[-1] = (i, t, out[-1][2], max(out[-1][3], start + n - out[-1][2]))
        else:
            out.append((i, t, start, n))
    return out


def _segment_batches(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Texts with their repeated anchors -> segments (shard, id, th, start, n, words); of
    equal segments of a run only the first has words, the others are known repeats, whose
    neighbours are one row and which go anywhere."""
    for b in batches:
        ids, ths = b.column("_sub_id").to_pylist(), b.column("_sub_th").to_pylist()
        hits = b.column("hits").combine_chunks() if isinstance(b.column("hits"), pa.ChunkedArray) else b.column("hits")
        flat = hits.flatten()
        known, first = np.unique(flat.field("h").to_numpy(zero_copy_only=False), return_index=True)
        shard_of = flat.field("shard").to_numpy(zero_copy_only=False)[first]
        hot_of = flat.field("hot").to_numpy(zero_copy_only=False)[first]
        for i, j, buf, off in text_runs(b.column("text")):
            words = Words(buf, off)
            anchor, inside, gram = window_anchors(words, window)
            if not inside.any():
                continue
            anchor = anchor.view(np.int64)
            at = np.minimum(np.searchsorted(known, anchor), len(known) - 1)
            use = np.flatnonzero(inside & (known[at] == anchor))
            if not len(use):
                continue
            shard = shard_of[at[use]]
            row = np.searchsorted(words.first, use, "right") - 1
            hot = hot_of[at[use]]
            if hot.any():
                shard[hot] = _hot_shard(gram, use[hot], shard[hot], window)
            cut = np.flatnonzero((np.diff(use) != 1) | (np.diff(shard) != 0) | (np.diff(row) != 0)) + 1
            a, z = use[np.concatenate([[0], cut])], use[np.concatenate([cut - 1, [len(use) - 1]])] + window
            shard, row = shard[np.concatenate([[0], cut])], row[np.concatenate([[0], cut])]
            data = buf.tobytes()
            out: dict[tuple, list] = {}
            done = []
            for s, r, x, y in zip(shard.tolist(), row.tolist(), a.tolist(), z.tolist()):
                text = b" ".join(data[words.starts[x]:words.ends[y - 1]].split())
                here = (ids[i + r], ths[i + r], x - int(words.first[r]), y - x)
                before = out.get((s, text))
                if before is None:
                    out[s, text] = here
                elif before[:3] != here[:3]:
                    out[s, text] = min(before, here)
                    done.append(max(before, here))
            rows = ([(s, *here, text) for (s, text), here in out.items()]
                    + [(here[0] ^ here[1], *here, None) for here in merged_places(done)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(),
                                                            pa.binary()))], ["shard", "id", "th", "start", "n", "words"])


def _repeat_batches(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Segments sorted by shard and document -> the spans that repeat earlier text."""
    shard, automaton, before = None, Automaton(), None
    for b in batches:
        found = []
        for s, i, t, start, n, text in zip(*(b.column(c).to_pylist() for c in ("shard", "id", "th", "start", "n", "words"))):
            if text is None:  # known already
                found.append((i, t, start, n))
                continue
            if s != shard:
                shard, automaton, before = s, Automaton(), None
            if (i, t, start) == before:
                continue  # a row that repeats in doc_id and text
            before = (i, t, start)
            found += [(i, t, start + a, z - a) for a, z in spans_of(automaton.add(text.split()), window)]
        cols = list(zip(*found)) or [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["id", "th", "start", "n"])


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("*", F.coalesce("doc_id", F.lit(LAST_ID)).cast("bigint").alias("_sub_id"),
                       F.xxhash64("text").alias("_sub_th"))


def keyed_texts(docs: DataFrame) -> DataFrame:
    return keyed(docs.select("doc_id", "text")).select("_sub_id", "_sub_th", "text")


def profile(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One stored row per document: _sub_id, _sub_th, doc_id, n_words, sha, anchors."""
    ship_package(docs.sparkSession)
    rows = keyed(docs.select("doc_id", "text"))
    return materialize(rows.select("doc_id", "_sub_id", "_sub_th", "text").mapInArrow(
        lambda it: _profile_batches(it, window),
        "doc_id bigint, _sub_id bigint, _sub_th bigint, n_words bigint, sha string, anchors array<bigint>"), "anchors")


def routed_segments(docs: DataFrame, profiles: DataFrame, window: int = WINDOW,
                    shard_anchors: int = SHARD_ANCHORS, hot_anchor: int = HOT_ANCHOR) -> DataFrame:
    """The stretches of windows whose anchor repeats, with the shard they belong to (see ``_segment_batches``)."""
    one = F.lit(1).cast("bigint")
    anchors = (profiles.select("_sub_id", "_sub_th", F.xxhash64("_sub_id", "_sub_th").alias("rid"),
                               F.explode("anchors").alias("a"))
               .select("_sub_id", "_sub_th", "rid", F.col("a").bitwiseAND(~1).alias("h"),
                       F.col("a").bitwiseAND(1).alias("own")))
    repeated = (anchors.select("h", "rid", "own").groupBy("h")
                .agg(F.min("rid").alias("f"), F.max("rid").alias("g"), F.max("own").alias("own"), F.count(one).alias("n"))
                .where("f < g or own = 1").select("h", "f", "n"))
    repeated = materialize(repeated, "repeated-anchors")
    large = (repeated.where(F.col("n") <= hot_anchor).groupBy("f").agg(F.sum("n").alias("total")).where(F.col("total") > shard_anchors)
             .select("f", F.ceil(F.col("total") / shard_anchors).alias("parts")))
    shards = (repeated.join(large, "f", "left")
              .withColumn("hot", F.col("n") > hot_anchor)
              .select("h", F.when(F.col("hot"), F.xxhash64("h"))
                      .otherwise(F.xxhash64("f", F.pmod(F.shiftright("h", 1), F.coalesce("parts", F.lit(1))))).alias("shard"),
                      "hot"))
    hits = (anchors.join(shards, "h").groupBy("_sub_id", "_sub_th")
            .agg(F.collect_list(F.struct("h", "shard", "hot")).alias("hits")))
    # not stored: the caller joins the spans with the same texts, whose shuffle Spark then uses again
    return (keyed_texts(docs).join(hits, ["_sub_id", "_sub_th"]).select("_sub_id", "_sub_th", "text", "hits")
            .mapInArrow(lambda it: _segment_batches(it, window),
                        "shard bigint, id bigint, th bigint, start int, n int, words binary"))


def repeated_spans(docs: DataFrame, profiles: DataFrame, window: int = WINDOW, **shards) -> DataFrame:
    """Per document with a repeat: _sub_id, _sub_th, spans (array of start, n in words;
    they may overlap). ``profiles`` is ``profile(docs)``."""
    spans = (routed_segments(docs, profiles, window, **shards).repartition("shard").sortWithinPartitions("shard", "id", "th", "start")
             .mapInArrow(lambda it: _repeat_batches(it, window), "id bigint, th bigint, start int, n int"))
    return (spans.groupBy(F.col("id").alias("_sub_id"), F.col("th").alias("_sub_th"))
            .agg(F.collect_list(F.struct("start", "n")).alias("spans")))


def _cut(text: bytes, spans: list[dict]) -> tuple[bytes, list[bytes], int]:
    """The text without the words of the spans, the words left, and how many went."""
    words = Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    n = len(words.starts)
    gone = np.zeros(n + 1, np.int32)
    for s in spans:
        gone[s["start"]] += 1
        gone[s["start"] + s["n"]] -= 1
    gone = np.cumsum(gone[:-1]) > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    parts, at = [], 0
    for a, z in edge.reshape(-1, 2).tolist():
        parts.append(text[at:words.starts[a]])
        at = int(words.starts[z]) if z < n else len(text)
    parts.append(text[at:])
    left = b"".join(parts)
    return left, left.split(), int(gone.sum())


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, j, buf, off in text_runs(b.column("text")):
            removed, sha = [], []
            for x, y, spans in zip(off[:-1], off[1:], b.column("spans").slice(i, j - i).to_pylist()):
                _, words, n = _cut(buf[x:y].tobytes(), spans)
                removed.append(n)
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column("_sub_id").slice(i, j - i), b.column("_sub_th").slice(i, j - i), pa.array(removed, pa.int64()),
                 pa.array(sha, pa.string())], ["_sub_id", "_sub_th", "n_removed", "kept"])


def dedup_digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    profiles = profile(docs, window)
    spans = repeated_spans(docs, profiles, window)
    cut = (keyed_texts(docs).join(spans, ["_sub_id", "_sub_th"]).select("_sub_id", "_sub_th", "text", "spans")
           .mapInArrow(_digest_batches, "_sub_id bigint, _sub_th bigint, n_removed bigint, kept string").distinct())
    return profiles.drop("anchors").join(cut, ["_sub_id", "_sub_th"], "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("kept", "sha").alias("kept_sha256"))


def _text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at = b.schema.get_field_index("text")
        keep = [k for k, c in enumerate(b.schema.names) if c != "_sub_spans"]
        for i, j, _, _ in text_runs(b.column(at)):
            part = b.slice(i, j - i)
            texts = part.column(at).to_pylist()
            for k, spans in enumerate(part.column("_sub_spans").to_pylist()):
                if spans:
                    texts[k] = _cut(texts[k].encode(), spans)[0].decode()
            cols = [pa.array(texts, part.column(at).type) if k == at else part.column(k) for k in keep]
            yield pa.RecordBatch.from_arrays(cols, [b.schema.names[k] for k in keep])


def without_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with the spans' words cut out of text (other white space stays)."""
    rows = (keyed(docs).join(spans.withColumnRenamed("spans", "_sub_spans"), ["_sub_id", "_sub_th"], "left")
            .select(*docs.columns, "_sub_spans"))
    return rows.mapInArrow(_text_batches, docs.schema)


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with every repeated span cut out of text; no row goes."""
    return without_spans(docs, repeated_spans(docs, profile(docs, window), window))


def _place_batches(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Texts with their shared anchors -> (shard, words, places): a stretch of windows of one
    shard, which travels once for all its places in a run."""
    kinds = (pa.int64(), pa.binary(), pa.list_(pa.struct([("id", pa.int64()), ("th", pa.int64()), ("start", pa.int32())])))
    for b in batches:
        ids, ths, hits = (b.column(c).to_pylist() for c in ("_sub_id", "_sub_th", "hits"))
        shards = {x["h"]: (x["shard"], x["hot"]) for row in hits for x in row}
        known = np.array(sorted(shards), np.int64)
        shard_of, hot_of = (np.array([shards[h][k] for h in known.tolist()], t) for k, t in ((0, np.int64), (1, bool)))
        for i, j, buf, off in text_runs(b.column("text")):
            words = Words(buf, off)
            anchor, inside, gram = window_anchors(words, window)
            anchor = anchor.view(np.int64)
            at = np.minimum(np.searchsorted(known, anchor), len(known) - 1)
            use = np.flatnonzero(inside & (known[at] == anchor))
            if not len(use):
                continue
            shard, hot = shard_of[at[use]], hot_of[at[use]]
            if hot.any():
                shard[hot] = _hot_shard(gram, use[hot], shard[hot], window)
            row = np.searchsorted(words.first, use, "right") - 1
            cut = np.flatnonzero((np.diff(use) != 1) | (np.diff(shard) != 0) | (np.diff(row) != 0)) + 1
            first, last = np.concatenate([[0], cut]), np.concatenate([cut - 1, [len(use) - 1]])
            data = buf.tobytes()
            out: dict[tuple, list] = {}
            for s, r, x, y in zip(shard[first].tolist(), row[first].tolist(), use[first].tolist(), (use[last] + window).tolist()):
                text = b" ".join(data[words.starts[x]:words.ends[y - 1]].split())
                out.setdefault((s, text), []).append({"id": ids[i + r], "th": ths[i + r], "start": x - int(words.first[r])})
            cols = ([s for s, _ in out], [text for _, text in out], list(out.values()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["shard", "words", "places"])


def _against_batches(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Stretches sorted by shard, the reference's (without places) first -> matched spans."""
    shard, automaton = None, Automaton()
    for b in batches:
        found = []
        for s, text, places in zip(*(b.column(c).to_pylist() for c in ("shard", "words", "places"))):
            if s != shard:
                shard, automaton = s, Automaton()
            if places is None:
                automaton.add(text.split())
                continue
            for a, z in spans_of(automaton.match(text.split()), window):
                found += [(p["id"], p["th"], p["start"] + a, z - a) for p in places]
        cols = list(zip(*found)) or [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))],
            ["_sub_id", "_sub_th", "start", "n"])


def remove_against(docs: DataFrame, reference: DataFrame, window: int = WINDOW,
                   shard_words: int = SHARD_WORDS, hot_anchor: int = HOT_ANCHOR) -> DataFrame:
    """``docs`` without the spans of ``window`` or more words that occur in ``reference``
    (column text), in shards of about ``shard_words`` reference words."""
    tables = [docs.select("doc_id", "text"), reference.select(F.lit(None).cast("bigint").alias("doc_id"), "text")]
    anchors = [profile(t, window).select("_sub_id", "_sub_th", F.explode("anchors").alias("a"))
               .select("_sub_id", "_sub_th", F.col("a").bitwiseAND(~1).alias("h")) for t in tables]
    counts = [a.groupBy("h").agg(F.count(F.lit(1)).alias(n)) for a, n in zip(anchors, ("n", "r"))]
    shared = materialize(counts[0].join(counts[1], "h"), "shared-anchors")
    total = shared.agg(F.sum("r")).first()[0]
    if total is None:
        return docs
    most = F.greatest("n", "r")
    hot = most > hot_anchor
    parts = -(-total * window // shard_words)
    shards = shared.select(
        "h", F.when(hot, F.xxhash64("h")).otherwise(F.pmod(F.xxhash64("h"), F.lit(parts))).alias("shard"), hot.alias("hot"))
    stretches = []
    for table, a in zip(tables, anchors):
        hits = (a.join(shards, "h").groupBy("_sub_id", "_sub_th")
                .agg(F.collect_list(F.struct("h", "shard", "hot")).alias("hits")))
        stretches.append(keyed(table).join(hits, ["_sub_id", "_sub_th"]).select("_sub_id", "_sub_th", "text", "hits").mapInArrow(
            lambda it: _place_batches(it, window), "shard bigint, words binary, places array<struct<id bigint, th bigint, start int>>"))
    both = stretches[0].union(stretches[1].withColumn("places", F.lit(None).cast(stretches[1].schema["places"].dataType)))
    spans = (both.repartition("shard").sortWithinPartitions("shard", F.col("places").isNotNull())
             .mapInArrow(lambda it: _against_batches(it, window), "_sub_id bigint, _sub_th bigint, start int, n int").distinct())
    return without_spans(docs, spans.groupBy("_sub_id", "_sub_th").agg(F.collect_list(F.struct("start", "n")).alias("spans")))
