"""Helpers shared by the training-data operators.

Texts reach Python as Arrow batches. The helpers below look at the batch's byte
buffer as one numpy array and find the words of all its texts at once, so the
cost per word is a few array operations instead of a Python object.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java and Python pattern of one word; everything else of ASCII white space separates.
WORD = r"[^\x20\x09-\x0D]+"

#: Separator bytes of the plain word rule.
SPACE_TABLE = np.zeros(256, bool)
SPACE_TABLE[[9, 10, 11, 12, 13, 32]] = True

#: Separator bytes of the letters-and-digits rule (words: 0-9, a-z after lower-casing,
#: and every byte of a non-ASCII character).
ALNUM_SEP_TABLE = np.ones(256, bool)
ALNUM_SEP_TABLE[0x30:0x3A] = False
ALNUM_SEP_TABLE[0x41:0x5B] = False
ALNUM_SEP_TABLE[0x61:0x7B] = False
ALNUM_SEP_TABLE[0x80:] = False

#: A-Z to a-z, other bytes unchanged.
LOWER_TABLE = np.arange(256, dtype=np.uint8)
LOWER_TABLE[0x41:0x5B] += 32

_M1 = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xBF58476D1CE4E5B9)
_M3 = np.uint64(0x94D049BB133111EB)


def word_count(text: Column | str) -> Column:
    """Number of words of a text column, 0 for null (JVM side)."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("bigint")


def mix64(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (wrapping arithmetic)."""
    h = (h ^ (h >> np.uint64(30))) * _M2
    h = (h ^ (h >> np.uint64(27))) * _M3
    return h ^ (h >> np.uint64(31))


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column as one array, and the n+1 offsets of its
    rows; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    bufs = col.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[col.offset:col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


class Words:
    """The words of a run of texts: byte spans, and where each text's words begin."""

    __slots__ = ("buf", "starts", "ends", "first")

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, sep: np.ndarray = SPACE_TABLE):
        inside = ~sep[buf]
        before = np.empty(len(buf), bool)
        after = np.empty(len(buf), bool)
        if len(buf):
            before[0], before[1:] = False, inside[:-1]
            after[-1], after[:-1] = False, inside[1:]
            cuts = offsets[(offsets > 0) & (offsets < len(buf))]
            before[cuts] = False
            after[cuts - 1] = False
        self.buf = buf
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        #: words of text i are first[i]:first[i + 1]
        self.first = np.searchsorted(self.starts, offsets)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word's bytes (equal words, equal hashes)."""
        lens = self.ends - self.starts
        out = lens.astype(np.uint64) * _M1
        padded = np.concatenate([self.buf, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(self.buf) + 1,), np.dtype("<u8"), padded.data, strides=(1,))
        todo = np.flatnonzero(lens <= 4096)
        pos, rem = self.starts[todo], lens[todo]
        while len(todo):
            block = eight[pos]
            short = rem < 8
            block[short] &= (np.uint64(1) << (rem[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
            out[todo] = mix64(out[todo] ^ block)
            more = rem > 8
            todo, pos, rem = todo[more], pos[more] + 8, rem[more] - 8
        for i in np.flatnonzero(lens > 4096):
            d = hashlib.blake2b(self.buf[self.starts[i]:self.ends[i]].tobytes(), digest_size=8).digest()
            out[i] = np.frombuffer(d, "<u8")[0]
        return out


#: Bytes of text that a task looks at in one go. The arrays made from them take some tens of
#: bytes per word, and a Python worker keeps part of its peak between tasks.
RUN_BYTES = 2 << 20


def pieces(offsets: np.ndarray, max_bytes: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``max_bytes`` bytes (at least one row each)."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + max_bytes, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def text_runs(col: pa.Array, max_bytes: int = RUN_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for bounded runs of a string column."""
    buf, off = text_buffer(col)
    for i, j in pieces(off, max_bytes):
        yield i, j, buf[off[i]:off[j]], off[i:j + 1] - off[i]


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours (len(v) - width + 1 values)."""
    have, m = 1, v
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    rest = width - have
    return np.minimum(m[:len(m) - rest], m[rest:]) if rest else m


def concat_ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """All integers of the ranges [start, start + len), one range after the other."""
    if len(lens) == 0 or lens.sum() == 0:
        return np.zeros(0, np.int64)
    keep = lens > 0
    starts, lens = starts[keep], lens[keep]
    step = np.ones(int(lens.sum()), np.int64)
    step[0] = starts[0]
    at = np.cumsum(lens)[:-1]
    step[at] = starts[1:] - (starts[:-1] + lens[:-1] - 1)
    return np.cumsum(step)
