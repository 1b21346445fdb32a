"""Helpers that the operators of this subpackage share.

Text is handled as bytes in numpy, about a megabyte at a time: words, their 64-bit
hashes and the hashes of word n-grams are computed for many documents at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..checkpoints import drop, scratch, stash  # noqa: F401

U64 = np.uint64
#: Text bytes that are turned into hashes at a time; a longer document is a piece of its own.
PIECE_BYTES = 1 << 20

#: Bytes that separate words: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[list(BLANKS)] = False
#: ASCII letters and digits and every byte of a longer code point.
LETTERS = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
SAME = np.arange(256, dtype=np.uint8)

_BASE = U64(0x9E3779B97F4A7C15)
_STEP = U64(0xD6E8FEB86659FD93)
_STEP_INVERSE = U64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (finaliser of splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_powers = {0: np.ones(1, U64)}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), modulo 2**64; kept for the next call."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(1024, 2 * n), base, U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if len(have) <= 1 << 21:
            _powers[int(base)] = have
    return have[:n]


class Words:
    """Words of some documents: bytes from start to end in data, a hash each, and per document the first word's number."""

    __slots__ = ("data", "end", "first", "hash", "start")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, fold: np.ndarray):
        self.data = data
        n = len(data)
        if not n:
            self.start = self.end = np.zeros(0, np.int64)
            self.hash, self.first = np.zeros(0, U64), np.zeros(len(offsets), np.int64)
            return
        word = inside[data]
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        at = offsets[:-1][offsets[:-1] < n]
        begins[at] = word[at]
        ends = word.copy()
        ends[:-1] &= ~word[1:]
        last = offsets[1:][offsets[1:] > 0] - 1
        ends[last] = word[last]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        if not len(self.start):
            self.hash = np.zeros(0, U64)
            return
        span = np.diff(self.start, append=n)
        place = np.arange(n, dtype=np.int64)
        place[self.start[0] :] -= np.repeat(self.start, span)
        place[: self.start[0]] = 0
        x = powers(_BASE, int(span.max() if len(span) else 0) + self.start[0] + 1)[place]
        x *= (fold[data].astype(U64) + U64(1)) * word
        self.hash = mix(np.add.reduceat(x, self.start) + (self.end - self.start).astype(U64))

    def sums(self) -> np.ndarray:
        """Sums from which spans() takes the hash of any run of words."""
        out = np.zeros(len(self.hash) + 1, U64)
        np.cumsum(self.hash * powers(_STEP, len(self.hash)), out=out[1:])
        return out

    def grams(self, n: int, seed: int = 0) -> np.ndarray:
        """Hashes of n consecutive words, by the first one's number; those that would cross a document's end are to be left out."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.zeros(0, U64)
        if seed:
            other = Words.__new__(Words)
            other.hash = mix(self.hash ^ U64(seed))
            return other.grams(n)
        if n > 12:
            sums = self.sums()
            return mix((sums[n:] - sums[:-n]) * powers(_STEP_INVERSE, m))
        out = self.hash[:m].copy()
        for j in range(1, n):
            out *= _STEP
            out += self.hash[j : j + m]
        return mix(out + U64(n))


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the runs of words from start to before end; sums: of Words.sums()."""
    return mix((sums[end] - sums[start]) * powers(_STEP_INVERSE, len(sums))[start] + (end - start).astype(U64))


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str, most: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past the last row, bytes, offsets) of runs of rows with about `most` bytes of text."""
    data, offsets = texts(batch.column(column))
    row, rows = 0, len(offsets) - 1
    while row < rows:
        to = int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1
        to = min(max(to, row + 1), rows)
        yield row, to, data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row]
        row = to


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
