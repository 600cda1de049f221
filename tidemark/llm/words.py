"""Words of whole texts as numpy arrays.

A word is a maximal run without the characters x20 and x09 to x0D. All functions work on
slices of Arrow batches of about a megabyte, so memory is bounded by the slice or the longest text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
#: Distinct words that a worker remembers what it found of: some tens of megabytes, however many a table has.
REMEMBERED = 60_000
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Table:
    """Powers of a base, as many as were asked for so far."""

    def __init__(self, base: int) -> None:
        self.base, self.values = base, _powers(base, 1024)

    def upto(self, n: int) -> np.ndarray:
        if len(self.values) < n:
            self.values = _powers(self.base, max(n, 2 * len(self.values)))
        return self.values[:n]


_UP, _DOWN = _Table(_BASE), _Table(_INVERSE)


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidied(run: Run) -> Run:
    """run, with what a task has freed given back to the system at its end: a worker serves many tasks, and keeps it otherwise."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return whole


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column that hold at most `most` bytes, or one row."""
    if not len(column):
        return
    ends = offsets(column)[1:]
    start, base = 0, offsets(column)[0]
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
        yield start, stop
        start, base = stop, ends[stop - 1]


def offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


@dataclass
class Words:
    """Words of some texts; positions are bytes of `data`."""

    data: np.ndarray
    at: np.ndarray  # of texts: offsets, one more than there are texts
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # of texts: number of the first word, one more than there are texts

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sums of a byte-wise array by text."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.at[1:]] - total[self.at[:-1]]

    def per_doc_words(self, values: np.ndarray) -> np.ndarray:
        """Sums of a word-wise array by text."""
        total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return total[self.first[1:]] - total[self.first[:-1]]

    def strings(self) -> pa.Array:
        """The words as a string column."""
        size = self.end - self.start
        ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        return pa.StringArray.from_buffers(len(size), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(self.data[~SPACE[self.data]])))

    def hashes(self) -> np.ndarray:
        """64 bits of each word's bytes."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        size = self.end - self.start
        begin = np.concatenate([[0], np.cumsum(size)])
        within = np.arange(begin[-1]) - np.repeat(begin[:-1], size)
        values = _BYTE[self.data[within + np.repeat(self.start, size)]]
        values *= _UP.upto(int(size.max()))[within]
        return mix(np.add.reduceat(values, begin[:-1]) + size.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def words_of(column: pa.Array) -> Words:
    """The words of a string column; a null is an empty text."""
    column = column.fill_null("") if column.null_count else column
    at = offsets(column) if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2] if len(column) else None
    data = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    solid = ~SPACE[data]
    head = np.empty(len(data) + 1, bool)  # the first byte of a text or the one after a space
    head[0], head[1:] = True, ~solid
    head[at] = True
    start = np.flatnonzero(solid & head[:-1])
    tail = np.empty(len(data) + 1, bool)
    tail[:-1], tail[-1] = ~solid, True
    tail[at] = True
    end = np.flatnonzero(solid & tail[1:]) + 1
    doc = np.searchsorted(at[:-1], start, "right") - 1
    first = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(column)))]).astype(np.int64)
    return Words(data, at, start, end, doc, first)


class Ranges:
    """Hashes of any range of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray) -> None:
        n = len(values)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(values * _UP.upto(n) if n else values, dtype=np.uint64, out=self.total[1:])
        self.down = _DOWN.upto(n + 1)

    def hashes(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Equal for equal values in [start, stop), wherever they stand."""
        x = (self.total[stop] - self.total[start]) * self.down[start]
        return mix(x + (stop - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))

    def windows(self, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows that lie in one text, and their hashes."""
        start = window_starts(first, size)
        return start, self.hashes(start, start + size)


def window_starts(first: np.ndarray, size: int) -> np.ndarray:
    count = np.maximum(np.diff(first) - size + 1, 0)
    begin = np.concatenate([[0], np.cumsum(count)])
    return np.arange(begin[-1]) - np.repeat(begin[:-1], count) + np.repeat(first[:-1], count)


def covered(start: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n words lie in one of the windows that begin at start."""
    if not len(start):
        return np.zeros(n, bool)
    step = np.bincount(start, minlength=n + 1) - np.bincount(start + size, minlength=n + 1)
    return np.cumsum(step)[:n] > 0
