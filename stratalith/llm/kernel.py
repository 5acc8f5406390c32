"""Word and window hashes over Arrow string columns, in numpy. Memory is bounded by a slice of rows and the longest text in it."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: True for the bytes that separate words: blank and 0x09 to 0x0D.
BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: True for the bytes outside [0-9a-z] and non-ASCII, after lower-casing.
NOT_ALNUM = np.array([b < 128 and not (48 <= b <= 57 or 97 <= b <= 122) for b in range(256)])
#: A-Z to a-z.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_STEP = 1 << 19


def released(run: Callable) -> Callable:
    """run, a function of batches; when its task ends, the worker gives the memory back that it no longer needs, for others to use."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
            if trim is not None:
                trim(0)

    return wrapped


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
_BASE = 0xD6E8FEB86659FD93
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** (0 .. n-1) modulo 2^64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 4096), U(base))
        have[0] = 1
        _POWERS[base] = have = np.multiply.accumulate(have)
    return have[:n]


_INVERSE = pow(_BASE, -1, 1 << 64)


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows, and the offset of each row's first byte and of the end. A null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about limit bytes of text; one longer text is a run of its own."""
    _, at = utf8(batch.column(text))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j


class Words:
    """The words of some rows: starts and ends (bytes), row (of each word), first (word of each row, then the number of words)."""

    def __init__(self, column, separators: np.ndarray = BLANK, lower: bool = False):
        data, at = utf8(column)
        self.raw, self.at = data, at
        self.data = LOWER[data] if lower else data
        self.rows = len(at) - 1
        inside = ~separators[self.data]
        if len(data):
            begins, ends = inside.copy(), inside.copy()
            begins[1:] &= ~inside[:-1]
            ends[:-1] &= ~inside[1:]
            heads = at[:-1][at[:-1] < at[1:]]
            begins[heads] = inside[heads]
            tails = heads[heads > 0] - 1
            ends[tails] = inside[tails]
            self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        else:
            self.starts = self.ends = np.zeros(0, np.int64)
        self.row = np.searchsorted(at, self.starts, side="right") - 1
        self.counts = np.bincount(self.row, minlength=self.rows).astype(np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.counts)))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        out = np.empty(len(self.starts), np.uint64)
        i = 0
        while i < len(out):
            j = max(i + 1, int(np.searchsorted(self.ends, self.starts[i] + _STEP, side="right")))
            low, high = self.starts[i], self.ends[j - 1]
            terms = _BYTE[self.data[low:high]]
            terms *= _powers(_BASE, len(terms))
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))
            a, b = self.starts[i:j] - low, self.ends[i:j] - low
            out[i:j] = mixed((sums[b] - sums[a]) * _powers(_INVERSE, len(terms))[a] + (b - a).astype(np.uint64))
            i = j
        return out

    def window_starts(self, length: int) -> np.ndarray:
        """The words at which a window of so many words of one row starts."""
        n = len(self.starts)
        if n < length:
            return np.zeros(0, np.int64)
        i = np.arange(n - length + 1)
        return i[self.row[i] == self.row[i + length - 1]]


def windows(hashes: np.ndarray, length: int, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the windows of so many hashes that start at the given places."""
    terms = hashes * _powers(_BASE, len(hashes))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))
    return mixed((sums[at + length] - sums[at]) * _powers(_INVERSE, max(1, len(hashes)))[at] + U(length))


class Lookup:
    """Places of known 64-bit hashes, by open addressing; the table has at least four slots a key."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.mask = U((1 << max(4, (4 * len(keys)).bit_length())) - 1)
        self.slots = np.full(int(self.mask) + 1, -1, np.int32)
        left, at = np.arange(len(keys)), (keys & self.mask).astype(np.int64)
        while len(left):
            free = self.slots[at] < 0
            where, first = np.unique(at[free], return_index=True)
            self.slots[where] = left[free][first]
            stays = self.slots[at] != left
            left, at = left[stays], (at[stays] + 1) & int(self.mask)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash among the keys, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        if not len(self.keys):
            return out
        left, at = np.arange(len(hashes)), (hashes & self.mask).astype(np.int64)
        while len(left):
            slot = self.slots[at]
            same = (slot >= 0) & (self.keys[slot] == hashes[left])
            out[left[same]] = slot[same]
            on = (slot >= 0) & ~same
            left, at = left[on], (at[on] + 1) & int(self.mask)
        return out
