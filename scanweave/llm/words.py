"""Words and word-window hashes of Arrow string columns, vectorised over a whole batch."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; arrays of eight bytes for each of them are made.
PIECE = 1_000_000


def give_back() -> None:
    """Free memory of this worker goes back to the system: workers outlive their tasks, and allocators keep what large arrays took."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def pieces(batches: Iterator[pa.RecordBatch], column: str | int = 0, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Slices of batches with about ``most`` bytes in a string or binary column, or a single longer row."""
    for batch in batches:
        at = size = 0
        for k, x in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
            if size and size + x > most:
                yield batch.slice(at, k - at)
                at, size = k, 0
            size += x
        if at < batch.num_rows:
            yield batch.slice(at)
        del batch
        give_back()


def lookup(*ranges: tuple[int, int]) -> np.ndarray:
    """Which bytes are in one of the ranges, ends included."""
    lut = np.zeros(256, bool)
    for lo, hi in ranges:
        lut[lo : hi + 1] = True
    return lut


#: Bytes of words that end at ASCII white space.
SPACED = ~lookup((0x20, 0x20), (0x09, 0x0D))
#: Bytes of words of ASCII digits and letters and everything beyond ASCII.
ALNUM = lookup((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))

_M = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values, so that all bits of a sum count."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(8)
def _byte_codes(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * _M + np.uint64(seed * 7919))


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse; grown on demand."""

    def __init__(self, seed: int):
        self.base = int(mix(np.array([seed + 11], np.uint64))[0]) | 1
        self.inverse = pow(self.base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            for name, base in (("up", self.base), ("down", self.inverse)):
                a = np.full(n, base, np.uint64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))
        return self.up, self.down


_powers: dict[int, _Powers] = {}


def range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each ``values[start:end]``; equal content gives equal hashes wherever it stands."""
    up, down = _powers.setdefault(seed, _Powers(seed)).upto(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _M)


@dataclass
class Words:
    """The words of a batch, in order. ``first[d]:first[d + 1]`` are those of text d; null texts have none."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self, seed: int = 0) -> np.ndarray:
        out, codes, a = np.empty(len(self.start), np.uint64), _byte_codes(seed), 0
        while a < len(out):  # by stretches of words, so that a very long text needs no more memory than a short one
            b = max(a + 1, int(np.searchsorted(self.end, self.start[a] + PIECE)))
            at = self.start[a]
            out[a:b] = range_hash(codes[self.data[at : self.end[b - 1]]], self.start[a:b] - at, self.end[a:b] - at, seed)
            a = b
        return out

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def words(column: pa.Array, kind: np.ndarray = SPACED, lower: bool = False) -> Words:
    """Split a string column at bytes outside ``kind``; ``lower`` first lower-cases A-Z."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pa.array(column, pa.string()) if column.type != pa.string() else column
    n = len(column)
    if column.null_count:
        column = column.fill_null("")
    if not n:
        return Words(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64))
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    inside = kind[data]
    begins, ends = inside.copy(), inside.copy()
    if len(data):
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        at = offsets[:-1][offsets[:-1] < len(data)]
        begins[at] = inside[at]
        last = offsets[1:][offsets[1:] > 0] - 1
        ends[last] = inside[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(data, start, end, np.searchsorted(start, offsets))


def window_starts(w: Words, size: int) -> np.ndarray:
    """Indices of words at which a window of ``size`` words of one text begins."""
    n = np.diff(w.first)
    return np.flatnonzero(np.arange(len(w.start)) + size <= np.repeat(w.first[1:], n))
