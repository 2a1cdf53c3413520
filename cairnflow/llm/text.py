"""Vectorised text kernels on the buffers of Arrow string columns.

A *slice* is a run of whole rows of at most ``SLICE_BYTES`` bytes (one row, if it alone is longer):
``data`` holds their UTF-8 bytes back to back and ``bounds`` the byte offset of each row plus the end.
Memory of a task is a small multiple of a slice, whatever the size of an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
U64 = np.uint64
# Odd multiplier of the polynomial hash modulo 2^64, and its inverse.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)

# Whitespace of the word rule [^\x20\x09-\x0D]+
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
WORD_BYTE = ~SPACE
# Bytes of the normalised word rule: a-z (after lower-casing), 0-9 and everything beyond ASCII.
NORMAL_BYTE = np.zeros(256, bool)
NORMAL_BYTE[list(range(0x30, 0x3A)) + list(range(0x61, 0x7B)) + list(range(0x80, 0x100))] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


class Cache(dict):
    """A dictionary that pickles as an empty one: kernels travel by value, and what they can rebuild stays behind."""

    def __reduce__(self):
        return Cache, ()


_powers = Cache()


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept and grown on demand."""
    table = _powers.get(base)
    if table is None or len(table) < n:
        steps = np.full(max(n, SLICE_BYTES + 1024), base, U64)
        steps[0] = 1
        table = _powers[base] = np.cumprod(steps, dtype=U64)
    return table[:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    x = x ^ U64(seed * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE_CODES = mix(np.arange(1, 257, dtype=U64))


class RangeHash:
    """Hashes of arbitrary ranges of a token array in constant time per range."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(codes * powers(BASE, n), dtype=U64, out=self.sums[1:])

    def ranges(self, begin: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
        scale = powers(BASE_INVERSE, len(self.sums))[begin]
        return mix((self.sums[end] - self.sums[begin]) * scale + (end - begin).astype(U64), seed)

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k tokens from every position on (empty when there are fewer than k)."""
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, U64)
        return mix((self.sums[k:] - self.sums[:n]) * powers(BASE_INVERSE, n))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    raw = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(raw[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    bounds = bounds.astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, data, bounds) of consecutive slices."""
    data, bounds = buffers(column)
    row, rows = 0, len(bounds) - 1
    while row < rows:
        stop = max(row + 1, int(np.searchsorted(bounds, bounds[row] + limit, "right")) - 1)
        yield row, stop, data[bounds[row] : bounds[stop]], bounds[row : stop + 1] - bounds[row]
        row = stop


class Words:
    """Words of a slice: byte range of each, and the first word of each row (plus the end)."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, classes: np.ndarray = WORD_BYTE):
        inside = classes[data]
        n = len(data)
        fresh = np.zeros(n + 1, bool)
        fresh[bounds] = True
        first = inside.copy()
        first[1:] &= ~inside[:-1] | fresh[1:n]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | fresh[1:n]
        self.begin = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.rows = np.searchsorted(self.begin, bounds)
        self.counts = np.diff(self.rows)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, data: np.ndarray, seed: int = 0) -> np.ndarray:
        return RangeHash(BYTE_CODES[data]).ranges(self.begin, self.end, seed)


class WordTable:
    """Numbers of known words by hash, in the order of the sorted hashes; most unknown ones fail on their low bits."""

    BITS = 16

    def __init__(self, codes: np.ndarray):
        self.codes = np.sort(codes)
        self.flags = np.zeros(1 << self.BITS, bool)
        self.flags[self.codes & U64((1 << self.BITS) - 1)] = True

    def numbers(self, codes: np.ndarray) -> np.ndarray:
        """-1 for unknown words."""
        found = np.full(len(codes), -1, np.int64)
        if len(self.codes):
            likely = np.flatnonzero(self.flags[codes & U64((1 << self.BITS) - 1)])
            at = np.minimum(np.searchsorted(self.codes, codes[likely]), len(self.codes) - 1)
            exact = self.codes[at] == codes[likely]
            found[likely[exact]] = at[exact]
        return found


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of ``width`` consecutive values from every position on."""
    if len(values) < width:
        return values[:0]
    reach, low = 1, values
    while reach * 2 <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def row_sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` between consecutive bounds; empty ranges give 0."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def signed(values: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as the longs Spark knows."""
    return values.view(np.int64)
