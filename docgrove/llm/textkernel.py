"""Vectorised UTF-8 kernels shared by the operators.

They work on the Arrow buffers of a batch (one flat byte array and row offsets),
so no Python object is made per word.  Slices of a batch are bounded in bytes: a
slice holds whole rows, and one row longer than the bound is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19

_U64 = np.uint64
_BASE = _U64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = _U64(pow(int(_BASE), -1, 1 << 64))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64 (two xor-multiply rounds)."""
    x = x ^ (x >> _U64(31))
    x = x * _U64(0x7FB5D329728EA185)
    x = x ^ (x >> _U64(27))
    x = x * _U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U64(33))


#: A 64-bit value per byte value, from the finaliser itself.
BYTE_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * _U64(0xD6E8FEB86659FD93))


def _lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


ASCII_LOWER = _lower_table()

#: Bytes of words without white space: anything but 0x20 and 0x09-0x0D.
SOLID = np.ones(256, dtype=bool)
SOLID[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes of alphanumeric words after lower-casing: digits, a-z and all of non-ASCII.
WORDY = np.zeros(256, dtype=bool)
WORDY[0x30:0x3A] = True
WORDY[0x61:0x7B] = True
WORDY[0x80:] = True

#: The first 0..8 bytes of a little-endian word.
HEAD_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        up = np.full(size, _BASE, dtype=np.uint64)
        down = np.full(size, _BASE_INV, dtype=np.uint64)
        up[0] = down[0] = 1
        if size > 4 * SLICE_BYTES:
            return np.multiply.accumulate(up), np.multiply.accumulate(down)
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0], _powers[1]


@dataclass
class Slice:
    """Rows first..last of a batch: their bytes, and where each row begins."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray  # last - first + 1 entries, from 0

    def rows(self) -> int:
        return self.last - self.first


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat bytes and int64 offsets of a string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, dat = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(dat, dtype=np.uint8) if dat is not None else np.zeros(0, np.uint8)
    return data, offsets


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    data, offsets = string_buffers(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield Slice(i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


@dataclass
class Tokens:
    start: np.ndarray  # byte positions in the slice
    end: np.ndarray
    row_first: np.ndarray  # rows + 1 entries: index of each row's first token
    hash: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.row_first)


def tokenize(s: Slice, member: np.ndarray, lower: bool = True, data: np.ndarray | None = None) -> Tokens:
    """Maximal runs of member bytes, which never cross rows, with 64-bit hashes."""
    data = (ASCII_LOWER[s.data] if lower else s.data) if data is None else data
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return Tokens(z, z, np.zeros(len(s.offsets), np.int64), np.zeros(0, np.uint64))
    inside = member[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    borders = s.offsets[:-1]
    before[borders[borders < n]] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = s.offsets[1:]
    after[ends[ends > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    up, down = powers(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_CODES[data] * up[:n], out=prefix[1:])
    h = mix64((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))
    return Tokens(start, end, np.searchsorted(start, s.offsets), h)


def gram_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Order-dependent hashes of `width` neighbouring tokens; shorter input gives none."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, width):
        out *= _BASE
        out += h[j : j + n]
    return mix64(out + _U64(width))


def shingle_sets(t: Tokens, width: int = 5) -> Iterator[np.ndarray]:
    """Per row the sorted distinct shingle hashes; fewer words than width: the whole sequence as one."""
    grams = gram_hashes(t.hash, width)
    for a, b in zip(t.row_first[:-1].tolist(), t.row_first[1:].tolist()):
        if b - a >= width:
            g = np.sort(grams[a : b - width + 1])
            keep = np.empty(len(g), bool)
            keep[0] = True
            np.not_equal(g[1:], g[:-1], out=keep[1:])
            yield g[keep]
        else:
            yield gram_hashes(t.hash[a:b], b - a) if b > a else grams[:0]
