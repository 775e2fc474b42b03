"""Packed columns for shuffles: many small entries travel as one binary row per destination."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bits of a 64-bit signature that a blob keeps; the bucket holds the others that matter.
REMAINDER_BITS = 40


def unblob(low: bytes, bucket: int) -> np.ndarray:
    """Signatures from their remainders and their bucket."""
    raw = np.frombuffer(low, np.uint8).reshape(-1, REMAINDER_BITS // 8)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, : REMAINDER_BITS // 8] = raw
    return wide.view(np.uint64)[:, 0] | np.uint64(bucket << REMAINDER_BITS)


def deal(to: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """(destination, its part of each column), columns staying in order within a destination."""
    order = np.argsort(to, kind="stable")
    to, columns = to[order], [c[order] for c in columns]
    first = np.flatnonzero(np.diff(to, prepend=to[0] - 1)) if len(to) else []
    for i, j in zip(first, [*first[1:], len(to)]):
        yield int(to[i]), *(c[i:j] for c in columns)


def delta(ids: np.ndarray) -> bytes:
    return np.diff(ids, prepend=0).tobytes()


def undelta(b: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(b, np.int64))


def places(parts: int) -> int:
    """A prime number of destinations for documents, by id: no stride of ids falls together."""
    n = max(parts, 2)
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of a partition that is sorted by its first column, together by that column; one run is held at a time."""
    current, held = None, []
    for batch in batches:
        for key, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if key != current:
                if held:
                    yield current, held
                current, held = key, []
            held.append(tuple(row))
    if held:
        yield current, held


def together(pieces: Iterator[tuple[np.ndarray, ...]], limit: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Tuples of equally long arrays, concatenated until they hold `limit` entries."""
    held, n = [], 0
    for piece in pieces:
        held.append(piece)
        n += len(piece[0])
        if n >= limit:
            yield tuple(map(np.concatenate, zip(*held)))
            held, n = [], 0
    if n:
        yield tuple(map(np.concatenate, zip(*held)))
