"""Vector and score functions as Columns, and the offline embedder."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; null for a zero vector or unlike sizes."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((norms > 0) & (F.size(a) == F.size(b)), dot(a, b) / norms)


def round_score(c: Column) -> Column:
    """Two decimals, halves towards plus infinity."""
    return F.floor(c * 100 + 0.5) / 100


def assert_dimension(v: Column | str, dimension: int) -> Column:
    """The vector itself; an error if it is empty or of another size."""
    size = F.size(v)
    return F.when(size == dimension, F.col(v) if isinstance(v, str) else v).otherwise(F.raise_error(F.concat(F.lit("embedding size "), size.cast("string"), F.lit(f", expected {dimension}"))))


_WORD = np.zeros(256, bool)
for _low, _high in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    _WORD[_low:_high] = True
_WORD[0x5F] = True
_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[0x41:0x5B] += np.uint64(32)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_WEIGHTS = np.multiply.accumulate(np.full(64, _ODD, np.uint64))


class HashingEmbedder:
    """Deterministic feature hashing of words into a unit vector; needs no network.

    It stands where a hosted model would, behind the same two methods; its neighbours
    are texts with common words.  Words are runs of ASCII letters (in either case),
    digits, underscores and all other characters outside ASCII.
    """

    #: Bytes of text that are hashed at once, in some eighty times as much memory.
    SLICE = 1 << 18

    def __init__(self, dimension: int = 256):
        self.dimension = dimension

    def embed(self, text: str, mode: str = "document") -> list[float]:
        """The vector of one text; documents and queries are treated alike."""
        return self.embed_batch(pa.array([text or ""]), mode)[0].tolist()

    def embed_batch(self, texts: pa.Array, mode: str = "document") -> np.ndarray:
        """A unit row per text; texts without words share one direction."""
        column = texts.cast(pa.large_string()).fill_null("")
        n = len(column)
        if not n:
            return np.zeros((0, self.dimension))
        _, off, dat = column.buffers()
        offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
        data = np.frombuffer(dat, np.uint8) if dat is not None else np.zeros(0, np.uint8)
        out, i = np.zeros((n, self.dimension)), 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + self.SLICE, "right")) - 1)
            self._add(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], out[i:j])
            i = j
        norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.where(norm > 0, out / np.where(norm > 0, norm, 1), 1 / np.sqrt(self.dimension))

    def _add(self, data: np.ndarray, offsets: np.ndarray, into: np.ndarray) -> None:
        inside = np.flatnonzero(_WORD[data])
        if not len(inside):
            return
        row = np.searchsorted(offsets, inside, "right") - 1
        first = np.ones(len(inside), bool)
        first[1:] = (np.diff(inside) > 1) | (np.diff(row) > 0)
        start = np.flatnonzero(first)
        place = np.arange(len(inside)) - np.repeat(start, np.diff(np.append(start, len(inside))))
        h = np.add.reduceat((_FOLD[data[inside]] + np.uint64(1)) * _ODD * _WEIGHTS[place % 64], start)
        h = (h ^ (h >> np.uint64(29))) * _ODD
        h ^= h >> np.uint64(32)
        at = row[start] * self.dimension + (h % np.uint64(self.dimension)).astype(np.int64)
        sign = np.where(h >> np.uint64(63) == 1, 1.0, -1.0)
        into += np.bincount(at, weights=sign, minlength=into.size).reshape(into.shape)


def reorder_by_index(items: list[dict], expected: int) -> list[list[float]]:
    """Vectors in input order: by index where every item has one, else as they came."""
    if len(items) != expected:
        raise ValueError(f"{len(items)} embeddings for {expected} texts")
    if any(not x.get("embedding") for x in items):
        raise ValueError("an embedding is empty")
    if not all("index" in x and x["index"] is not None for x in items):
        return [x["embedding"] for x in items]
    placed: dict[int, list[float]] = {}
    for x in items:
        if not 0 <= x["index"] < expected or x["index"] in placed:
            raise ValueError(f"embedding index {x['index']} is out of range or repeated")
        placed[x["index"]] = x["embedding"]
    return [placed[i] for i in range(expected)]
