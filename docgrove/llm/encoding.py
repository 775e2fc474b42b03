"""Byte-level BPE encoding of Arrow slices; the vocabulary is a given file.

A run of white space always starts a new word of the split pattern, so the pieces
between the starts of such runs are encoded independently of each other: each
distinct piece once, and the ids of its other places are gathered.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken

from . import textkernel as tk

#: Folder of the public tokenizer files.
TOKENIZERS = os.environ.get("DOCGROVE_TOKENIZERS", "/opt/tokenizers")
RANKS = "byte_bpe_50k.tiktoken"
# Fixed value: the vocabulary's split pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_OF_TEXT = 50256
#: Slots of a worker's table of pieces, and the ids that it holds at most.
SLOTS = 1 << 18
HELD_IDS = 1 << 21
#: Longer pieces, in bytes, are not kept.
LONG_PIECE = 64
#: Last bytes of white space outside ASCII (fixed values of UTF-8); no piece ends after one.
WIDE_WHITE_ENDS = [0x80, *range(0x81, 0x8B), 0x85, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]

_MAY_END = np.ones(256, bool)
_MAY_END[WIDE_WHITE_ENDS] = False
_MAY_END[~tk.SOLID] = False


def read_ranks(folder: str = TOKENIZERS, name: str = RANKS) -> dict[bytes, int]:
    with open(f"{folder}/{name}", "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder:
    """Token ids (uint16) of the rows of a slice.

    Known pieces stand in a table with one slot per low hash bits; a new piece takes
    the slot of an older one.  Pieces are told apart by a 64-bit hash; what the table
    holds must also agree in length and in the first eight bytes.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.plain = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 2, np.int64)
        for piece, i in ranks.items():
            self.lengths[i] = len(piece)
        self._clear()

    def _clear(self) -> None:
        self.hash = np.zeros(SLOTS, np.uint64)
        self.head = np.zeros(SLOTS, np.uint64)
        self.size = np.zeros(SLOTS, np.int32)
        self.begin = np.zeros(SLOTS, np.int64)
        self.count = np.zeros(SLOTS, np.int32)
        self.ids = np.zeros(1 << 16, np.uint16)
        self.used = 0

    def _add(self, found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """(begin, count) of lists of ids, appended to those held."""
        count = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((x for ids in found for x in ids), np.uint16, int(count.sum()))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(flat)] = flat
        begin = np.cumsum(count) - count + self.used
        self.used += len(flat)
        return begin, count

    def encode(self, s: tk.Slice) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, first): row r has ids first[r]..first[r + 1]."""
        rows, data, n = s.rows(), s.data, len(s.data)
        if not n:
            return np.zeros(0, np.uint16), np.zeros(rows + 1, np.int64)
        if self.used > HELD_IDS:
            self._clear()
        starts = ~tk.SOLID[data]
        starts[1:] &= _MAY_END[data[:-1]]
        starts[s.offsets[:-1][s.offsets[:-1] < n]] = True
        start = np.flatnonzero(starts)
        end = np.append(start[1:], n)
        size = end - start
        up, down = tk.powers(n + 1)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(tk.BYTE_CODES[data] * up[:n], out=prefix[1:])
        h = tk.mix64((prefix[end] - prefix[start]) * down[start] + size.astype(np.uint64))
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        head = np.lib.stride_tricks.sliding_window_view(padded, 8)[start].view(np.uint64)[:, 0]
        head &= tk.HEAD_MASKS[np.minimum(size, 8)]
        slot = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        hit = (self.hash[slot] == h) & (self.size[slot] == size) & (self.head[slot] == head)
        begin, count = self.begin[slot], self.count[slot].astype(np.int64)
        miss = np.flatnonzero(~hit)
        if len(miss):
            _, first, inverse = np.unique(h[miss], return_index=True, return_inverse=True)
            new = miss[first]
            raw = data.tobytes()
            b, c = self._add([self.plain.encode_ordinary(raw[x:y].decode("utf-8", "surrogatepass")) for x, y in zip(start[new].tolist(), end[new].tolist())])
            begin[miss], count[miss] = b[inverse], c[inverse]
            keep = size[new] <= LONG_PIECE
            new, at = new[keep], slot[new[keep]]
            self.hash[at], self.head[at], self.size[at], self.begin[at], self.count[at] = h[new], head[new], size[new], b[keep], c[keep]
        before = np.append(0, np.cumsum(count))
        ids = self.ids[np.arange(before[-1]) + np.repeat(begin - before[:-1], count)]
        return ids, before[np.searchsorted(start, s.offsets)]

    def encode_text(self, text: str) -> np.ndarray:
        """Ids of one text."""
        column = pa.array([text], pa.string())
        return np.concatenate([self.encode(s)[0] for s in tk.slices(column)])


@lru_cache(maxsize=2)
def _worker_encoder(packed: bytes) -> Encoder:
    return Encoder(dict(zip(_split(packed), range(1 << 16))))


def packed_ranks(folder: str = TOKENIZERS, name: str = RANKS) -> bytes:
    """The vocabulary in rank order, to travel with a task: executors open no file."""
    ranks = read_ranks(folder, name)
    pieces = sorted(ranks, key=ranks.get)
    if [ranks[p] for p in pieces] != list(range(len(pieces))) or len(pieces) >= 1 << 16:
        raise ValueError("ranks are not 0..n-1, or need more than 16 bits")
    sizes = np.array([len(p) for p in pieces], np.uint8)
    return len(pieces).to_bytes(4, "little") + sizes.tobytes() + b"".join(pieces)


def _split(packed: bytes) -> list[bytes]:
    n = int.from_bytes(packed[:4], "little")
    ends = np.cumsum(np.frombuffer(packed[4 : 4 + n], np.uint8).astype(np.int64)) + 4 + n
    begin = [4 + n, *ends[:-1].tolist()]
    return [packed[a:b] for a, b in zip(begin, ends.tolist())]


def worker_encoder(packed: bytes) -> Encoder:
    """The encoder of this worker process, built once."""
    return _worker_encoder(packed)
