"""Best-two-fit packing of documents into token sequences.

Every whole document is encoded once and closed by an end id; those longer than a
sequence are cut into pieces of its length, the last of which may be shorter.  Pieces
are dealt at random into groups of about GROUP pieces, each of which is packed by one
task: a sequence is filled greedily, always by the longest piece that still fits; then
its smallest piece is replaced by the two unpacked pieces that together fit the gap so
widened most tightly, where two do so more tightly than it.  Only pieces' places and
lengths are shuffled, never ids or texts.

A group's lengths are at most SEQUENCE different ones, so what is unpacked is a count
by length and a set of bits: the longest piece that fits is the highest bit below the
gap, and pairs of a sum are the set and its mirror image, shifted and intersected.

Groups are packed apart: each leaves one sequence at most that is filled by what was
left, one in several thousand.

Inputs and edge cases
* null and empty texts are the end id alone; null doc_id is carried as null.
* repeated rows are packed one by one, and spread over the groups like others.
* an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import textkernel as tk
from .encoding import TOKENIZERS
from .shared import durable

VOCABULARY = "word_bpe_49k.json"
SEQUENCE = 4096
END_ID = 1
#: Pieces that one task packs together, on average.
GROUP = 1 << 15

PIECES = "deal bigint, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PLACED = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"


def read_vocabulary(folder: str = TOKENIZERS, name: str = VOCABULARY) -> str:
    """The tokenizer's file, to travel with a task: executors open no file."""
    with open(f"{folder}/{name}", encoding="utf-8") as f:
        return f.read()


#: Slots of a worker's table of pieces, and the ids that it holds at most.
SLOTS = 1 << 19
HELD_IDS = 1 << 22
#: Longer pieces, in bytes, are not kept.
LONG_PIECE = 64

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
#: Marks that always start a new word of the vocabulary's split pattern behind a letter.
_MARK = np.zeros(256, bool)
_MARK[list(b".,:;!?")] = True


class WordEncoder:
    """Token ids (uint16) of the rows of a slice, by a vocabulary that drops white space and case.

    The pieces between white space, parted before a mark behind a letter, are encoded
    independently of each other: each distinct one once, all new ones of a slice in one
    call, and the ids of its other places are gathered from a table.  Pieces are told apart by a
    64-bit hash; what the table holds must also agree in length and in the first eight bytes.
    """

    def __init__(self, vocabulary: str):
        self.tokenizer = Tokenizer.from_str(vocabulary)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids need more than 16 bits")
        self._clear()

    def _clear(self) -> None:
        self.hash, self.head = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint64)
        self.size, self.begin, self.count = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.uint16), 0

    def _add(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(begin, count) of the ids of words, appended to those held."""
        found = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        flat = np.array(found.ids, np.uint16)
        at = np.array(found.offsets, np.int64).reshape(-1, 2)[:, 0]
        behind = np.cumsum([len(w) + 1 for w in words])
        upto = np.searchsorted(at, behind)
        count = np.diff(upto, prepend=0)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(flat)] = flat
        begin = upto - count + self.used
        self.used += len(flat)
        return begin, count

    def encode(self, s: tk.Slice) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, first): row r has ids first[r]..first[r + 1]."""
        n = len(s.data)
        if self.used > HELD_IDS:
            self._clear()
        # the special tokens, whose case counts, have this in them
        data = s.data if b"<|" in s.data.tobytes() else tk.ASCII_LOWER[s.data]
        solid = tk.SOLID[data]
        starts, ends = solid.copy(), np.ones(n + 1, bool)
        starts[1:] &= ~solid[:-1] | (_MARK[data[1:]] & _LETTER[data[:-1]])
        borders = s.offsets[:-1][s.offsets[:-1] < n]
        starts[borders] = solid[borders]
        start = np.flatnonzero(starts)
        if not len(start):
            return np.zeros(0, np.uint16), np.zeros(s.rows() + 1, np.int64)
        # a piece ends where white space, another piece or another row begins
        ends[:n] = starts | ~solid
        ends[s.offsets] = True
        stop = np.flatnonzero(ends)
        end = stop[np.searchsorted(stop, start, "right")]
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
        begin, count = self.begin[slot], self.count[slot]
        miss = np.flatnonzero(~hit)
        if len(miss):
            _, first, inverse = np.unique(h[miss], return_index=True, return_inverse=True)
            new = miss[first]
            raw = data.tobytes()
            b, c = self._add([raw[x:y].decode("utf-8", "surrogatepass") for x, y in zip(start[new].tolist(), end[new].tolist())])
            begin[miss], count[miss] = b[inverse], c[inverse]
            keep = size[new] <= LONG_PIECE
            new, at = new[keep], slot[new[keep]]
            self.hash[at], self.head[at], self.size[at], self.begin[at], self.count[at] = h[new], head[new], size[new], b[keep], c[keep]
        before = np.append(0, np.cumsum(count))
        ids = self.ids[np.arange(before[-1]) + np.repeat(begin - before[:-1], count)]
        return ids, before[np.searchsorted(start, s.offsets)]


@lru_cache(maxsize=1)
def worker_words(vocabulary: str) -> WordEncoder:
    return WordEncoder(vocabulary)


def pieces(docs: DataFrame, vocabulary: str, sequence: int = SEQUENCE) -> DataFrame:
    """PIECES of every document; `deal` is a number that spreads them evenly, repeated rows too."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, no = worker_words(vocabulary), TaskContext.get().partitionId(), 0
        for batch in batches:
            for s in tk.slices(batch.column(1)):
                ids, first = encoder.encode(s)
                n = np.diff(first) + 1  # with the end id
                parts = -(-n // sequence)
                total = int(parts.sum())
                part = np.arange(total) - np.repeat(np.cumsum(parts) - parts, parts)
                start = part * sequence
                length = np.minimum(np.repeat(n, parts) - start, sequence)
                flat = np.full(int(n.sum()), END_ID, "<u4")
                flat[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n - 1)] = ids
                ends = np.cumsum(length)
                raw = memoryview(flat).cast("B")
                crc = np.fromiter((zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), length.tolist())), np.int64, total)
                doc = batch.column(0).slice(s.first, s.rows()).take(pa.array(np.repeat(np.arange(s.rows()), parts)))
                deal = tk.mix64(np.arange(no, no + total, dtype=np.uint64) + (np.uint64(task) << np.uint64(40))).view(np.int64)
                no += total
                yield pa.RecordBatch.from_arrays([pa.array(deal), doc, pa.array(part, pa.int32()), pa.array(start), pa.array(length), pa.array(crc)], names=["deal", "doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text")).mapInArrow(rows, PIECES)


def _best_pair(bits: int, mirror: int, single: int, least: int, most: int, sequence: int) -> tuple[int, int] | None:
    """Two unpacked lengths with the greatest sum in least..most; single: bits of lengths left once."""
    top, low = bits.bit_length() - 1, (bits & -bits).bit_length() - 1
    for total in range(min(most, 2 * top), max(least, 2 * low) - 1, -1):
        # bit a of the shifted mirror image: there is a piece of length total - a
        shift = sequence - total
        pairs = bits & (mirror >> shift if shift >= 0 else mirror << -shift)
        if total % 2 == 0 and single >> total // 2 & 1:
            pairs &= ~(1 << total // 2)
        if pairs:
            a = pairs.bit_length() - 1
            return a, total - a
    return None


def pack(lengths: np.ndarray, sequence: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of pieces of 1..sequence tokens, by best-two-fit."""
    order = np.argsort(lengths, kind="stable").tolist()
    counts = np.bincount(lengths, minlength=sequence + 1)
    left, taken = counts.tolist(), (np.cumsum(counts) - counts).tolist()
    bits = single = mirror = 0

    def note(n: int) -> None:
        """Brings the sets up to date with left[n]."""
        nonlocal bits, single, mirror
        some, one = left[n] > 0, left[n] == 1
        if bits >> n & 1 != some:
            bits ^= 1 << n
            mirror ^= 1 << sequence - n
        if single >> n & 1 != one:
            single ^= 1 << n

    for n in np.flatnonzero(counts).tolist():
        note(n)
    masks = [(1 << n + 1) - 1 for n in range(sequence + 1)]
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    number = 0
    while bits:
        held, gap = [], sequence
        while fits := bits & masks[gap]:
            n = fits.bit_length() - 1
            several = min(gap // n, left[n])
            held += [n] * several
            left[n] -= several
            gap -= n * several
            note(n)
        if gap and len(held) > 1 and (pair := _best_pair(bits, mirror, single, held[-1] + 1, held[-1] + gap, sequence)):
            left[held[-1]] += 1
            note(held.pop())
            for n in pair:
                left[n] -= 1
                note(n)
            held += pair
        at = 0
        for n in held:
            i = order[taken[n]]
            taken[n] += 1
            bins[i], offsets[i] = number, at
            at += n
        number += 1
    return bins, offsets


def packed(docs: DataFrame, vocabulary: str, sequence: int = SEQUENCE, group: int = GROUP) -> DataFrame:
    """PLACED: every piece with its sequence and its place there."""
    found = durable(pieces(docs, vocabulary, sequence), "pieces")
    groups = max(1, -(-found.count() // group))
    parts = min(groups, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = found.withColumn("at", F.pmod("deal", F.lit(groups)))
    ordered = dealt.repartitionById(parts, F.floor(F.col("at") * parts / groups).cast("int")).sortWithinPartitions("at", "deal").drop("deal")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, held in _groups(batches):
            t = pa.Table.from_batches(held).combine_chunks()
            number, offset = pack(t["length"].to_numpy(), sequence)
            t = t.append_column("sequence_id", pa.array(number + (at << 32))).append_column("offset", pa.array(offset))
            yield from t.to_batches(max_chunksize=1 << 14)

    return ordered.select(*(c for c in ordered.columns if c != "at"), "at").mapInArrow(rows, PLACED)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """(group, its rows without it) of rows sorted by their last column; one group is held at a time."""
    current, held = None, []
    for b in batches:
        at = b.column(b.num_columns - 1).to_numpy()
        b = b.select(range(b.num_columns - 1))
        cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)] if len(at) else []
        for i, j in zip(cuts, cuts[1:]):
            if at[i] != current and held:
                yield current, held
                held = []
            current = int(at[i])
            held.append(b.slice(i, j - i))
    if held:
        yield current, held


def op13_query(docs: DataFrame) -> DataFrame:
    return packed(docs, read_vocabulary())
