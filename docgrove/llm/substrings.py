"""Suffix-array removal of repeated byte strings across documents.

A byte goes if a 50-byte string over it also starts in a document with a smaller id.

Suffixes of the whole corpus cannot be sorted in one place, so strings that may
repeat are first brought together.  Every 50-byte string holds an anchor: the
26-byte string of least hash in it.  Anchors are picked alike wherever a string
stands; those found in two or more documents are shared.  Around each shared anchor
its context (the bytes of all 50-byte strings over it, 74 at most) goes to the
anchor's bucket.  There the distinct contexts are suffix-sorted in two stages, and
adjacent common prefixes of 50 bytes give the classes of equal strings, with the
least document of each.

No anchor or string gathers in one task, however frequent it is.  A map task sends of
each anchor its least and its greatest document; the ones between are known to share
it.  Of equal contexts it sends those of the least document; the others are repeats
already.  Around an anchor of more than FREQUENT documents the context is parted
before it is sent: each of its 50-byte strings is a context of its own, in a bucket by
its own hash, and is sorted there like any other.

Equal texts are settled first: of them only the least document takes part.

Inputs and edge cases
* null text is empty; texts under 50 bytes lose nothing.
* null doc_id takes no part and loses nothing.
* repeated rows with one doc_id and text are one document, returned once per row.  Of
  rows that share an id but not the text, only the text of least MD5 takes part; the
  others are returned whole.
* an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .packing import REMAINDER_BITS, deal, delta, places, runs, together, unblob, undelta
from .shared import durable, hash_filter, id_filter, in_filter, scratch, suspect, without
from .suffixes import neighbours_agree, suffix_order

LENGTH = 50
ANCHOR = 26
REACH = LENGTH - ANCHOR
#: Documents of an anchor from which its contexts are parted into strings.
FREQUENT = 1 << 13
FLUSH = 1 << 18
#: Entries in a row of documents or spans that need not meet others.
DIRECT = 1 << 14
#: Bytes of contexts that are suffix-sorted at once; an anchor's contexts are never parted.
SORT_BYTES = 1 << 18

_U64 = np.uint64
SEPARATOR = 0xFF  # in no UTF-8 text


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over every `width` neighbours, by doubling."""
    have = 1
    while 2 * have <= width:
        x = pick(x[:-have], x[have:])
        have *= 2
    if have < width:
        x = pick(x[: len(x) - (width - have)], x[width - have :])
    return x


def prefix_hashes(s: tk.Slice) -> np.ndarray:
    """Running sums from which the hash of any byte range of the slice follows."""
    n = len(s.data)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(tk.BYTE_CODES[s.data] * tk.powers(n + 1)[0][:n], out=prefix[1:])
    return prefix


def range_hashes(prefix: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return tk.mix64((prefix[high] - prefix[low]) * tk.powers(len(prefix))[1][low] + (high - low).astype(np.uint64))


def anchors(s: tk.Slice, prefix: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the anchors in a slice, by position."""
    n = len(s.data)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    prefix = prefix_hashes(s) if prefix is None else prefix
    h = tk.mix64((prefix[ANCHOR:] - prefix[:-ANCHOR]) * tk.powers(n + 1)[1][: n - ANCHOR + 1])
    least = _sliding(h, REACH + 1, np.minimum)
    lengths = np.diff(s.offsets)
    left = np.repeat(s.offsets[1:], lengths) - np.arange(n)
    least[left[: len(least)] < LENGTH] = 0  # windows that would leave their row pick nothing
    edge = np.zeros(REACH, np.uint64)
    best = _sliding(np.concatenate([edge, least, edge]), REACH + 1, np.maximum)
    at = np.flatnonzero((best == h) & (best > 0))
    return at, h[at]


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))


def _short(sigs: np.ndarray, buckets: int) -> np.ndarray:
    """What the bucket and the remaining bits keep of a hash."""
    return (sigs >> _U64(REMAINDER_BITS)) % _U64(buckets) << _U64(REMAINDER_BITS) | sigs & _U64((1 << REMAINDER_BITS) - 1)


ANCHORS = "bucket int, sigs binary, docs binary, more binary"


def anchor_blobs(docs: DataFrame, buckets: int, n_places: int) -> DataFrame:
    """ANCHORS: each document's distinct anchors, packed by bucket; equal texts once per task.

    Of an anchor only its least and its greatest document in the task's hands go to the
    bucket; `more` counts those between, or is empty.  These go to rows of bucket
    -1 - place: they share the anchor.
    """

    def pack(sig: list[np.ndarray], doc: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        s, d = np.concatenate(sig), np.concatenate(doc)
        order = np.lexsort((d, s))
        s, d = s[order], d[order]
        edge = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        last = np.append(edge[1:], len(s)) - 1
        between = np.ones(len(s), bool)
        between[edge] = between[last] = False
        more = np.zeros(len(s), np.uint32)
        more[edge] = np.maximum(last - edge - 1, 0)
        use = between & np.repeat(d[edge] != d[last], last - edge + 1)
        keys, cols = [], ([], [], [])
        for place, i, x in deal(d[use] % n_places, d[use], s[use]):
            keys.append(-1 - place)
            for c, v in zip(cols, (x.tobytes(), delta(i), b"")):
                c.append(v)
        s, d, more = s[~between], d[~between], more[~between]
        bucket = (s >> _U64(REMAINDER_BITS)).astype(np.int64)
        at = np.searchsorted(bucket, np.arange(buckets + 1))
        low = s.view(np.uint8).reshape(-1, 8)[:, : REMAINDER_BITS // 8]
        for k in np.flatnonzero(np.diff(at)).tolist():
            a, b = at[k], at[k + 1]
            keys.append(k)
            for c, v in zip(cols, (low[a:b].tobytes(), delta(d[a:b]), more[a:b].tobytes() if more[a:b].any() else b"")):
                c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), *[pa.array(c, pa.binary()) for c in cols]], names=["bucket", "sigs", "docs", "more"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        sig: list[np.ndarray] = []
        doc: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for s in tk.slices(batch.column(1)):
                ids = batch.column(0).slice(s.first, s.rows()).to_pylist()
                at, h = anchors(s)
                cut = np.searchsorted(at, s.offsets)
                for r, i in enumerate(ids):
                    a, b = cut[r], cut[r + 1]
                    if i is None or a == b:
                        continue
                    key = hashlib.md5(s.data[s.offsets[r] : s.offsets[r + 1]]).digest()
                    if key in seen:
                        continue
                    seen.add(key)
                    u = np.unique(_short(h[a:b], buckets))
                    sig.append(u)
                    doc.append(np.full(len(u), i, np.int64))
                    held += len(u)
                if held >= FLUSH:
                    yield from pack(sig, doc)
                    sig, doc, held = [], [], 0
        if held:
            yield from pack(sig, doc)

    return _texts(docs).mapInArrow(rows, ANCHORS)


def shared_anchors(blobs: DataFrame, parts: int, n_places: int) -> DataFrame:
    """(doc_id, sigs): each document's anchors that also stand in another one, packed.

    Rows without an id hold the anchors of more than FREQUENT documents.
    """

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place, id, anchor); place -1 holds frequent anchors."""
        for bucket, held in runs(batches):
            if bucket < 0:
                for s, d, _ in held:
                    yield np.full(len(s) // 8, -1 - bucket), undelta(d), np.frombuffer(s, np.uint64)
                continue
            sigs = np.concatenate([unblob(s, bucket) for s, _, _ in held])
            ids = np.concatenate([undelta(d) for _, d, _ in held])
            more = np.concatenate([np.frombuffer(m, np.uint32) if m else np.zeros(len(d) // 8, np.uint32) for _, d, m in held])
            order = np.argsort(sigs, kind="stable")
            sigs, ids, more = sigs[order], ids[order], more[order]
            begin = np.flatnonzero(np.concatenate([[True], sigs[1:] != sigs[:-1]]))
            size = np.diff(np.append(begin, len(sigs)))
            often = sigs[begin[size + np.add.reduceat(more.astype(np.int64), begin) > FREQUENT]]
            yield np.full(len(often), -1), np.zeros(len(often), np.int64), often
            keep = np.repeat(np.minimum.reduceat(ids, begin) != np.maximum.reduceat(ids, begin), size)
            yield ids[keep] % n_places, ids[keep], sigs[keep]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place, ids, sigs in together(shared(batches), FLUSH):
            order = np.argsort(ids, kind="stable")
            keys, cols = [], ([], [])
            for key, i, s in deal(place[order], ids[order], sigs[order]):
                keys.append(key)
                cols[0].append(delta(i))
                cols[1].append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), *[pa.array(c, pa.binary()) for c in cols]], names=["place", "docs", "sigs"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place, got in runs(batches):
            if place < 0:
                found = [(None, np.frombuffer(s, np.uint64)) for _, s in got]
            else:
                ids = np.concatenate([undelta(d) for d, _ in got])
                sigs = np.concatenate([np.frombuffer(s, np.uint64) for _, s in got])
                order = np.argsort(ids, kind="stable")
                found = list(deal(ids[order], sigs[order]))
            for x in range(0, len(found), 4096):
                part = found[x : x + 4096]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in part], pa.int64()), pa.array([s.tobytes() for _, s in part], pa.binary())], names=["doc_id", "sigs"])

    met = blobs.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, "place int, docs binary, sigs binary")
    return met.repartition(parts, "place").sortWithinPartitions("place").mapInArrow(gather, "doc_id bigint, sigs binary")


def frequent_anchors(shared: DataFrame) -> np.ndarray:
    """A bounded filter over the anchors of more than FREQUENT documents.

    An anchor that it holds by chance has its contexts parted too, in every document alike.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.int64))], names=["hash"])

    return hash_filter(shared.filter(F.col("doc_id").isNull()).select("sigs").mapInArrow(rows, "hash bigint").distinct())


CONTEXTS = "bucket int, sigs binary, docs binary, starts binary, sizes binary, bytes binary, raw_size bigint"


def context_blobs(texts: DataFrame, buckets: int, frequent: np.ndarray) -> DataFrame:
    """CONTEXTS of shared anchors, packed by bucket; texts has doc_id, text and its packed sigs.

    Of equal contexts in the task's hands those of the least document are sent; where
    the others stand goes to rows of negative buckets, which need not meet any.
    """

    def pack(held: list[tuple], turn: int) -> Iterator[pa.RecordBatch]:
        sig, key, doc, start, size = (np.concatenate([x[j] for x in held]) for j in range(5))
        data = np.concatenate([x[5] for x in held])
        begin = np.cumsum(size) - size
        order = np.lexsort((doc, size, key, sig))
        same = np.zeros(len(order), bool)
        same[1:] = (sig[order[1:]] == sig[order[:-1]]) & (key[order[1:]] == key[order[:-1]]) & (size[order[1:]] == size[order[:-1]])
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        first = order[head]
        # a repeat of a smaller document's context, byte for byte
        later = np.flatnonzero(doc[order] != doc[first])
        stay = np.ones(len(sig), bool)
        for x in range(0, len(later), DIRECT):
            mine, theirs = order[later[x : x + DIRECT]], first[later[x : x + DIRECT]]
            n = size[mine]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            alike = data[step + np.repeat(begin[mine], n)] == data[step + np.repeat(begin[theirs], n)]
            stay[mine[np.logical_and.reduceat(alike, np.cumsum(n) - n)]] = False
        cols: list[list] = [[] for _ in range(7)]
        d, a, b = united_runs(doc[~stay], start[~stay], (start + size)[~stay])
        for x in range(0, len(d), DIRECT):
            at = slice(x, x + DIRECT)
            for c, v in zip(cols, (-1 - (turn + x // DIRECT) % buckets, b"", delta(d[at]), a[at].tobytes(), (b - a)[at].tobytes(), b"", 0)):
                c.append(v)
        bucket = (sig >> _U64(REMAINDER_BITS)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        order = order[stay[order]]
        at = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for k in np.flatnonzero(np.diff(at)).tolist():
            use = order[at[k] : at[k + 1]]
            n = size[use]
            pick = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[use], n)
            raw = data[pick].tobytes()
            packed = (sig[use].tobytes(), delta(doc[use]), start[use].astype(np.int64).tobytes(), n.astype(np.uint8).tobytes(), pa.compress(raw, "zstd", asbytes=True), len(raw))
            for c, v in zip(cols, (k, *packed)):
                c.append(v)
        kinds = [pa.int32(), *[pa.binary()] * 5, pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["bucket", "sigs", "docs", "starts", "sizes", "bytes", "raw_size"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n_held, turn = 0, TaskContext.get().partitionId()
        for doc, s, prefix, row, at, sig in _shared_places(batches, buckets):
            first, last = s.offsets[row], s.offsets[row + 1]
            often = in_filter(frequent, sig.view(np.int64))
            low = np.maximum(at[~often] - REACH, first)
            high = np.minimum(at[~often] + LENGTH, last)
            sig = sig[~often]
            if often.any():
                starts = np.unique((at[often][:, None] - np.arange(REACH + 1)).ravel())
                starts = starts[(starts >= first) & (starts + LENGTH <= last)]
                low, high = np.concatenate([low, starts]), np.concatenate([high, starts + LENGTH])
                sig = np.concatenate([sig, _short(tk.mix64(range_hashes(prefix, starts, starts + LENGTH)), buckets)])
            size = high - low
            pick = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
            held.append((sig, range_hashes(prefix, low, high), np.full(len(sig), doc, np.int64), low - first, size, s.data[pick]))
            n_held += len(sig)
            if n_held >= FLUSH // 2:
                yield from pack(held, turn)
                held, n_held, turn = [], 0, turn + 1
        if n_held:
            yield from pack(held, turn)

    return texts.select("doc_id", "text", "sigs").mapInArrow(rows, CONTEXTS)


def _shared_places(batches: Iterator[pa.RecordBatch], buckets: int):
    """Per document with shared anchors: id, slice, its prefix hashes, row, positions and short hashes."""
    for batch in batches:
        for s in tk.slices(batch.column(1)):
            ids = batch.column(0).slice(s.first, s.rows()).to_pylist()
            marks = batch.column(2).slice(s.first, s.rows())
            prefix = prefix_hashes(s)
            at, h = anchors(s, prefix)
            h = _short(h, buckets)
            cut = np.searchsorted(at, s.offsets)
            for r, i in enumerate(ids):
                known = np.sort(np.frombuffer(marks[r].as_buffer(), np.uint64))
                a, b = cut[r], cut[r + 1]
                if not len(known) or a == b:
                    continue
                j = np.minimum(np.searchsorted(known, h[a:b]), len(known) - 1)
                hit = known[j] == h[a:b]
                if hit.any():
                    yield i, s, prefix, r, at[a:b][hit], h[a:b][hit]


def repeated_spans(contexts: DataFrame, parts: int) -> DataFrame:
    """(doc_id, from, to): byte ranges covered by strings that also start in a smaller document.

    Partitions are sorted by bucket and worked off bucket by bucket; of a bucket, whole
    anchors of about SORT_BYTES are suffix-sorted at once.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, got in runs(batches):
            doc = np.concatenate([undelta(x[1]) for x in got])
            start = np.concatenate([np.frombuffer(x[2], np.int64) for x in got])
            size = np.concatenate([np.frombuffer(x[3], np.int64 if bucket < 0 else np.uint8) for x in got]).astype(np.int64)
            if bucket < 0:
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(start), pa.array(start + size)], names=["doc_id", "from", "to"])
                continue
            sig = np.concatenate([np.frombuffer(x[0], np.uint64) for x in got])
            data = np.concatenate([np.frombuffer(pa.decompress(x[4], x[5], "zstd", asbytes=True), np.uint8) for x in got])
            begin = np.cumsum(size) - size
            order = np.argsort(sig, kind="stable")
            total = np.cumsum(size[order])
            a = 0
            while a < len(order):
                b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + SORT_BYTES, "right")))
                while b < len(order) and sig[order[b]] == sig[order[b - 1]]:
                    b += 1
                yield _spans_of(sig, doc, start, size, begin, data, order[a:b])
                a = b

    return contexts.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(rows, "doc_id bigint, from bigint, to bigint")


def _spans_of(sig, doc, start, size, begin, data, use) -> pa.RecordBatch:
    """Spans of the contexts `use`, which hold all contexts of their anchors."""
    n = size[use]
    width = LENGTH + REACH
    grid = np.full((len(use), width + 1), SEPARATOR, np.uint8)
    at = np.repeat(np.arange(len(use)), n) * (width + 1) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    grid.ravel()[at] = data[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[use], n)]
    # equal contexts of an anchor become one, under their least document
    whole = np.concatenate([sig[use].view(np.uint8).reshape(-1, 8), grid], axis=1)
    order = np.lexsort((doc[use], _key(whole), sig[use]))
    sorted_rows = whole[order]
    new = np.ones(len(order), bool)
    new[1:] = (sorted_rows[1:] != sorted_rows[:-1]).any(axis=1)
    kind = np.cumsum(new) - 1
    one = order[new]
    least = doc[use][one]
    m = n[one]
    # the strings of an anchor with one context stand in no other place
    alone = np.ones(len(one), bool)
    alone[1:] = sig[use][one[1:]] != sig[use][one[:-1]]
    alone[:-1] &= alone[1:]
    several = np.flatnonzero(~alone)
    text = grid[one[several]].ravel()
    sa = suffix_order(text, LENGTH + 6)
    owner = several[sa // (width + 1)]
    offset = sa % (width + 1)
    full = offset + LENGTH <= m[owner]
    sa, owner, offset = sa[full], owner[full], offset[full]
    agree = neighbours_agree(text, sa, LENGTH)
    cls = np.cumsum(~agree) - 1
    firsts = np.flatnonzero(~agree)
    smallest = np.minimum.reduceat(least[owner], firsts) if len(sa) else least[:0]
    flagged = smallest[cls] < least[owner] if len(sa) else np.zeros(0, bool)
    # the least document of a context loses what an even smaller one has; all others lose the context
    o, f = owner[flagged], offset[flagged]
    by = np.lexsort((f, o))
    o, f = o[by], f[by]
    fresh = np.ones(len(o), bool)
    fresh[1:] = (o[1:] != o[:-1]) | (f[1:] > f[:-1] + LENGTH)
    lo = np.flatnonzero(fresh)
    hi = np.append(lo[1:], len(o))[: len(lo)] - 1
    spans_o, spans_a, spans_b = o[lo], f[lo], f[hi] + LENGTH
    is_least = doc[use][order] == least[kind]
    holders = np.flatnonzero(is_least)
    first_holder = np.searchsorted(kind[holders], np.arange(len(one)))
    held = np.bincount(kind[holders], minlength=len(one))
    reps = held[spans_o]
    rows = holders[np.repeat(first_holder[spans_o], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)] if len(spans_o) else np.zeros(0, np.int64)
    place = use[order[rows]]
    out_doc, out_a, out_b = doc[place], start[place] + np.repeat(spans_a, reps), start[place] + np.repeat(spans_b, reps)
    rest = use[order[~is_least & (m[kind] >= LENGTH)]]
    found = united_runs(np.concatenate([out_doc, doc[rest]]), np.concatenate([out_a, start[rest]]), np.concatenate([out_b, start[rest] + size[rest]]))
    return pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["doc_id", "from", "to"])


def united_runs(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges a..b by document, overlapping and touching ones made one."""
    order = np.lexsort((a, doc))
    doc, a, b = doc[order], a[order], b[order]
    new = np.ones(len(doc), bool)
    new[1:] = doc[1:] != doc[:-1]
    lift = (np.cumsum(new) - 1) * (int(b.max(initial=0)) + 1)  # ends of one document stay below those of the next
    reach = np.maximum.accumulate(b + lift)
    new[1:] |= (a + lift)[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc))[: len(first)] - 1
    return doc[first], a[first], (reach - lift)[last]


def _key(rows: np.ndarray) -> np.ndarray:
    """A 64-bit hash per row of bytes; rows are compared in full afterwards."""
    pad = -rows.shape[1] % 8
    words = np.ascontiguousarray(np.pad(rows, ((0, 0), (0, pad)))).view(np.uint64)
    h = np.zeros(len(rows), np.uint64)
    for j in range(words.shape[1]):
        h = tk.mix64(h * _U64(0x9E3779B97F4A7C15) + words[:, j])
    return h


def united(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((x["from"], x["to"]) for x in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


REMOVED = "doc_id bigint, n_bytes bigint, spans array<struct<from:bigint,to:bigint>>, kept binary"


def _changes(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, spans): what goes of the text with that digest; to = -1 is its end."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets, n_places = 3 * parts, places(parts)
    texts = _texts(docs)
    known = durable(texts.select("doc_id", F.md5(F.encode("text", "utf-8")).alias("digest")), "digests")
    named = known.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("digest").alias("digest"))
    origin = named.groupBy("digest").agg(F.min("doc_id").alias("origin"))
    placed = durable(named.join(origin, "digest").select("doc_id", "digest", "origin"), "origins")
    copies = durable(placed.filter("doc_id <> origin").select("doc_id"), "copies")

    shared = durable(shared_anchors(anchor_blobs(without(docs.select("doc_id", "text"), copies), buckets, n_places), parts, n_places), "shared-anchors")
    chosen = shared.join(placed.filter("doc_id = origin").select("doc_id", "digest"), "doc_id")
    texts_of = _caught(texts, shared.filter(F.col("doc_id").isNotNull()).select("doc_id"))
    texts_of = texts_of.withColumn("digest", F.md5(F.encode("text", "utf-8"))).join(chosen, ["doc_id", "digest"]).select("doc_id", "text", "sigs")
    spans = durable(repeated_spans(context_blobs(texts_of, buckets, frequent_anchors(shared)), parts), "spans")

    per_doc = spans.groupBy("doc_id").agg(F.collect_set(F.struct("from", "to")).alias("spans")).join(placed.select("doc_id", "digest"), "doc_id")
    copied = placed.filter("doc_id <> origin").select("doc_id", F.array(F.struct(F.lit(0).cast("long").alias("from"), F.lit(-1).cast("long").alias("to"))).alias("spans"), "digest")
    return per_doc.select("doc_id", "spans", "digest").unionByName(copied)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """REMOVED for every row: the maximal removed byte runs and the bytes that stay."""
    texts = _texts(docs)
    with scratch(docs.sparkSession) as keep:
        changes = keep(_changes(docs), "changes")
    changed_ids = changes.select("doc_id").distinct()
    bitmap = id_filter(changed_ids)
    flagged = texts.withColumn("flag", suspect(bitmap)(F.xxhash64(F.coalesce("doc_id", F.lit(0).cast("long")))))
    whole = flagged.filter(~F.col("flag")).select("doc_id", "text", F.lit(None).cast("array<struct<from:bigint,to:bigint>>").alias("spans"))
    part = flagged.filter("flag").withColumn("digest", F.md5(F.encode("text", "utf-8"))).join(changes, ["doc_id", "digest"], "left").select("doc_id", "text", "spans")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
        for batch in batches:
            for x in range(0, batch.num_rows, 256):
                cut = batch.slice(x, 256)
                n, spans_, kept = [], [], []
                for t, found in zip(cut.column(1), cut.column(2).to_pylist()):
                    raw = t.as_py().encode()
                    n.append(len(raw))
                    runs = united([{"from": y["from"], "to": len(raw) if y["to"] < 0 else y["to"]} for y in found or [] if y["to"] >= 0 or len(raw) >= LENGTH])
                    spans_.append([{"from": a, "to": b} for a, b in runs])
                    at, pieces = 0, []
                    for a, b in runs:
                        pieces.append(raw[at:a])
                        at = b
                    kept.append(b"".join([*pieces, raw[at:]]))
                yield pa.RecordBatch.from_arrays([cut.column(0), pa.array(n, pa.int64()), pa.array(spans_, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    untouched = whole.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.array().cast("array<struct<from:bigint,to:bigint>>").alias("spans"), F.encode("text", "utf-8").alias("kept"))
    return untouched.unionByName(part.mapInArrow(rows, REMOVED))


def _caught(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """texts whose id is among ids, and a few others: a bounded filter before a join."""
    return texts.filter(F.col("doc_id").isNotNull()).filter(suspect(id_filter(ids))(F.xxhash64("doc_id")))


def op9_query(docs: DataFrame) -> DataFrame:
    found = remove_repeats(docs)
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["to"] - x["from"])
    return found.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Byte windows as pairs of hexadecimal digits.
ORACLE = r"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) h from documents),
w as (select doc_id, p, substr(h, 2 * p + 1, 100) s from (select doc_id, h, unnest(range(0, greatest(length(h) // 2 - 49, 0))) p from d)),
f as (select s, min(doc_id) least from w group by s having min(doc_id) < max(doc_id)),
hit as (select w.doc_id, w.p from w join f using (s) where least < w.doc_id),
covered as (select distinct doc_id, unnest(range(p, p + 50)) b from hit),
steps as (select doc_id, b, b - lag(b) over (partition by doc_id order by b) step from covered),
gone as (select doc_id, count(*)::bigint n_removed, count(*) filter (where step is distinct from 1)::bigint n_spans from steps group by doc_id),
bytes as (select doc_id, h, unnest(range(0, length(h) // 2)) b from d join gone using (doc_id)),
kept as (
  select doc_id, string_agg(substr(h, 2 * b + 1, 2), '' order by b) filter (where c.b is null) h
  from bytes left join covered c using (doc_id, b) group by doc_id)
select d.doc_id, (length(d.h) // 2)::bigint n_bytes, coalesce(n_removed, 0)::bigint n_removed, coalesce(n_spans, 0)::bigint n_spans,
  sha256(unhex(case when n_removed is null then d.h else coalesce(kept.h, '') end)) kept_sha256
from d left join gone using (doc_id) left join kept using (doc_id)
"""
