"""N-gram Jaccard join by PartEnum signatures, and the components of its links.

Two documents link when the Jaccard similarity of their sets of five-word shingles
is 0.75 or more.  The feature domain (shingle hashes) is cut into n1 partitions of
n2 parts; a set's projections on all subsets of n2 - k2 parts of a partition are its
signatures.  Sets of one size band use the same cut, and a set also signs for the
band below where it can have partners there, so that any linking pair meets in one.

Why no link is lost.  A set of size s has a partner of at most 4s/3 shingles, so a
linking pair differs in at most h = (s + 4s/3) / 7 shingles, and at most
h / (k2 + 1) partitions differ in more than k2.  Call a partition sound for a set if
none of its signatures is empty there.  Each set signs its partitions in one fixed
order until it has h / (k2 + 1) + 1 + x sound ones.  Of the set that stops first, all
but h / (k2 + 1) of these give a common signature that is not empty: the pair shares
at least 1 + x.  Therefore each set may pass over the x signatures that most sets
share (one order for all sets), and a set that shares no more than 1 + x with all
others together has no link: both take frequent lines and passages out.  Sets
without enough sound partitions sign everything and pass over nothing.

Bands of more than ENUMERATE_UPTO shingles have n2 = 1 and k2 = 0, and sets up to
SINGLES_UPTO take every shingle as a partition: with n1 > h partitions one of them is
equal in both sets, and the enumeration of all subsets of size n2 - k2 = 1 is the
partition itself.  The same scheme, at the end of its range of parameters.

Rows do not travel one by one: each task packs its signatures into blobs by bucket,
one set per task for equal sets.  Signatures that meet name candidates: first each
set against the group's hub, the set that is in most groups (the text that variants
were made from keeps most signatures); then, in families (all groups of one hub) whose
sets are not yet in one component, every pair of different components.  A lower bound on their difference,
from small sketches, rules most candidates out; the others are checked exactly on
whole sets, which only they fetch.

Inputs and edge cases
* null, empty and wordless texts: no shingles, linked with nothing, own component.
* null doc_id takes no part: n_shingles is right, component_id is null.
* repeated rows: one result each; rows with one doc_id are one document.
* an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .components import components
from .packing import REMAINDER_BITS, deal, delta, places, runs, together, unblob, undelta
from .shared import durable, id_filter, in_filter, scratch, without

WIDTH = 5
SINGLES_UPTO = 48
#: Bands up to this size enumerate subsets of two of three parts; beyond, whole partitions select enough.
ENUMERATE_UPTO = 256
SLACK = 12
FLUSH = 1 << 18
HUB_ROWS = 128
#: Sets of a family that are compared with each other in one piece.
BLOCK = 1024

_U64 = np.uint64


def links(inter: int, a: int, b: int) -> bool:
    return 100 * inter >= 75 * (a + b - inter)


def most_differing(s: int) -> int:
    return (s + 4 * s // 3) // 7


def slack(s: int, k2: int) -> int:
    return s // (SLACK * (k2 + 1)) + 1


def allowance(s: int, k2: int) -> int:
    """Signatures that a set of size s may pass over: the slack of its smallest partner at most."""
    return (3 * s // 4) // (SLACK * (k2 + 1))


@dataclass(frozen=True)
class Band:
    number: int
    low: int
    high: int
    n1: int
    n2: int
    k2: int


def bands() -> Iterator[Band]:
    low = SINGLES_UPTO + 1
    for number in itertools.count(1):
        after = low * 16 // 9 + 1
        high = 4 * (after - 1) // 3
        n2, k2 = (3, 1) if high <= ENUMERATE_UPTO else (1, 0)
        stretch = 1.45 if k2 else 1.25
        yield Band(number, low, high, int(stretch * most_differing(high) / (k2 + 1)) + 2, n2, k2)
        low = after


_bands: list[Band] = []
_source = bands()


def bands_of(s: int) -> list[Band]:
    while not _bands or _bands[-1].low <= s:
        _bands.append(next(_source))
    return [b for b in _bands if b.low <= s <= b.high]


def _single_signatures(u: np.ndarray) -> tuple[np.ndarray, bool]:
    """Small sets: every shingle is a partition of its own, in the order of its mixed hash."""
    s = len(u)
    need = most_differing(s) + 1 + slack(s, 0)
    h = np.sort(tk.mix64(u + _U64(0x5851F42D4C957F2D)))
    return h[:need], s < need


def band_signatures(u: np.ndarray, band: Band) -> tuple[np.ndarray, bool]:
    """Signatures of the sorted set u in a band, and whether it passes over none."""
    m = tk.mix64(u ^ _U64(band.number * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    cell = (m >> _U64(20)) % _U64(band.n1)
    if band.n2 > 1:
        cell = cell * _U64(band.n2) + (m & _U64(0xFFFFF)) % _U64(band.n2)
    cell = cell.astype(np.int64)
    cells = band.n1 * band.n2
    sums = np.zeros(cells, np.uint64)
    np.add.at(sums, cell, tk.mix64(u * _U64(0xD1342543DE82EF95)))
    count = np.bincount(cell, minlength=cells).reshape(band.n1, band.n2)
    sums = sums.reshape(band.n1, band.n2)
    subsets = list(itertools.combinations(range(band.n2), band.n2 - band.k2))
    value = np.stack([sums[:, c].sum(axis=1, dtype=np.uint64) for c in subsets], axis=1)
    filled = np.stack([count[:, c].sum(axis=1) for c in subsets], axis=1) > 0
    sound = np.cumsum(filled.all(axis=1))
    s = len(u)
    least = most_differing(s) // (band.k2 + 1) + 1
    need = least + slack(s, band.k2)
    stop, keeps_all = band.n1, True
    if sound[-1] >= need:
        stop, keeps_all = int(np.searchsorted(sound, need)) + 1, False
    place = np.arange(band.n1 * len(subsets), dtype=np.uint64).reshape(value.shape)
    sig = tk.mix64(value + tk.mix64(place + _U64(band.number << 32)))
    chosen = filled.copy() if sound[-1] >= least else np.ones_like(filled)
    chosen[stop:] = False
    return sig[chosen], keeps_all


def signatures(u: np.ndarray) -> list[tuple[int, np.ndarray, bool]]:
    """(band parity, signatures, passes over none) in each band that the set signs for."""
    out = []
    s = len(u)
    if 0 < s <= 4 * SINGLES_UPTO // 3:
        out.append((0, *_single_signatures(u)))
    if s > SINGLES_UPTO:
        out.extend((b.number & 1, *band_signatures(u, b)) for b in bands_of(s))
    return out


def set_key(u: np.ndarray) -> tuple[int, int]:
    a = tk.mix64(u).sum(dtype=np.uint64)
    b = tk.mix64(u * _U64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64)
    return int(np.int64(a)), int(np.int64(b))


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text"))


def shingle_counts(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles and a 128-bit key of the set."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in tk.slices(batch.column(1)):
                got = [(len(u), *set_key(u)) for u in tk.shingle_sets(tk.tokenize(s, tk.SOLID), width)]
                n, a, b = (pa.array(x, pa.int64()) for x in zip(*got))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, s.rows()), n, a, b], names=["doc_id", "n_shingles", "key_a", "key_b"])

    return _documents(docs).mapInArrow(rows, "doc_id bigint, n_shingles bigint, key_a bigint, key_b bigint")


SIGNATURES = "bucket int, sigs binary, docs binary, keeps binary"


def _packed(sig: list[np.ndarray], doc: list[np.ndarray], keeps: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    s, d, k = np.concatenate(sig), np.concatenate(doc), np.concatenate(keeps)
    bucket = ((s >> _U64(REMAINDER_BITS)) % _U64(buckets)).astype(np.int64)
    keys, cols = [], ([], [], [])
    low = s.view(np.uint8).reshape(-1, 8)[:, : REMAINDER_BITS // 8]
    for key, x, i, f in deal(bucket, low, d, k):
        keys.append(key)
        for c, v in zip(cols, (x.tobytes(), delta(i), np.packbits(f).tobytes())):
            c.append(v)
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), *[pa.array(c, pa.binary()) for c in cols]], names=["bucket", "sigs", "docs", "keeps"])


def signature_blobs(docs: DataFrame, buckets: int, width: int = WIDTH) -> DataFrame:
    """SIGNATURES: packed by bucket, with the documents and a bit for those that pass over none."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        held: tuple[list, list, list] = ([], [], [])
        n_held = 0
        for batch in batches:
            for s in tk.slices(batch.column(1)):
                ids = batch.column(0).slice(s.first, s.rows()).to_pylist()
                for i, u in zip(ids, tk.shingle_sets(tk.tokenize(s, tk.SOLID), width)):
                    if i is None or not len(u):
                        continue
                    key = set_key(u)
                    if key in seen:
                        continue
                    seen.add(key)
                    for parity, found, keeps_all in signatures(u):
                        # the lowest bit tells the band's parity
                        for x, v in zip(held, ((found >> _U64(1) << _U64(1)) | _U64(parity), np.full(len(found), i, np.int64), np.full(len(found), keeps_all))):
                            x.append(v)
                        n_held += len(found)
                if n_held >= FLUSH:
                    yield _packed(*held, buckets)
                    held, n_held = ([], [], []), 0
        if n_held:
            yield _packed(*held, buckets)

    return _documents(docs).mapInArrow(rows, SIGNATURES)


def meeting_sets(blobs: DataFrame, parts: int) -> DataFrame:
    """(place, docs, sigs, classes): signatures that two or more sets share, packed by the document's place.

    A class byte holds the group's size on a log scale, and in its top bit whether
    the document passes over nothing in that signature's band.
    """
    n_places = places(parts)

    def shared_ones(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for bucket, got in runs(batches):
            sigs = np.concatenate([unblob(s, bucket) for s, _, _ in got])
            docs = np.concatenate([undelta(d) for _, d, _ in got])
            keeps = np.concatenate([np.unpackbits(np.frombuffer(k, np.uint8), count=len(d) // 8) for _, d, k in got])
            order = np.argsort(sigs, kind="stable")
            sigs, docs, keeps = sigs[order], docs[order], keeps[order]
            begin = np.flatnonzero(np.concatenate([[True], sigs[1:] != sigs[:-1]]))
            size = np.diff(np.append(begin, len(sigs)))
            shared = np.repeat(size > 1, size)
            scale = np.repeat(np.minimum(4 * np.log2(size), 127).astype(np.uint8), size)[shared] | keeps[shared] << 7
            yield docs[shared], sigs[shared], scale

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sigs, scale in together(shared_ones(batches), FLUSH):
            order = np.argsort(ids, kind="stable")
            ids, sigs, scale = ids[order], sigs[order], scale[order]
            cols = ([], [], [], [])
            for place, i, s, c in deal(ids % n_places, ids, sigs, scale):
                for x, v in zip(cols, (place, delta(i), s.tobytes(), c.tobytes())):
                    x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names=["place", "docs", "sigs", "classes"])

    return blobs.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(rows, "place bigint, docs binary, sigs binary, classes binary")


def k2_of(s: int, parity: int) -> int:
    """k2 of the band of this parity that sets of size s sign for."""
    if parity == 0 and s <= 4 * SINGLES_UPTO // 3:
        return 0
    return next((b.k2 for b in bands_of(s) if b.number & 1 == parity), 0)


def used_signatures(meet: DataFrame, nodes: DataFrame, parts: int) -> DataFrame:
    """(bucket, sigs, docs): shared signatures less those of the largest groups, within each set's allowance.

    A set that shares fewer signatures than any link of its size needs uses none in that band.
    The sizes of sets come from nodes (doc_id, n), dealt to the same places.
    """
    n_places = places(parts)
    none = F.lit(None).cast("binary")
    sizes = nodes.select(F.pmod("doc_id", F.lit(n_places)).alias("place"), none.alias("docs"), none.alias("sigs"), none.alias("classes"), "doc_id", "n")
    null = F.lit(None).cast("bigint")
    both = meet.withColumns({"doc_id": null, "n": null}).unionByName(sizes)

    def used(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for _, got in runs(batches):
            blobs = [x for x in got if x[0] is not None]
            if not blobs:
                continue
            ids = np.concatenate([undelta(x[0]) for x in blobs])
            sigs = np.concatenate([np.frombuffer(x[1], np.uint64) for x in blobs])
            classes = np.concatenate([np.frombuffer(x[2], np.uint8) for x in blobs])
            order = np.lexsort((sigs, classes & 127, sigs & _U64(1), ids))
            ids, sigs, classes = ids[order], sigs[order], classes[order]
            parity = (sigs & _U64(1)).astype(np.int64)
            new = np.ones(len(ids), bool)
            new[1:] = (ids[1:] != ids[:-1]) | (parity[1:] != parity[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(ids))
            size_of = {x[3]: x[4] for x in got if x[0] is None}
            keeps_all = np.bitwise_or.reduceat(classes, first) >> 7
            use = np.zeros(len(ids), bool)
            for i, j, k, p, d in zip(first.tolist(), last.tolist(), keeps_all.tolist(), parity[first].tolist(), ids[first].tolist()):
                may = 0 if k else allowance(size_of[d], k2_of(size_of[d], p))
                if k or j - i >= may + 2:
                    use[i : j - may] = True
            yield sigs[use], ids[use]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sigs, ids in together(used(batches), FLUSH):
            cols = ([], [], [])
            for k, s, d in deal((sigs >> _U64(REMAINDER_BITS)).astype(np.int64), sigs, ids):
                low = np.ascontiguousarray(s).view(np.uint8).reshape(-1, 8)[:, : REMAINDER_BITS // 8]
                for x, v in zip(cols, (k, low.tobytes(), delta(d))):
                    x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names=["bucket", "sigs", "docs"])

    return both.repartition(parts, "place").sortWithinPartitions("place").mapInArrow(rows, "bucket int, sigs binary, docs binary")


def groups_of(used: DataFrame, parts: int) -> DataFrame:
    """(grp, doc_id): groups of two or more sets that use one signature; equal groups of a bucket once.

    grp is a hash of the members.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, got in runs(batches):
            sigs = np.concatenate([unblob(s, bucket) for s, _ in got])
            ids = np.concatenate([undelta(d) for _, d in got])
            order = np.lexsort((ids, sigs))
            sigs, ids = sigs[order], ids[order]
            begin = np.flatnonzero(np.concatenate([[True], sigs[1:] != sigs[:-1]]))
            size = np.diff(np.append(begin, len(sigs)))
            members = tk.mix64(np.add.reduceat(tk.mix64(ids.view(np.uint64)), begin) + size.astype(np.uint64)).view(np.int64)
            first = np.zeros(len(begin), bool)
            first[np.unique(members, return_index=True)[1]] = True
            row = np.flatnonzero(np.repeat(first & (size > 1), size))
            for i in range(0, len(row), 1 << 16):
                at = row[i : i + (1 << 16)]
                g = np.searchsorted(begin, at, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(members[g]), pa.array(ids[at])], names=["grp", "doc_id"])

    return used.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(rows, "grp bigint, doc_id bigint")


def hubs_of(kept: DataFrame) -> DataFrame:
    """(grp, doc_id, hub): the hub of a group is the member that is in most groups, of equal ones the least."""
    often = kept.groupBy("doc_id").count()
    best = kept.join(often, "doc_id").groupBy("grp").agg(F.min(F.struct((-F.col("count")).alias("less"), F.col("doc_id").alias("hub")))["hub"].alias("hub"))
    return kept.join(best, "grp").filter(F.col("doc_id") != F.col("hub"))


def _of_nodes(docs: DataFrame, nodes: DataFrame, width: int, columns: str, make: Callable[[np.ndarray], tuple]) -> DataFrame:
    """doc_id and what make gives of the set, for the documents in nodes (doc_id), once each."""
    bitmap = id_filter(nodes)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            hit = pa.array(in_filter(bitmap, batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)))
            kept, texts = ids.filter(hit), batch.column(1).filter(hit)
            for s in tk.slices(texts):
                made = zip(*[make(u) for u in tk.shingle_sets(tk.tokenize(s, tk.SOLID), width)])
                yield pa.RecordBatch.from_arrays([kept.slice(s.first, s.rows()), *[pa.array(c, pa.binary()) for c in made]], names=["doc_id", *columns.split()])

    kinds = ", ".join(f"{c} binary" for c in columns.split())
    found = _documents(docs).filter(F.col("doc_id").isNotNull()).withColumn("h", F.xxhash64("doc_id")).mapInArrow(rows, f"doc_id bigint, {kinds}")
    return found.join(nodes, "doc_id", "left_semi").dropDuplicates(["doc_id"])


def whole_sets(docs: DataFrame, nodes: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, shingles): the sets of the documents in nodes, six bytes a shingle."""
    return _of_nodes(docs, nodes, width, "shingles", lambda u: (_short_set(u).view(np.uint8).reshape(-1, 8)[:, :6].tobytes(),))


def set_sketches(docs: DataFrame, nodes: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, payload): four bytes of size and the sketch of the documents in nodes."""
    return _of_nodes(docs, nodes, width, "payload", lambda u: (len(v := _short_set(u)).to_bytes(4, "little") + sketch(v),))


def _short_set(u: np.ndarray) -> np.ndarray:
    return np.unique(u & _U64((1 << 48) - 1))


def _unpacked(b: bytes) -> np.ndarray:
    raw = np.frombuffer(b, np.uint8).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :6] = raw
    return wide.view(np.uint64)[:, 0]


def _with_hubs(pairs: DataFrame, payloads: DataFrame, keep: Callable[[bytes, bytes], int | None]) -> DataFrame:
    """Pairs (a, b) for which keep(payload of a, payload of b) is a number, and that number.

    Each a (a hub may have very many partners) is copied to as many salts as it
    takes for HUB_ROWS partners each; a group holds one hub and its partners.
    payloads has doc_id and payload.
    """
    hubs = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / HUB_ROWS).cast("long").alias("salts"))
    partner = pairs.join(hubs, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts"))).join(payloads.withColumnRenamed("doc_id", "b"), "b").select("a", "salt", "b", "payload")
    hub = hubs.join(payloads.withColumnRenamed("doc_id", "a"), "a").select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "payload")

    def group(t: pa.Table) -> pa.Table:
        ids, payload = t["b"].to_pylist(), t["payload"].to_pylist()
        own = [x for i, x in zip(ids, payload) if i is None]
        found = [(i, n) for i, x in zip(ids, payload) if i is not None and own and (n := keep(own[0], x)) is not None]
        return pa.table({"a": pa.array([t["a"][0].as_py()] * len(found), pa.int64()), "b": pa.array([i for i, _ in found], pa.int64()), "number": pa.array([n for _, n in found], pa.int64())})

    return partner.unionByName(hub).groupBy("a", "salt").applyInArrow(group, "a bigint, b bigint, number bigint")


def _linked(x: bytes, y: bytes) -> int | None:
    a, b = _unpacked(x), _unpacked(y)
    if 4 * min(len(a), len(b)) < 3 * max(len(a), len(b)):
        return None
    inter = int(np.isin(a, b, assume_unique=True, kind="sort").sum())
    return inter if links(inter, len(a), len(b)) else None


def _possible(x: bytes, y: bytes) -> int | None:
    """By sketches behind their set sizes: sets differ in at least as many shingles as sketches do."""
    n = int.from_bytes(x[:4], "little") + int.from_bytes(y[:4], "little")
    s = _folded([x[4:], y[4:]])
    apart = int(np.abs(s[0] - s[1]).sum(dtype=np.int64))
    return apart if 7 * apart <= n else None


def checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of candidate pairs (a, b) those that link, with their exact intersection size."""
    return _with_hubs(pairs.select("a", "b"), sets.withColumnRenamed("shingles", "payload"), _linked)


def possible(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Candidate pairs that the sketches do not rule out."""
    return _with_hubs(pairs, sketches, _possible).select("a", "b")


def sketch(u: np.ndarray) -> bytes:
    """Counts of the set's shingles by low hash bits; as many bytes as the set has shingles, at least."""
    size = 64
    while size < len(u):
        size *= 2
    return np.minimum(np.bincount((u & _U64(size - 1)).astype(np.int64), minlength=size), 255).astype(np.uint8).tobytes()


def _folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of one width, the least of theirs; counts that fold together add up."""
    width = min(map(len, sketches))
    narrow = max(map(len, sketches)) // width * 255 < 1 << 15
    out = np.zeros((len(sketches), width), np.int16 if narrow else np.int64)
    for i, s in enumerate(sketches):
        out[i] = np.frombuffer(s, np.uint8).reshape(-1, width).sum(axis=0)
    return out


def across_components(members: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs (a, b) of unlike components in one family that their sketches do not rule out.

    members has family, node, component and n.  Two sets differ in at least as many
    shingles as their sketches do.  A family of more than BLOCK sets is dealt into
    blocks by hash, and pairs of blocks are compared.
    """
    blocks = members.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    rows = members.join(blocks, "family").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = rows.join(sketches.withColumnRenamed("doc_id", "node"), "node").withColumn("other", other).select("family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "component", "n", "payload")

    def compare(t: pa.Table) -> pa.Table:
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        block, node, comp, n = (t[c].to_numpy() for c in ("block", "node", "component", "n"))
        s = _folded([x[4:] for x in t["payload"].to_pylist()])
        a, b = [], []
        for p in np.flatnonzero(block == i).tolist():
            with_ = np.flatnonzero((comp != comp[p]) & (4 * np.minimum(n, n[p]) >= 3 * np.maximum(n, n[p])) & ((block == j) if i != j else (np.arange(len(n)) > p)))
            if len(with_):
                apart = np.abs(s[with_] - s[p]).sum(axis=1, dtype=np.int64)
                with_ = with_[7 * apart <= n[with_] + n[p]]
                a.append(np.minimum(node[with_], node[p]))
                b.append(np.maximum(node[with_], node[p]))
        none = np.zeros(0, np.int64)
        return pa.table({"a": np.concatenate(a or [none]), "b": np.concatenate(b or [none])})

    return dealt.groupBy("family", "i", "j").applyInArrow(compare, "a bigint, b bigint").distinct()


def _pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.filter(F.col(x) != F.col(y)).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def link_components(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id for every row.

    Not every link is looked for: two texts that others already put into one component are not compared.
    """
    with scratch(docs.sparkSession) as keep:
        return keep(_link_components(docs, width), "linked")


def _link_components(docs: DataFrame, width: int) -> DataFrame:
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = durable(shingle_counts(docs, width), "shingle-counts")
    known = counted.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    # equal sets, by their key, are one node: the least document
    same = known.groupBy("key_a", "key_b", "n_shingles").agg(F.min("doc_id").alias("node"))
    nodes = durable(known.select("doc_id", "key_a", "key_b").distinct().join(same, ["key_a", "key_b"]).groupBy("doc_id").agg(F.min("node").alias("node"), F.max("n_shingles").alias("n")), "nodes")

    meet = meeting_sets(signature_blobs(docs, 4 * parts, width), parts)
    kept = durable(groups_of(used_signatures(meet, nodes, parts), parts).distinct(), "kept")

    of = nodes.select("doc_id", "node", "n")
    hub = of.select(F.col("doc_id").alias("hub"), F.col("node").alias("family"), F.col("n").alias("n_hub"))
    stars = durable(hubs_of(kept).select("doc_id", "hub").distinct().join(of, "doc_id").join(hub, "hub").select("family", "node", "n", "n_hub").distinct(), "stars")
    pairs = durable(_pairs(stars.filter("4 * least(n, n_hub) >= 3 * greatest(n, n_hub)"), "family", "node"), "pairs")
    inside = durable(stars.select("family", "node").union(stars.select("family", F.col("family").alias("node"))).distinct(), "families")
    needed = durable(inside.select(F.col("node").alias("doc_id")).distinct(), "needed")
    sketches = durable(set_sketches(docs, needed, width), "sketches")
    linked = _linked_pairs(docs, durable(possible(pairs, sketches), "possible"), width)
    found = components(linked)

    # families that still hold different components: every pair across them that was not checked
    members = inside.join(found, "node", "left").select("family", "node", F.coalesce("component", "node").alias("component")).join(nodes.filter("doc_id = node").select("node", "n"), "node")
    members = durable(members, "members")
    mixed = members.groupBy("family").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least <> most").select("family")
    members = members.join(mixed, "family")
    more = durable(across_components(members, sketches).join(pairs, ["a", "b"], "left_anti"), "pairs")
    linked_too = None if more.isEmpty() else _linked_pairs(docs, more, width)
    if linked_too is not None and not linked_too.isEmpty():
        found = components(linked.unionByName(linked_too))
    labels = of.select("doc_id", "node").join(found, "node", "left").select("doc_id", F.coalesce("component", "node").alias("component"))
    return counted.join(labels, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _linked_pairs(docs: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """Of the pairs (a, b) those that link, checked on the whole sets of their documents."""
    ends = durable(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ends")
    sets = durable(whole_sets(docs, ends, width), "sets")
    return durable(checked(pairs, sets), "links")


def one_of_each(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs without the documents that are not the least of their component.

    Only rows that a bounded filter over the dropped ids catches are joined with
    them; the others pass without a shuffle of their texts.
    """
    with scratch(docs.sparkSession) as keep:
        found = link_components(docs, width)
        drop = keep(found.filter(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct(), "dropped")
    return without(docs, drop)


def op5_query(docs: DataFrame) -> DataFrame:
    return link_components(docs).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
with w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as (
  select distinct doc_id, array_to_string(w[i : i + 4], ' ') g
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) i from w)),
n as (select doc_id, count(*) n from s group by doc_id),
common as (select a.doc_id a, b.doc_id b, count(*) k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
links as (
  select a, b from common join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 75 * (x.n + y.n - k)),
sides as (select a, b from links union all select b, a from links),
reach as (
  with recursive r(doc_id, other) as (
    select doc_id, doc_id from documents union select r.doc_id, sides.b from r join sides on sides.a = r.other)
  select doc_id, min(other) component_id from r group by doc_id)
select w.doc_id, coalesce(n.n, 0)::bigint n_shingles, coalesce(component_id, w.doc_id) component_id
from w left join n using (doc_id) left join reach using (doc_id)
"""
