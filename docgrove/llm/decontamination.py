"""Benchmark decontamination with a stored positional inverted index.

``build_index`` tokenises the training documents once and stores, per segment (a
run of whole documents of about a megabyte), the sorted term hashes with their
position lists.  ``match`` answers benchmark windows from those lists alone: the
offset-adjusted list of a window's rarest term is intersected with the next
rarest, and so on.  Segments hold whole documents, so no list of a frequent term
ever spans the corpus, and nothing is shuffled.

Terms are compared by 64-bit hash of the word's bytes.  Positions count words.

Inputs and edge cases
* null text: no words; the document is returned with n_words 0 and no hit.
* null doc_id: kept, returned as null.  Repeated rows: one result per row.
* null or wordless benchmark items give no window; null item_id reads as ''.
* empty tables: an empty result, or documents without hits.
* other columns of either table are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .shared import durable, scratch, unused_name, without

WINDOW = 10
#: Benchmark text that one pass carries to the executors; larger benchmarks go in blocks.
BLOCK_BYTES = 2 << 20
#: Distinct benchmark terms up to which postings are kept only for them.
VOCABULARY_LIMIT = 1 << 21
_CANDIDATES = 1 << 20
#: Words by which the proximity query lets a benchmark word lie off its place.
SLOP = 1
NO_ID = -(1 << 63)

INDEX_SCHEMA = "segment_task int, segment_no int, doc_ids array<bigint>, first_word array<bigint>, terms binary, lengths binary, positions binary"
MATCH_SCHEMA = "segment_task int, segment_no int, segment_row int, doc_id bigint, n_words bigint, spans array<struct<from:bigint,to:bigint>>, item_ids array<string>, near_item_ids array<string>"


@dataclass
class Windows:
    """Windows of benchmark items over a vocabulary of term hashes (a bounded block)."""

    vocabulary: np.ndarray  # sorted uint64
    terms: np.ndarray  # windows x width, index into vocabulary, -1 past the end
    length: np.ndarray
    item: np.ndarray
    item_ids: list[str]


def item_windows(items: list[tuple[str | None, str | None]], width: int = WINDOW) -> Windows:
    """Every run of `width` item words; an item with fewer words, but not none, is one window."""
    texts = pa.array([t for _, t in items], pa.string())
    rows, lengths, owner = [], [], []
    base = 0
    for s in tk.slices(texts):
        t = tk.tokenize(s, tk.WORDY)
        for r, (a, b) in enumerate(zip(t.row_first[:-1].tolist(), t.row_first[1:].tolist())):
            n = b - a
            if n == 0:
                continue
            w = min(width, n)
            view = np.lib.stride_tricks.sliding_window_view(t.hash[a:b], w)
            block = np.zeros((len(view), width), np.uint64)
            block[:, :w] = view
            rows.append(block)
            lengths.append(np.full(len(view), w))
            owner.append(np.full(len(view), base + r))
        base += s.rows()
    # rows of one id are one item
    place: dict[str, int] = {}
    of_row = np.array([place.setdefault("" if i is None else str(i), len(place)) for i, _ in items], np.int64)
    ids = list(place)
    if not rows:
        z = np.zeros(0, np.int64)
        return Windows(np.zeros(0, np.uint64), np.zeros((0, width), np.int64), z, z, ids)
    grid, length, item = np.concatenate(rows), np.concatenate(lengths), of_row[np.concatenate(owner)]
    real = np.arange(width) < length[:, None]
    vocabulary = np.unique(grid[real])
    terms = np.where(real, np.searchsorted(vocabulary, grid), -1).astype(np.int32)
    return Windows(vocabulary, terms, length, item, ids)


def _pack_postings(t: tk.Tokens, keep: np.ndarray | None) -> tuple[bytes, bytes, bytes]:
    pos = np.arange(len(t.hash), dtype=np.int64) if keep is None else np.flatnonzero(keep)
    h = t.hash[pos]
    order = np.argsort(h, kind="stable")
    h, pos = h[order], pos[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    begin = np.flatnonzero(new)
    lengths = np.diff(np.append(begin, len(h)))
    delta = np.diff(pos, prepend=0)
    delta[begin] = pos[begin]
    return h[begin].tobytes(), lengths.astype(np.uint32).tobytes(), delta.astype(np.uint32).tobytes()


def build_index(docs: DataFrame, vocabulary: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index: one row per segment.  `vocabulary` restricts it to these term hashes."""
    mask = None
    if vocabulary is not None:
        bits = max(10, int(len(vocabulary)).bit_length() + 4)
        mask = np.zeros(1 << bits, bool)
        mask[(vocabulary & np.uint64(len(mask) - 1)).astype(np.int64)] = True

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, no = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = batch.column(0)
            for s in tk.slices(batch.column(1)):
                t = tk.tokenize(s, tk.WORDY)
                keep = None
                if mask is not None:
                    keep = mask[(t.hash & np.uint64(len(mask) - 1)).astype(np.int64)]
                    if len(vocabulary):
                        at = np.flatnonzero(keep)
                        found = np.minimum(np.searchsorted(vocabulary, t.hash[at]), len(vocabulary) - 1)
                        keep[at] = vocabulary[found] == t.hash[at]
                terms, lengths, positions = _pack_postings(t, keep)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([task], pa.int32()), pa.array([no], pa.int32()), pa.array([ids[s.first : s.last].to_pylist()], pa.list_(pa.int64())),
                     pa.array([t.row_first], pa.list_(pa.int64())), pa.array([terms], pa.binary()), pa.array([lengths], pa.binary()), pa.array([positions], pa.binary())],
                    names=["segment_task", "segment_no", "doc_ids", "first_word", "terms", "lengths", "positions"],
                )
                no += 1

    plan = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return durable(plan.mapInArrow(segments, INDEX_SCHEMA), "postings")


class Postings:
    """The position lists of one segment, ready for intersection."""

    def __init__(self, terms: bytes, lengths: bytes, positions: bytes, first_word: np.ndarray):
        self.terms = np.frombuffer(terms, np.uint64)
        self.lengths = np.frombuffer(lengths, np.uint32).astype(np.int64)
        self.begin = np.cumsum(self.lengths) - self.lengths
        delta = np.frombuffer(positions, np.uint32).astype(np.int64)
        total = np.cumsum(delta)
        ahead = np.zeros(len(self.lengths), np.int64)
        if len(ahead):
            ahead[1:] = total[self.begin[1:] - 1]
        self.positions = total - np.repeat(ahead, self.lengths)
        self.first_word = first_word
        self.span = int(first_word[-1]) + 1 if len(first_word) else 1
        self.keys = np.repeat(np.arange(len(self.terms)), self.lengths) * self.span + self.positions

    def find(self, w: Windows, slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(window, start): at start, each window word j has a posting within `slop` of start + j.

        All of them lie in one document, and so does the window itself.  slop 0 is
        the exact phrase.
        """
        none = np.zeros(0, np.int64)
        if not len(self.terms) or not len(w.terms):
            return none, none
        local = np.minimum(np.searchsorted(self.terms, w.vocabulary), len(self.terms) - 1)
        local = np.where(self.terms[local] == w.vocabulary, local, -1)
        width = w.terms.shape[1]
        real = w.terms >= 0
        terms = np.where(real, local[w.terms], -1)
        sizes = np.where(terms >= 0, self.lengths[terms], 0)
        sizes[~real] = np.iinfo(np.int64).max
        active = np.flatnonzero(sizes.min(axis=1) > 0)
        if not len(active):
            return none, none
        rarest = np.argsort(sizes[active], axis=1, kind="stable")
        least = np.take_along_axis(sizes[active], rarest[:, :1], 1)[:, 0] * (2 * slop + 1)
        cuts = np.flatnonzero(np.diff(np.cumsum(least) // _CANDIDATES, prepend=0)).tolist()
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for a, b in zip([0, *cuts], [*cuts, len(active)]):
            if a < b:
                found.append(self._intersect(w, terms, active[a:b], rarest[a:b], width, slop))
        return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])

    def _intersect(self, w: Windows, terms: np.ndarray, active: np.ndarray, rarest: np.ndarray, width: int, slop: int) -> tuple[np.ndarray, np.ndarray]:
        first = terms[active, rarest[:, 0]]
        n = self.lengths[first]
        row = np.repeat(np.arange(len(active)), n)
        at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.begin[first], n)
        start = self.positions[at] - rarest[row, 0]
        if slop:
            shift = np.arange(-slop, slop + 1)
            row, start = np.repeat(row, len(shift)), (start[:, None] + shift).ravel()
            room = self.span + 2 * (width + slop)
            pair = np.unique(row * room + start + width + slop)
            row, start = pair // room, pair % room - width - slop
        length = w.length[active[row]]
        doc = np.searchsorted(self.first_word, np.maximum(start, 0), "right") - 1
        doc = np.minimum(doc, len(self.first_word) - 2)
        inside = (start >= 0) & (start + length <= self.first_word[doc + 1])
        row, start, length, doc = row[inside], start[inside], length[inside], doc[inside]
        for j in range(0 if slop else 1, width):
            if not len(row):
                break
            offset = rarest[row, j]
            needed = j < length
            term = terms[active[row], offset]
            low = np.maximum(start + offset - slop, self.first_word[doc])
            high = np.minimum(start + offset + slop, self.first_word[doc + 1] - 1)
            k = np.searchsorted(self.keys, term * self.span + low)
            hit = self.keys[np.minimum(k, len(self.keys) - 1)]
            ok = ~needed | ((k < len(self.keys)) & (hit <= term * self.span + high))
            row, start, length, doc = row[ok], start[ok], length[ok], doc[ok]
        return active[row], start


def _spans(postings: Postings, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal hit runs (document row, from, to), in words of the document."""
    edge = np.zeros(postings.span + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + length, -1)
    hit = np.cumsum(edge)[: postings.span - 1] > 0
    before = np.concatenate([[False], hit[:-1]]) if len(hit) else hit
    borders = postings.first_word[:-1]
    before[borders[borders < len(hit)]] = False
    begin = np.flatnonzero(hit & ~before)
    after = np.concatenate([hit[1:], [False]]) if len(hit) else hit
    ends = postings.first_word[1:]
    after[ends[ends > 0] - 1] = False
    end = np.flatnonzero(hit & ~after) + 1
    doc = np.searchsorted(postings.first_word, begin, "right") - 1
    return doc, begin - postings.first_word[doc], end - postings.first_word[doc]


def match(index: DataFrame, windows: Windows, slop: int = 0) -> DataFrame:
    """Per indexed document its exact hit spans and items; with slop, also the items met in proximity."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                first = np.array(r["first_word"], np.int64)
                n = len(first) - 1
                p = Postings(r["terms"], r["lengths"], r["positions"], first)
                spans: list[list[dict]] = [[] for _ in range(n)]
                items: list[list[str]] = [[] for _ in range(n)]
                near: list[list[str]] = [[] for _ in range(n)]
                which, start = p.find(windows)
                if len(which):
                    for d, a, b in zip(*(x.tolist() for x in _spans(p, start, windows.length[which]))):
                        spans[d].append({"from": a, "to": b})
                    _items(p, windows, which, start, items)
                if slop:
                    _items(p, windows, *p.find(windows, slop), near)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["segment_task"]] * n, pa.int32()), pa.array([r["segment_no"]] * n, pa.int32()), pa.array(np.arange(n), pa.int32()), pa.array(r["doc_ids"], pa.int64()), pa.array(np.diff(first), pa.int64()),
                     pa.array(spans, pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))), pa.array(items, pa.list_(pa.string())), pa.array(near, pa.list_(pa.string()))],
                    names=["segment_task", "segment_no", "segment_row", "doc_id", "n_words", "spans", "item_ids", "near_item_ids"],
                )

    return index.mapInArrow(rows, MATCH_SCHEMA)


def _items(p: Postings, w: Windows, which: np.ndarray, start: np.ndarray, into: list[list[str]]) -> None:
    doc = np.searchsorted(p.first_word, start, "right") - 1
    pair = np.unique(doc * len(w.item_ids) + w.item[which])
    for d, i in zip((pair // len(w.item_ids)).tolist(), (pair % len(w.item_ids)).tolist()):
        into[d].append(w.item_ids[i])


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, slop: int = 0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of MATCH_SCHEMA for every document against the whole benchmark.

    The benchmark's size is measured first.  Up to `block_bytes` it travels as one
    block; beyond, items are dealt by hash into blocks that are matched one after
    another against the same stored index, and their spans are united.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-total // block_bytes))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)))
    blocks = (item_windows([(r.item_id, r.text) for r in dealt.filter(F.col("block") == k).select("item_id", "text").collect()], width) for k in range(n_blocks))
    if n_blocks == 1:
        only = next(blocks)
        return match(build_index(docs, only.vocabulary), only, slop)
    vocabulary = np.zeros(0, np.uint64)
    for w in blocks:
        vocabulary = np.union1d(vocabulary, w.vocabulary)
        if len(vocabulary) > VOCABULARY_LIMIT:
            vocabulary = None
            break
    index = build_index(docs, vocabulary)
    parts = None
    for k in range(n_blocks):
        w = item_windows([(r.item_id, r.text) for r in dealt.filter(F.col("block") == k).select("item_id", "text").collect()], width)
        part = match(index, w, slop)
        parts = part if parts is None else parts.unionByName(part)
    merged = parts.groupBy("segment_task", "segment_no", "segment_row", "doc_id", "n_words").agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_list("item_ids"))).alias("item_ids"),
        F.array_distinct(F.flatten(F.collect_list("near_item_ids"))).alias("near_item_ids"),
    )
    return merged.select("segment_task", "segment_no", "segment_row", "doc_id", "n_words", _united("spans").alias("spans"), "item_ids", "near_item_ids")


def _united(spans: str) -> F.Column:
    """Sorted spans with overlapping and touching ones made one."""
    kind = "array<struct<from:bigint,to:bigint>>"
    return F.aggregate(
        spans,
        F.array().cast(kind),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["to"] >= x["from"]),
            F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["from"].alias("from"), F.greatest(F.try_element_at(acc, F.lit(-1))["to"], x["to"]).alias("to")))),
        ).otherwise(F.concat(acc, F.array(F.struct(x["from"].alias("from"), x["to"].alias("to"))))),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that hold a benchmark window.

    Of rows that share an id, one contaminated row takes all.  Rows with a null id
    stand behind one id in the first look, and are judged by text if that one is hit.
    """
    with scratch(docs.sparkSession) as keep:
        named = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc_id"), "text")
        hit = keep(decontaminate(named, benchmark).filter(F.size("spans") > 0).select("doc_id").distinct(), "contaminated")
        nameless = docs.filter(F.col("doc_id").isNull())
        bad = None
        if not hit.filter(F.col("doc_id") == NO_ID).isEmpty():
            # rows without an id: judged one by one, by their text
            bad = keep(contaminated_texts(nameless, benchmark), "contaminated-texts")
    if bad is not None:
        text = unused_name("bad_text", docs)
        nameless = nameless.join(bad.toDF(text), F.col("text") == F.col(text), "left_anti")
    return without(docs.filter(F.col("doc_id").isNotNull()), hit.filter(F.col("doc_id") != NO_ID)).unionByName(nameless)


def contaminated_texts(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """text: the distinct texts of docs with a benchmark window."""
    texts = durable(docs.filter(F.col("text").isNotNull()).select("text").distinct().select("text", F.xxhash64("text").alias("doc_id")), "texts")
    hit = decontaminate(texts, benchmark).filter(F.size("spans") > 0).select("doc_id").distinct()
    return texts.join(hit, "doc_id", "left_semi").select("text")


def _verdicts(found: DataFrame, *more: Column) -> DataFrame:
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["to"] - x["from"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("item_ids"), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        *more,
    )


def op1_query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return _verdicts(decontaminate(docs, benchmark))


def proximity_query(docs: DataFrame, benchmark: DataFrame, slop: int = SLOP) -> DataFrame:
    """The columns of op1_query, and the items met within `slop`, among them those of exact hits."""
    near = F.array_sort(F.array_distinct("near_item_ids"))
    return _verdicts(decontaminate(docs, benchmark, slop=slop), F.size(near).cast("long").alias("n_near_items"), near.alias("near_item_ids"))


ORACLE = r"""
with d as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
bw as (
  select distinct item_id, least(10, len(w)) n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') g
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, least(len(w), 1)) + 1)) i from b)),
widths as (select distinct n from bw),
dw as (
  select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') g
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from d, widths)),
hits as (select doc_id, dw.n, i, item_id from dw join bw on dw.g = bw.g and dw.n = bw.n),
words as (select doc_id, count(distinct j) n_hit from (select doc_id, unnest(range(i, i + n)) j from hits) group by doc_id),
items as (
  select doc_id, count(distinct item_id) n_items, array_to_string(list_sort(list(distinct item_id::varchar)), ',') ids from hits group by doc_id)
select d.doc_id, coalesce(len(w), 0)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
  sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join words using (doc_id) left join items using (doc_id)
"""
