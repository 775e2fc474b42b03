"""Hard negatives by branch and bound over ball trees.

Rows are dealt at random over the tasks.  A task gathers TREE_ROWS of them at a time
into a ball tree and searches it for a block of queries at once.  A ball around c of
radius r bounds the inner products of a query q with its rows from both sides by
q.c -+ |q| r; a node is left out for the queries whose score window it misses, for
those whose label it cannot serve, and for those whose k-th best score so far lies
strictly above it.  The best rows so far stay from one tree to the next, so later
trees are pruned by what earlier ones gave; the lists of the tasks are merged last.

Two searches make triples: an anchor's best rows of its own label (the positives), then
for each the best rows of other labels in a window that its score sets.

Queries come in chunks of QUERIES; a task sees one chunk and a share of the rows, so
neither side is ever held whole.  Scores are exact: components are integers, and their
products are summed as doubles while those are exact, else as Python integers.

Inputs and edge cases
* rows with a null label or vector or a null or non-finite component take no part.
* a null vec_id is no anchor, and comes last among equal scores.
* vectors of unlike length: the shorter one counts as if it ended in zeros.
* repeated rows are rows of their own: a repeated anchor is answered each time, and only
  one of the rows that equal an anchor in vec_id and score counts as the anchor itself.
* scores outside of 64 bits are an error.  An empty table, or one without anchors, gives no
  rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import durable

LEAF = 64
TREE_ROWS = 1 << 14
#: Queries of a chunk.
QUERIES = 1 << 12
#: Stands for a null id; larger than any that is not null.
NO_ID = np.int64(2**63 - 1)
LOWEST, HIGHEST = -(2**63), 2**63 - 1
#: Sums of products below this are exact as doubles.
EXACT = 2.0**53
SCALE = 256

FOUND = "query bigint, vec_id bigint, score bigint"


@dataclass
class Node:
    center: np.ndarray
    radius: float
    first: int
    last: int
    label: int | None  # of all its rows, where they share one
    below: tuple["Node", ...] = ()


def components(vectors: pa.Array, width: int) -> np.ndarray:
    """floor(256 * x) of each component, rows padded with zeros to `width`."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = np.floor(SCALE * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class BallTree:
    """Rows sorted into balls; those of a label of LEAF rows and more have a subtree of their own."""

    def __init__(self, vectors: np.ndarray, labels: np.ndarray, ids: np.ndarray):
        order = np.argsort(labels, kind="stable")
        _, first, counts = np.unique(labels[order], return_index=True, return_counts=True)
        large = counts >= LEAF
        pooled = np.repeat(~large, counts)
        order = np.concatenate([order[~pooled], order[pooled]])
        self.vectors, self.labels, self.ids = vectors[order], labels[order], ids[order]
        ends = np.cumsum(counts[large]).tolist()
        spans = [*zip([0, *ends], ends)]
        if pooled.any():
            spans.append((ends[-1] if ends else 0, len(order)))
        self.roots = [self._build(a, b, int(self.labels[a]) if self.labels[a] == self.labels[b - 1] else None) for a, b in spans]

    def _build(self, a: int, b: int, label: int | None) -> Node:
        v = self.vectors[a:b]
        center = v.mean(axis=0)
        away = np.einsum("ij,ij->i", v - center, v - center)
        node = Node(center, float(np.sqrt(away.max())), a, b, label)
        if b - a > LEAF and node.radius > 0:
            one = v[np.argmax(away)]
            other = v[np.argmax(np.einsum("ij,ij->i", v - one, v - one))]
            half = (b - a) // 2
            order = np.argpartition(v @ (other - one), half) + a
            for x in (self.vectors, self.labels, self.ids):
                x[a:b] = x[order]
            node.below = (self._build(a, a + half, label), self._build(a + half, b, label))
        return node


class Queries:
    """A block of queries, and the k best rows that each has so far."""

    def __init__(self, vectors: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same_label: bool):
        self.vectors, self.labels, self.low, self.high, self.same_label, self.k = vectors, labels, low, high, same_label, k
        self.norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        self.widest = float(np.abs(vectors).max(initial=0.0))
        self.score = np.full((len(vectors), k), LOWEST, np.int64)
        self.id = np.full((len(vectors), k), NO_ID, np.int64)
        self.held = np.zeros(len(vectors), np.int64)
        self.worst = np.full(len(vectors), LOWEST, np.int64)

    def search(self, tree: BallTree) -> None:
        """First each query's most promising leaf, for a bound to begin with; then all that bounds leave over."""
        self.exact = self.widest * float(np.abs(tree.vectors).max(initial=0.0)) * self.vectors.shape[1] < EXACT
        self.begun = np.full(len(self.vectors), -1)
        everyone = np.arange(len(self.vectors))
        self._begin(tree, tree.roots, everyone)
        for root in tree.roots:
            self._visit(tree, root, everyone)

    def _begin(self, tree: BallTree, nodes: list[Node] | tuple[Node, ...], asked: np.ndarray) -> None:
        """Sends each query down to the leaf whose centre scores highest, or nearest to its window's upper end."""
        middle = self.vectors[asked] @ np.array([x.center for x in nodes]).T
        high = self.high[asked].astype(np.float64)[:, None]
        worth = np.where(middle <= high, middle, 2 * high - middle)
        for j, node in enumerate(nodes):
            if node.label is not None:
                worth[(self.labels[asked] == node.label) != self.same_label, j] = -np.inf
        best = worth.argmax(axis=1)
        best[np.isneginf(worth.max(axis=1))] = -1
        for j in np.unique(best[best >= 0]).tolist():
            mine, node = asked[best == j], nodes[j]
            if node.below:
                self._begin(tree, node.below, mine)
            else:
                self._visit(tree, node, mine)
                self.begun[mine] = node.first

    def _visit(self, tree: BallTree, node: Node, asked: np.ndarray) -> None:
        if node.label is not None:
            asked = asked[(self.labels[asked] == node.label) == self.same_label]
        if not node.below:
            asked = asked[self.begun[asked] != node.first]
        middle = self.vectors[asked] @ node.center
        reach = self.norms[asked] * node.radius
        # doubles err by far less than a part in 10**9 here
        slack = 1e-9 * (np.abs(middle) + reach + self.norms[asked] * np.sqrt(node.center @ node.center)) + 1e-6
        upper, lower = middle + reach + slack, middle - reach - slack
        asked = asked[(upper >= self.low[asked]) & (lower <= self.high[asked]) & (upper >= self.worst[asked])]
        if not len(asked):
            return
        if node.below:
            for child in node.below:
                self._visit(tree, child, asked)
        else:
            # equal rows make leaves of any size
            for first in range(node.first, node.last, LEAF):
                self._take(tree, node, first, min(first + LEAF, node.last), asked)

    def _take(self, tree: BallTree, node: Node, first: int, last: int, asked: np.ndarray) -> None:
        rows = tree.vectors[first:last]
        if self.exact:
            score = (self.vectors[asked] @ rows.T).astype(np.int64)
        else:
            own, theirs = ([[int(x) for x in v] for v in m] for m in (self.vectors[asked], rows))
            score = np.array([[sum(map(int.__mul__, q, v)) for v in theirs] for q in own], dtype=np.int64)
        good = (score >= np.maximum(self.low[asked], self.worst[asked])[:, None]) & (score <= self.high[asked][:, None])
        if node.label is None:
            good &= (self.labels[asked][:, None] == tree.labels[first:last][None, :]) == self.same_label
        who, which = np.nonzero(good)
        if not len(who):
            return
        hit = np.unique(who)
        mine = asked[hit]
        k = self.k
        keep = np.arange(k)[None, :] < self.held[mine][:, None]
        owner = np.concatenate([np.repeat(mine, k)[keep.ravel()], asked[who]])
        scores = np.concatenate([self.score[mine].ravel()[keep.ravel()], score[who, which]])
        ids = np.concatenate([self.id[mine].ravel()[keep.ravel()], tree.ids[first:last][which]])
        # scores are negated as ~s, which has no overflow
        order = np.lexsort((ids, ~scores, owner))
        owner, scores, ids = owner[order], scores[order], ids[order]
        begin = np.flatnonzero(np.diff(owner, prepend=-1))
        rank = np.arange(len(owner)) - np.repeat(begin, np.diff(np.append(begin, len(owner))))
        best = rank < k
        owner, scores, ids, rank = owner[best], scores[best], ids[best], rank[best]
        self.score[owner, rank], self.id[owner, rank] = scores, ids
        np.maximum.at(self.held, owner, rank + 1)
        full = mine[self.held[mine] == k]
        self.worst[full] = self.score[full, k - 1]


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, label and embedding of the rows that take part."""
    e = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), "embedding")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return e.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
    """(cell, whether they are rows and not queries, stretch of a batch) of batches sorted by both."""
    for b in batches:
        cell, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(2 * cell + kind)) + 1).tolist(), len(cell)] if len(cell) else []
        for i, j in zip(cuts, cuts[1:]):
            yield int(cell[i]), bool(kind[i]), b.slice(i, j - i)


def _columns(b: pa.RecordBatch, width: int) -> tuple[np.ndarray, ...]:
    """ids, labels and components; of queries also their windows."""
    ids, label, vector = b.column(2).fill_null(int(NO_ID)).to_numpy(), b.column(3).to_numpy(), components(b.column(4), width)
    if b.column(1)[0].as_py():
        return vector, label, ids
    return ids, label, vector, b.column(5).to_numpy(), b.column(6).to_numpy()


def _joined(columns: Iterable[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    return tuple(map(np.concatenate, zip(*columns)))


def search(vectors: DataFrame, queries: DataFrame, k: int, same_label: bool, chunk: int = QUERIES, tree_rows: int = TREE_ROWS) -> DataFrame:
    """FOUND: the k best rows of vectors (vec_id, label, embedding) for each row of queries.

    queries is a stored table (query, label, embedding, low, high): `query` numbers its
    rows, scores lie in low..high, and rows have the query's label or, without
    same_label, another.  Ties go to the smaller vec_id.
    """
    spark = vectors.sparkSession
    sizes = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("width")).first()
    chunks, shares = max(1, -(-sizes["n"] // chunk)), int(spark.conf.get("spark.sql.shuffle.partitions"))
    # what lies behind the longest query's last component meets zeros only
    width = max(sizes["width"] or 0, 1)
    cell = lambda part, share: (part * shares + share).alias("cell")
    none = F.lit(None).cast("bigint")
    part = F.pmod(F.xxhash64("query"), F.lit(chunks))
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), "query", "label", "embedding", "low", "high")
    asked = asked.select(cell(part, F.col("share")), F.lit(0).alias("kind"), F.col("query").alias("id"), "label", "embedding", "low", "high")
    dealt = vectors.select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shares)).alias("share"), "vec_id", "label", F.slice("embedding", 1, width).alias("embedding"))
    dealt = dealt.select("share", "vec_id", "label", "embedding", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("part"))
    dealt = dealt.select(cell(F.col("part"), F.col("share")), F.lit(1).alias("kind"), F.col("vec_id").alias("id"), "label", "embedding", none.alias("low"), none.alias("high"))
    parts = min(chunks * shares, 8 * shares)
    both = asked.unionByName(dealt).repartitionById(parts, F.pmod("cell", F.lit(parts)).cast("int")).sortWithinPartitions("cell", "kind")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, runs in groupby(_cells(batches), lambda x: x[0]):
            numbers, block, held, size = None, None, [], 0
            for is_row, found in groupby((x[1:] for x in runs), lambda x: x[0]):
                if not is_row:
                    numbers, label, vector, low, high = _joined(_columns(b, width) for _, b in found)
                    block = Queries(vector, label, low, high, k, same_label)
                    continue
                for _, b in found:
                    if block is None:
                        break  # a chunk without queries
                    held.append(_columns(b, width))
                    size += b.num_rows
                    if size >= tree_rows:
                        block.search(BallTree(*_joined(held)))
                        held, size = [], 0
            if held:
                block.search(BallTree(*_joined(held)))
            if block is not None:
                keep = np.arange(k)[None, :] < block.held[:, None]
                ids = block.id[keep]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(numbers, block.held)), pa.array(ids, mask=ids == NO_ID), pa.array(block.score[keep])], names=["query", "vec_id", "score"])

    found = both.mapInArrow(rows, FOUND)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), F.asc_nulls_last("vec_id")))).filter(F.col("rank") <= k)


def _self_score(v: F.Column) -> F.Column:
    """An anchor's product with itself, where it is exact in a long; null elsewhere."""
    total = F.aggregate(F.transform(v, lambda x: F.floor(x * SCALE).cast("double")), F.lit(0.0), lambda acc, x: acc + x * x)
    return F.when(total < EXACT, total.cast("bigint"))


def positives(vectors: DataFrame, anchors: DataFrame, n: int) -> DataFrame:
    """anchors (query, vec_id, label, embedding) with their n best other rows of the same label: positive_id, positive_score."""
    wide = anchors.select("query", "label", "embedding", F.lit(LOWEST).alias("low"), F.lit(HIGHEST).alias("high"))
    best = search(vectors, wide, n + 1, True)
    about = anchors.select("query", F.col("vec_id").alias("anchor_id"), _self_score(F.col("embedding")).alias("own"))
    named = best.join(about, "query")
    itself = (F.col("vec_id") == F.col("anchor_id")) & (F.col("own").isNull() | (F.col("score") == F.col("own")))
    at = F.min(F.when(itself, F.col("rank"))).over(Window.partitionBy("query"))
    others = named.withColumn("at", at).filter("not (rank <=> at)").withColumn("place", F.col("rank") - F.coalesce((F.col("rank") > F.col("at")).cast("int"), F.lit(0)))
    return others.filter(F.col("place") <= n).select("query", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))


def mine(vectors: DataFrame, anchors: DataFrame, n_positives: int = 5, n_negatives: int = 3, least: int = 50, most: int = 95) -> DataFrame:
    """Triples of anchors, positives and the best negatives with least..most per cent of the positive's score."""
    anchors = durable(anchors.withColumn("query", F.monotonically_increasing_id()), "anchors")
    found = positives(vectors, anchors, n_positives)
    # per cents of a score without a product that could overflow
    whole, rest = F.expr("positive_score div 100"), F.col("positive_score") % 100
    low, high = whole * least + F.ceil(rest * least / 100), whole * most + F.floor(rest * most / 100)
    pairs = found.filter("positive_score >= 0").withColumns({"low": low.cast("bigint"), "high": high.cast("bigint"), "pair": F.monotonically_increasing_id()}).filter("low <= high")
    pairs = durable(pairs, "positives")
    asked = pairs.join(anchors.select("query", "label", "embedding"), "query").select(F.col("pair").alias("query"), "label", "embedding", "low", "high")
    hard = search(vectors, durable(asked, "windows"), n_negatives, False)
    about = pairs.select(F.col("pair").alias("query"), "anchor_id", "positive_id", "positive_score")
    return hard.join(about, "query").select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_query(embeddings: DataFrame) -> DataFrame:
    rows = usable(embeddings)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.withColumn("label", moved)
    return mine(rows, rows.filter("vec_id % 50 = 0"))


ORACLE = """
with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end l, list_transform(embedding, lambda x: floor(256 * x::double)) v from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id a, b.vec_id b, a.l = b.l same, list_dot_product(a.v, b.v)::bigint s from e a, e b where a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
p as (select a, b, s from s where same qualify row_number() over (partition by a order by s desc, b) <= 5),
n as (select p.a, p.b p, p.s ps, s.b n, s.s ns, row_number() over (partition by p.a, p.b order by s.s desc, s.b) r from p join s on p.a = s.a and not s.same and 50 * p.s <= 100 * s.s and 100 * s.s <= 95 * p.s)
select a anchor_id, p positive_id, r::int rank, n negative_id, ps positive_score, ns negative_score from n where r <= 3
"""
