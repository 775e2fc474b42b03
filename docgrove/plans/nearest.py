"""Exact nearest rows of a set of queries: blocks of queries meet shares of the vectors.

Spark deals queries into blocks and vectors into shares of bounded size; each pair of a
block and a share is one group.  Inside it a product of matrices gives every score but
for its last bits.  Rows that come within the product's error of a query's k-th best are
scored again, component by component in order as ``functions.vectors.dot`` adds them, and
only those scores are returned.  So scores and ties are the same for any layout.

A vector or query with a null or infinite component, NaN, of length 0 or of another
size than its partner takes no part in the product; such pairs are scored one by one.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

#: Components of the vectors of a share, and scores that are held at once.
SHARE_VALUES, SCORES = 1 << 21, 1 << 20
#: Vectors of a share at least and at most.
LEAST_SHARE, MOST_SHARE = 1 << 10, 1 << 15


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """As Spark's round: halves of the shortest decimal form go away from zero."""
    scale = 10.0**digits
    with np.errstate(all="ignore"):
        up = np.abs(x) * scale
        near = np.floor(up + 0.5)
        out = np.copysign(np.where(up < 2**52, near / scale, np.abs(x)), x)
        unsure = np.flatnonzero((up < 2**52) & (np.abs(up - np.floor(up) - 0.5) < np.maximum(1e-6, up * 1e-14)))
    unit = Decimal(1).scaleb(-digits)
    for i in unsure:
        out[i] = float(Decimal(repr(float(x[i]))).quantize(unit, ROUND_HALF_UP))
    return out


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row inner products, summed in order."""
    return np.cumsum(a * b, axis=1)[:, -1] + 0.0 if a.shape[1] else np.zeros(len(a))


class _Vectors:
    """Rows of a column of arrays, by size; rows that are null or hold a null have none."""

    def __init__(self, column: pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
        size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = column.flatten()
        self.start = np.cumsum(size) - size
        self.values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
        nulls = np.append(0, np.cumsum(flat.is_null().to_numpy(zero_copy_only=False)))
        whole = column.is_valid().to_numpy(zero_copy_only=False) & (nulls[self.start + size] == nulls[self.start])
        self.size = np.where(whole, size, -1)

    def rows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.size == size)
        return at, self.values[self.start[at][:, None] + np.arange(size)]


def _best(q: np.ndarray, v: np.ndarray, rank: np.ndarray, k: int, cosine: bool, digits: int | None):
    """Per query (place in v, score, null) of the k first rows of v, which all have its size."""
    with np.errstate(all="ignore"):
        nq, nv = (np.sqrt(_dots(x, x)) for x in (q, v))
        fit_q, fit_v = (np.isfinite(n) & (n > 0) if cosine else np.isfinite(n) for n in (nq, nv))
        regular, odd = np.flatnonzero(fit_v), np.flatnonzero(~fit_v)
        held = v[regular] / nv[regular, None] if cosine else v[regular]
        error = 16 * np.finfo(float).eps * (q.shape[1] + 4)
        largest = nv[regular].max(initial=0.0)
        step = max(1, SCORES // max(1, len(regular)))
        for a in range(0, len(q), step):
            product = (q[a : a + step] / np.where(nq[a : a + step] > 0, nq[a : a + step], 1)[:, None] if cosine else q[a : a + step]) @ held.T
            if len(regular) > k:
                bounds = np.partition(product, len(regular) - k, axis=1)[:, len(regular) - k]
            else:
                bounds = np.full(len(product), -np.inf)
            for i, bound in enumerate(bounds, a):
                if fit_q[i]:
                    slack = error if cosine else error * nq[i] * largest
                    slack = slack if digits is None else slack + 10.0**-digits
                    at = np.append(regular[product[i - a] >= bound - slack], odd)
                else:
                    at = np.arange(len(v))
                score = _dots(v[at], np.broadcast_to(q[i], (len(at), q.shape[1])))
                null = np.zeros(len(at), bool)
                if cosine:
                    norms = nv[at] * nq[i]
                    null = ~((norms > 0) | np.isnan(norms))
                    score = score / norms
                score = score if digits is None else rounded(score, digits)
                unlike = np.isnan(score)
                # as Spark orders scores that fall: NaN, numbers, null
                first = np.lexsort((rank[at], np.where(unlike | null, 0, -score), np.where(null, 2, ~unlike)))[:k]
                yield i, at[first], score[first], null[first]


def top_k_each(vectors: DataFrame, queries: DataFrame, k: int, id_col: str, vector_col: str, cosine: bool, digits: int | None, on: str | None, query_block: int, per_query: int) -> DataFrame:
    """The k first rows (the columns of vectors but for the vector, query_id, score) of each query in each share."""
    spark = vectors.sparkSession
    asked = queries.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("query")), F.lit(1)).alias("size")).first()
    rows = min(MOST_SHARE, max(LEAST_SHARE, SHARE_VALUES // max(1, asked["size"])))
    blocks = max(1, -(-asked["n"] // (query_block * per_query)))
    kept = [c for c in vectors.columns if c != vector_col]
    v, q = vectors.select(*kept, F.col(vector_col).alias("_vector")), queries.select("query_id", "query", *([on] if on else []))
    if on:
        # one row per value, such as the lists of an index
        shares = vectors.groupBy(F.col(on).alias("_on")).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("_shares"))
        v = v.join(F.broadcast(shares), F.col(on) == F.col("_on"))
        q = q.join(F.broadcast(shares.toDF("_list", "_shares")), F.col(on) == F.col("_list")).drop(on).withColumnRenamed("_list", "_on")
    else:
        shares = F.lit(max(1, -(-vectors.count() // rows)))
        v, q = (x.withColumns({"_on": F.lit(0), "_shares": shares}) for x in (v, q))
    v = v.withColumns({"_share": F.pmod(F.xxhash64(F.lit("share"), id_col), F.col("_shares")).cast("int"), "_block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))}).drop("_shares")
    q = q.withColumns({"_block": F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"), "_share": F.explode(F.sequence(F.lit(0), F.col("_shares") - 1))}).drop("_shares")
    out = StructType([q.schema["query_id"], *[v.schema[c] for c in kept], StructField("score", DoubleType())])
    arrow = to_arrow_schema(out)

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return arrow.empty_table()
        rank = np.empty(left.num_rows, np.int64)
        rank[pc.sort_indices(left.select([id_col]), sort_keys=[(id_col, "ascending")], null_placement="at_start").to_numpy()] = np.arange(left.num_rows)
        a, b = _Vectors(right["query"]), _Vectors(left["_vector"])
        asked_at, found_at, scores, nulls = [], [], [], []
        for size in np.unique(a.size):
            if size < 0:
                which, own, found = np.flatnonzero(a.size < 0), np.zeros(0, np.int64), []
            else:
                (which, mine), (own, theirs) = a.rows(size), b.rows(size)
                found = _best(mine, theirs, rank[own], k, cosine, digits) if len(own) else []
            other = np.setdiff1d(np.arange(left.num_rows), own)
            other = other[np.argsort(rank[other])][:k]
            filled = set()
            for i, at, score, null in found:
                filled.add(i)
                rest = other if null.any() or len(at) < k else other[:0]
                asked_at.append(np.full(len(at) + len(rest), which[i]))
                found_at += [own[at], rest]
                scores += [score, np.zeros(len(rest))]
                nulls += [null, np.ones(len(rest), bool)]
            for i in range(len(which)):
                if i not in filled:
                    asked_at.append(np.full(len(other), which[i]))
                    found_at.append(other)
                    scores.append(np.zeros(len(other)))
                    nulls.append(np.ones(len(other), bool))
        at = pa.array(np.concatenate(found_at))
        score = pa.array(np.concatenate(scores), mask=np.concatenate(nulls), from_pandas=False)
        columns = [right["query_id"].take(pa.array(np.concatenate(asked_at))), *[left[c].take(at) for c in kept], score]
        return pa.Table.from_arrays([pa.chunked_array(c.chunks if isinstance(c, pa.ChunkedArray) else [c]).cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    keys = ("_on", "_block", "_share")
    return v.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInArrow(nearest, out)
