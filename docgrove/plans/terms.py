"""An inverted index of terms: document frequencies, lengths and BM25 over all documents.

Postings (term, id, tf, length, df) are stored by a bucket of the term's hash, a partition
column, so a query reads the buckets of its own terms.  BM25 serves as a first stage
beside the vectors (the two lists are fused by rank) and as a reranker of a pool, which
then weighs words by how rare they are in the whole corpus.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from .nearest import rounded

K1, B = 1.2, 0.75
BUCKETS = 64
#: Documents and postings of a share at most, about; queries of a block; terms that are broadcast.
SHARE_DOCUMENTS, SHARE_POSTINGS, BLOCK_QUERIES, BROADCAST_TERMS = 1 << 13, 1 << 21, 1 << 16, 1 << 20
#: Constant of reciprocal rank fusion, and the ranks of each list that enter it.
FUSION, FUSED_RANKS = 60, 30
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms_of(text: Column) -> Column:
    """The words of a text in order: ASCII letters, in lower case, digits and underscores; null has none."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), r"[^a-z0-9_]+"), lambda w: w != "")


def query_terms(text: str) -> list[str]:
    return sorted({w for w in re.split(r"[^a-z0-9_]+", text.translate(str.maketrans(_UPPER, _LOWER))) if w})


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def idf(n: Column | float, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1.0)


def weight(tf: Column, length: Column, mean: Column | float) -> Column:
    return tf * (K1 + 1) / (tf + (length / mean * B + (1 - B)) * K1)


def _coded(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Codes of a column's values, and the values."""
    coded = pc.dictionary_encode(column, null_encoding="encode").combine_chunks()
    coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
    return coded.indices.to_numpy(), coded.dictionary


def _best_of_share(postings: pa.Table, asked: pa.Table, k: int, schema: pa.Schema) -> pa.Table:
    """The k best documents of a share (query_id, id, bm25) for each query: postings (term, id, part), asked (query_id, term)."""
    (doc, ids), (term, terms) = _coded(postings["id"]), _coded(postings["term"])
    place = np.empty(len(ids), np.int64)
    place[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    by_term = np.argsort(term, kind="stable")
    doc, part = doc[by_term], postings["part"].to_numpy()[by_term]
    first = np.searchsorted(term[by_term], np.arange(len(terms) + 1))
    query, names = _coded(asked["query_id"])
    wanted = pc.fill_null(pc.index_in(asked["term"], value_set=terms), -1).to_numpy()
    query, wanted = query[wanted >= 0], wanted[wanted >= 0]
    by_query = np.lexsort((wanted, query))
    query, wanted = query[by_query], wanted[by_query]
    edges = np.searchsorted(query, np.arange(len(names) + 1))
    found: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
    for q in np.flatnonzero(np.diff(edges)):
        score = np.zeros(len(ids))
        for t in wanted[edges[q] : edges[q + 1]]:
            score[doc[first[t] : first[t + 1]]] += part[first[t] : first[t + 1]]
        at = np.flatnonzero(score)
        if len(at) > k:
            # what may be as good as the k-th once scores are rounded
            at = at[score[at] >= np.partition(score[at], len(at) - k)[len(at) - k] - 1e-8]
        # rounded, so that the order of a sum decides no tie
        score = rounded(score[at], 9)
        top = np.lexsort((place[at], -score))[:k]
        for into, x in zip(found, (np.full(len(top), q), at[top], score[top])):
            into.append(x)
    q, at, score = (np.concatenate(x) for x in found)
    return pa.Table.from_arrays([names.take(pa.array(q)), ids.take(pa.array(at)), pa.array(score)], schema=schema)


class TermIndex:
    """The index under `path`: postings, and the numbers of documents and words."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, documents: DataFrame, id_col: str = "id", text_col: str = "content") -> TermIndex:
        """Indexes every row of documents; equal ids are one document, whose texts follow each other."""
        words = documents.select(F.col(id_col).alias("id"), F.explode_outer(terms_of(F.col(text_col))).alias("term"))
        words.groupBy("id", "term").agg(F.count("term").alias("tf")).write.mode("overwrite").parquet(f"{self.path}/counts")
        counts = self.spark.read.parquet(f"{self.path}/counts")
        length = counts.groupBy("id").agg(F.sum("tf").alias("length"))
        length.write.mode("overwrite").parquet(f"{self.path}/lengths")
        length = self.spark.read.parquet(f"{self.path}/lengths")
        held = counts.filter("term is not null")
        frequency = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        postings = held.join(length, "id").join(frequency, "term").withColumn("bucket", _bucket(F.col("term")))
        # a word of every document makes a bucket of many tasks
        postings.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings")
        totals = length.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("mean"))
        totals.coalesce(1).write.mode("overwrite").json(f"{self.path}/totals")
        return self

    def totals(self) -> tuple[int, float]:
        """(documents, mean words)."""
        r = self.spark.read.schema("n bigint, mean double").json(f"{self.path}/totals").first()
        return r["n"], r["mean"] or 1.0

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """(term, id, tf, length, df), of all terms or from the buckets of those given."""
        kind = self.spark.read.parquet(f"{self.path}/lengths").schema["id"].dataType.simpleString()
        found = self.spark.read.schema(f"id {kind}, term string, tf bigint, length bigint, df bigint, bucket int").parquet(f"{self.path}/postings")
        if terms is not None:
            wanted = self.spark.createDataFrame([(t,) for t in terms], "term string")
            buckets = [r[0] for r in wanted.select(_bucket(F.col("term"))).distinct().collect()]  # a query's terms
            found = found.filter(F.col("bucket").isin(buckets) & F.col("term").isin(terms))
        return found.select("term", "id", "tf", "length", "df")

    def _scored(self, hits: DataFrame, *by: str) -> DataFrame:
        n, mean = self.totals()
        # rounded, so that the order of a sum decides no tie
        return hits.groupBy(*by, "id").agg(F.round(F.sum(idf(F.lit(float(n)), F.col("df")) * weight(F.col("tf"), F.col("length"), F.lit(mean))), 9).alias("bm25"))

    def top_k(self, query: str, k: int) -> DataFrame:
        """The k best documents (id, bm25, rank) for a query; ties by id.  Only documents with one of its terms come up."""
        best = self._scored(self.postings(query_terms(query))).orderBy(F.col("bm25").desc(), "id").limit(k)
        return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("bm25").desc(), "id")))

    def top_k_each(self, queries: DataFrame, k: int) -> DataFrame:
        """The k best documents (query_id, id, bm25, rank) for each row of queries (query_id, query).

        Queries meet shares of the documents, whose postings are summed in one array a
        query; a share passes on k documents per query.
        """
        n, mean = self.totals()
        asked = queries.select("query_id", F.explode(F.array_distinct(terms_of(F.col("query")))).alias("term"))
        terms = asked.select("term").distinct()
        held, rows = self.postings(), self.postings().count()
        few = terms.count() <= BROADCAST_TERMS
        held = held.join(F.broadcast(terms) if few else terms, "term", "left_semi")
        shares = max(1, -(-n // SHARE_DOCUMENTS), -(-rows // SHARE_POSTINGS))
        blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
        share = lambda c: F.pmod(F.xxhash64(F.lit("share"), c), F.lit(shares)).cast("int")
        held = held.select("term", "id", (idf(F.lit(float(n)), F.col("df")) * weight(F.col("tf"), F.col("length"), F.lit(mean))).alias("part"), share("id").alias("share"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        asked = asked.select("query_id", "term", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"))
        out = StructType([asked.schema["query_id"], held.schema["id"], StructField("bm25", DoubleType())])
        arrow = to_arrow_schema(out)

        def best(left: pa.Table, right: pa.Table) -> pa.Table:
            return _best_of_share(left, right, k, arrow) if left.num_rows and right.num_rows else arrow.empty_table()

        keys = ("block", "share")
        found = held.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(best, out)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("bm25").desc(), "id"))
        return found.withColumn("rank", rank).filter(F.col("rank") <= k)

    def scorer(self) -> Callable[[Column, str], Column]:
        """A reranker for ``search.search``: BM25 of a pool's texts by the statistics of the whole corpus."""
        n, mean = self.totals()

        def score(text: Column, query: str) -> Column:
            terms = query_terms(query)
            df = {r["term"]: r["df"] for r in self.postings(terms).select("term", "df").distinct().collect()}  # a query's terms
            words = terms_of(text)
            total = F.lit(0.0)
            for t in terms:
                tf = (F.size(words) - F.size(F.array_remove(words, t))).cast("double")
                total += F.lit(math.log(1 + (n - df.get(t, 0) + 0.5) / (df.get(t, 0) + 0.5))) * weight(tf, F.size(words).cast("double"), F.lit(mean))
            return total

        return score


def fuse(k: int, *ranked: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The k best (by, id, fused, rank) of ranked lists (by, id, rank): sums of 1 / (FUSION + rank); ties by id."""
    all_ranks = None
    for df in ranked:
        part = df.filter(F.col("rank") <= FUSED_RANKS).select(*by, "id", (F.lit(1.0) / (F.col("rank") + FUSION)).alias("share"))
        all_ranks = part if all_ranks is None else all_ranks.unionByName(part)
    fused = all_ranks.groupBy(*by, "id").agg(F.round(F.sum("share"), 9).alias("fused"))
    order = [F.col("fused").desc(), F.col("id")]
    if by:
        return fused.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)
    return fused.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


