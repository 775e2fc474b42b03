"""Inverted lists: vectors by their nearest of a few centroids, so that a search reads the nearest lists only.

The centroids are fitted by k-means under cosine on a bounded sample; every vector is
assigned to one.  Zero vectors, which cosine cannot place, are in list -1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import search

#: Vectors that the centroids are fitted on, about; and queries on which the number of probes is chosen.
SAMPLE_ROWS, TUNING_QUERIES = 1 << 16, 200
MOST_LISTS = 4096
UNLISTED = -1
SEED = 7


def _features(vector: str, norm: str = "norm") -> Column:
    """The vector for the model; zero vectors are replaced, as their list is not the model's."""
    v = F.col(vector).cast("array<double>")
    return array_to_vector(F.when(F.col(norm) > 0, v).otherwise(F.transform(v, lambda _: F.lit(1.0))))


def fit(vectors: DataFrame, n_vectors: int, n_lists: int | None = None, vector: str = "values", sample_rows: int = SAMPLE_ROWS) -> KMeansModel:
    """Centroids of vectors (vector, norm); as many as the root of their number, if not told otherwise."""
    n_lists = min(MOST_LISTS, max(2, round(n_vectors**0.5) if n_lists is None else n_lists))
    sample = vectors.filter("norm > 0")
    sample = sample if n_vectors <= sample_rows else sample.sample(sample_rows / n_vectors, SEED)
    means = KMeans(k=n_lists, distanceMeasure="cosine", maxIter=10, seed=SEED, featuresCol="features", predictionCol="list")
    return means.fit(sample.select(_features(vector).alias("features")))


def load(path: str) -> KMeansModel:
    return KMeansModel.load(path)


def assign(rows: DataFrame, model: KMeansModel | None, vector: str) -> DataFrame:
    """rows (with norm) and their `list`."""
    if model is None:
        return rows.withColumn("list", F.lit(UNLISTED))
    placed = model.transform(rows.withColumn("features", _features(vector))).drop("features")
    return placed.withColumn("list", F.when(F.col("norm") > 0, F.col("list")).otherwise(UNLISTED))


def order(model: KMeansModel, queries: np.ndarray) -> np.ndarray:
    """Lists of each query, the nearest first."""
    centers = np.array(model.clusterCenters())
    centers = centers / np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-30)
    return np.argsort(-(queries @ centers.T), axis=1, kind="stable")


def probed(model: KMeansModel, query: Column, probes: int) -> Column:
    """The nearest lists of a column of queries, as an array."""
    held = [c.tolist() for c in model.clusterCenters()]

    @F.pandas_udf("array<int>")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        centers = np.array(held)
        centers = centers / np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-30)
        for q in batches:
            ranked = np.argsort(-(np.stack(q.to_numpy()).astype(float) @ centers.T), axis=1, kind="stable") if len(q) else []
            yield pd.Series([[*r[:probes].tolist(), UNLISTED] for r in ranked])

    return nearest(query)


def tune(rows: DataFrame, model: KMeansModel, n_vectors: int, recall: float, k: int, id_col: str = "id", vector: str = "values") -> int:
    """The least number of probes with which the lists of rows (id, vector, list) hold `recall` of the true k nearest.

    Measured on TUNING_QUERIES of the vectors themselves, a documented sample, against
    an exact search of all rows.
    """
    asked = rows.filter("norm > 0").orderBy(F.xxhash64(id_col)).limit(TUNING_QUERIES).select(F.col(id_col).alias("query_id"), F.col(vector).alias("query"))
    queries = {r["query_id"]: r["query"] for r in asked.collect()}  # TUNING_QUERIES rows
    if not queries:
        return 1
    ranked = dict(zip(queries, np.argsort(order(model, np.array(list(queries.values()), float)), axis=1)))
    exact = search.top_k_each(rows.select(id_col, vector, "list"), rows.sparkSession.createDataFrame(list(queries.items()), asked.schema), k, id_col, vector).select("query_id", "list").collect()
    needed = np.sort([0 if r["list"] == UNLISTED else ranked[r["query_id"]][r["list"]] + 1 for r in exact])
    return max(1, int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]))
