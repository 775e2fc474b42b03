"""Nearest rows by products of matrices against the Column expressions."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from docgrove.functions.vectors import cosine, dot
from docgrove.plans import nearest, search


def plain(vectors, queries, k, score):
    scored = vectors.join(queries).withColumn("score", score)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


@pytest.mark.parametrize("kind", ["cosine", "dot"])
def test_scores_ties_and_odd_vectors(spark, monkeypatch, kind):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 8)).round(2)
    rows = [(f"v{i}", base[i % 60].tolist()) for i in range(150)]
    nan, inf = float("nan"), float("inf")
    rows += [("zero", [0.0] * 8), ("none", None), ("gap", [1.0, None] + [0.5] * 6), ("short", [1.0] * 7), ("empty", []), ("nan", [nan] * 8), ("inf", [inf] + [1.0] * 7), (None, base[3].tolist()), ("huge", [1e200] * 8), ("half", [0.0000000005] + [0.0] * 7)]
    v = spark.createDataFrame(rows, "id string, values array<double>")
    asked = [(i, base[i].tolist()) for i in range(20)] + [(90, [0.0] * 8), (91, None), (92, [1.0] * 7), (93, [nan] * 8), (94, [1.0] + [0.0] * 7), (95, [])]
    q = spark.createDataFrame(asked, "query_id int, query array<double>")
    monkeypatch.setattr(nearest, "LEAST_SHARE", 40)
    monkeypatch.setattr(nearest, "SHARE_VALUES", 64)
    monkeypatch.setattr(nearest, "SCORES", 100)
    monkeypatch.setattr(search, "QUERY_BLOCK", 7)
    want = plain(v, q, 6, cosine("values", "query") if kind == "cosine" else F.round(dot("values", "query"), 9))
    found = search.top_k_each(v, q, 6, score=kind, digits=None if kind == "cosine" else 9)
    key = lambda df: sorted((r.query_id, r["rank"], str(r.id), str(r.score)) for r in df.collect())
    assert key(found) == key(want)


def test_no_row_takes_the_vectors_of_another_list(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0], i % 3) for i in range(30)], "id int, values array<float>, list int")
    q = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 2), (2, [1.0, 0.0], 1), (3, [1.0, 0.0], 9)], "query_id int, query array<float>, list int")
    found = {(r.query_id, r["rank"], r.id) for r in search.top_k_each(v, q, 2, score="dot", on="list", per_query=2).collect()}
    assert found == {(1, 1, 29), (1, 2, 27), (2, 1, 28), (2, 2, 25)}


def test_rounding_is_that_of_spark(spark):
    x = np.array([0.0000000005, 0.1234567885, -0.1234567885, 2.5e-9, 1.0000000015, 123456.7890123455, 5e6, -3.0, 0.0, 7.1e-10, 1e300])
    want = [r[0] for r in spark.createDataFrame([(i, float(a)) for i, a in enumerate(x)], "i int, x double").orderBy("i").select(F.round("x", 9)).collect()]
    assert nearest.rounded(x, 9).tolist() == want
