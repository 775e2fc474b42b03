"""BM25 over an inverted index, fusion of ranked lists, and hybrid searches."""

import math
import random
import re
from collections import Counter

from pyspark.sql import Window
from pyspark.sql import functions as F

from docgrove.functions.vectors import HashingEmbedder
from docgrove.plans import terms as terms_module
from docgrove.plans.engine import Engine
from docgrove.plans.terms import BUCKETS, TermIndex, fuse, query_terms, terms_of
from docgrove.sources.files import Source

LOREM = "Words about nothing in particular fill this paragraph so that it is long enough. " * 4


def words(text):
    return re.findall("[a-z0-9_]+", (text or "").lower())


def bm25(texts, query, key):
    n, mean = len(texts), sum(len(words(t)) for t in texts.values()) / len(texts)
    tf, total = Counter(words(texts[key])), 0.0
    for w in sorted(set(words(query))):
        df = sum(w in words(t) for t in texts.values())
        if tf[w]:
            total += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(words(texts[key])) / mean))
    return total


def corpus():
    rng = random.Random(2)
    texts = {f"d{k}": " ".join(rng.choice(["The", "cat", "Dog", "runs", f"w{rng.randrange(30)}"]) for _ in range(rng.randrange(1, 40))) for k in range(60)}
    return texts | {"null": None, "empty": "  ", "é": "été, cat"}


def test_bm25_equals_its_formula(spark, tmp_path):
    texts = corpus()
    index = TermIndex(spark, str(tmp_path / "t")).build(spark.createDataFrame(list(texts.items()), "id string, content string"))
    assert index.totals()[0] == len(texts)
    for query in ("the cat", "w3 DOG w3", "nothing of this", ""):
        got = [(r.id, r.bm25, r["rank"]) for r in index.top_k(query, 10).collect()]
        scores = {k: bm25(texts, query, k) for k in texts}
        expected = sorted(((round(-s, 6), k) for k, s in scores.items() if s > 0))[:10]
        assert [(round(-s, 6), i) for i, s, _ in got] == expected and [r for *_, r in got] == list(range(1, len(got) + 1))
    asked = spark.createDataFrame([(1, "the cat"), (2, "dog"), (3, None)], "query_id int, query string")
    each = index.top_k_each(asked, 4).collect()
    assert sorted((r["rank"], r.id) for r in each if r.query_id == 1) == [(r["rank"], r.id) for r in index.top_k("the cat", 4).collect()]
    assert {r.query_id for r in each} == {1, 2}
    # as a reranker it gives the same scores
    score = index.scorer()
    rows = spark.createDataFrame(list(texts.items()), "id string, content string").withColumn("s", score(F.col("content"), "the w3 cat"))
    assert all(abs(r.s - bm25(texts, "the w3 cat", r.id)) < 1e-9 for r in rows.collect())


def test_a_query_reads_its_own_buckets(spark, tmp_path):
    index = TermIndex(spark, str(tmp_path / "t")).build(spark.createDataFrame(list(corpus().items()), "id string, content string"))
    found = index.postings(query_terms("The cat"))
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:80]
    assert {r.term for r in found.collect()} == {"the", "cat"} and BUCKETS > 2
    none = TermIndex(spark, str(tmp_path / "none")).build(spark.createDataFrame([], "id string, content string"))
    assert none.totals()[0] == 0 and none.top_k("cat", 3).count() == 0


def test_fusion(spark):
    one = spark.createDataFrame([("a", 1), ("b", 2), ("c", 40)], "id string, rank int")
    two = spark.createDataFrame([("b", 1), ("d", 2)], "id string, rank int")
    assert [r.id for r in fuse(10, one, two).orderBy("rank").collect()] == ["b", "a", "d"]
    assert [r.id for r in fuse(1, one, two).collect()] == ["b"]


def test_hybrid_search_finds_rare_words(spark, tmp_path):
    for k in range(12):
        (tmp_path / f"p{k}.md").write_text(f"# Page {k}\n\n{LOREM}" + ("The zyx protocol is set here." if k == 7 else "More words."))
    engine = Engine(spark, str(tmp_path / "index"), HashingEmbedder(16))
    engine.reindex([Source("docs", path=str(tmp_path))])
    engine.index_terms()
    best = engine.search_hybrid("zyx", 3).orderBy("rank").collect()
    assert "zyx" in best[0].content and len(best) == 3


def test_queries_meet_shares_of_the_documents(spark, tmp_path, monkeypatch):
    words = "red blue green sun moon star tree leaf".split()
    docs = spark.createDataFrame([(i, " ".join(words[(i * j) % 8] for j in range(1, 2 + i % 9))) for i in range(200)], "id bigint, content string")
    index = TermIndex(spark, str(tmp_path / "t")).build(docs)
    asked = spark.createDataFrame([(1, "red leaf"), (2, "moon moon sun none"), (None, "tree"), (4, "none"), (5, None), (6, "star blue green red sun")], "query_id int, query string")
    terms = asked.select("query_id", F.explode(F.array_distinct(terms_of(F.col("query")))).alias("term"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("bm25").desc(), "id"))
    want = index._scored(index.postings().join(terms, "term"), "query_id").withColumn("rank", rank).filter("rank <= 7")
    monkeypatch.setattr(terms_module, "SHARE_DOCUMENTS", 30)
    monkeypatch.setattr(terms_module, "BLOCK_QUERIES", 2)
    key = lambda df: sorted(repr((r.query_id, r["rank"], r.id, r.bm25)) for r in df.collect())
    found = index.top_k_each(asked, 7)
    assert key(found) == key(want) and "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().toString()
