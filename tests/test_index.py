"""Upserts of a part, versions, two writers, compaction, and inverted lists."""

import os
import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from docgrove.functions.vectors import HashingEmbedder
from docgrove.model import RECORD_METADATA
from docgrove.plans.engine import Engine
from docgrove.plans.index import METADATA, VectorIndex
from docgrove.sources.files import Source

LOREM = "Words about nothing in particular fill this paragraph so that it is long enough. " * 4
DIMENSION = 8


def records(spark, rows):
    """Records of (id, text); the vector follows from the text's length."""
    blank = dict.fromkeys(RECORD_METADATA)
    return spark.createDataFrame([(i, [float(len(x)), 1.0] + [0.0] * 6, blank | {"content": x}) for i, x in rows], f"id string, values array<float>, metadata {METADATA}")


def contents(index, namespace=None):
    return {r.id: (r.source, r.content) for r in index.read(namespace).select("id", "source", "metadata.content").collect()}


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if not f.endswith(".crc"))


def test_an_upsert_writes_its_own_part(spark, tmp_path):
    rng = random.Random(1)
    text = lambda: "".join(rng.choice("abcdefghij ") for _ in range(400))
    index = VectorIndex(spark, str(tmp_path / "i"), DIMENSION)
    index.upsert(records(spark, [(f"d{k}", text()) for k in range(3000)]).coalesce(2), "one")
    whole = size(tmp_path / "i")
    index.upsert(records(spark, [(f"d{k}", "changed") for k in range(30)]).coalesce(1), "one")
    assert size(tmp_path / "i") - whole < 0.03 * whole
    assert index.stats()["vectorCount"] == 3000 and sum(c == "changed" for _, c in contents(index).values()) == 30
    before = contents(index)
    assert index.compact() and contents(index) == before and len(index.manifest().segments) == 1


def test_replaced_sources_namespaces_and_clear(spark, tmp_path):
    index = VectorIndex(spark, str(tmp_path / "i"), DIMENSION)
    with pytest.raises(ValueError, match="no index"):
        index.read()
    index.upsert(records(spark, [("a", "x"), ("b", "y")]), "one")
    index.upsert(records(spark, [("a", "other space")]), "one", namespace="n")
    index.upsert(records(spark, [("c", "z")]), "two")
    index.upsert(records(spark, [("b", "new")]), "one", replace_source=True)
    assert contents(index, "") == {"b": ("one", "new"), "c": ("two", "z")}
    assert contents(index, "n") == {"a": ("one", "other space")}
    index.upsert(records(spark, []), "two", replace_source=True)
    assert contents(index, "") == {"b": ("one", "new")}
    assert index.compact() and contents(index, "n") == {"a": ("one", "other space")}
    index.clear()
    assert contents(index) == {} and index.stats() == {"vectorCount": 0, "dimension": DIMENSION}


def test_many_upserts_are_compacted_and_old_files_go(spark, tmp_path):
    index = VectorIndex(spark, str(tmp_path / "i"), DIMENSION)
    index.MOST_SEGMENTS = 3
    for k in range(7):
        index.upsert(records(spark, [(f"d{k}", f"v{k}"), ("all", f"v{k}")]), "one")
    assert {i: c for i, (_, c) in contents(index).items()} == {f"d{k}": f"v{k}" for k in range(7)} | {"all": "v6"}
    assert len(index.manifest().segments) <= 3 and len(index.versions()) == VectorIndex.KEPT
    kept = set().union(*(type(index.manifest()).of(0, index.store.read(f"log/{n}")).files() for n in index.versions()))
    there = {f"{d}/{x}" for d in ("data", "gone") if (tmp_path / "i" / d).exists() for x in os.listdir(tmp_path / "i" / d)}
    assert there == {x for x in kept if not x.startswith("centroids")}


def test_two_writers_both_land(spark, tmp_path):
    path = str(tmp_path / "i")
    VectorIndex(spark, path, DIMENSION).upsert(records(spark, [(f"d{k}", "old") for k in range(20)]), "base")
    errors = []

    def write(name, rows):
        try:
            VectorIndex(spark, path, DIMENSION).upsert(records(spark, rows), name)
        except Exception as e:  # shown by the assertion below
            errors.append(e)

    jobs = [threading.Thread(target=write, args=(f"w{n}", [(f"d{n}", "new"), ("both", f"of w{n}"), (f"own{n}", "x")])) for n in range(3)]
    for j in jobs:
        j.start()
    for j in jobs:
        j.join()
    assert not errors
    found = contents(VectorIndex(spark, path, DIMENSION))
    assert len(found) == 24 and all(found[f"d{n}"] == (f"w{n}", "new") and f"own{n}" in found for n in range(3))
    assert found["both"][1].startswith("of w")


def test_an_upsert_that_finds_its_number_taken_tries_the_next(spark, tmp_path):
    index = VectorIndex(spark, str(tmp_path / "i"), DIMENSION)
    index.upsert(records(spark, [("a", "old"), ("b", "old"), *((f"d{k}", "") for k in range(20))]), "one")
    other = VectorIndex(spark, str(tmp_path / "i"), DIMENSION)
    put, raced = index._put, []

    def late(m):
        if not raced:
            raced.append(other.upsert(records(spark, [("a", "between"), ("c", "between")]), "two"))
        return put(m)

    index._put = late
    index.upsert(records(spark, [("a", "last")]), "one")
    assert {k: v for k, v in contents(index).items() if k < "d"} == {"a": ("one", "last"), "b": ("one", "old"), "c": ("two", "between")}
    # a deletion that lands while a compaction writes
    index._put, raced[:] = late, []
    other.upsert = lambda *_: VectorIndex.upsert(other, records(spark, [("b", "during")]), "two")
    assert index.compact() and contents(index)["b"] == ("two", "during") and len(contents(index)) == 23


def test_put_new_happens_once(spark, tmp_path):
    index = VectorIndex(spark, str(tmp_path / "i"), DIMENSION)
    assert index.store.put_new("log/x", "one") and not index.store.put_new("log/x", "two")
    assert index.store.read("log/x") == "one" and index.store.names("log") == ["x"]


def test_the_later_source_and_chunk_win(spark, tmp_path):
    index = VectorIndex(spark, str(tmp_path / "i"), DIMENSION)
    rows = records(spark, [("x", "from zeta"), ("x", "from alpha"), ("y", "first file"), ("y", "second file"), ("z", "chunk 1"), ("z", "chunk 0"), ("u", "alone")])
    place = F.create_map(*[F.lit(v) for pair in {"from zeta": "0 a 0", "from alpha": "1 a 0", "first file": "0 a 9", "second file": "0 b 0", "chunk 1": "0 a 1", "chunk 0": "0 a 0", "alone": "0 a 0"}.items() for v in pair])
    named = F.split(place[F.col("metadata.content")], " ")
    rows = rows.withColumn("source_ord", F.struct(named[0].cast("int"), named[1], named[2].cast("int"))).withColumn("source", F.when(F.col("metadata.content") == "from zeta", "zeta").otherwise("alpha"))
    index.replace(rows, ["zeta", "alpha"])
    assert {k: c for k, (_, c) in contents(index).items()} == {"x": "from alpha", "y": "second file", "z": "chunk 1", "u": "alone"}


def test_records_of_replaced_files_go(spark, tmp_path):
    index = VectorIndex(spark, str(tmp_path / "i"), DIMENSION)
    of = lambda rows, file: records(spark, rows).withColumns({"source": F.lit("s"), "file": F.lit(file)})
    index.replace(of([("a0", "x"), ("a1", "y"), ("a2", "z")], "a.md").unionByName(of([("b0", "b")], "b.md")), [])
    files = lambda *names: spark.createDataFrame([("s", n) for n in names], "source string, file string")
    index.replace(of([("a0", "shorter")], "a.md"), [], files=files("a.md"))
    assert {k: c for k, (_, c) in contents(index).items()} == {"a0": "shorter", "b0": "b"}
    index.replace(of([], "b.md"), [], files=files("b.md", "new.md"))
    assert {k: c for k, (_, c) in contents(index).items()} == {"a0": "shorter"}
    assert index.compact() and index.stats()["vectorCount"] == 1


def test_reindex_lets_the_later_source_overwrite(spark, tmp_path):
    for name in ("zeta", "alpha"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.md").write_text(f"# A\n\nfrom {name}. {LOREM}")
    sources = [Source(n, path=str(tmp_path / n), display_name="Docs") for n in ("zeta", "alpha")]
    for order, winner in ((sources, "alpha"), (sources[::-1], "zeta")):
        engine = Engine(spark, str(tmp_path / f"i-{winner}"), HashingEmbedder(DIMENSION))
        engine.reindex(order)
        assert [(s, c.split("from ")[1].split(".")[0]) for s, c in contents(engine.index).values()] == [(winner, winner)]


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(24, DIMENSION))
    v = np.repeat(centers, 120, axis=0) + rng.normal(scale=0.15, size=(2880, DIMENSION))
    rows = [(f"v{k}", x.tolist(), dict.fromkeys(RECORD_METADATA)) for k, x in enumerate(v)] + [("zero", [0.0] * DIMENSION, dict.fromkeys(RECORD_METADATA))]
    index = VectorIndex(spark, str(tmp_path_factory.mktemp("lists") / "i"), DIMENSION)
    index.upsert(spark.createDataFrame(rows, f"id string, values array<float>, metadata {METADATA}"), "one")
    return index, index.fit_lists(24)


def test_lists_reach_their_recall_and_prune(spark, clustered):
    index, probes = clustered
    assert 1 <= probes <= 6
    asked = index.read().filter("id like '%00'").selectExpr("id query_id", "values query")
    exact = {(r.query_id, r.id) for r in index.top_k_each(asked, 10, probes=0).collect()}
    found = {(r.query_id, r.id) for r in index.top_k_each(asked, 10).collect()}
    assert len(exact) == 10 * asked.count() and len(exact & found) >= 0.9 * len(exact)
    query = asked.first().query
    near = index.candidates(query)
    plan = near._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "list" in plan.split("PartitionFilters")[1][:120]
    assert near.count() < 0.5 * index.stats()["vectorCount"] and index.candidates(query, probes=0).count() == 2881


def test_lists_take_later_upserts(spark, clustered):
    index, _ = clustered
    one = index.read().filter("id = 'v5'").first()
    index.upsert(spark.createDataFrame([("new", one["values"], dict.fromkeys(RECORD_METADATA)), ("v7", [0.0] * DIMENSION, dict.fromkeys(RECORD_METADATA))], f"id string, values array<float>, metadata {METADATA}"), "two")
    best = index.top_k_each(spark.createDataFrame([(1, one["values"])], "query_id int, query array<float>"), 2).collect()
    assert {r.id for r in best} == {"v5", "new"} and index.stats()["vectorCount"] == 2882
    assert index.compact() and index.manifest().centroids and index.candidates(one["values"]).filter("id = 'new'").count() == 1


def test_upserts_and_new_lists_that_meet(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = lambda name, n: spark.createDataFrame([(f"{name}{k}", rng.normal(size=DIMENSION).tolist(), dict.fromkeys(RECORD_METADATA)) for k in range(n)], f"id string, values array<float>, metadata {METADATA}")
    index, other = (VectorIndex(spark, str(tmp_path / "i"), DIMENSION) for _ in range(2))
    index.upsert(rows("a", 60), "one")
    put, raced = index._put, []

    def late(m):
        if not raced:
            raced.append(1)
            other.fit_lists(4) if len(index.manifest().segments) == 1 and not index.manifest().centroids else other.upsert(rows("c", 9), "three")
        return put(m)

    index._put = late
    index.upsert(rows("b", 20), "two")  # lists come while it writes
    raced.clear()
    index.fit_lists(3)  # an upsert comes while it writes
    m = index.manifest()
    lists = {r.list for r in index._live(m).select("list").distinct().collect()}
    assert index.stats()["vectorCount"] == 89 and m.centroids and lists <= {0, 1, 2}
    one = index.read().filter("id = 'c0'").first()["values"]
    assert index.candidates(one, probes=1).filter("id = 'c0'").count() == 1
