"""Greedy runs, whole and in stretches, and the two-level outline of long documents."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docgrove.operators import runs
from docgrove.operators.outline import line_sections, section_tree


def greedy(sizes, limit):
    out, batch, total = [], -1, None
    for n in sizes:
        if total is None or total + n > limit:
            batch, total = batch + 1, n
        else:
            total += n
        out.append(batch)
    return out


def test_stretches_follow_each_other():
    rng = random.Random(1)
    for _ in range(1500):
        limit, n = rng.choice([0, 1, 5, 20, 100]), rng.randrange(1, 40)
        sizes = np.array([rng.choice([0, 0, 1, 2, 3, 7, rng.randrange(limit + 5)]) for _ in range(n)], np.int64)
        cuts = sorted({0, n, *(rng.randrange(n) for _ in range(rng.randrange(5)))})
        got, carry, count = [], None, 0
        for a, b in zip(cuts, cuts[1:]):
            got += (runs.number(sizes[a:b], carry, limit) + max(count - 1, 0)).tolist()
            _, total, reach, leaves, more = runs.summary(sizes[a:b], limit)
            which = 0 if carry is None else int(np.searchsorted(-np.array(reach), -carry, "right"))
            carry, count = (leaves[which], count + more[which]) if which < len(reach) else (carry + total, count)
        assert got == greedy(sizes.tolist(), limit)


@pytest.mark.parametrize("limit", [1000, 7])
def test_one_key_of_many_items(spark, limit):
    n = 300_000
    items = spark.range(n).select(F.lit("k").alias("key"), F.col("id").alias("at"), F.pmod(F.xxhash64("id"), F.lit(60)).alias("size"))
    got = runs.pack_runs(items, "key", "at", "size", limit).select("at", "size", "batch").toPandas().sort_values("at")
    assert got["batch"].tolist() == greedy(got["size"].tolist(), limit) and len(got) == n


def test_keys_nulls_and_nothing(spark):
    rows = [(k, i, None if i % 5 == 0 else i % 4) for k in ("a", "b", None) for i in range(30)] + [("one", 1, 99), ("zero", 0, -3)]
    items = spark.createDataFrame(rows, "key string, ord int, size int")
    got = {}
    for r in runs.pack_runs(items, "key", "ord", "size", 6).collect():
        got.setdefault(r.key, []).append((r.ord, r.batch))
    for key in ("a", "b", None, "one", "zero"):
        sizes = [max(s or 0, 0) for k, _, s in rows if k == key]
        assert [b for _, b in sorted(got[key])] == greedy(sizes, 6)
    assert runs.pack_runs(items.limit(0), "key", "ord", "size", 6).count() == 0


def test_small_segments_give_the_same_tree(spark):
    rng = random.Random(4)
    texts = [(i if i else None, "\n".join(rng.choice(["#" * rng.randint(1, 6) + f" h{rng.randrange(9)}", "text " * rng.randrange(9), ""]) for _ in range(rng.randrange(200)))) for i in range(12)]
    docs = spark.createDataFrame(texts, "doc_id int, text string")
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(section_tree(docs, segment=3)) == rows(section_tree(docs))


def test_a_document_of_many_lines_is_no_task(spark):
    lines = spark.range(40_000).select(F.lit(1).alias("doc_id"), (F.col("id") * 10).alias("line_no"), F.when(F.col("id") % 100 == 0, F.concat(F.lit("## s"), F.col("id"))).when(F.col("id") == 1, F.lit("### t")).otherwise(F.lit("x")).alias("line"))
    found = line_sections(lines, segment=1000)
    assert found.count() == 401
    first = {r.heading: r for r in found.filter("section_id <= 3").collect()}
    assert (first["s0"].subtree_size, first["t"].parent_id, first["s100"].parent_id, first["s100"].subtree_size) == (195, 1, None, 197)


def test_pieces_of_a_stretch_give_the_whole(monkeypatch):
    """Joined summaries act like the one of the whole, and numbers by pieces are those of the whole."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        limit, n = int(rng.integers(1, 40)), int(rng.integers(1, 60))
        sizes = rng.integers(0, int(rng.choice([2, 8, 50])), n)
        cuts = [0, *sorted(set(rng.integers(1, n + 1, 4).tolist()) - {n}), n]
        parts = [sizes[a:b] for a, b in zip(cuts, cuts[1:])]
        whole, found = runs.summary(sizes, limit), runs.summary(parts[0], limit)
        for p in parts[1:]:
            found = runs.together(found, runs.summary(p, limit))

        def act(s, c):
            which = 0 if c is None else next((i for i, r in enumerate(s[2]) if r < c), len(s[2]))
            return (int(s[3][which]), int(s[4][which])) if which < len(s[2]) else (c + s[1], 0)

        for c in [None, *range(limit + 12)]:
            assert found[:2] == whole[:2] and act(found, c) == act(whole, c)
            carry, first, got = c, 0, []
            for p in parts:
                numbers, carry = runs.number_on(p, carry, limit)
                got += (numbers + first).tolist()
                first += int(numbers[-1])
            assert got == runs.number(sizes, c, limit).tolist()
    monkeypatch.setattr(runs, "PIECE", 3)
    batch = pa.RecordBatch.from_pydict({"k": [1] * 7 + [2]})
    assert [(new, b.num_rows) for new, b in runs._pieces([batch, batch], 1)] == [(True, 3), (False, 3), (False, 1), (True, 1), (True, 3), (False, 3), (False, 1), (True, 1)]
