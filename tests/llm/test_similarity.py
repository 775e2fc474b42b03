"""Jaccard components and repeated byte strings against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from docgrove.llm import jaccard as J
from docgrove.llm import shared, substrings, suffixes
from docgrove.llm.components import components


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def expected_components(rows):
    sets = {}
    for r in rows:
        if r[0] is not None:
            sets.setdefault(r[0], shingles(r[1]))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_components_match_all_pairs(docs, rows, empty):
    want = expected_components(rows)
    got = J.op5_query(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter((r[0], len(shingles(r[1])), want.get(r[0])) for r in rows)
    assert len({c for c in want.values()}) < len(want)
    assert J.op5_query(empty).count() == 0


def test_components_of_ids_of_the_full_range(spark):
    text = " ".join(f"w{i}" for i in range(60))
    ids = [(1 << 63) - 1, -(1 << 63), 1 << 62, -(1 << 62) - 5, 3]
    docs = spark.createDataFrame([(i, text if i != 3 else "other words", 5) for i in ids], "doc_id bigint, text string, dropped_id int")
    got = {r.doc_id: r.component_id for r in J.op5_query(docs).collect()}
    assert got == {i: (-(1 << 63) if i != 3 else 3) for i in ids}
    assert {r.doc_id for r in J.one_of_each(docs).collect()} == {-(1 << 63), 3}


def test_components_claim_no_count_of_links(docs):
    assert J.link_components(docs).columns == ["doc_id", "n_shingles", "component_id"]


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_one_of_each(docs, rows, broadcast, monkeypatch):
    monkeypatch.setattr(shared, "BROADCAST_IDS", broadcast)
    want = expected_components(rows)
    kept = J.one_of_each(docs)
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r[0] for r in rows if r[0] is None or want[r[0]] == r[0])
    assert kept.columns == docs.columns


@pytest.mark.parametrize("n", [3, 8, 20, 47, 48, 49, 63, 64, 65, 87, 88, 100, 157, 200, 400, 1000])
def test_linking_sets_share_more_signatures_than_they_may_pass_over(n):
    rng = np.random.default_rng(n)
    for _ in range(30):
        pool = rng.integers(1, 1 << 63, 3 * n, dtype=np.uint64)
        s = pool[:n]
        drop = int(rng.integers(0, n // 4 + 1))
        grow = int(rng.integers(0, max(1, (n - drop) * 4 // 3 - n + 1)))
        t = np.concatenate([s[drop:], pool[n : n + grow]])
        inter = n - drop
        if not J.links(inter, n, len(t)):
            continue
        a, b = (J.signatures(np.unique(x)) for x in (s, t))
        shared, free, enough = {}, {}, {}
        for parity in (0, 1):
            x = {int(v) for p, sig, _ in a if p == parity for v in sig}
            y = {int(v) for p, sig, _ in b if p == parity for v in sig}
            shared[parity] = len(x & y)
            may = [0 if k else J.allowance(len(z), J.k2_of(len(z), parity)) for z, f in ((s, a), (t, b)) for p, _, k in f if p == parity]
            free[parity] = max(may, default=0)
            enough[parity] = all(k or shared[parity] >= J.allowance(len(z), J.k2_of(len(z), parity)) + 2 for z, f in ((s, a), (t, b)) for p, _, k in f if p == parity)
        assert any(shared[p] > free[p] and enough[p] for p in (0, 1))


def test_bands_cover_every_linking_pair_of_sizes():
    for s in [*range(1, 400), 1000, 5000, 40000]:
        for t in {s, s + 1, 4 * s // 3}:
            if J.links(s, s, t):
                singles = t <= 4 * J.SINGLES_UPTO // 3
                assert singles or {b.number for b in J.bands_of(s)} & {b.number for b in J.bands_of(t)}


def test_chain_components(spark):
    rng = random.Random(3)
    order = list(range(60))
    rng.shuffle(order)
    links = spark.createDataFrame(list(zip(order, order[1:])) + [(100, 101), (7, 7)], "a bigint, b bigint")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(60)}, 100: 100, 101: 100}
    assert components(links.limit(0)).count() == 0


def expected_removal(rows):
    texts = {}
    for r in rows:
        if r[0] is not None:
            texts.setdefault(r[0], (r[1] or "").encode())
    first, out = {}, {}
    for i in sorted(texts):
        b = texts[i]
        cover = bytearray(len(b))
        for j in range(len(b) - 49):
            if first.get(b[j : j + 50], i) < i:
                cover[j : j + 50] = b"\1" * 50
        for j in range(len(b) - 49):
            first.setdefault(b[j : j + 50], i)
        kept = bytes(c for c, m in zip(b, cover) if not m)
        spans = sum(1 for k in range(len(b)) if cover[k] and not (k and cover[k - 1]))
        out[i] = (len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("frequent", [1 << 12, 3, 0])
def test_repeats_match_brute_force(docs, rows, frequent, monkeypatch):
    monkeypatch.setattr(substrings, "FREQUENT", frequent)
    want = expected_removal(rows)
    whole = lambda t: (len((t or "").encode()), 0, 0, hashlib.sha256((t or "").encode()).hexdigest())
    got = Counter(tuple(r) for r in substrings.op9_query(docs).collect())
    assert got == Counter((r[0], *(want[r[0]] if r[0] is not None else whole(r[1]))) for r in rows)
    assert any(w[1] for w in want.values())


def test_repeats_empty(empty):
    assert substrings.op9_query(empty).count() == 0


def test_suffix_order_is_sorted():
    rng = random.Random(5)
    for _ in range(300):
        t = np.array([rng.choice(b"aab\xff") for _ in range(rng.randint(0, 60))] + [255], np.uint8)
        raw = bytes(t)
        for depth in (5, 56):
            keys = [raw[i : i + depth] for i in suffixes.suffix_order(t, depth).tolist()]
            assert keys == sorted(keys) and len(keys) == len(t)
        assert suffixes.smaller_than_successor(t).tolist() == [raw[i:] < raw[i + 1 :] for i in range(len(t))]
