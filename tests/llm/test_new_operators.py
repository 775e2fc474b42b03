"""Hard negatives, conversation repair and best-two-fit packing against brute force."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from docgrove.llm import best_fit, conversations, hard_negatives
from docgrove.llm import textkernel as tk

WHITE = " \t\n\x0b\x0c\r"


# --- conversations ------------------------------------------------------------------

TURNS = "conv_id bigint, turn bigint, role string, text string, report string, kind int, seq int, digest string"


def talk():
    rng = random.Random(5)
    rows = []
    for conv in range(120):
        for turn in range(rng.choice([1, 2, 3, 6, 9, 40])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Hello.", "Hello.", "no end", "What?\n ", "", "  \t", None, f"Text {rng.randrange(9)}!", "é \U0001f600.", "..."])
            rows.append((conv, None if rng.random() < 0.05 else turn + (turn > 3) * rng.randrange(2), role, text))
    rows += [(None, t, "user", "a.") for t in range(5)] + [rows[7]] * 3 + [(500, 1, "user", "x" * 300_000)]
    rows += [(900 + k, t, r, "Same.") for k in range(40) for t, r in enumerate(("user", "assistant"))]
    rows += [(5000 + 37 * k, k, "user", "Alone.") for k in range(90)]  # some of which lose their only row
    return [(*r, "x", 1, 2, "y") for r in rows]


def cheapest(codes):
    """(cost, edits) by uniform-cost search over (row, place); ties to the least string."""
    step = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
    queue, done = [(0, "", 0, 0)], set()
    while queue:
        cost, edits, i, q = heapq.heappop(queue)
        if (i, q) in done:
            continue
        if i == len(codes) and q in (0, 3):
            return cost, edits
        done.add((i, q))
        to = [c for c in step[q] if c != "s"][0]
        heapq.heappush(queue, (cost + 2, edits + "I", i, step[q][to]))
        if i < len(codes):
            role, fault = codes[i]
            heapq.heappush(queue, (cost + 3, edits + "D", i + 1, q))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if role in step[q]:
                    heapq.heappush(queue, (cost + more, edits + "K", i + 1, step[q][role]))
                heapq.heappush(queue, (cost + 2 + more, edits + "R", i + 1, step[q][to]))
    raise AssertionError


def expected_audit(rows):
    """Per conv_id the columns of op12, row by row."""
    found = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        say = lambda x: " " if x is None else str(x)
        role, text = say(role), say(text)
        fate = zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20
        found[conv]
        if fate == 1:
            text = ""
        if fate == 2:
            text = re.sub("[.!?]", "", text)
        if fate == 4:
            role = "user"
        found[conv] += [(turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    out = {}
    for conv, held in found.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, codes, faults = set(), [], Counter()
        for _, role, text in held:
            bare = text.strip(WHITE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            codes.append((role[:1], fault))
            faults[fault] += 1
        turns = [t for t, *_ in held if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") or not a or not b for (a, _), (b, _) in zip(codes, codes[1:]))
        cost, audit = cheapest(codes)
        lines, place, i = [], "", 0
        for edit in audit:
            nxt = "assistant" if place == "u" else "user"
            if edit == "I":
                lines.append(f"{nxt}:")
            elif edit == "R":
                lines.append(f"{nxt}:{held[i][2]}")
            elif edit == "K":
                lines.append(f"{held[i][1]}:{held[i][2]}")
            i += edit != "I"
            place = place if edit == "D" else lines[-1][0]
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def test_conversations_match_brute_force(spark):
    rows = talk()
    got = conversations.op12_query(spark.createDataFrame(rows, TURNS).repartition(5)).collect()
    expected = expected_audit(rows)
    assert len(got) == len(expected) and {r.conv_id: tuple(r)[1:] for r in got} == expected
    assert any(r.audit == "" for r in got) and any("I" in r.audit for r in got) and any("R" in r.audit for r in got)


def test_repaired_rows_follow_the_audit(spark):
    turns = conversations.damaged(spark.createDataFrame(talk(), TURNS))
    audits = {r.conv_id: r.audit for r in conversations.audits(turns).collect()}
    rows = defaultdict(list)
    for r in conversations.repaired(turns).collect():
        rows[r.conv_id].append(r)
    for conv, held in rows.items():
        held.sort(key=lambda r: r.seq)
        assert "".join(r.edit for r in held) == audits[conv] and [r.seq for r in held] == list(range(len(held)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[:1] for r in held if r.edit != "D"))
    assert set(rows) == {c for c, a in audits.items() if a}


def test_no_conversations(spark):
    assert conversations.op12_query(spark.createDataFrame([], TURNS)).count() == 0


def test_shared_prefixes_give_the_same_answers_as_lone_signatures():
    rng = random.Random(3)
    signatures = sorted({bytes(rng.choice([0, 4, 8, 1, 5, 2, 12]) for _ in range(rng.randrange(40))) for _ in range(300)})
    assert list(conversations.solve(iter(signatures))) == [x for s in signatures for x in conversations.solve(iter([s]))]


# --- packing ------------------------------------------------------------------------


def test_packing_is_whole_and_tight(docs, rows, empty):
    vocabulary = best_fit.read_vocabulary()
    plain = Tokenizer.from_str(vocabulary)
    expected = Counter()
    for r in rows:
        ids = [*plain.encode(r[1] or "", add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            expected[r[0], piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    got = best_fit.op13_query(docs).collect()
    assert Counter(tuple(r)[:5] for r in got) == expected
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for spans in held.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:i]) for i in range(len(spans))]
        assert spans[-1][0] + spans[-1][1] <= 4096
    total = sum(r.length for r in got)
    assert len(held) == math.ceil(total / 4096)
    assert best_fit.op13_query(empty).count() == 0
    apart = best_fit.packed(docs, vocabulary, group=20).collect()
    assert Counter(tuple(r)[:5] for r in apart) == expected


@pytest.mark.parametrize("text", ["<|endoftext|> a<|startoftext|>b", "It's  they'LL x y", "é ̸= ΣΑΣ İ", "a\x00b \x1c c\x85d", "a.́b é;̸ x:̈ y\u3000,z?'s !!'t a.'s", "<|ENDOFTEXT|>", "it.İ K. ﬁn,", "", "  \n"])
def test_pieces_between_white_space_encode_alone(text):
    vocabulary = best_fit.read_vocabulary()
    encoder = best_fit.WordEncoder(vocabulary)
    for t in (text, f"x {text}\n\n{text} {text}", text + ",", f"Ab{text}.{text};B"):
        ids = np.concatenate([encoder.encode(s)[0] for s in tk.slices(pa.array([t], pa.string()))])
        assert ids.tolist() == Tokenizer.from_str(vocabulary).encode(t, add_special_tokens=False).ids


def two_fit(lengths, sequence):
    """Sorted sequences of best-two-fit, with lists."""
    left, out = sorted(lengths), []
    while left:
        held, gap = [], sequence
        while fits := [n for n in left if n <= gap]:
            left.remove(fits[-1])
            held.append(fits[-1])
            gap -= fits[-1]
        if gap and len(held) > 1:
            pairs = [(a + b, max(a, b)) for i, a in enumerate(left) for b in left[i + 1 :] if held[-1] < a + b <= held[-1] + gap]
            if pairs:
                total, a = max(pairs)
                left = sorted([*left, held.pop()])
                for n in (a, total - a):
                    left.remove(n)
                    held.append(n)
        out.append(sorted(held))
    return sorted(out)


def test_pack_is_best_two_fit():
    rng = random.Random(2)
    for _ in range(60):
        sequence = rng.choice([16, 100, 4096])
        lengths = np.array([rng.randint(1, rng.choice([sequence, max(1, sequence // 3)])) for _ in range(rng.randrange(1, 70))])
        bins, offsets = best_fit.pack(lengths, sequence)
        held = defaultdict(list)
        for b, o, n in sorted(zip(bins.tolist(), offsets.tolist(), lengths.tolist())):
            assert o == sum(held[b])
            held[b].append(n)
        assert sorted(map(sorted, held.values())) == two_fit(lengths.tolist(), sequence)


# --- hard negatives -----------------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<float>, label int, query int, low int, rank string"


def vectors():
    rng = random.Random(11)
    centers = [[rng.gauss(0, 0.3) for _ in range(8)] for _ in range(6)]
    rows = []
    for i in range(700):
        c = centers[i % 6]
        rows.append((i, [x + rng.gauss(0, 0.15) for x in c], (i % 6) if rng.random() < 0.8 else rng.randrange(10)))
    rows += [(1000 + k, list(rows[3][1]), 3) for k in range(90)]  # equal vectors
    rows += [(2000, None, 1), (2050, [1.0, None] + [0.0] * 6, 1), (2100, [float("nan")] * 8, 1), (2150, [float("inf")] * 8, 1), (2200, [0.1] * 8, None)]
    rows += [rows[50], rows[50], (50, [0.3] * 8, 2), (None, [0.2] * 8, 4), (None, [0.2] * 8, 2), (3000, [], 4), (3050, [0.5, 0.5], 5)]
    return [(*r, 1, 2, "z") for r in rows]


def expected_triples(rows, positives=5, negatives=3):
    import struct

    single = lambda x: struct.unpack("f", struct.pack("f", x))[0]
    kept = []
    for vec_id, v, label, *_ in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        kept.append((vec_id, label, [math.floor(256 * single(x)) for x in v]))
    out = Counter()
    for i, (anchor, label, q) in enumerate(kept):
        if anchor is None or anchor % 50:
            continue
        scored = [(-sum(a * b for a, b in zip(q, v)), vec_id is None, vec_id, lab) for j, (vec_id, lab, v) in enumerate(kept) if j != i]
        scored.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        for s, _, positive, _ in [x for x in scored if x[3] == label][:positives]:
            fit = [x for x in scored if x[3] != label and 50 * -s <= 100 * -x[0] <= 95 * -s]
            for rank, x in enumerate(fit[:negatives], 1):
                out[anchor, positive, rank, x[2], -s, -x[0]] += 1
    return out


def test_hard_negatives_match_brute_force(spark):
    rows = vectors()
    table = spark.createDataFrame(rows, VECTORS).repartition(3)
    expected = expected_triples(rows)
    got = Counter(map(tuple, hard_negatives.op11_query(table).collect()))
    assert got == expected and len(expected) > 100
    assert hard_negatives.op11_query(spark.createDataFrame([], VECTORS)).count() == 0


def test_many_chunks_and_small_trees(spark):
    rows = vectors()
    table = hard_negatives.usable(spark.createDataFrame(rows, VECTORS))
    queries = table.filter("vec_id % 10 = 3").selectExpr("vec_id query", "label", "embedding", "-1000L low", "9000L high")
    whole = hard_negatives.search(table, queries, 4, False).collect()
    parts = hard_negatives.search(table, queries, 4, False, chunk=7, tree_rows=50).collect()
    assert Counter(map(tuple, whole)) == Counter(map(tuple, parts)) and len(whole) > 100


def test_large_components_stay_exact():
    rng = random.Random(4)
    v = np.array([[float(rng.randrange(-(2**28), 2**28)) for _ in range(12)] for _ in range(300)])
    tree = hard_negatives.BallTree(v.copy(), np.zeros(300, np.int64), np.arange(300))
    block = hard_negatives.Queries(v[:9], np.zeros(9, np.int64), np.full(9, -(2**62)), np.full(9, 2**62), 5, True)
    block.search(tree)
    for i in range(9):
        exact = sorted((-sum(int(a) * int(b) for a, b in zip(v[i], w)), j) for j, w in enumerate(v))[:5]
        assert list(zip((-block.score[i]).tolist(), block.id[i].tolist())) == exact


def test_balls_hold_their_rows_and_prune():
    rng = np.random.default_rng(1)
    centers = rng.normal(0, 40, (40, 16))
    v = np.floor(np.repeat(centers, 300, axis=0) + rng.normal(0, 3, (12000, 16)))
    tree = hard_negatives.BallTree(v.copy(), np.arange(12000) % 3, np.arange(12000))
    seen = []

    class Counting(hard_negatives.Queries):
        def _take(self, tree, node, first, last, asked):
            seen.append((last - first) * len(asked))
            super()._take(tree, node, first, last, asked)

    def check(node):
        away = np.sqrt(((tree.vectors[node.first : node.last] - node.center) ** 2).sum(axis=1))
        assert away.max() <= node.radius + 1e-9
        for child in node.below:
            check(child)

    for root in tree.roots:
        check(root)
    block = Counting(v[::500], np.arange(12000)[::500] % 3, np.full(24, -(2**62)), np.full(24, 2**62), 5, True)
    block.search(tree)
    assert sum(seen) < 0.5 * 24 * 4000
