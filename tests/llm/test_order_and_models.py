"""Mixing, sharding, tokens, LM scoring, training order, and the pipeline's stages."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docgrove.llm import encoding, lm_scoring, mixing, sharding, token_counts, training_order
from docgrove.llm import textkernel as tk

SOLID = re.compile(r"[^\x20\x09-\x0D]+")


def test_mix_meets_targets(docs, rows, empty):
    got = mixing.op2_query(docs).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], len(SOLID.findall(r[1] or ""))) for r in rows)
    size, target, taken, most = defaultdict(int), {}, defaultdict(int), defaultdict(int)
    source = {id(r): None for r in got}
    for r in got:
        key = (r.source_size, r.target)
        size[key] += r.size
        target[key] = r.target
        taken[key] += r.taken
        most[key] = max(most[key], r.size)
        assert r.taken <= 3 * r.size
    del source
    total = sum(r.size for r in got)
    assert sum(taken.values()) <= total
    assert abs(sum(target.values()) - total) < 1e-6 * total
    for k in target:
        assert target[k] <= 3 * k[0] + 1e-9
        assert abs(taken[k] - target[k]) <= 2 * max(most.values())
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.op2_query(docs.repartition(7)).collect()))
    assert mixing.op2_query(empty).count() == 0


def test_parted_repeats_are_taken_exactly_in_any_layout(spark):
    rows = [(7, "one two three", "a")] * 4000 + [(k, "w " * 5, "b") for k in range(100, 300)] + [(9, "x y", "c")] * 700
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumns({c: F.lit(1) for c in ("p", "s", "m", "rows")})
    found = [Counter(map(tuple, mixing.op2_query(docs.repartition(n)).collect())) for n in (2, 40)]
    assert found[0] == found[1] and sum(found[0].values()) == len(rows)
    target, taken = {}, Counter()
    for (_, size, source_size, goal, words), n in found[0].items():
        target[source_size] = goal
        taken[source_size] += words * n
    for k, goal in target.items():
        assert abs(taken[k] - goal) <= 5
    mix = [Counter(r.doc_id for r in mixing.mixed_documents(docs.repartition(n)).select("doc_id").collect()) for n in (2, 40)]
    assert mix[0] == mix[1]


def expected_mix(rows):
    """(doc_id, size, source_size, target) and how often such rows are taken in all, row by row in Python."""
    base = []
    for r in rows:
        text = r[1]
        name = str(r[0]) if r[0] is not None else hashlib.md5(text.encode()).hexdigest() if text is not None else None
        key = hashlib.md5(":".join(x for x in (name, mixing.SEED) if x is not None).encode()).hexdigest()
        base.append((r[3], key, len(SOLID.findall(text or "")), r[0]))
    sources = sorted({b[0] for b in base}, key=lambda x: (x is None, x or ""))
    total = sum(b[2] for b in base)
    full = {s: sum(b[2] for b in base if b[0] == s) for s in sources}
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(sources)}
    target, left, free = {}, float(total), set(sources)
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if 3 * full[s] < level * weight[s]]
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = 3.0 * full[s]
            left -= target[s]
            free.remove(s)
    queue = []
    for rank, s in enumerate(sources):
        done = 0
        for b in sorted((b for b in base if b[0] == s), key=lambda b: b[1:3]):
            done += b[2]
            if b[2] and target[s]:
                queue += [((done + k * full[s]) / target[s], rank, k, b[1], b[2], b) for k in range(min(3, max(1, math.ceil(target[s] / full[s] - 1e-12))))]
    taken, used = Counter(), 0
    for q in sorted(queue, key=lambda q: q[:5]):
        used += q[4]
        if used > total:
            break
        taken[q[5][3], q[4], full[q[5][0]]] += 1
    return target, taken, full


def test_mix_matches_row_by_row_queueing(docs, rows):
    target, taken, full = expected_mix(rows)
    got = Counter()
    for r in mixing.op2_query(docs).collect():
        if r.taken:
            got[r.doc_id, r.size, r.source_size] += r.taken // r.size
        assert any(math.isclose(r.target, target[s], rel_tol=1e-9, abs_tol=1e-9) and r.source_size == full[s] for s in full)
    assert got == taken


def test_mix_parts_equal_rows(spark):
    rows = [(7, "one two three", "en", "hot", 0)] * 900 + [(i, "w " * (1 + i % 9), "en", f"s{i % 4}", 0) for i in range(100, 700)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(5)
    _, taken, _ = expected_mix(rows)
    got, most = Counter(), 0
    for r in mixing.op2_query(docs).collect():
        most = max(most, r.taken // r.size)
        got[r.doc_id, r.size, r.source_size] += r.taken // r.size
    assert most <= 3
    assert all(got[k] == v for k, v in taken.items() if k[0] != 7)
    hot = [k for k in taken if k[0] == 7][0]
    assert 0 <= taken[hot] - got[hot] <= 3 * 5


def test_mix_repeats_documents(docs):
    found = mixing.mixed_documents(docs)
    want = {(r.doc_id): r.taken // r.size for r in mixing.op2_query(docs).collect() if r.size}
    got = Counter(r.doc_id for r in found.collect())
    assert all(got[k] == v for k, v in want.items() if k is not None and k != 3)
    assert found.columns == docs.columns


def test_shards_are_exact_and_gapless(docs, rows, empty):
    got = sharding.op6_query(docs).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    sizes = [len(slots[s]) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.op6_query(empty).count() == 0
    again = sharding.op6_query(docs.repartition(5)).collect()
    assert Counter((r.doc_id, r.shard, r.slot) for r in again if r.doc_id not in (3, None)) == Counter((r.doc_id, r.shard, r.slot) for r in got if r.doc_id not in (3, None))


def test_shards_follow_the_drawn_matrix(spark, monkeypatch):
    """Shards and slots anew in Python, from the keys of the rows."""
    monkeypatch.setattr(sharding, "PARTITION_ROWS", 16)
    n = 700
    docs = spark.createDataFrame([(i, f"text {i * i}") for i in range(n)], "doc_id bigint, text string").repartition(3)
    crc = F.crc32(F.encode("text", "utf-8"))
    ids = [F.col("doc_id"), (F.octet_length("text").cast("long") + 1), crc]
    keys = docs.select("doc_id", *[F.xxhash64(F.lit(sharding.SEED + k), *ids).alias(f"k{k}") for k in range(3)]).collect()
    n_parts = -(-n // 16)
    parts = defaultdict(list)
    for r in keys:
        parts[r.k0 % n_parts].append((r.k1, r.k2, r.doc_id))
    groups = defaultdict(list)
    for p in sorted(parts):
        groups[p * sharding.GROUPS // n_parts].append(p)
    sizes = [n // 8 + (s < n % 8) for s in range(8)]
    margins = sharding.communication_matrix([sum(len(parts[p]) for p in groups[g]) for g in sorted(groups)], sizes)
    shard = defaultdict(list)
    for g, margin in zip(sorted(groups), margins):
        for p, row in zip(groups[g], sharding.communication_matrix([len(parts[p]) for p in groups[g]], margin, sharding.SEED * sharding.GROUPS + g + 1)):
            turn = iter(sorted(parts[p]))
            for s, k in enumerate(row):
                shard[s] += [next(turn) for _ in range(k)]
    want = {doc: (s, slot) for s, held in shard.items() for slot, (_, _, doc) in enumerate(sorted(held, key=lambda x: (x[1] % (1 << 64), x[0])))}
    assert {r.doc_id: (r.shard, r.slot) for r in sharding.op6_query(docs).collect()} == want


def test_shards_of_rows_that_repeat(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PARTITION_ROWS", 16)
    docs = spark.createDataFrame([(None, None)] * 300 + [(5, "five")] * 200 + [(i, f"t{i}") for i in range(100)], "doc_id bigint, text string").repartition(4)
    slots = defaultdict(list)
    for r in sharding.op6_query(docs).collect():
        slots[r.shard].append(r.slot)
    assert sorted(map(len, slots.values())) == [75] * 8
    assert all(sorted(v) == list(range(75)) for v in slots.values())


def test_hypergeometric_law():
    rng = random.Random(1)
    good, bad, sample = 7, 9, 6
    n = 20000
    seen = Counter(sharding.draw_hypergeometric(rng, good, bad, sample) for _ in range(n))
    for k in range(7):
        p = math.comb(good, k) * math.comb(bad, sample - k) / math.comb(good + bad, sample)
        assert abs(seen[k] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4
    big = [sharding.draw_hypergeometric(rng, 10**11, 3 * 10**11, 10**9) for _ in range(200)]
    assert abs(np.mean(big) - 2.5e8) < 5 * math.sqrt(1e9 * 0.1875) / math.sqrt(200) * 1.1


def test_matrix_margins():
    counts, shards = [5, 0, 17, 3, 100], [16, 16, 16, 16, 16, 15, 15, 15]
    m = sharding.communication_matrix(counts, shards)
    assert [sum(r) for r in m] == counts and [sum(c) for c in zip(*m)] == shards
    assert all(x >= 0 for r in m for x in r)


def test_encoder_equals_plain_encoding(rows):
    e = encoding.worker_encoder(encoding.packed_ranks())
    texts = [r[1] for r in rows if r[1]] + ["a  b", " lead", "tail ", "x\n\ny z", "it's we'll  done\t tab", "é 中文 \U0001f600 ok", "a b c"]
    white = " \n\t\r\x0b\x0c\x85\xa0\u1680\u2003\u2028\u202f\u205f\u3000"
    rng = random.Random(11)
    texts += ["".join(rng.choice(white + "ab'se1é\U0001f600.-") for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    for t in texts:
        ids = e.encode_text(t).tolist()
        assert ids == e.plain.encode_ordinary(t)
        assert e.plain.decode(ids) == t


def test_encoder_splits_slices_by_row(rows):
    import pyarrow as pa

    e = encoding.worker_encoder(encoding.packed_ranks())
    texts = [r[1] for r in rows]
    got = []
    for s in tk.slices(pa.array(texts, pa.string()), 2000):
        ids, first = e.encode(s)
        got += [ids[a:b].tolist() for a, b in zip(first, first[1:])]
    assert got == [e.plain.encode_ordinary(t or "") for t in texts]


def expected_lines(plain, text):
    """Per line its span and tokens, character by character: a token goes where most of its characters are."""
    text = text or ""
    lines = [x for x in re.findall(r"[^\n]*\n|[^\n]+", text)] or [""]
    line_of, spans, at = [], [], 0
    for k, x in enumerate(lines):
        line_of += [k] * len(x)
        spans.append((at, at + len(x)))
        at += len(x)
    char_of = [i for i, c in enumerate(text) for _ in c.encode()]
    n, byte = [0] * len(lines), 0
    for t in plain.encode_ordinary(text):
        size = len(plain.decode_single_token_bytes(t))
        held = Counter(line_of[i] for i in sorted(set(char_of[byte : byte + size])))
        n[min(held, key=lambda k: (-held[k], k))] += 1
        byte += size
    return [(k, a, b, n[k]) for k, (a, b) in enumerate(spans)]


def test_token_attribution(spark, docs, rows, empty):
    e = encoding.worker_encoder(encoding.packed_ranks())
    more = [(700 + i, t) for i, t in enumerate(["\n", "\n\n\n", "a\n\n\nb\n", "x  \n  y", "\U0001f600\n\U0001f600\u0301 \n", "é\n" * 50, "end\n"])]
    table = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id bigint, text string"))
    want = Counter((i, *line) for i, text in [*((r[0], r[1]) for r in rows), *more] for line in expected_lines(e.plain, text))
    assert Counter(tuple(r) for r in token_counts.op7_query(table).collect()) == want
    assert token_counts.op7_query(empty).count() == 0


def test_allocation_rules():
    starts, ends, sections = np.array([0, 2, 6]), np.array([2, 6, 8]), np.array([3, 8])
    assert token_counts.allocate(starts, ends, sections, "most").tolist() == [1, 2]
    assert token_counts.allocate(starts, ends, sections, "first").tolist() == [2, 1]
    assert token_counts.allocate(starts, ends, sections, "split").tolist() == [1.25, 1.75]
    assert token_counts.allocate(np.array([0]), np.array([4]), np.array([2, 4]), "most").tolist() == [1, 0]


def segmentations(word, pieces):
    if not word:
        return 1.0
    return sum(pieces[word[:k]] * segmentations(word[k:], pieces) for k in range(1, len(word) + 1) if word[:k] in pieces)


def test_lattice_sums_all_segmentations():
    p = {b"a": 0.2, b"b": 0.3, b"ab": 0.1, b"ba": 0.05, b"aba": 0.07, b" ": 0.11, b" a": 0.17}
    lattice = lm_scoring.Lattice({k: math.log(v) for k, v in p.items()})
    for w in (b" a", b" ab", b" abab", b" babaab"):
        assert math.isclose(math.exp(lattice.forward(w)), segmentations(w, p), rel_tol=1e-12)
        counts = {}
        lattice.expected(w, 2.0, counts)
        assert math.isclose(sum(len(k) * v for k, v in counts.items()), 2.0 * len(w), rel_tol=1e-9)


def plain_vocabulary():
    """Weights of the pieces, straight from the model file."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=f"{encoding.TOKENIZERS}/{lm_scoring.VOCABULARY}")
    size, weight = m.get_piece_size(), Counter()
    for i in range(size):
        if m.is_byte(i):
            weight[bytes([int(m.id_to_piece(i)[3:5], 16)])] += 1 / size
        elif not m.is_control(i) and not m.is_unknown(i):
            piece = m.id_to_piece(i).replace("\u2581", " ").encode()
            if b" " not in piece[1:] and 1 - m.get_score(i) <= size:
                weight[piece] += 1 / (1 - m.get_score(i))
    total = sum(weight.values())
    return {p: w / total for p, w in weight.items()}


def arcs_of(word, pieces):
    return {(i, j): pieces[word[i:j]] for i in range(len(word)) for j in range(i + 1, min(len(word), i + 64) + 1) if word[i:j] in pieces}


def plain_sums(word, pieces):
    """Weights of all spellings up to each place and from it on, in extended precision."""
    n = len(word)
    ends, starts = np.zeros(n + 1, np.longdouble), np.zeros(n + 1, np.longdouble)
    ends[0] = starts[n] = 1
    arcs = arcs_of(word, pieces)
    for (i, j), p in sorted(arcs.items(), key=lambda x: x[0][1]):
        ends[j] += ends[i] * np.longdouble(p)
    for (i, j), p in sorted(arcs.items(), key=lambda x: -x[0][0]):
        starts[i] += starts[j] * np.longdouble(p)
    return ends, starts


def tokens(text):
    return SOLID.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.mark.parametrize("dictionary", [200_000, 20])
def test_lm_scores(docs, rows, empty, dictionary):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts, n_docs = Counter(), 0
    for r in rows:
        if not held(r[0]):
            counts.update(tokens(r[1]))
            n_docs += 1
    total, distinct = sum(counts.values()) + n_docs, len(counts) + 1
    first = plain_vocabulary()
    expected = Counter()
    for w, c in counts.items():
        ends, starts = plain_sums(b" " + w.encode(), first)
        for (i, j), p in arcs_of(b" " + w.encode(), first).items():
            expected[(b" " + w.encode())[i:j]] += float(c * ends[i] * p * starts[j] / ends[-1])
    mass = sum(round(v, 3) for v in expected.values()) + lm_scoring.PRIOR + n_docs + 1
    trained = {p: (round(expected.get(p, 0.0), 3) + lm_scoring.PRIOR * w) / mass for p, w in first.items()}
    got = defaultdict(list)
    for r in lm_scoring.score_documents(docs, dictionary=dictionary).collect():
        got[r.doc_id].append(r)
    cache = {}
    for r in rows:
        w = tokens(r[1])
        base = sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in w) + math.log10((n_docs + 1) / (total + distinct + 1))
        for x in set(w) - set(cache):
            cache[x] = float(np.log(plain_sums(b" " + x.encode(), trained)[0][-1]))
        score = (sum(cache[x] for x in w) + math.log((n_docs + 1) / mass)) / math.log(10)
        found = [g for g in got[r[0]] if g.n_tokens == len(w) + 1][0]
        assert found.held_out == held(r[0]) and found.train_tokens == total
        assert found.n_known == sum(counts[x] > 0 for x in w) + 1
        assert math.isclose(found.base_score, base, rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(found.score, score, rel_tol=1e-6, abs_tol=1e-6)
    assert lm_scoring.op8_query(empty).count() == 0


def plain_feistel(x, size):
    """The keyed permutation of one number, in Python integers."""
    full = (1 << 64) - 1

    def mix(v):
        v ^= v >> 31
        v = v * 0x7FB5D329728EA185 & full
        v ^= v >> 27
        v = v * 0x81DADEF4BC2DD44D & full
        return v ^ v >> 33

    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = x >> half, x & mask
        for k in range(1, training_order.ROUNDS + 1):
            left, right = right, left ^ (mix(right + mix(k * 0x9E3779B97F4A7C15 + training_order.KEY & full) & full) & mask)
        x = left << half | right
        if x < size:
            return x


@pytest.mark.parametrize("size", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_feistel_is_a_permutation(size):
    x = training_order.feistel(np.arange(size), size)
    assert sorted(x.tolist()) == list(range(size))
    if size > 100:
        assert (x != training_order.feistel(np.arange(size), size, key=1)).any()


def test_training_order_round_trip(docs, rows, empty, tmp_path):
    e = encoding.worker_encoder(encoding.packed_ranks())
    shards = training_order.training_shards(docs, shard_records=16)
    got = sorted(shards.collect(), key=lambda r: r.shard)
    slots = [(s.first_slot + k, d, p, n, bytes(s.payload[k * s.stride : (k + 1) * s.stride])) for s in got for k, (d, p, n) in enumerate(zip(s.doc_ids, s.parts, s.n_tokens))]
    assert [s[0] for s in slots] == list(range(len(slots)))
    pad = lambda ids: [*ids, *[encoding.END_OF_TEXT] * (training_order.SEQUENCE - len(ids))]
    want = Counter()
    for r in rows:
        ids = [*e.plain.encode_ordinary(r[1] or ""), encoding.END_OF_TEXT]
        for k in range(0, len(ids), training_order.SEQUENCE):
            cut = ids[k : k + training_order.SEQUENCE]
            want[r[0], k // training_order.SEQUENCE, len(cut), np.array(pad(cut), np.uint16).tobytes()] += 1
    assert Counter(s[1:] for s in slots) == want
    # every slot anew: the stored number of a sequence, sent through the permutation in plain integers
    stored = training_order.sequences(docs).collect()
    number = {k: i for i, k in enumerate(sorted((r.task, r.task_no) for r in stored))}
    placed = {plain_feistel(number[r.task, r.task_no], len(stored)): (r.doc_id, r.part, r.n_tokens, bytes(r.tokens)) for r in stored}
    assert [placed[k] for k in range(len(slots))] == [s[1:] for s in slots]
    folder = str(tmp_path / "shards")
    training_order.write_shards(docs, folder, shard_records=16)
    for a, b in ((0, len(slots)), (13, 35), (len(slots) - 1, len(slots) + 40)):
        read = training_order.read_records(docs.sparkSession, folder, a, b, 16)
        assert [x.tobytes() for x in read] == [s[4] for s in slots[a:b]]
    assert training_order.training_shards(empty).count() == 0


def test_kernel_hashes_words_alike_everywhere(rows):
    import pyarrow as pa

    texts = pa.array([r[1] for r in rows])
    seen = {}
    for limit in (64, 1 << 20):
        for s in tk.slices(texts, limit):
            t = tk.tokenize(s, tk.SOLID)
            for a, b, h in zip(t.start.tolist(), t.end.tolist(), t.hash.tolist()):
                assert seen.setdefault(tk.ASCII_LOWER[s.data[a:b]].tobytes(), h) == h
    assert len(set(seen.values())) == len(seen)


def test_pipeline_stages_chain(spark, docs, rows, tmp_path):
    import corpus_pipeline

    docs.filter(F.col("doc_id").isNotNull()).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(rows[1][1].split()[3:20]))], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = spark.read.parquet(str(tmp_path / "documents.parquet"))
    ids = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        kept = stage(spark, kept, str(tmp_path))
        kept.write.parquet(str(tmp_path / f"stage{i}"))
        kept = spark.read.parquet(str(tmp_path / f"stage{i}"))
        assert kept.columns == docs.columns
        ids.append({r.doc_id for r in kept.select("doc_id").collect()})
    assert ids[0] >= ids[1] >= ids[2] >= ids[3]
    assert 1 in ids[1] and 1 not in ids[2]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {d for r in out for d in r.doc_ids} == ids[3]


def test_pipeline_on_an_empty_table(spark, empty, tmp_path):
    import corpus_pipeline

    empty.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
