"""LM scoring by subword lattice likelihood, with an add-one word unigram score as base.

The pieces are an existing vocabulary with its scores; they are never changed.  A
word is a lattice over its bytes: every way to spell it by pieces is a path, and the
forward recursion in log space sums the paths.  White space bounds words, so a
document's marginal probability is the product over its words and the end piece.

Weights.  The vocabulary's scores order the pieces; the first distribution takes a
piece's weight as the reciprocal of its place in that order.  The training texts
then re-weight the pieces once: expected piece counts over all segmentations of all
training words (forward and backward recursion), smoothed by the first distribution.

Words are keyed by a 64-bit hash.  Counts, N and V come from all training texts;
each distinct word's lattice is scored once for the corpus.  A dictionary of the
most frequent words, at most DICTIONARY, travels to the documents; words beyond it
meet their scores in a join, in which no word is frequent.

Inputs and edge cases
* null text is empty: one token, the end.  Null doc_id counts as '' for the split.
* repeated rows are scored one by one, and count one by one in training.
* no training texts: N = V = 0, and the first distribution stands.
* an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .encoding import TOKENIZERS
from .shared import durable

VOCABULARY = "piece_bpe_32k.model"
DICTIONARY = 200_000
#: Weight of the first distribution, in pieces, when the training texts re-weight it.
PRIOR = 10_000.0
FLUSH_WORDS = 200_000
_FLUSH_SLICES = 8
MARK = b" "  # stands for the word-start mark: words hold no space
LOG10 = math.log(10)


def vocabulary(folder: str = TOKENIZERS, name: str = VOCABULARY) -> dict[bytes, float]:
    """Log weights of the pieces as byte strings: the normalised reciprocal of their place by score.

    Single-byte fallbacks come last, and add up with a piece of the same byte.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{name}")
    weight: dict[bytes, float] = {}
    size = model.get_piece_size()
    for i in range(size):
        if model.is_control(i) or model.is_unknown(i):
            continue
        if model.is_byte(i):
            piece, place = bytes([int(model.id_to_piece(i)[3:5], 16)]), size
        else:
            text = model.id_to_piece(i)
            piece, place = text.replace("▁", " ").encode(), 1 - model.get_score(i)
            if b" " in piece[1:] or place > size:
                continue
        weight[piece] = weight.get(piece, 0.0) + 1 / place
    total = sum(weight.values())
    return {p: math.log(w / total) for p, w in weight.items()}


class Lattice:
    """Forward and backward recursion over a trie of pieces."""

    def __init__(self, weights: dict[bytes, float]):
        self.root: dict = {}
        for piece, w in weights.items():
            node = self.root
            for b in piece:
                node = node.setdefault(b, {})
            node[-1] = (w, piece)

    def _arcs(self, word: bytes) -> list[list[tuple[int, float, bytes]]]:
        """Per end position the arcs that arrive there: (start, log weight, piece)."""
        n = len(word)
        into: list[list[tuple[int, float, bytes]]] = [[] for _ in range(n + 1)]
        for i in range(n):
            node = self.root
            for j in range(i, n):
                node = node.get(word[j])
                if node is None:
                    break
                found = node.get(-1)
                if found is not None:
                    into[j + 1].append((i, *found))
        return into

    def forward(self, word: bytes) -> float:
        """Log of the summed weight of all segmentations."""
        return self._forward(self._arcs(word))[-1]

    @staticmethod
    def _forward(into: list) -> list[float]:
        alpha = [0.0]
        for arcs in into[1:]:
            if len(arcs) == 1:
                alpha.append(alpha[arcs[0][0]] + arcs[0][1])
                continue
            terms = [alpha[i] + w for i, w, _ in arcs]
            top = max(terms, default=-math.inf)
            alpha.append(top if top == -math.inf else top + math.log(sum(math.exp(t - top) for t in terms)))
        return alpha

    def expected(self, word: bytes, times: float, into_counts: dict[bytes, float]) -> None:
        """Adds the expected piece counts of a word met `times` times."""
        into = self._arcs(word)
        alpha = self._forward(into)
        beta = [-math.inf] * len(alpha)
        beta[-1] = 0.0
        for j in range(len(alpha) - 1, 0, -1):
            for i, w, piece in into[j]:
                t = beta[j] + w
                if t == -math.inf:
                    continue
                a, b = (beta[i], t) if beta[i] > t else (t, beta[i])
                beta[i] = a + math.log1p(math.exp(b - a)) if b > -math.inf else a
                share = alpha[i] + t - alpha[-1]
                if share > -40:
                    into_counts[piece] = into_counts.get(piece, 0.0) + times * math.exp(share)


def _held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text")).withColumn("held_out", _held_out())


def word_counts(rows: DataFrame) -> DataFrame:
    """(hash, word, n, seen): n in training texts, seen in all texts; summed per task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            out = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for s in tk.slices(batch.column(1)):
                data = tk.ASCII_LOWER[s.data]
                t = tk.tokenize(s, tk.SOLID, data=data)
                if not len(t.hash):
                    continue
                u, first, inverse = np.unique(t.hash, return_index=True, return_inverse=True)
                train = np.repeat(~out[s.first : s.last], t.counts())
                n = np.bincount(inverse, weights=train, minlength=len(u)).astype(np.int64)
                seen = np.bincount(inverse, minlength=len(u))
                words = np.array([data[a:b].tobytes() for a, b in zip(t.start[first].tolist(), t.end[first].tolist())], dtype=object)
                held.append((u, words, n, seen))
                if len(held) >= _FLUSH_SLICES:
                    held = [_summed(held)]
                    if len(held[0][0]) >= FLUSH_WORDS:
                        yield _count_batch(held.pop())
        if held:
            yield _count_batch(_summed(held))

    found = rows.select("doc_id", "text", "held_out").mapInArrow(count, "hash bigint, word binary, n bigint, seen bigint")
    return found.groupBy("hash").agg(F.min("word").alias("word"), F.sum("n").alias("n"), F.sum("seen").alias("seen"))


def _summed(held: list) -> tuple:
    h, w, n, seen = (np.concatenate([x[j] for x in held]) for j in range(4))
    u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    return u, w[first], np.bincount(inverse, weights=n, minlength=len(u)).astype(np.int64), np.bincount(inverse, weights=seen, minlength=len(u)).astype(np.int64)


def _count_batch(x: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x[0].view(np.int64)), pa.array(x[1].tolist(), pa.binary()), pa.array(x[2]), pa.array(x[3])], names=["hash", "word", "n", "seen"])


def trained_weights(counts: DataFrame, first: dict[bytes, float], n_docs: int) -> dict[bytes, float]:
    """Piece log weights after one re-estimation on all training words; b'' is the end piece."""

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, total = Lattice(first), {}
        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lattice.expected(MARK + word, n, total)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.float64())], names=["piece", "n"])

    # at most one row per piece of the vocabulary reaches the driver
    got = counts.filter("n > 0").select("word", "n").mapInArrow(expect, "piece binary, n double").groupBy("piece").agg(F.round(F.sum("n"), 3).alias("n")).collect()
    expected = {bytes(r["piece"]): r["n"] for r in got}
    total = sum(expected.values()) + PRIOR + n_docs + 1
    weights = {p: math.log((expected.get(p, 0.0) + PRIOR * math.exp(w)) / total) for p, w in first.items()}
    weights[b""] = math.log((n_docs + 1) / total)
    return weights


def score_documents(docs: DataFrame, tokenizers: str = TOKENIZERS, dictionary: int = DICTIONARY) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10), for every row."""
    rows = _rows(docs)
    counts = durable(word_counts(rows), "word-counts")
    n_docs = rows.filter(~F.col("held_out")).count()
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    train_tokens, distinct = sums["n"] + n_docs, sums["v"] + (n_docs > 0)
    weights = trained_weights(counts, vocabulary(tokenizers), n_docs)
    end = weights.pop(b"")

    def lattice_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(weights)
        for b in batches:
            lp = [lattice.forward(MARK + w) / LOG10 for w in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(lp, pa.float64())], names=["hash", "n", "seen", "lp"])

    words = durable(counts.select("hash", "word", "n", "seen").mapInArrow(lattice_scores, "hash bigint, n bigint, seen bigint, lp double"), "word-scores")
    least = _least_level(words, dictionary)
    table = words.filter(_level() >= least).select("hash", "n", "lp").toArrow()  # `dictionary` rows at most
    key = table["hash"].to_numpy().view(np.uint64)
    order = np.argsort(key)
    key, known = key[order], (table["n"].to_numpy() > 0)[order]
    base, lp = np.log10(table["n"].to_numpy() + 1.0)[order], table["lp"].to_numpy()[order]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, no = TaskContext.get().partitionId(), 0
        for batch in batches:
            for s in tk.slices(batch.column(1)):
                t = tk.tokenize(s, tk.SOLID)
                n = s.rows()
                row = np.repeat(np.arange(n), t.counts())
                at = np.minimum(np.searchsorted(key, t.hash), max(len(key) - 1, 0))
                hit = key[at] == t.hash if len(key) else np.zeros(len(t.hash), bool)
                sums = [np.bincount(row[hit], weights=x[at[hit]], minlength=n) if len(key) else np.zeros(n) for x in (known, base, lp)]
                rare, times = [], []
                cut = np.searchsorted(row[~hit], np.arange(n + 1))
                missing = t.hash[~hit]
                for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                    u, k = np.unique(missing[a:b], return_counts=True)
                    rare.append(u.view(np.int64))
                    times.append(k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, task), pa.int32()), pa.array(np.arange(no, no + n), pa.int64()), batch.column(0).slice(s.first, n), batch.column(2).slice(s.first, n), pa.array(t.counts() + 1, pa.int64()), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2]),
                     pa.array(rare, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64()))],
                    names=["task", "no", "doc_id", "held_out", "n_tokens", "n_known", "base", "lp", "rare", "times"],
                )
                no += n

    parts = durable(rows.select("doc_id", "text", "held_out").mapInArrow(score, "task int, no bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, lp double, rare array<bigint>, times array<bigint>"), "partial-scores")
    each = parts.select("task", "no", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("task", "no", F.col("x.rare").alias("hash"), F.col("x.times").alias("times"))
    rest = each.join(words.filter(_level() < least).select("hash", "n", F.col("lp").alias("word_lp")), "hash").groupBy("task", "no").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(F.lit(0))).alias("more_known"),
        F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more_base"),
        F.sum(F.col("times") * F.col("word_lp")).alias("more_lp"),
    )
    zero = F.lit(0.0)
    end_known = 1 if n_docs else 0
    return parts.join(rest, ["task", "no"], "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0)) + end_known).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", zero) + math.log10(n_docs + 1) - F.col("n_tokens") * math.log10(train_tokens + distinct + 1)).alias("base_score"),
        (F.col("lp") + F.coalesce("more_lp", zero) + end / LOG10).alias("score"),
    )


def _level() -> Column:
    """A word's frequency on a log scale of few levels."""
    return F.floor(16 * F.log2("seen")).cast("int")


def _least_level(words: DataFrame, dictionary: int) -> int:
    """The least frequency level such that no more than `dictionary` words lie on it or above."""
    held, least = 0, 1 << 20
    for r in words.groupBy(_level().alias("level")).count().orderBy(F.col("level").desc()).collect():
        held += r["count"]
        if held > dictionary:
            break
        least = r["level"]
    return least


def op8_query(docs: DataFrame) -> DataFrame:
    return score_documents(docs)
