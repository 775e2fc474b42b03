"""Two-stage suffix sorting with bucket scans, in numpy, and adjacent common prefixes."""

from __future__ import annotations

import numpy as np


def smaller_than_successor(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one that starts a byte later.

    The first unlike neighbours decide: so a run of equal bytes has the type of its
    last byte.  The last suffix is larger than the empty one after it.
    """
    n = len(t)
    if n == 0:
        return np.zeros(0, bool)
    rises = np.zeros(n, bool)
    rises[:-1] = t[:-1] < t[1:]
    decided = np.ones(n, bool)
    decided[:-1] = t[:-1] != t[1:]
    at = np.where(decided, np.arange(n), n)
    nearest = np.minimum.accumulate(at[::-1])[::-1]
    return rises[nearest]


def suffix_order(t: np.ndarray, depth: int) -> np.ndarray:
    """Start positions of all suffixes of bytes t, in order of their first `depth` bytes at least.

    Stage one sorts directly, by `depth` bytes, only the suffixes smaller than their
    successors.  Stage two scans the buckets of first bytes upwards: the suffix
    before each scanned one, if larger than its successor, is next in its bucket.
    Within a bucket these come before the directly sorted ones.
    """
    n = len(t)
    if n == 0:
        return np.zeros(0, np.int64)
    rising = smaller_than_successor(t)
    direct = np.flatnonzero(rising)
    padded = np.concatenate([t, np.zeros(depth, np.uint8)])
    if len(direct):
        wide = np.zeros((len(direct), -(-depth // 8) * 8), np.uint8)
        wide[:, :depth] = np.lib.stride_tricks.sliding_window_view(padded, depth)[direct]
        direct = direct[_word_order(wide.view(">u8").astype(np.uint64))]
    first = t[direct]
    edge = np.searchsorted(first, np.arange(257))
    ahead: list[list[np.ndarray]] = [[] for _ in range(256)]
    ahead[int(t[-1])].append(np.array([n - 1]))
    out = []
    for c in range(256):
        level = np.concatenate(ahead[c]) if ahead[c] else np.zeros(0, np.int64)
        found = [level]
        while len(level):
            before = level[level > 0] - 1
            level = before[(t[before] == c) & ~rising[before]]
            found.append(level)
        found.append(direct[edge[c] : edge[c + 1]])
        bucket = np.concatenate(found)
        ahead[c] = []
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[~rising[before] & (t[before] > c)]
        if len(before):
            byte = t[before]
            order = np.argsort(byte, kind="stable")
            before, byte = before[order], byte[order]
            cut = np.flatnonzero(np.diff(byte)) + 1
            for part, b in zip(np.split(before, cut), byte[np.concatenate([[0], cut])].tolist()):
                ahead[b].append(part)
    return np.concatenate(out)


def _word_order(words: np.ndarray) -> np.ndarray:
    """Lexicographic order of rows of 64-bit words: by the first, then only inside ties by the next."""
    order = np.argsort(words[:, 0], kind="stable")
    rank = np.zeros(len(order), np.int64)
    col = words[order, 0]
    rank[1:] = np.cumsum(col[1:] != col[:-1])
    for j in range(1, words.shape[1]):
        same = np.zeros(len(order), bool)
        tie = rank[1:] == rank[:-1]
        same[1:] |= tie
        same[:-1] |= tie
        at = np.flatnonzero(same)
        if not len(at):
            break
        sub = np.lexsort((words[order[at], j], rank[at]))
        order[at] = order[at][sub]
        col = words[order, j]
        step = np.ones(len(order), np.int64)
        step[0] = 0
        step[1:] = (rank[1:] != rank[:-1]) | (col[1:] != col[:-1])
        rank = np.cumsum(step)
    return order


def neighbours_agree(t: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """For sorted starts, whether each suffix has `length` bytes in common with the one before it."""
    if not len(starts):
        return np.zeros(0, bool)
    padded = np.concatenate([t, np.zeros(length, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(padded, length)
    agree = np.zeros(len(starts), bool)
    for a in range(1, len(starts), 1 << 17):
        b = min(a + (1 << 17), len(starts))
        agree[a:b] = (view[starts[a:b]] == view[starts[a - 1 : b - 1]]).all(axis=1)
    return agree
