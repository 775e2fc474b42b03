"""Token counts per section by offset-mapped attribution.

Each whole document is encoded once.  Token spans follow from the tokens' byte
lengths and are mapped to characters; sections are character spans that tile the
document; both are sorted, so the interval join is a merge by binary search inside
the row.  A token that lies in several sections is allocated by an explicit rule:

* ``most``: the section that holds most of its characters, the earlier one on ties;
* ``first``: the section that holds its first character;
* ``split``: to each section its share of the token's characters.

A token that ends inside a character counts as touching that whole character.

Sections of the query are the lines of a text, each with its newline.

Inputs and edge cases
* null and empty texts have one empty section with 0 tokens.
* null doc_id is returned as null; repeated rows are counted one by one; an empty
  table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .encoding import TOKENIZERS, packed_ranks, worker_encoder

SCHEMA = "doc_id bigint, section bigint, char_start bigint, char_end bigint, n_tokens double"
RULES = ("most", "first", "split")


def line_ends(text: str) -> np.ndarray:
    """Ends of the sections of a text: after each newline, and at the end."""
    at = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) == 10) + 1
    return at if len(at) and at[-1] == len(text) else np.append(at, len(text))


def token_spans(text: str, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character spans of the tokens of a text."""
    ends = np.cumsum(lengths[ids])
    starts = ends - lengths[ids]
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if len(raw) == len(text):
        return starts, ends
    seen = np.cumsum((raw & 0xC0) != 0x80)
    return seen[starts] - 1, seen[ends - 1]


def allocate(starts: np.ndarray, ends: np.ndarray, section_ends: np.ndarray, rule: str = "most") -> np.ndarray:
    """Tokens per section; sections tile the text, and every token has a character."""
    n = len(section_ends)
    first = np.searchsorted(section_ends, starts, "right")
    last = np.searchsorted(section_ends, ends - 1, "right")
    if rule == "first":
        return np.bincount(first, minlength=n).astype(float)
    inside = first == last
    out = np.bincount(first[inside], minlength=n).astype(float)
    for a, b, f, k in zip(*(x[~inside].tolist() for x in (starts, ends, first, last))):
        edges = np.concatenate([[a], section_ends[f:k], [b]])
        held = np.diff(edges)
        if rule == "split":
            out[f : k + 1] += held / (b - a)
        else:
            out[f + int(np.argmax(held))] += 1
    return out


def count_tokens(docs: DataFrame, section_ends: Callable[[str], np.ndarray] = line_ends, rule: str = "most", tokenizers: str = TOKENIZERS) -> DataFrame:
    """A row per section of every document, with its allocated tokens."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {', '.join(RULES)}")
    packed = packed_ranks(tokenizers)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(packed)
        for batch in batches:
            for s in tk.slices(batch.column(1)):
                tokens, first = encoder.encode(s)
                ends, counts = [], []
                for r, t in enumerate(batch.column(1).slice(s.first, s.rows())):
                    text = t.as_py() or ""
                    ids = tokens[first[r] : first[r + 1]]
                    ends.append(section_ends(text))
                    counts.append(allocate(*token_spans(text, ids, encoder.lengths), ends[-1], rule) if len(ids) else np.zeros(len(ends[-1])))
                n = np.array([len(e) for e in ends])
                end = np.concatenate(ends)
                top = np.cumsum(n) - n  # each row's first section
                start = np.append(0, end[:-1])
                start[top] = 0
                doc = batch.column(0).slice(s.first, s.rows()).take(pa.array(np.repeat(np.arange(len(n)), n)))
                yield pa.RecordBatch.from_arrays([doc, pa.array(np.arange(len(end)) - np.repeat(top, n), pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(np.concatenate(counts), pa.float64())], names=["doc_id", "section", "char_start", "char_end", "n_tokens"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text")).mapInArrow(rows, SCHEMA)


def op7_query(docs: DataFrame) -> DataFrame:
    return count_tokens(docs).withColumn("n_tokens", F.col("n_tokens").cast("long"))


SPANS_ORACLE = """
with l as (select doc_id, string_split(coalesce(text, ''), chr(10)) x from documents),
p as (select doc_id, unnest(range(1, len(x) + 1)) i, x from l),
s as (select doc_id, i, i = len(x) is_last, length(x[i]) + (i < len(x))::bigint n from p),
e as (select *, sum(n) over (partition by doc_id order by i) char_end, count(*) over (partition by doc_id) lines from s)
select doc_id, (i - 1)::bigint section, (char_end - n)::bigint char_start, char_end::bigint char_end from e where n > 0 or lines = 1
"""
