"""Secret scans: Aho-Corasick keyword prefilter, anchored patterns near hits, checksum validation.

One automaton over all keywords runs over each text (ASCII-lowered).  A pattern is
tried only where a keyword of its kind begins; a hit inside the kind's previous
match is passed over, which gives the leftmost non-overlapping matches.  Runs of
hexadecimal digits have no keyword: for them the automaton runs over the text's
image under "hexadecimal digit or not", where sixteen digits in a row are the
keyword.

Base kinds (kept by length alone): assign, access, hex.  Kinds that the method
adds are kept by an embedded checksum: ``token`` (prefixed tokens whose last six
base-62 digits are the CRC-32 of the characters between prefix and checksum),
``card`` (payment numbers after a card keyword, Luhn digit) and ``iban`` (account
numbers after the keyword, remainder 1 modulo 97).

Offsets are code points, end exclusive.

Inputs and edge cases
* null text is empty: no span.  Null doc_id is returned as null; repeated rows are
  scanned one by one; an empty table gives no rows.
* texts are scanned whole, whatever their length.
* other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Keywords, patterns, and least lengths of the base kinds.
ASSIGN_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_LEAST = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]+", re.ASCII)
ACCESS_LEAST = 18
HEX = re.compile(r"[0-9a-f]+", re.ASCII)
HEX_LEAST = 16
# Prefixes of tokens that end in a checksum, and its digits.
TOKEN_PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
TOKEN = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])", re.ASCII)
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
CARD_KEYWORDS = ("card", "visa", "mastercard")
CARD = re.compile(r"[A-Za-z]*[\x20_-]?(?:number|no\.?)?[\x20:=#]{0,4}((?:[0-9][\x20-]?){12,18}[0-9])(?![0-9])", re.ASCII | re.IGNORECASE)
IBAN_KEYWORDS = ("iban",)
IBAN = re.compile(r"iban[\x20:=#]{0,4}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?![A-Z0-9])", re.ASCII | re.IGNORECASE)

KINDS = ("assign", "access", "hex", "token", "card", "iban")
SCHEMA = "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint>>"

_HEX_IMAGE = bytes(0x68 if chr(b) in "0123456789abcdef" else 0x2E for b in range(128)) + bytes(0x2E for _ in range(128))


def token_checksum(body: str) -> str:
    n, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        digits = BASE62[d] + digits
    return digits


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_valid(number: str) -> bool:
    moved = number[4:] + number[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _automaton() -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
    kinds: dict[str, list[str]] = {}
    for kind, words in (("assign", ASSIGN_KEYWORDS), ("access", ("akia",)), ("token", TOKEN_PREFIXES), ("card", CARD_KEYWORDS), ("iban", IBAN_KEYWORDS)):
        for w in words:
            kinds.setdefault(w, []).append(kind)
    words = ahocorasick.Automaton()
    for w, of in kinds.items():
        words.add_word(w, (len(w), tuple(of)))
    words.make_automaton()
    runs = ahocorasick.Automaton()
    runs.add_word("h" * HEX_LEAST, HEX_LEAST)
    runs.make_automaton()
    return words, runs


_shared: list = []


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of one text, by start and then kind."""
    if not text:
        return []
    if not _shared:
        _shared.extend(_automaton())
    words, runs = _shared
    raw = text.encode("utf-8", "surrogatepass")
    plain = len(raw) == len(text)
    lowered = raw.lower().decode("ascii") if plain else raw.lower().decode("utf-8", "surrogatepass")
    found: list[tuple[int, int, int]] = []
    upto = dict.fromkeys(KINDS, 0)
    for last, (size, kinds) in words.iter(lowered):
        start = last - size + 1
        for kind in kinds:
            if start < upto[kind]:
                continue
            if kind == "assign":
                m = ASSIGN.match(text, start)
                if m:
                    upto[kind] = m.end()
                    if m.end(2) - m.start(2) >= ASSIGN_LEAST:
                        found.append((start, 0, m.end()))
            elif kind == "access":
                m = ACCESS.match(text, start)
                if m:
                    upto[kind] = m.end()
                    if m.end() - start >= ACCESS_LEAST:
                        found.append((start, 1, m.end()))
            elif kind == "token":
                m = TOKEN.match(text, start)
                if m and token_checksum(m[1]) == m[2]:
                    upto[kind] = m.end()
                    found.append((start, 3, m.end()))
            elif kind == "card":
                m = CARD.match(text, start)
                if m and luhn(re.sub(r"[^0-9]", "", m[1])):
                    upto[kind] = m.end()
                    found.append((m.start(1), 4, m.end()))
            elif kind == "iban":
                m = IBAN.match(text, start)
                if m and iban_valid(m[1].replace(" ", "").upper()):
                    upto[kind] = m.end()
                    found.append((m.start(1), 5, m.end()))
    if plain:
        image = raw.translate(_HEX_IMAGE).decode("ascii")
    else:
        # one byte per code point: continuation bytes go, lead bytes are no digits
        image = raw.translate(_HEX_IMAGE, bytes(range(0x80, 0xC0))).decode("ascii")
    if "h" * HEX_LEAST in image:
        done = 0
        for last, size in runs.iter(image):
            start = last - size + 1
            if start < done:
                continue
            m = HEX.match(text, start)
            done = m.end()
            found.append((start, 2, done))
    found.sort(key=lambda x: (x[0], x[1]))
    return [(KINDS[k], a, b) for a, k, b in found]


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and all spans of every document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                spans = [[{"kind": k, "start": a, "end": b} for k, a, b in scan(t.as_py())] for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(rows, SCHEMA)


def op4_query(docs: DataFrame) -> DataFrame:
    found = find_secrets(docs)
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))

    def count(kind: str) -> F.Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    def joined(spans: F.Column | str) -> F.Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"))


COUNTS_ORACLE = r"""
select doc_id,
  len(list_filter(regexp_extract_all(coalesce(text, ''), '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 12))::bigint n_assign,
  len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 18))::bigint n_access,
  len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 16))::bigint n_hex
from documents
"""
