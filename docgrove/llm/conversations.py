"""Repair of conversation structure by a dynamic program over a trie of signatures.

A conversation is its rows by turn (nulls first), those of one turn by role and then
by the SHA-256 of their text.  The first fault of a row counts: blank (nothing but white
space), duplicate (role and text seen earlier), truncated (does not end in ``.!?``).
Edits are Keep (0), Rerole to user or assistant (2), Delete (3; required for blank and
duplicate rows) and Insert of an empty user or assistant row (2); a truncated row that
stays adds 1.  The cheapest edits whose role initials read ``(s?(ua)+)?`` are chosen,
of equally cheap ones those whose initials are least in ASCII.

Method
* ``reports`` gives each conversation its signature, one byte a row: the class of the
  role's initial and the fault.  Only digests of the texts are shuffled for it.
* ``answers`` takes the distinct signatures, sorts them by range and walks the prefix
  trie that they form: the layers of the current path stay on a stack, a signature pops
  those behind its common prefix with the one before and pushes its own, and the answer
  is read off the terminal layer.  A layer holds, for each of the four places in the
  pattern, the least cost and how the best edit strings compare; equal layers and bytes
  have equal successors, which are kept (``advance``).
* ``repaired`` streams the texts in order past their conversation's edits.

The rows of one conversation pass one task in order, for its edits form one string and
its digest is sequential; that task holds a byte a row and no texts but the batch it
reads.  Equal signatures, however many, are one row before they are sorted.

Inputs and edge cases
* a null role or text is one space, so such a text is blank and such a role fits nothing.
* a null conv_id is a conversation of its own; null turns come first and do not count
  for gaps.  Repeated rows are duplicates of the first.
* roles other than user, assistant and system count by their first character.
* a conversation all of whose rows are gone is reported with zeros, no edits and the
  digest of the empty string, where its id is known.
* an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .shared import durable

WHITE = " \t\n\x0b\x0c\r"
#: Classes of role initials, and faults; a row's byte is 4 * class + fault.
USER, ASSISTANT, SYSTEM, OTHER = range(4)
SOUND, TRUNCATED, DUPLICATE, BLANK = range(4)
KEEP, REROLE, DELETE, INSERT = "KRDI"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}

#: Places in the pattern (s?(ua)+)?: at its start, behind s, behind u, behind a; may it end there.
PLACES = 4
STEP = ({SYSTEM: 1, USER: 2}, {USER: 2}, {ASSISTANT: 3}, {USER: 2})
ENDS = (0, 3)
#: The one role other than system that may follow each place.
FILL = tuple(next(c for c in s if c != SYSTEM) for s in STEP)
ROLE = {USER: "user", ASSISTANT: "assistant"}

_LEGAL = np.zeros((4, 4), bool)
_LEGAL[[SYSTEM, USER, ASSISTANT], [USER, ASSISTANT, USER]] = True

COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")
REPORT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint"

#: A layer: for each place its least cost above the layer's base (None: unreachable), and a
#: short string that stands for its edits; those of a layer compare as the edits do.
Layer = tuple[tuple[int | None, ...], tuple[str, ...]]


def _settle(found: dict[int, tuple[int, str, tuple]]) -> tuple[int, Layer, tuple]:
    """Closes a layer under inserts; (base, layer, how each place was reached)."""
    for _ in range(PLACES):
        for q, (cost, edits, (p, tail)) in list(found.items()):
            to = STEP[q][FILL[q]]
            new = (cost + COST[INSERT], edits + INSERT, (p, tail + INSERT))
            if to not in found or new[:2] < found[to][:2]:
                found[to] = new
    base = min(x[0] for x in found.values())
    names: list[tuple[str, str]] = []  # edits of places in order, and what stands for them
    for edits in sorted(x[1] for x in found.values()):
        longer = next(((e, s) for e, s in names if edits.startswith(e)), None)
        names.append((edits, longer[1] + edits[len(longer[0]) :] if longer else chr(ord("a") + len(names))))
    stands = dict(names)
    costs = tuple(found[q][0] - base if q in found else None for q in range(PLACES))
    return base, (costs, tuple(stands[found[q][1]] if q in found else "" for q in range(PLACES))), tuple(found[q][2] if q in found else None for q in range(PLACES))


#: Before the first row.
ROOT = _settle({0: (0, "", (0, ""))})


@lru_cache(maxsize=1 << 16)
def advance(layer: Layer, byte: int) -> tuple[int, Layer, tuple]:
    """The layer behind one more row: (added to the base, layer, (place before, edits) of each place)."""
    role, fault = divmod(byte, 4)
    found: dict[int, tuple[int, str, tuple]] = {}

    def offer(q: int, to: int, edit: str, more: int) -> None:
        cost, stands = layer[0][q], layer[1][q]
        new = (cost + COST[edit] + more, stands + edit, (q, edit))
        if to not in found or new[:2] < found[to][:2]:
            found[to] = new

    for q in range(PLACES):
        if layer[0][q] is None:
            continue
        offer(q, q, DELETE, 0)
        if fault not in (BLANK, DUPLICATE):
            if role in STEP[q]:
                offer(q, STEP[q][role], KEEP, fault == TRUNCATED)
            offer(q, STEP[q][FILL[q]], REROLE, fault == TRUNCATED)
    return _settle(found)


def solve(signatures: Iterator[bytes]) -> Iterator[tuple[bytes, int, str]]:
    """(signature, cost, edits) of sorted signatures; layers of shared prefixes are computed once."""
    path, layers, bases, came = b"", [ROOT[1]], [ROOT[0]], [ROOT[2]]
    for signature in signatures:
        shared = 0
        for a, b in zip(path, signature):
            if a != b:
                break
            shared += 1
        del layers[shared + 1 :], bases[shared + 1 :], came[shared + 1 :]
        for byte in signature[shared:]:
            added, layer, how = advance(layers[-1], byte)
            layers.append(layer)
            bases.append(bases[-1] + added)
            came.append(how)
        path, (costs, stands) = signature, layers[-1]
        cost, _, q = min((costs[q], stands[q], q) for q in ENDS if costs[q] is not None)
        edits = []
        for how in reversed(came):
            q, tail = how[q]
            edits.append(tail)
        yield signature, bases[-1] + cost, "".join(reversed(edits))


def _read(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role and text, no role or text null."""
    space = F.lit(" ")
    return turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role"), space).alias("role"), F.coalesce(F.col("text"), space).alias("text"))


def _digest() -> F.Column:
    return F.unhex(F.sha2(F.col("text"), 256))


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, pa.RecordBatch, bool]]:
    """(conversation, its rows in a batch, whether they are its first) of rows sorted by their first column."""
    last, begun = None, False
    for b in batches:
        if not b.num_rows:
            continue
        runs = pc.run_end_encode(b.column(0))
        at = 0
        for conv, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
            yield conv, b.slice(at, end - at), not begun or conv != last
            last, begun, at = conv, True, end


def reports(turns: DataFrame) -> DataFrame:
    """REPORT and `signature` of each conversation (conv_id) of turns."""
    rows = _read(turns)
    bare = F.rtrim("text", F.lit(WHITE))
    role = F.when(F.col("role").startswith("u"), USER).when(F.col("role").startswith("a"), ASSISTANT).when(F.col("role").startswith("s"), SYSTEM).otherwise(OTHER)
    narrow = rows.select("conv_id", "turn", "role", _digest().alias("digest"), role.alias("class"), (bare == "").alias("is_blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("is_open"))
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "digest").orderBy("turn"))
    fault = F.when(F.col("is_blank"), BLANK).when(F.col("seen") > 1, DUPLICATE).when(F.col("is_open"), TRUNCATED).otherwise(SOUND)
    coded = narrow.repartition("conv_id").withColumn("seen", seen).select("conv_id", "turn", "role", "digest", (4 * F.col("class") + fault).cast("int").alias("code"))
    ordered = coded.sortWithinPartitions("conv_id", "turn", "role", "digest", F.col("code") % 4 == DUPLICATE).select("conv_id", "turn", "code")
    schema = StructType([ordered.schema["conv_id"], *StructType.fromDDL(REPORT + ", signature binary").fields])
    arrow = to_arrow_schema(schema)

    def count(held: list[pa.RecordBatch]) -> tuple:
        code = np.concatenate([b.column(2).to_numpy() for b in held]).astype(np.uint8)
        turn = np.concatenate([b.column(1).drop_null().to_numpy() for b in held])
        gaps = int(turn[-1] - turn[0]) - int(np.count_nonzero(np.diff(turn))) if len(turn) else 0
        role, fault = code >> 2, np.bincount(code & 3, minlength=4)
        return gaps, int(fault[BLANK]), int(fault[DUPLICATE]), int(fault[TRUNCATED]), int(np.count_nonzero(~_LEGAL[role[:-1], role[1:]])), code.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        convs, found = [], []

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(convs, arrow.field(0).type), *(pa.array(x, f.type) for x, f in zip(zip(*found), list(arrow)[1:]))], schema=arrow)
            convs.clear()
            found.clear()
            return out

        current = None
        for conv, rows, first in _stretches(batches):
            if first and held:
                convs.append(current)
                found.append(count(held))
                held = []
                if len(found) >= 4096:
                    yield batch()
            current = conv
            held.append(rows)
        if held:
            convs.append(current)
            found.append(count(held))
        if found:
            yield batch()

    return ordered.mapInArrow(run, schema)


def answers(signatures: DataFrame) -> DataFrame:
    """(signature, cost, audit) of distinct signatures, by tries over ranges of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = solve(s for b in batches for s in b.column(0).to_pylist())
        while part := [x for _, x in zip(range(4096), found)]:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*part), (pa.binary(), pa.int64(), pa.string()))], names=["signature", "cost", "audit"])

    ranged = signatures.select("signature").distinct().repartitionByRange("signature").sortWithinPartitions("signature")
    return ranged.mapInArrow(run, "signature binary, cost bigint, audit string")


def audits(turns: DataFrame) -> DataFrame:
    """conv_id, REPORT, cost and audit of each conversation."""
    found = durable(reports(turns), "conversations")
    return found.join(answers(found), "signature").drop("signature")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """What becomes of rows sorted by conversation, report first: (conversation, report or None, edit, role, text).

    Every conversation begins with an event whose edit is None.
    """
    audit, at, place, has_report = "", 0, 0, False
    current = None

    def inserts() -> Iterator[tuple]:
        nonlocal at, place
        while at < len(audit) and audit[at] == INSERT:
            yield current, None, INSERT, ROLE[FILL[place]], ""
            at, place = at + 1, STEP[place][FILL[place]]

    for conv, rows, first in _stretches(batches):
        kinds, roles, texts = rows.column(1).to_pylist(), rows.column(3), rows.column(4)
        if first:
            yield from inserts()
            report = [rows.column(k)[0].as_py() for k in range(5, rows.num_columns)] if kinds[0] == 0 else None
            current, audit, at, place, has_report = conv, report[-1] if report else "", 0, 0, report is not None
            yield conv, report, None, None, None
        for i, kind in enumerate(kinds):
            if kind != 1:
                continue
            if not has_report:
                raise ValueError("a conversation has rows and no report")
            yield from inserts()
            edit, at = audit[at], at + 1
            role, text = roles[i].as_py(), texts[i].as_py()
            if edit == DELETE:
                yield conv, None, edit, role, text
                continue
            kept = {"u": USER, "a": ASSISTANT, "s": SYSTEM}.get(role[:1], OTHER) if edit == KEEP else FILL[place]
            place = STEP[place][kept]
            yield conv, None, edit, role if edit == KEEP else ROLE[kept], text
    yield from inserts()


def _with_reports(turns: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Reports, rows and ids of conversations, those of one together and in this order."""
    report = audits(turns).select("conv_id", F.lit(0).alias("kind"), F.struct(*COUNTS, "cost", "audit").alias("report"))
    rows = _read(turns).withColumns({"kind": F.lit(1), "digest": _digest()})
    both = report.unionByName(rows, allowMissingColumns=True)
    if ids is not None:
        both = both.unionByName(ids.select("conv_id", F.lit(2).alias("kind")).distinct(), allowMissingColumns=True)
    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest")
    return ordered.select("conv_id", "kind", "turn", "role", "text", *(F.col("report")[k].alias(k) for k in (*COUNTS, "cost", "audit")))


def repaired(turns: DataFrame) -> DataFrame:
    """The rows of every conversation with what becomes of them.

    conv_id, seq (place among the conversation's edits, from 0), edit, role and text as
    repaired; deleted rows are given with the role and text that go.
    """
    rows = _with_reports(turns, None)
    schema = StructType([rows.schema["conv_id"], *StructType.fromDDL("seq bigint, edit string, role string, text string").fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seq = [], 0, 0
        for conv, _, edit, role, text in _edited(batches):
            seq = 0 if edit is None else seq + 1
            if edit is not None:
                held.append((conv, seq - 1, edit, role, text))
                size += 64 + len(text)
                if size > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), arrow)], schema=arrow)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), arrow)], schema=arrow)

    return rows.mapInArrow(run, schema)


def audited(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """conv_id, REPORT, cost, audit and repaired_sha256 (of ``role:text`` lines) of each conversation.

    Conversations of `ids` (conv_id) that have no rows are reported too.
    """
    rows = _with_reports(turns, ids)
    schema = StructType([rows.schema["conv_id"], *StructType.fromDDL(REPORT + ", cost bigint, audit string, repaired_sha256 string").fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []
        digest, lines = None, 0
        for conv, report, edit, role, text in _edited(batches):
            if edit is None:
                if held:
                    held[-1].append(digest.hexdigest())
                if len(held) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), arrow)], schema=arrow)
                    held = []
                held.append([conv, *(report or [0] * (len(COUNTS) + 1) + [""])])
                digest, lines = hashlib.sha256(), 0
            elif edit != DELETE:
                digest.update(f"{chr(10) if lines else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
                lines += 1
        if held:
            held[-1].append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), arrow)], schema=arrow)

    return rows.mapInArrow(run, schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations after the contract's damage, by crc32 of conv_id:turn modulo 20."""
    say = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(say("conv_id"), F.lit(":"), say("turn")).cast("binary")) % 20
    rows = _read(conversations).withColumn("fate", fate).filter("fate <> 0")
    text = F.when(F.col("fate") == 1, F.lit("")).when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("fate") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", F.when(F.col("fate") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def op12_query(conversations: DataFrame) -> DataFrame:
    return audited(damaged(conversations), conversations.select("conv_id"))
