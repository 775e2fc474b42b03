"""Heading outlines: a native section tree on DataFrames, and the same as arrays in Python.

A document is a preorder list of sections.  A section's subtree is the run up to
the next section of the same or a smaller level, so parents, subtree ends and sizes
follow from what stands before and behind it.  They come from scans in two levels:
windows inside segments of a document, and windows over one summary per segment (for
each of the six levels the last section, and the first place where one ends).  No task
holds the lines or sections of a whole document.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import js_trim, trimmed

HEADING_LINE = r"(?dU)^(#{1,6})\s+(.+)$"
#: Where a heading line begins in a text; white space behind the marks ends with the line.
HEADING_START = r"(?dUm)(?=^#{1,6}[^\S\n]+.+$)"
INTRO_OVER = 50
#: Line numbers, and sections, of a segment.
SEGMENT = 4096
LEVELS = range(1, 7)


def cut_at_headings(text: Column) -> Column:
    """The sections of a text as they stand, each from its heading line on; the first one may be without."""
    return F.split(text, HEADING_START)


def _first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def body_of(part: Column) -> Column:
    """The text of a section below its heading."""
    line = _first_line(part)
    return js_trim(F.when(line.rlike(HEADING_LINE), part.substr(F.length(line) + 2, F.length(part))).otherwise(part))


def text_sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT) -> DataFrame:
    """(id, pos, section_id, level, heading, content, own, seg) of the sections of whole texts, in the rows of the texts: nothing is shuffled.

    `pos` is the place in ``cut_at_headings``.
    """
    text, line = F.col(text_col), _first_line(F.col("part"))
    cut = docs.select(F.col(id_col), _first_line(text).rlike(HEADING_LINE).alias("begins"), F.length(text).alias("n"), F.posexplode(cut_at_headings(text)).alias("pos", "part"))
    is_head = F.col("begins") | (F.col("pos") > 0)
    intro = F.when(F.length("part") < F.col("n"), F.lit("Introduction")).otherwise(F.lit("Documentation"))
    found = cut.select(
        id_col,
        "pos",
        (F.col("pos") + F.col("begins").cast("int")).cast("bigint").alias("section_id"),
        F.when(is_head, F.length(F.regexp_extract(line, HEADING_LINE, 1))).otherwise(F.lit(0)).alias("level"),
        F.when(is_head, js_trim(F.regexp_extract(line, HEADING_LINE, 2))).otherwise(intro).alias("heading"),
        body_of(F.col("part")).alias("content"),
    )
    found = found.withColumns({"own": F.length("content").cast("bigint"), "seg": F.floor(F.col("section_id") / segment)})
    return found.filter((F.col("section_id") > 0) | (F.col("own") > INTRO_OVER))


def section_tree(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT) -> DataFrame:
    """``line_sections`` of whole texts."""
    return nested(text_sections(docs, id_col, text_col, segment), id_col).select(id_col, "section_id", "parent_id", "level", "heading", "content", "subtree_size")


def _with(rows: DataFrame, table: DataFrame, *keys: str) -> DataFrame:
    """rows joined with a table that has one row per key; null keys agree."""
    own = {k: f"_{k}" for k in keys}
    renamed = table.withColumnsRenamed(own)
    same = [F.col(k).eqNullSafe(F.col(own[k])) for k in keys]
    return rows.join(renamed, same, "left").drop(*own.values())


def line_sections(lines: DataFrame, id_col: str = "doc_id", order_col: str = "line_no", line_col: str = "line", segment: int = SEGMENT) -> DataFrame:
    """(id, section_id, parent_id, level, heading, content, subtree_size) of every section of lines (id, line number, line).

    Line numbers rise in a document; they may have gaps.  Text before the first heading is
    'Introduction' at level 0 if longer than 50 characters ('Documentation' where there
    is no heading at all).
    """
    lines = lines.select(F.col(id_col), F.col(order_col).alias("line_no"), F.col(line_col).alias("line"))
    lines = lines.withColumns({"is_head": F.col("line").rlike(HEADING_LINE), "seg": F.floor(F.col("line_no") / segment)})
    before = Window.partitionBy(id_col).orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    heads = lines.groupBy(id_col, "seg").agg(F.count_if("is_head").alias("heads"))
    heads = heads.withColumn("heads_before", F.coalesce(F.sum("heads").over(before), F.lit(0))).drop("heads")
    upto = Window.partitionBy(id_col, "seg").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    lines = _with(lines, heads, id_col, "seg").withColumn("section_id", F.col("heads_before") + F.sum(F.col("is_head").cast("int")).over(upto))
    body = F.array_sort(F.collect_list(F.when(~F.col("is_head"), F.struct("line_no", "line"))))
    found = lines.groupBy(id_col, "section_id").agg(
        F.max(F.when(F.col("is_head"), F.length(F.regexp_extract("line", HEADING_LINE, 1)))).alias("level"),
        F.max(F.when(F.col("is_head"), js_trim(F.regexp_extract("line", HEADING_LINE, 2)))).alias("heading"),
        js_trim(F.array_join(F.transform(body, lambda x: x["line"]), "\n")).alias("content"),
    )
    headed = lines.groupBy(id_col).agg(F.bool_or("is_head").alias("headed"))
    found = _with(found.filter((F.col("section_id") > 0) | (F.length("content") > INTRO_OVER)), headed, id_col)
    found = found.select(
        id_col,
        "section_id",
        F.coalesce("level", F.lit(0)).alias("level"),
        F.coalesce("heading", F.when(F.col("headed"), F.lit("Introduction")).otherwise(F.lit("Documentation"))).alias("heading"),
        "content",
        F.length("content").cast("long").alias("own"),
        F.floor(F.col("section_id") / segment).alias("seg"),
    )
    return nested(found, id_col).select(id_col, "section_id", "parent_id", "level", "heading", "content", "subtree_size")


def nested(found: DataFrame, id_col: str) -> DataFrame:
    """Sections (id, section_id, level, own, seg) with parent_id and subtree_size."""
    inside = Window.partitionBy(id_col, "seg")
    ahead_in = inside.orderBy("section_id").rowsBetween(Window.unboundedPreceding, -1)
    behind_in = inside.orderBy(F.col("section_id").desc()).rowsBetween(Window.unboundedPreceding, -1)
    level, at = F.col("level"), F.col("section_id")
    local = found.withColumn("ahead", F.coalesce(F.sum("own").over(ahead_in), F.lit(0)))
    last = lambda k: F.max(F.when(level == k, at))
    closes = lambda k: F.min(F.when(level.between(1, k), F.struct("section_id", "ahead")))["ahead"]
    sums = local.groupBy(id_col, "seg").agg(F.sum("own").alias("total"), *(last(k).alias(f"last{k}") for k in (0, *LEVELS)), *(closes(k).alias(f"closes{k}") for k in LEVELS))
    per_doc = Window.partitionBy(id_col)
    earlier = per_doc.orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    later = per_doc.orderBy(F.col("seg").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumns({"base": F.coalesce(F.sum("total").over(earlier), F.lit(0)), "whole": F.sum("total").over(per_doc)})
    carried: dict[str, Column] = {f"last{k}": F.max(f"last{k}").over(earlier) for k in (0, *LEVELS)}
    carried |= {f"closes{k}": F.last(F.col("base") + F.col(f"closes{k}"), ignorenulls=True).over(later) for k in LEVELS}
    sums = sums.select(id_col, "seg", "base", "whole", *(c.alias(k) for k, c in carried.items()))
    placed = _with(local, sums, id_col, "seg").withColumn("ahead", F.col("base") + F.col("ahead"))
    parents = [F.when(level > k, F.coalesce(F.last(F.when(level == k, at), ignorenulls=True).over(ahead_in), F.col(f"last{k}"))) for k in (0, *LEVELS)]
    ends = [F.when(level == k, F.coalesce(F.last(F.when(level.between(1, k), F.col("ahead")), ignorenulls=True).over(behind_in), F.col(f"closes{k}"))) for k in LEVELS]
    size = F.when(level > 0, F.coalesce(*ends, F.col("whole")) - F.col("ahead")).otherwise(F.col("own"))
    return placed.withColumns({"parent_id": F.greatest(*parents[1:]), "subtree_size": size})


@dataclass
class Outline:
    """Sections in preorder; section i's subtree is i..end[i]-1 and holds size[i] characters."""

    heading: list[str] = field(default_factory=list)
    level: list[int] = field(default_factory=list)
    content: list[str] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    size: list[int] = field(default_factory=list)

    def close(self) -> Outline:
        n = len(self.level)
        prefix = [0]
        for c in self.content:
            prefix.append(prefix[-1] + len(c))
        self.end = [n] * n
        open_: list[int] = []
        for i, lv in enumerate(self.level):
            while open_ and (self.level[open_[-1]] >= lv or self.level[open_[-1]] == 0):
                self.end[open_.pop()] = i
            open_.append(i)
        self.size = [prefix[e] - prefix[i] for i, e in enumerate(self.end)]
        return self

    def children(self, i: int) -> list[int]:
        out, j = [], i + 1
        while j < self.end[i]:
            out.append(j)
            j = self.end[j]
        return out

    def roots(self) -> list[int]:
        out, j = [], 0
        while j < len(self.level):
            out.append(j)
            j = self.end[j]
        return out

    def markdown(self, i: int) -> str:
        """A subtree as Markdown, its levels held to 1..4."""
        parts = []
        for j in range(i, self.end[i]):
            if self.heading[j] and self.heading[j] != "Introduction":
                parts.append("#" * min(max(self.level[j], 1), 4) + " " + self.heading[j])
            if self.content[j]:
                parts.append(self.content[j])
        return "\n\n".join(parts)


_HEADING = re.compile(r"(#{1,6})\s+(.+)")
_FENCE = re.compile(r"(?s)```.*?```")


def outline(text: str, fence_aware: bool = False) -> Outline:
    """The outline of a text; with fence_aware, lines in fences are no headings."""
    inside: set[int] = set()
    if fence_aware:
        for m in _FENCE.finditer(text):
            first = text.count("\n", 0, m.start())
            inside.update(range(first, first + m[0].count("\n") + 1))
    out, bodies = Outline(), [[]]
    for no, line in enumerate(text.split("\n")):
        m = None if no in inside else _HEADING.fullmatch(line)
        if m:
            out.heading.append(trimmed(m[2]))
            out.level.append(len(m[1]))
            bodies.append([])
        else:
            bodies[-1].append(line)
    intro, *rest = [trimmed("\n".join(b)) for b in bodies]
    out.content = rest
    if len(intro) > INTRO_OVER:
        out.heading.insert(0, "Introduction" if rest else "Documentation")
        out.level.insert(0, 0)
        out.content.insert(0, intro)
    return out.close()
