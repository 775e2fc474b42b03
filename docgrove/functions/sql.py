"""Operators as table functions for SQL, registered by name.

    SELECT f.path, c.* FROM files f, LATERAL markdown_chunks(f.content, f.path, f.url) c
    SELECT d.id, o.* FROM docs d, LATERAL outline_sections(d.text) o
    SELECT d.id, p.* FROM docs d, LATERAL fence_parts(d.text) p
    SELECT * FROM pack_batches(limit => 200, rows => TABLE(SELECT k, pos, n FROM parts) PARTITION BY k ORDER BY pos)

The schema of ``pack_batches`` follows from its table (``analyze``).  A partition passes
through one task; ``operators.runs.pack_runs`` is the form for keys of any size.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..operators.chunking import fence_parts, markdown_chunks
from ..operators.outline import outline

CHUNK = "id string, title string, heading string, content string, source_url string"


class MarkdownChunks:
    """Chunks of one Markdown file."""

    def eval(self, content: str, path: str, url: str) -> Iterator[tuple]:
        for c in markdown_chunks(path or "", content or "", url or "", "", "unknown"):
            yield c["id"], c["documentTitle"], c["heading"], c["content"], c["metadata"]["sourceUrl"]


class OutlineSections:
    """Sections of one text in preorder, with the size of their subtrees."""

    def eval(self, text: str) -> Iterator[tuple]:
        o = outline(text or "")
        yield from zip(range(len(o.level)), o.level, o.heading, o.content, o.size)


class FenceParts:
    """The parts of a text: fenced ones, and what stands between."""

    def eval(self, text: str) -> Iterator[tuple]:
        yield from enumerate(fence_parts(text or ""))


class PackBatches:
    """Runs of a partition's rows, whose last column holds sizes, up to a limit: first column, batch, rows and size."""

    def __init__(self) -> None:
        self.key, self.batch, self.n, self.size = None, 0, 0, 0

    @staticmethod
    def analyze(rows: AnalyzeArgument, limit: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or len(rows.dataType.fields) < 2:
            raise ValueError("pack_batches takes a table of a key, what orders it, and sizes")
        if not isinstance(limit.dataType, (IntegerType, LongType)) or not limit.isConstantExpression:
            raise ValueError("the limit is an integer constant")
        key = rows.dataType.fields[0]
        return AnalyzeResult(StructType([StructField(key.name, key.dataType), StructField("batch", IntegerType()), StructField("n", LongType()), StructField("size", LongType())]))

    def eval(self, rows: Row, limit: int) -> Iterator[tuple]:
        self.key, more = rows[0], rows[len(rows) - 1] or 0
        if self.n and self.size + more > limit:
            yield self.key, self.batch, self.n, self.size
            self.batch, self.n, self.size = self.batch + 1, 0, 0
        self.n, self.size = self.n + 1, self.size + more

    def terminate(self) -> Iterator[tuple]:
        if self.n:
            yield self.key, self.batch, self.n, self.size


FUNCTIONS = {
    "markdown_chunks": udtf(MarkdownChunks, returnType=CHUNK),
    "outline_sections": udtf(OutlineSections, returnType="section int, level int, heading string, content string, subtree_size bigint"),
    "fence_parts": udtf(FenceParts, returnType="part int, body string"),
    "pack_batches": udtf(PackBatches),
}


def register(spark: SparkSession) -> None:
    """Makes the table functions known to the session."""
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, function)
