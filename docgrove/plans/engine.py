"""The engine: reindex, search, preview, export, dump and clear over configured sources."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.tokens import TokenCap
from ..functions.vectors import HashingEmbedder
from ..model import ChunkConfig
from ..operators.chunking import chunk_rows, mdx_chunks
from ..operators.html import html_chunks
from ..operators.markdown import markdown_files
from ..operators.openapi import doc_url_map, load_spec, spec_chunks
from ..sources.config import resolve_deletion
from ..sources.datasources import BATCH, send
from ..sources.files import Source, read_chunk_dump, scan
from ..sources.remote import Staging, read_source
from . import search as s
from .index import VectorIndex, to_records
from .terms import FUSED_RANKS, TermIndex, fuse

#: Parsers whose files fail one by one; a bad file of another parser fails its source.
ISOLATED = ("html",)


class SourceError(RuntimeError):
    """A source that is not optional has files that cannot be parsed."""


def parse(files: DataFrame, source: Source, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Chunks of a source's files (context, path, content, url, language, source), with `error`.

    `file` and `place` say where in its source a chunk stands.
    """
    if source.parser == "markdown":
        found = markdown_files(files, config)
        # ids by file: files of one directory would share them otherwise
        own = F.concat(F.col("metadata.repository"), F.lit("/"), "file", F.lit("#"), F.col("place").cast("string"))
        return found.withColumns({"id": own, "source": F.lit(source.name), "error": F.lit(None).cast("string")})

    def make(r: dict) -> list[dict]:
        text, url, context = r["content"] or "", r["url"] or "", r["context"]
        if source.parser == "mdx":
            return _mdx(text, r["path"], source, config)
        if source.parser == "html":
            return html_chunks(text, r["path"], url, context, r["language"], config)
        return spec_chunks(load_spec(text), source.base_url)

    return chunk_rows(files.withColumn("file", F.col("path")), make, keep=["source", "file"], place="place")


def with_page_urls(chunks: DataFrame, pages: DataFrame, base_url: str) -> DataFrame:
    """API chunks with the address of the page (path, content) whose frontmatter names their operation."""
    urls = doc_url_map(pages, base_url).withColumnRenamed("url", "page_url")
    key = F.concat(F.upper("metadata.method"), F.lit(" "), F.col("metadata.path"))
    joined = chunks.withColumn("key", key).join(urls, "key", "left")
    address = F.coalesce("page_url", "metadata.sourceUrl")
    return joined.withColumn("metadata", F.col("metadata").withField("sourceUrl", address)).select(*chunks.columns)


def _mdx(text: str, path: str, source: Source, config: ChunkConfig) -> list[dict]:
    import yaml

    text = tx.apply_str(tx.LINE_ENDINGS, text)
    head = re.match(r"(?s)\A---\n(.*?)\n---\n?", text)
    front = (yaml.safe_load(head[1]) if head else None) or {}
    slug = re.sub(r"/index$", "", re.sub(r"(?i)\.mdx?$", "", path))
    base = source.base_url.rstrip("/")
    url = f"{base}/{slug}" if base else f"https://github.com/{source.repository}/blob/main/{source.path}/{path}" if source.repository else ""
    folder = path.split("/")[0] if "/" in path else ""
    category = " / ".join(x for x in (source.display_name or source.name, folder) if x)
    body = text[head.end() :] if head else text
    return mdx_chunks(body, f"{source.name}/{slug}", path, str(front.get("title") or slug.split("/")[-1]), front.get("description"), category, url, config)


def embed_chunks(chunks: DataFrame, embedder: HashingEmbedder, cap: TokenCap | None = None) -> DataFrame:
    """chunks with `values`, embedded in Arrow batches of their inputs; a chunk and its vector stay one row.

    Inputs are cut at the tokens of `cap`, of ``TokenCap.default()`` if none is given.
    """
    m = lambda k: F.col(f"metadata.{k}")
    text = tx.embedding_text(F.col("documentTitle"), F.col("heading"), F.col("content"), m("language"), m("repository"), m("method"), m("path"), m("description"))
    cap = cap or TokenCap.default()

    def run(texts: pa.Array) -> pa.Array:
        # cut here: another function would be a second worker beside each task's
        vectors = embedder.embed_batch(cap.cut_batch(texts))
        if vectors.shape != (len(texts), embedder.dimension):
            raise ValueError(f"{vectors.shape} embeddings for {len(texts)} texts in {embedder.dimension} dimensions")
        return pa.ListArray.from_arrays(pa.array(range(0, vectors.size + 1, embedder.dimension), pa.int32()), pa.array(vectors.ravel().astype(np.float32)))

    # not deterministic for Spark, so that no text is embedded twice; only the inputs go to Python
    return chunks.withColumn("values", F.arrow_udf(run, "array<float>").asNondeterministic()(text))


class Engine:
    """Sources to index to results.

    `staging` brings remote sources to files; its folder must be shared on a cluster.
    """

    def __init__(self, spark: SparkSession, index_path: str, embedder: HashingEmbedder | None = None, name: str = "docs", staging: Staging | None = None, cap: TokenCap | None = None):
        self.spark, self.embedder, self.name, self.cap = spark, embedder or HashingEmbedder(), name, cap
        self.index = VectorIndex(spark, index_path, self.embedder.dimension)
        self.terms = TermIndex(spark, f"{self.index.path}/terms")
        self.staging = staging or Staging(spark, f"{self.index.path}/_staging")

    def chunks(self, sources: list[Source], config: ChunkConfig = ChunkConfig()) -> DataFrame:
        """All chunks, with an `error` column and their place by configuration, file and chunk (`source_ord`); missing optional sources are left out."""
        parts = []
        for i, source in enumerate(sources):
            try:
                files = read_source(source, self.staging)
            except Exception:
                if not source.optional:
                    raise
                files = None
            if files is not None:
                found = parse(files, source, config)
                root = source.path if source.type == "local" else self.staging.roots.get(source.name)
                if source.parser == "openapi" and root:
                    found = with_page_urls(found, self._pages(root), source.base_url)
                parts.append(found.withColumn("source_ord", F.struct(F.lit(i).alias("source"), "file", "place")).drop("file", "place"))
        if not parts:
            raise ValueError("no source could be read")
        return reduce(DataFrame.unionByName, parts)

    def _pages(self, root: str) -> DataFrame:
        """The .mdx files of a folder, in which frontmatter may name operations."""
        return scan(self.spark, root, "mdx")

    def reindex(self, sources: list[Source], config: ChunkConfig = ChunkConfig(), namespace: str = "", dry_run: bool = False, dump: str | None = None, show: Callable[[DataFrame], None] | None = None) -> DataFrame:
        """Parses each source once and publishes all chunks as one version; returns the manifest row.

        A file that cannot be parsed fails its source: an optional one is left as it
        was, any other ends the run before anything is published.  A dry run stops
        before the vectors.  What is published is also what `dump` gets, and what `show`
        gets the first of.
        """
        path = f"{self.index.path}/_chunks-{uuid.uuid4().hex}"
        try:
            found = self.chunks(sources, config)
            found.write.parquet(path)
            found = self.spark.read.schema(found.schema).parquet(path)
            failed = self._failed(found, sources)
            good = found.filter(F.col("error").isNull() & ~F.col("source").isin(failed))
            if dump:
                write_dump(good.drop("error", "source_ord"), dump)
            if show:
                show(_first(good))
            if not dry_run:
                records = to_records(embed_chunks(good.drop("error"), self.embedder, self.cap), keep=("source", "source_ord"))
                read = {r["source"] for r in found.select("source").distinct().collect()}  # one row per source
                self.index.replace(records, sorted(read - set(failed)), namespace)
            return self.spark.createDataFrame(manifest(good).collect(), "totalChunks bigint, categories array<string>, sources array<string>")
        finally:
            self.index.remove(path)
            self.staging.cleanup()

    def _failed(self, found: DataFrame, sources: list[Source]) -> list[str]:
        of = {x.name: x for x in sources}
        bad = found.filter("error is not null").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("error").alias("error")).collect()  # one row per source
        failed = []
        for r in bad:
            if of[r["source"]].parser in ISOLATED:
                continue
            if not of[r["source"]].optional:
                raise SourceError(f"{r['n']} files of source {r['source']} failed, among them: {r['error']}")
            failed.append(r["source"])
        return failed

    def preview(self, sources: list[Source], config: ChunkConfig = ChunkConfig(), n: int = 3) -> DataFrame:
        """The first n chunks as a dry run shows them."""
        return _first(self.chunks(sources, config).filter("error is null"), n)

    def index_terms(self) -> TermIndex:
        """Builds the inverted index of the records' titles, headings and contents, for hybrid searches."""
        m = lambda k: F.coalesce(F.col(f"metadata.{k}"), F.lit(""))
        text = F.concat_ws("\n", m("documentTitle"), m("heading"), m("content"))
        return self.terms.build(self.index.read().select("id", text.alias("content")))

    def search_hybrid(self, query: str, limit: int | None = None, namespace: str | None = None) -> DataFrame:
        """Results of a pool from both the vectors and the terms (``index_terms``), reranked by BM25 over the whole corpus."""
        vector = self._query(query)
        near = s.top_k(self.index.candidates(vector, namespace), vector, FUSED_RANKS).select("id", "score")
        near = near.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "id")))
        pool = fuse(s.RERANK_POOL, near, self.terms.top_k(query, FUSED_RANKS))
        return s.search(self.index.read(namespace), lambda _: vector, query, limit, rerank=self.terms.scorer(), among=pool)

    def search(self, query: str, limit: int | None = None, namespace: str | None = None, exact: bool = False) -> DataFrame:
        """Results from the lists that the index probes, or with `exact` from all of its records."""
        vector = self._query(query)
        return s.search(self.index.candidates(vector, namespace, 0 if exact else None), lambda _: vector, query, limit)

    def _query(self, text: str) -> list[float]:
        found = self.embedder.embed(text, "query")
        if len(found) != self.index.dimension:
            raise ValueError(f"the query has {len(found)} dimensions, the index {self.index.dimension}")
        return found

    def search_text(self, query: str, limit: int | None = None, exact: bool = False) -> str:
        return s.format_results(self.search(query, limit, exact=exact), query, self.name).first()["text"]

    def push(self, put: Callable[[str, list[dict]], None], namespace: str = "", batch_size: int = BATCH, delay_ms: int = 0) -> None:
        """Sends the index's records to a hosted one, `put(namespace, records)`, in batches with retries."""
        send(self.index.read(namespace).select("id", "values", "metadata"), put, namespace, batch_size, delay_ms)

    def export_text(self, dump: str, path: str, overwrite: bool = False) -> None:
        """The text export of a chunk dump."""
        s.export_text(read_chunk_dump(self.spark, dump), path, ["documentPath", "id"], overwrite)

    def clear(self, force: bool = False, interactive: bool = False, answer: str | None = None) -> tuple[bool, str]:
        """Empties the index if the deletion is forced, or confirmed by the index's name; whether it was, and why."""
        ok, why = resolve_deletion(force, interactive, self.name, answer)
        if ok:
            self.index.clear()
        return ok, why


def _first(chunks: DataFrame, n: int = 3) -> DataFrame:
    return chunks.orderBy("source_ord", "documentPath", "id").limit(n).select("heading", F.col("documentPath").alias("path"), "category", F.length("content").alias("size"))


def manifest(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count(F.lit(1)).alias("totalChunks"), F.array_sort(F.collect_set("category")).alias("categories"), F.array_sort(F.collect_set("source")).alias("sources"))


def write_dump(chunks: DataFrame, path: str) -> None:
    """The chunk dump as JSON lines beside its manifest; ``read_chunk_dump`` reads it back."""
    chunks.write.mode("overwrite").json(f"{path}/chunks")
    manifest(chunks).write.mode("overwrite").json(f"{path}/manifest")
