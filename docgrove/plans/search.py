"""Search: exact cosine top-k with over-fetch and rerank, and the text forms of results."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine, dot, round_score
from . import nearest

DEFAULT_TOP_K, MAX_TOP_K, RERANK_POOL, RERANK_TEXT = 10, 20, 30, 1200
RULE = "-" * 40


def clamp_k(limit: int | None, default: int = DEFAULT_TOP_K, most: int = MAX_TOP_K) -> int:
    return min(max(1, default if limit is None else limit), most)


def top_k(vectors: DataFrame, query: list[float], k: int, id_col: str = "id", vector_col: str = "values") -> DataFrame:
    """The k nearest rows with `score`; ties by id.  The query is a literal, so each task keeps k rows and nothing is shuffled.

    Where the rows have their `norm`, one fold per row is left of the three that cosine needs.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    v = F.col(vector_col)
    if "norm" in vectors.columns:
        norms = F.col("norm") * F.sqrt(dot(q, q))
        score = F.when((norms > 0) & (F.size(v) == F.size(q)), dot(v, q) / norms)
    else:
        score = cosine(v, q)
    return vectors.withColumn("score", score).orderBy(F.col("score").desc(), id_col).limit(k)


#: Queries of a set that meet a share of the vectors at once.
QUERY_BLOCK = 4096


def top_k_each(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vector_col: str = "values", score: str = "cosine", digits: int | None = None, on: str | None = None, per_query: int = 1) -> DataFrame:
    """The k nearest rows for every row of queries (query_id, query), with `score` and `rank`; the vectors themselves are left out.

    The score is `cosine` or `dot`, rounded to digits if given.  Blocks of queries meet
    shares of the vectors (``nearest``), and a share passes on k rows per query and no more.  With
    `on`, a query meets only rows that agree with it in this column; it may have
    `per_query` rows with different values.
    """
    found = nearest.top_k_each(vectors, queries, k, id_col, vector_col, score == "cosine", digits, on, QUERY_BLOCK, per_query)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), id_col))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def result_columns(hits: DataFrame) -> DataFrame:
    m = lambda k: F.col(f"metadata.{k}")
    blank = lambda k: F.coalesce(m(k), F.lit(""))
    return hits.select("id", round_score(F.col("score")).alias("score"), blank("documentTitle").alias("title"), blank("heading").alias("heading"), blank("content").alias("content"), m("sourceUrl").alias("url"), m("method").alias("method"), m("path").alias("path"), m("language").alias("language"), F.col("score").alias("exact_score"))


def rerank_text(title: Column, heading: Column, content: Column) -> Column:
    whole = F.concat(title, F.lit(" - "), heading, F.lit("\n"), content)
    return F.when(F.length(whole) > RERANK_TEXT, F.concat(F.substring(whole, 1, RERANK_TEXT), F.lit("..."))).otherwise(whole)


def lexical_overlap(text: Column, query: str) -> Column:
    """Share of the query's words that the text holds: an offline scorer behind the reranker's interface."""
    words = F.array_distinct(F.filter(F.split(F.lower(F.lit(query)), r"\W+"), lambda w: w != ""))
    held = F.array_intersect(words, F.split(F.lower(text), r"\W+"))
    return F.when(F.size(words) > 0, F.size(held) / F.size(words)).otherwise(F.lit(0.0))


def search(vectors: DataFrame, embed: Callable[[str], list[float]], query: str, limit: int | None = None, rerank: Callable[[Column, str], Column] | None = lexical_overlap, pool: int = RERANK_POOL, among: DataFrame | None = None) -> DataFrame:
    """Result rows in order (`rank` from 1).  Without a reranker, or if it fails, the first k by vector score.

    `among` holds the ids of a pool that another first stage has chosen.

    Only the pool, RERANK_POOL rows, is reranked; it comes to the driver first, so that
    a scorer that fails on the rows fails here and not in the search.
    """
    k = clamp_k(limit)
    if among is not None:
        vectors = vectors.join(F.broadcast(among.select("id")), "id", "left_semi")
    hits = result_columns(top_k(vectors, embed(query), pool if rerank else k))
    order = [F.col("exact_score").desc(), F.col("id")]
    if rerank:
        hits = vectors.sparkSession.createDataFrame(hits.collect(), hits.schema)
        try:
            scored = hits.withColumn("rerank_score", rerank(rerank_text(F.col("title"), F.col("heading"), F.col("content")), query))
            hits = vectors.sparkSession.createDataFrame(scored.collect(), scored.schema)
            order = [F.col("rerank_score").desc(), *order]
        except Exception as e:
            warnings.warn(f"the reranker failed, vector order stands: {type(e).__name__}", stacklevel=2)
    best = hits.orderBy(*order).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def _line(prefix: str, value: Column) -> Column:
    return F.concat(F.lit(prefix), F.nullif(value, F.lit("")))


def _api(method: Column, path: Column) -> Column:
    return F.concat(F.lit("API: "), F.nullif(method, F.lit("")), F.lit(" "), F.nullif(path, F.lit("")))


def result_block() -> Column:
    return F.concat_ws("\n", F.lit(RULE), F.concat(F.lit("## "), F.col("title")), _line("Source: ", F.col("url")), _api(F.col("method"), F.col("path")), _line("Language: ", F.col("language")), F.lit(""), F.col("content"), F.lit(""))


def format_results(results: DataFrame, query: str, server: str) -> DataFrame:
    """One row `text`: header and a block per result; at most MAX_TOP_K rows are gathered."""
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("rank", result_block().alias("block")))), lambda x: x["block"])
    head = F.concat_ws("\n", F.lit(f"# {server} Documentation"), F.lit(f"> Query: {query}"), F.concat(F.lit("> Results: "), F.count(F.lit(1)).cast("string")), F.lit(""))
    return results.agg(F.concat_ws("\n", head, F.array_join(blocks, "\n")).alias("text"))


def chunk_block(chunks: DataFrame) -> Column:
    m = lambda k: F.col(f"metadata.{k}")
    heading = F.when(~F.col("heading").eqNullSafe(F.col("documentTitle")), F.col("heading"))
    return F.concat_ws("\n", F.lit(RULE), F.concat(F.lit("## "), F.col("documentTitle")), _line("Heading: ", heading), _line("Source: ", m("sourceUrl")), _api(m("method"), m("path")), _line("Language: ", m("language")), F.lit(""), F.coalesce("content", F.lit("")), F.lit(""))


def export_blocks(chunks: DataFrame) -> DataFrame:
    """(id, block): the text block of each chunk; order and header are the writer's."""
    return chunks.select("id", chunk_block(chunks).alias("block"))


def export_text(chunks: DataFrame, path: str, order: list[str], overwrite: bool = False) -> None:
    """Writes the text export in order, a part file per range, the header as the first line block."""
    n = chunks.count()
    head = chunks.sparkSession.createDataFrame([(0, f"# Documentation\n> Total chunks: {n}\n")], "part int, block string")
    body = chunks.orderBy(*order).select(F.lit(1).alias("part"), chunk_block(chunks).alias("block"))
    head.coalesce(1).union(body).select("block").write.mode("overwrite" if overwrite else "errorifexists").text(path)
