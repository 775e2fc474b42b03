"""The library's own queries over the driver's tables, each with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sql
from ..functions import text as tx
from ..functions.vectors import HashingEmbedder, assert_dimension, cosine, dot, round_score
from ..model import RECORD_METADATA, ChunkConfig
from ..operators.chunking import chunk_rows, mdx_chunks
from ..operators.html import html_documents, pages_markdown
from ..operators.markdown import changelog_chunks_of, markdown_documents, section_chunks
from ..operators.openapi import openapi_documents, with_doc_urls
from ..operators.outline import line_sections
from ..operators.runs import pack_runs
from ..operators.specs import resolved_operations
from ..sources.files import read_chunk_dump, select_files
from ..sources.links import extract_links, link_table, page_path
from . import search
from .engine import embed_chunks, manifest, with_page_urls, write_dump
from .index import VectorIndex, keep_last, to_records
from .scratch import shared_folder
from .terms import TermIndex, fuse

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The white space that Columns and Python's strings trim (``text.js_trim``, ``text.trimmed``), as SQL; an escape E'\\v' would be the letter v.
_SPACES = " || ".join(f"chr({ord(c)})" for c in tx.SPACES)
_SPACES_STR = _SPACES + " || " + " || ".join(f"chr({c})" for c in range(28, 32))

# --- vectors ------------------------------------------------------------------

_Q = "(select embedding::double[] q from embeddings where vec_id = 0)"
_COS = "list_dot_product(embedding::double[], q) / (sqrt(list_dot_product(embedding::double[], embedding::double[])) * sqrt(list_dot_product(q, q)))"


def _first_vector(vectors: DataFrame) -> DataFrame:
    return vectors.filter("vec_id = 0").select(F.col("embedding").alias("query"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    v = t(spark, d, "embeddings")
    return v.join(F.broadcast(_first_vector(v))).withColumn("score", cosine(F.col("embedding"), F.col("query")))


@query(f"select vec_id, label, floor(({_COS}) * 100 + 0.5) / 100 score from embeddings, {_Q} order by ({_COS}) desc, vec_id limit 10")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    best = _scored(spark, d).orderBy(F.col("score").desc(), "vec_id").limit(search.clamp_k(None))
    return best.select("vec_id", "label", round_score(F.col("score")).alias("score"))


@query(f"select label, vec_id, r rank from (select label, vec_id, row_number() over (partition by label order by round({_COS}, 9) desc, vec_id) r from embeddings, {_Q}) where r <= 3")
def vector_topk_by_label(spark: SparkSession, d: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.round("score", 9).desc(), "vec_id"))
    return _scored(spark, d).withColumn("rank", rank).filter("rank <= 3").select("label", "vec_id", "rank")


@query(f"""select q, vec_id, r rank from (
  select a.vec_id q, b.vec_id, row_number() over (partition by a.vec_id order by round(list_dot_product(a.embedding::double[], b.embedding::double[]), 9) desc, b.vec_id) r
  from embeddings a, embeddings b where a.vec_id % 100 = 0) where r <= 5""")  # fmt: skip
def vector_topk_batch(spark: SparkSession, d: str) -> DataFrame:
    v = t(spark, d, "embeddings")
    asked = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    found = search.top_k_each(v, asked, 5, "vec_id", "embedding", "dot", 9)
    return found.select(F.col("query_id").alias("q"), "vec_id", "rank")


@query(f"select vec_id, label from (select vec_id, label, {_COS} s from embeddings, {_Q} order by s desc, vec_id limit 30) order by label desc, s desc, vec_id limit 20")
def clamped_overfetch(spark: SparkSession, d: str) -> DataFrame:
    pool = _scored(spark, d).orderBy(F.col("score").desc(), "vec_id").limit(search.RERANK_POOL)
    return pool.orderBy(F.col("label").desc(), F.col("score").desc(), "vec_id").limit(search.clamp_k(500)).select("vec_id", "label")


@query("select len(embedding)::int dimension, count(*) n, count(*) filter (abs(sqrt(list_dot_product(embedding::double[], embedding::double[])) - 1) < 1e-5) n_unit, case when len(embedding) in (64, 256) then 'ok' else 'mismatch' end status from embeddings group by len(embedding)")
def dimension_check(spark: SparkSession, d: str) -> DataFrame:
    v = t(spark, d, "embeddings").select(F.size("embedding").alias("dimension"), F.sqrt(dot("embedding", "embedding")).alias("norm"))
    return v.groupBy("dimension").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs(F.col("norm") - 1) < 1e-5).alias("n_unit")).withColumn("status", F.when(F.col("dimension").isin(64, 256), F.lit("ok")).otherwise(F.lit("mismatch")))


# --- text functions -----------------------------------------------------------


@query(r"""select doc_id, regexp_replace(source || '/' || lang || '#' || doc_id, '[^a-zA-Z0-9_-]', '_', 'g') id,
  case when length(text) > 8000 then substr(text, 1, 8000) || '...' else text end content, source "sourceUrl" from documents""")  # fmt: skip
def record_projection(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents")
    return docs.select("doc_id", tx.sanitize_id(F.concat_ws("", "source", F.lit("/"), "lang", F.lit("#"), F.col("doc_id").cast("string"))).alias("id"), tx.truncate_content(F.col("text")).alias("content"), F.col("source").alias("sourceUrl"))


@query(r"""select d.doc_id, concat_ws(chr(10) || chr(10), 'SDK: ' || nullif(source, ''), 'Language: ' || nullif(lang, ''), 'Document ' || d.doc_id, case quality when 1 then 'good' when 0 then 'bad' end, nullif(text, '')) input
  from documents d left join labels l on d.doc_id = l.doc_id""")  # fmt: skip
def embedding_input(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id", "left")
    none = F.lit(None).cast("string")
    title = F.concat(F.lit("Document "), F.col("doc_id").cast("string"))
    about = F.when(F.col("quality") == 1, F.lit("good")).when(F.col("quality") == 0, F.lit("bad"))
    return rows.select("doc_id", tx.embedding_text(title, title, F.col("text"), F.col("lang"), F.col("source"), none, none, about).alias("input"))


@query(r"""with raw as (select doc_id, '`' || split_part(text, ' ', 1) || '` **' || source || '** *' || split_part(text, ' ', 2) || '*  [' || lang || '](http://x/' || doc_id || ') ' || split_part(text, ' ', 3) x from documents)
  select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '`([^`]+)`', '\1', 'g'), '\*\*([^*]+)\*\*', '\1', 'g'), '\*([^*]+)\*', '\1', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '\s+', ' ', 'g')) heading from raw""")  # fmt: skip
def clean_heading(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents")
    word = lambda k: F.coalesce(F.get(F.split("text", " "), k), F.when(F.col("text").isNotNull(), F.lit("")))
    raw = F.concat(F.lit("`"), word(0), F.lit("` **"), "source", F.lit("** *"), word(1), F.lit("*  ["), "lang", F.lit("](http://x/"), F.col("doc_id").cast("string"), F.lit(") "), word(2))
    return docs.select("doc_id", tx.clean_heading(raw).alias("heading"))


@query(r"""select doc_id, trim(regexp_replace(regexp_replace(text, E'\r\n?', E'\n', 'g'), '(?m)[ \t]+$', '', 'g'), E' \n') body from documents""")
def normalize_whitespace(spark: SparkSession, d: str) -> DataFrame:
    padded = F.concat(F.lit("\r\n  "), F.regexp_replace("text", "\n", " \t\r\n"), F.lit("  \n\n\n\n\n"))
    return t(spark, d, "documents").select("doc_id", tx.normalize_whitespace(tx.normalize_line_endings(padded)).alias("body"))


@query(rf"""with raw as (select doc_id, E'# Title\n\n```\ncode\n```\n\n- a list\n\n> quote\n\n' || text || E'\n\nanother paragraph that is long enough to count' x from documents),
  parts as (select doc_id, x is null nothing, list_transform(regexp_split_to_array(regexp_replace(x, '(?s)```.*?```', '', 'g'), '\n\n+'), lambda p: trim(p, {_SPACES})) ps from raw),
  first as (select doc_id, nothing, list_filter(ps, lambda p: length(p) >= 30 and not (p[1] in ('#', '-', '|', '>', '[')) and not (p[1] = '*' and not starts_with(p, '**')) and not (starts_with(p, '**') and ends_with(p, '**')))[1] p from parts),
  cleaned as (select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(p, '[\s\x0B\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+', ' ', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '`([^`]+)`', '\1', 'g'), '\*\*([^*]+)\*\*', '\1', 'g'), {_SPACES}) x, nothing from first)
  select doc_id, case when nothing then null when length(x) > 200 then substr(x, 1, 197) || '...' else coalesce(x, '') end description from cleaned""")  # fmt: skip
def extract_description(spark: SparkSession, d: str) -> DataFrame:
    built = F.concat(F.lit("# Title\n\n```\ncode\n```\n\n- a list\n\n> quote\n\n"), F.col("text"), F.lit("\n\nanother paragraph that is long enough to count"))
    return t(spark, d, "documents").select("doc_id", tx.extract_description(built).alias("description"))


@query(r"""with raw as (select doc_id, string_split('# ' || source || E'\n```\n' || lang || E'\n```\n' || text || case doc_id % 3 when 0 then E'\n```\ncode ' || doc_id || E'\n```' when 1 then E'\n```\nopen' else '' end, '```') s from documents),
  cut as (select doc_id, list_filter(list_transform(range(1, len(s) + 1), lambda k: case when k % 2 = 0 and k < len(s) then '```' || s[k] || '```' when k % 2 = 1 and k = len(s) - 1 then s[k] || '```' || s[len(s)] when k % 2 = 1 then s[k] end), lambda p: p is not null and p <> '') parts from raw)
  select doc_id, parts, true whole from cut""")  # fmt: skip
def fence_split(spark: SparkSession, d: str) -> DataFrame:
    """Closed fences, open ones and none, behind one that every document has."""
    k = F.col("doc_id") % 3
    tail = F.when(k == 0, F.concat(F.lit("\n```\ncode "), F.col("doc_id").cast("string"), F.lit("\n```"))).when(k == 1, F.lit("\n```\nopen")).otherwise(F.lit(""))
    built = F.concat(F.lit("# "), F.col("source"), F.lit("\n```\n"), F.col("lang"), F.lit("\n```\n"), F.col("text"), tail)
    parts = tx.split_fences(built)
    return t(spark, d, "documents").select("doc_id", parts.alias("parts"), (F.array_join(parts, "") == built).alias("whole"))


@query(r"""select doc_id, 'https://example.com/' || source || '/' || doc_id canonical, 'https://github.com/' || source || '/' || lang || '/blob/main/docs/' || doc_id || '.md' file_url, source || '/docs' context from documents""")
def source_urls(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents")
    key = F.col("doc_id").cast("string")
    marked = F.concat(F.lit("intro\n- **URL**: https://example.com/"), F.col("source"), F.lit("/"), key, F.lit(".\nrest"))
    path = F.concat(F.lit("docs/"), key, F.lit(".md"))
    repo = F.concat("source", F.lit("/"), "lang")
    return docs.select("doc_id", tx.canonical_url(marked).alias("canonical"), tx.file_source_url(F.lit("github"), F.lit(None).cast("string"), repo, F.lit(False), path).alias("file_url"), tx.file_context(F.col("source"), path).alias("context"))


@query(r"""select doc_id, case when doc_id % 3 = 0 then source || ' guide: v1.2.' || doc_id when doc_id % 3 = 1 then source || ' guide: ' || lang else source || ' Documentation' end heading from documents""")
def section_headings(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents")
    k = F.col("doc_id") % 3
    heading = F.when(k == 0, F.concat(F.lit("1.2."), F.col("doc_id").cast("string"), F.lit(" (2024)"))).when(k == 1, F.concat(F.lit("`"), F.col("lang"), F.lit("`"))).otherwise(F.lit("Introduction"))
    crumbs = F.when(k < 2, F.array(F.lit("Introduction"), F.concat("source", F.lit(" guide")), F.lit("api"))).otherwise(F.array(F.lit("Documentation")))
    return docs.select("doc_id", tx.section_heading(heading, crumbs, F.col("source")).alias("heading"))


_PLAIN = "regexp_replace(split_part(text, ' ', {k}), '[^a-zA-Z0-9]', '', 'g') || doc_id"


@query(rf"""with w as (select doc_id, lang, {_PLAIN.format(k=1)} a, {_PLAIN.format(k=2)} b, {_PLAIN.format(k=3)} c from documents)
  select doc_id, case when doc_id % 2 = 0 then '> **Note:** ' || a || E'\n\n#### ' || lang || E'\n\n**' || b || E'**\n ' || c || E'\n\n' || a
    else '> **' || a || ':** ' || b || E'\n\n> ' || c || E'\n\n- **' || lang || '**: ' || a || E'\n' || c end body from w""")  # fmt: skip
def component_cleaning(spark: SparkSession, d: str) -> DataFrame:
    """Both dialects of components, with words of each document in every place."""
    a, b, c = (F.concat(F.regexp_replace(F.coalesce(F.get(F.split("text", " "), k), F.when(F.col("text").isNotNull(), F.lit(""))), "[^a-zA-Z0-9]", ""), F.col("doc_id").cast("string")) for k in range(3))
    say = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    mint = say("---\ntitle: ", b, "\n---\nimport A from 'a';\n<Frame><Note>", a, "</Note></Frame>\n<Card>", c, '</Card>\n<Accordion title="', F.col("lang"), '"></Accordion>\n<Steps><Step title="', b, '"> ', c, "</Step></Steps>\nexport const a = 1;\n", a)
    fuma = say('<Callout title="', a, "\" type='x'> ", b, " </Callout>\n<Callout type=x> ", c, ' </Callout>\n<Cards><Card title="', F.col("lang"), '"> ', a, " </Card></Cards>\n", c)
    return t(spark, d, "documents").select("doc_id", tx.clean_mdx(F.when(F.col("doc_id") % 2 == 0, mint).otherwise(fuma)).alias("body"))


# --- relational steps ---------------------------------------------------------


@query("select doc_id, source from documents where length(text) >= 125")
def min_size_filter(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").filter(F.length("text") >= ChunkConfig().min_size / 2).select("doc_id", "source")


@query("select id, doc_id, n_chars from (select source || ':' || (doc_id % 97) id, doc_id, n_chars, row_number() over (partition by source || ':' || (doc_id % 97) order by doc_id desc) r from documents) where r = 1")
def dedupe_keep_last(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "documents").select(F.concat_ws(":", "source", (F.col("doc_id") % 97).cast("string")).alias("id"), "doc_id", "n_chars")
    return keep_last(rows, "id", "doc_id")


@query('select count(*) "totalChunks", list_sort(list(distinct lang)) categories, list_sort(list(distinct source)) sources from (select lang, source from documents union all select role, \'conversations\' from conversations)')
def category_manifest(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents").select(F.col("lang").alias("category"), "source")
    turns = t(spark, d, "conversations").select(F.col("role").alias("category"), F.lit("conversations").alias("source"))
    return manifest(docs.unionByName(turns))


@query("select count(*) filter (event_type in ('view', 'click')) pass, count(*) filter (event_type in ('signup', 'purchase')) warn, count(*) filter (event_type = 'error') fail, bool_or(event_type = 'error') has_failure from events")
def status_tally(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_type")
    return t(spark, d, "events").agg(F.count_if(e.isin("view", "click")).alias("pass"), F.count_if(e.isin("signup", "purchase")).alias("warn"), F.count_if(e == "error").alias("fail"), F.bool_or(e == "error").alias("has_failure"))


@query(r"""with ops as (select p_partkey k, '/' || lower(split_part(p_brand, '#', 1)) || '/' || p_partkey path, 'GET' m, 'get_' || p_partkey || '_handler' op from part)
  select k, m, case when k % 2 = 0 then 'https://docs.example.com/ref/' || k else 'https://docs.example.com/' || split_part(path, '/', 2) || '/get-' || k end url from ops""")  # fmt: skip
def doc_url_join(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    ops = t(spark, d, "part").select(F.col("p_partkey").alias("k"), F.concat(F.lit("/"), F.lower(F.get(F.split("p_brand", "#"), 0)), F.lit("/"), key).alias("path"), F.lit("get").alias("method"), F.concat(F.lit("get_"), key, F.lit("_handler")).alias("operation_id"))
    urls = ops.filter("k % 2 = 0").select(F.concat(F.lit("GET "), F.col("path")).alias("key"), F.concat(F.lit("https://docs.example.com/ref/"), F.col("k").cast("string")).alias("url"))
    return with_doc_urls(ops, urls, "https://docs.example.com").select("k", F.upper("method").alias("m"), "url")


#: What is added to every page: repeats, upper case, queries, fragments, marks behind links, bare roots, other schemes.
_LINKED = """html || ' see <a href="' || url || '">here</a>, (HTTPS://Docs.Example.COM/Guide/' || page_id % 7 || '?q=1#top) https://docs.example.com/Guide/' || page_id % 7 || '/, [x](http://other' || page_id % 3 || '.example/a/b' || page_id || '#f). https://docs.example.com/ ftp://docs.example.com/x https://docs.example.com/z/' || page_id || '.;' """
_LINKS = """select page_id, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(t, 'https?://[^\\s)\\]"''>,]+'), lambda x: lower(regexp_extract(x, '^(https?://[^/?#]+)', 1)) || regexp_replace(regexp_extract(regexp_replace(x, '[.,;]+$', ''), '^https?://[^/?#]+([^?#]*)', 1), '/+$', '')), lambda x: regexp_matches(x, '^https?://[^/]+/')))) links from linked"""


def _linked_pages(spark: SparkSession, d: str) -> DataFrame:
    key = lambda n=None: (F.col("page_id") if n is None else F.col("page_id") % n).cast("string")
    say = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    text = say(F.col("html"), ' see <a href="', F.col("url"), '">here</a>, (HTTPS://Docs.Example.COM/Guide/', key(7), "?q=1#top) https://docs.example.com/Guide/", key(7), "/, [x](http://other", key(3), ".example/a/b", key(), "#f). https://docs.example.com/ ftp://docs.example.com/x https://docs.example.com/z/", key(), ".;")
    return t(spark, d, "pages").select("page_id", text.alias("text"))


@query(f"with linked as (select page_id, {_LINKED} t from pages) {_LINKS}")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    return _linked_pages(spark, d).select("page_id", extract_links(F.col("text")).alias("links"))


@query(r"select page_id, regexp_replace(regexp_replace(url, '^https?://[^/]+/+', ''), '[?#].*$', '') path from pages where regexp_matches(url, '^https?://[^/]+/+[^?#]')")
def page_paths(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "pages").select("page_id", page_path(F.col("url")).alias("path")).filter("path is not null")


@query("select l_orderkey, l_linenumber, r chunk_index from (select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by l_linenumber) - 1 r from lineitem)")
def running_index(spark: SparkSession, d: str) -> DataFrame:
    index = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")) - 1
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", index.alias("chunk_index"))


@query(rf"""select page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g'), {_SPACES_STR}) title from pages""")
def page_title(spark: SparkSession, d: str) -> DataFrame:
    return pages_markdown(t(spark, d, "pages")).select("page_id", "title")


# --- structure ----------------------------------------------------------------


def _nation_lines(spark: SparkSession, d: str) -> DataFrame:
    """A document per region, line by line: ## nations, ### segments with a line for each of their customers.

    No document is ever one text: line numbers are a place for nation and segment, then the customer's key.
    """
    nations = t(spark, d, "nation").withColumn("place", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_name")))
    rows = t(spark, d, "customer").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))
    segments = rows.groupBy("n_regionkey", "n_name", "place", "c_mktsegment").agg(F.min("c_custkey").alias("first"))
    segments = segments.withColumn("at", F.row_number().over(Window.partitionBy("n_regionkey", "n_name").orderBy("c_mktsegment")))
    place = lambda at: F.shiftleft((F.col("place") * 64 + at).cast("bigint"), 40)
    line = lambda no, text: (F.col("n_regionkey").alias("doc_id"), no.alias("line_no"), text.alias("line"))
    heads = segments.select("n_regionkey", "n_name", "place").distinct()
    parts = [
        heads.select("n_regionkey").distinct().select(*line(F.lit(0).cast("bigint"), F.lit("# Region"))),
        heads.select(*line(place(F.lit(0)), F.concat(F.lit("## "), "n_name"))),
        heads.select(*line(place(F.lit(0)) + 1, F.concat(F.lit("about "), "n_name"))),
        segments.select(*line(place(F.col("at")), F.concat(F.lit("### "), "c_mktsegment"))),
        rows.join(F.broadcast(segments.select("n_name", "c_mktsegment", "at")), ["n_name", "c_mktsegment"]).select(*line(place(F.col("at")) + 1 + F.col("c_custkey"), F.col("c_name"))),
    ]
    return reduce(DataFrame.unionByName, parts)


_TREE = """with leaf as (select n_regionkey, n_name, c_mktsegment, sum(length(c_name)) + count(*) - 1 size from customer join nation on c_nationkey = n_nationkey group by n_regionkey, n_name, c_mktsegment),
  mid as (select n_regionkey, n_name, sum(size) + 6 + length(n_name) size from leaf group by n_regionkey, n_name)
  """


@query(_TREE + "select n_regionkey doc_id, c_mktsegment heading, 3 \"level\", size::bigint subtree_size from leaf union all select n_regionkey, n_name, 2, size::bigint from mid union all select n_regionkey, 'Region', 1, sum(size)::bigint from mid group by 1")
def section_sizes(spark: SparkSession, d: str) -> DataFrame:
    return line_sections(_nation_lines(spark, d)).select("doc_id", "heading", "level", "subtree_size")


@query(_TREE + "select n_regionkey doc_id, c_mktsegment heading, n_name parent from leaf union all select n_regionkey, n_name, 'Region' from mid union all select distinct n_regionkey, 'Region', null from mid")
def section_parents(spark: SparkSession, d: str) -> DataFrame:
    tree = line_sections(_nation_lines(spark, d))
    up = tree.select("doc_id", F.col("section_id").alias("parent_id"), F.col("heading").alias("parent"))
    return tree.join(up, ["doc_id", "parent_id"], "left").select("doc_id", "heading", "parent")


@query("""with x as (select p_brand, p_partkey, length(p_name) n, row_number() over (partition by p_brand order by p_partkey) i from part),
  recursive_pack as (
    with recursive r(p_brand, i, total, batch) as (
      select p_brand, i, n, 0 from x where i = 1
      union all select x.p_brand, x.i, case when r.total + x.n <= 200 then r.total + x.n else x.n end, case when r.total + x.n <= 200 then r.batch else r.batch + 1 end
      from r join x on x.p_brand = r.p_brand and x.i = r.i + 1)
    select * from r)
  select p_brand, batch, count(*) n, max(total)::bigint size from recursive_pack group by p_brand, batch""")  # fmt: skip
def greedy_batches(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring part names packed up to 200 characters."""
    parts = t(spark, d, "part").select("p_brand", "p_partkey", F.length("p_name").alias("n"))
    runs = pack_runs(parts, "p_brand", "p_partkey", "n", 200)
    return runs.groupBy("p_brand", "batch").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("n")).alias("size"))


@query("""with recursive x as (select row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey) i, floor(l_quantity)::bigint n from lineitem),
  p as (select i, n, (sum(n) over (order by i))::bigint s from x),
  e as (select i, greatest(count(*) over w, 1) n, greatest(sum(n) over w, n)::bigint size from p window w as (order by s range between current row and greatest(1000 - n, 0) following)),
  r as (select i, n, size, 0::bigint batch from e where i = 1 union all select e.i, e.n, e.size, r.batch + 1 from r join e on e.i = r.i + r.n)
  select batch, n, size from r""")  # fmt: skip
def one_key_batches(spark: SparkSession, d: str) -> DataFrame:
    """All line items as one key, packed to shipments of 1000 pieces."""
    items = t(spark, d, "lineitem").select(F.lit("all").alias("key"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("at"), F.floor("l_quantity").alias("n"))
    return pack_runs(items, "key", "at", "n", 1000).groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("size"))


def _readme_chunks(spark: SparkSession, d: str) -> DataFrame:
    """CHUNKS of all texts as READMEs, with doc_id and source."""
    docs = t(spark, d, "documents").select("doc_id", F.col("source").alias("context"), F.col("text").alias("content"), F.lit("").alias("url"), F.col("lang").alias("language"))
    return section_chunks(docs, "doc_id").withColumn("source", F.col("metadata.repository"))


@query(rf"""with x as (select doc_id, source, trim(text, {_SPACES}) x from documents),
  y as (select doc_id, source || '/readme#0' id, case when length(x) < 250 then '# Documentation' || chr(10) || chr(10) else '' end || x content from x where length(x) > 50)
  select * from y where length(content) >= 125""")  # fmt: skip
def readme_documents(spark: SparkSession, d: str) -> DataFrame:
    """README chunks of all texts; those of these tables have no headings, so each gives one chunk at most."""
    return _readme_chunks(spark, d).select("doc_id", "id", "content")


@query(r"""select doc_id, concat_ws(chr(10), repeat('-', 40), '## ' || source, 'Heading: ' || lang, 'Source: ' || nullif(source, ''), '', text, '') block from documents""")
def export_text(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    meta = F.struct(F.col("source").alias("sourceUrl"), none.alias("method"), none.alias("path"), none.alias("language"))
    chunks = t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("documentTitle"), F.col("lang").alias("heading"), F.col("text").alias("content"), meta.alias("metadata"))
    return search.export_blocks(chunks).withColumnRenamed("id", "doc_id")


@query(rf"""with x as (select doc_id, source, trim(text, {_SPACES}) x from documents)
  select source || '/README.md' "documentPath", 'Document ' || doc_id heading, case when length(x) < 250 then '## Document ' || doc_id || chr(10) || chr(10) else '' end || x content from x where x <> '' and length(x) + case when length(x) < 250 then 5 + length('Document ' || doc_id) else 0 end >= 125""")  # fmt: skip
def markdown_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of constructed Markdown: a file for every fifty documents of a source, a ## section per document."""
    docs = t(spark, d, "documents")
    section = F.concat(F.lit("## Document "), F.col("doc_id").cast("string"), F.lit("\n"), F.col("text"))
    files = docs.groupBy("source", (F.col("doc_id") / 50).cast("long").alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", section.alias("s")))), lambda x: x["s"]), "\n\n").alias("content"))
    path = F.concat("source", F.lit("/part-"), F.col("part").cast("string"), F.lit(".md"))
    rows = files.select(F.col("source").alias("context"), path.alias("path"), "content", F.lit("https://example.com").alias("url"), F.lit("en").alias("language"))
    return markdown_documents(rows).select("documentPath", "heading", "content")


@query()
def page_markdown_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "pages").select(F.lit("pages").alias("context"), F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").alias("content"), "url", F.lit("en").alias("language"))
    return html_documents(rows).filter("error is null").select("id", "documentTitle", "heading", "content")


@query()
def mdx_sections(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat(F.lit("## Usage\n<Tabs><Tab title=\"One\">"), F.col("text"), F.lit("</Tab><Tab title=\"Two\">"), F.col("text"), F.lit("</Tab></Tabs>\n## Notes\n"), F.col("text"))
    docs = t(spark, d, "documents").select("doc_id", "source", body.alias("body"))
    return chunk_rows(docs, lambda r: mdx_chunks(r["body"] or "", f"{r['source']}/{r['doc_id']}", f"{r['doc_id']}.mdx", "Title", None, r["source"], ""), keep=["doc_id"]).select("doc_id", "id", "heading", "content")


@query()
def openapi_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Specs built from parts, one per brand, rendered to chunks."""
    return openapi_documents(_part_specs(t(spark, d, "part")), "https://docs.example.com").filter("error is null").select("id", "documentTitle", "content")


@query(r"""select 'api/get_part_' || p_partkey id, 'Get Part ' || p_partkey || ' - GET /parts/' || p_partkey title, '## GET /parts/' || p_partkey || E'\n\n### Description\n' || p_name || E'\n\n### Method\nGET\n\n### Endpoint\n/parts/' || p_partkey
    || E'\n\n#### Base URLs\n- https://api.example (live)\n\n### Parameters\n#### Path Parameters\n- **id** (integer) - Required [min: ' || p_size || E']\n#### Query Parameters\n- **brand** (string) - Optional - of the maker (Allowed: `' || p_brand
    || E'`)\n\n### Request Body\n- **n** (integer) - Optional\n\n### Request Example\n```json\n{\n  "n": ' || p_size || E'\n}\n```\n\n### Response\n#### Success Response (200)\nok\n- **name** (string) - Required\n- **made** (Maker) - Optional\n- **tags** (array[string]) - Optional\n\n#### Response Example\n```json\n{\n  "name": "string",\n  "made": {},\n  "tags": [\n    "string"\n  ]\n}\n```\n\n#### Client Error Response (404)\nnone' content from part
  union all select 'api/get_part_' || p_partkey || '/code/python', 'Get Part ' || p_partkey || ' - Python Example', 'Python code example for `GET /parts/' || p_partkey || E'`\n\n```python\nget(' || p_partkey || E')\n```' from part""")  # fmt: skip
def openapi_contents(spark: SparkSession, d: str) -> DataFrame:
    """The rendered chunks of operations with parameters, bodies, references, answers and samples, from every part's columns."""
    key = F.col("p_partkey").cast("string")
    size, say = F.col("p_size").cast("string"), lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    answer = '"responses": {"200": {"description": "ok", "content": {"application/json": {"schema": {"$ref": "#/components/schemas/Part"}}}}, "404": {"description": "none"}}'
    op = say(
        '"/parts/', key, '": {"get": {"operationId": "get_part_', key, '", "summary": ', F.to_json(F.array("p_name")).substr(F.lit(2), F.length(F.to_json(F.array("p_name"))) - 2),
        ', "parameters": [{"name": "id", "in": "path", "required": true, "schema": {"type": "integer", "minimum": ', size, '}}, {"name": "brand", "in": "query", "schema": {"type": "string", "enum": ["', F.col("p_brand"), '"]}, "description": "of the maker"}], ',
        '"requestBody": {"content": {"application/json": {"schema": {"type": "object", "properties": {"n": {"type": "integer", "default": ', size, "}}}}}}, ", answer, ', "x-codeSamples": [{"lang": "Python", "source": "get(', key, ')"}]}}',
    )
    named = '"Part": {"type": "object", "required": ["name"], "properties": {"name": {"type": "string"}, "made": {"$ref": "#/components/schemas/Maker"}, "tags": {"type": "array", "items": {"type": "string"}}}}, "Maker": {"type": "object", "properties": {"mail": {"type": "string", "format": "email"}, "since": {"type": "string", "format": "date"}}}'
    spec = say('{"servers": [{"url": "https://api.example", "description": "live"}], "paths": {', F.array_join(F.collect_list(op), ", "), '}, "components": {"schemas": {', named, "}}}")
    specs = t(spark, d, "part").groupBy(F.floor(F.col("p_partkey") / 100).cast("string").alias("path")).agg(spec.alias("content"))
    return openapi_documents(specs, "https://docs.example.com").select("id", F.col("documentTitle").alias("title"), "content")


def _part_specs(parts: DataFrame) -> DataFrame:
    """(path, content): specs of a hundred operations each, dealt by hash; a spec's size does not grow with the table."""
    n = parts.count()
    key = F.col("p_partkey").cast("string")
    op = F.concat(F.lit('"/parts/'), key, F.lit('": {"get": {"operationId": "get_part_'), key, F.lit('", "summary": "Reads a part", "responses": {"200": {"description": "ok", "content": {"application/json": {"schema": {"$ref": "#/components/schemas/Part"}}}}}}}'))
    spec = F.concat(F.lit('{"paths": {'), F.array_join(F.array_sort(F.collect_list(op)), ", "), F.lit('}, "components": {"schemas": {"Part": {"type": "object", "properties": {"name": {"type": "string"}, "size": {"type": "integer", "minimum": 1}}}}}}'))
    return parts.groupBy(F.pmod(F.xxhash64("p_partkey"), F.lit(-(-n // 100) or 1)).cast("string").alias("path")).agg(spec.alias("content"))


@query("""select (p_partkey // 100)::string spec, '/parts/' || p_partkey path, 'get_part_' || p_partkey operation_id, case when p_partkey % 5 = 0 then 'P' || p_partkey when p_partkey % 5 = 1 and p_partkey - 1 in (select p_partkey from part) then 'P' || (p_partkey - 1) end resolved from part""")
def spec_references(spark: SparkSession, d: str) -> DataFrame:
    """Operations of specs and the schemas that their answers end at, behind references, cycles and gaps."""
    key = F.col("p_partkey")
    name = lambda k: F.concat(F.lit("P"), k.cast("string"))
    say = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    to = lambda n: say('{"$ref": "#/components/schemas/', n, '"}')
    k = key % 5
    schema = F.when(k == 0, F.lit('{"type": "object"}')).when(k.isin(1, 3), to(name(key - 1))).when(k == 2, to(name(key + 1))).otherwise(to(F.lit("Gone")))
    op = say('"/parts/', key.cast("string"), '": {"get": {"operationId": "get_part_', key.cast("string"), '", "responses": {"200": {"content": {"application/json": {"schema": ', to(name(key)), '}}}}}, "summary": "no method"}')
    spec = say('{"paths": {', F.array_join(F.collect_list(op), ", "), '}, "components": {"schemas": {', F.array_join(F.collect_list(say('"', name(key), '": ', schema)), ", "), "}}}")
    specs = t(spark, d, "part").groupBy(F.floor(key / 100).cast("string").alias("path")).agg(spec.alias("content"))
    return resolved_operations(specs).select("spec", "path", "operation_id", "resolved")


@query("""with x as (select p_brand, p_partkey, length(p_name) n, row_number() over (partition by p_brand order by p_partkey) i from part),
  recursive_pack as (
    with recursive r(p_brand, i, total, batch) as (
      select p_brand, i, n, 0 from x where i = 1
      union all select x.p_brand, x.i, case when r.total + x.n <= 500 then r.total + x.n else x.n end, case when r.total + x.n <= 500 then r.batch else r.batch + 1 end
      from r join x on x.p_brand = r.p_brand and x.i = r.i + 1)
    select * from r)
  select p_brand, batch, count(*) n, max(total)::bigint size from recursive_pack group by p_brand, batch""")  # fmt: skip
def sql_batches(spark: SparkSession, d: str) -> DataFrame:
    """Part names packed up to 500 characters, in SQL."""
    sql.register(spark)
    return spark.sql("select * from pack_batches(limit => 500, rows => table(select p_brand, p_partkey, length(p_name) size from {parts}) partition by p_brand order by p_partkey)", parts=t(spark, d, "part"))


@query(rf"""with b as (select doc_id, E'\n# Top\nabout ' || source || E'\n## First\n' || coalesce(text, '') || E'\n### Deep\n' || lang || E'\n## Second\nend' t from documents),
  n as (select doc_id, length(trim((select string_agg(l, chr(10) order by i) from (select unnest(string_split(coalesce(text, ''), chr(10))) l, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) i) q), {_SPACES_STR})) n, length(trim(lang, {_SPACES_STR})) l, length(trim('about ' || source, {_SPACES_STR})) s from documents)
  select doc_id, 'Top' heading, 1 "level", s + n + l + 3 subtree_size from n union all select doc_id, 'First', 2, n + l from n union all select doc_id, 'Deep', 3, l from n union all select doc_id, 'Second', 2, 3 from n""")  # fmt: skip
def sql_outlines(spark: SparkSession, d: str) -> DataFrame:
    """Outlines of whole texts under given headings, in SQL."""
    sql.register(spark)
    text = F.concat(F.lit("\n# Top\nabout "), F.col("source"), F.lit("\n## First\n"), F.coalesce("text", F.lit("")), F.lit("\n### Deep\n"), F.col("lang"), F.lit("\n## Second\nend"))
    docs = t(spark, d, "documents").select("doc_id", text.alias("text"))
    return spark.sql("select d.doc_id, o.heading, o.level, o.subtree_size from {docs} d, lateral outline_sections(d.text) o", docs=docs)


@query(r"""with raw as (select doc_id, string_split('# ' || source || E'\n```\n' || lang || E'\n```\n' || text || case doc_id % 3 when 0 then E'\n```\ncode ' || doc_id || E'\n```' when 1 then E'\n```\nopen' else '' end, '```') s from documents),
  cut as (select doc_id, list_filter(list_transform(range(1, len(s) + 1), lambda k: case when k % 2 = 0 and k < len(s) then '```' || s[k] || '```' when k % 2 = 1 and k = len(s) - 1 then s[k] || '```' || s[len(s)] when k % 2 = 1 then s[k] end), lambda p: p is not null and p <> '') parts from raw)
  select doc_id, (unnest(range(len(parts))))::int part, md5(unnest(parts)) body from cut""")  # fmt: skip
def sql_fences(spark: SparkSession, d: str) -> DataFrame:
    """The parts of fence_split by the table function of SQL."""
    sql.register(spark)
    k = F.col("doc_id") % 3
    tail = F.when(k == 0, F.concat(F.lit("\n```\ncode "), F.col("doc_id").cast("string"), F.lit("\n```"))).when(k == 1, F.lit("\n```\nopen")).otherwise(F.lit(""))
    built = F.concat(F.lit("# "), F.col("source"), F.lit("\n```\n"), F.col("lang"), F.lit("\n```\n"), F.col("text"), tail)
    docs = t(spark, d, "documents").select("doc_id", built.alias("text"))
    return spark.sql("select d.doc_id, p.part, md5(p.body) body from {docs} d, lateral fence_parts(d.text) p", docs=docs)


# --- chunkers on inputs whose chunks SQL can state ------------------------------

_BODY = "left(repeat(source || ' ' || lang || ' ' || doc_id || ' words ', 60), {n})"


def _body(n: int | F.Column) -> F.Column:
    """As many characters as wished, from each document's own columns."""
    once = F.concat("source", F.lit(" "), "lang", F.lit(" "), F.col("doc_id").cast("string"), F.lit(" words "))
    return F.substring(F.repeat(once, 60), F.lit(1), n if isinstance(n, F.Column) else F.lit(n))


def _files(docs: DataFrame, part: F.Column, joiner: str, rows: int = 20) -> DataFrame:
    """(file, source, text): every source's documents in order, `rows` to a file, their parts joined."""
    n = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
    numbered = docs.withColumn("n", n).withColumn("file", F.floor(F.col("n") / rows).cast("int"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("n", part.alias("part")))), lambda x: x["part"])
    return numbered.groupBy("source", "file").agg(F.array_join(parts, joiner).alias("text"))


def _file_chunks(files: DataFrame, rule: Callable[[DataFrame, str], DataFrame], *more: F.Column) -> DataFrame:
    key = F.concat_ws(":", F.col("file").cast("string"), "source")
    rows = files.select(key.alias("key"), F.col("source").alias("context"), F.col("text").alias("content"), F.lit("").alias("url"), F.lit("en").alias("language"))
    named = F.split("key", ":", 2)
    return rule(rows, "key").select(named[1].alias("source"), named[0].cast("int").alias("file"), "heading", "content", *more)


_NUMBERED = "numbered as (select *, row_number() over (partition by source order by doc_id) - 1 n from documents)"


@query(rf"""with {_NUMBERED}, b as (select *, trim({_BODY.format(n="300 + doc_id % 500")}) body from numbered)
  select source, (n // 20)::int file, 'Document ' || doc_id heading, body content from b""")  # fmt: skip
def markdown_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections of 300 to 799 characters under headings: each is a chunk of its own."""
    docs = t(spark, d, "documents")
    part = F.concat(F.lit("## Document "), F.col("doc_id").cast("string"), F.lit("\n"), _body(F.lit(300) + F.col("doc_id").cast("int") % 500))
    return _file_chunks(_files(docs, part, "\n\n"), section_chunks)


@query(rf"""with {_NUMBERED}, v as (
    select source, doc_id, n, n // 20 file, '1.' || n || '.0' version, n % 5 < 2 small,
      '## 1.' || n || E'.0\n' || case when n % 5 < 2 then 'note ' || doc_id else trim({_BODY.format(n="300 + doc_id % 500")}) end body from numbered),
  two as (select *, lead(body) over w next_body, lead(version) over w next_version, lead(small) over w next_small, lag(small) over w and n % 5 = 1 is_second from v window w as (partition by source, file order by n))
  select source, file::int file, case when small and coalesce(next_small, false) then 'Versions ' || next_version || ' - ' || version else 'Version ' || version end heading,
    case when small and coalesce(next_small, false) then body || E'\n\n' || next_body else body end content, version
  from two where not coalesce(is_second, false)""")  # fmt: skip
def changelog_versions(spark: SparkSession, d: str) -> DataFrame:
    """Large versions alone, runs of two small ones together."""
    docs = t(spark, d, "documents")
    body = F.when(F.col("n") % 5 < 2, F.concat(F.lit("note "), F.col("doc_id").cast("string"))).otherwise(_body(F.lit(300) + F.col("doc_id").cast("int") % 500))
    part = F.concat(F.lit("## 1."), F.col("n").cast("string"), F.lit(".0\n"), body)
    return _file_chunks(_files(docs, part, "\n\n"), changelog_chunks_of, F.col("metadata.version").alias("version"))


@query(rf"""with {_NUMBERED}, b as (select *, trim({_BODY.format(n="100 + doc_id % 300")}) body from numbered)
  select source, (n // 20)::int file, 'From ' || doc_id heading, case when length(body) >= 100 then body else '## From ' || doc_id || E'\n\n' || body end content from b where length(body) + case when length(body) >= 100 then 0 else 10 + length(doc_id::varchar) end >= 100""")  # fmt: skip
def migration_sections(spark: SparkSession, d: str) -> DataFrame:
    """Migration guides: sections of 100 characters and more stand alone."""
    docs = t(spark, d, "documents")
    part = F.concat(F.lit("## From "), F.col("doc_id").cast("string"), F.lit("\n"), F.trim(_body(F.lit(100) + F.col("doc_id").cast("int") % 300)))
    return _file_chunks(_files(docs, part, "\n\n"), lambda rows, key: section_chunks(rows, key, migration=True))


@query(rf"""with b as (select doc_id, trim({_BODY.format(n="60 + doc_id * 37 % 1200")}) a, trim({_BODY.format(n="60 + doc_id * 91 % 1200")}) b from documents),
  c as (select *, length(a) + length(b) + 5 + 50 + 100 <= 2000 fits from b)
  select doc_id, doc_id || '#0' id, 'Setup' heading, E'## Setup\n\n### One\n\n' || a || E'\n\n### Two\n\n' || b content from c where fits
  union all select doc_id, doc_id || '#0', 'Setup - One', E'## Setup\n\n### One\n\n' || a from c where not fits
  union all select doc_id, doc_id || '#1', 'Setup - Two', E'## Setup\n\n### Two\n\n' || b from c where not fits""")  # fmt: skip
def mdx_tabs(spark: SparkSession, d: str) -> DataFrame:
    """Two tabs: one chunk where both fit, else one each."""
    k = F.col("doc_id").cast("int")
    a, b = F.trim(_body(F.lit(60) + k * 37 % 1200)), F.trim(_body(F.lit(60) + k * 91 % 1200))
    text = F.concat(F.lit('## Setup\n<Tabs><Tab title="One">'), a, F.lit('</Tab><Tab title="Two">'), b, F.lit("</Tab></Tabs>"))
    docs = t(spark, d, "documents").select("doc_id", text.alias("text"))
    return chunk_rows(docs, lambda r: mdx_chunks(r["text"], str(r["doc_id"]), "p.mdx", "T", None, "c", ""), keep=["doc_id"]).select("doc_id", "id", "heading", "content")


@query(rf"""with b as (select doc_id, trim({_BODY.format(n="100 + doc_id * 37 % 900")}) a, trim({_BODY.format(n="100 + doc_id * 91 % 900")}) b from documents)
  select doc_id, doc_id || '#0' id, 'Use: First' heading, E'## Use\n\n### 1. First\n' || a content from b
  union all select doc_id, doc_id || '#1', 'Use: Second', E'## Use\n\n### 2. Second\n' || b from b
  union all select doc_id, doc_id || '#2', 'More', E'## More\n' || a from b""")  # fmt: skip
def mdx_examples(spark: SparkSession, d: str) -> DataFrame:
    """Numbered examples become chunks of their own; a plain section follows."""
    k = F.col("doc_id").cast("int")
    a, b = F.trim(_body(F.lit(100) + k * 37 % 900)), F.trim(_body(F.lit(100) + k * 91 % 900))
    text = F.concat(F.lit("## Use\n\n### 1. First\n"), a, F.lit("\n\n### 2. Second\n"), b, F.lit("\n\n## More\n"), a)
    docs = t(spark, d, "documents").select("doc_id", text.alias("text"))
    return chunk_rows(docs, lambda r: mdx_chunks(r["text"], str(r["doc_id"]), "p.mdx", "T", None, "c", ""), keep=["doc_id"]).select("doc_id", "id", "heading", "content")


@query(rf"""select doc_id, 'Page ' || doc_id title, '# Page ' || doc_id || E'\n\n## ' || source || E'\n\n' || trim({_BODY.format(n="20 + doc_id % 400")}) || E' **bold** and `code`\n\n- ' || lang || E'\n- [link](https://x.example/' || doc_id || E')\n\n```sql\nselect ' || doc_id || E'\n```' markdown from documents""")
def html_to_markdown_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages with boilerplate around a main element of known parts."""
    key = F.col("doc_id").cast("string")
    say = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    html = say("<html><head><title>Page ", key, "</title></head><body><nav>menu</nav><main><h2>", F.col("source"), "</h2><p>", F.trim(_body(F.lit(20) + F.col("doc_id").cast("int") % 400)), " <b>bold</b> and <code>code</code></p><ul><li>", F.col("lang"), '</li><li><a href="https://x.example/', key, '">link</a></li></ul><pre><code class="language-sql">select ', key, "</code></pre></main><footer>foot</footer></body></html>")
    pages = t(spark, d, "documents").select(F.col("doc_id").alias("page_id"), html.alias("html"))
    return pages_markdown(pages).withColumnRenamed("page_id", "doc_id")


@query(r"""select 'api/get_part_' || p_partkey id, 'GET' m, '/parts/' || p_partkey path, case when p_partkey % 2 = 0 then 'https://docs.example.com/ref/' || p_partkey else 'https://docs.example.com/parts/get-part-' || p_partkey end url from part""")
def openapi_operations(spark: SparkSession, d: str) -> DataFrame:
    """Specs of many operations, every second of which a page's frontmatter names."""
    parts = t(spark, d, "part")
    key = F.col("p_partkey").cast("string")
    pages = parts.filter("p_partkey % 2 = 0").select(F.concat(F.lit("ref/"), key, F.lit(".mdx")).alias("path"), F.concat(F.lit('---\nopenapi: "get /parts/'), key, F.lit('"\n---\nbody')).alias("content"))
    found = openapi_documents(_part_specs(parts), "https://docs.example.com").filter("error is null")
    found = with_page_urls(found, pages, "https://docs.example.com")
    return found.select("id", F.col("metadata.method").alias("m"), F.col("metadata.path").alias("path"), F.col("metadata.sourceUrl").alias("url"))


# --- files, index, dump ---------------------------------------------------------

_PATHS = "case doc_id % 6 when 0 then 'guides/' || source || '/' || doc_id || '.md' when 1 then 'Vendor/' || doc_id || '.MD' when 2 then '.git/' || doc_id || '.html' when 3 then 'web/' || doc_id || '.htm' when 4 then doc_id || '.yaml' else 'a/' || lang || '.mdx' end"


@query(f"""with p as (select doc_id, {_PATHS} path from documents)
  select 'markdown' parser, doc_id, path from p where regexp_matches(path, '(?i)\\.md$') and not regexp_matches(path, '(?i)(^|/)vendor/') union all
  select 'mdx', doc_id, path from p where regexp_matches(path, '\\.(mdx?|MDX?)$') and not path like '%/en.mdx' union all
  select 'html', doc_id, path from p where regexp_matches(path, '(?i)\\.html?$') and not regexp_matches(path, '(^|/)\\.[^/]*/') union all
  select 'openapi', doc_id, path from p where path = (select min(path) from p where regexp_matches(path, '^[^/]*\\.yaml$'))""")  # fmt: skip
def file_discovery(spark: SparkSession, d: str) -> DataFrame:
    """The discovery rules of each parser, with skipped folders and files."""
    docs, key, k = t(spark, d, "documents"), F.col("doc_id").cast("string"), F.col("doc_id") % 6
    path = (
        F.when(k == 0, F.concat(F.lit("guides/"), "source", F.lit("/"), key, F.lit(".md")))
        .when(k == 1, F.concat(F.lit("Vendor/"), key, F.lit(".MD")))
        .when(k == 2, F.concat(F.lit(".git/"), key, F.lit(".html")))
        .when(k == 3, F.concat(F.lit("web/"), key, F.lit(".htm")))
        .when(k == 4, F.concat(key, F.lit(".yaml")))
        .otherwise(F.concat(F.lit("a/"), "lang", F.lit(".mdx")))
    )
    files = docs.select("doc_id", path.alias("path"))
    rules = (("markdown", ("vendor",), ()), ("mdx", (), ("EN.mdx",)), ("html", (), ()), ("openapi", (), ()))
    return reduce(DataFrame.unionByName, [select_files(files, *r).select(F.lit(r[0]).alias("parser"), "doc_id", "path") for r in rules])


@query(f"with linked as (select page_id, {_LINKED} t from pages), raw as (select unnest(links) url from ({_LINKS})) select url from (select distinct url from raw where url like '%://docs.example.com/%') order by url limit 500")
def page_link_table(spark: SparkSession, d: str) -> DataFrame:
    """The pages of one host that a crawl of all pages' links would fetch: the first 500, which is the rule."""
    return link_table(_linked_pages(spark, d), "text", ["docs.example.com"])


def _records(docs: DataFrame) -> DataFrame:
    none = {k: F.lit(None).cast("string").alias(k) for k in RECORD_METADATA}
    meta = none | {"sourceUrl": F.col("source").alias("sourceUrl"), "content": tx.truncate_content(F.col("text")).alias("content"), "heading": F.col("lang").alias("heading")}
    vector = F.array((F.col("doc_id") % 7).cast("float"), F.lit(1.0).cast("float"))
    return docs.select(tx.sanitize_id(F.concat_ws("/", "source", F.col("doc_id").cast("string"))).alias("id"), vector.alias("values"), F.struct(*[meta[k] for k in RECORD_METADATA]).alias("metadata"))


def _two_versions(spark: SparkSession, d: str) -> VectorIndex:
    """All documents as source one, then a third of them again as source two."""
    index, docs = VectorIndex(spark, shared_folder(spark, "index"), 2), t(spark, d, "documents")
    index.upsert(_records(docs), "one", replace_source=True)
    index.upsert(_records(docs.filter("doc_id % 3 = 0").withColumn("lang", F.lit("new"))), "two", replace_source=True)
    return index


_UPSERTED = r"""select regexp_replace(source || '/' || doc_id, '[^a-zA-Z0-9_-]', '_', 'g') id, case when doc_id % 3 = 0 then 'two' else 'one' end source, case when doc_id % 3 = 0 then 'new' else lang end heading, md5(case when length(text) > 8000 then substr(text, 1, 8000) || '...' else text end) content_md5 from documents"""


def _contents(index: VectorIndex) -> DataFrame:
    return index.read().select("id", "source", F.col("metadata.heading").alias("heading"), F.md5("metadata.content").alias("content_md5"))


@query(_UPSERTED)
def index_upsert(spark: SparkSession, d: str) -> DataFrame:
    """What an index holds after an upsert that replaces a third of its records: two segments, less what is gone."""
    return _contents(_two_versions(spark, d))


@query(_UPSERTED)
def index_compacted(spark: SparkSession, d: str) -> DataFrame:
    """The same index once it is one segment."""
    index = _two_versions(spark, d)
    index.compact()
    return _contents(index)


def _listed(spark: SparkSession, d: str) -> tuple[VectorIndex, DataFrame]:
    """An index of all vectors in inverted lists, and the vectors whose id is divisible by 100 as queries."""
    v = t(spark, d, "embeddings")
    index = VectorIndex(spark, shared_folder(spark, "lists"), 64)
    none = F.struct(*[F.lit(None).cast("string").alias(k) for k in RECORD_METADATA])
    index.upsert(v.select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("values"), none.alias("metadata")))
    index.fit_lists(recall=0.95)
    return index, v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


@query(f"""select q, vec_id, r rank, floor(s * 100 + 0.5) / 100 score from (
  select a.vec_id q, b.vec_id, {_COS.replace("embedding::double[]", "b.embedding::double[]").replace(", q)", ", a.embedding::double[])").replace("(q,", "(a.embedding::double[],")} s, row_number() over (partition by a.vec_id order by s desc, b.vec_id) r
  from embeddings a, embeddings b where a.vec_id % 100 = 0) where r <= 10""")  # fmt: skip
def index_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest of all vectors by the index's exact switch."""
    index, asked = _listed(spark, d)
    found = index.top_k_each(asked, 10, probes=0)
    return found.select(F.col("query_id").alias("q"), F.col("id").cast("bigint").alias("vec_id"), "rank", round_score(F.col("score")).alias("score"))


@query("select count(*) n_queries, 10 k, true reached from embeddings where vec_id % 100 = 0")
def index_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether the probed lists give nine in ten of the true ten nearest of all vectors."""
    index, asked = _listed(spark, d)
    exact, probed = index.top_k_each(asked, 10, probes=0), index.top_k_each(asked, 10)
    held = exact.join(probed.select("query_id", "id", F.lit(1).alias("found")), ["query_id", "id"], "left")
    return held.agg(F.count_distinct("query_id").alias("n_queries"), F.lit(10).alias("k"), (F.count("found") >= 0.9 * F.count(F.lit(1))).alias("reached"))


@query("select 'full' step, count(*) n, 2 dimension from documents union all select 'cleared', 0, 2")
def index_stats(spark: SparkSession, d: str) -> DataFrame:
    """Counts of an index before and after it is cleared."""
    index = _two_versions(spark, d)
    full = index.stats()
    index.clear()
    none = index.stats()
    return spark.createDataFrame([("full", full["vectorCount"], full["dimension"]), ("cleared", none["vectorCount"], none["dimension"])], "step string, n bigint, dimension int")


_BM25 = r"""words as (select doc_id id, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9_]+')) term from documents),
  tf as (select id, term, count(*) tf from words where term <> '' group by id, term),
  lengths as (select doc_id id, coalesce(n, 0)::double length from documents left join (select id, sum(tf) n from tf group by id) x on x.id = doc_id),
  df as (select term, count(*) df from tf group by term),
  asked as (select distinct q, term from (select q, unnest(string_split_regex(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9_]+')) term from queries) where term <> ''),
  scored as (select q, id, round(sum(ln(1 + ((select count(*) from documents) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / (select avg(length) from lengths)))), 9) bm25
    from asked join tf using (term) join df using (term) join lengths using (id) group by q, id),
  lexical as (select q, id, bm25, row_number() over (partition by q order by bm25 desc, id) r from scored)"""


def _terms(spark: SparkSession, d: str) -> TermIndex:
    return TermIndex(spark, shared_folder(spark, "terms")).build(t(spark, d, "documents"), "doc_id", "text")


@query(f"with queries as (select item_id q, substr(text, 1, 60) t from benchmark), {_BM25} select q, id doc_id, r rank, round(bm25, 6) score from lexical where r <= 5")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """The five documents of highest BM25 for the beginning of each benchmark item."""
    asked = t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.substring("text", 1, 60).alias("query"))
    found = _terms(spark, d).top_k_each(asked, 5)
    return found.select(F.col("query_id").alias("q"), F.col("id").alias("doc_id"), "rank", F.round("bm25", 6).alias("score"))


@query(f"""with queries as (select doc_id q, substr(text, 1, 60) t from documents join embeddings on vec_id = doc_id where doc_id % 100 = 0), {_BM25},
  near as (select a.vec_id q, b.vec_id id, row_number() over (partition by a.vec_id order by round(list_dot_product(a.embedding::double[], b.embedding::double[]), 9) desc, b.vec_id) r from embeddings a join documents on doc_id = a.vec_id, embeddings b where a.vec_id % 100 = 0),
  fused as (select q, id, round(sum(1.0::double / (60 + r)), 9) fused from (select q, id, r from lexical where r <= 30 union all select q, id, r from near where r <= 30) group by q, id)
  select q, id, r rank from (select q, id, row_number() over (partition by q order by fused desc, id) r from fused) where r <= 10""")  # fmt: skip
def hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    """Terms and vectors fused by rank, for the documents whose id is divisible by 100 and that have a vector."""
    docs, v = t(spark, d, "documents"), t(spark, d, "embeddings")
    asked = docs.filter("doc_id % 100 = 0").join(v, F.col("doc_id") == F.col("vec_id")).select(F.col("doc_id").alias("query_id"), F.substring("text", 1, 60).alias("query"), "embedding")
    near = search.top_k_each(v, asked.select("query_id", F.col("embedding").alias("query")), 30, "vec_id", "embedding", "dot", 9)
    lexical = _terms(spark, d).top_k_each(asked.select("query_id", "query"), 30)
    found = fuse(10, near.select("query_id", F.col("vec_id").alias("id"), "rank"), lexical, by=("query_id",))
    return found.select(F.col("query_id").alias("q"), "id", "rank")


@query(rf"""with x as (select doc_id, source, trim(text, {_SPACES}) x from documents),
  y as (select source || '/' || doc_id id, source, case when length(x) < 250 then '# Documentation' || chr(10) || chr(10) else '' end || x content from x where length(x) > 50)
  select id, source, content, '' url from y where length(content) >= 125""")  # fmt: skip
def chunk_dump(spark: SparkSession, d: str) -> DataFrame:
    """Chunks written as a dump and read back."""
    chunks = _readme_chunks(spark, d).withColumn("id", F.concat_ws("/", "source", F.col("doc_id").cast("string"))).drop("doc_id", "index")
    path = shared_folder(spark, "dump")
    write_dump(chunks, path)
    return read_chunk_dump(spark, path).select("id", "source", "content", F.col("metadata.sourceUrl").alias("url"))


@query("select doc_id, 64 n, true unit from documents")
def embedded_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk keeps its own vector, of the right size and of length 1."""
    none = F.lit(None).cast("string")
    meta = F.struct(*[none.alias(k) for k in ("description", "sourceUrl", "method", "path", "language", "repository", "version")])
    docs = t(spark, d, "documents")
    key = F.col("doc_id").cast("string")
    chunks = docs.select(key.alias("id"), F.lit("p").alias("documentPath"), "source", F.col("source").alias("documentTitle"), F.col("lang").alias("category"), key.alias("heading"), F.col("text").alias("content"), meta.alias("metadata"))
    found = embed_chunks(chunks, HashingEmbedder(64)).withColumn("values", assert_dimension("values", 64))
    return found.select(F.col("id").cast("bigint").alias("doc_id"), F.size("values").alias("n"), (F.abs(dot("values", "values") - 1) < 1e-5).alias("unit"))


@query(r"""with top as (select *, row_number() over (order by n_chars desc, doc_id) rank from documents qualify rank <= 5)
  select '# docs Documentation' || chr(10) || '> Query: longest' || chr(10) || '> Results: ' || count(*) || chr(10) || chr(10)
    || string_agg(concat_ws(chr(10), repeat('-', 40), '## ' || source, 'Source: ' || lang, '', doc_id, ''), chr(10) order by rank) "text" from top""")  # fmt: skip
def result_text(spark: SparkSession, d: str) -> DataFrame:
    """The text form of the five longest documents."""
    docs = t(spark, d, "documents")
    rank = F.row_number().over(Window.orderBy(F.col("n_chars").desc(), "doc_id"))
    none = F.lit(None).cast("string")
    top = docs.orderBy(F.col("n_chars").desc(), "doc_id").limit(5).select(rank.alias("rank"), F.col("source").alias("title"), F.col("lang").alias("url"), F.col("doc_id").cast("string").alias("content"), none.alias("method"), none.alias("path"), none.alias("language"))
    return search.format_results(top, "longest", "docs")


@query()
def e2e_search(spark: SparkSession, d: str) -> DataFrame:
    """Documents chunked, embedded by feature hashing, searched, reranked and projected."""
    chunks = _readme_chunks(spark, d).withColumn("id", F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit("#"), F.col("index").cast("string")))
    embedder = HashingEmbedder(64)
    records = to_records(embed_chunks(chunks, embedder))
    return search.search(records, embedder.embed, "the thing that was there", 10).select("rank", "id", "score", "title", "heading")
