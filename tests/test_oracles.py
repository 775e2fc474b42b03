"""Queries against their SQL on texts whose ends and sections are unusual."""

import os

import duckdb
import pytest

from docgrove.plans import queries

WORDS = "some words of a text that is long enough to be a chunk of its own "
TEXTS = ["vital " + WORDS * 3 + "end v", "\x0b　 " + WORDS * 2 + "mid dle    \x0b", "﻿v" + WORDS * 5, WORDS * 2 + "\x0b\x85", "short", None, ""]
TITLES = ["Than &amp;&amp", "a &quot;b&quot c &lt;x&gt; &am", "　v &amp;lt; \x0b"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    docs = [(i + 1 if i < 20 else 300 * i, TEXTS[i % len(TEXTS)], "en", f"src{i % 2}") for i in range(40)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string").write.parquet(f"{at}/documents.parquet")
    pages = [(i, f"https://a.example/{i}", f"<html><head><title> {t} </title></head><body><p>x</p></body></html>") for i, t in enumerate(TITLES)]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(f"{at}/pages.parquet")
    return at


@pytest.mark.parametrize("name", ["chunk_dump", "extract_description", "markdown_chunks", "migration_sections", "page_title", "readme_documents", "sql_outlines"])
def test_query_and_sql_agree(spark, tables, name):
    con = duckdb.connect()
    for f in os.listdir(tables):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{tables}/{f}/*.parquet')")
    found = queries.QUERIES[name](spark, tables)
    want = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    key = lambda rows: sorted(map(repr, rows))
    assert key([tuple(r) for r in found.select(*columns).collect()]) == key(want.fetchall())
