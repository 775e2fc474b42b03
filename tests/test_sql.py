"""Table functions of SQL against the DataFrame calls, and specs as VARIANT tables."""

import json

import pytest

from docgrove.functions import sql
from docgrove.operators import runs
from docgrove.operators.markdown import markdown_documents
from docgrove.operators.outline import section_tree
from docgrove.operators.specs import operations, references, resolved_operations, schemas

LOREM = "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor. "


@pytest.fixture(scope="module")
def session(spark):
    sql.register(spark)
    return spark


def test_markdown_chunks(session):
    rows = [("a.md", "# A\n\n" + LOREM * 5 + "\n## B\n" + LOREM * 40), ("CHANGELOG.md", f"## 1.0\n{LOREM * 6}\n## 0.9\n{LOREM * 6}"), ("none.md", None), ("empty.md", "")]
    files = session.createDataFrame(rows, "path string, content string")
    got = session.sql("select f.path, c.heading, c.content, c.source_url from {files} f, lateral markdown_chunks(f.content, f.path, 'https://d.example') c", files=files)
    same = markdown_documents(files.selectExpr("'' context", "path", "content", "'https://d.example' url", "'unknown' language"))
    assert sorted((r.heading, r.content, r.source_url) for r in got.collect()) == sorted((r.heading, r.content, r.metadata.sourceUrl) for r in same.collect())
    assert got.count() > 3


def test_outline_sections(session):
    docs = session.createDataFrame([(1, "# A\nx\n## B\nyy\n# C\nzzz"), (2, None), (3, "plain " * 20)], "id int, text string")
    got = session.sql("select d.id, o.heading, o.level, o.subtree_size from {docs} d, lateral outline_sections(d.text) o", docs=docs).collect()
    tree = section_tree(docs, "id").collect()
    assert sorted((r.id, r.heading, r.level, r.subtree_size) for r in got) == sorted((r.id, r.heading, r.level, r.subtree_size) for r in tree)


def test_fence_parts(session):
    text = "a\n```\nb\n```\nc"
    parts = session.sql("select * from fence_parts('a\\n```\\nb\\n```\\nc')").collect()
    assert "".join(r.body for r in sorted(parts, key=lambda r: r.part)) == text and len(parts) == 3


def test_pack_batches(session):
    rows = [(k, i, (i * 7) % 11 if i % 5 else None) for k in ("a", "b") for i in range(40)]
    parts = session.createDataFrame(rows, "k string, pos int, n int")
    got = session.sql("select * from pack_batches(limit => 30, rows => table({parts}) partition by k order by pos)", parts=parts)
    assert got.schema.simpleString() == "struct<k:string,batch:int,n:bigint,size:bigint>"
    same = runs.pack_runs(parts, "k", "pos", "n", 30).groupBy("k", "batch").agg({"*": "count", "n": "sum"}).collect()
    assert sorted((r.k, r.batch, r.n, r["size"]) for r in got.collect()) == sorted((r.k, r.batch, r["count(1)"], r["sum(n)"]) for r in same)
    for bad in ("limit => 'x', rows => table({parts}) partition by k order by pos", "limit => 3, rows => 4"):
        with pytest.raises(Exception, match="pack_batches takes|integer constant"):
            session.sql(f"select * from pack_batches({bad})", **({"parts": parts} if "{parts}" in bad else {})).collect()


def test_specs_as_variants(spark):
    ref = lambda n: {"$ref": f"#/components/schemas/{n}"}
    answer = lambda s: {"responses": {"200": {"content": {"application/json": {"schema": s}}}}}
    spec = {
        "paths": {"/a": {"get": {"operationId": "a", "summary": "A"} | answer(ref("One")), "x-other": {}, "parameters": []}, "/b": {"post": answer({"type": "object"}), "delete": {}}, "/c": {"put": answer(ref("Loop1"))}, "/d": None},
        "components": {"schemas": {"One": ref("Two"), "Two": ref("End"), "End": {"type": "object"}, "Loop1": ref("Loop2"), "Loop2": ref("Loop1"), "Self": ref("Self"), "Gap": ref("Gone")}},
    }
    specs = spark.createDataFrame([("s", json.dumps(spec)), (None, json.dumps(spec)), ("bad", "{"), ("list", "[1]"), ("none", None), ("bare", "{}")], "path string, content string")
    found = sorted((r.spec or "", r.path, r.method, r.operation_id, r.ref) for r in operations(specs).collect())
    one = [("/a", "get", "a", "One"), ("/b", "delete", None, None), ("/b", "post", None, None), ("/c", "put", None, "Loop1")]
    assert found == sorted((s, *x) for s in ("", "s") for x in one)
    ends = {(r.spec, r.name): r.resolved for r in references(schemas(specs)).collect()}
    assert {n: ends["s", n] for n in spec["components"]["schemas"]} == {"One": "End", "Two": "End", "End": "End", "Loop1": None, "Loop2": None, "Self": None, "Gap": None}
    assert {k[0] for k in ends} == {"s", None} and len(ends) == 14
    got = {(r.spec, r.path, r.method): r.resolved for r in resolved_operations(specs).collect()}
    assert got["s", "/a", "get"] == got[None, "/a", "get"] == "End" and got["s", "/c", "put"] is None and len(got) == 8


def test_references_of_any_number_and_length(spark):
    ring = [("ring", f"R{i}", f"R{(i + 1) % 7}") for i in range(7)]
    line = [("line", f"L{i}", f"L{i + 1}" if i < 1500 else None) for i in range(1501)]
    rows = [*ring, *line, ("twice", "A", None), ("twice", "A", "B"), ("twice", "B", "A"), ("twice", "B", None), (None, "A", "C"), (None, "C", None)]
    limit = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "100")
    try:
        found = [(r.spec, r.name, r.resolved) for r in references(spark.createDataFrame(rows, "spec string, name string, ref string")).collect()]
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", limit)
    want = [*(("ring", f"R{i}", None) for i in range(7)), *(("line", f"L{i}", "L1500") for i in range(1501)), ("twice", "A", "A"), ("twice", "A", "B"), ("twice", "B", "B"), ("twice", "B", "B"), (None, "A", "C"), (None, "C", "C")]
    key = lambda r: tuple(x or "" for x in r)
    assert sorted(found, key=key) == sorted(want, key=key)
