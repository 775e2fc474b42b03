"""Outlines, chunkers, HTML and OpenAPI."""

import json
import random

import pytest

from docgrove.model import ChunkConfig
from docgrove.operators import chunking as ch
from docgrove.operators import html as h
from docgrove.operators import openapi as oa
from docgrove.operators.outline import outline, section_tree

LOREM = "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor. "


def test_native_tree_equals_outline(spark):
    rng = random.Random(11)
    texts = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(0, 25)):
            k = rng.random()
            lines.append("#" * rng.randint(1, 7) + rng.choice([" ", "", "  "]) + "head" if k < 0.5 else rng.choice(["", "text " * rng.randint(0, 20), "\ttab"]))
        texts.append((i, "\n".join(lines)))
    got = {}
    for r in section_tree(spark.createDataFrame(texts, "doc_id int, text string")).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, text in texts:
        o = outline(text)
        found = sorted(got.get(i, []), key=lambda r: r.section_id)
        assert [(r.heading, r.level, r.content, r.subtree_size) for r in found] == list(zip(o.heading, o.level, o.content, o.size))
        place = {r.section_id: k for k, r in enumerate(found)}
        for k, r in enumerate(found):
            parents = [p for p in range(k) if k < o.end[p] and k in o.children(p)]
            assert ([place[r.parent_id]] if r.parent_id is not None else []) == parents


def test_fences_hide_headings_on_request():
    text = "# A\n" + "x" * 60 + "\n```\n# not\n```\n"
    assert outline(text).heading == ["A", "not"]
    assert outline(text, fence_aware=True).heading == ["A"]


def test_pack_drops_short_pieces():
    assert ch.pack(["a" * 90, "b" * 5, "c" * 90], 100, 50, 50) == ["a" * 90 + "b" * 5, "c" * 90]
    assert ch.pack(["a" * 10, "c" * 95], 100, 50, 200) == []


def test_readme_splits_and_marks_urls():
    text = "## Payments\nURL: https://a.example/pay\n\n" + LOREM * 8
    found = ch.readme_chunks(text, "https://fallback", "ctx")
    assert {c["metadata"]["sourceUrl"] for c in found} == {"https://a.example/pay"}
    assert {c["metadata"]["sourceUrl"] for c in ch.readme_chunks("## P\n" + LOREM * 8, "https://fallback", "ctx")} == {"https://fallback"}


def test_hierarchy_breadcrumbs_and_batches():
    text = "# Top\n" + "\n".join(f"## S{i}\n" + LOREM * n for i, n in enumerate([1, 1, 30, 1]))
    pieces = ch.hierarchical(outline(text))
    assert [p["heading"] for p in pieces] == ["S0 / S1", "S2", "S3"]
    assert all(p["breadcrumbs"] == ["Top"] for p in pieces)


def test_changelog_keeps_the_run_behind_a_large_version():
    big = "```\n" + "x" * 900 + "\n```\n"
    text = "preamble\n## 1.0.0\nsmall one\n## 0.9.0\n" + big * 3 + "## 0.8.0\nsmall two\n"
    found = ch.changelog_chunks(text, "", "lib")
    assert [c["heading"] for c in found] == ["Version 0.9.0", "Version 0.9.0", "Versions 0.8.0 - 1.0.0"]
    assert "preamble" not in "".join(c["content"] for c in found)
    assert ch.changelog_chunks(text, "", "lib", keep_all=True)[0]["content"] == "preamble"


def test_routing_by_path():
    body = "# T\n" + LOREM * 5
    assert ch.markdown_chunks("x/CHANGELOG.md", "## 1.2.3\n" + LOREM, "", "c")[0]["category"] == "changelog"
    assert ch.markdown_chunks("upgrade/a.md", body, "", "c")[0]["category"] == "migration"
    assert ch.markdown_chunks("a.md", body, "", "c")[0]["category"] == "documentation"


def test_mdx_forms():
    ex = "## Use\nAn introduction that is longer than thirty characters.\n### 1. One\n" + LOREM * 2 + "\n### 2. Two\n" + LOREM * 2
    assert [c["heading"] for c in ch.mdx_chunks(ex, "s", "p", "T", None, "cat", "")] == ["Use: One", "Use: Two"]
    tabs = '## Tabs\n<Tabs><Tab title="A">' + LOREM + '</Tab><Tab title="B">' + LOREM + "</Tab></Tabs>"
    assert [c["heading"] for c in ch.mdx_chunks(tabs, "s", "p", "T", None, "cat", "")] == ["Tabs"]
    split = '## Tabs\n<Tabs><Tab title="A">' + LOREM * 15 + '</Tab><Tab title="B">' + LOREM * 15 + "</Tab></Tabs>"
    assert [c["heading"] for c in ch.mdx_chunks(split, "s", "p", "T", None, "cat", "")] == ["Tabs - A", "Tabs - B"]
    plain = "## Long\n" + "\n\n".join([LOREM * 10] * 4)
    found = ch.mdx_chunks(plain, "s", "p", "T", "about", "cat", "")
    assert [c["heading"] for c in found] == ["Long (Part 1)", "Long (Part 2)"]
    assert all(len(c["content"]) <= 2000 for c in found)


def test_flat_sections_and_merging():
    s = ch.flat_sections("intro\n## A\none\n## B\ntwo")
    assert [x["heading"] for x in s] == ["Introduction", "A", "B"]
    assert ch.merge_small(s)[0]["content"] == "intro\n\n### A\n\none\n\n### B\n\ntwo"
    big = {"heading": "H", "level": 2, "content": "### x\n" + "a" * 1500 + "\n### y\n" + "b" * 1500}
    assert [x["heading"] for x in ch.split_by_subheadings(big)] == ["H: x", "H: y"]
    assert len(ch.fence_parts_by_paragraph("p1\n\np2\n```c```", 3)) == 3


def test_oversized_code_stays_whole():
    code = "```\n" + "x" * 3000 + "\n```"
    assert code in ch.split_oversized("text " * 100 + code + "tail " * 100, 2000)


PAGE = """<html><head><title> T </title><style>x</style></head><body><nav>menu</nav><header>top</header>
<main><h2>Install</h2><p>Run <code>npm i</code> now.</p><pre><code class="language-sh">npm i
x</code></pre><ul><li>one</li><li>two</li></ul></main><footer>foot</footer><script>js()</script></body></html>"""


def test_html_page():
    title, md = h.html_to_markdown(PAGE)
    assert title == "T" and md.startswith("# T\n\n## Install")
    assert "`npm i`" in md and "```sh\nnpm i\nx\n```" in md and "- one\n- two" in md
    assert not any(x in md for x in ("menu", "top", "foot", "js()"))


@pytest.mark.parametrize("inner", ['<div role="main">M</div>', '<div id="content">M</div>', '<div class="a content">M</div>', "<article>M</article>"])
def test_html_containers(inner):
    assert h.html_to_markdown(f"<body><p>side</p>{inner}</body>")[1] == "M"


def test_html_fallbacks():
    assert h.html_to_markdown("<body><h1>Head</h1>x</body>")[0] == "Head"
    assert h.html_chunks("", "a.html", "", "c") == []
    deep = "<div>" * 4000 + "x" * 300 + "</div>" * 4000
    assert h.html_chunks(deep, "a.html", "", "c")


def test_html_ids_and_isolation(spark):
    rows = [("site", f"{p}.html", f"<title>{p}</title><main><h2>A</h2><p>{LOREM * 6}</p></main>", "", "en") for p in ("a", "b", "sub/c")]
    found = h.html_documents(spark.createDataFrame(rows, "context string, path string, content string, url string, language string")).collect()
    assert len({r.id for r in found}) == len(found) >= 3 and len({r.documentPath for r in found}) == 3
    bad = ch.chunk_rows(spark.createDataFrame([("x",), (None,)], "content string"), lambda r: [{"id": r["content"].upper()}]).collect()
    assert sorted(bool(r.error) for r in bad) == [False, True]


SPEC = {
    "servers": [{"url": "https://api.example", "description": "live"}],
    "paths": {
        "/pets/{id}": {
            "get": {
                "operationId": "get_pet_handler", "summary": "Reads", "tags": ["Pets"],
                "parameters": [{"name": "id", "in": "path", "required": True, "schema": {"type": "integer", "minimum": 1}}, {"name": "q", "in": "query", "schema": {"type": "string", "enum": ["a", "b"], "default": "a"}}],
                "responses": {"200": {"description": "ok", "content": {"application/json": {"schema": {"$ref": "#/components/schemas/Pet"}}}}, "404": {"description": "gone"}},
                "x-codeSamples": [{"lang": "Python", "source": "get()"}],
            },
            "delete": {"responses": {}},
        }
    },
    "components": {"schemas": {"Pet": {"type": "object", "required": ["name"], "properties": {"name": {"type": "string", "description": "its name"}, "born": {"type": "string", "format": "date"}, "owner": {"$ref": "#/components/schemas/Loop"}, "tags": {"type": "array", "items": {"type": "string"}}}}, "Loop": {"$ref": "#/components/schemas/Loop"}}},
}


def test_openapi_chunks():
    found = oa.spec_chunks(SPEC, "https://d.example")
    assert [c["id"] for c in found] == ["api/get_pet_handler", "api/get_pet_handler/code/python", "api/delete__pets_{id}"]
    text = found[0]["content"]
    assert "- **id** (integer) - Required [min: 1]" in text and "(Allowed: `a`, `b`) (Default: `a`)" in text
    assert '"born": "2024-01-15"' in text and "#### Client Error Response (404)" in text
    assert found[0]["metadata"]["sourceUrl"] == "https://d.example/pets/get-pet"
    assert found[2]["metadata"]["sourceUrl"] == "https://d.example/pets/delete--pets-{id}"
    with pytest.raises(ValueError):
        oa.spec_chunks(SPEC, "")
    assert oa.endpoint_content(SPEC, "GET", "/pets/{id}/").startswith("## GET")
    assert oa.endpoint_content(SPEC, "PUT", "/pets/{id}") is None


def test_specs_in_json_are_read_as_json(monkeypatch):
    assert oa.load_spec("a: [1, 0x10, ~, 2024]\n") == {"a": [1, 16, None, 2024]} and oa.load_spec('{"a": NaN, b: 1}') == {"a": "NaN", "b": 1} and oa.load_spec("") is None
    assert oa.load_spec('{"a": [1e3, "\\ud83d\\ude00", "2024-01-01", "<<"]}') == {"a": [1000.0, "\U0001f600", "2024-01-01", "<<"]}
    # YAML's parser takes a second for 80 KB
    monkeypatch.setattr(oa, "yaml", None)
    assert oa.load_spec(json.dumps(SPEC)) == SPEC


def test_openapi_examples_stop_at_cycles():
    s = oa.Schemas(SPEC["components"]["schemas"])
    assert s.resolve("#/components/schemas/Loop") is None
    assert s.example({"allOf": [{"type": "object", "properties": {"a": {"type": "integer"}}}, {"type": "object", "properties": {"b": {"type": "boolean"}}}]}) == {"a": 0, "b": True}
    assert s.example({"oneOf": [{"enum": ["x"]}]}) == "x"
    assert oa.type_name({"anyOf": [{"type": "string"}, {"$ref": "#/components/schemas/Pet"}]}) == "string | Pet"


def test_doc_urls(spark):
    files = spark.createDataFrame([("a/x.mdx", '---\nopenapi: "get /pets"\n---'), ("b/y.mdx", "openapi: GET /pets\n"), ("z.md", "openapi: GET /no")], "path string, content string")
    urls = oa.doc_url_map(files, "https://d")
    assert {(r.key, r.url) for r in urls.collect()} == {("GET /pets", "https://d/b/y")}
    ops = spark.createDataFrame([("get", "/pets", "list_pets"), ("post", "/", "make_it_proxy")], "method string, path string, operation_id string")
    assert {r.url for r in oa.with_doc_urls(ops, urls, "https://d").collect()} == {"https://d/b/y", "https://d/misc/make-it"}


def test_config_is_honoured():
    assert len(ch.readme_chunks("## A\n" + LOREM * 4, "", "c", config=ChunkConfig(200, 50, 100))) >= 1
