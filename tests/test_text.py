"""Text functions: literal expectations, and Columns against their Python twins."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docgrove.functions import text as tx
from docgrove.functions.vectors import HashingEmbedder, cosine, reorder_by_index, round_score


def one(spark, f, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(f(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first().x


@pytest.mark.parametrize(
    "f, given_, want",
    [
        (tx.clean_heading, "`code` heading", "code heading"),
        (tx.clean_heading, "[text](http://x) **b** *i*\n\n  z", "text b i z"),
        (tx.normalize_line_endings, "a\r\nb\rc", "a\nb\nc"),
        (tx.normalize_whitespace, "a\n\n\n\n\nb", "a\n\nb"),
        (tx.normalize_whitespace, " a  \nb\t\n﻿", "a\nb"),
        (tx.remove_frontmatter, "---\ntitle: Hello\n---\n# Body", "# Body"),
        (tx.remove_frontmatter, "# Body", "# Body"),
        (tx.convert_callouts, "<Note>x</Note>", "\n> **Note:** x\n"),
        (tx.remove_jsx_tags, "a <Foo bar>b</Foo> <Baz/>", "a b "),
        (tx.remove_imports_exports, "import A from 'a'\nx\n```\nimport B from 'b'\n```", "\nx\n```\nimport B from 'b'\n```"),
        (tx.extract_description, "# H\n\n- list\n\nThis is a prose paragraph with `code` and more words.", "This is a prose paragraph with code and more words."),
        (tx.extract_description, "# only", ""),
        (tx.canonical_url, "text\n- **URL**: https://a.example/x.", "https://a.example/x"),
        (tx.canonical_url, "see URL: https://a.example", None),
        (tx.first_subheading, "a\n### Sub one\n", "Sub one"),
        (tx.sanitize_id, "a/b#1 é", "a_b_1__"),
        (tx.strip_doc_extension, "a/b.MDX", "a/b"),
    ],
)
def test_literals(spark, f, given_, want):
    assert one(spark, f, given_) == want


def test_description_is_cut(spark):
    got = one(spark, lambda c: tx.extract_description(c, 50), "x" * 300)
    assert len(got) == 50 and got.endswith("...")
    assert one(spark, tx.extract_description, None) is None


def test_truncation(spark):
    assert len(one(spark, tx.truncate_content, "y" * 9000)) == 8003


@pytest.mark.parametrize("text", ["a", "a ```x``` b", "```x```", "```x``` y ```z", "a\n```\nb\n```\nc```d```", ""])
def test_fences_join_to_the_text(spark, text):
    parts = one(spark, tx.split_fences, text)
    from docgrove.operators.chunking import fence_parts

    assert parts == fence_parts(text) and "".join(parts) == text


PIECES = ["a", "B c", "\n", "\n\n", "# h", "```", "---", "import x from 'y';", "export z", "<Note>", "</Note>", "<Card>", "</Card>", "<Tab title=\"t\">", "`", "**", "[l](u)", "<Accordion title=\"q\">", "<Step title=\"s\">", "items={[", " ", "\t", "é", "URL: http://u/v.", "<Frame x>", "<Callout title=\"c\">", "</Callout>", "word word word word word word"]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=25).map("".join), min_size=20, max_size=20))
def test_columns_equal_twins(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    c = F.col("t")
    got = df.select("i", tx.clean_mdx(c).alias("mdx"), tx.final_cleanup(c).alias("final"), tx.extract_description(c).alias("about"), tx.canonical_url(c).alias("url"), tx.clean_heading(c).alias("head")).collect()
    for r in got:
        t = texts[r.i]
        assert r.mdx == tx.clean_mdx_str(t)
        assert r.final == tx.apply_str(tx.FINAL, t)
        assert r.about == tx.description_str(t)
        assert r.url == tx.canonical_url_str(t)
        assert r.head == tx.apply_str(tx.HEADING, t)


def test_urls(spark):
    f = lambda kind, base, repo, follow: one(spark, lambda a, b, c, d: tx.file_source_url(a, b, c, d == "y", F.lit("docs/a.md")), kind, base, repo, follow)
    assert f("url", "https://d.example/", None, "y") == "https://d.example/docs/a"
    assert f("url", "https://d.example/", None, "n") == "https://d.example"
    assert f("github", None, "o/r", "n") == "https://github.com/o/r/blob/main/docs/a.md"
    assert f("local", "https://d.example", None, "n") == "https://d.example/docs/a.md"
    assert f("local", None, None, "n") == ""


def test_section_heading(spark):
    f = lambda h, crumbs: one(spark, lambda a: tx.section_heading(a, F.array(*map(F.lit, crumbs)), F.lit("ctx")), h)
    assert f("Use `x`", ["Introduction", "Guide"]) == "Guide: Use x"
    assert f("1.2.3 (2024)", ["api"]) == "v1.2.3"
    assert f("Introduction", ["Documentation"]) == "ctx Documentation"


def test_scores(spark):
    assert one(spark, lambda c: round_score(c.cast("double")), "0.285") == 0.28
    assert one(spark, lambda c: round_score(c.cast("double")), "-0.125") == -0.12
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [round(x[0], 6) if x[0] is not None else None for x in df.select(cosine("a", "b") if False else cosine(F.col("a"), F.col("b"))).collect()] == [0.707107, None]


def test_embedder_and_order():
    v = HashingEmbedder(32).embed("Hello world")
    assert abs(sum(x * x for x in v) - 1) < 1e-9 and v == HashingEmbedder(32).embed("hello  WORLD")
    assert reorder_by_index([{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}], 2) == [[1.0], [2.0]]
    for bad in ([{"embedding": [1.0]}], [{"embedding": []}, {"embedding": [1.0]}], [{"index": 0, "embedding": [1.0]}] * 2):
        with pytest.raises(ValueError):
            reorder_by_index(bad, 2)
    assert re.fullmatch(r"\w+", "ok")


def test_whole_table_queries_leave_out_no_document(spark, tmp_path):
    from docgrove.operators.chunking import fence_parts, readme_chunks
    from docgrove.plans import queries as q

    prose = "Plain prose that is long enough to be a paragraph of its own, " * 3
    texts = [None, "", "x", prose, "`code` and " + prose, "well-known " + prose, "# Head\n" + prose + "\n## Next\n" + prose, "a ```x``` b " + prose, "```\ncode\n```\n" + prose, prose + "\r\n" + prose, "**bold** word", "- item\n\n" + prose, "[l](u) text, " + prose, "> quote"]
    rows = [(i, s, "en", f"s{i % 2}", len(s or "")) for i, s in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))

    def got(name):
        return q.QUERIES[name](spark, str(tmp_path)).collect()

    before, after = "# Title\n\n```\ncode\n```\n\n- a list\n\n> quote\n\n", "\n\nanother paragraph that is long enough to count"
    assert {r.doc_id: r.description for r in got("extract_description")} == {i: None if s is None else tx.description_str(before + s + after) for i, s in enumerate(texts)}
    word = lambda s, k: (s.split(" ") + [""] * 3)[k]
    raw = {i: None if s is None else f"`{word(s, 0)}` **s{i % 2}** *{word(s, 1)}*  [en](http://x/{i}) {word(s, 2)}" for i, s in enumerate(texts)}
    assert {r.doc_id: r.heading for r in got("clean_heading")} == {i: None if s is None else tx.apply_str(tx.HEADING, s) for i, s in raw.items()}
    tail = lambda i: {0: f"\n```\ncode {i}\n```", 1: "\n```\nopen", 2: ""}[i % 3]
    whole = {i: None if s is None else f"# s{i % 2}\n```\nen\n```\n{s}{tail(i)}" for i, s in enumerate(texts)}
    assert {r.doc_id: (r.parts, r.whole) for r in got("fence_split")} == {i: (None, None) if s is None else (fence_parts(s), True) for i, s in whole.items()}
    want = sorted((i, c["id"], c["content"]) for i, s in enumerate(texts) for c in readme_chunks(s or "", "", f"s{i % 2}"))
    assert sorted(tuple(r) for r in got("readme_documents")) == want and len({x[0] for x in want}) > 5
