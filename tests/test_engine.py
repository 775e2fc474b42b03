"""Sources, configuration, index, search and the whole path from files to results."""

import os
from dataclasses import replace
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docgrove.functions.tokens import TokenCap
from docgrove.functions.vectors import HashingEmbedder
from docgrove.model import RECORD_METADATA
from docgrove.plans import search
from docgrove.plans.engine import Engine, SourceError, write_dump
from docgrove.plans.index import VectorIndex, keep_last
from docgrove.sources import config, git, links
from docgrove.sources.files import Source, read_chunk_dump, scan
from docgrove.sources.remote import HttpError, Staging, fetch, read_source
from docgrove.streaming.incremental import index_stream

LOREM = "Words about nothing in particular fill this paragraph so that it is long enough. " * 4


def write(root, files):
    for name, text in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return str(root)


def test_discovery(spark, tmp_path):
    root = write(tmp_path / "d", {"a.md": "x", "Vendor/b.md": "x", "c.MD": "x", "IGNORE.md": "x", ".git/h.html": "x", "p/i.html": "x", "j.htm": "x", "n.txt": "x", "b.yaml": "x", "a.json": "x", "s/c.yaml": "x", "m.mdx": "x"})
    paths = lambda *a: {r.path for r in scan(spark, root, *a).select("path").collect()}
    assert paths("markdown", ("vendor",), ("ignore.md",)) == {"a.md", "c.MD"}
    assert paths("html") == {"p/i.html", "j.htm"}
    assert paths("openapi") == {"a.json"}
    assert "m.mdx" in paths("mdx")


def test_links(spark):
    text = "see https://a.example/x?q=1#f, (https://a.example/x/) https://b.example/y. http://a.example/ and https://a.example/z;"
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(links.extract_links(F.col("t"))).first()[0] == ["https://a.example/x", "https://a.example/z", "https://b.example/y"]
    assert df.select(links.extract_links(F.col("t"), ["b.example"])).first()[0] == ["https://b.example/y"]
    assert [r.url for r in links.link_table(df, "t", None, 2).collect()] == ["https://a.example/x", "https://a.example/z"]
    assert df.select(links.page_path(F.lit("https://a/../b"))).first()[0] is None


def test_file_names():
    assert links.resolve_filename("https://a.example/s/spec.yaml?x=1") == "spec.yaml"
    assert links.resolve_filename("https://a.example/") == "content.yaml"
    assert links.resolve_filename("https://a.example/x", "y.md") == "y.md"
    for bad in ("", " ", "a/b", "..", "a\\b"):
        with pytest.raises(ValueError):
            links.resolve_filename("https://a.example/x", bad)


def test_retry():
    class Http(Exception):
        def __init__(self, status, headers=None):
            self.status, self.headers = status, headers

    waits, calls = [], []

    def fail(error, times):
        def call():
            calls.append(1)
            if len(calls) <= times:
                raise error
            return "ok"

        calls.clear()
        waits.clear()
        return call

    go = lambda c, **k: links.with_retry(c, sleep=waits.append, jitter=lambda: 0.5, **k)
    assert go(fail(Http(503), 2)) == "ok" and waits == [2.5, 4.5]
    assert go(fail(Http(429, {"retry-after": "7"}), 1)) == "ok" and waits == [7.0]
    with pytest.raises(Http):
        go(fail(Http(404), 1))
    with pytest.raises(Http):
        go(fail(Http(500), 1), attempts=0)
    assert links.is_retryable(code="ECONNRESET") and not links.is_retryable(code="ENOTFOUND")


def test_git_rules():
    for bad in (("-h", "a/b", "m"), ("h", "a", "m"), ("h", "a/../b", "m"), ("h", "a/b", "-x"), ("h;x", "a/b", "m")):
        with pytest.raises(ValueError):
            git.validate(*bad)
    git.validate("git.example:8443", "g/s/r", "feat/x")
    dirs = {git.clone_dir(git.GITLAB, h, r) for h, r in (("a", "x/y-z"), ("a", "x-y/z"), ("b", "x/y-z"))}
    assert len(dirs) == 3
    assert git.clone_url(git.GITHUB, "github.com", "o/r", "t") == "https://x-access-token:t@github.com/o/r.git"


def test_config():
    assert config.substitute("${A} ${B:-d} ${C}", {"A": "1"}) == "1 d ${C}"
    assert config.validate_embedding("openai", "text-embedding-3-large", 4000)[0]
    assert config.validate_embedding("openai", "text-embedding-3-large", 32) == ([], ["32 dimensions are few"])
    assert config.validate_embedding("openai", "new-model", 5)[1] and config.validate_embedding("none", "x", 5)[0]
    assert config.validate_embedding("ollama", "anything", 5) == ([], [])
    good = "sources:\n- {name: docs, type: local, path: /x}\nembeddings: {provider: openai, model: text-embedding-3-small, dimensions: 1536}"
    c = config.load(good, {})
    assert config.sources_of(c, "docs")[0].path == "/x"
    with pytest.raises(ValueError):
        config.sources_of(c, "other")
    with pytest.raises(ValueError):
        config.load("sources:\n- {name: Bad Name, type: ftp}", {})
    checks = config.doctor(c, {})
    assert config.count_results(checks) == {"pass": 1, "warn": 0, "fail": 1} and config.has_failure(checks)
    assert config.resolve_deletion(False, True, "idx", " idx ")[0] and not config.resolve_deletion(False, False, "idx", "idx")[0]
    assert config.dimension_mismatch(3, 3) is None and config.dimension_mismatch(3, 4)


def test_clamp():
    assert [search.clamp_k(x) for x in (None, 0, -3, 5, 99)] == [10, 1, 1, 5, 20]


def test_keep_last(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "id string, seq int, v string")
    assert {(r.id, r.v) for r in keep_last(df, "id", "seq").collect()} == {("a", "y"), ("b", "z")}


def test_files_to_results(spark, tmp_path):
    root = write(tmp_path / "docs", {"pay.md": "# Payments\n\nHow refunds and charges work. " + LOREM, "sub/auth.md": "# Tokens\n\nHow to rotate an access credential. " + LOREM})
    web = write(tmp_path / "web", {"p.html": f"<title>Web</title><main><h2>Hooks</h2><p>Webhook signatures. {LOREM}</p></main>"})
    sources = [Source("docs", path=root, base_url="https://d.example"), Source("web", parser="html", path=web), Source("gone", path=str(tmp_path / "no"), optional=True)]
    engine = Engine(spark, str(tmp_path / "index"), HashingEmbedder(128))
    row = engine.reindex(sources)
    assert row.first().totalChunks == 3 and row.first().sources == ["docs", "web"]
    assert engine.index.stats() == {"vectorCount": 3, "dimension": 128}
    engine.reindex(sources[:1])
    assert engine.index.stats()["vectorCount"] == 3
    best = engine.search("refunds and charges", 2).orderBy("rank").collect()
    assert len(best) == 2 and "refunds" in best[0].content and best[0].url == "https://d.example/pay.md"
    text = engine.search_text("webhook signatures", 1)
    assert text.startswith("# docs Documentation\n> Query: webhook signatures\n> Results: 1\n") and "Webhook" in text
    found = engine.chunks(sources).filter("error is null")
    search.export_text(found, str(tmp_path / "out"), ["source_ord", "documentPath", "id"])
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        search.export_text(found, str(tmp_path / "out"), ["id"])
    assert engine.clear() == (False, "not interactive") and engine.index.stats()["vectorCount"] == 3
    assert engine.clear(interactive=True, answer="docs")[0]
    assert engine.index.stats()["vectorCount"] == 0
    with pytest.raises(FileNotFoundError):
        engine.chunks([Source("gone", path=str(tmp_path / "no"))])


def test_reindex_rules(spark, tmp_path):
    root = write(tmp_path / "docs", {"a.md": "# A\n\nfirst page. " + LOREM})
    bad = write(tmp_path / "mdx", {"x.mdx": "---\r\ntitle: [\r\n---\r\n## B\n" + LOREM, "y.mdx": "---\r\ntitle: Fine\r\n---\r\n## C\n" + LOREM})
    engine = Engine(spark, str(tmp_path / "index"), HashingEmbedder(32))
    docs, broken = Source("docs", path=root), Source("m", parser="mdx", path=bad)
    assert engine.reindex([docs], dry_run=True).first().totalChunks == 1 and engine.index.versions() == []
    with pytest.raises(SourceError, match="source m"):
        engine.reindex([docs, broken])
    assert engine.index.versions() == []
    row = engine.reindex([docs, replace(broken, optional=True)]).first()
    assert (row.totalChunks, row.sources) == (1, ["docs"])
    shown = engine.preview([docs]).collect()
    assert [(r.heading, r.path, r["size"] > 300) for r in shown] == [("A", "docs/README.md", True)]
    for _ in range(3):
        engine.reindex([docs])
    assert len(engine.index.versions()) == 2 and engine.index.stats()["vectorCount"] == 1
    assert not [p for p in os.listdir(tmp_path / "index") if p.startswith(("_chunks", "_fresh"))]
    with pytest.raises(ValueError, match="32 dimensions"):
        VectorIndex(spark, str(tmp_path / "index"), 64).create()
    with pytest.raises(ValueError, match="compares by"):
        VectorIndex(spark, str(tmp_path / "index"), 32, "dotproduct").create()


def test_mdx_header_with_carriage_returns(spark, tmp_path):
    root = write(tmp_path / "mdx", {"y.mdx": "---\r\ntitle: Fine\r\n---\r\n## C\r\n" + LOREM})
    found = Engine(spark, str(tmp_path / "i")).chunks([Source("m", parser="mdx", path=root)]).collect()
    assert [(r.documentTitle, r.heading) for r in found] == [("Fine", "C")]


def test_operations_get_the_address_of_their_page(spark, tmp_path):
    spec = "paths:\n  /pets:\n    get: {operationId: list_pets, responses: {}}\n    post: {operationId: add_pet, responses: {}}\n"
    root = write(tmp_path / "api", {"spec.yaml": spec, "ref/pets.mdx": '---\nopenapi: "GET /pets"\n---\ntext'})
    found = Engine(spark, str(tmp_path / "i")).chunks([Source("api", parser="openapi", path=root, base_url="https://d.example")]).collect()
    assert {r.id: r.metadata.sourceUrl for r in found} == {"api/list_pets": "https://d.example/ref/pets", "api/add_pet": "https://d.example/pets/add-pet"}


def test_dump_round_trip_and_export(spark, tmp_path):
    root = write(tmp_path / "docs", {"a.md": "# A\n\nfirst page. " + LOREM})
    engine = Engine(spark, str(tmp_path / "index"))
    chunks = engine.chunks([Source("docs", path=root)]).drop("error", "source_ord")
    write_dump(chunks, str(tmp_path / "dump"))
    back = read_chunk_dump(spark, str(tmp_path / "dump"))
    assert back.select(chunks.columns).collect() == chunks.select(chunks.columns).collect()
    engine.export_text(str(tmp_path / "dump"), str(tmp_path / "out"))
    assert "first page" in "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    (tmp_path / "one.json").write_text('{"totalChunks": 1, "chunks": [{"id": "x", "heading": "H", "metadata": {"sourceUrl": "u"}}]}')
    assert [(r.id, r.heading, r.metadata.sourceUrl) for r in read_chunk_dump(spark, str(tmp_path / "one.json")).collect()] == [("x", "H", "u")]


def test_failing_reranker_leaves_vector_order(spark):
    rows = [(f"d{i}", [1.0, float(i)], {"content": f"text {i}"}) for i in range(5)]
    fields = "struct<" + ",".join(f"{k}:string" for k in RECORD_METADATA) + ">"
    index = spark.createDataFrame([(i, v, {k: m.get(k) for k in RECORD_METADATA}) for i, v, m in rows], f"id string, values array<float>, metadata {fields}")
    plain = [r.id for r in search.search(index, lambda q: [1.0, 0.0], "q", 3, rerank=None).orderBy("rank").collect()]
    assert plain == ["d0", "d1", "d2"]
    with pytest.warns(UserWarning, match="reranker failed"):
        got = search.search(index, lambda q: [1.0, 0.0], "q", 3, rerank=lambda text, q: F.raise_error(F.lit("down")).cast("double"))
    assert [r.id for r in got.orderBy("rank").collect()] == plain
    better = search.search(index, lambda q: [1.0, 0.0], "q", 3, rerank=lambda text, q: F.when(text.contains("text 4"), 1.0).otherwise(0.0))
    assert [r.id for r in better.orderBy("rank").collect()] == ["d4", "d0", "d1"]


def test_top_k_in_query_blocks(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float(i % 5), float(i)]) for i in range(40)], "id bigint, values array<double>")
    asked = v.filter("id % 4 = 0").selectExpr("id as query_id", "values as query")
    key = lambda df: sorted((r.query_id, r.id, r["rank"]) for r in df.collect())
    whole = key(search.top_k_each(v.filter("id > 0"), asked, 3))
    monkeypatch.setattr(search, "QUERY_BLOCK", 3)
    assert key(search.top_k_each(v.filter("id > 0"), asked, 3)) == whole


PAGES = {
    "https://a.example/llms.txt": "see https://a.example/docs/one and https://a.example/docs/two, https://a.example/gone https://b.example/x",
    "https://a.example/docs/one.md": "# One\n\n" + LOREM,
    "https://a.example/docs/two.md": "# Two\n\n" + LOREM,
}


def test_linked_pages_are_staged_one_by_one(spark, tmp_path):
    pages = dict(PAGES)

    def get_page(url):
        if url not in pages:
            raise HttpError(404, url)
        return pages[url]

    stage = Staging(spark, str(tmp_path / "stage"), get=get_page)
    source = Source("web", type="url", url="https://a.example/llms.txt", follow_links=True, hosts=("a.example",), append_extension=".md", base_url="https://a.example")
    rows = {r.path: r for r in read_source(source, stage).collect()}
    assert set(rows) == {"docs/one.md", "docs/two.md"} and rows["docs/one.md"].url == "https://a.example/docs/one"
    assert [(s, u) for s, u, _ in stage.skipped] == [("web", "https://a.example/gone")]
    assert os.listdir(tmp_path / "stage") and stage.cleanup() == [] and os.listdir(tmp_path / "stage") == []
    engine = Engine(spark, str(tmp_path / "i"), staging=stage)
    assert engine.reindex([source]).first().totalChunks == 2 and os.listdir(tmp_path / "stage") == []


def test_single_page_and_router(spark, tmp_path):
    stage = Staging(spark, str(tmp_path / "stage"), get=lambda url: "# P\n\n" + LOREM)
    assert [r.path for r in read_source(Source("p", type="url", url="https://a.example/x/page.md"), stage).collect()] == ["page.md"]
    assert [r.path for r in read_source(Source("p", type="url", url="https://a.example/x", save_as="y.md"), stage).collect()] == ["y.md"]
    for bad in (Source("p", type="ftp"), Source("p", type="url"), Source("p", type="github")):
        with pytest.raises(ValueError):
            read_source(bad, stage)
    waits, calls = [], []

    def flaky(url):
        calls.append(url)
        if len(calls) < 3:
            raise HttpError(503, url, {"retry-after": "2"})
        return "ok"

    assert fetch("u", flaky, waits.append) == "ok" and waits == [2.0, 2.0]


class Git:
    """Stands for git: makes the clone's folder, and fails for branches that are not there."""

    def __init__(self, branches):
        self.branches, self.calls, self.remote = branches, [], ""

    def __call__(self, args, capture_output=True, check=False):
        self.calls.append(args[1:])
        done = SimpleNamespace(returncode=0, stdout=b"")
        if "clone" in args:
            if "--branch" in args and args[args.index("--branch") + 1] not in self.branches:
                done.returncode = 128
            else:
                os.makedirs(args[-1] + "/guide")
                with open(args[-1] + "/guide/a.md", "w") as f:
                    f.write("# A\n\n" + LOREM)
                self.remote = args[-2]
        elif "fetch" in args and args[-1] not in self.branches:
            done.returncode = 1
        elif "set-url" in args:
            self.remote = args[-1]
        elif "get-url" in args:
            done.stdout = self.remote.encode()
        return done


def test_repositories_are_staged(spark, tmp_path):
    run = Git({"main"})
    stage = Staging(spark, str(tmp_path / "stage"), run=run, env={"GITHUB_TOKEN": "secret"})
    source = Source("lib", type="github", repository="o/r", path="guide")
    assert [(r.path, r.url) for r in read_source(source, stage).collect()] == [("a.md", "https://github.com/o/r/blob/main/a.md")]
    assert "secret" in run.calls[0][-2] and "secret" not in run.remote
    read_source(source, stage)
    assert [c[2] for c in run.calls if c[0] == "-C"].count("fetch") == 1 and sum(c[0] == "clone" for c in run.calls) == 1
    with pytest.raises(FileNotFoundError):
        read_source(replace(source, path="none"), stage)
    assert stage.cleanup()[:0] == [] and not os.listdir(tmp_path / "stage")
    other = Staging(spark, str(tmp_path / "stage"), run=Git(set()), env={})
    assert read_source(replace(source, branch="gone"), other).count() == 1
    with pytest.raises(ValueError):
        read_source(replace(source, repository="-x/y"), other)
    other.cleanup()


def test_operations_of_a_repository_get_their_pages(spark, tmp_path):
    class Repository(Git):
        def __call__(self, args, **k):
            done = super().__call__(args, **k)
            if "clone" in args and done.returncode == 0:
                with open(args[-1] + "/guide/spec.yaml", "w") as f:
                    f.write("paths:\n  /pets:\n    get: {operationId: list_pets, responses: {}}\n")
                with open(args[-1] + "/guide/pets.mdx", "w") as f:
                    f.write('---\nopenapi: "GET /pets"\n---\ntext')
            return done

    staging = Staging(spark, str(tmp_path / "stage"), run=Repository({"main"}), env={})
    engine = Engine(spark, str(tmp_path / "i"), staging=staging)
    found = engine.chunks([Source("api", type="github", repository="o/r", path="guide", parser="openapi", base_url="https://d.example")]).collect()
    assert [r.metadata.sourceUrl for r in found] == ["https://d.example/pets"]


def test_cleanup_goes_on_after_a_failure(spark, tmp_path):
    stage, seen = Staging(spark, str(tmp_path)), []
    stage._undo = [("a", lambda: seen.append("a")), ("b", lambda: 1 / 0)]
    assert stage.cleanup() == ["b: division by zero"] and seen == ["a"]


def test_token_cap(spark):
    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    if not os.path.exists(path):
        pytest.skip("no vocabulary here")
    cap = TokenCap.from_file(path, cap=20)
    df = spark.createDataFrame([("short",), ("many words of it " * 50,), (None,)], "t string")
    short, cut, none = [r[0] for r in df.select(cap.apply(F.col("t"))).collect()]
    assert short == "short" and none is None and cut == ("many words of it " * 5)[: len(cut)] and 60 < len(cut) < 90


def test_embedding_takes_one_worker_a_task_and_little_memory(spark):
    import tracemalloc

    from docgrove.functions.vectors import HashingEmbedder
    from docgrove.model import CHUNKS
    from docgrove.plans.engine import embed_chunks

    chunks = spark.createDataFrame([("a", "p", "t", "c", "h", "one two " * 9000, None), ("b", None, None, None, None, None, None)], CHUNKS)
    found = embed_chunks(chunks, HashingEmbedder(16))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "MapInArrow" not in plan
    by_id = {r["id"]: r["values"] for r in found.collect()}
    assert len(by_id["a"]) == len(by_id["b"]) == 16 and abs(sum(x * x for x in by_id["a"]) - 1) < 1e-5
    texts = pa.array(["some words " * 400] * 1000)
    tracemalloc.start()
    HashingEmbedder(64).embed_batch(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50e6


def test_embeddings_by_batch_equal_single_ones():
    texts = ["One two, two", "", None, "été _x9 One", "a" * 200]
    e = HashingEmbedder(16)
    got = e.embed_batch(pa.array(texts, pa.string()))
    assert [r.tolist() for r in got] == [e.embed(t) for t in texts]
    assert e.embed("ONE two") == e.embed("one, two!") and abs(sum(x * x for x in got[0].tolist()) - 1) < 1e-6
    e.SLICE = 3
    assert (e.embed_batch(pa.array(texts, pa.string())) == got).all()


def test_incremental_index(spark, tmp_path):
    root = write(tmp_path / "in", {"a.md": "# A\n\nfirst page. " + LOREM})
    index = VectorIndex(spark, str(tmp_path / "idx"), 32)
    source = Source("in", path=root)
    for n, more in ((1, {}), (2, {"b.md": "# B\n\nsecond page. " + LOREM})):
        write(tmp_path / "in", more)
        index_stream(spark, source, index, HashingEmbedder(32), str(tmp_path / "cp")).awaitTermination()
        assert index.stats()["vectorCount"] == n


def test_own_queries_run_without_llm():
    import __spark_entry__ as e

    own = [k for k in e.queries() if not k.startswith("op") and k != "pipeline"]
    assert len(own) > 25 and set(e.oracle_sql()) <= set(e.queries()) and os.path.exists("/root/testdata")


def test_command_line(spark, tmp_path, capsys):
    from docgrove.__main__ import main

    root = write(tmp_path / "docs", {"a.md": "# Refunds\n\nHow refunds work. " + LOREM})
    cfg = tmp_path / "c.yaml"
    cfg.write_text(f"sources:\n- {{name: docs, type: local, path: {root}}}\nembeddings: {{provider: openai, model: text-embedding-3-small, dimensions: 64}}\n")
    at = ["--index", str(tmp_path / "index")]
    assert main([*at, "reindex", "--config", str(cfg), "--dry-run", "--dump", str(tmp_path / "dump")], spark) == 0
    assert "Refunds (documentation" in capsys.readouterr().out and not (tmp_path / "index" / "log").exists()
    assert main([*at, "reindex", "--config", str(cfg)], spark) == 0 and "1 chunks from docs" in capsys.readouterr().out
    assert main([*at, "search", "refunds", "--limit", "1"], spark) == 0 and "How refunds work" in capsys.readouterr().out
    assert main([*at, "export", str(tmp_path / "dump"), str(tmp_path / "txt")], spark) == 0
    assert main([*at, "clear", "--force"], spark) == 0 and "forced" in capsys.readouterr().out
    assert main(["doctor", "--config", str(cfg)]) in (0, 1) and "OPENAI" in capsys.readouterr().out
