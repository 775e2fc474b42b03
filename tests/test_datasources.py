"""Pages, folder trees and batches as Spark data sources."""

import json
import os
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docgrove.sources import datasources as ds
from docgrove.sources.files import scan
from docgrove.sources.remote import HttpError


def lines(path):
    return sorted(path.read_text().split()) if path.exists() else []


def test_pages_that_a_filter_rules_out_are_not_fetched(spark, tmp_path):
    asked = tmp_path / "asked"

    def fetch(url):
        with open(asked, "a") as f:
            f.write(url + "\n")
        if "bad" in url:
            raise HttpError(404, url)
        return f"text of {url}"

    ds.register(spark, ds.page_source(fetch))
    urls = [f"https://{h}.example/{p}/{k}" for h in "ab" for p in ("docs", "blog") for k in range(3)] + ["https://a.example/docs/bad"]
    load = lambda **o: spark.read.format("docgrove_pages").options(urls="\n".join([*urls, urls[0]]), pagesPerTask=2, extension=".md", **o).load()
    wanted = (F.col("host") == "a.example") & F.col("path").startswith("docs/")
    for found in (load(pushFilters="true").filter(wanted), load(hosts="a.example", pathPrefix="docs/")):
        rows = {r.path: r for r in found.collect()}
        assert lines(asked) == sorted(f"https://a.example/docs/{k}.md" for k in (0, 1, 2, "bad"))
        assert set(rows) == {"docs/0", "docs/1", "docs/2", "docs/bad"} and rows["docs/0"].content == "text of https://a.example/docs/0.md"
        assert rows["docs/bad"].content is None and rows["docs/bad"].error.startswith("HttpError")
        asked.unlink()
    assert load(pushFilters="true").filter("host = 'c.example'").count() == 0 and not asked.exists()
    # without pushFilters, one loaded table answers any query
    pages = load()
    assert [pages.filter(wanted).count(), pages.count(), pages.filter("host in ('b.example') and content is not null").count(), pages.count()] == [4, 13, 6, 13]
    # a task per host and range
    assert pages.rdd.getNumPartitions() == 4 + 3


TREE = {"a.md": "A", "guides/b.md": "B", "guides/deep/c.MD": "C", "Vendor/d.md": "D", "vendor/x/e.md": "E", ".git/f.md": "F", "other/IGNORE.md": "I", "other/g.txt": "G"}


def tree(root):
    for name, text in TREE.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return str(root)


def test_skipped_folders_are_never_listed(spark, tmp_path):
    root, seen = tree(tmp_path / "t"), tmp_path / "seen"

    def listing(path):
        with open(seen, "a") as f:
            f.write(path.removeprefix(root) + "/\n")
        return ds.list_folder(path)

    ds.register(spark, ds.tree_source(r"(?i)\.md$", listing))
    load = lambda **o: spark.read.format("docgrove_tree").options(path=root, skipDirs="VENDOR", skipFiles="ignore.md", hiddenDirs="false", **o).load()
    assert {r.path: bytes(r.content) for r in load().collect()} == {"a.md": b"A", "guides/b.md": b"B", "guides/deep/c.MD": b"C"}
    assert set(lines(seen)) == {"/", "/guides/", "/guides/deep/", "/other/"}
    seen.unlink()
    assert [r.path for r in load(pushFilters="true").filter(F.col("path").startswith("guides/deep/")).collect()] == ["guides/deep/c.MD"]
    assert set(lines(seen)) == {"/", "/guides/", "/guides/deep/"}
    seen.unlink()
    assert load(pushFilters="true").filter("path = 'a.md'").count() == 1 and set(lines(seen)) == {"/"}
    names = load(contents="false", recursive="false").collect()
    assert [(r.path, r.length, r.content) for r in names] == [("a.md", 1, None)]


def test_contents_of_skipped_files_are_not_opened(spark, tmp_path):
    root = tree(tmp_path / "t")
    os.symlink("/nowhere", os.path.join(root, "gone.txt"))
    os.mkfifo(os.path.join(root, "pipe.txt"))  # opening it would wait for ever
    assert {r.path for r in scan(spark, root, "markdown", ("vendor",)).select("path").collect()} == {"a.md", "guides/b.md", "guides/deep/c.MD", ".git/f.md", "other/IGNORE.md"}
    assert scan(spark, f"file://{root}", "markdown", ("vendor",)).count() == 5
    many = tmp_path / "many"
    for k in range(150):
        (many / f"f{k}").mkdir(parents=True)
        (many / f"f{k}" / "x.md").write_text(str(k))
    assert {r.content for r in scan(spark, str(many), "markdown").collect()} == {str(k) for k in range(150)}


def test_batches_reach_a_failing_endpoint_once_each(spark, tmp_path):
    store, log = tmp_path / "store", tmp_path / "log"
    store.mkdir()

    def put(namespace, records):
        with open(log, "a") as f:
            f.write(f"{len(records)}\n")
        for k, r in enumerate(records):
            # fails before, between and after records
            if random.random() < 0.004 or k == 0 and random.random() < 0.3:
                raise HttpError(503, "endpoint")
            path = Path(store) / f"{namespace}-{r['id']}"
            path.write_text(json.dumps([r["values"], path.exists()]))
        if random.random() < 0.2:
            raise HttpError(429, "endpoint", {"retry-after": "0"})

    told = tmp_path / "told"  # the commit runs in a process of its own

    def finish(batches, records):
        with open(told, "a") as f:
            f.write(f"{batches},{records}\n")

    rows = spark.range(1000).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("id"), F.array(F.col("id").cast("float")).alias("values")).repartition(3)
    # the default retry gives up after five attempts; this endpoint fails more often
    for _ in range(20):
        try:
            ds.send(rows, put, "n", batch_size=40, delay_ms=1, sleep=lambda s: None, finish=finish)
            break
        except Exception:
            continue
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert lines(told) == [f"{sum(-(-n // 40) for n in sizes)},1000"]
    assert {p.name: json.loads(p.read_text())[0] for p in store.iterdir()} == {f"n-r{k}": [float(k)] for k in range(1000)}
    assert max(map(int, lines(log))) == 40
    with pytest.raises(Exception, match="batchSize"):
        ds.send(rows, put, batch_size=501)

    def never(namespace, records):
        raise HttpError(400, "endpoint")

    with pytest.raises(Exception, match="400"):
        ds.send(rows, never, finish=finish)
    assert len(lines(told)) == 1
