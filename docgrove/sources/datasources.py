"""Spark data sources in Python: pages behind URLs, folder trees, and a sink in batches.

Each is made by a function that takes its door to the outside (the transport, the
lister, the endpoint), for which tests pass their own, and is then registered by name.
Conditions on places are taken over by the readers, given as options or, with option
pushFilters, as filters of the query: a page that they rule out is not fetched, and a
folder that none of its files can pass is not listed.

Spark keeps what a reader has taken over with the loaded table: a second query on the
same table, with other filters or none, would read what the first has left.  So filters are
taken over only where pushFilters says that each ``load()`` serves one query.
"""

from __future__ import annotations

import datetime
import os
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringEndsWith, StringStartsWith, WriterCommitMessage

from .links import with_retry

#: Pages that one task fetches, and folders from which a tree is dealt out to tasks.
PAGES_PER_TASK, FOLDERS = 50, 64
BATCH_LEAST, BATCH_MOST, BATCH = 1, 500, 100

PAGES = "url string, host string, path string, content string, error string"
TREE = "path string, length bigint, modified timestamp, content binary"


def register(spark: SparkSession, source: type[DataSource]) -> None:
    """Registers a source of this module; its readers take filters over, which the session must allow."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)


class _Places(DataSourceReader):
    """A reader whose rows have places; conditions on these are taken over."""

    places: tuple[str, ...] = ()

    def __init__(self, options: dict[str, str]):
        self.push = options.get("pushFilters", "false") == "true"
        names = [x for x in options.get("hosts", "").split("\n") if x]
        self.taken: list[Filter] = [In(("host",), tuple(names))] if names and "host" in self.places else []
        if options.get("pathPrefix"):
            self.taken.append(StringStartsWith(("path",), options["pathPrefix"]))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if self.push and isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith, IsNotNull)) and len(f.attribute) == 1 and f.attribute[0] in self.places:
                self.taken.append(f)
            else:
                yield f

    def passes(self, **row: str) -> bool:
        return all(self._holds(f, row[f.attribute[0]]) for f in self.taken)

    @staticmethod
    def _holds(f: Filter, x: str) -> bool:
        if isinstance(f, EqualTo):
            return x == f.value
        if isinstance(f, In):
            return x in f.value
        if isinstance(f, StringStartsWith):
            return x.startswith(f.value)
        return not isinstance(f, StringEndsWith) or x.endswith(f.value)


# --- pages --------------------------------------------------------------------


@dataclass
class Pages(InputPartition):
    """A range of the URLs of one host."""

    urls: list[str]


class PageReader(_Places):
    places = ("url", "host", "path")

    def __init__(self, options: dict[str, str], fetch: Callable[[str], str]):
        super().__init__(options)
        self.urls = sorted({u for u in options["urls"].split("\n") if u})
        self.extension, self.per_task, self.fetch = options.get("extension", ""), int(options.get("pagesPerTask", PAGES_PER_TASK)), fetch

    @staticmethod
    def place(url: str) -> dict[str, str]:
        at = urlsplit(url)
        return {"url": url, "host": (at.hostname or ""), "path": at.path.lstrip("/")}

    def partitions(self) -> list[Pages]:
        hosts: dict[str, list[str]] = {}
        for url in self.urls:
            at = self.place(url)
            if self.passes(**at):
                hosts.setdefault(at["host"], []).append(url)
        return [Pages(urls[i : i + self.per_task]) for urls in hosts.values() for i in range(0, len(urls), self.per_task)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        # without any page left, Spark reads one partition of None
        for url in partition.urls if partition else ():
            at = self.place(url)
            try:
                yield (url, at["host"], at["path"], self.fetch(url + self.extension), None)
            except Exception as e:  # one page fails for itself
                yield (url, at["host"], at["path"], None, f"{type(e).__name__}: {e}"[:500])


def page_source(fetch: Callable[[str], str]) -> type[DataSource]:
    """`docgrove_pages`: PAGES of the URLs in option `urls` (one a line), a task per host and range of URLs.

    `fetch` gives a page's text, retries included.  Options: hosts (one a line), pathPrefix,
    pushFilters, extension (added to what is fetched), pagesPerTask.
    """

    class PageSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return "docgrove_pages"

        def schema(self) -> str:
            return PAGES

        def reader(self, schema) -> DataSourceReader:
            return PageReader(self.options, fetch)

    return PageSource


def read_pages(spark: SparkSession, urls: list[str], fetch: Callable[[str], str], extension: str = "") -> DataFrame:
    """PAGES of a list of URLs, which a crawl's page cap bounds."""
    register(spark, page_source(fetch))
    return spark.read.format("docgrove_pages").option("urls", "\n".join(urls)).option("extension", extension).load()


# --- folder trees -------------------------------------------------------------


def list_folder(path: str) -> list[tuple[str, bool, int, float]]:
    """(name, whether it is a folder, bytes, time) of what a folder holds; links to folders are not followed."""
    with os.scandir(path) as found:
        return sorted((e.name, e.is_dir(follow_symlinks=False), e.stat().st_size, e.stat().st_mtime) for e in found if e.is_dir(follow_symlinks=False) or e.is_file())


@dataclass
class Folder(InputPartition):
    """A folder under the root ('' for it), to be walked to its end, or its own files only."""

    path: str
    deep: bool


class TreeReader(_Places):
    places = ("path",)

    def __init__(self, options: dict[str, str], pattern: str, listing: Callable[[str], list[tuple[str, bool, int, float]]]):
        super().__init__(options)
        names = lambda key: {x.lower() for x in options.get(key, "").split("\n") if x}
        self.root, self.pattern, self.listing = options["path"].rstrip("/"), pattern, listing
        self.skip_dirs, self.skip_files = names("skipDirs"), names("skipFiles")
        self.hidden = options.get("hiddenDirs", "true") == "true"
        self.recursive = options.get("recursive", "true") == "true"
        self.contents = options.get("contents", "true") == "true"

    def _list(self, folder: str) -> tuple[list[str], list[tuple[str, int, float]]]:
        """The folders of a folder that may hold rows, and its files that are rows, by their paths under the root."""
        folders, files = [], []
        for name, is_dir, size, changed in self.listing(f"{self.root}/{folder}" if folder else self.root):
            path = f"{folder}/{name}" if folder else name
            if is_dir:
                if self.recursive and name.lower() not in self.skip_dirs and (self.hidden or not name.startswith(".")) and self._may_hold(path + "/"):
                    folders.append(path)
            elif re.search(self.pattern, path) and name.lower() not in self.skip_files and self.passes(path=path):
                files.append((path, size, changed))
        return folders, files

    def _may_hold(self, folder: str) -> bool:
        """Whether the conditions on paths leave room for a file of the folder."""
        for f in self.taken:
            if isinstance(f, (EqualTo, StringStartsWith)) and not (f.value.startswith(folder) or isinstance(f, StringStartsWith) and folder.startswith(f.value)):
                return False
            if isinstance(f, In) and not any(v.startswith(folder) for v in f.value):
                return False
        return True

    def partitions(self) -> list[Folder]:
        """Folders until there are enough to share out: each is listed here or in a task, none twice for its files."""
        shallow, deep = [], [""]
        while deep and len(deep) < FOLDERS:
            below = []
            for folder in deep:
                folders, files = self._list(folder)
                shallow += [folder] * bool(files)
                below += folders
            deep = below
        return [Folder(f, False) for f in shallow] + [Folder(f, True) for f in deep]

    def read(self, partition: Folder) -> Iterator[tuple]:
        stack = [partition.path] if partition else []
        while stack:
            folders, files = self._list(stack.pop())
            for path, size, changed in files:
                content = None
                if self.contents:
                    with open(f"{self.root}/{path}", "rb") as f:
                        content = f.read()
                yield (path, size, datetime.datetime.fromtimestamp(changed, datetime.UTC), content)
            stack += folders if partition.deep else []


def tree_source(pattern: str, listing: Callable[[str], list[tuple[str, bool, int, float]]] = list_folder) -> type[DataSource]:
    """`docgrove_tree`: TREE of the files under option `path` whose relative path matches the pattern.

    For folders that driver and executors share as a file system.  Options: skipDirs and
    skipFiles (one a line, in any case), hiddenDirs, recursive, contents (or names only),
    pathPrefix, pushFilters.
    """

    class TreeSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return "docgrove_tree"

        def schema(self) -> str:
            return TREE

        def reader(self, schema) -> DataSourceReader:
            return TreeReader(self.options, pattern, listing)

    return TreeSource


# --- batches to an endpoint ---------------------------------------------------


@dataclass
class Sent(WriterCommitMessage):
    batches: int
    records: int


class BatchWriter(DataSourceArrowWriter):
    """Sends each task's records in batches, one after another, each retried for itself.

    A task that Spark runs again sends its records again: the endpoint takes them by id.
    """

    def __init__(self, options: dict[str, str], put: Callable[[str, list[dict]], None], sleep: Callable[[float], None], finish: Callable[[int, int], None] | None):
        self.size, self.namespace, self.delay = int(options.get("batchSize", BATCH)), options.get("namespace", ""), float(options.get("delayMs", 0)) / 1000
        if not BATCH_LEAST <= self.size <= BATCH_MOST:
            raise ValueError(f"batchSize: {BATCH_LEAST} to {BATCH_MOST}")
        self.put, self.sleep, self.finish = put, sleep, finish

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Sent:
        sent, held = Sent(0, 0), []

        def send() -> None:
            if sent.batches and self.delay:
                self.sleep(self.delay)
            batch = held[: self.size]
            with_retry(lambda: self.put(self.namespace, batch), sleep=self.sleep)
            sent.batches, sent.records = sent.batches + 1, sent.records + len(batch)
            del held[: self.size]

        for b in iterator:
            for at in range(0, b.num_rows, self.size):
                held += b.slice(at, self.size).to_pylist()
                while len(held) >= self.size:
                    send()
        if held:
            send()
        return sent

    def commit(self, messages: list[Sent | None]) -> None:
        if self.finish:
            self.finish(sum(m.batches for m in messages if m), sum(m.records for m in messages if m))

    def abort(self, messages: list[Sent | None]) -> None:
        """What was sent stays; the next run sends it again under the same ids."""


def batch_sink(put: Callable[[str, list[dict]], None], sleep: Callable[[float], None] = time.sleep, finish: Callable[[int, int], None] | None = None) -> type[DataSource]:
    """`docgrove_batches`: writes rows to an endpoint, `put(namespace, records)`.

    Options: batchSize (1 to 500), namespace, delayMs (between batches of a task).  `finish`
    is told the numbers of batches and records once every task is through.
    """

    class BatchSink(DataSource):
        @classmethod
        def name(cls) -> str:
            return "docgrove_batches"

        def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
            return BatchWriter(self.options, put, sleep, finish)

    return BatchSink


def send(rows: DataFrame, put: Callable[[str, list[dict]], None], namespace: str = "", batch_size: int = BATCH, delay_ms: int = 0, sleep: Callable[[float], None] = time.sleep, finish: Callable[[int, int], None] | None = None) -> None:
    """Sends all rows to an endpoint in batches."""
    register(rows.sparkSession, batch_sink(put, sleep, finish))
    rows.write.format("docgrove_batches").options(batchSize=str(batch_size), namespace=namespace, delayMs=str(delay_ms)).mode("append").save()
