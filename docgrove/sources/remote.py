"""Sources of every type as tables of files; remote ones are staged first.

The network step stands apart from queries: it runs once, and what it brings is
written to the staging folder, from which all later steps read.  Linked pages are
fetched by tasks, one page failing for itself.  The folder must be one that driver and
executors share.
"""

from __future__ import annotations

import errno
import os
import shutil
import subprocess
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_context, file_source_url
from . import git
from .datasources import read_pages
from .files import Source, scan, select_files
from .links import link_table, page_path, resolve_filename, with_retry

TIMEOUT_S, ATTEMPTS, BASE_MS = 30.0, 4, 1000.0
PROVIDERS = {"github": git.GITHUB, "gitlab": git.GITLAB}


class HttpError(Exception):
    def __init__(self, status: int, url: str, headers: dict[str, str] | None = None):
        super().__init__(f"status {status} for {url}")
        self.status, self.headers = status, headers or {}


class ConnectionFailed(Exception):
    def __init__(self, url: str, code: str | None):
        super().__init__(f"{code or 'no connection'} for {url}")
        self.code = code


def http_get(url: str) -> str:
    """The text behind a URL; errors carry what the retry rule looks at."""
    try:
        with urllib.request.urlopen(url, timeout=TIMEOUT_S) as answer:
            return answer.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        raise HttpError(e.code, url, {k.lower(): v for k, v in e.headers.items()}) from e
    except urllib.error.URLError as e:
        if isinstance(e.reason, TimeoutError):
            raise TimeoutError(f"{url} took longer than {TIMEOUT_S:g} s") from e
        raise ConnectionFailed(url, errno.errorcode.get(getattr(e.reason, "errno", None) or 0)) from e


def fetch(url: str, get: Callable[[str], str] = http_get, sleep: Callable[[float], None] = time.sleep) -> str:
    return with_retry(lambda: get(url), attempts=ATTEMPTS, base_ms=BASE_MS, sleep=sleep)


class Staging:
    """Reads sources, staging remote ones under `folder`; `get` and `run` are the network's two doors."""

    def __init__(self, spark: SparkSession, folder: str, get: Callable[[str], str] = http_get, run: Callable = subprocess.run, env: dict[str, str] | None = None, sleep: Callable[[float], None] = time.sleep):
        self.spark, self.folder, self.get, self.run, self.sleep = spark, folder.rstrip("/"), get, run, sleep
        self.env = dict(os.environ) if env is None else env
        #: Pages that could not be fetched, as (source, url, error).
        self.skipped: list[tuple[str, str, str]] = []
        #: Folders of the repositories that were cloned, by source.
        self.roots: dict[str, str] = {}
        self._undo: list[tuple[str, Callable[[], None]]] = []

    def files(self, source: Source) -> DataFrame | None:
        """(path, content) of a source; None for an optional one that is missing."""
        if source.type == "local":
            if "://" not in source.path and not os.path.exists(source.path):
                if source.optional:
                    return None
                raise FileNotFoundError(source.path)
            return scan(self.spark, source.path, source.parser, source.skip_dirs, source.skip_files)
        if source.type == "url":
            return self._pages(source)
        if source.type in PROVIDERS:
            return scan(self.spark, self._clone(source), source.parser, source.skip_dirs, source.skip_files)
        raise ValueError(f"unknown source type {source.type}")

    def _pages(self, source: Source) -> DataFrame:
        if not source.url:
            raise ValueError(f"url source {source.name} needs a url")
        seed = fetch(source.url, self.get, self.sleep)
        if source.follow_links:
            text = self.spark.createDataFrame([(seed,)], "content string")
            links = link_table(text, "content", list(source.hosts) or None, source.max_pages)
            get, sleep = self.get, self.sleep
            # max_pages rows at most
            pages = read_pages(self.spark, [r["url"] for r in links.collect()], lambda url: fetch(url, get, sleep), source.append_extension)
            found = pages.select(F.concat(page_path(F.col("url")), F.lit(source.append_extension)).alias("path"), "content", "url", "error")
        else:
            found = self.spark.createDataFrame([(resolve_filename(source.url, source.save_as), seed, source.url, None)], "path string, content string, url string, error string")
        at = f"{self.folder}/{source.name}-{uuid.uuid4().hex}"
        self._undo.append((source.name, lambda: self._remove(at)))
        found.write.parquet(at)
        stored = self.spark.read.schema(found.schema).parquet(at)
        # max_pages rows at most
        self.skipped += [(source.name, r["url"], r["error"]) for r in stored.filter("error is not null").select("url", "error").orderBy("url").collect()]
        return select_files(stored.filter("error is null and path is not null").select("path", "content"), source.parser, source.skip_dirs, source.skip_files)

    def _clone(self, source: Source) -> str:
        provider = PROVIDERS[source.type]
        if not source.repository:
            raise ValueError(f"{provider.name} source {source.name} needs a repository")
        Path(self.folder).mkdir(parents=True, exist_ok=True)
        target = git.stage(provider, source.host or provider.default_host, source.repository, source.branch or "main", self.folder, self.env.get(provider.token_name), self.run)
        self._undo.append((source.name, lambda: shutil.rmtree(target)))
        inside = os.path.join(target, source.path) if source.path not in ("", ".") else target
        if not os.path.exists(inside):
            raise FileNotFoundError(f"{source.path} is not in repository {source.repository}")
        self.roots[source.name] = inside
        return inside

    def _remove(self, at: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def cleanup(self) -> list[str]:
        """Removes what was staged; what cannot be removed is reported, and does not keep the rest."""
        failed = []
        while self._undo:
            name, undo = self._undo.pop()
            try:
                undo()
            except Exception as e:
                failed.append(f"{name}: {e}")
        return failed


def read_source(source: Source, staging: Staging) -> DataFrame | None:
    """(context, path, content, url, language, source) rows; None for a missing optional source."""
    files = staging.files(source)
    return None if files is None else described(files, source)


def described(files: DataFrame, source: Source) -> DataFrame:
    """Files (path, content) with what their source says about them."""
    context = F.lit(source.display_name or source.name)
    url = file_source_url(F.lit(source.type), F.lit(source.base_url), F.lit(source.repository), F.lit(source.follow_links), F.col("path"))
    return files.select(file_context(context, F.col("path")).alias("context"), "path", "content", url.alias("url"), F.lit(source.language).alias("language"), F.lit(source.name).alias("source"))
