"""URL sources: link extraction on Columns, file names, page paths, and a fetch with retries."""

from __future__ import annotations

import os
import random
import re
import time
from collections.abc import Callable
from email.utils import parsedate_to_datetime
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The link pattern, and what may be retried.
LINK = r"https?://[^\s)\]\"'>,]+"
RETRY_STATUS = {408, 429}
RETRY_CODES = {"ECONNRESET", "ECONNREFUSED", "ETIMEDOUT", "EPIPE", "EAI_AGAIN", "EHOSTUNREACH", "ENETUNREACH", "UND_ERR_CONNECT_TIMEOUT"}


def extract_links(text: Column, hosts: list[str] | None = None) -> Column:
    """Distinct sorted page URLs of a text: no query, fragment or trailing slash, no bare roots."""
    raw = F.transform(F.regexp_extract_all(text, F.lit(f"({LINK})"), F.lit(1)), lambda u: F.regexp_replace(u, r"[.,;]+$", ""))

    def clean(u: Column) -> Column:
        host = F.lower(F.try_parse_url(u, F.lit("HOST")))
        path = F.regexp_replace(F.coalesce(F.try_parse_url(u, F.lit("PATH")), F.lit("")), "/+$", "")
        ok = host.isNotNull() & (path != "")
        if hosts:
            ok = ok & host.isin(hosts)
        return F.when(ok, F.concat(F.lower(F.try_parse_url(u, F.lit("PROTOCOL"))), F.lit("://"), host, path))

    return F.array_sort(F.array_distinct(F.array_compact(F.transform(raw, clean))))


def link_table(pages: DataFrame, text_col: str, hosts: list[str] | None = None, max_pages: int = 500) -> DataFrame:
    """(url): the links of all rows, each once, the first max_pages in order."""
    return pages.select(F.explode(extract_links(F.col(text_col), hosts)).alias("url")).distinct().orderBy("url").limit(max_pages)


def resolve_filename(url: str, save_as: str | None = None) -> str:
    if save_as is not None:
        if not save_as.strip():
            raise ValueError("saveAs must not be empty")
        if "/" in save_as or "\\" in save_as or save_as in (".", ".."):
            raise ValueError(f"saveAs '{save_as}' is no bare file name")
        return save_as
    return os.path.basename(urlsplit(url).path.rstrip("/")) or "content.yaml"


def page_path(url: Column) -> Column:
    """The relative path that mirrors a page; null if it would leave its folder."""
    path = F.regexp_replace(F.try_parse_url(url, F.lit("PATH")), "^/+", "")
    return F.when((path != "") & ~F.array_contains(F.split(path, "/"), ".."), path)


def is_retryable(status: int | None = None, code: str | None = None, name: str | None = None) -> bool:
    if status is not None:
        return status in RETRY_STATUS or 500 <= status < 600
    return code in RETRY_CODES or name in ("AbortError", "TimeoutError")


def retry_after_ms(header: str | None, now: float | None = None) -> float | None:
    """Delay of a Retry-After header in seconds or as a date."""
    if not header:
        return None
    if re.fullmatch(r"\d+(\.\d+)?", header.strip()):
        return float(header) * 1000
    try:
        return max(0.0, (parsedate_to_datetime(header).timestamp() - (time.time() if now is None else now)) * 1000)
    except (TypeError, ValueError):
        return None


def with_retry(call: Callable, attempts: int = 5, base_ms: float = 2000, max_ms: float = 60_000, retryable: Callable[[Exception], bool] | None = None, sleep: Callable[[float], None] = time.sleep, jitter: Callable[[], float] = random.random):
    """Runs call(); after a retryable error waits min(base * 2^(n-1), max) plus jitter, or as the server says."""
    attempts = attempts if isinstance(attempts, int) and attempts > 0 else 1
    decide = retryable or (lambda e: is_retryable(getattr(e, "status", None), getattr(e, "code", None), type(e).__name__))
    for n in range(1, attempts + 1):
        try:
            return call()
        except Exception as e:
            if n == attempts or not decide(e):
                raise
            backoff = min(base_ms * 2 ** (n - 1), max_ms)
            told = retry_after_ms((getattr(e, "headers", None) or {}).get("retry-after"))
            sleep((min(told, max_ms) if told is not None else backoff + jitter() * min(1000, backoff)) / 1000)
