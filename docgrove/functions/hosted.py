"""Embedders behind web services, with the same two methods as the offline one.

A provider is what it asks and how it answers; the way there is a function
``post(url, headers, body)``, for which tests pass their own.  Tasks send texts in batches,
each with the retry rule of upserts, and every answer must hold one vector per text.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa

from ..sources.config import API_KEYS
from ..sources.links import with_retry
from ..sources.remote import TIMEOUT_S, ConnectionFailed, HttpError
from .vectors import reorder_by_index

BATCH = 100
Post = Callable[[str, dict[str, str], dict], Any]


def http_post(url: str, headers: dict[str, str], body: dict) -> Any:
    """The JSON answer to a JSON question; errors carry what the retry rule looks at."""
    asked = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    try:
        with urllib.request.urlopen(asked, timeout=TIMEOUT_S) as answer:
            return json.loads(answer.read())
    except urllib.error.HTTPError as e:
        raise HttpError(e.code, url, {k.lower(): v for k, v in e.headers.items()}) from e
    except urllib.error.URLError as e:
        if isinstance(e.reason, TimeoutError):
            raise TimeoutError(f"{url} took longer than {TIMEOUT_S:g} s") from e
        raise ConnectionFailed(url, None) from e


def supports_dimensions(model: str) -> bool:
    """Whether a model of OpenAI takes a number of dimensions; older ones reject it."""
    return model.startswith("text-embedding-3")


@dataclass(frozen=True)
class Provider:
    """Where a service is, what it is asked for, and where its answer keeps the vectors."""

    url: str
    header: str
    #: (model, texts, dimensions, whether they are a query) to the body
    body: Callable[[str, list[str], int, bool], dict]
    #: the answer to its items, each a vector or a mapping with one, or None
    items: Callable[[dict], list | None]


def _openai(model: str, texts: list[str], dimensions: int, query: bool) -> dict:
    return {"model": model, "input": texts} | ({"dimensions": dimensions} if supports_dimensions(model) else {})


def _gemini(model: str, texts: list[str], dimensions: int, query: bool) -> dict:
    kind = "RETRIEVAL_QUERY" if query else "RETRIEVAL_DOCUMENT"
    return {"requests": [{"model": f"models/{model}", "content": {"role": "user", "parts": [{"text": t}]}, "taskType": kind, "outputDimensionality": dimensions} for t in texts]}


# Addresses, fields and task names of the services.
PROVIDERS = {
    "openai": Provider("https://api.openai.com/v1/embeddings", "Authorization", _openai, lambda a: a.get("data")),
    "gemini": Provider("https://generativelanguage.googleapis.com/v1beta/models/{model}:batchEmbedContents", "x-goog-api-key", _gemini, lambda a: [{"embedding": x.get("values")} for x in a["embeddings"]] if a.get("embeddings") else None),
    "cohere": Provider(
        "https://api.cohere.com/v2/embed",
        "Authorization",
        lambda model, texts, dimensions, query: {"model": model, "texts": texts, "input_type": "search_query" if query else "search_document", "embedding_types": ["float"], "output_dimension": dimensions},
        lambda a: (a.get("embeddings") or {}).get("float"),
    ),
    "voyage": Provider(
        "https://api.voyageai.com/v1/embeddings",
        "Authorization",
        lambda model, texts, dimensions, query: {"model": model, "input": texts, "input_type": "query" if query else "document", "output_dimension": dimensions},
        lambda a: a.get("data"),
    ),
    "ollama": Provider("{base}/api/embed", "", lambda model, texts, dimensions, query: {"model": model, "input": texts}, lambda a: a.get("embeddings")),
}


class HostedEmbedder:
    """A model of a provider; documents and queries are asked for as such where it tells them apart."""

    def __init__(self, provider: str, model: str, dimension: int, key: str = "", base_url: str = "http://localhost:11434", post: Post = http_post, batch: int = BATCH, sleep: Callable[[float], None] = time.sleep):
        if provider not in PROVIDERS:
            raise ValueError(f"unknown embedding provider {provider!r}")
        if API_KEYS[provider] and not key:
            raise ValueError(f"{provider} needs a key ({API_KEYS[provider]})")
        self.provider, self.model, self.dimension, self.key, self.base_url = provider, model, dimension, key, base_url.rstrip("/")
        self.post, self.batch, self.sleep = post, batch, sleep

    @classmethod
    def of(cls, config: dict, env: dict[str, str], **settings) -> HostedEmbedder:
        """The embedder that a configuration names, its key and address from the environment."""
        e = config.get("embeddings") or {}
        provider = e.get("provider", "openai")
        return cls(provider, e.get("model", "text-embedding-3-large"), int(e.get("dimensions", 3072)), env.get(API_KEYS.get(provider) or "", ""), env.get("OLLAMA_BASE_URL") or "http://localhost:11434", **settings)

    def embed(self, text: str, mode: str = "document") -> list[float]:
        return self.embed_batch(pa.array([text or ""]), mode)[0].tolist()

    def embed_batch(self, texts: pa.Array, mode: str = "document") -> np.ndarray:
        """A row per text, in order."""
        held = [t or "" for t in texts.to_pylist()]
        rows = [v for at in range(0, len(held), self.batch) for v in self._asked(held[at : at + self.batch], mode == "query")]
        out = np.array(rows, np.float64).reshape(len(rows), -1) if rows else np.zeros((0, self.dimension))
        if out.shape[1] != self.dimension:
            raise ValueError(f"{self.provider}: {out.shape[1]} dimensions, expected {self.dimension}")
        return out

    def _asked(self, texts: list[str], query: bool) -> list[list[float]]:
        p = PROVIDERS[self.provider]
        url = p.url.format(model=self.model, base=self.base_url)
        headers = {p.header: f"Bearer {self.key}" if p.header == "Authorization" else self.key} if p.header else {}

        def once() -> list[list[float]]:
            items = p.items(self.post(url, headers, p.body(self.model, texts, self.dimension, query)))
            if items is None:
                raise ValueError(f"{self.provider}: an answer without embeddings")
            return reorder_by_index([x if isinstance(x, dict) else {"embedding": x} for x in items], len(texts))

        return with_retry(once, sleep=self.sleep)
