"""Embedders behind services, by answers such as theirs."""

import numpy as np
import pyarrow as pa
import pytest

from docgrove.functions.hosted import PROVIDERS, HostedEmbedder, supports_dimensions
from docgrove.sources.remote import HttpError


def vector(text):
    return [float(len(text)), float(text.count("a")), 1.0]


class Service:
    """Answers as the provider does; fails as often as told."""

    def __init__(self, provider, failures=0, change=lambda a: a):
        self.provider, self.failures, self.change, self.asked = provider, failures, change, []

    def __call__(self, url, headers, body):
        self.asked.append((url, headers, body))
        if len(self.asked) <= self.failures:
            raise HttpError(429, url, {"retry-after": "1"})
        if self.provider == "gemini":
            return self.change({"embeddings": [{"values": vector(r["content"]["parts"][0]["text"])} for r in body["requests"]]})
        texts = body.get("texts") or body["input"]
        found = [vector(t) for t in texts]
        if self.provider == "cohere":
            return self.change({"embeddings": {"float": found}})
        if self.provider == "ollama":
            return self.change({"embeddings": found})
        return self.change({"data": [{"embedding": v, "index": i} for i, v in reversed(list(enumerate(found)))]})


TEXTS = ["banana", "", "aa", None, "xyz"]


@pytest.mark.parametrize("provider", list(PROVIDERS))
def test_every_provider_gives_vectors_in_input_order(provider):
    waits, service = [], Service(provider, failures=2)
    e = HostedEmbedder(provider, "text-embedding-3-small", 3, "k", "http://host:1/", service, batch=2, sleep=waits.append)
    got = e.embed_batch(pa.array(TEXTS))
    assert (got == np.array([vector(t or "") for t in TEXTS])).all() and waits == [1.0, 1.0] and len(service.asked) == 5
    assert e.embed_batch(pa.array([], pa.string())).shape == (0, 3)
    e.embed("what", "query")
    (_, headers, first), (url, _, last) = service.asked[0], service.asked[-1]
    assert headers == {"ollama": {}, "gemini": {"x-goog-api-key": "k"}}.get(provider, {"Authorization": "Bearer k"})
    told = {"cohere": ("input_type", "search_document", "search_query"), "voyage": ("input_type", "document", "query")}.get(provider)
    if told:
        assert (first[told[0]], last[told[0]], last["output_dimension"]) == (told[1], told[2], 3)
    if provider == "gemini":
        assert [b["requests"][0]["taskType"] for b in (first, last)] == ["RETRIEVAL_DOCUMENT", "RETRIEVAL_QUERY"] and "text-embedding-3-small:batch" in url
    if provider == "ollama":
        assert url == "http://host:1/api/embed"


def test_dimensions_go_to_models_that_take_them():
    for model, takes in (("text-embedding-3-large", True), ("text-embedding-ada-002", False)):
        service = Service("openai")
        HostedEmbedder("openai", model, 3, "k", post=service).embed("x")
        assert supports_dimensions(model) == takes == ("dimensions" in service.asked[0][2])


@pytest.mark.parametrize("change", [lambda a: {"data": a["data"][1:]}, lambda a: {"data": [{"embedding": [], "index": 0}] * 2}, lambda a: {}, lambda a: {"data": [x | {"index": 0} for x in a["data"]]}, lambda a: {"data": [x | {"embedding": [1.0]} for x in a["data"]]}])
def test_wrong_answers_are_errors(change):
    with pytest.raises(ValueError):
        HostedEmbedder("voyage", "voyage-3", 3, "k", post=Service("voyage", change=change)).embed_batch(pa.array(["a", "b"]))


def test_settings():
    with pytest.raises(ValueError, match="OPENAI_API_KEY"):
        HostedEmbedder.of({}, {})
    with pytest.raises(ValueError, match="unknown"):
        HostedEmbedder("none", "m", 3)
    e = HostedEmbedder.of({"embeddings": {"provider": "ollama", "model": "m", "dimensions": 8}}, {"OLLAMA_BASE_URL": "http://o/"})
    assert (e.provider, e.base_url, e.dimension) == ("ollama", "http://o", 8)
    with pytest.raises(HttpError):
        HostedEmbedder("ollama", "m", 3, post=Service("ollama", failures=9), sleep=lambda s: None).embed("x")


def test_it_embeds_chunks_in_tasks(spark):
    from pyspark.sql import functions as F

    from docgrove.model import CHUNKS
    from docgrove.plans.engine import embed_chunks

    def post(url, headers, body):  # tasks cannot import this module
        return {"embeddings": [[float(len(t)), float(t.count("a")), 1.0] for t in body["input"]]}

    rows = spark.createDataFrame([(f"c{i}", "p", "T", "c", "H", "a" * i, None) for i in range(20)], CHUNKS)
    found = embed_chunks(rows, HostedEmbedder("ollama", "m", 3, post=post, batch=3))
    assert all(r["values"][1] == i for r, i in ((r, int(r.id[1:])) for r in found.select("id", F.col("values")).collect()))
