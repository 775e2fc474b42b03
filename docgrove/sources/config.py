"""Configuration: loading with variables, validation, model registry and checks."""

from __future__ import annotations

import os
import re
from collections import Counter
from typing import Any

import yaml

from ..model import ChunkConfig
from .files import Source

# Standard places, and the known models: (least, most) or the allowed sizes, then the default.
STANDARD_PATHS = ("config.yaml", "config.yml", "config/config.yaml", "config/config.yml")
RANGE_MODELS = {
    ("openai", "text-embedding-3-large"): (1, 3072),
    ("openai", "text-embedding-3-small"): (1, 1536),
    ("gemini", "gemini-embedding-2-preview"): (1, 3072),
}
FIXED_MODELS = {
    ("openai", "text-embedding-ada-002"): (1536,),
    ("cohere", "embed-v4.0"): (256, 512, 1024, 1536),
    ("cohere", "embed-english-v3.0"): (1024,),
    ("cohere", "embed-english-light-v3.0"): (384,),
    ("cohere", "embed-multilingual-v3.0"): (1024,),
    ("cohere", "embed-multilingual-light-v3.0"): (384,),
    ("voyage", "voyage-4-large"): (256, 512, 1024, 2048),
    ("voyage", "voyage-4"): (256, 512, 1024, 2048),
    ("voyage", "voyage-4-lite"): (256, 512, 1024, 2048),
    ("voyage", "voyage-code-3"): (256, 512, 1024, 2048),
    ("voyage", "voyage-3.5"): (256, 512, 1024, 2048),
    ("voyage", "voyage-3.5-lite"): (256, 512, 1024, 2048),
    ("voyage", "voyage-3-large"): (256, 512, 1024, 2048),
    ("voyage", "voyage-3"): (1024,),
}
API_KEYS = {"openai": "OPENAI_API_KEY", "gemini": "GEMINI_API_KEY", "cohere": "COHERE_API_KEY", "voyage": "VOYAGE_API_KEY", "ollama": None}
PARSERS, TYPES = ("mdx", "markdown", "openapi", "html"), ("github", "gitlab", "local", "url")
SMALL_DIMENSION = 64


def substitute(text: str, env: dict[str, str] | None = None) -> str:
    """${NAME} and ${NAME:-default}; a name without a value stays."""
    env = os.environ if env is None else env
    return re.sub(r"\$\{([^}:]+)(?::-([^}]*))?\}", lambda m: env.get(m[1]) or (m[2] if m[2] is not None else m[0]), text)


def find(folder: str, path: str | None = None) -> str | None:
    return next((p for p in ([path] if path else [f"{folder}/{x}" for x in STANDARD_PATHS]) if os.path.exists(p)), None)


def parse(text: str, env: dict[str, str] | None = None) -> Any:
    """The configuration as written, variables put in; not validated."""
    return yaml.safe_load(substitute(text, env)) or {}


def unset(text: str, env: dict[str, str] | None = None) -> list[str]:
    """Names of ${NAME} without a default that the environment lacks."""
    env = os.environ if env is None else env
    named = re.findall(r"\$\{([^}:]+)(:-[^}]*)?\}", text)
    return sorted({name for name, default in named if not default and not env.get(name)})


def missing_key(config: Any, env: dict[str, str] | None = None) -> list[str]:
    """The variable of the embedding provider's key, if the environment lacks it."""
    env = os.environ if env is None else env
    name = API_KEYS.get(((config or {}).get("embeddings") or {}).get("provider", "openai")) if isinstance(config, dict) else None
    return [f"{name} is not set"] if name and not env.get(name) else []


def load(text: str, env: dict[str, str] | None = None) -> dict[str, Any]:
    config = parse(text, env)
    found = validate(config)
    if found["errors"]:
        raise ValueError("; ".join(found["errors"]))
    return config


def validate_embedding(provider: str, model: str, dimensions: int) -> tuple[list[str], list[str]]:
    """(errors, warnings) of a provider, model and dimension."""
    if provider not in API_KEYS:
        return [f"unknown embedding provider {provider!r}"], []
    errors, warnings = [], []
    key = (provider, model)
    if key in FIXED_MODELS:
        if dimensions not in FIXED_MODELS[key]:
            errors.append(f"{model} has dimensions {', '.join(map(str, FIXED_MODELS[key]))}, not {dimensions}")
    elif key in RANGE_MODELS:
        low, high = RANGE_MODELS[key]
        if not low <= dimensions <= high:
            errors.append(f"{model} has {low} to {high} dimensions, not {dimensions}")
        elif dimensions < SMALL_DIMENSION:
            warnings.append(f"{dimensions} dimensions are few")
    elif provider != "ollama":
        warnings.append(f"unknown model {model!r} of {provider}")
    return errors, warnings


def dimension_mismatch(index_dimension: int, config_dimension: int) -> str | None:
    return None if index_dimension == config_dimension else f"the index has {index_dimension} dimensions, the configuration {config_dimension}"


def validate(config: Any) -> dict[str, list[str]]:
    errors: list[str] = []
    if not isinstance(config, dict):
        return {"errors": ["the configuration is no mapping"], "warnings": []}
    sources = config.get("sources") or []
    if not sources:
        errors.append("no sources")
    for i, s in enumerate(sources):
        where = f"sources[{i}]"
        if not re.fullmatch(r"[a-z0-9-]+", str(s.get("name", ""))):
            errors.append(f"{where}.name: lower-case letters, digits and hyphens")
        if s.get("type") not in TYPES:
            errors.append(f"{where}.type: one of {', '.join(TYPES)}")
        if s.get("parser", "markdown") not in PARSERS:
            errors.append(f"{where}.parser: one of {', '.join(PARSERS)}")
        if not 1 <= int(s.get("maxPages", 500)) <= 2000:
            errors.append(f"{where}.maxPages: 1 to 2000")
    for key, low, high in (("maxChunkSize", 100, 10000), ("minChunkSize", 50, 5000), ("idealChunkSize", 100, 5000)):
        value = (config.get("chunking") or {}).get(key)
        if value is not None and not low <= value <= high:
            errors.append(f"chunking.{key}: {low} to {high}")
    e = config.get("embeddings") or {}
    more, warnings = validate_embedding(e.get("provider", "openai"), e.get("model", "text-embedding-3-large"), int(e.get("dimensions", 3072)))
    batch = (config.get("reindex") or {}).get("batchSize", 100)
    if not 1 <= batch <= 500:
        errors.append("reindex.batchSize: 1 to 500")
    return {"errors": errors + more, "warnings": warnings}


def chunk_config(config: dict) -> ChunkConfig:
    c = config.get("chunking") or {}
    return ChunkConfig(c.get("maxChunkSize", 2000), c.get("minChunkSize", 250), c.get("idealChunkSize", 1000))


def _links(source: dict) -> dict:
    """The settings of followLinks, which may also be a plain truth value."""
    found = source.get("followLinks")
    return found if isinstance(found, dict) else {}


def sources_of(config: dict, only: str | None = None) -> list[Source]:
    """Configured sources, or the one named; an unknown name is an error that lists the known."""
    found = [
        Source(s["name"], s.get("type", "local"), s.get("parser", "markdown"), s.get("path") or s.get("localPath") or "", s.get("displayName", ""), s.get("baseUrl", ""), s.get("repository", ""), s.get("language", "unknown"), bool(s.get("optional")), bool(s.get("followLinks")), int(_links(s).get("maxPages", s.get("maxPages", 500))), tuple(s.get("skipDirs", ())), tuple(s.get("skipFiles", ())),
            s.get("url", ""), s.get("saveAs"), tuple(_links(s).get("hostAllowlist", ())), _links(s).get("appendExtension", ""), s.get("host", ""), s.get("branch") or "main")
        for s in config.get("sources", [])
    ]
    chosen = [s for s in found if only is None or s.name == only]
    if not chosen:
        raise ValueError(f"no source {only!r}; there are {', '.join(s.name for s in found)}")
    return chosen


def count_results(checks: list[dict]) -> dict[str, int]:
    n = Counter(c["status"] for c in checks)
    return {k: n[k] for k in ("pass", "warn", "fail")}


def has_failure(checks: list[dict]) -> bool:
    return any(c["status"] == "fail" for c in checks)


def doctor(config: Any, env: dict[str, str] | None = None) -> list[dict]:
    """Checks of the configuration and of the provider's key."""
    env = os.environ if env is None else env
    found = validate(config)
    out = [{"status": "fail", "label": "configuration", "detail": x} for x in found["errors"]] + [{"status": "warn", "label": "configuration", "detail": x} for x in found["warnings"]]
    out = out or [{"status": "pass", "label": "configuration", "detail": None}]
    name = API_KEYS.get(((config or {}).get("embeddings") or {}).get("provider", "openai")) if isinstance(config, dict) else None
    if name:
        out.append({"status": "pass" if env.get(name) else "fail", "label": name, "detail": None})
    return out


def resolve_deletion(force: bool, interactive: bool, index_name: str, answer: str | None) -> tuple[bool, str]:
    """Whether a deletion may go on, and why."""
    if force:
        return True, "forced"
    if not interactive:
        return False, "not interactive"
    ok = (answer or "").strip() == index_name
    return ok, "confirmed" if ok else "name does not match"
