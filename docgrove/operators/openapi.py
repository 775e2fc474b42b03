"""OpenAPI specs to chunks: one per operation and one per code sample.

Specs are untyped, so rendering is Python on parsed objects; the lookup of
documentation URLs is a join (``with_doc_urls``).
"""

from __future__ import annotations

import json
import re
from typing import Any

import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import chunk
from .chunking import chunk_rows

METHODS = ("get", "post", "put", "patch", "delete")
SCHEMA_PREFIX = "#/components/schemas/"
DEPTH = 3
# Examples by string format.
FORMAT_EXAMPLES = {
    "date-time": "2024-01-15T10:30:00Z",
    "date": "2024-01-15",
    "email": "user@example.com",
    "uri": "https://example.com",
    "uuid": "550e8400-e29b-41d4-a716-446655440000",
}


def _name(ref: str) -> str:
    return ref.replace(SCHEMA_PREFIX, "")


class Schemas:
    """Named schemas of one spec: resolution, examples and property lists."""

    def __init__(self, named: dict[str, Any] | None):
        self.named = named or {}

    def resolve(self, ref: str) -> dict | None:
        """Follows references by name; null at a gap or a cycle."""
        seen: set[str] = set()
        name = _name(ref)
        while name not in seen:
            seen.add(name)
            schema = self.named.get(name)
            if not schema or "$ref" not in schema:
                return schema or None
            name = _name(schema["$ref"])
        return None

    def example(self, s: dict | None, depth: int = 0) -> Any:
        if depth > DEPTH or not s:
            return None
        if s.get("$ref"):
            return self.example(self.resolve(s["$ref"]), depth + 1)
        if "example" in s:
            return s["example"]
        if s.get("allOf"):
            merged: dict = {}
            for part in s["allOf"]:
                found = self.example(part, depth + 1)
                if isinstance(found, dict):
                    merged |= found
            return merged or None
        for choice in ("oneOf", "anyOf"):
            if s.get(choice):
                return self.example(s[choice][0], depth + 1)
        if s.get("enum"):
            return s["enum"][0]
        kind = s.get("type")
        if isinstance(kind, list):
            kind = next((k for k in kind if k != "null"), "string")
        by_kind = {"object": self._object, "array": self._array, "string": self._string, "integer": self._number, "number": self._number, "boolean": lambda x, _: x.get("default", True)}
        return by_kind[kind](s, depth) if kind in by_kind else None

    def _object(self, s: dict, depth: int) -> dict:
        """Required properties, and others while there are fewer than five."""
        out: dict = {}
        required = set(s.get("required") or ())
        for name, prop in (s.get("properties") or {}).items():
            if name in required or len(out) < 5:
                found = self.example(prop, depth + 1)
                if found is not None:
                    out[name] = found
        return out

    def _array(self, s: dict, depth: int) -> list:
        found = self.example(s.get("items"), depth + 1)
        return [] if found is None else [found]

    @staticmethod
    def _string(s: dict, depth: int) -> str:
        return FORMAT_EXAMPLES.get(s.get("format")) or s.get("default") or "string"

    @staticmethod
    def _number(s: dict, depth: int) -> Any:
        return next((s[k] for k in ("default", "minimum") if s.get(k) is not None), 0)

    def properties(self, s: dict | None, indent: str = "", depth: int = 0) -> str:
        """A nested bullet list of properties."""
        if not s or depth > DEPTH:
            return ""
        if s.get("$ref"):
            return self.properties(self.resolve(s["$ref"]), indent, depth + 1)
        if s.get("allOf"):
            return "\n".join(filter(None, (self.properties(x, indent, depth + 1) for x in s["allOf"])))
        required, out = set(s.get("required") or ()), []
        for name, p in (s.get("properties") or {}).items():
            kind = type_name(p) + (f" ({p['format']})" if p.get("format") else "")
            if p.get("nullable") or (isinstance(p.get("type"), list) and "null" in p["type"]):
                kind += " | null"
            line = f"{indent}- **{name}** ({kind}) - {'Required' if name in required else 'Optional'}"
            out.append(line + (f" - {p['description']}" if p.get("description") else "") + _allowed(p) + _bounds(p))
            if p.get("type") == "object" and p.get("properties") and depth < 2:
                out.append(self.properties(p, indent + "  ", depth + 1))
        return "\n".join(filter(None, out))


def _allowed(s: dict) -> str:
    return f" (Allowed: {', '.join(f'`{_js(e)}`' for e in s['enum'])})" if s.get("enum") else ""


def _bounds(s: dict) -> str:
    found = [f"{word}: {_js(s[key])}" for key, word in (("minimum", "min"), ("maximum", "max")) if key in s]
    return f" [{', '.join(found)}]" if found else ""


def _js(v: Any) -> str:
    return v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)


def _short_type(s: dict) -> str:
    return _name(s["$ref"]) if s.get("$ref") else s.get("type") or ""


def type_name(s: dict) -> str:
    if s.get("$ref"):
        return _name(s["$ref"])
    if s.get("allOf"):
        return " & ".join(filter(None, map(_short_type, s["allOf"]))) or "object"
    if s.get("oneOf") or s.get("anyOf"):
        return " | ".join(filter(None, map(_short_type, s.get("oneOf") or s.get("anyOf")))) or "any"
    kind = s.get("type")
    if isinstance(kind, list):
        return " | ".join(k for k in kind if k != "null")
    if kind == "array" and s.get("items"):
        return f"array[{_short_type(s['items']) or 'any'}]"
    return kind or "any"


def parameter_line(p: dict) -> str:
    s = p.get("schema") or {}
    line = f"- **{p['name']}** ({s.get('type') or 'string'}) - {'Required' if p.get('required') else 'Optional'}"
    line += f" - {p['description']}" if p.get("description") else ""
    line += _allowed(s)
    for key, word in (("default", "Default"), ("example", "Example")):
        if key in s:
            line += f" ({word}: `{_js(s[key])}`)"
    return line + _bounds(s)


def parameter_lines(parameters: list[dict] | None) -> str:
    if not parameters:
        return "None"
    out = []
    for place in ("path", "query", "header"):
        group = [p for p in parameters if p.get("in") == place]
        if group:
            out += [f"#### {place.title()} Parameters", *map(parameter_line, group)]
    return "\n".join(out)


def _fenced_json(value: Any) -> list[str]:
    return ["```json", json.dumps(value, indent=2, ensure_ascii=False), "```"]


def operation_id(method: str, path: str, op: dict) -> str:
    return op.get("operationId") or f"{method}_{path.replace('/', '_')}"


def action_name(op_id: str) -> str:
    return " ".join(w[:1].upper() + w[1:] for w in op_id.split("_"))


def fallback_url(base: str, path: str, op_id: str) -> str:
    resource = next((p for p in path.split("/") if p), "misc")
    return f"{base}/{resource}/{re.sub('_proxy$', '', re.sub('_handler$', '', op_id)).replace('_', '-')}"


def render_operation(method: str, path: str, op: dict, schemas: Schemas, servers: list[dict]) -> str:
    """The Markdown of one operation, section by section."""

    def described(s: dict | None) -> str:
        return schemas.properties(schemas.resolve(s["$ref"]) if s and s.get("$ref") else s)

    op_id = operation_id(method, path, op)
    out = [f"## {method.upper()} {path}", "", "### Description", op.get("summary") or op.get("description") or f"{action_name(op_id)} endpoint.", ""]
    out += ["### Method", method.upper(), "", "### Endpoint", path, ""]
    if servers:
        out += ["#### Base URLs", *(f"- {s.get('url')} ({s.get('description', 'undefined')})" for s in servers), ""]
    out += ["### Parameters", parameter_lines(op.get("parameters")), ""]
    body = ((op.get("requestBody") or {}).get("content") or {}).get("application/json")
    if body is not None:
        out.append("### Request Body")
        if body.get("schema"):
            out.append(described(body["schema"]))
        out.append("")
        shown = body.get("example") or schemas.example(body.get("schema"))
        if shown is not None and shown not in ("", 0, False):
            out += ["### Request Example", *_fenced_json(shown), ""]
    if op.get("responses"):
        out.append("### Response")
        for code, response in op["responses"].items():
            code = str(code)
            label = {"2": "Success", "4": "Client Error"}.get(code[:1], "Error")
            out.append(f"#### {label} Response ({code})")
            if response.get("description"):
                out.append(response["description"])
            answer = (response.get("content") or {}).get("application/json")
            if answer is not None:
                listed = described(answer.get("schema")) if answer.get("schema") else ""
                if listed:
                    out.append(listed)
                shown = answer.get("example") or schemas.example(answer.get("schema"))
                if code.startswith("2") and shown is not None and shown not in ("", 0, False):
                    out += ["", "#### Response Example", *_fenced_json(shown)]
            out.append("")
    return "\n".join(out).strip()


def spec_chunks(spec: dict, base_url: str, doc_urls: dict[str, str] | None = None) -> list[dict]:
    """Chunks of a parsed spec: paths in order, methods in fixed order, samples after their operation."""
    if not base_url:
        raise ValueError("OpenAPI parsing needs a base URL")
    schemas, servers, out = Schemas((spec.get("components") or {}).get("schemas")), spec.get("servers") or [], []
    for path, item in (spec.get("paths") or {}).items():
        for method in METHODS:
            op = (item or {}).get(method)
            if not op:
                continue
            op_id, verb = operation_id(method, path, op), method.upper()
            url = (doc_urls or {}).get(f"{verb} {path}") or fallback_url(base_url, path, op_id)
            place = f"api-reference/{((op.get('tags') or ['API'])[0]).lower()}/{op_id.replace('_', '-')}"
            name = action_name(op_id)
            out.append(chunk(f"api/{op_id}", place, f"{name} - {verb} {path}", "api-reference", name, render_operation(method, path, op, schemas, servers), description=op.get("summary") or op.get("description"), sourceUrl=url, method=verb, path=path))
            for s in op.get("x-codeSamples") or ():
                body = f"{s['lang']} code example for `{verb} {path}`\n\n```{s['lang'].lower()}\n{s['source']}\n```"
                out.append(chunk(f"api/{op_id}/code/{s['lang'].lower()}", place, f"{name} - {s['lang']} Example", "api-reference", f"{s['lang']} Example", body.strip(), description=f"{s['lang']} code example for {name}", sourceUrl=url, language=s["lang"], method=verb, path=path))
    return out


def _no_json(constant: str) -> None:
    raise ValueError(f"{constant} is no JSON")


def load_spec(text: str) -> Any:
    """The object of a JSON or YAML text.  YAML's parser reads JSON too, but takes some hundred times as long for it."""
    try:
        return json.loads(text, parse_constant=_no_json)
    except ValueError:
        # libyaml's loader where PyYAML was built with it
        return yaml.load(text, getattr(yaml, "CSafeLoader", yaml.SafeLoader))


def openapi_documents(files: DataFrame, base_url: str) -> DataFrame:
    """Chunks of rows (path, content) that hold YAML or JSON specs."""
    return chunk_rows(files, lambda r: spec_chunks(load_spec(r["content"]), base_url))


def endpoint_content(spec: dict, method: str, path: str) -> str | None:
    """The Markdown of one endpoint, with or without a trailing slash; null if absent."""
    paths = spec.get("paths") or {}
    item = paths.get(path) or paths.get(path[:-1] if path.endswith("/") else path + "/")
    op = (item or {}).get(method.lower())
    return render_operation(method, path, op, Schemas((spec.get("components") or {}).get("schemas")), spec.get("servers") or []) if op else None


def doc_url_map(files: DataFrame, base_url: str) -> DataFrame:
    """(key, url): 'METHOD /path' of ``openapi:`` frontmatter in .mdx rows (path, content); the later file wins."""
    pattern = r'(?dm)^openapi:\s*"?(\w+)\s+([^"\n\r]+)"?'
    found = files.filter(F.col("path").endswith(".mdx")).select("path", F.upper(F.regexp_extract("content", pattern, 1)).alias("m"), F.regexp_extract("content", pattern, 2).alias("p")).filter("m <> ''")
    key = F.concat("m", F.lit(" "), F.regexp_replace(F.trim("p"), '"$', ""))
    url = F.concat(F.lit(base_url + "/"), F.regexp_replace("path", r"\.mdx$", ""))
    return found.groupBy(key.alias("key")).agg(F.max_by(url, "path").alias("url"))


def with_doc_urls(operations: DataFrame, urls: DataFrame, base_url: str) -> DataFrame:
    """operations (method, path, operation_id, ...) with their documentation url; the left join is Spark's to plan."""
    key = F.concat(F.upper("method"), F.lit(" "), F.col("path"))
    slug = F.regexp_replace(F.regexp_replace(F.regexp_replace("operation_id", "_handler$", ""), "_proxy$", ""), "_", "-")
    first = F.coalesce(F.get(F.filter(F.split("path", "/"), lambda p: p != ""), 0), F.lit("misc"))
    return operations.withColumn("key", key).join(urls, "key", "left").withColumn("url", F.coalesce("url", F.concat_ws("/", F.lit(base_url), first, slug))).drop("key")
