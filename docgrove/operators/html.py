"""HTML pages to Markdown with the standard library's parser; iterative, so depth cannot overflow.

Rules (our own, deterministic): ATX headings, ``-`` bullets, numbered lists, fenced
code for pre, backticks for code, ** and _ for strong and em, [text](href) for links,
> for quotes, tables as | rows.  White space in prose collapses.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.text import trimmed
from ..model import ChunkConfig
from .chunking import chunk_rows, readme_chunks

# Boilerplate elements and main containers, the latter in order of choice.
BOILERPLATE = ("script", "style", "noscript", "nav", "header", "footer", "aside", "form", "iframe", "svg")
CONTAINERS = ("main", "article", '[role="main"]', "#content", ".content")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = {"p", "div", "section", "article", "main", "body", "html", "ul", "ol", "table", "blockquote", "pre", "figure", "dl", "dd", "dt", "h1", "h2", "h3", "h4", "h5", "h6", "li", "tr", "header", "footer"}


class _Node:
    __slots__ = ("tag", "attrs", "kids", "parent")

    def __init__(self, tag: str, attrs: dict, parent: _Node | None):
        self.tag, self.attrs, self.kids, self.parent = tag, attrs, [], parent


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("p", "li", "tr", "td", "th", "dt", "dd") and self.at.tag == tag:
            self.at = self.at.parent
        node = _Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.kids.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.kids.append(_Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        x = self.at
        while x.parent is not None and x.tag != tag:
            x = x.parent
        if x.parent is not None:
            self.at = x.parent

    def handle_data(self, data: str) -> None:
        self.at.kids.append(data)


def _walk(node: _Node):
    stack = [node]
    while stack:
        x = stack.pop()
        yield x
        if isinstance(x, _Node):
            stack.extend(reversed(x.kids))


def _text(node: _Node) -> str:
    return "".join(x for x in _walk(node) if isinstance(x, str))


def _matches(x: _Node, selector: str) -> bool:
    if selector.startswith("#"):
        return x.attrs.get("id") == selector[1:]
    if selector.startswith("."):
        return selector[1:] in x.attrs.get("class", "").split()
    if selector.startswith("["):
        name, value = selector[1:-1].split("=")
        return x.attrs.get(name) == value.strip('"')
    return x.tag == selector


def _first(root: _Node, selector: str) -> _Node | None:
    return next((x for x in _walk(root) if isinstance(x, _Node) and _matches(x, selector)), None)


def main_content(html: str) -> tuple[str, _Node]:
    """Title (title element, else the first h1) and the main container without boilerplate."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    title = next((t for s in ("title", "h1") if (x := _first(tree.root, s)) and (t := trimmed(_text(x)))), "")
    for x in _walk(tree.root):
        if isinstance(x, _Node):
            x.kids = [k for k in x.kids if isinstance(k, str) or k.tag not in BOILERPLATE]
    return title, next((x for s in (*CONTAINERS, "body") if (x := _first(tree.root, s))), tree.root)


def to_markdown(node: _Node) -> str:
    out: list[str] = []
    stack: list[tuple] = [("open", node, "")]
    lists: list[int | None] = []
    while stack:
        kind, x, _ = stack.pop()
        if kind == "text":
            out.append(x)
            continue
        if kind == "unlist":
            lists.pop()
            out.append("\n\n" if not lists else "")
            continue
        if isinstance(x, str):
            out.append(re.sub(r"\s+", " ", x))
            continue
        before, after, tag = "", "", x.tag
        if tag == "pre":
            code = next((k for k in x.kids if isinstance(k, _Node) and k.tag == "code"), None)
            language = next((c[9:] for c in (code.attrs.get("class", "").split() if code else []) if c.startswith("language-")), "")
            out.append(f"\n\n```{language}\n{_text(x).strip(chr(10))}\n```\n\n")
            continue
        if tag == "code":
            out.append(f"`{_text(x)}`" if _text(x).strip() else "")
            continue
        if tag in ("head", "title", "template"):
            continue
        if re.fullmatch("h[1-6]", tag):
            before, after = "\n\n" + "#" * int(tag[1]) + " ", "\n\n"
        elif tag in ("strong", "b"):
            before = after = "**"
        elif tag in ("em", "i"):
            before = after = "_"
        elif tag == "a" and x.attrs.get("href"):
            before, after = "[", f"]({x.attrs['href']})"
        elif tag == "img":
            before = f"![{x.attrs.get('alt', '')}]({x.attrs.get('src', '')})"
        elif tag == "br":
            before = "  \n"
        elif tag == "hr":
            before = "\n\n* * *\n\n"
        elif tag in ("ul", "ol"):
            before = "\n\n" if not lists else "\n"
            lists.append(0 if tag == "ol" else None)
            stack.append(("unlist", x, ""))
        elif tag == "li":
            if lists and lists[-1] is not None:
                lists[-1] += 1
            mark = f"{lists[-1]}." if lists and lists[-1] is not None else "-"
            before, after = "\n" + "    " * max(0, len(lists) - 1) + mark + " ", ""
        elif tag == "blockquote":
            before, after = "\n\n> ", "\n\n"
        elif tag in ("td", "th"):
            before = "| "
            after = " "
        elif tag == "tr":
            before, after = "\n", "|"
        elif tag in BLOCKS and not (tag == "p" and lists):
            before = after = "\n\n"
        out.append(before)
        stack.append(("text", after, ""))
        stack.extend(("open", k, "") for k in reversed(x.kids))
    text = "".join(out)
    parts = re.split(r"(?s)(\n```.*?\n```)", text)
    tidy = [p if i % 2 else re.sub(r"[ \t]+\n(?!\n?$)", "\n", re.sub(r"\n[ \t]+(?![-\d ])", "\n", p)) for i, p in enumerate(parts)]
    return trimmed(re.sub(r"\n{3,}", "\n\n", "".join(tidy)))


def html_to_markdown(html: str) -> tuple[str, str]:
    title, container = main_content(html)
    body = to_markdown(container)
    return title, f"# {title}\n\n{body}" if title else body


def html_chunks(html: str, file: str, url: str, context: str, language: str = "unknown", config: ChunkConfig = ChunkConfig()) -> list[dict]:
    """README rules on the page's Markdown, with ids by file; a blank page gives none."""
    title, markdown = html_to_markdown(html)
    if not trimmed(markdown):
        return []
    found = readme_chunks(markdown, url, context, language, config)
    return [c | {"id": f"{context}/{file}#{i}", "documentPath": f"{context}/{file}", "documentTitle": title or context} for i, c in enumerate(found)]


def html_documents(files: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Chunks of rows (context, path, content, url, language); a bad page is an error row, not a failure."""
    return chunk_rows(files, lambda r: html_chunks(r["content"], r["path"], r["url"] or "", r["context"], r["language"] or "unknown", config))


def pages_markdown(pages: DataFrame) -> DataFrame:
    """page_id, title and Markdown of raw pages."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [html_to_markdown(x.as_py() or "") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([f[k] for f in found], pa.string()) for k in (0, 1)]], names=["page_id", "title", "markdown"])

    return pages.select("page_id", "html").mapInArrow(convert, f"page_id {pages.schema['page_id'].dataType.simpleString()}, title string, markdown string")
