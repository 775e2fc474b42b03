"""Schemas and settings shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ChunkConfig:
    """Sizes in code points."""

    max_size: int = 2000
    min_size: int = 250
    ideal_size: int = 1000


METADATA = "struct<description:string,sourceUrl:string,method:string,path:string,language:string,repository:string,version:string>"
CHUNK_FIELDS = f"id:string,documentPath:string,documentTitle:string,category:string,heading:string,content:string,metadata:{METADATA}"
CHUNKS = f"id string, documentPath string, documentTitle string, category string, heading string, content string, metadata {METADATA}"
RECORD_METADATA = ("documentPath", "documentTitle", "category", "heading", "content", "sourceUrl", "repository", "language", "method", "path", "version")


def chunk(id: str, path: str, title: str, category: str, heading: str, content: str, /, **metadata: str | None) -> dict:
    keys = ("description", "sourceUrl", "method", "path", "language", "repository", "version")
    return {"id": id, "documentPath": path, "documentTitle": title, "category": category, "heading": heading, "content": content, "metadata": {k: metadata.get(k) for k in keys}}
