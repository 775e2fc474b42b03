"""File sources as DataFrames: discovery rules of Markdown, MDX, HTML and OpenAPI trees.

Trees that are shared as a file system are listed by ``docgrove_tree``, which enters no folder
and opens no file that the rules skip.  Other stores are listed by Spark's
``binaryFile``, and the rules are predicates on the relative path.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import CHUNK_FIELDS, CHUNKS
from .datasources import register, tree_source

EXTENSIONS = {"markdown": r"(?i)\.md$", "mdx": r"\.(mdx?|MDX?)$", "html": r"(?i)\.html?$", "openapi": r"(?i)\.(ya?ml|json)$"}


@dataclass(frozen=True)
class Source:
    """One configured source of documents."""

    name: str
    type: str = "local"  # local, url, github, gitlab
    parser: str = "markdown"
    path: str = ""
    display_name: str = ""
    base_url: str = ""
    repository: str = ""
    language: str = "unknown"
    optional: bool = False
    follow_links: bool = False
    max_pages: int = 500
    skip_dirs: tuple[str, ...] = field(default=())
    skip_files: tuple[str, ...] = field(default=())
    url: str = ""
    save_as: str | None = None
    hosts: tuple[str, ...] = field(default=())
    append_extension: str = ""
    host: str = ""
    branch: str = "main"


def scan(spark: SparkSession, root: str, parser: str, skip_dirs: tuple[str, ...] = (), skip_files: tuple[str, ...] = ()) -> DataFrame:
    """(path, content) under root, path relative to it.

    Names are skipped without regard to case; HTML trees also skip dot-directories;
    of specs only the first by name, not in a subdirectory, is taken.
    """
    root = root.rstrip("/")
    at = re.fullmatch(r"(?:file:(?://)?)?(/.*|[^:]*)", root)
    if at:
        register(spark, tree_source(EXTENSIONS[parser]))
        options = {"skipDirs": "\n".join(skip_dirs), "skipFiles": "\n".join(skip_files), "hiddenDirs": str(parser != "html").lower(), "recursive": str(parser != "openapi").lower()}
        found = spark.read.format("docgrove_tree").options(path=os.path.abspath(at[1]), **options).load()
        return select_files(found.select("path", F.decode("content", "utf-8").alias("content")), parser, skip_dirs, skip_files)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", parser != "openapi").load(root)
    full = F.col("path")
    # the part after the root, whatever scheme the listing puts in front
    path = F.substring_index(full, root + "/", -1)
    return select_files(files.select(path.alias("path"), F.decode("content", "utf-8").alias("content")), parser, skip_dirs, skip_files)


def select_files(files: DataFrame, parser: str, skip_dirs: tuple[str, ...] = (), skip_files: tuple[str, ...] = ()) -> DataFrame:
    """The rows of (path, ...) that the parser's discovery rules take."""
    parts = F.split("path", "/")
    dirs = F.slice(parts, F.lit(1), F.size(parts) - 1)
    name = F.lower(F.try_element_at(parts, F.lit(-1)))
    found = files.filter(F.col("path").rlike(EXTENSIONS[parser]))
    if skip_dirs:
        found = found.filter(~F.exists(dirs, lambda d: F.lower(d).isin([x.lower() for x in skip_dirs])))
    if skip_files:
        found = found.filter(~name.isin([x.lower() for x in skip_files]))
    if parser == "html":
        found = found.filter(~F.exists(dirs, lambda d: d.startswith(".")))
    if parser == "openapi":
        found = found.filter(F.size(parts) == 1).orderBy("path").limit(1)
    return found


def read_chunk_dump(spark: SparkSession, path: str) -> DataFrame:
    """The chunks of a dump: of the engine's folder, or of one JSON file with an array `chunks`."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/chunks")
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.read.schema(f"{CHUNKS}, source string").json(folder.toString())
    return spark.read.schema(f"chunks array<struct<{CHUNK_FIELDS}>>").option("multiLine", True).json(path).select(F.explode("chunks").alias("c")).select("c.*")
