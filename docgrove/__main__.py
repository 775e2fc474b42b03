"""Command line: reindex, search, export, upkeep of the index, and checks of a configuration file.

    python -m docgrove --index PATH reindex [--config FILE] [--source NAME] [--dry-run] [--dump PATH]
    python -m docgrove --index PATH search QUERY [--limit N]
    python -m docgrove --index PATH export DUMP OUT [--overwrite]
    python -m docgrove --index PATH clear [--force]
    python -m docgrove --index PATH compact
    python -m docgrove --index PATH lists [--number N] [--recall R]
    python -m docgrove doctor [--config FILE]
    python -m docgrove validate [--config FILE] [--check-env]
"""

from __future__ import annotations

import argparse
import os
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .functions.hosted import HostedEmbedder
from .functions.tokens import TokenCap
from .functions.vectors import HashingEmbedder
from .plans.engine import Engine
from .sources import config as conf


def _arguments(args: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser("docgrove", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--index", default="index")
    parser.add_argument("--name", default="docs")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("reindex", "doctor", "validate"):
        commands.add_parser(name).add_argument("--config")
    reindex = commands.choices["reindex"]
    reindex.add_argument("--source")
    reindex.add_argument("--dry-run", action="store_true")
    reindex.add_argument("--dump")
    reindex.add_argument("--vocabulary", help="file of (base64 token, rank) lines that counts the tokens of embedding inputs")
    reindex.add_argument("--hosted", action="store_true", help="embed by the provider that the configuration names, not offline")
    commands.choices["validate"].add_argument("--check-env", action="store_true")
    commands.add_parser("compact")
    lists = commands.add_parser("lists")
    lists.add_argument("--number", type=int)
    lists.add_argument("--recall", type=float, default=0.95)
    search = commands.add_parser("search")
    search.add_argument("query")
    search.add_argument("--limit", type=int)
    search.add_argument("--exact", action="store_true")
    search.add_argument("--hosted", action="store_true")
    search.add_argument("--config")
    export = commands.add_parser("export")
    export.add_argument("dump")
    export.add_argument("out")
    export.add_argument("--overwrite", action="store_true")
    commands.add_parser("clear").add_argument("--force", action="store_true")
    return parser.parse_args(args)


def _config(path: str | None) -> dict:
    found = path or next((p for p in conf.STANDARD_PATHS if Path(p).exists()), None)
    if found is None:
        raise FileNotFoundError(f"no configuration at {', '.join(conf.STANDARD_PATHS)}")
    return conf.load(Path(found).read_text())


def _validate(path: str | None, check_env: bool) -> int:
    """Prints errors and warnings of a configuration, and with check_env of variables that it names and the environment lacks."""
    found = next((p for p in ([path] if path else conf.STANDARD_PATHS) if Path(p).exists()), None)
    if found is None:
        print(f"error: no configuration at {path or ', '.join(conf.STANDARD_PATHS)}")
        return 1
    text = Path(found).read_text()
    result = conf.validate(conf.parse(text))
    errors = result["errors"] + ([f"{name} is not set" for name in conf.unset(text)] + conf.missing_key(conf.parse(text)) if check_env else [])
    for kind, lines in (("error", errors), ("warning", result["warnings"])):
        for line in lines:
            print(f"{kind}: {line}")
    if not errors:
        print(f"{found} is valid")
    return int(bool(errors))


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _arguments(sys.argv[1:] if args is None else args)
    if a.command == "doctor":
        checks = conf.doctor(_config(a.config))
        for c in checks:
            print(f"{c['status']:4} {c['label']}" + (f": {c['detail']}" if c["detail"] else ""))
        print(conf.count_results(checks))
        return int(conf.has_failure(checks))
    if a.command == "validate":
        return _validate(a.config, a.check_env)
    spark = spark or SparkSession.builder.appName("docgrove").getOrCreate()
    hosted = getattr(a, "hosted", False)
    settings = _config(a.config) if a.command == "reindex" or hosted else {}
    dimension = int((settings.get("embeddings") or {}).get("dimensions", 256))
    engine = Engine(spark, a.index, HashingEmbedder(dimension), a.name)
    if a.command in ("search", "clear", "compact", "lists"):
        # an index that is there says how many dimensions it has
        engine = Engine(spark, a.index, HashingEmbedder(engine.index.stats()["dimension"]), a.name)
    if hosted:
        engine = Engine(spark, a.index, HostedEmbedder.of(settings, dict(os.environ)), a.name)
    if a.command == "reindex" and a.vocabulary:
        engine.cap = TokenCap.from_file(a.vocabulary)
    if a.command == "reindex":
        sources = conf.sources_of(settings, a.source)

        def show(first: DataFrame) -> None:
            for r in first.collect():
                print(f"{r['path']}: {r['heading']} ({r['category']}, {r['size']} characters)")

        row = engine.reindex(sources, conf.chunk_config(settings), dry_run=a.dry_run, dump=a.dump, show=show if a.dry_run else None).first()
        print(f"{row['totalChunks']} chunks from {', '.join(row['sources'])}")
    elif a.command == "search":
        print(engine.search_text(a.query, a.limit, a.exact))
    elif a.command == "compact":
        print("compacted" if engine.index.compact() else "another writer came first")
    elif a.command == "lists":
        print(f"{engine.index.fit_lists(a.number, a.recall)} lists are probed for a recall of {a.recall:g}")
    elif a.command == "export":
        engine.export_text(a.dump, a.out, a.overwrite)
    else:
        answer = None if a.force or not sys.stdin.isatty() else input(f"Type {a.name} to empty the index: ")
        ok, why = engine.clear(a.force, sys.stdin.isatty(), answer)
        print(why)
        return int(not ok)
    return 0


if __name__ == "__main__":
    sys.exit(main())
