"""Command line: index, add, files, search, stats."""

from __future__ import annotations

import argparse
import dataclasses
import json
import os
import sys

from pyspark.sql import SparkSession

from notegrove.config import EmbeddingConfig, EngineConfig, GroveError
from notegrove.plans.embedders import HttpEmbedder
from notegrove.plans.engine import Engine


def parser() -> argparse.ArgumentParser:
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("-w", "--workspace", default=".")
    common.add_argument("--embedding-model")
    common.add_argument("--api-base")
    common.add_argument("-q", "--quiet", action="store_true")
    top = argparse.ArgumentParser(prog="notegrove", description="Search a folder of Markdown notes.")
    commands = top.add_subparsers(dest="command", required=True)
    index = commands.add_parser("index", parents=[common])
    index.add_argument("--force", action="store_true")
    add = commands.add_parser("add", parents=[common])
    add.add_argument("file")
    add.add_argument("--force", action="store_true")
    listing = commands.add_parser("files", parents=[common])
    listing.add_argument("--source")
    listing.add_argument("--json", action="store_true")
    search = commands.add_parser("search", parents=[common])
    search.add_argument("query")
    search.add_argument("--strategy", default=None)
    search.add_argument("-n", "--max-results", type=int)
    search.add_argument("--min-score", type=float)
    search.add_argument("--source")
    search.add_argument("--mmr", type=float, dest="mmr_lambda", metavar="LAMBDA")
    search.add_argument("--decay", type=float, dest="decay_half_life_days", metavar="DAYS")
    search.add_argument("--no-sync", action="store_true")
    search.add_argument("--json", action="store_true")
    stats = commands.add_parser("stats", parents=[common])
    stats.add_argument("--json", action="store_true")
    return top


def columns(rows: list[dict], names: list[str]) -> str:
    """Rows as text in columns as wide as they need."""
    cells = [names, *([("-" if r[n] is None else f"{r[n]:.4f}" if isinstance(r[n], float) else str(r[n])) for n in names] for r in rows)]
    widths = [max(len(row[k]) for row in cells) for k in range(len(names))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(row, widths, strict=True)).rstrip() for row in cells)


def run(args: argparse.Namespace, engine: Engine) -> str:
    if args.command in ("index", "add"):
        done = engine.index(args.force) if args.command == "index" else engine.add(os.path.abspath(args.file), args.force)
        return "\n".join(f"{k}: {v:.0f}" if isinstance(v, float) else f"{k}: {v}" for k, v in dataclasses.asdict(done).items())
    if args.command == "files":
        rows = [r.asDict() for r in engine.files(args.source).collect()]
        return json.dumps(rows, indent=2) if args.json else columns(rows, ["path", "source", "chunks", "size", "is_evergreen"]) if rows else "No files indexed."
    if args.command == "search":
        wanted = {k: getattr(args, k) for k in ("strategy", "max_results", "min_score", "source", "mmr_lambda", "decay_half_life_days")}
        rows = [r.asDict() for r in engine.search(args.query, **wanted).collect()]
        if args.json:
            return json.dumps(rows, indent=2)
        for r in rows:
            r["lines"], r["preview"] = f"{r['start_line']}-{r['end_line']}", r["snippet"].replace("\n", " ")[:60]
        return columns(rows, ["rank", "score", "vector_score", "text_score", "source", "path", "lines", "preview"]) if rows else "No results."
    status = engine.status()
    stale = "\nFiles have changed since they were indexed." if status["dirty"] else ""
    return json.dumps(status, indent=2) if args.json else "\n".join(f"{k}: {v}" for k, v in status.items()) + stale


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("notegrove").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    config = EngineConfig(workspace_dir=os.path.abspath(args.workspace))
    if getattr(args, "no_sync", False):
        config = dataclasses.replace(config, sync=dataclasses.replace(config.sync, on_search=False))
    provider = HttpEmbedder(EmbeddingConfig(model=args.embedding_model, api_base=args.api_base)) if args.embedding_model else None
    try:
        with Engine(spark, config, provider) as engine:
            print(run(args, engine))
    except GroveError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
