"""The command line: python -m weftline COMMAND ... --store FOLDER. Output is JSON lines, numbers to three digits."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from weftline.api import Engine
from weftline.config import Config
from weftline.plans.search import MODES, SearchRequest
from weftline.sources.registry import Registry


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="weftline")
    out.add_argument("--store", default=".weftline", help="folder of the index")
    out.add_argument("--config", default="", help="YAML settings")
    out.add_argument("--registry", default=str(Path.home() / ".weftline" / "projects.json"))
    commands = out.add_subparsers(dest="command", required=True)
    for name in ("index", "reembed"):
        c = commands.add_parser(name)
        c.add_argument("root")
        c.add_argument("--full", action="store_true", default=name == "reembed")
    c = commands.add_parser("search")
    c.add_argument("query")
    c.add_argument("--limit", type=int, default=10)
    c.add_argument("--mode", choices=MODES)
    c.add_argument("--filter", action="append", default=[], metavar="NAME=VALUE")
    c.add_argument("--active-file")
    c.add_argument("--full", action="store_true", help="with contents")
    c = commands.add_parser("trace")
    c.add_argument("entity")
    c.add_argument("--direction", choices=("both", "inbound", "outbound"), default="both")
    c.add_argument("--depth", type=int, default=2)
    c.add_argument("--type", action="append", default=[])
    c = commands.add_parser("explain")
    c.add_argument("entity")
    for name in ("status", "doctor", "projects"):
        commands.add_parser(name)
    return out


def shown(value: object) -> object:
    return round(value, 3) if isinstance(value, float) else value


def rows(df: DataFrame) -> list[dict]:
    """Rows of a result that its limit or depth bounds, without nulls."""
    return [{k: shown(v) for k, v in r.asDict(recursive=True).items() if v is not None} for r in df.collect()]


def run(args: argparse.Namespace, spark: SparkSession) -> list[dict]:
    registry = Registry(args.registry)
    if args.command == "projects":
        return registry.list()
    engine = Engine.open(spark, args.store, Config.from_yaml(args.config) if args.config else None)
    if args.command in ("index", "reembed"):
        changes = engine.index(args.root, args.full)
        registry.register(Path(args.root).resolve().name, args.root, args.store)
        return rows(changes.groupBy("change").count())
    if args.command == "search":
        request = SearchRequest(args.query, args.limit, args.mode, filters=dict(x.split("=", 1) for x in args.filter), active_file=args.active_file)
        r = engine.respond(request)
        from weftline.plans.search import compact

        head = {"query": r.query_enhanced, "intent": r.intent, "mode": r.mode_used, "confidence": shown(r.confidence), "label": r.confidence_label, "suggestion": r.suggestion, "candidates": r.total_candidates}
        return [head, *rows(compact(r.results, args.full))]
    if args.command == "trace":
        return rows(engine.trace(args.entity, args.direction, args.depth, tuple(args.type)))
    if args.command == "explain":
        return rows(engine.explain(args.entity))
    if args.command == "status":
        return [engine.status()]
    return [{"check": name, "passed": ok, "hint": hint} for name, ok, hint in engine.health()]


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("weftline").getOrCreate()
    found = run(args, spark)
    for row in found:
        print(json.dumps(row, default=str))
    return int(args.command == "doctor" and not all(r["passed"] for r in found))


if __name__ == "__main__":
    sys.exit(main())
