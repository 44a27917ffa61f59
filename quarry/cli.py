"""python -m quarry.cli COMMAND: ingest, ingest-dir, docs, search, ask, graph-build, explore, connect, stats, graph-export, evaluate, serve, mcp."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from quarry import mcp
from quarry.config import Settings
from quarry.engine import Engine
from quarry.operators import evaluate, graph
from quarry.server import serve
from quarry.sources import remote


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarry")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("ingest").add_argument("references", nargs="+")
    sub.add_parser("ingest-dir").add_argument("folder")
    sub.add_parser("docs")
    sub.add_parser("stats")
    s = sub.add_parser("search")
    s.add_argument("question")
    s.add_argument("--mode", default="hybrid", choices=("vector", "lexical", "graph", "hybrid"))
    s.add_argument("--limit", type=int, default=5)
    sub.add_parser("ask").add_argument("question")
    b = sub.add_parser("graph-build")
    b.add_argument("--limit", type=int)
    b.add_argument("--rebuild", action="store_true")
    e = sub.add_parser("explore")
    e.add_argument("name")
    e.add_argument("--depth", type=int, default=1)
    c = sub.add_parser("connect")
    c.add_argument("a")
    c.add_argument("b")
    c.add_argument("--max-hops", type=int, default=4)
    sub.add_parser("graph-export").add_argument("path")
    sub.add_parser("evaluate").add_argument("questions")
    sub.add_parser("mcp")
    sub.add_parser("serve").add_argument("--port", type=int, default=8000)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    for stream in (sys.stdout, sys.stderr):  # names have accents, whatever the console's code page
        if hasattr(stream, "reconfigure"):
            stream.reconfigure(encoding="utf-8", errors="replace")
    engine = Engine(spark or SparkSession.builder.appName("quarry").getOrCreate(), Settings.load())
    show = lambda x: print(json.dumps(x, ensure_ascii=False, indent=1, default=str))
    match args.command:
        case "ingest":
            found = [engine.ingest_document(r) for r in args.references]
            show(found)
            return int(not all(r["ok"] for r in found))
        case "ingest-dir":
            show(engine.ingest_folder(args.folder))
        case "docs":
            show(engine.list_documents())
        case "stats":
            show(engine.graph_stats())
        case "search":
            show(engine.search_knowledge(args.question, args.mode, args.limit))
        case "ask":
            answer = engine.answer_question(args.question)
            show(answer)
            return int(not answer["grounded"])
        case "graph-build":
            if args.rebuild:
                engine.store.clear_graph()
            show(engine.build_graph(args.limit))
        case "explore":
            show(engine.explore_entity(args.name, args.depth))
        case "connect":
            found = engine.find_connection(args.a, args.b, args.max_hops)
            show(found)
            return int(not found["found"])
        case "graph-export":
            graph.export_json(engine.store.table("nodes"), engine.store.table("edges"), args.path)
        case "evaluate":
            print(evaluate.format_table(engine.evaluate(remote.golden_questions(engine.spark, args.questions))))
        case "mcp":
            mcp.serve(engine)
        case "serve":
            serve(engine, args.port).serve_forever()
    return 0


if __name__ == "__main__":
    sys.exit(main())
