"""Command line: python -m weftgraph.cli COMMAND ... (run, update, watch, query, path, explain, stats, export, merge, diff, history, cluster-only, ingest)."""

from __future__ import annotations

import argparse
import json
import time

from .engine import Engine
from .session import get_session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weftgraph")
    p.add_argument("--graph", default=".weftgraph", help="folder of the graph's tables")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("run", "update"):
        sub.add_parser(name).add_argument("path")
    w = sub.add_parser("watch")
    w.add_argument("path")
    w.add_argument("--debounce", type=int, default=3000)
    q = sub.add_parser("query")
    q.add_argument("question")
    q.add_argument("--dfs", action="store_true")
    q.add_argument("--depth", type=int, default=2)
    q.add_argument("--budget", type=int, default=2000)
    x = sub.add_parser("path")
    x.add_argument("a")
    x.add_argument("b")
    sub.add_parser("explain").add_argument("node")
    sub.add_parser("stats")
    e = sub.add_parser("export")
    e.add_argument("--out", required=True)
    e.add_argument("--format", default="json", choices=["json", "file", "graphml", "html", "report"])
    m = sub.add_parser("merge")
    for a in ("a", "b", "out"):
        m.add_argument(a)
    d = sub.add_parser("diff")
    for a in ("a", "b"):
        d.add_argument(a)
    sub.add_parser("history").add_argument("--limit", type=int, default=20)
    sub.add_parser("cluster-only")
    i = sub.add_parser("ingest")
    i.add_argument("urls", nargs="+")
    i.add_argument("--out", required=True)
    return p


def get(url: str) -> bytes:
    """The body behind a URL, one byte more than is taken at most."""
    from urllib.request import urlopen

    from .sources.web import MAX_DOWNLOAD

    with urlopen(url, timeout=30) as r:
        return r.read(MAX_DOWNLOAD + 1)


def main(argv: list[str] | None = None) -> object:
    args = parser().parse_args(argv)
    spark = get_session()
    g = Engine(spark, args.graph)
    c = args.command
    if c in ("run", "update"):
        out = g.run(args.path)
    elif c == "watch":
        from .streaming.watch import watch

        q = watch(spark, args.path, lambda _: g.run(args.path), f"{args.graph}/watch", f"{args.debounce} milliseconds")
        try:
            while q.isActive:
                time.sleep(1)
        except KeyboardInterrupt:
            q.stop()
        out = None
    elif c == "query":
        out = g.query(args.question, "dfs" if args.dfs else "bfs", args.depth, args.budget)
    elif c == "path":
        out = g.path_text(args.a, args.b)
    elif c == "explain":
        out = g.explain(args.node)
    elif c == "stats":
        out = g.stats()
    elif c == "export":
        out = g.export(args.out, args.format)
    elif c == "merge":
        out = Engine(spark, args.a).merge(Engine(spark, args.b), Engine(spark, args.out))
    elif c == "diff":
        out = Engine(spark, args.a).diff_text(Engine(spark, args.b))
    elif c == "history":
        out = g.history_text(args.limit)
    elif c == "ingest":
        from .sources.web import ingest

        out = ingest(spark.createDataFrame([(u,) for u in args.urls], "url string"), get, args.out)
    else:
        out = g.cluster_only()
    if out is not None:
        print(out if isinstance(out, str) else json.dumps(out, indent=2, default=str))
    return out


if __name__ == "__main__":
    main()
