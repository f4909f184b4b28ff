"""python -m docloom [--home DIR] ingest DIR | search QUERY | ask QUESTION | register FILE | sql STATEMENT | stats | delete SOURCE"""

from __future__ import annotations

import argparse

from .engine import Engine
from .session import local_session


def main(argv: list[str] | None = None, spark=None) -> None:
    p = argparse.ArgumentParser(prog="docloom")
    p.add_argument("--home", default="docloom-data")
    sub = p.add_subparsers(dest="command", required=True)
    for name, arg in (("ingest", "path"), ("search", "query"), ("ask", "question"), ("register", "path"), ("sql", "statement"), ("delete", "source")):
        sub.add_parser(name).add_argument(arg)
    sub.add_parser("stats")
    a = p.parse_args(argv)
    e = Engine(spark or local_session("*", partitions=8, memory="4g", app="docloom"), a.home)
    if a.command == "ingest":
        for r in e.ingest(a.path).toLocalIterator():
            print(f"refused {r.path}: {r.error}")
    elif a.command == "search":
        for r in e.search(a.query).collect():  # at most TOP_K rows
            print(f"{r.score:.4f} {r.source} #{r.seq}: {r.text[:280]!r}")
    elif a.command == "ask":
        got = e.ask(a.question)
        print(f"{got.text}\n[{got.verdict}, confidence {got.confidence}]", *(f"[{n}] {s}" for n, s in got.citations), sep="\n")
    elif a.command == "register":
        print(*e.register(a.path), sep="\n")
    elif a.command == "sql":
        e.sql(a.statement).show(200, truncate=80)
    elif a.command == "delete":
        e.delete(a.source)
    if a.command in ("ingest", "stats", "delete"):
        print("{} chunks of {} files".format(*e.stats()))


if __name__ == "__main__":
    main()
