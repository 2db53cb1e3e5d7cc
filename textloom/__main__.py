"""Command line: ``python -m textloom scrape|index|ask|count``."""

from __future__ import annotations

import argparse
import json

from textloom.plans.engine import Engine
from textloom.session import build_session
from textloom.sources.pages import read_raw_pages


def main() -> None:
    parser = argparse.ArgumentParser(prog="textloom")
    parser.add_argument("--store", required=True, help="folder of the index")
    commands = parser.add_subparsers(dest="command", required=True)
    index = commands.add_parser("index", help="index a folder of page files")
    index.add_argument("folder")
    index.add_argument("--clear", action="store_true")
    index.add_argument("--max", type=int, default=None)
    index.add_argument("--replace-pages", action="store_true")
    scrape = commands.add_parser("scrape", help="take page files of a source into the page table")
    scrape.add_argument("folder")
    scrape.add_argument("--source", default="docs")
    scrape.add_argument("--prefix", default=None, help="addresses that begin so only")
    scrape.add_argument("--max", type=int, default=None)
    scrape.add_argument("--force", action="store_true", help="stored pages too")
    ask = commands.add_parser("ask", help="ask a question")
    ask.add_argument("message")
    ask.add_argument("--session", default=None)
    commands.add_parser("count", help="size of the index")
    args = parser.parse_args()
    engine = Engine(build_session(), args.store)
    if args.command == "index":
        row = engine.index(read_raw_pages(engine.spark, args.folder, args.max), args.clear, args.replace_pages).first()
        print(json.dumps(row.asDict()))
    elif args.command == "scrape":
        print(json.dumps(engine.crawl(read_raw_pages(engine.spark, args.folder), args.source, args.max, args.prefix, args.force)))
    elif args.command == "ask":
        print(json.dumps(engine.ask(args.message, args.session), ensure_ascii=False))
    else:
        print(json.dumps(engine.health()))


if __name__ == "__main__":
    main()
