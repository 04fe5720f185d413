"""Command line: index, query, inspect, config, serve."""

from __future__ import annotations

import argparse
import sys

from corvane.config import Config, interview
from corvane.engine import ContextEngine
from corvane.providers import HashProvider, HttpProvider, Provider
from corvane.session import session


def provider_of(c: Config) -> Provider:
    if c.provider == "hash":
        return HashProvider()
    return HttpProvider(c.api_base or "", c.api_key, c.chat_model or "", c.embedding_model or "", allowed=c.allowed_providers)


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="corvane")
    parser.add_argument("--config")
    sub = parser.add_subparsers(dest="command", required=True)
    p = sub.add_parser("index")
    p.add_argument("root")
    p.add_argument("--output", default="repo_index")
    p = sub.add_parser("query")
    p.add_argument("question")
    p.add_argument("--index", default="repo_index")
    p.add_argument("--top-k", type=int, default=20)
    p.add_argument("--output-k", type=int, default=5)
    p.add_argument("--no-cache", action="store_true")
    p = sub.add_parser("inspect")
    p.add_argument("index")
    p = sub.add_parser("config")
    p.add_argument("path")
    p.add_argument("--ask", action="store_true", help="ask for every setting")
    p = sub.add_parser("serve")
    p.add_argument("--indexes", default="indexes")
    a = parser.parse_args(args)
    if a.command == "config":
        (interview(input) if a.ask else Config()).save(a.path)
        return 0
    config = Config.load(a.config) if a.config else Config()
    if a.command == "serve":
        from corvane.server import index_of, serve

        spark = session("corvane-server")
        serve(lambda question, root, limit: ContextEngine(spark, index_of(root, a.indexes), config, provider_of(config)).sync_and_query(question, root, limit))
        return 0
    where = a.output if a.command == "index" else a.index
    engine = ContextEngine(session("corvane-cli"), where, config, provider_of(config))
    if a.command == "index":
        print(engine.index(a.root), file=sys.stderr)
    elif a.command == "query":
        print(engine.query(a.question, a.top_k, a.output_k, use_cache=not a.no_cache))
    else:
        engine.inspect().show()
    return 0


if __name__ == "__main__":
    sys.exit(main())
