"""The command line: `python -m graphloom COMMAND`.  Queries print text, or JSON with --json."""

from __future__ import annotations

import argparse
import cmd
import json
import sys
from collections.abc import Callable
from dataclasses import asdict
from pathlib import Path

from graphloom import bench, doctor, server, setup
from graphloom.api import CodeGraph
from graphloom.index import Index, IndexReport, MissingIndex
from graphloom.operators.lookups import Filters
from graphloom.session import local_session
from graphloom.sources.synthetic import generate
from graphloom.streaming import watch

WHY = {
    "impact": "Callers are found backwards from the name; criticality is personalised PageRank over them, 100 for the highest. Fan-in, fan-out, export, tests and depth are shown, and don't change it.",
    "validate": "A bloom filter of all full names answers no for certain; a yes is checked against the symbols. Candidates have a Jaro-Winkler similarity of 0.6 or more.",
    "search": "A pattern with * is a glob; no pattern lists symbols; any other text is matched within names and ranked by Jaro-Winkler similarity.",
    "unused": "Symbols outside tests whose names occur in no reference and no call edge. Calls by reflection or from other repositories are not seen.",
}


def _filters(a: argparse.Namespace) -> Filters:
    exported = None if a.exported is None else a.exported == "true"
    return Filters(a.kind or [], a.language or [], exported, a.path, a.limit)


def _snippet(g: CodeGraph, a: argparse.Namespace) -> dict:
    return g.validate_snippet(Path(a.file).read_text() if a.file else sys.stdin.read(), a.language)


def _export(g: CodeGraph, a: argparse.Namespace) -> dict:
    return g.export(a.format, a.start, a.depth, a.limit, a.group_by, a.collapse_tests, a.exported_only, a.html_out)


#: name: (positional arguments, options, call)
DEPTH = lambda n: ("--depth", {"type": int, "default": n})
FILTERS = [("--kind", {"action": "append"}), ("--language", {"action": "append"}), ("--exported", {"choices": ["true", "false"]}), ("--path", {}), ("--limit", {"type": int, "default": 50})]
QUERIES: dict[str, tuple[list[str], list[tuple[str, dict]], Callable]] = {
    "find-definition": (["symbol"], [], lambda g, a: g.find_definition(a.symbol)),
    "find-references": (["symbol"], [], lambda g, a: g.find_references(a.symbol)),
    "outline": (["path"], [], lambda g, a: g.outline(a.path)),
    "expand": (["symbol"], [], lambda g, a: g.expand(a.symbol)),
    "impact": (["symbol"], [DEPTH(4)], lambda g, a: g.impact(a.symbol, a.depth)),
    "validate": (["symbol"], [], lambda g, a: g.validate(a.symbol)),
    "validate-snippet": ([], [("--file", {}), ("--language", {"required": True})], _snippet),
    "stats": ([], [], lambda g, a: g.stats()),
    "tests-for": (["symbol"], [], lambda g, a: g.tests_for(a.symbol)),
    "connect": (["start", "goal"], [DEPTH(8)], lambda g, a: g.connect(a.start, a.goal, a.depth)),
    "export": ([], [("--format", {"default": "mermaid"}), ("--from", {"dest": "start"}), DEPTH(3), ("--limit", {"type": int, "default": 800}), ("--group-by", {"default": "none", "choices": ["none", "file", "directory", "language"]}), ("--collapse-tests", {"action": "store_true"}), ("--exported-only", {"action": "store_true"}), ("--html-out", {})], _export),
    "context-pack": (["symbol"], [("--budget", {"type": int, "default": 1500})], lambda g, a: g.context_pack(a.symbol, a.budget)),
    "search": (["pattern"], FILTERS, lambda g, a: g.search(a.pattern, _filters(a))),
    "unused": ([], FILTERS, lambda g, a: g.unused(_filters(a))),
    "plan-query": (["task"], [("--symbol", {})], lambda g, a: g.plan_query(a.task, a.symbol)),
    "edit-prep": (["symbol"], [("--budget", {"type": int, "default": 1800})], lambda g, a: g.edit_prep(a.symbol, a.budget)),
    "diff-impact": (["start"], [("--to", {"default": "HEAD"}), DEPTH(3)], lambda g, a: g.diff_impact(a.start, a.to, a.depth)),
    "imports": (["path"], [], lambda g, a: g.imports(a.path)),
    "imported-by": (["source"], [], lambda g, a: g.imported_by(a.source)),
    "signature": (["symbol"], [], lambda g, a: g.signature(a.symbol)),
    "siblings": (["symbol"], [], lambda g, a: g.siblings(a.symbol)),
}
OTHERS = ["index", "watch", "snapshot", "mcp", "serve", "shell", "bench", "doctor", "init", "completions"]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="graphloom", description="Code-graph analytics on Spark.")
    top.add_argument("--db", default=".graphloom/index", help="folder of the index")
    top.add_argument("--engine", default="spark")
    commands = top.add_subparsers(dest="command", required=True)
    for name, (positional, options, _) in QUERIES.items():
        p = commands.add_parser(name)
        for x in positional:
            p.add_argument(x)
        for flag, settings in options:
            p.add_argument(flag, **settings)
        p.add_argument("--json", action="store_true")
        if name in WHY:
            p.add_argument("--explain", "--why", action="store_true", dest="why")
    for name in OTHERS:
        p = commands.add_parser(name)
        if name in ("index", "watch", "bench"):
            p.add_argument("root", nargs="?", default=".")
        if name in ("doctor", "init"):
            p.add_argument("--root", default=".")
        if name in ("init",):
            p.add_argument("--force", action="store_true")
        if name == "index":
            p.add_argument("--full", action="store_true")
        if name == "watch":
            p.add_argument("--once", action="store_true")
            p.add_argument("--debounce-ms", type=int, default=250)
        if name == "bench":
            p.add_argument("--symbol")
            p.add_argument("--scale", type=int, help="generate a tree of so many modules at root first")
        if name == "serve":
            p.add_argument("--host", default="127.0.0.1")
            p.add_argument("--port", type=int, default=8765)
        if name == "completions":
            p.add_argument("shell", choices=["bash", "zsh", "fish", "powershell"])
        p.add_argument("--json", action="store_true")
    return top


def text(name: str, out: dict) -> str:
    """Lines for people: what was found, a hint if nothing was, and the estimate."""
    lines = []
    for key, value in out.items():
        if key == "meta":
            continue
        if isinstance(value, list):
            lines.append(f"{key} ({len(value)})")
            lines += ["  " + _line(v) for v in value]
        elif isinstance(value, dict):
            lines.append(f"{key}: {_line(value)}")
        else:
            lines.append(f"{key}: {value}")
    if not any(out[k] for k in out if isinstance(out[k], list)) and name not in ("stats", "plan-query"):
        lines.append("hint: nothing was found; try `graphloom validate <name>` or `graphloom search '*name*'`")
    if "meta" in out:
        lines.append(f"_meta: about {out['meta']['tokens_returned_estimate']} tokens")
    return "\n".join(lines)


def _line(v: object) -> str:
    if not isinstance(v, dict):
        return str(v)
    s = v.get("symbol") if isinstance(v.get("symbol"), dict) else v
    head = " ".join(str(s[k]) for k in ("qualified_name", "symbol_name", "source", "tool") if s.get(k))
    place = f" {s['path']}:{s.get('start_line') or s.get('line')}" if s.get("path") else ""
    rest = " ".join(f"{k}={v[k]:.2f}" if isinstance(v[k], float) else f"{k}={v[k]}" for k in ("depth", "criticality", "score", "confidence", "shared_callers", "exists", "n", "callers", "command") if k in v)
    return f"{head}{place} {rest}".strip() or json.dumps(v, default=str)


class Shell(cmd.Cmd):
    prompt = "graphloom> "
    WORDS = {"def": "find_definition", "refs": "find_references", "outline": "outline", "expand": "expand", "impact": "impact", "validate": "validate", "tests": "tests_for"}

    def __init__(self, graph: CodeGraph, **streams):
        super().__init__(**streams)
        self.graph = graph

    def default(self, line: str) -> bool | None:
        word, _, rest = line.strip().partition(" ")
        if word in ("quit", "exit", "EOF"):
            return True
        if word == "stats":
            out = self.graph.stats()
        elif word in self.WORDS and rest.strip():
            out = getattr(self.graph, self.WORDS[word])(rest.strip())
        else:
            print("def, refs, outline, expand, impact, validate, tests NAME; stats; quit", file=self.stdout)
            return None
        print(text(word, out), file=self.stdout)
        return None

    def emptyline(self) -> None:
        pass


def _report(r: IndexReport) -> None:
    print(f"{r.mode}: {r.files_indexed} indexed, {r.files_reused} reused, {r.files_removed} removed; {r.symbols_indexed} symbols, {r.references_indexed} references; {r.elapsed_ms} ms")
    for w in r.warnings[:5]:
        print(f"warning: {w['path']}: {w['message']}", file=sys.stderr)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.engine != "spark":
        print(f"unknown engine: {a.engine}; there is only spark", file=sys.stderr)
        return 2
    if a.command == "completions":
        print(setup.completions(a.shell, [*QUERIES, *OTHERS]), end="")
        return 0
    if a.command == "init":
        print(json.dumps(setup.init(a.root, a.force), indent=2))
        return 0
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    try:
        if a.command in QUERIES:
            out = QUERIES[a.command][2](CodeGraph(spark, a.db), a)
            print(json.dumps(out, indent=2, default=str) if a.json else text(a.command, out))
            if getattr(a, "why", False):
                print(f"Why: {WHY[a.command]}")
        elif a.command == "index":
            report = Index(spark, a.db).build(a.root, a.full)
            print(json.dumps(asdict(report), indent=2)) if a.json else _report(report)
        elif a.command == "watch":
            watch.poll(spark, a.root, a.db, a.once, debounce=a.debounce_ms / 1000, on_report=_report)
        elif a.command == "snapshot":
            print(f"{Index(spark, a.db).snapshot().count()} resolved edges")
        elif a.command == "mcp":
            server.serve_stdio(CodeGraph(spark, a.db))
        elif a.command == "serve":
            server.http_server(CodeGraph(spark, a.db), a.host, a.port).serve_forever()
        elif a.command == "shell":
            Shell(CodeGraph(spark, a.db)).cmdloop()
        elif a.command == "bench":
            if a.scale:
                generate(a.root, a.scale)
            found = bench.run(spark, a.root, a.db, a.symbol)
            print(json.dumps(found, indent=2) if a.json else bench.chart(found), end="")
        elif a.command == "doctor":
            found = doctor.run(spark, a.root, a.db)
            print(json.dumps(found, indent=2))
            return 0 if found["ok"] else 1
    except MissingIndex as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0
