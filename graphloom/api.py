"""The library: an index's queries as JSON-ready dictionaries with token estimates.

Each method collects at most what its limit allows; the DataFrame cores in
`graphloom.operators` have no such bound and also work on many names at once.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import match, render
from graphloom.functions import is_test_path
from graphloom.index import Index, IndexReport
from graphloom.operators import compose, lookups
from graphloom.operators import graph as walks
from graphloom.operators.lookups import Filters
from graphloom.sources.extract import rows
from graphloom.sources.gitdiff import git_diff, hunks_of
from graphloom.sources.languages import label, variant_of_name


def estimate(value: object) -> int:
    """A fourth of the JSON's bytes, one at least."""
    return max(1, len(json.dumps(value, separators=(",", ":"), ensure_ascii=False, default=str).encode()) // 4)


def meta(tokens: int, tool: str, tool_tokens: int, fidelity: float) -> dict:
    return {"tokens_returned_estimate": tokens, "alternative_queries": [{"tool": tool, "tokens_estimate": tool_tokens, "fidelity": fidelity}]}


def records(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def signature_line(r: dict) -> dict:
    return {"qualified_name": r["qualified_name"], "kind": r["kind"], "path": r["path"], "line": r["start_line"], "signature": r["signature"]}


class CodeGraph:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.index = spark, Index(spark, path)
        self.g = self.index.tables().cache()

    @classmethod
    def build(cls, spark: SparkSession, root: str, path: str, full: bool = False) -> tuple[CodeGraph, IndexReport]:
        report = Index(spark, path).build(root, full)
        return cls(spark, path), report

    def _top(self, symbol: str) -> dict | None:
        found = records(lookups.resolve_top1(self.g, symbol))
        return found[0] if found else None

    def find_definition(self, symbol: str) -> dict:
        found = records(lookups.definition(self.g, symbol)) or records(lookups.fuzzy(self.g, symbol, 5).drop("similarity"))
        return {"matches": found, "meta": meta(estimate(found), "get_outline", 320, 0.72)}

    def find_references(self, symbol: str) -> dict:
        found = records(lookups.references(self.g, symbol))
        return {"references": found, "meta": meta(estimate(found), "impact", 900, 0.84)}

    def outline(self, path: str) -> dict:
        found = records(lookups.outline(self.g, path))
        return {"path": path, "symbols": found, "meta": meta(estimate(found), "expand_symbol", 1200, 0.9)}

    def expand(self, symbol: str) -> dict:
        top = records(compose.bodies(self.g, lookups.resolve_top1(self.g, symbol)))
        if not top:
            return {"symbol": None, "body": None, "dependencies": [], "meta": meta(20, "validate", 40, 0.6)}
        body = top[0].pop("body")
        refs = records(lookups.references_from(self.g, top[0]["id"]))
        return {"symbol": top[0], "body": body, "dependencies": refs, "meta": meta(estimate([top, body, refs]), "get_outline", 320, 0.6)}

    def impact(self, symbol: str, depth: int = 4) -> dict:
        top = self._top(symbol)
        callers = []
        if top:
            for r in records(walks.impact(self.g, symbol, depth)):
                symbol_part = {k: r[k] for k in top}
                breakdown = {k: r[k] for k in ("pagerank", "fanout_in", "fanout_out", "exported", "test_coverage", "depth_decay")}
                callers.append({"symbol": symbol_part, "depth": r["depth"], "criticality": r["criticality"], "breakdown": breakdown})
        return {"symbol": top, "callers": callers, "meta": meta(estimate(callers) if callers else 40, "find_references", 700, 0.78)}

    def validate(self, symbol: str) -> dict:
        bloom = self.index.bloom()
        hit = bloom is None or symbol in bloom
        exists = hit and not self.g.symbols.filter(match.resolves(symbol)).isEmpty()
        candidates = [] if exists else records(lookups.suggestions(self.g, symbol))
        return {"query": symbol, "exists": exists, "bloom_hit": hit, "candidates": candidates, "meta": meta(max(40, estimate(candidates)), "find_definition", 120, 0.8)}

    def validate_snippet(self, code: str, language: str) -> dict:
        variant = variant_of_name(language)
        if variant is None:
            raise ValueError(f"unknown language: {language}")
        found = [r for r in rows("snippet", code, variant) if r["rec"] == "ref"]
        checks: list[dict] = []
        if found:
            refs = self.spark.createDataFrame([{k: r[k] for k in ("name", "start_line", "column")} for r in found], "name string, start_line int, column int")
            refs = refs.select(F.col("name").alias("symbol_name"), F.col("start_line").alias("line"), "column")
            checks = [{**r, "candidates": [{k: c[k] for k in ("qualified_name", "name", "path", "line", "confidence")} for c in r["candidates"] or []]} for r in records(compose.check_snippet(self.g, refs))]
        missing = sum(not c["exists"] for c in checks)
        return {"language": label(variant), "total_calls": len(checks), "unresolved_calls": missing, "checks": checks, "meta": meta(max(40, estimate(checks)), "validate", 48, 0.7)}

    def stats(self) -> dict:
        n = {r["table_name"]: r["n"] for r in records(lookups.stats_counts(self.g))}
        out = {"files": n["files"], "symbols": n["symbols"], "references": n["refs"], "edges": n["edges"]}
        out |= {"languages": records(lookups.stats_language(self.g)), "kinds": records(lookups.stats_kind(self.g)), "top_fanout": records(lookups.top_fanout(self.g))}
        return out | {"db_path": str(self.index.path), "snapshot_present": True, "meta": meta(n["symbols"] // 8 + 60, "get_outline", 320, 0.5)}

    def tests_for(self, symbol: str) -> dict:
        found = records(walks.tests_for(self.g, symbol))
        return {"symbol": symbol, "tests": found, "meta": meta(estimate(found), "impact", 500, 0.7)}

    def connect(self, start: str, goal: str, depth: int = 8) -> dict:
        path = [{"qualified_name": r["qualified_name"], "kind": r["kind"], "path": r["path"], "line": r["start_line"]} for r in records(walks.connect(self.g, start, goal, depth))]
        return {"from": start, "to": goal, "found": bool(path), "path": path, "meta": meta(estimate(path), "impact", 500, 0.7)}

    def export(self, format: str = "mermaid", start: str | None = None, depth: int = 3, limit: int = 800, group_by: str = "none", collapse_tests: bool = False, exported_only: bool = False, html_out: str | None = None) -> dict:
        limit = min(max(limit, 1), 5000)
        if start:
            edges = records(walks.export_from(self.g, start, depth, limit, collapse_tests, exported_only))
            truncated = len(edges) >= limit
        else:
            edges = records(walks.export_all(self.g, limit, collapse_tests, exported_only))
            truncated = len(edges) > limit
            edges = edges[:limit]
        draw = render.dot if format == "dot" else render.mermaid
        diagram = draw(edges, group_by)
        nodes, pairs = render.nodes_of(edges)
        scope = f"from:{start}" if start else "all"
        out = {"format": "dot" if format == "dot" else "mermaid", "scope": scope, "group_by": group_by, "nodes": len(nodes), "edges": len(pairs), "truncated": truncated, "diagram": diagram}
        if html_out:
            Path(html_out).write_text(render.html(diagram, out["format"], f"Call graph ({scope})"))
            out["html_path"] = html_out
        return out | {"meta": meta(estimate(diagram), "connect", 250, 0.6)}

    def context_pack(self, symbol: str, budget: int = 1500) -> dict:
        """Body 40 %, dependencies 20 %, callers 25 % of the budget, tests the rest."""
        budget = budget or 1500
        empty = {"symbol": None, "body": None, "dependency_signatures": [], "caller_signatures": [], "tests": [], "budget_tokens": budget}
        top = records(compose.bodies(self.g, lookups.resolve_top1(self.g, symbol)))
        if not top:
            return empty | {"meta": meta(40, "validate", 48, 0.6)}
        body = top[0].pop("body")
        most = 4 * (budget * 40 // 100)
        if body is not None and len(body.encode()) > most:
            body = body[:most] + "\n... truncated"
        deps = _within([signature_line(r) for r in records(compose.dependencies(self.g, top[0]["id"]))], budget * 20 // 100)
        callers = _within([signature_line(r) for r in records(compose.context_callers(self.g, top[0]["qualified_name"], top[0]["name"]))], budget * 25 // 100)
        used = sum(estimate(x) for x in (body, deps, callers) if x)
        tests = _within([signature_line(r) for r in records(walks.tests_for(self.g, symbol).limit(8))], max(0, budget - used))
        out = empty | {"symbol": top[0], "body": body, "dependency_signatures": deps, "caller_signatures": callers, "tests": tests}
        return out | {"meta": meta(estimate(out), "expand_symbol", 1200, 0.9)}

    def search(self, pattern: str, options: Filters | None = None) -> dict:
        found = records(lookups.search(self.g, pattern, options))
        hits = [{"symbol": {k: v for k, v in r.items() if k != "score"}, "score": r["score"]} for r in found]
        return {"query": pattern, "hits": hits, "meta": meta(estimate(hits), "find_definition", 120, 0.7)}

    def unused(self, options: Filters | None = None) -> dict:
        found = records(lookups.unused(self.g, options))
        symbols = [{"symbol": {k: v for k, v in r.items() if not k.startswith("inbound")}, "inbound_refs": r["inbound_refs"], "inbound_edges": r["inbound_edges"]} for r in found]
        return {"symbols": symbols, "meta": meta(estimate(symbols), "impact", 400, 0.7)}

    def plan_query(self, task: str, symbol: str | None = None) -> dict:
        out = compose.plan_query(task, symbol)
        return out | {"meta": meta(sum(s["expected_tokens"] for s in out["steps"]) + 40, "search", 500, 0.68)}

    def edit_prep(self, symbol: str, budget: int = 1800) -> dict:
        budget = budget or 1800
        out = {"symbol": symbol, "validate": self.validate(symbol), "signature": self.signature(symbol), "siblings": self.siblings(symbol), "context": self.context_pack(symbol, budget), "tests": self.tests_for(symbol)}
        out["next_steps"] = [f"graphloom impact {symbol} --depth 4", f"graphloom tests-for {symbol}", f"graphloom validate {symbol}"]
        tokens = sum(out[k]["meta"]["tokens_returned_estimate"] for k in ("validate", "signature", "siblings", "context", "tests"))
        return out | {"meta": meta(tokens, "context_pack", budget, 0.8)}

    def diff_impact(self, start: str, end: str = "HEAD", depth: int = 3, diff: str | None = None) -> dict:
        """`diff` takes the text of a diff in place of a call to git."""
        text = git_diff(self.index.meta()["root"], start, end) if diff is None else diff
        hunks = hunks_of(self.spark, text).cache()
        changed, impacted = compose.diff_impact_frames(self.g, hunks, depth)
        part = lambda r, *out: {k: v for k, v in r.items() if k not in out}
        changed_rows = [{"symbol": part(r, "added_lines", "removed_lines"), "added_lines": r["added_lines"], "removed_lines": r["removed_lines"]} for r in records(changed)]
        impacted_rows = [{"symbol": part(r, "via", "criticality"), "via": r["via"], "criticality": r["criticality"]} for r in records(impacted)] if changed_rows else []
        out = {"from_ref": start, "to_ref": end, "changed_files": hunks.select("path").distinct().count(), "changed_symbols": changed_rows, "impacted": impacted_rows}
        return out | {"meta": meta(estimate(out), "impact", 500, 0.8)}

    def imports(self, path: str) -> dict:
        found = records(lookups.imports_of(self.g, path))
        return {"path": path, "imports": found, "meta": meta(estimate(found), "get_outline", 320, 0.7)}

    def imported_by(self, source: str) -> dict:
        found = records(lookups.imported_by(self.g, source))
        return {"source": source, "imported_by": found, "meta": meta(estimate(found), "find_references", 700, 0.7)}

    def signature(self, symbol: str) -> dict:
        top = self._top(symbol)
        found = [signature_line(r) for r in records(lookups.signature_members(self.g, symbol))] if top else []
        return {"symbol": top, "members": found, "meta": meta(estimate([top, found]), "expand_symbol", 1200, 0.9)}

    def siblings(self, symbol: str) -> dict:
        found = [{k: r[k] for k in ("qualified_name", "shared_callers", "path", "line")} for r in records(lookups.siblings(self.g, symbol))]
        return {"symbol": symbol, "siblings": found, "meta": meta(estimate(found), "impact", 500, 0.6)}

    def transitive_callers(self, symbol: str, depth: int) -> list[tuple[int, int]]:
        return [(r["id"], r["depth"]) for r in records(walks.transitive_callers(self.g, symbol, depth))]

    def test_symbols(self) -> DataFrame:
        return self.g.symbol_records.filter(is_test_path("path"))


def _within(items: list[dict], budget: int) -> list[dict]:
    """The longest beginning of the list that fits."""
    while items and estimate(items) > budget:
        items = items[:-1]
    return items


