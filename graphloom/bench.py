"""The engine's own benchmark on a source tree: indexing, five queries, and what their answers save in tokens."""

from __future__ import annotations

import time
from pathlib import Path
from statistics import median

from pyspark.sql import SparkSession

from graphloom.api import CodeGraph
from graphloom.operators.lookups import most_called
from graphloom.sources.config import load_config
from graphloom.sources.scan import list_files


def run(spark: SparkSession, root: str, path: str, symbol: str | None = None, runs: int = 3) -> dict:
    graph, first = CodeGraph.build(spark, root, path, full=True)
    _, again = CodeGraph.build(spark, root, path)
    if symbol is None:
        top = most_called(graph.g).first()
        symbol = top["name"] if top else ""
    queries = []
    for name, call in (("find_definition", graph.find_definition), ("find_references", graph.find_references), ("get_outline", lambda _: graph.outline("")), ("impact", graph.impact), ("validate", graph.validate)):
        took, out = [], {}
        for _ in range(runs):
            began = time.time()
            out = call(symbol)
            took.append((time.time() - began) * 1000)
        queries.append({"name": name, "median_ms": round(median(took)), "tokens": out["meta"]["tokens_returned_estimate"]})
    sizes, holding = [], 0
    for p in list_files(root, load_config(root))[0]:
        data = (Path(root) / p).read_bytes()
        sizes.append(len(data) // 4)
        holding += len(data) // 4 if symbol and symbol.encode() in data else 0
    tokens = {q["name"]: q["tokens"] for q in queries}
    savings = [
        {"question": "who calls", "raw_tokens": holding, "graph_tokens": tokens["impact"]},
        {"question": "where defined", "raw_tokens": sum(sizes) // max(1, len(sizes)), "graph_tokens": tokens["find_definition"]},
    ]
    for s in savings:
        s["ratio"] = round(s["raw_tokens"] / max(1, s["graph_tokens"]), 1)
    return {"probe": symbol, "full_index_ms": first.elapsed_ms, "incremental_ms": again.elapsed_ms, "files": first.files_indexed, "symbols": first.symbols_indexed, "references": first.references_indexed, "queries": queries, "savings": savings}


def chart(result: dict, width: int = 40) -> str:
    lines = [f"full index {result['full_index_ms']:,} ms, again {result['incremental_ms']:,} ms; probe {result['probe']}"]
    most = max([1, *(q["median_ms"] for q in result["queries"])])
    lines += [f"{q['name']:16} {'#' * max(1, q['median_ms'] * width // most)} {q['median_ms']:,} ms, {q['tokens']:,} tokens" for q in result["queries"]]
    lines += [f"{s['question']:16} {s['raw_tokens']:,} -> {s['graph_tokens']:,} tokens ({s['ratio']}x)" for s in result["savings"]]
    return "\n".join(lines) + "\n"
