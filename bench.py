"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

HERE = Path(__file__).resolve().parent
sys.path.insert(0, str(HERE))
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [str(HERE), os.environ.get("PYTHONPATH", "")]))

#: The graph view is built once (its own entry); queries then run on cached tables, as a server's do.
QUERIES = [
    "definition", "references", "outline", "unused", "stats_kind", "top_fanout", "siblings", "signature_members", "search_fuzzy", "validate_exists", "references_batch", "callee_resolution",
    "resolved_edges", "export_edges", "transitive_callers", "tests_for", "impact_ppr", "impact_batch", "connect_distance", "diff_overlap", "incremental_classify",
]


def main() -> None:
    from graphloom.plans import catalogue
    from graphloom.plans.driver_view import graph
    from graphloom.session import local_session

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, 8)
    spark.sparkContext.setLogLevel("OFF")
    took: dict[str, float] = {}

    def timed(name: str, run) -> None:
        began = time.time()
        run()
        took[name] = round(time.time() - began, 3)

    def view() -> None:
        g = graph(spark, sf_dir)
        for df in (g.files, g.symbols, g.refs):
            df.count()

    timed("graph_view", view)
    known = catalogue.queries()
    for name in QUERIES:
        timed(name, lambda name=name: known[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    with tempfile.TemporaryDirectory() as temp:
        from graphloom.index import Index
        from graphloom.sources.synthetic import generate

        generate(f"{temp}/tree", 950)
        index = Index(spark, f"{temp}/index")
        timed("index_full_951_files", lambda: index.build(f"{temp}/tree", full=True))
        timed("index_unchanged", lambda: index.build(f"{temp}/tree"))
    print(json.dumps({"metric": "code_graph_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
