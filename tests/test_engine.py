import io
import json
import subprocess
import threading
import time
import urllib.request

import pytest
from pyspark.sql import functions as F

from graphloom import cli, doctor, match, server, setup
from graphloom.api import CodeGraph
from graphloom.functions import jaro_winkler
from graphloom.functions.bloom import Bloom, build_bloom
from graphloom.index import Index, MissingIndex
from graphloom.operators import compose
from graphloom.operators import graph as walks
from graphloom.operators import lookups
from graphloom.operators.lookups import Filters
from graphloom.sources.config import parse_lossy
from graphloom.sources.extract import rows, signature
from graphloom.sources.gitdiff import hunks_of
from graphloom.streaming import watch
from tests.sources import CHAIN, IMPACT, write


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("chain")
    write(root / "repo", CHAIN)
    g, report = CodeGraph.build(spark, str(root / "repo"), str(root / "index"))
    assert report.mode == "full" and report.files_indexed == len(CHAIN) and not report.warnings
    return g


def names(items, key="qualified_name"):
    return [x[key] for x in items]


def test_golden_tables(spark, tmp_path):
    write(tmp_path / "r", {"util.ts": "export function helper() {\n  return 1;\n}\n", "app.ts": 'import { helper } from "./util";\nexport function entry() {\n  return helper();\n}\n'})
    g, _ = CodeGraph.build(spark, str(tmp_path / "r"), str(tmp_path / "i"))
    assert sorted((r.name, r.kind, r.exported) for r in g.g.symbols.collect()) == [("entry", "function", True), ("helper", "function", True)]
    assert [r.symbol_name for r in g.g.refs.collect()] == ["helper"]
    assert [r.source for r in g.g.imports.collect()] == ["./util"]
    edges = g.g.edges.join(g.g.symbols, g.g.edges["from_symbol_id"] == g.g.symbols["id"]).select("name", "to_symbol_name").collect()
    assert [tuple(r) for r in edges] == [("entry", "helper")]
    assert [r.to_symbol_id for r in g.index.snapshot().collect()] == [g.g.symbols.filter("name = 'helper'").first().id]


def test_config_and_bad_encoding(spark, tmp_path):
    body = "export function {}() {{\n  return 1;\n}}\n"
    write(tmp_path / "r", {"src/app.ts": body.format("kept"), "src/generated/app.ts": body.format("made"), "vendor2/app.ts": body.format("other"), "src/bad.ts": b"\xff\xfe\xfd", ".graphloom.toml": '[include]\npaths = ["src/"]\n[exclude]\npaths = ["./src/generated/"]\n[ignore]\nextra = ["vendor2"] # no\n'})
    g, report = CodeGraph.build(spark, str(tmp_path / "r"), str(tmp_path / "i"))
    assert [r.name for r in g.g.symbols.collect()] == ["kept"]
    assert any("bad.ts" in w["path"] for w in report.warnings)
    assert parse_lossy("nonsense [[[\n[ignore]\nextra = [\n 'a',\n 'b' ]").ignore == ["a", "b"]


@pytest.mark.parametrize("target,caller", IMPACT.items())
def test_extraction_chains(target, caller):
    """Each language's chain, read from the extractor's rows alone."""
    found = {}
    for path, text in CHAIN.items():
        from graphloom.sources.languages import variant_of_path

        for r in rows(path, text, variant_of_path(path)):
            if r["rec"] == "ref" and r["from_qualified_name"]:
                found.setdefault(r["name"], set()).add(r["from_qualified_name"].split(".")[-1])
    assert caller in found[target]


def test_extraction_details():
    java = {r["qualified_name"]: r for r in rows("a.java", CHAIN["java/UserService.java"], "java") if r["rec"] == "symbol"}
    assert java["UserService"]["exported"] and not java["UserService.loadOne"]["exported"] and java["UserService.findOne"]["kind"] == "method"
    assert [r["name"] for r in rows("a.rs", CHAIN["rs/store.rs"], "rust") if r["rec"] == "symbol" and r["exported"]] == ["find_by_id", "render_user"]
    assert [(r["name"], r["kind"]) for r in rows("x.tsx", CHAIN["web/UserList.tsx"], "tsx") if r["rec"] == "ref"] == [("UserAvatar", "jsx"), ("map", "call"), ("UserCard", "jsx")]
    assert [r["name"] for p in CHAIN for r in rows(p, CHAIN[p], __import__("graphloom.sources.languages", fromlist=["x"]).variant_of_path(p)) if r["rec"] == "import"] == ["react", "os", "app.db", "fmt", "std::fmt", "java.util.List", "stdio.h", "string", "System", "set", "App\\Models\\User", "./users"]
    broken = rows("a.py", "def f(:\n    g(1)\nclass K:\n    def m(self):\n        return h()\n", "python")
    assert ("K.m", "function") in [(r["qualified_name"], r["kind"]) for r in broken] and "h" in [r["name"] for r in broken if r["rec"] == "ref"]
    go = {r["qualified_name"]: r for r in rows("a.go", "package a\ntype S struct { n int }\nfunc (s *S) Get() int { return s.n }\ntype I interface { Get() int }\ntype N int\n", "go") if r["rec"] == "symbol"}
    assert {k: v["kind"] for k, v in go.items()} == {"S": "struct", "S.Get": "method", "I": "interface", "N": "type"}
    assert signature("x" * 300) == "x" * 180 + "..." and signature("é" * 100 + "\n") == "é" * 90 + "..."
    assert rows("e.ts", "", "typescript") == [] and rows("e.c", "/* open", "c") == []


def test_impact_all_languages(graph):
    for target, caller in list(IMPACT.items())[:3]:
        found = graph.impact(target)
        assert caller in [c["symbol"]["name"] for c in found["callers"]]
        assert all(0 <= c["criticality"] <= 100 for c in found["callers"]) and max(c["criticality"] for c in found["callers"]) == 100
    many = walks.impact_targets(graph.g, graph.g.symbols.sparkSession.createDataFrame(list(enumerate(IMPACT)), "seed long, query string"))
    ranked = walks.impact_many(graph.g, walks.cut(many), 4).collect()
    for i, (_, caller) in enumerate(IMPACT.items()):
        assert caller in [r.name for r in ranked if r.seed == i]
    assert graph.impact("nothing_here")["callers"] == []


def test_lookups(graph):
    assert names(graph.find_definition("findById")["matches"])[0] == "findById"
    assert names(graph.find_definition("FINDONE")["matches"]) == ["UserService.findOne"]
    assert "findById" in names(graph.find_definition("findByIdd")["matches"])
    refs = graph.find_references("findById")["references"]
    assert {r["from_symbol"] for r in refs} == {"handler", "testFind"}
    assert names(graph.outline("java")["symbols"])[0] == "UserService"
    out = graph.expand("normalize_user")
    assert out["body"].startswith("def normalize_user") and [d["symbol_name"] for d in out["dependencies"]] == ["strip"]
    assert graph.expand("zzz")["symbol"] is None
    assert [i["source"] for i in graph.imports("py/service.py")["imports"]] == ["os", "app.db"]
    assert [i["from_path"] for i in graph.imported_by("./users")["imported_by"]] == ["web/users.test.ts"]
    members = graph.signature("UserService")["members"]
    assert names(members) == ["UserService.findOne", "UserService.loadOne", "UserService.renderOne"]
    assert [t["qualified_name"] for t in graph.tests_for("findById")["tests"]] == ["testFind"]
    stats = graph.stats()
    assert {"java", "typescript", "csharp", "ruby", "php"} <= {x["language"] for x in stats["languages"]} and stats["files"] == len(CHAIN)


def test_validate(graph):
    assert graph.validate("findById")["exists"]
    miss = graph.validate("findByIdd")
    assert not miss["exists"] and miss["candidates"][0]["qualified_name"] == "findById" and miss["candidates"][0]["confidence"] > 0.97
    assert not graph.validate("findone")["exists"]  # the bloom filter knows whole names only
    snippet = graph.validate_snippet("function a() { findById(1); findByIdd(2); }", "typescript")
    assert snippet["total_calls"] == 2 and snippet["unresolved_calls"] == 1
    bad = next(c for c in snippet["checks"] if not c["exists"])
    assert bad["symbol_name"] == "findByIdd" and bad["candidates"][0]["name"] == "findById"
    with pytest.raises(ValueError):
        graph.validate_snippet("x", "cobol")


def test_search(graph):
    assert {"UserCard", "UserList"} <= {h["symbol"]["name"] for h in graph.search("*User*")["hits"]}
    assert {h["symbol"]["kind"] for h in graph.search("find", Filters(kinds=["method"]))["hits"]} == {"method"}
    assert {h["symbol"]["language"] for h in graph.search("find", Filters(languages=["java"]))["hits"]} == {"java"}
    assert len(graph.search("", Filters(limit=3))["hits"]) == 3
    assert graph.search("*findById*")["hits"][0]["score"] == 1.0


def test_connect_and_export(graph, tmp_path):
    path = graph.connect("handler", "loadUser")
    assert path["found"] and names(path["path"]) == ["handler", "findById", "loadUser"]
    assert not graph.connect("loadUser", "handler")["found"] and names(graph.connect("handler", "handler")["path"]) == ["handler"]
    out = graph.export("mermaid")
    assert out["diagram"].startswith("graph TD") and "-->" in out["diagram"] and not out["truncated"]
    dot = graph.export("dot", start="findById", html_out=str(tmp_path / "g.html"))
    assert "loadUser" in dot["diagram"] and "->" in dot["diagram"] and "&gt;" in (tmp_path / "g.html").read_text()
    assert "subgraph" in graph.export("mermaid", group_by="language")["diagram"]
    assert "testFind" not in graph.export("dot", collapse_tests=True)["diagram"]


def test_compositions(graph):
    pack = graph.context_pack("findById")
    assert pack["body"].startswith("export function findById") or pack["body"].startswith("function findById")
    assert "handler" in names(pack["caller_signatures"]) and "loadUser" in names(pack["dependency_signatures"])
    tiny = graph.context_pack("findById", 10)
    assert tiny["body"].endswith("truncated") and tiny["caller_signatures"] == []
    edit = graph.edit_prep("findById")
    assert edit["validate"]["exists"] and edit["signature"]["symbol"]["name"] == "findById" and any("impact" in s for s in edit["next_steps"])
    plan = graph.plan_query("edit findById safely", "findById")
    assert plan["inferred_intent"] == "prepare_edit" and plan["steps"][1]["tool"] == "edit-prep" and plan["steps"][1]["command"].endswith("findById")
    diff = "diff --git a/web/users.ts b/web/users.ts\n--- a/web/users.ts\n+++ b/web/users.ts\n@@ -5 +5,2 @@\n-x\n+y\n+z\n"
    found = graph.diff_impact("a", diff=diff)
    assert names([c["symbol"] for c in found["changed_symbols"]]) == ["loadUser"] and found["changed_symbols"][0]["added_lines"] == 2
    assert {"findById", "handler"} <= {c["symbol"]["name"] for c in found["impacted"]} and found["changed_files"] == 1
    hunks = hunks_of(graph.spark, "+++ /dev/null\n@@ -1 +0,0 @@\n+++ b/a b.ts\n@@ -3,0 +4,5 @@ f\n").collect()
    assert [tuple(h) for h in hunks] == [("a b.ts", 3, 0, 4, 5)]


def test_unused_and_siblings(spark, tmp_path):
    write(tmp_path / "r", {
        "src/app.ts": "export function entry() {\n  used();\n}\nfunction used() {\n}\nfunction orphan() {\n}\nexport function publicUnused() {\n}\nfunction callerOne() {\n  a(); b();\n}\nfunction callerTwo() {\n  a(); b(); c();\n}\n",
        "tests/app.test.ts": "export function testOnlyHelper() {\n}\n",
    })
    g, _ = CodeGraph.build(spark, str(tmp_path / "r"), str(tmp_path / "i"))
    found = names([u["symbol"] for u in g.unused()["symbols"]])
    assert {"orphan", "publicUnused"} <= set(found) and "testOnlyHelper" not in found and "used" not in found
    one = g.unused(Filters(kinds=["function"], languages=["typescript"], exported=False, path_prefix="src/", limit=3))["symbols"]
    assert [(u["symbol"]["name"], u["inbound_refs"]) for u in one] == [("callerOne", 0), ("callerTwo", 0), ("orphan", 0)]
    assert [(s["qualified_name"], s["shared_callers"]) for s in g.siblings("a")["siblings"]] == [("b", 2), ("c", 1)]


def test_incremental_equals_full(spark, tmp_path):
    root, index = tmp_path / "r", Index(spark, str(tmp_path / "i"))
    write(root, CHAIN)
    index.build(str(root))
    same = index.build(str(root))
    assert (same.files_indexed, same.files_reused, same.files_removed) == (0, len(CHAIN), 0)
    (root / "py/service.py").write_text("def handle_request(n):\n    return other(n)\n")
    (root / "go/users.go").unlink()
    write(root, {"new/a.py": "def fresh():\n    handle_request(1)\n"})
    step = index.build(str(root))
    assert (step.files_indexed, step.files_reused, step.files_removed) == (2, len(CHAIN) - 2, 1)
    full = Index(spark, str(tmp_path / "full"))
    full.build(str(root), full=True)
    a, b = index.tables(), full.tables()
    for name in ("symbols", "refs", "edges", "imports", "sources"):
        x, y = getattr(a, name), getattr(b, name)
        assert x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty(), name
    with pytest.raises(MissingIndex):
        Index(spark, str(tmp_path / "none")).tables()


def test_bloom(spark):
    words = [f"name{i}" for i in range(500)]
    bloom = Bloom.empty(len(words))
    for w in words:
        bloom.add(w)
    back = Bloom.from_bytes(bloom.to_bytes())
    assert all(w in back for w in words) and sum(f"other{i}" in back for i in range(2000)) < 60
    assert Bloom.from_bytes(b"short") is None
    built = build_bloom(spark.createDataFrame([(w, "q." + w) for w in words], "name string, qualified_name string"))
    assert all(w in built and "q." + w in built for w in words) and sum(f"other{i}" in built for i in range(2000)) < 60


def test_matching(spark):
    assert jaro_winkler("findByIdd", "findById") == pytest.approx(0.97778, abs=1e-4) and jaro_winkler("findByIdd", "find_by_id") == pytest.approx(0.85333, abs=1e-4)
    assert jaro_winkler("", "a") == 0 and jaro_winkler("a", "a") == 1
    cols = "id long, name string, qualified_name string, kind string, file_id long, path string, language string, start_line int, end_line int, signature string, exported boolean"
    rec = spark.createDataFrame([(i, q.rsplit(".", 1)[-1], q, "function", 1, "a", "go", i, i, "", True) for i, q in enumerate(["A.b_c", "A.bxc", "B.A.b_c", "b_c", "Z.B_C", "A.b.c\\d", "x%y", "q.xzzy"])], cols)
    asked = spark.createDataFrame([(s,) for s in ["b_c", "A.b_c", "x%y", "c\\d", "none", "_c"]], "symbol string")
    got = {(r.symbol, r.qualified_name, r["rank"]) for r in match.resolve_all(rec, asked).collect()}
    for s in ["b_c", "A.b_c", "x%y", "c\\d", "none", "_c"]:
        one = {(s, r.qualified_name, r.k) for r in rec.filter(match.resolves(s)).withColumn("k", match.resolve_rank(s)).collect()}
        assert {x for x in got if x[0] == s} == one, s
    assert ("b_c", "A.bxc", 2) in got
    # names that begin and end with wildcards join on what is between; nothing is compared with every symbol
    python = rec.filter("id < 0").unionByName(spark.createDataFrame([(i, "__init__", f"C{i}.{q}", "function", 1, "a", "python", i, i, "", True) for i, q in enumerate(["__init__", "xxinityy", "othernam", "__iter__", "__exit__"])], cols))
    asked = spark.createDataFrame([(s,) for s in ["__init__", "__", "____exit", "_xit__"]], "symbol string")
    df = match.resolve_all(python, asked)
    got = {(r.symbol, r.qualified_name, r["rank"]) for r in df.collect()}
    for s in ["__init__", "__", "____exit", "_xit__"]:
        assert {x for x in got if x[0] == s} == {(s, r.qualified_name, r.k) for r in python.filter(match.resolves(s)).withColumn("k", match.resolve_rank(s)).collect()}, s
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_rank_takes_seeds_together(graph, monkeypatch):
    """A block of seeds gives what each gives alone, and seeds of few nodes share a call."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(3)
    nodes, edges = [], []
    for seed in range(40):
        ids = rng.permutation(60)[: 1 + seed % 9]  # ids are shared between seeds
        nodes += [(seed * 7, int(i), int(rng.integers(1, 3)) if seed % 5 else 2, n == 0 and seed % 3 > 0) for n, i in enumerate(ids)]
        edges += [(seed * 7, int(a), int(b)) for a in ids for b in ids if a != b and rng.random() < 0.4]
    nodes, edges = pd.DataFrame(nodes, columns=["seed", "id", "depth", "target"]), pd.DataFrame(edges, columns=["seed", "callee", "caller"])
    alone = pd.concat([walks._rank(n, edges[edges["seed"] == s]) for s, n in nodes.groupby("seed")])
    together = walks._rank(nodes, edges)
    both = alone.merge(together, on=["seed", "id"])
    assert len(both) == len(nodes) == len(together) and np.allclose(both["pagerank_x"], both["pagerank_y"], atol=1e-12)
    assert np.allclose(together.groupby("seed")["pagerank"].sum(), 1)

    targets = graph.spark.createDataFrame([(i, n) for i, n in enumerate(IMPACT)], "seed long, query string")
    targets, tables = walks.cut(walks.impact_targets(graph.g, targets)), {}
    monkeypatch.setattr(walks, "cut", lambda df, name="level", cut=walks.cut: tables.setdefault(name, cut(df, name)) if name == "nodes" else cut(df, name))
    walks.impact_many(graph.g, targets, 2)
    assert tables["nodes"].select("per", "block").distinct().count() < tables["nodes"].select("seed").distinct().count()


def test_first_of_alike(spark):
    """Five symbols of one name, one of which is among its own callers: two walks say what five say."""
    from graphloom.model import GraphTables
    from graphloom.schema import TABLES

    tables = {name: spark.createDataFrame([], schema) for name, schema in TABLES.items()}
    names = ["f", "f", "f", "f", "f", "g", "h", "k"]
    g = GraphTables(**tables)
    g.__dict__["symbol_records"] = spark.createDataFrame([(i, n, "Q." + n, "function", i % 2, f"p{i % 2}", "go", i, i, "", True) for i, n in enumerate(names)], g.symbol_records.schema)
    calls = [(5, "f"), (6, "f"), (3, "f"), (7, "g"), (7, "h"), (6, "g")]
    g.edges = spark.createDataFrame([(n, a, b, "call", 1.0) for n, (a, b) in enumerate(calls)], "id long, from_symbol_id long, to_symbol_name string, kind string, weight double")
    targets = walks.cut(g.symbol_records.filter("name = 'f'").select(F.col("id").alias("seed"), F.col("qualified_name").alias("query"), *g.symbol_records.columns))
    fewer, frontier = walks.first_of_alike(g, targets, 3)
    assert sorted(r.seed for r in fewer.collect()) == [0, 3]

    def ranks(found):
        return {(r.seed, r.id): (r.depth, r.place, round(r.criticality, 6)) for r in found.collect()}

    every, some = ranks(walks.impact_many(g, targets, 3)), ranks(walks.impact_many(g, fewer, 3, frontier=frontier))
    assert some == {k: v for k, v in every.items() if k[0] in (0, 3)}
    assert all({i: v for (s, i), v in every.items() if s == other} == {i: v for (s, i), v in some.items() if s == 0} for other in (1, 2, 4))


def test_equal_hunks_meet_symbols_once(spark, graph):
    """Sums are as from each of them."""
    path, start = graph.g.symbol_records.filter("name = 'findById'").select("path", "start_line").first()
    hunks = spark.range(1_000).select(F.lit(path).alias("path"), F.lit(start).alias("new_start"), (F.col("id") % 2).cast("int").alias("new_count"))
    found = lookups.hunk_symbols(graph.g, hunks)
    assert {r.name: r.added_lines for r in found.collect()}["findById"] == 500 and found.schema["added_lines"].dataType.typeName() == "long"
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 2  # of hunks, then of symbols


def test_seeds_of_a_diff_need_no_single_task(spark, graph, monkeypatch):
    plans = {}
    monkeypatch.setattr(compose.walks, "cut", lambda df, name="level", cut=walks.cut: plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()) and cut(df, name))
    path = graph.g.symbol_records.filter("name = 'findById'").first().path
    compose.diff_impact_frames(graph.g, spark.createDataFrame([(path, 1, 20)], "path string, new_start int, new_count int"), 2)
    assert "Window" not in plans["targets"]


def test_names_that_begin_alike(spark):
    """Names of one beginning and length meet by what else they hold, not all with all."""
    n = 6000
    rows = [(i, f"get_{c}{i:05d}", f"K.get_{c}{i:05d}", "function", i, "a.py", "python", 1, 2, "", True) for i in range(n) for c in ("_x"[i % 2],)]
    rec = spark.createDataFrame(rows, spark.createDataFrame([], "id long, name string, qualified_name string, kind string, file_id long, path string, language string, start_line int, end_line int, signature string, exported boolean").schema)
    began = time.monotonic()
    got = sorted((r.symbol, r.id) for r in match.resolve_all(rec, rec.select(F.concat(F.lit("GET_"), F.substring("name", 5, 10)).alias("symbol"))).collect())
    # the wildcard of `GET__00002` takes the x of no odd name, since digits differ
    assert got == sorted(("GET_" + r[1][4:], r[0]) for r in rows) and time.monotonic() - began < 15


def test_odd_wildcards(spark):
    """Shapes of names with wildcards against LIKE."""
    tails = ["", "_", "__", "a", "ab", "a_b", "axb", "a\\b", "ab_", "_ab", "xab", "é_é", "éxé", "a__b", "axyb", "a_xb", "😀_", "😀b"]
    asked = [*tails[1:], "A_B", "É_É", "___", "____", "_\\_", "a_b_", "a.b_"]
    t, a = spark.createDataFrame([(x,) for x in tails], "tail string"), spark.createDataFrame([(x,) for x in asked], "symbol string")
    got = sorted(tuple(r) for r in match._suffix_texts(t, a).collect())
    assert got == sorted(tuple(r) for r in t.crossJoin(a).filter(F.expr("tail like replace(lower(symbol), '\\\\', '\\\\\\\\')")).collect()) and len(got) > 40


def test_scan_opens_wanted_files_only(spark, tmp_path):
    """Names that look like patterns, escapes and partitions are files like any other; ignored folders are not read."""
    from graphloom.sources.config import load_config
    from graphloom.sources.scan import scan_tree

    names = ["x y.ts", "[id].ts", "a%20b.ts", "k=v/q.ts", "{a,b}.ts", "é.ts"]
    for n in [*names, "node_modules/z.ts"]:
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_text("export function f() { g(); }\n")
    files, warnings = scan_tree(spark, str(tmp_path), load_config(str(tmp_path)))
    assert sorted(r.path for r in files.collect()) == sorted(names) and not warnings
    assert "node_modules" not in " ".join(files.inputFiles())


def test_pagerank_and_bfs(spark):
    import numpy as np

    rank = walks.personal_pagerank(3, np.array([[0, 1], [1, 2], [0, 2], [0, 2]]), np.array([1.0, 0, 0]))
    assert rank.sum() == pytest.approx(1) and rank[0] > rank[2] > rank[1]


def test_surfaces(graph, capsys, tmp_path):
    ask = lambda method, **params: server.handle(graph, json.dumps({"jsonrpc": "2.0", "id": 7, "method": method, "params": params}))
    assert len(ask("tools/list")["result"]["tools"]) == 21 and ask("initialize")["result"]["serverInfo"]["name"] == "graphloom"
    hit = ask("tools/call", name="find_definition", arguments={"symbol": "findById"})
    assert hit["id"] == 7 and hit["result"]["structuredContent"]["matches"][0]["path"] == "web/users.ts"
    assert ask("tools/call", name="nope")["error"]["code"] == -32000 and server.handle(graph, "{")["error"]["code"] == -32700
    out = io.StringIO()
    server.serve_stdio(graph, ['{"id": 1, "method": "tools/call", "params": {"name": "plan_query", "arguments": {"task": "where is x"}}}\n', "\n"], out)
    assert "locate_symbol" in out.getvalue()
    http = server.http_server(graph, port=0)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{http.server_port}"
    assert json.load(urllib.request.urlopen(base + "/health"))["schema_version"] == "3"
    assert b"event: ready" in urllib.request.urlopen(base + "/sse").read()
    with pytest.raises(urllib.error.HTTPError):
        urllib.request.urlopen(base + "/other")
    http.shutdown()
    shell = cli.Shell(graph, stdout=io.StringIO())
    shell.onecmd("def findById")
    assert "web/users.ts" in shell.stdout.getvalue() and shell.onecmd("quit")
    assert doctor.run(graph.spark, graph.index.meta()["root"], str(graph.index.path))["ok"]
    assert not doctor.run(graph.spark, str(tmp_path), str(tmp_path / "none"))["ok"]
    made = setup.init(str(tmp_path))
    assert made["created"] and not setup.init(str(tmp_path))["created"]
    for s in ("bash", "zsh", "fish", "powershell"):
        assert "impact" in setup.completions(s, [*cli.QUERIES, *cli.OTHERS])
    assert len(cli.QUERIES) + len(cli.OTHERS) == 31
    assert cli.main(["--engine", "other", "stats"]) == 2


def test_watch(spark, tmp_path):
    root, index = tmp_path / "r", str(tmp_path / "i")
    write(root, {"a.ts": "export function start() {\n  helper();\n}\n", "b.md": "x"})
    before = watch.fingerprint(str(root))
    (root / "b.md").write_text("y")
    assert watch.fingerprint(str(root)) == before
    reports = []
    watch.poll(spark, str(root), index, once=True, on_report=reports.append)
    assert reports[0].files_indexed == 1
    (root / "a.ts").write_text("export function begin() {\n}\n")
    assert watch.fingerprint(str(root)) != before
    watch.stream(spark, str(root), index, str(tmp_path / "c"), once=True, on_report=reports.append).awaitTermination()
    assert reports[-1].files_indexed == 1 and [r.name for r in Index(spark, index).tables().symbols.collect()] == ["begin"]


def test_git_diff(spark, tmp_path):
    root = tmp_path / "r"
    write(root, {"a.ts": "export function one() {\n  return two();\n}\nexport function two() {\n  return 1;\n}\n"})
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "a")
    g, _ = CodeGraph.build(spark, str(root), str(tmp_path / "i"))
    (root / "a.ts").write_text((root / "a.ts").read_text().replace("return 1", "return 2"))
    git("commit", "-qam", "b")
    found = g.diff_impact("HEAD~1")
    assert names([c["symbol"] for c in found["changed_symbols"]]) == ["two"] and [c["symbol"]["name"] for c in found["impacted"]] == ["one"]
    with pytest.raises(ValueError):
        g.diff_impact("--output=x")


def test_empty_tree(spark, tmp_path):
    (tmp_path / "r").mkdir()
    g, report = CodeGraph.build(spark, str(tmp_path / "r"), str(tmp_path / "i"))
    assert report.files_indexed == 0 and g.stats()["symbols"] == 0 and g.find_definition("x")["matches"] == []
    assert lookups.resolved_edges(g.g).isEmpty() and g.g.symbols.agg(F.count("*")).first()[0] == 0
