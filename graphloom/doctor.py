"""Health checks of a root and its index, each with a status and, where it is not ok, a hint."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

from graphloom.index import Index
from graphloom.schema import SCHEMA_VERSION, TABLES
from graphloom.sources.config import IGNORED, load_config
from graphloom.sources.extract import parse

#: One line of each language that its scanner must read as a definition.
PROBES = {
    "javascript": "function a() { b(); }", "typescript": "export const a = (x: number) => b(x);", "tsx": "export const A = () => <B />;", "python": "def a():\n    b()\n",
    "go": "func A() { b() }", "rust": "pub fn a() { b(); }", "java": "class A { void b() { c(); } }", "c": "int a(void) { return b(); }", "cpp": "class A { int b() { return c(); } };",
    "csharp": "class A { void B() { C(); } }", "ruby": "def a\n  b(1)\nend\n", "php": "<?php function a() { b(); }",
}


def run(spark: SparkSession, root: str, path: str) -> dict:
    checks = []

    def check(name: str, ok: bool, message: str, hint: str | None = None, status: str = "error") -> None:
        checks.append({"name": name, "status": "ok" if ok else status, "message": message, "hint": None if ok else hint})

    check("root", Path(root).is_dir(), f"root {root}", "pass an existing folder")
    index = Index(spark, path)
    try:
        info = index.meta()
        check("schema", info["schema_version"] == SCHEMA_VERSION, f"schema version {info['schema_version']}", "rebuild with `graphloom index --full`")
        version = index.path / info["version"]
        missing = [t for t in TABLES if not (version / t).exists()]
        check("index", not missing, "all tables are there" if not missing else f"missing tables: {', '.join(missing)}", "rebuild with `graphloom index --full`")
        check("snapshot", (version / "resolved_edges").exists(), "resolved edges", "rebuild with `graphloom snapshot`", "warn")
    except (OSError, ValueError, KeyError) as e:
        check("schema", False, f"cannot read the index: {e}", f"run `graphloom index {root}`")
    failed = [v for v, code in PROBES.items() if not parse(code, v).symbols]
    check("parsers", not failed, "all languages parse" if not failed else f"failing: {', '.join(failed)}", "report this")
    config = load_config(root)
    check("ignored paths", True, f"{len(IGNORED)} names are ignored, and {len(config.ignore)} more by configuration")
    check("server command", True, "graphloom mcp")
    return {"ok": all(c["status"] != "error" for c in checks), "checks": checks}
