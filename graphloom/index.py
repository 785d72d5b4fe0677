"""The stored index: five tables of parquet in a version folder, and a pointer to the current version.

A full run extracts every file; an incremental one only those whose content hash
differs, keeps the rest's rows, and drops rows of files that are gone.  Ids are
hashes of path and place, so rows of unchanged files keep theirs.  A version is
written whole before the pointer is replaced: readers see the old or the new one.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.bloom import Bloom, build_bloom
from graphloom.model import GraphTables
from graphloom.operators.lookups import resolved_edges
from graphloom.schema import SCHEMA_VERSION, TABLES
from graphloom.sources.config import Config, load_config
from graphloom.sources.extract import extract
from graphloom.sources.scan import scan_tree


@dataclass
class IndexReport:
    files_indexed: int = 0
    files_reused: int = 0
    files_removed: int = 0
    symbols_indexed: int = 0
    references_indexed: int = 0
    elapsed_ms: int = 0
    mode: str = "incremental"
    warnings: list[dict] = field(default_factory=list)


class MissingIndex(FileNotFoundError):
    pass


def classify(scan: DataFrame, stored: DataFrame) -> DataFrame:
    """path, state: new, changed, unchanged or removed, of two tables of path and sha256."""
    a, b = scan.select("path", F.col("sha256").alias("now")), stored.select("path", F.col("sha256").alias("was"))
    state = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "removed").when(F.col("now") == F.col("was"), "unchanged").otherwise("changed")
    return a.join(b, "path", "full_outer").select("path", state.alias("state"), "now")


def tables_of(scanned: DataFrame, extracted: DataFrame) -> dict[str, DataFrame]:
    """The five tables (and sources) of scanned files and what was extracted from them."""
    file_id = F.xxhash64("path")
    files = scanned.select(file_id.alias("id"), "path", "language", "sha256", F.when(F.col("content") == "", 0).otherwise(F.size(F.split(F.regexp_replace("content", r"\n$", ""), "\n"))).cast("int").alias("loc"), F.current_timestamp().alias("indexed_at"))
    row_id = lambda rec: F.xxhash64("path", F.lit(rec), "ordinal")
    symbols = extracted.filter("rec = 'symbol'").select(row_id("symbol").alias("id"), "name", "qualified_name", "kind", file_id.alias("file_id"), "start_line", "end_line", "signature", "exported")
    # a name that a file defines twice binds to the first definition
    first = extracted.filter("rec = 'symbol'").groupBy(file_id.alias("file_id"), F.col("qualified_name").alias("from_qualified_name")).agg(F.min("ordinal").alias("ordinal"), F.first("path").alias("path"))
    owner = first.select("file_id", "from_qualified_name", row_id("symbol").alias("from_symbol_id"))
    refs = extracted.filter("rec = 'ref'").select(row_id("ref").alias("id"), F.col("name").alias("symbol_name"), file_id.alias("file_id"), F.col("start_line").alias("line"), "column", "context", "kind", "from_qualified_name")
    refs = refs.join(owner, ["file_id", "from_qualified_name"], "left").select("id", "symbol_name", "from_symbol_id", "file_id", "line", "column", "context", "kind")
    edges = refs.filter("from_symbol_id is not null").select("id", "from_symbol_id", F.col("symbol_name").alias("to_symbol_name"), "kind", F.lit(1.0).alias("weight"))
    imports = extracted.filter("rec = 'import'").select(row_id("import").alias("id"), file_id.alias("file_id"), F.col("name").alias("source"), F.col("start_line").alias("line"), "kind")
    return {"files": files, "symbols": symbols, "refs": refs, "edges": edges, "imports": imports, "sources": scanned.select(file_id.alias("file_id"), "path", "content")}


class Index:
    """An index in a folder.  `path` must be reachable by the driver and the executors."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, Path(path)

    @property
    def pointer(self) -> Path:
        return self.path / "CURRENT"

    def meta(self) -> dict:
        if not self.pointer.exists():
            raise MissingIndex(f"no index at {self.path}; run `graphloom index <root>` first")
        return json.loads(self.pointer.read_text())

    def tables(self) -> GraphTables:
        version = self.path / self.meta()["version"]
        read = {name: self.spark.read.schema(schema).parquet(str(version / name)) for name, schema in TABLES.items()}
        return GraphTables(**read)

    def bloom(self) -> Bloom | None:
        file = self.path / self.meta()["version"] / "bloom"
        return Bloom.from_bytes(file.read_bytes()) if file.exists() else None

    def warnings(self) -> DataFrame:
        """path, message: all files that the last run left out."""
        return self.spark.read.schema("path string, message string").parquet(str(self.path / self.meta()["version"] / "warnings"))

    def snapshot(self) -> DataFrame:
        return self.spark.read.parquet(str(self.path / self.meta()["version"] / "resolved_edges"))

    def build(self, root: str, full: bool = False, config: Config | None = None) -> IndexReport:
        began = time.time()
        config = config or load_config(root)
        scanned, warnings = scan_tree(self.spark, root, config)
        scanned = scanned.cache()
        old = self.tables() if not full and self.pointer.exists() else None
        report = IndexReport(mode="full" if full or old is None else "incremental", warnings=warnings)
        if old is None:
            fresh, kept = scanned, None
        else:
            states = classify(scanned, old.files).cache()
            by = {r.state: r.n for r in states.groupBy("state").agg(F.count(F.lit(1)).alias("n")).collect()}
            report.files_reused, report.files_removed = by.get("unchanged", 0), by.get("removed", 0)
            fresh = scanned.join(states.filter("state in ('new', 'changed')").select("path"), "path", "left_semi")
            kept = states.filter("state = 'unchanged'").select(F.xxhash64("path").alias("file_id"))
            if not by.get("new", 0) + by.get("changed", 0) + by.get("removed", 0):
                states.unpersist()
                scanned.unpersist()
                report.elapsed_ms = int((time.time() - began) * 1000)
                return report
        extracted = extract(fresh).cache()
        warned = extracted.filter("rec = 'warning'").select("path", F.col("context").alias("message"))
        failed = warned.select("path").distinct()
        made = tables_of(fresh.join(failed, "path", "left_anti"), extracted.filter("rec != 'warning'"))
        if kept is not None:
            made = {name: part.unionByName(_kept(old, name, kept)) for name, part in made.items()}
        version = f"v-{int(time.time() * 1000)}-{uuid.uuid4().hex[:8]}"
        # all warnings are kept beside the tables; the report shows the first hundred
        warned.orderBy("path").write.parquet(str(self.path / version / "warnings"))
        report.warnings += [r.asDict() for r in self.spark.read.schema("path string, message string").parquet(str(self.path / version / "warnings")).orderBy("path").limit(100).collect()]
        for name, df in made.items():
            if name in ("symbols", "refs", "edges"):  # clustered by the names that lookups ask for, so that row groups can be skipped
                df = df.sortWithinPartitions({"symbols": "name", "refs": "symbol_name", "edges": "to_symbol_name"}[name])
            df.write.parquet(str(self.path / version / name))
        written = GraphTables(**{name: self.spark.read.schema(schema).parquet(str(self.path / version / name)) for name, schema in TABLES.items()})
        resolved_edges(written).write.parquet(str(self.path / version / "resolved_edges"))
        (self.path / version / "bloom").write_bytes(build_bloom(written.symbols).to_bytes())
        report.files_indexed = fresh.count()
        report.symbols_indexed, report.references_indexed = (extracted.filter(f"rec = '{rec}'").count() for rec in ("symbol", "ref"))
        self._point(version, root)
        extracted.unpersist()
        scanned.unpersist()
        report.elapsed_ms = int((time.time() - began) * 1000)
        return report

    def _point(self, version: str, root: str) -> None:
        temporary = self.pointer.with_suffix(".next")
        temporary.write_text(json.dumps({"version": version, "root": str(root), "schema_version": SCHEMA_VERSION}))
        os.replace(temporary, self.pointer)


def _kept(old: GraphTables, name: str, kept: DataFrame) -> DataFrame:
    """The rows of unchanged files."""
    df = getattr(old, name)
    if name == "files":
        return df.join(kept, df["id"] == kept["file_id"], "left_semi")
    if name == "edges":
        owners = old.symbols.join(kept, "file_id", "left_semi").select(F.col("id").alias("from_symbol_id"))
        return df.join(owners, "from_symbol_id", "left_semi").select("id", "from_symbol_id", "to_symbol_name", "kind", "weight")
    return df.join(kept, "file_id", "left_semi").select(df.columns)


def report_json(report: IndexReport) -> str:
    return json.dumps(asdict(report))
