"""The graph tables as DataFrames, and the two projections that nearly every query starts from."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOL_COLUMNS = ["id", "name", "qualified_name", "kind", "file_id", "path", "language", "start_line", "end_line", "signature", "exported"]
REFERENCE_COLUMNS = ["id", "symbol_name", "from_symbol_id", "from_symbol", "path", "line", "column", "context", "kind"]


@dataclass
class GraphTables:
    files: DataFrame
    symbols: DataFrame
    refs: DataFrame
    edges: DataFrame
    imports: DataFrame
    sources: DataFrame | None = None

    @cached_property
    def symbol_records(self) -> DataFrame:
        """Symbols with path and language.  Files may be many: Spark broadcasts them only if they are small."""
        return self.symbols.join(self.files.select(F.col("id").alias("file_id"), "path", "language"), "file_id").select(SYMBOL_COLUMNS)

    @cached_property
    def reference_records(self) -> DataFrame:
        """References with path and the caller's qualified name (null at top level)."""
        callers = self.symbols.select(F.col("id").alias("from_symbol_id"), F.col("qualified_name").alias("from_symbol"))
        paths = self.files.select(F.col("id").alias("file_id"), "path")
        return self.refs.join(paths, "file_id").join(callers, "from_symbol_id", "left").select(*REFERENCE_COLUMNS, "file_id")

    @cached_property
    def symbol_keys(self) -> DataFrame:
        """(key, id): a row for each of a symbol's distinct name and qualified name."""
        return self.symbols.select(F.explode(F.array_distinct(F.array("name", "qualified_name"))).alias("key"), "id")

    @cached_property
    def call_limits(self) -> tuple[int, bool]:
        """The most callers of any name, and whether a called name has a dot: one pass, kept.

        Walks skip the cap on callers and the suffix arm where neither can matter.
        """
        top = self.edges.groupBy("to_symbol_name").agg(F.count_distinct("from_symbol_id").alias("n")).agg(F.max("n").alias("n"), F.max(F.col("to_symbol_name").contains(".")).alias("dot")).first()
        return top["n"] or 0, bool(top["dot"])

    def cache(self) -> GraphTables:
        for df in (self.files, self.symbols, self.refs, self.edges, self.imports):
            df.cache()
        return self
