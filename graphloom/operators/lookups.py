"""Queries that need no walk over the graph: DataFrame in, DataFrame out.

Orders and limits are part of each query's meaning; every order ends on the id.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom import match
from graphloom.functions import glob_like, glob_score, is_test_path, name_similarity
from graphloom.model import REFERENCE_COLUMNS, SYMBOL_COLUMNS, GraphTables

CONTAINERS = ["class", "interface", "struct", "enum", "record", "trait", "module", "impl"]
SIMILAR = 0.6


@dataclass
class Filters:
    """Options of search and unused; empty means any."""

    kinds: list[str] = field(default_factory=list)
    languages: list[str] = field(default_factory=list)
    exported: bool | None = None
    path_prefix: str | None = None
    limit: int = 50

    def condition(self) -> Column:
        out = F.lit(True)
        if self.kinds:
            out = out & F.col("kind").isin(self.kinds)
        if self.languages:
            out = out & F.col("language").isin(self.languages)
        if self.exported is not None:
            out = out & (F.col("exported") == self.exported)
        if self.path_prefix:
            out = out & F.col("path").startswith(self.path_prefix)
        return out

    @property
    def bounded(self) -> int:
        return min(max(self.limit, 1), 500)


def definition(g: GraphTables, symbol: str, limit: int = 25) -> DataFrame:
    """Best matches of a name, exact before suffix, short before long."""
    return g.symbol_records.filter(match.resolves(symbol)).orderBy(*match.resolve_order(symbol)).limit(limit)


def resolve_top1(g: GraphTables, symbol: str) -> DataFrame:
    return definition(g, symbol, 1)


def definitions(g: GraphTables, names: DataFrame, limit: int = 25) -> DataFrame:
    """`definition` for many names (column symbol) at once; adds rank and place."""
    order = W.partitionBy("symbol").orderBy("rank", F.length("qualified_name"), "path", "start_line", "id")
    return match.resolve_all(g.symbol_records, names).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)


def references(g: GraphTables, symbol: str, limit: int = 250) -> DataFrame:
    return g.reference_records.filter(match.calls(symbol, "symbol_name")).orderBy("path", "line", "id").limit(limit).select(REFERENCE_COLUMNS)


def references_batch(g: GraphTables, names: DataFrame) -> DataFrame:
    """Counts and first places of the references of many names, by exact match."""
    hits = g.reference_records.join(names.select("symbol").distinct(), F.col("symbol_name") == F.col("symbol"))
    return hits.groupBy("symbol").agg(F.count(F.lit(1)).alias("refs"), F.count_distinct("from_symbol_id").alias("callers"), F.min("path").alias("first_path"))


def references_from(g: GraphTables, symbol_id: int, limit: int = 100) -> DataFrame:
    return g.reference_records.filter(F.col("from_symbol_id") == symbol_id).orderBy("line", "id").limit(limit).select(REFERENCE_COLUMNS)


def _path_arm(path: str) -> Column:
    """The path itself or what starts like it; LIKE, so case does not matter and `_` matches any character."""
    path = path.replace("\\", "/")
    if path in ("", "."):
        return F.lit(True)
    return (F.col("path") == path) | F.lower("path").like(match.like_pattern(path) + "%")


def outline(g: GraphTables, path: str, limit: int = 1000) -> DataFrame:
    return g.symbol_records.filter(_path_arm(path)).orderBy("path", "start_line", "id").limit(limit)


def imports_of(g: GraphTables, path: str, limit: int = 500) -> DataFrame:
    while path.endswith("*"):
        path = path[:-1]
    joined = g.imports.join(g.files.select(F.col("id").alias("file_id"), "path"), "file_id")
    return joined.filter(_path_arm(path)).orderBy("path", "line", "id").limit(limit).select("source", F.col("path").alias("from_path"), "line", "kind")


def imported_by(g: GraphTables, source: str, limit: int = 500) -> DataFrame:
    arm = (F.col("source") == source) | F.lower("source").like("%" + match.like_pattern(source) + "%")
    joined = g.imports.filter(arm).join(g.files.select(F.col("id").alias("file_id"), "path"), "file_id")
    return joined.orderBy("path", "line", "id").limit(limit).select("source", F.col("path").alias("from_path"), "line", "kind")


def members(g: GraphTables, limit: int = 200, containers: DataFrame | None = None) -> DataFrame:
    """Symbols within each container's lines, by containment in the same file.

    The range join is an equi-join on the file with the range as a residual, so
    it costs files' symbol counts squared at most, never the table's.
    """
    outer = (containers if containers is not None else g.symbol_records.filter(F.col("kind").isin(CONTAINERS))).select(F.col("id").alias("container_id"), F.col("file_id"), F.col("start_line").alias("outer_start"), F.col("end_line").alias("outer_end"))
    inside = (F.col("start_line") > F.col("outer_start")) & (F.col("end_line") <= F.col("outer_end")) & (F.col("id") != F.col("container_id"))
    order = W.partitionBy("container_id").orderBy("start_line", "id")
    found = g.symbol_records.join(outer, "file_id").filter(inside)
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit).select("container_id", *SYMBOL_COLUMNS)


def signature_members(g: GraphTables, symbol: str) -> DataFrame:
    """The members of the best match, if it is a container."""
    return members(g, containers=resolve_top1(g, symbol).filter(F.col("kind").isin(CONTAINERS))).orderBy("start_line", "id")


def siblings_raw(g: GraphTables, symbol: str, limit: int = 50) -> DataFrame:
    """Names that the callers of `symbol` also call, by how many callers they share."""
    callers = g.edges.filter(match.calls(symbol)).select("from_symbol_id").distinct()
    also = g.edges.join(callers, "from_symbol_id", "left_semi").filter(F.col("to_symbol_name") != symbol)
    return also.groupBy("to_symbol_name").agg(F.count_distinct("from_symbol_id").alias("shared_callers")).orderBy(F.desc("shared_callers"), "to_symbol_name").limit(limit)


def siblings(g: GraphTables, symbol: str, limit: int = 50) -> DataFrame:
    """Siblings with where they are defined; names that resolve to nothing keep their own name."""
    raw = siblings_raw(g, symbol, limit)
    best = match.resolve_best(g.symbol_records, raw.select(F.col("to_symbol_name").alias("symbol"))).select(F.col("symbol").alias("to_symbol_name"), F.col("qualified_name").alias("resolved"), "path", F.col("start_line").alias("line"))
    joined = raw.join(best, "to_symbol_name", "left")
    return joined.select(F.coalesce("resolved", "to_symbol_name").alias("qualified_name"), "shared_callers", "path", "line", "to_symbol_name").orderBy(F.desc("shared_callers"), "to_symbol_name")


def inbound_counts(g: GraphTables) -> DataFrame:
    """id, inbound_refs, inbound_edges of each symbol; a name equal to the qualified name counts once."""
    refs = g.refs.groupBy(F.col("symbol_name").alias("key")).agg(F.count(F.lit(1)).alias("r"))
    edges = g.edges.groupBy(F.col("to_symbol_name").alias("key")).agg(F.count(F.lit(1)).alias("e"))
    counted = g.symbol_keys.join(refs, "key", "left").join(edges, "key", "left")
    return counted.groupBy("id").agg(F.coalesce(F.sum("r"), F.lit(0)).alias("inbound_refs"), F.coalesce(F.sum("e"), F.lit(0)).alias("inbound_edges"))


def unused(g: GraphTables, options: Filters | None = None) -> DataFrame:
    """Symbols outside test paths that nothing refers to.  A self-call counts as use."""
    options = options or Filters()
    used = g.refs.select(F.col("symbol_name").alias("key")).union(g.edges.select("to_symbol_name")).distinct()
    live = g.symbol_keys.join(used, "key", "left_semi").select("id").distinct()
    free = g.symbol_records.filter(options.condition() & ~is_test_path("path")).join(live, "id", "left_anti")
    return free.orderBy("qualified_name", "id").limit(options.bounded).select(*SYMBOL_COLUMNS, F.lit(0).cast("long").alias("inbound_refs"), F.lit(0).cast("long").alias("inbound_edges"))


def fanout(g: GraphTables) -> DataFrame:
    return g.edges.groupBy("from_symbol_id").agg(F.count_distinct("to_symbol_name").alias("fanout"))


def fanin(g: GraphTables) -> DataFrame:
    return g.edges.groupBy("to_symbol_name").agg(F.count_distinct("from_symbol_id").alias("fanin"))


def stats_counts(g: GraphTables) -> DataFrame:
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in (("files", g.files), ("symbols", g.symbols), ("refs", g.refs), ("edges", g.edges), ("imports", g.imports))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def stats_language(g: GraphTables) -> DataFrame:
    return g.files.groupBy("language").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "language")


def stats_kind(g: GraphTables) -> DataFrame:
    return g.symbols.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "kind")


def top_fanout(g: GraphTables, limit: int = 10) -> DataFrame:
    """Symbols by how many distinct callers name them (named fan-out, but it is fan-in).

    The disjunctive join on either name is an equi-join on exploded keys.  Edges
    are reduced to distinct (name, caller) pairs before the join.
    """
    calls = g.edges.select(F.col("to_symbol_name").alias("key"), "from_symbol_id").distinct()
    names = g.symbols.select(F.explode(F.array_distinct(F.array("name", "qualified_name"))).alias("key"), "qualified_name").distinct()
    return calls.join(names, "key").groupBy("qualified_name").agg(F.count_distinct("from_symbol_id").alias("callers")).orderBy(F.desc("callers"), "qualified_name").limit(limit)


def most_called(g: GraphTables, limit: int = 1) -> DataFrame:
    """Functions and methods by how many call edges carry one of their names."""
    calls = g.edges.groupBy(F.col("to_symbol_name").alias("key")).agg(F.count(F.lit(1)).alias("calls"))
    names = g.symbols.filter(F.col("kind").isin("function", "method")).select(F.explode(F.array_distinct(F.array("name", "qualified_name"))).alias("key"), "name", "id")
    return names.join(calls, "key").groupBy("name").agg(F.sum("calls").alias("calls")).orderBy(F.desc("calls"), "name").limit(limit)


def search_list(g: GraphTables, limit: int) -> DataFrame:
    return g.symbol_records.orderBy("qualified_name", "id").limit(limit)


def search_glob(g: GraphTables, pattern: str, limit: int) -> DataFrame:
    like = glob_like(pattern)
    return g.symbol_records.filter(F.lower("name").like(like) | F.lower("qualified_name").like(like)).orderBy(F.length("qualified_name"), "qualified_name", "id").limit(limit)


def fuzzy(g: GraphTables, query: str, limit: int, scan: int = 5000) -> DataFrame:
    """Case-insensitive substring candidates (the first `scan` symbols if there are none), ranked by Jaro-Winkler, 0.6 at least."""
    word = "".join(c for c in query if c.isascii() and (c.isalnum() or c == "_")).lower()
    records = g.symbol_records
    found = None
    if len(word) >= 3:
        found = records.filter(F.lower("name").contains(word) | F.lower("qualified_name").contains(word)).orderBy("id").limit(limit * 4)
        if found.isEmpty():
            found = None
    if found is None:
        found = records.orderBy("qualified_name", "id").limit(scan)
    scored = found.withColumn("similarity", name_similarity(F.lit(query)))
    return scored.filter(F.col("similarity") >= SIMILAR).orderBy(F.desc("similarity"), "qualified_name", "id").limit(limit)


def search(g: GraphTables, pattern: str, options: Filters | None = None) -> DataFrame:
    """Glob, list or fuzzy search.  Filters apply after the candidates' limit, which can be seen in results."""
    options = options or Filters()
    pool = max(options.bounded * 4, 50)
    if "*" in pattern:
        found = search_glob(g, pattern, pool).withColumn("score", glob_score(F.col("name"), pattern))
    elif not pattern:
        found = search_list(g, pool).withColumn("score", F.lit(0.5))
    else:
        found = fuzzy(g, pattern, pool).withColumnRenamed("similarity", "score")
    return found.filter(options.condition()).orderBy(F.desc("score"), "qualified_name", "id").limit(options.bounded).select(*SYMBOL_COLUMNS, "score")


def suggestions(g: GraphTables, query: str, limit: int = 5) -> DataFrame:
    return fuzzy(g, query, limit).select("qualified_name", "name", "path", F.col("start_line").alias("line"), F.col("similarity").alias("confidence"))


def suggest_many(g: GraphTables, names: DataFrame, limit: int = 3) -> DataFrame:
    """Suggestions for many unknown names at once.

    Candidates share a lower-case trigram with the query, by an equi-join on
    trigrams; names that share none have a similarity below what is kept, unless
    both are very short.
    """
    def grams(c: Column) -> Column:
        low = F.lower(c)
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - 2, F.lit(1))), lambda i: F.substring(low, i, F.lit(3))))

    asked = names.select("symbol").distinct().withColumn("gram", F.explode(grams(F.col("symbol"))))
    known = g.symbol_records.withColumn("gram", F.explode(grams(F.col("qualified_name"))))
    pairs = known.join(asked, "gram").select("symbol", "id", "name", "qualified_name", "path", "start_line").distinct()
    scored = pairs.withColumn("confidence", name_similarity(F.col("symbol"))).filter(F.col("confidence") >= SIMILAR)
    best = W.partitionBy("symbol").orderBy(F.desc("confidence"), "qualified_name", "id")
    return scored.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= limit).select("symbol", "place", "qualified_name", "name", "path", F.col("start_line").alias("line"), "confidence")


def exists_many(g: GraphTables, names: DataFrame) -> DataFrame:
    """symbol, exists: exact membership, as the bloom filter in front of the suffix match makes it."""
    known = g.symbol_keys.select(F.col("key").alias("symbol")).distinct().withColumn("exists", F.lit(True))
    return names.select("symbol").distinct().join(known, "symbol", "left").select("symbol", F.coalesce("exists", F.lit(False)).alias("exists"))


def resolved_edges(g: GraphTables) -> DataFrame:
    """The snapshot: each edge with the symbols of that qualified name, or else of that name."""
    edges = g.edges.select(F.col("id").alias("edge_id"), "from_symbol_id", "to_symbol_name")
    by_qualified = g.symbols.select(F.col("qualified_name").alias("to_symbol_name"), F.col("id").alias("to_symbol_id"))
    by_name = g.symbols.select(F.col("name").alias("to_symbol_name"), F.col("id").alias("to_symbol_id"))
    qualified = g.symbols.select(F.col("qualified_name").alias("to_symbol_name")).distinct()
    first = edges.join(by_qualified, "to_symbol_name")
    second = edges.join(qualified, "to_symbol_name", "left_anti").join(by_name, "to_symbol_name")
    return first.unionByName(second).select("edge_id", "from_symbol_id", "to_symbol_id")


def hunk_symbols(g: GraphTables, hunks: DataFrame) -> DataFrame:
    """Symbols whose lines overlap a hunk (path, new_start, new_count), with the lines added.  Unknown paths drop out."""
    hunks = hunks.groupBy("path", "new_start", "new_count").agg(F.count(F.lit(1)).alias("hunks"))  # equal hunks meet the symbols once
    end = F.col("new_start") + F.greatest(F.col("new_count"), F.lit(1)) - 1
    joined = g.symbol_records.join(hunks.select("path", "new_start", end.alias("hunk_end"), "new_count", "hunks"), "path")
    hit = joined.filter((F.col("start_line") <= F.col("hunk_end")) & (F.col("end_line") >= F.col("new_start")))
    return hit.groupBy(SYMBOL_COLUMNS).agg(F.sum(F.col("new_count") * F.col("hunks")).alias("added_lines")).withColumn("removed_lines", F.lit(0))
