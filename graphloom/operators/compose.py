"""Queries made of other queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom import match
from graphloom.functions import is_test_path
from graphloom.model import SYMBOL_COLUMNS, GraphTables
from graphloom.operators import graph as walks
from graphloom.operators import lookups as look

#: Intents in order of precedence, the words that tell them, and the tools they lead to with expected tokens.
INTENTS = [
    ("prepare_edit", ["edit", "change", "modify", "refactor", "fix"], [("validate", 80), ("edit-prep", 1300), ("impact", 500)]),
    ("review_changes", ["review", "pr", "diff", "changed", "regression"], [("diff-impact", 900), ("tests-for", 250)]),
    ("trace_connection", ["call path", "connect", "reach", "flow"], [("connect", 250), ("export", 450)]),
    ("find_cleanup_targets", ["unused", "dead", "cleanup"], [("unused", 600), ("impact", 400)]),
    ("locate_symbol", ["where", "definition", "find", "locate"], [("validate", 80), ("find-definition", 120), ("signature", 180)]),
    ("understand_symbol", [], [("validate", 80), ("context-pack", 1200), ("siblings", 250)]),
]
#: What each tool is for, and its arguments; {} is the symbol.
TOOLS = {
    "validate": ("Make sure that the name exists.", "validate {}"),
    "edit-prep": ("Get signature, siblings, context and tests together.", "edit-prep {}"),
    "impact": ("See which callers are reached.", "impact {}"),
    "diff-impact": ("See which callers the changed symbols reach.", "diff-impact origin/main --depth 3"),
    "tests-for": ("See which tests reach the symbol.", "tests-for {}"),
    "connect": ("Find the shortest chain of calls.", "connect <from> <to> --depth 8"),
    "export": ("Draw the calls that start here.", "export --from <from> --depth 3"),
    "unused": ("List symbols that nothing refers to.", "unused --limit 50"),
    "find-definition": ("Get file, line and signature.", "find-definition {}"),
    "signature": ("Get the shape without bodies.", "signature {}"),
    "context-pack": ("Get body, dependencies, callers and tests within a budget.", "context-pack {}"),
    "siblings": ("Find what its callers also call.", "siblings {}"),
}


def intent(task: Column) -> Column:
    """The first intent one of whose words occurs anywhere in the text, also within other words."""
    low, out = F.lower(task), None
    for name, words, _ in INTENTS:
        if words:
            hit = F.lit(False)
            for w in words:
                hit = hit | low.contains(w)
            out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(INTENTS[-1][0])


def plan_query_many(tasks: DataFrame) -> DataFrame:
    """Adds intent and expected tokens to `tasks` (column task)."""
    named = tasks.withColumn("intent", intent(F.col("task")))
    tokens = F.create_map(*[F.lit(x) for name, _, steps in INTENTS for x in (name, sum(t for _, t in steps) + 40)])
    return named.withColumn("expected_tokens", tokens[F.col("intent")])


def plan_query(task: str, symbol: str | None = None) -> dict:
    text = task.strip()
    low, subject = text.lower(), (symbol or "").strip() or "<symbol>"
    name, _, steps = next(x for x in INTENTS if not x[1] or any(w in low for w in x[1]))
    return {
        "query": text,
        "inferred_intent": name,
        "steps": [{"order": i, "tool": tool, "command": "graphloom " + TOOLS[tool][1].format(subject), "reason": TOOLS[tool][0], "expected_tokens": tokens} for i, (tool, tokens) in enumerate(steps, 1)],
    }


def bodies(g: GraphTables, symbols: DataFrame) -> DataFrame:
    """Adds body: the symbol's lines; null where the source is not there."""
    if g.sources is None:
        return symbols.withColumn("body", F.lit(None).cast("string"))
    lines = F.split("content", "\n")
    body = F.array_join(F.slice(lines, F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    return symbols.join(g.sources.select("file_id", "content"), "file_id", "left").withColumn("body", body).drop("content")


def dependencies(g: GraphTables, symbol_id: int, limit: int = 80) -> DataFrame:
    """Best matches of the names that a symbol refers to."""
    names = g.refs.filter(F.col("from_symbol_id") == symbol_id).groupBy("symbol_name").agg(F.min("id").alias("first")).orderBy("first").limit(limit)
    return match.resolve_best(g.symbol_records, names.select(F.col("symbol_name").alias("symbol"))).orderBy("qualified_name", "id")


def context_callers(g: GraphTables, qualified_name: str, name: str, limit: int = 60) -> DataFrame:
    """Callers by qualified name, or by name if that has none."""
    spark = g.symbols.sparkSession
    for key in dict.fromkeys((qualified_name, name)):
        names = spark.createDataFrame([(0, key)], "seed long, name string")
        found = walks.callers_of(g, names, limit).drop("name").withColumnRenamed("caller_name", "name").select(SYMBOL_COLUMNS)
        if not found.isEmpty():
            break
    return found.orderBy("path", "start_line", "id")


def diff_impact_frames(g: GraphTables, hunks: DataFrame, depth: int = 3) -> tuple[DataFrame, DataFrame]:
    """Changed symbols; impacted symbols with the best criticality and the first changed symbol that gives it."""
    changed = walks.cut(look.hunk_symbols(g, hunks), "changed")
    # seeds are in the order of the symbols, not without gaps
    targets = walks.cut(changed.orderBy("path", "start_line", "id").select(F.monotonically_increasing_id().alias("seed"), F.col("qualified_name").alias("query"), *SYMBOL_COLUMNS), "targets")
    # of symbols that give the same callers, the first is named
    targets, frontier = walks.first_of_alike(g, targets, max(depth, 1))
    found = walks.impact_many(g, targets, max(depth, 1), limit=20, frontier=frontier)
    named = found.join(targets.select("seed", F.col("query").alias("via")), "seed")
    high = F.desc(F.round("criticality", 6))  # the last bits depend on the order of sums
    best = W.partitionBy("id").orderBy(high, "seed")
    top = named.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")
    return changed.orderBy("path", "start_line", "id"), top.orderBy(high, "path", "start_line", "id").limit(50).select(*SYMBOL_COLUMNS, "via", "criticality")


def check_snippet(g: GraphTables, refs: DataFrame) -> DataFrame:
    """`refs`: symbol_name, line, column.  Adds exists and up to three suggestions."""
    names = refs.select(F.col("symbol_name").alias("symbol"))
    known = look.exists_many(g, names)
    missing = known.filter("not exists").select("symbol")
    near = look.suggest_many(g, missing).groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("place", "qualified_name", "name", "path", "line", "confidence"))).alias("candidates"))  # three a name
    joined = refs.join(known, F.col("symbol_name") == F.col("symbol")).drop("symbol").join(near, F.col("symbol_name") == F.col("symbol"), "left").drop("symbol")
    return joined.orderBy("line", "column", "symbol_name")


def unused_tests(records: DataFrame) -> DataFrame:
    return records.filter(is_test_path("path"))
