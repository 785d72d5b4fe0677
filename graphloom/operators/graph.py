"""Walks over the call graph, for one start or many.

Every walk is a loop of joins over a bounded number of levels (13 at most), each
cut off in the shared folder, so lineage and recomputation stay bounded.  Edges are
late-bound: they lead to names, and a name leads to all symbols that carry it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom import match
from graphloom.functions import is_test_path
from graphloom.model import SYMBOL_COLUMNS, GraphTables
from graphloom.operators.lookups import fanin, fanout, resolve_top1
from graphloom.plans.lineage import cut

DAMPING, ROUNDS = 0.85, 25
FRONTIER, PER_NAME, PER_NODE, VISITED = 800, 500, 200, 5000
#: Nodes of the seeds that PageRank takes at once.
BLOCK = 4096


def callers_of(g: GraphTables, names: DataFrame, limit: int = PER_NAME) -> DataFrame:
    """`names`: seed, name.  seed, name and the caller's record, `limit` callers a seed and name, by path and line.

    A called name with a dot in it also answers to its dotted suffixes.
    """
    names = names.select("seed", "name").distinct()
    edges = g.edges.select("from_symbol_id", F.col("to_symbol_name").alias("called")).distinct()
    plain = edges.join(names, F.col("called") == F.col("name")).select("seed", "name", "from_symbol_id")
    dotted = edges.filter(F.col("called").contains("."))
    tails = dotted.select("from_symbol_id", F.explode(match._suffixes("called")).alias("tail"))
    suffix = tails.join(names, F.col("tail") == F.lower("name")).select("seed", "name", "from_symbol_id")
    hits = plain.union(suffix).distinct()
    records = g.symbol_records.select([F.col(c).alias(f"caller_{c}") if c in ("name",) else F.col(c) for c in SYMBOL_COLUMNS])
    order = W.partitionBy("seed", "name").orderBy("path", "start_line", "id")
    found = hits.join(records, hits["from_symbol_id"] == records["id"]).drop("from_symbol_id")
    return found.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= limit).drop("_n")


def reverse_bfs(g: GraphTables, starts: DataFrame, depth: int, stop_at_tests: bool = False) -> DataFrame:
    """`starts`: seed, name.  seed, the caller's record and its least depth (1 for direct callers), within `depth` levels."""
    names = starts.select("seed", "name").distinct()
    most, dotted = g.call_limits
    found = None
    for level in range(1, depth + 1):
        if most <= PER_NAME and not dotted:  # no cap can bind, and names match exactly only
            ids = g.edges.join(names, F.col("to_symbol_name") == F.col("name")).select("seed", F.col("from_symbol_id").alias("id")).distinct()
        else:
            ids = callers_of(g, names).select("seed", "id").distinct()
        if found is not None:
            ids = ids.join(found.select("seed", "id"), ["seed", "id"], "left_anti")
        hits = cut(ids.join(g.symbol_records, "id").select("seed", *SYMBOL_COLUMNS, F.lit(level).alias("depth")), "callers")
        found = hits if found is None else found.unionByName(hits)
        if level == depth or hits.isEmpty():
            break
        onward = hits.filter(~is_test_path("path")) if stop_at_tests else hits
        names = onward.select("seed", F.explode(F.array_distinct(F.array("name", "qualified_name"))).alias("name")).distinct()  # a name asked again brings no new caller
    return found


def transitive_callers(g: GraphTables, target: str, depth: int) -> DataFrame:
    """(id, depth) of all callers within `depth` levels, by least depth."""
    spark = g.symbols.sparkSession
    starts = spark.createDataFrame([(0, target)], "seed long, name string")
    return reverse_bfs(g, starts, max(depth, 1)).select("id", "depth").orderBy("depth", "id")


def tests_for(g: GraphTables, symbol: str) -> DataFrame:
    """Test-path callers within six levels; a test is reported and not passed through.  Starts from the text as given."""
    starts = g.symbols.sparkSession.createDataFrame([(0, symbol)], "seed long, name string")
    return reverse_bfs(g, starts, 6, stop_at_tests=True).filter(is_test_path("path")).orderBy("path", "start_line", "id").select(SYMBOL_COLUMNS)


def seeds_of(targets: DataFrame) -> DataFrame:
    """`targets`: seed, query, and the resolved record.  The names a walk starts from."""
    return targets.select("seed", F.explode(F.array_distinct(F.array("query", "name", "qualified_name"))).alias("name"))


def impact_frontier(g: GraphTables, targets: DataFrame, depth: int) -> DataFrame:
    """Callers by least depth, the first `FRONTIER` a seed, nearest first."""
    found = reverse_bfs(g, seeds_of(targets), max(depth, 1))
    order = W.partitionBy("seed").orderBy("depth", "path", "start_line", "id")
    return found.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= FRONTIER).drop("_n")


def personal_pagerank(n: int, edges: np.ndarray, teleport: np.ndarray, walk: np.ndarray | None = None) -> np.ndarray:
    """25 rounds over edges (u, v), parallel edges counted; dangling mass goes to the teleport; sums to one.

    `walk`: of several walks that share no edge, the number of each node's; each sums to one.
    """
    walk = np.zeros(n, int) if walk is None else walk
    out = np.bincount(edges[:, 0], minlength=n) if len(edges) else np.zeros(n)
    rank = teleport.copy()
    for _ in range(ROUNDS):
        flow = np.bincount(edges[:, 1], rank[edges[:, 0]] / out[edges[:, 0]], n) if len(edges) else np.zeros(n)
        rank = (1 - DAMPING) * teleport + DAMPING * (flow + np.bincount(walk, np.where(out == 0, rank, 0))[walk] * teleport)
        total = np.bincount(walk, rank)[walk]
        rank = np.divide(rank, total, out=rank, where=total > 0)
    return rank


def _rank(nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """Kernel of a block of seeds: at most `BLOCK` nodes, or one seed's FRONTIER + 1."""
    if nodes.empty:
        return pd.DataFrame({"seed": [], "id": [], "pagerank": []})
    nodes = nodes.sort_values(["seed", "id"]).reset_index(drop=True)
    edges = edges.sort_values(["seed", "callee", "caller"])
    place = pd.MultiIndex.from_frame(nodes[["seed", "id"]])
    ends = [place.get_indexer(pd.MultiIndex.from_arrays([edges["seed"], edges[end]])) for end in ("callee", "caller")]
    walk = np.unique(nodes["seed"].to_numpy(), return_inverse=True)[1]
    first = np.r_[True, walk[1:] != walk[:-1]]
    teleport = nodes["target"].to_numpy(dtype=float)
    for other in ((nodes["depth"] == 1).to_numpy(dtype=float), first.astype(float)):
        teleport = np.where(np.bincount(walk, teleport)[walk] > 0, teleport, other)
    rank = personal_pagerank(len(nodes), np.stack(ends, axis=1), teleport / np.bincount(walk, teleport)[walk], walk)
    return pd.DataFrame({"seed": nodes["seed"], "id": nodes["id"], "pagerank": rank})


def impact_targets(g: GraphTables, names: DataFrame) -> DataFrame:
    """`names`: seed, query.  The resolved record of each that resolves."""
    best = match.resolve_best(g.symbol_records, names.select(F.col("query").alias("symbol")))
    return names.join(best.withColumnRenamed("symbol", "query"), "query").select("seed", "query", *SYMBOL_COLUMNS)


def first_of_alike(g: GraphTables, targets: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """The targets without those that give what one of a smaller seed gives, and their frontier.

    Symbols of one name and qualified name, asked for by these, have the same callers,
    and these the same ranks, unless the symbol is among its own callers.
    """
    alike = W.partitionBy("query", "name", "qualified_name")
    led = cut(targets.withColumn("lead", F.min("seed").over(alike)), "led")
    frontier = cut(impact_frontier(g, led.filter("seed = lead").drop("lead"), depth), "frontier")
    own = frontier.select(F.col("seed").alias("lead"), "id", F.lit(True).alias("own"))
    led = led.join(own, ["lead", "id"], "left").withColumn("own", F.coalesce("own", F.lit(False)))
    first = F.min("seed").over(W.partitionBy("lead", "own"))
    led = cut(led.withColumn("first", first).filter("own or seed = first").select("lead", *targets.columns), "alike")
    seeds = led.select("lead", F.col("seed").alias("of"))
    moved = frontier.withColumnRenamed("seed", "lead").join(seeds, "lead").withColumnRenamed("of", "seed").select(frontier.columns)
    return led.drop("lead"), cut(moved, "frontier")


def impact_many(g: GraphTables, targets: DataFrame, depth: int = 4, limit: int = 100, frontier: DataFrame | None = None) -> DataFrame:
    """seed, the caller's record, depth, pagerank, criticality and its breakdown, by criticality.  `frontier`: that of the targets, if it is known."""
    frontier = cut(impact_frontier(g, targets, depth), "frontier") if frontier is None else frontier
    nodes = frontier.select("seed", "id", "name", "qualified_name", "depth", F.lit(False).alias("target"))
    goal = targets.select("seed", "id", "name", "qualified_name", F.lit(0).alias("depth"), F.lit(True).alias("target"))
    nodes = nodes.unionByName(goal).groupBy("seed", "id").agg(F.first("name").alias("name"), F.first("qualified_name").alias("qualified_name"), F.max("depth").alias("depth"), F.max("target").alias("target"))
    nodes = nodes.join(frontier.select(F.col("seed").alias("seed")).distinct(), "seed", "left_semi")
    # seeds of like size share a block, so that one with few nodes costs no call of its own
    size = F.pow(F.lit(2), F.ceil(F.log2(F.count(F.lit(1)).over(W.partitionBy("seed")))))
    nodes = cut(nodes.withColumn("per", F.greatest(F.lit(1), F.lit(BLOCK) / size).cast("long")).withColumn("block", F.floor(F.col("seed") / F.col("per"))), "nodes")
    keys = nodes.select("per", "block", "seed", F.explode(F.array_distinct(F.array("name", "qualified_name"))).alias("to_symbol_name"), F.col("id").alias("callee"))
    walk = g.edges.select("from_symbol_id", "to_symbol_name").join(keys, "to_symbol_name").select("per", "block", "seed", "callee", F.col("from_symbol_id").alias("caller"))
    inside = nodes.select(F.col("seed").alias("seed"), F.col("id").alias("caller"))
    walk = walk.join(inside, ["seed", "caller"], "left_semi").filter("caller != callee").select(*[F.col(c).alias(c) for c in ("per", "block", "seed")], "callee", "caller")
    ranks = nodes.select("per", "block", "seed", "id", "depth", "target").groupBy("per", "block").cogroup(walk.groupBy("per", "block")).applyInPandas(_rank, "seed long, id long, pagerank double")
    most = F.max("pagerank").over(W.partitionBy("seed"))
    share = F.when(F.col("most") > 0, F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100 * F.col("pagerank") / F.col("most")))).otherwise(0.0)
    ranked = frontier.join(ranks, ["seed", "id"]).withColumn("most", most).withColumn("criticality", share)
    order = W.partitionBy("seed").orderBy(F.desc(F.round("criticality", 6)), "depth", "path", "start_line", "id")
    top = ranked.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
    outs = fanout(g).select(F.col("from_symbol_id").alias("id"), F.col("fanout").alias("fanout_out"))
    ins = fanin(g).select(F.col("to_symbol_name").alias("name"), F.col("fanin").alias("fanout_in"))
    decorated = top.join(outs, "id", "left").join(ins, "name", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return decorated.select(
        "seed", *SYMBOL_COLUMNS, "depth", "place", "criticality", "pagerank", zero("fanout_in"), zero("fanout_out"),
        F.when(is_test_path("path"), 1).otherwise(0).alias("test_coverage"), (1 / F.col("depth")).alias("depth_decay"),
    )


def impact(g: GraphTables, symbol: str, depth: int = 4) -> DataFrame:
    """Ranked callers that a change of `symbol` reaches."""
    one = resolve_top1(g, symbol)
    return impact_many(g, cut(one.select(F.lit(0).cast("long").alias("seed"), F.lit(symbol).alias("query"), *SYMBOL_COLUMNS), "target"), depth).drop("seed").orderBy("place")


def connect_levels(g: GraphTables, start: str, goal: str, depth: int = 8) -> tuple[DataFrame | None, list[tuple[int, int, int | None]]]:
    """Forward breadth-first search over best callees; returns the target's path as (level, id, parent), or nothing.

    Ties go to the earlier parent in the queue, then the earlier call site.
    """
    depth = min(max(depth, 1), 12)
    records = g.symbol_records
    starts = records.filter(match.exact(start)).orderBy(*match.exact_order(start)).limit(25)
    goals = records.filter(match.exact(goal)).orderBy(*match.exact_order(goal)).limit(50)
    first = [(r.id, i) for i, r in enumerate(starts.select("id").collect())]
    wanted = {r.id for r in goals.select("id").collect()}
    if not first or not wanted:
        return None, []
    for i, _ in first:
        if i in wanted:
            return records, [(0, i, None)]
    spark = records.sparkSession
    visited = cut(spark.createDataFrame([(i, None, o, 0) for i, o in first], "id long, parent long, place long, level int"), "visited")
    frontier = visited
    for level in range(1, depth + 1):
        calls = g.edges.join(frontier.select(F.col("id").alias("from_symbol_id"), F.col("place").alias("queue")), "from_symbol_id")
        order = W.partitionBy("from_symbol_id").orderBy("edge_id")
        callees = match.resolve_callees(records, calls).withColumn("_n", F.row_number().over(order)).filter(f"_n <= {PER_NODE} and callee_id != from_symbol_id")
        queued = callees.join(frontier.select(F.col("id").alias("from_symbol_id"), F.col("place").alias("queue")), "from_symbol_id")
        new = queued.groupBy(F.col("callee_id").alias("id")).agg(F.min(F.struct("queue", "edge_id", F.col("from_symbol_id").alias("parent"))).alias("best"))
        new = new.join(visited.select("id"), "id", "left_anti")
        rank = F.row_number().over(W.orderBy("best"))  # one level of the search, VISITED rows at most: the cut comes first
        frontier = cut(new.orderBy("best").limit(VISITED).withColumn("place", rank.cast("long")).select("id", F.col("best.parent").alias("parent"), "place", F.lit(level).alias("level")), "level")
        visited = visited.unionByName(frontier)
        hit = frontier.filter(F.col("id").isin(list(wanted))).orderBy("place").limit(1).collect()
        if hit:
            path, at, parent = [(level, hit[0].id, hit[0].parent)], level - 1, hit[0].parent
            while parent is not None:
                r = visited.filter((F.col("id") == parent) & (F.col("level") == at)).first()
                path.append((at, r.id, r.parent))
                parent, at = r.parent, at - 1
            return records, path[::-1]
        if frontier.isEmpty() or visited.count() >= VISITED:
            break
    return None, []


def connect(g: GraphTables, start: str, goal: str, depth: int = 8) -> DataFrame:
    """The shortest chain of calls from `start` to `goal`: step and record; no row if there is none."""
    records, path = connect_levels(g, start, goal, depth)
    spark = g.symbols.sparkSession
    steps = spark.createDataFrame([(level, i) for level, i, _ in path], "step int, id long")
    return g.symbol_records.join(F.broadcast(steps), "id").select("step", *SYMBOL_COLUMNS).orderBy("step")  # 13 rows at most


def export_all(g: GraphTables, limit: int = 800, collapse_tests: bool = False, exported_only: bool = False) -> DataFrame:
    """Edges of the whole graph by qualified names.  The limit applies before the filters; `truncated` tells if more than `limit` came."""
    ends = g.symbol_records.select(F.col("id"), "qualified_name", "kind", "path", "language", "exported")
    sources = ends.select([F.col(c).alias(f"from_{c}") for c in ends.columns])
    targets = ends.select([F.col(c).alias(f"to_{c}") for c in ends.columns])
    keys = g.symbol_keys.select(F.col("key").alias("to_symbol_name"), F.col("id").alias("to_id"))
    calls = g.edges.select(F.col("from_symbol_id").alias("from_id"), "to_symbol_name").distinct()
    joined = calls.join(keys, "to_symbol_name").filter("from_id != to_id").select("from_id", "to_id").distinct().join(sources, "from_id").join(targets, "to_id")
    cut_off = joined.orderBy("from_qualified_name", "to_qualified_name", "from_id", "to_id").limit(limit + 1)
    return _filtered(cut_off, collapse_tests, exported_only)


def _filtered(edges: DataFrame, collapse_tests: bool, exported_only: bool) -> DataFrame:
    if collapse_tests:
        edges = edges.filter(~is_test_path("from_path") & ~is_test_path("to_path"))
    if exported_only:
        edges = edges.filter("from_exported and to_exported")
    return edges


def export_from(g: GraphTables, symbol: str, depth: int = 3, limit: int = 800, collapse_tests: bool = False, exported_only: bool = False) -> DataFrame:
    """Edges reached from a symbol over best callees; a callee is followed only if its edge is kept."""
    depth = min(max(depth, 1), 12)
    records = g.symbol_records
    starts = records.filter(match.exact(symbol)).orderBy(*match.exact_order(symbol)).limit(25).select("id")
    seen = frontier = cut(starts, "starts")
    found = None
    for _ in range(depth):
        calls = g.edges.join(frontier.select(F.col("id").alias("from_symbol_id")), "from_symbol_id", "left_semi")
        callees = match.resolve_callees(records, calls).filter("callee_id != from_symbol_id")
        sources = records.select([F.col(c).alias(f"from_{c}") for c in records.columns])
        edges = callees.withColumnRenamed("from_symbol_id", "from_id").join(sources, "from_id").select("edge_id", *[f"from_{c}" for c in ("id", "qualified_name", "kind", "path", "language", "exported")], *[F.col(f"callee_{c}").alias(f"to_{c}") for c in ("id", "qualified_name", "kind", "path", "language", "exported")])
        edges = cut(_filtered(edges, collapse_tests, exported_only), "edges")
        found = edges if found is None else found.unionByName(edges)
        frontier = edges.select(F.col("to_id").alias("id")).distinct().join(seen, "id", "left_anti")
        seen = seen.union(frontier)
        if frontier.isEmpty():
            break
    return found.orderBy("edge_id").limit(limit).drop("edge_id")
