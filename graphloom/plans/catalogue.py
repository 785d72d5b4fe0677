"""The catalogue of queries over the driver's tables, each with DuckDB SQL that says the same.

Probes: the most-called name, found by the same rule on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import functions as fn
from graphloom import match, render
from graphloom.functions.bloom import Bloom, build_bloom
from graphloom.model import REFERENCE_COLUMNS, SYMBOL_COLUMNS, GraphTables
from graphloom.operators import graph as walks
from graphloom.operators import lookups as look
from graphloom.operators.compose import diff_impact_frames, plan_query_many
from graphloom.plans.driver_view import ctes, graph
from graphloom.sources.extract import extract

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}

SYM = ", ".join(SYMBOL_COLUMNS)
REF = ", ".join(f'"{c}"' for c in REFERENCE_COLUMNS)
PROBE = "probe AS (SELECT to_symbol_name AS s FROM edges GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
M1 = "(qualified_name = s OR name = s OR lower(qualified_name) LIKE '%.' || lower(s))"
RANK = "CASE WHEN qualified_name = s THEN 0 WHEN name = s THEN 1 ELSE 2 END"
M1_ORDER = f"{RANK}, length(qualified_name), path, start_line, id"
IS_TEST = "(lower(path) LIKE '%/test/%' OR lower(path) LIKE '%/tests/%' OR contains(lower(path), '/__tests__/') OR contains(lower(path), '.test.') OR contains(lower(path), '.spec.') OR ends_with(lower(path), '_test.go') OR starts_with(lower(path), 'test_') OR contains(lower(path), '/test_'))"
CONTAINERS = ", ".join(f"'{k}'" for k in look.CONTAINERS)


class View:
    """The derived graph, and the driver's own tables beside it."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.graph = spark, sf_dir, graph(spark, sf_dir)

    def __getattr__(self, name: str):
        if name in ("orders", "documents"):
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return getattr(self.graph, name)


def query(sql: str | None = None, name: str | None = None):
    def add(f: Callable[[GraphTables], DataFrame]) -> Callable:
        key = name or f.__name__
        _queries[key] = lambda spark, sf_dir: f(View(spark, sf_dir))
        if sql:
            _oracles[key] = sql if sql.lstrip().startswith("--raw") else with_view(sql)
        return f

    return add


def with_view(sql: str) -> str:
    """`sql` may begin with further CTEs, each ended by a comma line, marked by a leading '& '."""
    if sql.lstrip().startswith("&"):
        return ctes() + ", " + sql.lstrip()[1:]
    return ctes() + sql


def probe(g: GraphTables) -> str:
    return g.edges.groupBy("to_symbol_name").count().orderBy(F.desc("count"), "to_symbol_name").first()[0]


@query(f"&{PROBE} SELECT {SYM} FROM srec, probe WHERE {M1} ORDER BY {M1_ORDER} LIMIT 25")
def definition(g):
    return look.definition(g, probe(g))


@query(f"&probe AS (SELECT upper(to_symbol_name) AS s FROM edges GROUP BY to_symbol_name ORDER BY count(*) DESC, to_symbol_name LIMIT 1) SELECT {SYM} FROM srec, probe WHERE {M1} ORDER BY {M1_ORDER} LIMIT 25")
def definition_suffix(g):
    return look.definition(g, probe(g).upper())


@query(f"&{PROBE} SELECT {SYM} FROM srec, probe WHERE {M1} ORDER BY {M1_ORDER} LIMIT 1")
def resolve_top1(g):
    return look.resolve_top1(g, probe(g))


@query(f"&names AS (SELECT DISTINCT symbol_name AS s FROM refs WHERE from_symbol_id IS NULL), r AS (SELECT s AS symbol, {SYM}, {RANK} AS rank, row_number() OVER (PARTITION BY s ORDER BY {M1_ORDER}) AS place FROM srec JOIN names ON {M1}) SELECT symbol, {SYM}, rank, place FROM r WHERE place <= 25")
def definitions_batch(g):
    return look.definitions(g, g.refs.filter("from_symbol_id is null").select(F.col("symbol_name").alias("symbol")))


@query(f"&{PROBE} SELECT {REF} FROM rrec, probe WHERE symbol_name = s OR lower(symbol_name) LIKE '%.' || lower(s) ORDER BY path, line, id LIMIT 250")
def references(g):
    return look.references(g, probe(g))


@query("&names AS (SELECT DISTINCT name AS symbol FROM symbols) SELECT symbol, count(*) AS refs, count(DISTINCT from_symbol_id) AS callers, min(path) AS first_path FROM rrec JOIN names ON symbol_name = symbol GROUP BY symbol")
def references_batch(g):
    return look.references_batch(g, g.symbols.select(F.col("name").alias("symbol")))


@query(f"SELECT {REF} FROM rrec WHERE from_symbol_id = (SELECT from_symbol_id FROM edges GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) ORDER BY line, id LIMIT 100")
def references_from(g):
    top = g.edges.groupBy("from_symbol_id").count().orderBy(F.desc("count"), "from_symbol_id").first()[0]
    return look.references_from(g, top)


@query(f"SELECT {SYM} FROM srec WHERE lower(path) LIKE 'src/nation_1%' ORDER BY path, start_line, id LIMIT 1000")
def outline(g):
    return look.outline(g, "src/nation_1")


@query("SELECT i.source, f.path AS from_path, i.line, i.kind FROM imports i JOIN files f ON f.id = i.file_id WHERE lower(f.path) LIKE 'src/nation_1%' ORDER BY f.path, i.line, i.id LIMIT 500")
def imports(g):
    return look.imports_of(g, "src/nation_1**")


@query("SELECT i.source, f.path AS from_path, i.line, i.kind FROM imports i JOIN files f ON f.id = i.file_id WHERE lower(i.source) LIKE '%/de%' ORDER BY f.path, i.line, i.id LIMIT 500")
def imported_by(g):
    return look.imported_by(g, "/de")


@query(f"SELECT t.id AS container_id, {', '.join('s.' + c for c in SYMBOL_COLUMNS)} FROM srec s JOIN srec t ON t.file_id = s.file_id AND s.start_line > t.start_line AND s.end_line <= t.end_line AND s.id <> t.id WHERE t.kind IN ({CONTAINERS})")
def signature_members(g):
    return look.members(g)


@query(f"&{PROBE} SELECT e2.to_symbol_name, count(DISTINCT e1.from_symbol_id) AS shared_callers FROM edges e1 JOIN edges e2 USING (from_symbol_id), probe WHERE (e1.to_symbol_name = s OR lower(e1.to_symbol_name) LIKE '%.' || lower(s)) AND e2.to_symbol_name <> s GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def siblings(g):
    return look.siblings_raw(g, probe(g))


@query(f"""&{PROBE}, raw AS (SELECT e2.to_symbol_name AS t, count(DISTINCT e1.from_symbol_id) AS shared_callers FROM edges e1 JOIN edges e2 USING (from_symbol_id), probe WHERE (e1.to_symbol_name = s OR lower(e1.to_symbol_name) LIKE '%.' || lower(s)) AND e2.to_symbol_name <> s GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50),
best AS (SELECT s, qualified_name AS q, path, start_line AS line, row_number() OVER (PARTITION BY s ORDER BY {M1_ORDER}) AS n FROM srec JOIN (SELECT t AS s FROM raw) ON {M1})
SELECT coalesce(q, t) AS qualified_name, shared_callers, path, line, t AS to_symbol_name FROM raw LEFT JOIN best ON s = t AND n = 1""")
def siblings_resolved(g):
    return look.siblings(g, probe(g))


@query(f"SELECT {SYM}, CAST(0 AS BIGINT) AS inbound_refs, CAST(0 AS BIGINT) AS inbound_edges FROM srec s WHERE NOT {IS_TEST} AND NOT EXISTS (SELECT 1 FROM refs r WHERE r.symbol_name = s.name OR r.symbol_name = s.qualified_name) ORDER BY qualified_name, id LIMIT 500")
def unused(g):
    return look.unused(g, look.Filters(limit=500))


@query("SELECT 'files' AS table_name, count(*) AS n FROM files UNION ALL SELECT 'symbols', count(*) FROM symbols UNION ALL SELECT 'refs', count(*) FROM refs UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'imports', count(*) FROM imports")
def stats_counts(g):
    return look.stats_counts(g)


@query("SELECT language, count(*) AS n FROM files GROUP BY 1 ORDER BY 2 DESC, 1")
def stats_language(g):
    return look.stats_language(g)


@query("SELECT kind, count(*) AS n FROM symbols GROUP BY 1 ORDER BY 2 DESC, 1")
def stats_kind(g):
    return look.stats_kind(g)


@query("SELECT qualified_name, count(DISTINCT from_symbol_id) AS callers FROM edges JOIN symbols ON name = to_symbol_name OR qualified_name = to_symbol_name GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_fanout(g):
    return look.top_fanout(g)


@query("SELECT s.name, CAST(count(*) AS BIGINT) AS calls FROM edges e JOIN symbols s ON s.name = e.to_symbol_name OR s.qualified_name = e.to_symbol_name WHERE s.kind IN ('function', 'method') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def most_called(g):
    return look.most_called(g)


@query("SELECT to_symbol_name, count(DISTINCT from_symbol_id) AS fanin FROM edges GROUP BY 1")
def fanin(g):
    return look.fanin(g)


@query("SELECT from_symbol_id, count(DISTINCT to_symbol_name) AS fanout FROM edges GROUP BY 1")
def fanout(g):
    return look.fanout(g)


@query("SELECT s.id, CAST((SELECT count(*) FROM refs r WHERE r.symbol_name = s.name OR r.symbol_name = s.qualified_name) AS BIGINT) AS inbound_refs, CAST((SELECT count(*) FROM edges e WHERE e.to_symbol_name = s.name OR e.to_symbol_name = s.qualified_name) AS BIGINT) AS inbound_edges FROM symbols s".replace(
    "(SELECT count(*) FROM refs r WHERE r.symbol_name = s.name OR r.symbol_name = s.qualified_name)", "coalesce((SELECT sum(c) FROM (SELECT symbol_name AS k, count(*) AS c FROM refs GROUP BY 1) x WHERE x.k IN (s.name, s.qualified_name)), 0)").replace(
    "(SELECT count(*) FROM edges e WHERE e.to_symbol_name = s.name OR e.to_symbol_name = s.qualified_name)", "coalesce((SELECT sum(c) FROM (SELECT to_symbol_name AS k, count(*) AS c FROM edges GROUP BY 1) x WHERE x.k IN (s.name, s.qualified_name)), 0)"))
def inbound_counts(g):
    return look.inbound_counts(g)


@query(f"SELECT {SYM} FROM srec WHERE lower(name) LIKE '%red%' OR lower(qualified_name) LIKE '%red%' ORDER BY length(qualified_name), qualified_name, id LIMIT 200")
def search_glob(g):
    return look.search_glob(g, "*red*", 200)


@query(f"SELECT {SYM} FROM srec ORDER BY qualified_name, id LIMIT 200")
def search_list(g):
    return look.search_list(g, 200)


def _fuzzy_sql(s: str, limit: int, columns: str) -> str:
    return f"""&{s}, cand AS (SELECT srec.*, s FROM srec, probe WHERE contains(lower(name), lower(s)) OR contains(lower(qualified_name), lower(s)) ORDER BY id LIMIT {limit * 4}),
pool AS (SELECT * FROM cand UNION ALL (SELECT srec.*, s FROM srec, probe WHERE (SELECT count(*) FROM cand) = 0 ORDER BY qualified_name, id LIMIT 5000)),
scored AS (SELECT *, greatest(jaro_winkler_similarity(qualified_name, s), jaro_winkler_similarity(name, s)) AS similarity FROM pool)
SELECT {columns} FROM scored WHERE similarity >= 0.6 ORDER BY similarity DESC, qualified_name, id LIMIT {limit}"""


@query(_fuzzy_sql(PROBE, 20, f"{SYM}, round(similarity, 6) AS similarity"))
def search_fuzzy(g):
    return look.fuzzy(g, probe(g), 20).withColumn("similarity", F.round("similarity", 6))


@query(_fuzzy_sql("probe AS (SELECT to_symbol_name || 'd' AS s FROM edges GROUP BY to_symbol_name ORDER BY count(*) DESC, to_symbol_name LIMIT 1)", 5, "qualified_name, name, path, start_line AS line, round(similarity, 6) AS confidence"))
def validate_suggest(g):
    return look.suggestions(g, probe(g) + "d").withColumn("confidence", F.round("confidence", 6))


@query("SELECT id, CASE WHEN lower(name) = 'old' THEN 1.0 WHEN contains(lower(name), 'old') THEN 0.85 ELSE 0.5 END::DOUBLE AS score FROM symbols")
def glob_score(g):
    return g.symbols.select("id", fn.glob_score(F.col("name"), "*old*").cast("double").alias("score"))


@query("&asked AS (SELECT DISTINCT CASE WHEN id % 3 = 0 THEN symbol_name || 'x' ELSE symbol_name END AS symbol FROM refs) SELECT symbol, symbol IN (SELECT key FROM keys) AS exists FROM asked")
def validate_exists(g):
    names = g.refs.select(F.when(F.col("id") % 3 == 0, F.concat("symbol_name", F.lit("x"))).otherwise(F.col("symbol_name")).alias("symbol"))
    return look.exists_many(g, names)


BFS = """&{probe}, target AS (SELECT srec.* FROM srec, probe WHERE {m1} ORDER BY {order} LIMIT 1),
start AS (SELECT s AS name FROM probe UNION SELECT name FROM target UNION SELECT qualified_name FROM target),
bfs(id, depth) AS (
  SELECT DISTINCT e.from_symbol_id, 1 FROM edges e JOIN start ON e.to_symbol_name = start.name
  UNION
  SELECT e.from_symbol_id, b.depth + 1 FROM bfs b JOIN symbols s ON s.id = b.id JOIN edges e ON e.to_symbol_name IN (s.name, s.qualified_name) WHERE b.depth < {depth}
), least_ AS (SELECT id, min(depth) AS depth FROM bfs GROUP BY id)"""
START_PROBE_ONLY = BFS.replace("UNION SELECT name FROM target UNION SELECT qualified_name FROM target", "")
_bfs = lambda depth, base=BFS: base.format(probe=PROBE, m1=M1, order=M1_ORDER, depth=depth)


@query(_bfs(3, START_PROBE_ONLY) + " SELECT id, CAST(depth AS INT) AS depth FROM least_")
def transitive_callers(g):
    return walks.transitive_callers(g, probe(g), 3)


@query(_bfs(4) + f", f AS (SELECT {', '.join('srec.' + c for c in SYMBOL_COLUMNS)}, CAST(depth AS INT) AS depth, row_number() OVER (ORDER BY depth, path, start_line, srec.id) AS n FROM least_ JOIN srec USING (id)) SELECT * EXCLUDE (n) FROM f WHERE n <= 800")
def impact_frontier(g):
    targets = walks.impact_targets(g, _names(g))
    return walks.impact_frontier(g, targets, 4).select(*SYMBOL_COLUMNS, "depth")


def _names(g: GraphTables) -> DataFrame:
    return g.symbols.sparkSession.createDataFrame([(0, probe(g))], "seed long, query string")


def _ppr_sql() -> str:
    sql = _bfs(4) + """, node AS (SELECT id, depth, false AS goal FROM least_ WHERE id NOT IN (SELECT id FROM target) UNION ALL SELECT id, 0, true FROM target),
pairs AS (SELECT DISTINCT k.id AS u, e.id AS e, e.from_symbol_id AS v FROM keys k JOIN node ON node.id = k.id JOIN edges e ON e.to_symbol_name = k.key JOIN node w ON w.id = e.from_symbol_id WHERE k.id <> e.from_symbol_id),
outdeg AS (SELECT u, count(*) AS d FROM pairs GROUP BY u),
p0 AS (SELECT id, CASE WHEN goal THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS t, CASE WHEN goal THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS r, coalesce(d, 0) AS d FROM node LEFT JOIN outdeg ON u = id)"""
    for i in range(walks.ROUNDS):
        sql += f""", q{i} AS MATERIALIZED (SELECT a.id, a.t, a.d, {1 - walks.DAMPING!r}::DOUBLE * a.t + {walks.DAMPING}::DOUBLE * (coalesce(f.x, 0) + (SELECT coalesce(sum(r), 0) FROM p{i} WHERE d = 0) * a.t) AS r
FROM p{i} a LEFT JOIN (SELECT v, sum(p.r / p.d) AS x FROM pairs JOIN p{i} p ON p.id = pairs.u GROUP BY v) f ON f.v = a.id),
p{i + 1} AS MATERIALIZED (SELECT id, t, d, r / (SELECT sum(r) FROM q{i}) AS r FROM q{i})"""
    n = walks.ROUNDS
    return sql + f""", crit AS (SELECT l.id, l.depth, p.r AS pagerank, 100 * p.r / max(p.r) OVER () AS criticality FROM least_ l JOIN p{n} p ON p.id = l.id),
best AS (SELECT srec.id, qualified_name, path, depth, pagerank, criticality, exported, row_number() OVER (ORDER BY round(criticality, 6) DESC, depth, path, start_line, srec.id) AS place, name FROM crit JOIN srec ON srec.id = crit.id)
SELECT id, qualified_name, path, CAST(depth AS INT) AS depth, CAST(place AS INT) AS place, round(pagerank, 6) AS pagerank, round(criticality, 4) AS criticality,
  CAST((SELECT count(DISTINCT from_symbol_id) FROM edges WHERE to_symbol_name = best.name) AS BIGINT) AS fanout_in, CAST((SELECT count(DISTINCT to_symbol_name) FROM edges WHERE from_symbol_id = best.id) AS BIGINT) AS fanout_out,
  CASE WHEN {IS_TEST} THEN 1 ELSE 0 END AS test_coverage, round(1.0::DOUBLE / depth, 6) AS depth_decay
FROM best WHERE place <= 100"""


@query(_ppr_sql())
def impact_ppr(g):
    found = walks.impact(g, probe(g), 4)
    return found.select("id", "qualified_name", "path", "depth", F.col("place").cast("int").alias("place"), F.round("pagerank", 6).alias("pagerank"), F.round("criticality", 4).alias("criticality"), "fanout_in", "fanout_out", "test_coverage", F.round("depth_decay", 6).alias("depth_decay"))


@query()
def impact_batch(g):
    """Impact of the 50 most-called functions at once."""
    names = look.most_called(g, 50).select(F.monotonically_increasing_id().alias("seed"), F.col("name").alias("query"))
    found = walks.impact_many(g, walks.cut(walks.impact_targets(g, walks.cut(names, "names")), "targets"), 3)
    return found.select("seed", "id", "qualified_name", "depth", F.round("criticality", 4).alias("criticality"), "place")


@query(_bfs(6, START_PROBE_ONLY).replace("WHERE b.depth < 6", f"JOIN files f ON f.id = s.file_id WHERE b.depth < 6 AND NOT {IS_TEST}") + f" SELECT {', '.join('srec.' + c for c in SYMBOL_COLUMNS)} FROM least_ JOIN srec USING (id) WHERE {IS_TEST}")
def tests_for(g):
    return walks.tests_for(g, probe(g))


CALLEES = """callee AS (SELECT e.from_symbol_id, e.to_symbol_name, min(e.id) AS edge_id FROM edges e GROUP BY 1, 2), best AS (
  SELECT c.from_symbol_id, c.to_symbol_name, c.edge_id, t.id AS callee_id, t.qualified_name AS callee_qualified_name,
    row_number() OVER (PARTITION BY c.from_symbol_id, c.to_symbol_name ORDER BY CASE WHEN t.file_id = s.file_id THEN 0 ELSE 1 END, CASE WHEN t.qualified_name = c.to_symbol_name THEN 0 ELSE 1 END, length(t.qualified_name), t.path, t.start_line, t.id) AS n
  FROM callee c JOIN srec s ON s.id = c.from_symbol_id JOIN keys k ON k.key = c.to_symbol_name JOIN srec t ON t.id = k.id)"""


@query(f"&{CALLEES} SELECT from_symbol_id, to_symbol_name, edge_id, callee_id, callee_qualified_name FROM best WHERE n = 1")
def callee_resolution(g):
    return match.resolve_callees(g.symbol_records, g.edges).select("from_symbol_id", "to_symbol_name", "edge_id", "callee_id", "callee_qualified_name")


def _ends(g: GraphTables) -> tuple[str, str]:
    """A caller two calls away from the probe, and the probe."""
    found = walks.transitive_callers(g, probe(g), 2).orderBy(F.desc("depth"), "id").first()
    return g.symbols.filter(F.col("id") == found[0]).first()["qualified_name"], probe(g)


@query(_bfs(2, START_PROBE_ONLY) + f""", {CALLEES}, ends AS (SELECT qualified_name AS a, (SELECT s FROM probe) AS b FROM symbols WHERE id = (SELECT id FROM least_ ORDER BY depth DESC, id LIMIT 1)),
fwd(id, depth) AS (SELECT id, 0 FROM symbols, ends WHERE qualified_name = a OR name = a UNION SELECT callee_id, depth + 1 FROM fwd JOIN best ON best.from_symbol_id = fwd.id AND n = 1 AND callee_id <> fwd.id WHERE depth < 8)
SELECT CAST(min(depth) AS INT) AS distance FROM fwd JOIN symbols s USING (id), ends WHERE s.name = b OR s.qualified_name = b""")
def connect_distance(g):
    return walks.connect(g, *_ends(g)).agg(F.max("step").alias("distance"))


@query()
def connect_path(g):
    return walks.connect(g, *_ends(g))


@query("SELECT s1.qualified_name AS from_qualified_name, s2.qualified_name AS to_qualified_name FROM (SELECT DISTINCT s1.id AS a, k.id AS b FROM edges e JOIN symbols s1 ON s1.id = e.from_symbol_id JOIN keys k ON k.key = e.to_symbol_name WHERE s1.id <> k.id) x JOIN srec s1 ON s1.id = a JOIN srec s2 ON s2.id = b ORDER BY 1, 2, s1.id, s2.id LIMIT 801")
def export_edges(g):
    return walks.export_all(g).select("from_qualified_name", "to_qualified_name")


@query("""&e AS (SELECT s1.path AS p1, s2.path AS p2, s1.qualified_name AS q1, s2.qualified_name AS q2 FROM (SELECT DISTINCT s1.id AS a, k.id AS b FROM edges e JOIN symbols s1 ON s1.id = e.from_symbol_id JOIN keys k ON k.key = e.to_symbol_name WHERE s1.id <> k.id) x JOIN srec s1 ON s1.id = a JOIN srec s2 ON s2.id = b ORDER BY s1.qualified_name, s2.qualified_name, s1.id, s2.id LIMIT 801),
n AS (SELECT p1 AS p, q1 AS q FROM e UNION SELECT p2, q2 FROM e)
SELECT CASE WHEN contains(p, '/') THEN regexp_extract(p, '^(.*)/[^/]*$', 1) ELSE '.' END AS directory, count(DISTINCT q) AS nodes FROM n GROUP BY 1""")
def export_groups(g):
    e = walks.export_all(g)
    nodes = e.select(F.col("from_path").alias("p"), F.col("from_qualified_name").alias("q")).union(e.select("to_path", "to_qualified_name"))
    return nodes.groupBy(fn.directory(F.col("p")).alias("directory")).agg(F.count_distinct("q").alias("nodes"))


@query()
def export_from(g):
    return walks.export_from(g, _ends(g)[0]).select("from_qualified_name", "to_qualified_name")


@query("""&hunks AS (SELECT f.path, CAST(1 + o_orderkey % 200 AS INT) AS new_start, CAST(o_orderkey % 30 AS INT) AS new_count FROM orders JOIN files f ON f.id = o_orderkey % (SELECT count(*) FROM supplier))
SELECT id, qualified_name, CAST(sum(new_count) AS BIGINT) AS added_lines, 0 AS removed_lines FROM srec JOIN hunks USING (path) WHERE start_line <= new_start + greatest(new_count, 1) - 1 AND end_line >= new_start GROUP BY 1, 2""")
def diff_overlap(g):
    return look.hunk_symbols(g, _hunks(g, g.orders)).select("id", "qualified_name", "added_lines", "removed_lines")


def _hunks(g: GraphTables, orders: DataFrame) -> DataFrame:
    n = g.files.count()
    orders = orders.select((F.col("o_orderkey") % n).alias("id"), (1 + F.col("o_orderkey") % 200).cast("int").alias("new_start"), (F.col("o_orderkey") % 30).cast("int").alias("new_count"))
    return orders.join(g.files.select("id", "path"), "id").select("path", "new_start", "new_count")


@query("SELECT e.id AS edge_id, e.from_symbol_id, s.id AS to_symbol_id FROM edges e JOIN symbols s ON s.qualified_name = e.to_symbol_name OR (s.name = e.to_symbol_name AND e.to_symbol_name NOT IN (SELECT qualified_name FROM symbols))")
def resolved_edges(g):
    return look.resolved_edges(g)


NEW = "scan AS (SELECT path, CASE WHEN id % 5 = 0 THEN 'new' ELSE 'old' END AS sha FROM files WHERE id % 11 <> 0 UNION ALL SELECT path || '.added', 'new' FROM files WHERE id % 13 = 0), stored AS (SELECT path, 'old' AS sha FROM files)"


def _scan(g: GraphTables) -> tuple[DataFrame, DataFrame]:
    kept = g.files.filter("id % 11 != 0").select("path", F.when(F.col("id") % 5 == 0, "new").otherwise("old").alias("sha256"))
    added = g.files.filter("id % 13 = 0").select(F.concat("path", F.lit(".added")), F.lit("new"))
    return kept.union(added), g.files.select("path", F.lit("old").alias("sha256"))


@query(f"&{NEW} SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'new' WHEN a.path IS NULL THEN 'removed' WHEN a.sha = b.sha THEN 'unchanged' ELSE 'changed' END AS state FROM scan a FULL OUTER JOIN stored b ON a.path = b.path")
def incremental_classify(g):
    from graphloom.index import classify

    return classify(*_scan(g)).select("path", "state")


@query(f"&{NEW} SELECT state, count(*) AS n FROM (SELECT CASE WHEN b.path IS NULL THEN 'new' WHEN a.path IS NULL THEN 'removed' WHEN a.sha = b.sha THEN 'unchanged' ELSE 'changed' END AS state FROM scan a FULL OUTER JOIN stored b ON a.path = b.path) GROUP BY 1")
def reconcile(g):
    from graphloom.index import classify

    return classify(*_scan(g)).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id, greatest(1, CAST(floor(octet_length(encode('{\"name\":\"' || name || '\",\"qualified_name\":\"' || qualified_name || '\"}')) / 4) AS BIGINT)) AS tokens FROM symbols")
def token_estimate(g):
    return g.symbols.select("id", fn.token_estimate(F.to_json(F.struct("name", "qualified_name"), {"ignoreNullFields": "false"})).alias("tokens"))


@query("SELECT id, sha256(path) AS sha FROM files")
def sha256(g):
    return g.files.select("id", F.sha2("path", 256).alias("sha"))


@query(f"SELECT id, {IS_TEST} AS is_test FROM files")
def is_test_path(g):
    return g.files.select("id", fn.is_test_path("path").alias("is_test"))


@query("SELECT id, CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '.' END AS directory FROM files")
def directory(g):
    return g.files.select("id", fn.directory(F.col("path")).alias("directory"))


@query("SELECT id, regexp_extract(qualified_name || '()', '([A-Za-z0-9_$]+)[^A-Za-z0-9_$]*$', 1) AS ident FROM symbols")
def last_identifier(g):
    return g.symbols.select("id", fn.last_identifier(F.concat("qualified_name", F.lit("()"))).alias("ident"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(t, 'edit|change|modify|refactor|fix') THEN 'prepare_edit' WHEN regexp_matches(t, 'review|pr|diff|changed|regression') THEN 'review_changes' WHEN regexp_matches(t, 'call path|connect|reach|flow') THEN 'trace_connection'
  WHEN regexp_matches(t, 'unused|dead|cleanup') THEN 'find_cleanup_targets' WHEN regexp_matches(t, 'where|definition|find|locate') THEN 'locate_symbol' ELSE 'understand_symbol' END AS intent FROM (SELECT doc_id, lower(text) AS t FROM documents)""")
def plan_query(g):
    return plan_query_many(g.documents.select("doc_id", F.col("text").alias("task"))).select("doc_id", "intent")


@query()
def diff_impacted(g):
    """Callers that the symbols of all hunks reach, with the first symbol that gives the best criticality."""
    return diff_impact_frames(g, walks.cut(_hunks(g, g.orders), "hunks"), 2)[1].select("id", "qualified_name", "via", F.round("criticality", 4).alias("criticality"))


#: A source text for each supplier, in the language of its file: a definition that calls the next one's.
GENERATED = {
    ".ts": "export function run_{i}(n) {{\n  return run_{j}(n);\n}}\n",
    ".py": "def run_{i}(n):\n    return run_{j}(n)\n",
    ".go": "package gen\n\nfunc run_{i}(n int) int {{\n\treturn run_{j}(n)\n}}\n",
    ".java": "public class C_{i} {{\n    private int run_{i}(int n) {{\n        return run_{j}(n);\n    }}\n}}\n",
}
GEN = """&gen AS (SELECT s_suppkey AS i, concat('gen/f', CAST(s_suppkey AS VARCHAR), CASE s_suppkey % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' WHEN 2 THEN '.go' ELSE '.java' END) AS path FROM supplier)"""


def _generated(g: GraphTables) -> DataFrame:
    texts = None
    for n, (extension, text) in enumerate(GENERATED.items()):
        pattern = text.replace("%", "%%").replace("{i}", "%1$d").replace("{j}", "%2$d").replace("{{", "{").replace("}}", "}")
        part = g.files.filter(F.col("id") % 4 == n).select(F.format_string("gen/f%d" + extension, "id").alias("path"), F.format_string(pattern, F.col("id"), F.col("id") + 1).alias("content"))
        texts = part if texts is None else texts.unionByName(part)
    return texts


@query(GEN + """ SELECT path, 'run_' || i AS name, CASE i % 4 WHEN 3 THEN 'C_' || i || '.run_' || i ELSE 'run_' || i END AS qualified_name, CASE i % 4 WHEN 3 THEN 'method' ELSE 'function' END AS kind,
  CASE i % 4 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 2 END AS start_line, CASE i % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 5 ELSE 4 END AS end_line, i % 4 < 2 AS exported FROM gen
UNION ALL SELECT path, 'C_' || i, 'C_' || i, 'class', 1, 5, true FROM gen WHERE i % 4 = 3""")
def extract_symbols(g):
    return extract(_generated(g)).filter("rec = 'symbol'").select("path", "name", "qualified_name", "kind", "start_line", "end_line", "exported")


@query(GEN + """ SELECT path, 'run_' || (i + 1) AS name, CASE i % 4 WHEN 3 THEN 'C_' || i || '.run_' || i ELSE 'run_' || i END AS from_qualified_name, CASE i % 4 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 3 END AS line,
  CASE i % 4 WHEN 0 THEN 10 WHEN 1 THEN 12 WHEN 2 THEN 9 ELSE 16 END AS "column", 'call' AS kind, 'return run_' || (i + 1) || '(n)' || CASE i % 4 WHEN 0 THEN ';' WHEN 3 THEN ';' ELSE '' END AS context FROM gen""")
def extract_references(g):
    return extract(_generated(g)).filter("rec = 'ref'").select("path", "name", "from_qualified_name", F.col("start_line").alias("line"), "column", "kind", "context")


@query("SELECT DISTINCT key, true AS hit FROM keys")
def bloom_membership(g):
    """Every known name is a hit: no false negatives."""
    data = build_bloom(g.symbols).to_bytes()  # 10 bits a name

    def probe_names(frames):
        bloom = Bloom.from_bytes(data)
        for frame in frames:
            yield frame.assign(hit=[k in bloom for k in frame["key"]])

    return g.symbol_keys.select("key").distinct().mapInPandas(probe_names, "key string, hit boolean")


@query()
def render_mermaid(g):
    """The diagram of the whole graph's first 800 edges, a row a line."""
    edges = [r.asDict() for r in walks.export_all(g).limit(800).collect()]
    lines = render.mermaid(edges, "directory").split("\n")
    return g.symbols.sparkSession.createDataFrame(list(enumerate(lines)), "n long, line string")


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)
