"""A code graph derived from the driver's star-schema tables, in SQL that Spark and DuckDB share.

Only the numbering of references differs: SQL says it with one global window;
Spark numbers within ranges of the leading sort key and adds the ranges' offsets,
which gives the same numbers without sorting everything in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.model import GraphTables

FILES = """
SELECT s_suppkey AS id,
  concat(CASE WHEN s_suppkey % 7 = 0 THEN 'src/tests/' ELSE 'src/' END, lower(n.n_name), '/', lower(replace(s.s_name, '#', '_')),
         CASE s_suppkey % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' WHEN 2 THEN '.go' ELSE '.java' END) AS path,
  CASE s_suppkey % 4 WHEN 0 THEN 'typescript' WHEN 1 THEN 'python' WHEN 2 THEN 'go' ELSE 'java' END AS language,
  CAST(100 + s_suppkey % 900 AS INT) AS loc
FROM {supplier} s JOIN {nation} n ON n.n_nationkey = s.s_nationkey
"""

SYMBOLS = """
SELECT id, name, qualified_name, kind, file_id, start_line, end_line, concat(kind, ' ', name) AS signature, exported FROM (
  SELECT p.p_partkey AS id,
    concat(replace(p.p_name, ' ', '_'), '_', CAST(p.p_partkey % c.m AS STRING)) AS name,
    concat(replace(p.p_brand, '#', '_'), '.', replace(p.p_name, ' ', '_'), '_', CAST(p.p_partkey % c.m AS STRING)) AS qualified_name,
    CASE p.p_size % 5 WHEN 0 THEN 'class' WHEN 1 THEN 'method' WHEN 2 THEN 'struct' ELSE 'function' END AS kind,
    p.p_partkey % c.n AS file_id,
    CAST(1 + (p.p_partkey - p.p_partkey % c.n) / c.n * 10 AS INT) AS start_line,
    CAST(1 + (p.p_partkey - p.p_partkey % c.n) / c.n * 10 + p.p_size AS INT) AS end_line,
    p.p_size % 2 = 0 AS exported
  FROM {part} p CROSS JOIN (SELECT (SELECT count(*) FROM {supplier}) AS n, (SELECT CAST(count(*) / 50 AS BIGINT) FROM {part}) AS m) c
) x
"""

ORDER = ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]

RAW_REFS = """
SELECT {order}, t.name AS symbol_name,
  CASE WHEN l.l_linestatus = 'O' AND l.l_quantity > 48 THEN NULL ELSE l.l_partkey END AS from_symbol_id,
  s.file_id AS file_id, CAST(s.start_line + l.l_linenumber AS INT) AS line, CAST(1 + l.l_quantity AS INT) AS "column",
  concat('call ', t.name) AS context, CASE WHEN l.l_suppkey % 10 = 0 THEN 'new' ELSE 'call' END AS kind
FROM {lineitem} l JOIN {symbols} s ON s.id = l.l_partkey
CROSS JOIN (SELECT count(*) AS n FROM {part}) c
JOIN {symbols} t ON t.id = (l.l_orderkey * 31 + l.l_suppkey * 7) % c.n
WHERE l.l_returnflag = 'R' AND l.l_linenumber = 1
"""

IMPORTS_DUCKDB = """
SELECT page_id * 1000 + line AS id, page_id % (SELECT count(*) FROM supplier) AS file_id, source, CAST(line AS INT) AS line, 'import' AS kind FROM (
  SELECT page_id, unnest(h) AS source, unnest(range(1, len(h) + 1)) AS line FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h FROM pages)
)
"""


def ctes() -> str:
    """The view as leading CTEs of a DuckDB statement."""
    own = {k: k for k in ("supplier", "nation", "part", "lineitem", "symbols")}
    columns = ", ".join(f"l.{c}" for c in ORDER)
    return f"""WITH RECURSIVE files AS ({FILES.format(**own)}), symbols AS ({SYMBOLS.format(**own)}),
refs AS (SELECT row_number() OVER (ORDER BY {", ".join(ORDER)}) AS id, symbol_name, from_symbol_id, file_id, line, "column", context, kind FROM ({RAW_REFS.format(order=columns, **own)})),
edges AS (SELECT id, from_symbol_id, symbol_name AS to_symbol_name FROM refs WHERE from_symbol_id IS NOT NULL),
imports AS ({IMPORTS_DUCKDB}),
srec AS (SELECT s.id, s.name, s.qualified_name, s.kind, s.file_id, f.path, f.language, s.start_line, s.end_line, s.signature, s.exported FROM symbols s JOIN files f ON f.id = s.file_id),
rrec AS (SELECT r.id, r.symbol_name, r.from_symbol_id, q.qualified_name AS from_symbol, f.path, r.line, r."column", r.context, r.kind FROM refs r JOIN files f ON f.id = r.file_id LEFT JOIN symbols q ON q.id = r.from_symbol_id),
keys AS (SELECT name AS key, id FROM symbols UNION SELECT qualified_name, id FROM symbols)
"""


def global_row_number(df: DataFrame, order: list[str], width: int = 4096) -> DataFrame:
    """`id`: the row's place in the order, from 1.  The first order column is a whole number."""
    bucketed = df.withColumn("_bucket", F.floor(F.col(order[0]) / width))
    sizes = bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))  # a row per range of keys
    before = F.coalesce(F.sum("_n").over(W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = bucketed.withColumn("_i", F.row_number().over(W.partitionBy("_bucket").orderBy(*order)))
    return placed.join(sizes.select("_bucket", before.alias("_before")), "_bucket").withColumn("id", F.col("_before") + F.col("_i")).drop("_bucket", "_before", "_i")


_known: dict[tuple[int, str], GraphTables] = {}


def graph(spark: SparkSession, sf_dir: str) -> GraphTables:
    """The view over one directory; tables are cached, since every query starts from them."""
    key = (id(spark), sf_dir)
    if key in _known and not spark.sparkContext._jsc.sc().isStopped():
        return _known[key]
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    base = {n: read(n) for n in ("supplier", "nation", "part", "lineitem", "pages")}
    files = spark.sql(FILES, supplier=base["supplier"], nation=base["nation"]).selectExpr("id", "path", "language", "cast(null as string) as sha256", "loc", "cast(null as timestamp) as indexed_at")
    symbols = spark.sql(SYMBOLS, part=base["part"], supplier=base["supplier"]).cache()
    raw = spark.sql(RAW_REFS.replace('"column"', "`column`").replace("{order}", ", ".join(f"l.{c}" for c in ORDER)), lineitem=base["lineitem"], symbols=symbols, part=base["part"])
    refs = global_row_number(raw, ORDER).select("id", "symbol_name", "from_symbol_id", "file_id", "line", "column", "context", "kind").cache()
    edges = refs.filter("from_symbol_id is not null").selectExpr("id", "from_symbol_id", "symbol_name as to_symbol_name", "kind", "1.0D as weight")
    n = base["supplier"].count()
    hrefs = base["pages"].select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("pos", "source"))
    imports = hrefs.select((F.col("page_id") * 1000 + F.col("pos") + 1).alias("id"), (F.col("page_id") % n).alias("file_id"), "source", (F.col("pos") + 1).alias("line"), F.lit("import").alias("kind"))
    _known.clear()
    _known[key] = GraphTables(files.cache(), symbols, refs, edges, imports)
    return _known[key]
