"""The catalogue's queries against their SQL, on the driver's smallest tables."""

import math
from pathlib import Path

import pytest

from graphloom.plans import catalogue
from graphloom.plans.driver_view import ORDER, global_row_number

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def db():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for file in DATA.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, db, name):
    got = catalogue.queries()[name](spark, str(DATA))
    want = db.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = sorted(tuple(plain(x) for x in r) for r in want.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == rows


def test_rows_only(spark):
    for name in set(catalogue.queries()) - set(catalogue.oracle_sql()):
        assert catalogue.queries()[name](spark, str(DATA)).columns, name


def test_diff_impacted_takes_all_hunks(spark, monkeypatch):
    """Every order is a hunk."""
    taken = []
    monkeypatch.setattr(catalogue, "diff_impact_frames", lambda g, hunks, depth: taken.append(hunks.count()) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        catalogue.queries()["diff_impacted"](spark, str(DATA))
    orders, files = spark.read.parquet(f"{DATA}/orders.parquet"), spark.read.parquet(f"{DATA}/supplier.parquet").count()
    paths = catalogue.queries()["directory"](spark, str(DATA)).select("id")
    assert taken == [orders.selectExpr(f"o_orderkey % {files} AS id").join(paths, "id").count()] and taken[0] > 20


def test_row_numbers(spark):
    rows = [((i * 7919) % 20_000, i % 3, 0, 0, 0, 0, 0) for i in range(3000)]
    numbered = global_row_number(spark.createDataFrame(rows, ORDER), ORDER, width=100).select("id", *ORDER).orderBy("id").collect()
    assert [tuple(r)[1:] for r in numbered] == sorted(rows) and [r.id for r in numbered] == list(range(1, 3001))


def test_no_nested_loop_joins(spark):
    """Joins on either of two names must stay equi-joins."""
    from graphloom.model import GraphTables
    from graphloom.operators import lookups
    from graphloom.schema import TABLES

    g = GraphTables(**{name: spark.createDataFrame([], schema) for name, schema in TABLES.items()})
    for df in (lookups.top_fanout(g), lookups.unused(g), lookups.inbound_counts(g), lookups.members(g), lookups.resolved_edges(g)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
