"""The name-matching predicates.  All matching lives here.

resolve  (M1): exact qualified name, else exact name, else dotted suffix; the
         suffix arm is LIKE: ASCII-case-insensitive, `_` and `%` of the name are
         wildcards.
callers  (M2): exact called name, or dotted suffix of it.
exact    (M3): qualified name or name, equality only.
callee   (M4): exact, same file first; one best symbol for each call.
any      (M5): exact, all symbols.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def like_pattern(text: str) -> str:
    """A LIKE pattern for Spark: its escape is the backslash, here an ordinary character."""
    return text.replace("\\", "\\\\").lower()


def suffix_like(column: Column | str, symbol: str) -> Column:
    return F.lower(F.col(column) if isinstance(column, str) else column).like("%." + like_pattern(symbol))


def resolves(symbol: str) -> Column:
    return (F.col("qualified_name") == symbol) | (F.col("name") == symbol) | suffix_like("qualified_name", symbol)


def resolve_rank(symbol: str) -> Column:
    return F.when(F.col("qualified_name") == symbol, 0).when(F.col("name") == symbol, 1).otherwise(2)


def resolve_order(symbol: str) -> list[Column]:
    return [resolve_rank(symbol), F.length("qualified_name"), F.col("path"), F.col("start_line"), F.col("id")]


def calls(symbol: str, column: str = "to_symbol_name") -> Column:
    return (F.col(column) == symbol) | suffix_like(column, symbol)


def exact(symbol: str) -> Column:
    return (F.col("qualified_name") == symbol) | (F.col("name") == symbol)


def exact_order(symbol: str) -> list[Column]:
    return [F.when(F.col("qualified_name") == symbol, 0).otherwise(1), F.length("qualified_name"), F.col("path"), F.col("start_line"), F.col("id")]


def _suffixes(name: str) -> Column:
    """All dotted suffixes of a name, lower-cased, without the name itself."""
    parts = F.split(F.lower(F.col(name)), r"\.")
    n = F.size(parts)
    return F.when(n > 1, F.transform(F.sequence(F.lit(2), n), lambda i: F.array_join(F.slice(parts, i, n), "."))).otherwise(F.array().cast("array<string>"))


def _known_run(text: Column) -> tuple[Column, Column]:
    """Of a LIKE pattern whose wildcard is `_`: where the first run of other characters starts (from 1), and the run."""
    run = F.regexp_extract(text, "[^_]+", 0)
    return F.length(F.regexp_extract(text, "^_*", 0)) + 1, run


def _known_at(shape: Column) -> Column:
    """Of a shape (a LIKE pattern with `x` for all that is not `_`): start (from 1) and length of each run of known characters."""
    runs = F.filter(F.split(F.regexp_replace(shape, "(?<=x)(?=_)|(?<=_)(?=x)", " "), " "), lambda r: r != "")
    first = F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<at:int,long:int>>").alias("runs"))

    def step(done: Column, run: Column) -> Column:
        known = F.array(F.struct(done["next"].alias("at"), F.length(run).alias("long")))
        return F.struct((done["next"] + F.length(run)).alias("next"), F.when(F.startswith(run, F.lit("x")), F.concat(done["runs"], known)).otherwise(done["runs"]).alias("runs"))

    return F.aggregate(runs, first, step, lambda done: done["runs"])


def _suffix_texts(tails: DataFrame, names: DataFrame) -> DataFrame:
    """`tails`: tail, distinct; `names`: symbol, without `%`.  Rows tail, symbol where the tail is LIKE the lower-case symbol, by equi-joins.

    Names with `_` are told apart by their shape, the places of their wildcards: under
    a shape, a tail matches the names whose other characters are the tail's at the
    same places.  A tail meets the shapes of its length whose first run of known
    characters it has, not the names, so the work grows with shapes, not with the
    square of the names that begin alike.
    """
    asked = names.withColumn("low", F.lower("symbol"))
    plain = tails.join(asked.filter(~F.col("low").contains("_")), F.col("tail") == F.col("low")).select("tail", "symbol")

    start, run = _known_run(F.col("low"))
    wild = asked.filter(F.col("low").contains("_")).select("symbol", F.length("low").alias("size"), start.alias("start"), run.alias("run"), F.regexp_replace("low", "[^_]", "x").alias("shape"), F.replace("low", F.lit("_"), F.lit("")).alias("known"))
    wild = wild.withColumn("long", F.length("run"))
    first = wild.select("size", "start", "long").distinct()  # few of each length: where runs start, and how long they are
    begun = tails.withColumn("size", F.length("tail")).join(first, "size").withColumn("run", F.expr("substring(tail, start, long)"))
    shapes = wild.select("size", "start", "long", "run", "shape").distinct().withColumn("at", _known_at(F.col("shape")))
    shaped = begun.join(shapes, ["size", "start", "long", "run"])
    shaped = shaped.select("tail", "shape", F.array_join(F.transform("at", lambda r: F.substring("tail", r["at"], r["long"])), "").alias("known"))
    return plain.unionByName(shaped.join(wild.select("symbol", "shape", "known"), ["shape", "known"]).select("tail", "symbol"))


def resolve_all(records: DataFrame, names: DataFrame) -> DataFrame:
    """M1 for many names: every match of each distinct `symbol`, with its rank, by equi-joins.

    In the LIKE arm, a name without wildcards is equal to a dotted suffix; those with
    `_` are found by :func:`_suffix_texts`.  Only names with `%` in them, which
    no source language has, are compared with every symbol, where there are any.
    """
    names = names.select("symbol").distinct()
    columns = [F.col(c) for c in records.columns]
    keyed = records.select(F.explode(F.array_distinct(F.array("name", "qualified_name"))).alias("symbol"), *columns)
    hits = keyed.join(names, "symbol").withColumn("rank", F.when(F.col("qualified_name") == F.col("symbol"), 0).otherwise(1))

    other = (F.col("name") != F.col("symbol")) & (F.col("qualified_name") != F.col("symbol"))
    tails = records.select(*columns, F.explode(_suffixes("qualified_name")).alias("tail"))
    matched = _suffix_texts(tails.select("tail").distinct(), names.filter(~F.col("symbol").contains("%")))
    suffix = tails.join(matched, "tail").filter(other).select("symbol", *columns).distinct().withColumn("rank", F.lit(2))
    found = hits.select("symbol", *columns, "rank").unionByName(suffix)

    percent = names.filter(F.col("symbol").contains("%"))
    if percent.isEmpty():
        return found
    loose = F.expr("lower(qualified_name) like concat('%.', replace(lower(symbol), '\\\\', '\\\\\\\\'))") & other
    return found.unionByName(records.join(percent, loose).select("symbol", *columns).withColumn("rank", F.lit(2)))


def resolve_best(records: DataFrame, names: DataFrame) -> DataFrame:
    """The best M1 match of each name that has one."""
    best = W.partitionBy("symbol").orderBy("rank", F.length("qualified_name"), "path", "start_line", "id")
    return resolve_all(records, names).withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")


def resolve_callees(records: DataFrame, edges: DataFrame) -> DataFrame:
    """M4: edge columns and the callee's record (`callee_*`), one row per distinct caller and name that resolves."""
    callers = records.select(F.col("id").alias("from_symbol_id"), F.col("file_id").alias("caller_file"))
    asked = edges.groupBy("from_symbol_id", "to_symbol_name").agg(F.min("id").alias("edge_id")).join(callers, "from_symbol_id")
    keys = records.select(F.explode(F.array_distinct(F.array("name", "qualified_name"))).alias("to_symbol_name"), *[F.col(c).alias(f"callee_{c}") for c in records.columns])
    best = W.partitionBy("from_symbol_id", "to_symbol_name").orderBy(
        F.when(F.col("callee_file_id") == F.col("caller_file"), 0).otherwise(1),
        F.when(F.col("callee_qualified_name") == F.col("to_symbol_name"), 0).otherwise(1),
        F.length("callee_qualified_name"),
        "callee_path",
        "callee_start_line",
        "callee_id",
    )
    return asked.join(keys, "to_symbol_name").withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")
