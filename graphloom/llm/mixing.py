"""Mixing sources to target weights by weighted fair queueing.

Sources, ordered by code point with null last, weigh `weights` in turn.  The
budget is `share` of all words.  Targets are the budget split by weight, except
that a source stops at `repeats` times its size and what it leaves is split
again by weight: with m = the least water level at which all fits, a target is
min(repeats * size, m * weight).  m is found in closed form, by sorting sources
by the level at which they stop.

Each source is a queue of its documents in a shuffled order (md5 of a seed, the id
and the whole text; then the id and the kept columns), passed through up to
`repeats` times.  A document's virtual finish time is its source's words so far,
itself included, over the source's target; documents are served in order of finish
time until the budget is used.  Words so far come from a two-level prefix sum (hash
ranges of the shuffle, then rows within a range); rows that agree in everything are
one place of the queue with a count, so any number of them is one row there.  Finish
times are sorted globally by ranges, and the order is truncated where the running
sum passes the budget: sums of the ranges tell which range that is, and only that
one is summed row by row.  So no source and no sort ends in one task, however
large.  Documents that finish at the same time as the cut are in only if all of
them fit.  The order depends on the rows alone, so reruns agree.

Defined cases: null text has size 0 and takes 0 words; null sources form one
source of their own; rows that repeat an id and all else are separate documents
next to each other in the queue; a null id is an id like any other; very long texts
are counted and hashed whole; if there are no words, all targets and takes
are 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm.common import WORD, materialize


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, repeats: int = 2) -> DataFrame:
    """`sizes`: source, source_size.  Adds target.  One row per source: windows over all of them are small."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    limit = F.col("source_size").cast("double") * repeats
    ranked = sizes.withColumn("_w", weight).withColumn("_limit", limit).withColumn("_level", F.col("_limit") / F.col("_w"))
    upto = W.orderBy("_level", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, W.currentRow)
    every = W.partitionBy(F.lit(0))
    ranked = (
        ranked.withColumn("_budget", F.sum("source_size").over(every).cast("double") * share)
        .withColumn("_left", F.col("_budget") - (F.sum("_limit").over(upto) - F.col("_limit")))
        .withColumn("_weights", F.sum("_w").over(every) - (F.sum("_w").over(upto) - F.col("_w")))
    )
    # the level of the first source that doesn't stop there
    level = F.min(F.when(F.col("_left") / F.col("_weights") < F.col("_level"), F.struct(F.col("_level").alias("a"), (F.col("_left") / F.col("_weights")).alias("b")))).over(every)
    return ranked.withColumn("_m", level["b"]).select("source", "source_size", F.least("_limit", F.coalesce(F.col("_m") * F.col("_w"), F.col("_limit"))).alias("target"))


def _cut(items: DataFrame, budget: float) -> float:
    """The latest finish time at which all that finish by then fit into the budget: a global range sort, cut where its running sum passes it."""
    times = items.groupBy("f").agg(F.sum("size").alias("s"))
    ranged = materialize(times.repartitionByRange("f").withColumn("part", F.spark_partition_id()), "finish")
    parts = ranged.groupBy("part").agg(F.sum("s").alias("s"), F.max("f").alias("last")).orderBy("part").collect()  # one row a partition
    before, cut = 0, -1.0
    for r in parts:
        if before + r.s > budget:
            upto = W.partitionBy("part").orderBy("f").rowsBetween(W.unboundedPreceding, W.currentRow)
            inside = ranged.filter(F.col("part") == r.part).withColumn("upto", F.sum("s").over(upto) + F.lit(before))
            return inside.filter(F.col("upto") <= budget).agg(F.max("f")).first()[0] or cut
        before, cut = before + r.s, r["last"]
    return cut


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    repeats: int = 2,
    seed: str = "mix",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of `docs`: doc_id, size, source_size, target, taken, source, copies, and the columns `keep`.

    `copies` is how often the document is taken, `taken` = copies * size.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    text = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(F.col(text_col).cast("string"), F.lit("-")))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        size.alias("size"),
        F.md5(F.concat(F.lit(seed + ":"), text)).alias("_order"),
        F.xxhash64(F.lit(0), *[F.col(k) for k in keep]).alias("_rest"),
        *[F.col(k).alias(f"_keep_{k}") for k in keep],
    )
    # rows alike in all of these are places next to each other in the queue
    alike = ["doc_id", "source", "size", "_order", "_rest"]
    places = rows.groupBy(*alike).agg(F.count(F.lit(1)).alias("_m")).withColumn("_range", F.conv(F.substring("_order", 1, 3), 16, 10).cast("int"))
    places = materialize(places, "places")

    ranges = places.groupBy("source", "_range").agg(F.sum(F.col("size") * F.col("_m")).alias("_words"))
    targets = source_targets(ranges.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, share, repeats)
    upto = W.partitionBy("source").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # 4096 rows a source at most
    starts = ranges.withColumn("_start", F.coalesce(F.sum("_words").over(upto), F.lit(0))).select(F.col("source").alias("_s"), F.col("_range").alias("_r"), "_start")
    starts = starts.join(targets.withColumnRenamed("source", "_t"), F.col("_s").eqNullSafe(F.col("_t"))).drop("_t")

    queue = W.partitionBy("source", "_range").orderBy("_order", "doc_id", "_rest").rowsBetween(W.unboundedPreceding, -1)
    placed = places.withColumn("_own", F.coalesce(F.sum(F.col("size") * F.col("_m")).over(queue), F.lit(0))).join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
    placed = materialize(placed.withColumn("_start", F.col("_start") + F.col("_own")).select(*alike, "_m", "_start", "source_size", "target"), "mix")

    def finish(n: Column, k: Column) -> Column:
        """When the k-th (from 0) of a place's rows has been served for the n-th time (from 0)."""
        return (F.col("_start") + (k + 1) * F.col("size") + n * F.col("source_size")).cast("double") / F.nullif(F.col("target"), F.lit(0.0))

    each = placed.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1)))
    items = each.filter("size > 0").select("size", F.explode(F.array(*[finish(F.lit(n), F.col("_k")) for n in range(repeats)])).alias("f")).filter("f is not null")
    budget = placed.groupBy("source").agg(F.max("target").alias("t")).agg(F.sum("t")).first()[0] or 0.0
    cut = _cut(items, budget + 1e-6)
    copies = sum((F.when((F.col("size") > 0) & (finish(F.lit(n), F.col("_k")) <= cut), 1).otherwise(0) for n in range(repeats)), F.lit(0)).cast("int")
    taken = each.withColumn("copies", copies)
    if keep:
        # one row of each place carries what is kept, once for all rows alike
        carried = rows.groupBy(*alike, *[f"_keep_{k}" for k in keep]).agg(F.count(F.lit(1)).alias("_n")).drop("_n")
        counted = taken.groupBy(*alike, "source_size", "target", "copies").agg(F.count(F.lit(1)).alias("_n"))
        same = [carried[c].eqNullSafe(counted[c]) for c in ("doc_id", "source", "size", "_rest")]
        joined = carried.join(counted, (carried["_order"] == counted["_order"]) & same[0] & same[1] & same[2] & same[3])
        taken = joined.select(counted["doc_id"], counted["source"], counted["size"], "source_size", "target", "copies", "_n", *[f"_keep_{k}" for k in keep])
        taken = taken.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    return taken.select(
        "doc_id", "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), (F.col("copies") * F.col("size")).alias("taken"), "source", "copies", *[F.col(f"_keep_{k}").alias(k) for k in keep]
    )
