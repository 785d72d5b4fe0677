"""Exact deduplication by skew-safe combining.

Three stages, each of which groups by the whole normalised text next to its
digest, so a digest collision can never merge two texts:

1. each map task combines its own equal texts (the partial aggregation);
2. what the tasks found meets by digest, text and a salt taken from the task,
   so a text that a third of all rows share is merged by `salts` reducers, from
   one row per map task at most;
3. the winners of the salts meet by digest and text.

Only a row per digest goes on from there.  Rows are joined to it by digest
alone where the digest stands for one text (checked, not assumed) and by digest
and text where it stands for more.

Defined cases: null text counts as empty; ties cannot occur, since the largest
id stays; of rows that repeat an id and text, one is kept and the others are
dropped; null ids lose to any other id, and if a group has no other, one null
row is kept; an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import lower_ascii, materialize


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = 16,
    digest: Callable[[Column], Column] = lambda sha: sha,
) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    `digest` derives the grouping digest from the SHA-256; tests pass a weak one
    to make texts collide.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), lower_ascii(F.coalesce(F.col(text_col), F.lit(""))).alias("_text"))
    base = base.withColumn("_sha", F.sha2("_text", 256)).withColumn("_digest", digest(F.col("_sha")))

    salted = (
        base.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        .groupBy("_digest", "_text", "_salt")
        .agg(F.max("doc_id").alias("_winner"), F.count(F.lit(1)).alias("_n"))
    )
    groups = salted.groupBy("_digest", "_text").agg(F.max("_winner").alias("keep_id"), F.sum("_n").alias("group_size"))
    digests = materialize(
        groups.groupBy("_digest").agg(F.count(F.lit(1)).alias("_texts"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size")),
        "exact",
    )
    clashes = digests.filter("_texts > 1").select("_digest")

    def rows(part: DataFrame, *keys: str) -> DataFrame:
        """Repeated rows travel as one row with a count."""
        return part.groupBy("doc_id", "_sha", *keys).agg(F.count(F.lit(1)).alias("_m"))

    out = rows(base, "_digest").join(digests.filter("_texts = 1"), "_digest")
    if not clashes.isEmpty():
        out = out.select("doc_id", "_sha", "_m", "keep_id", "group_size").unionByName(
            rows(base.join(clashes, "_digest", "left_semi"), "_digest", "_text")
            .join(groups.join(clashes, "_digest", "left_semi"), ["_digest", "_text"])
            .select("doc_id", "_sha", "_m", "keep_id", "group_size")
        )
    return out.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), "_m"))).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_i") == 1)).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )
