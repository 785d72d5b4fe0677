"""Hunks of a diff as a DataFrame: path, old_start, old_count, new_start, new_count."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions import parse_range


def git_diff(root: str, start: str, end: str = "HEAD") -> str:
    """The text of `git diff -U0`; an error if git fails."""
    if start.startswith("-") or end.startswith("-"):
        raise ValueError("a revision must not start with a dash")
    done = subprocess.run(["git", "-C", root, "diff", "-U0", f"{start}..{end}"], capture_output=True, text=True)
    if done.returncode:
        raise RuntimeError(f"git diff failed: {done.stderr.strip()}")
    return done.stdout


def hunks_of(spark: SparkSession, diff: str) -> DataFrame:
    """The hunk headers with the file they belong to; deleted files drop out."""
    lines = spark.createDataFrame([(i, x) for i, x in enumerate(diff.split("\n")) if x.startswith(("+++ ", "@@ "))], "n long, line string")
    path = F.when(F.col("line").startswith("+++ "), F.regexp_replace(F.substring("line", 5, 1 << 20), "^b/", ""))
    # one diff's headers; the window carries the file's name on
    named = lines.withColumn("path", F.last(path, ignorenulls=True).over(W.orderBy("n").rowsBetween(W.unboundedPreceding, 0)))
    header = r"^@@ -(\d+(?:,\d+)?) \+(\d+(?:,\d+)?) @@"
    found = named.filter(F.col("line").rlike(header) & (F.col("path") != "/dev/null"))
    old, new = parse_range(F.regexp_extract("line", header, 1)), parse_range(F.regexp_extract("line", header, 2))
    return found.select("path", old["start"].alias("old_start"), old["count"].alias("old_count"), new["start"].alias("new_start"), new["count"].alias("new_count"))
