"""Scalar functions of the engine, as Column expressions where Spark can say them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity, and over 0.7 a tenth of the rest for each character of a common prefix, four at most."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken = [False] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, t in zip(b, taken, strict=True) if t]
    m, moved = len(left), sum(x != y for x, y in zip(left, right, strict=True))
    jaro = (m / len(a) + m / len(b) + (m - moved / 2) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro)


def _similarities(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in parts:
        yield pd.Series([None if x is None or y is None else jaro_winkler(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@cache
def jaro_winkler_udf():
    """Made on first use: workers import this module too, and have no session."""
    return F.pandas_udf(_similarities, "double")


def name_similarity(query: Column, name: str = "name", qualified: str = "qualified_name") -> Column:
    """The better of the two names' similarities."""
    return F.greatest(jaro_winkler_udf()(F.col(qualified), query), jaro_winkler_udf()(F.col(name), query))


def is_test_path(path: Column | str) -> Column:
    p = F.lower(F.col(path) if isinstance(path, str) else path)
    inside = ["/test/", "/tests/", "/__tests__/", ".test.", ".spec.", "/test_"]
    out = p.endswith("_test.go") | p.startswith("test_")
    for part in inside:
        out = out | p.contains(part)
    return out


def directory(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(F.lit("."))


def last_identifier(text: Column) -> Column:
    return F.regexp_extract(text, r"([A-Za-z0-9_$]+)[^A-Za-z0-9_$]*$", 1)


def token_estimate(json: Column) -> Column:
    """A fourth of the JSON's bytes, one at least."""
    return F.greatest(F.lit(1), F.floor(F.octet_length(json) / 4)).cast("long")


def glob_score(name: Column, pattern: str) -> Column:
    text = pattern.strip("*").lower()
    if not text:
        return F.lit(0.5)
    return F.when(F.lower(name) == text, 1.0).when(F.lower(name).contains(text), 0.85).otherwise(0.5)


def glob_like(pattern: str) -> str:
    """LIKE pattern of a glob: `*` is any text, all else is itself."""
    return pattern.lower().replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%")


def strip_quotes(text: Column) -> Column:
    return F.btrim(text, F.lit("\"'`"))


def normalize_path(path: Column) -> Column:
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(\./)+", "")


def clip_to_budget(text: Column, budget: Column) -> Column:
    """Whole text of at most four bytes a token, else its first 4 * budget characters and a mark."""
    return F.when(F.octet_length(text) > 4 * budget, F.concat(F.substring(text, F.lit(1), (4 * budget).cast("int")), F.lit("\n... truncated"))).otherwise(text)


def parse_range(text: Column) -> Column:
    """start and count of `a,b`; the count is one if it is left out."""
    parts = F.split(text, ",")
    return F.struct(F.coalesce(parts[0].try_cast("int"), F.lit(0)).alias("start"), F.coalesce(F.get(parts, 1).try_cast("int"), F.lit(1)).alias("count"))
