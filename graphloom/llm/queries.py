"""The operators applied to the driver's tables, one query each, and SQL where it can say the same."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import table
from graphloom.llm.contextmix import score_documents
from graphloom.llm.decontaminate import contaminated
from graphloom.llm.exact_dedup import exact_dedup
from graphloom.llm.langid import language_id
from graphloom.llm.linededup import dedup_lines
from graphloom.llm.mixing import mix_sources
from graphloom.llm.pii import pseudonymise_checked
from graphloom.llm.quality import quality_scores
from graphloom.llm.simhash import simhash_groups
from graphloom.llm.tokencount import token_counts


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every text as it is, and after edits that mask the host of each mail address."""
    return token_counts(table(spark, sf_dir, "documents"), find=r"@[^\s@]+", replacement="@host")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the session's key, or else one that nobody keeps."""
    key = spark.conf.get("spark.graphloom.pii.key", None) or secrets.token_hex(32)
    return pseudonymise_checked(table(spark, sf_dir, "documents"), key)


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OPERATORS = [op1_exact_dedup, op2_line_dedup, op3_token_counts, op4_mix_sources, op5_pii, op6_lm_score, op7_language_id, op8_quality, op9_simhash, op10_decontaminate]


def queries() -> dict:
    return {f.__name__: f for f in OPERATORS}


OP1_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""

OP4_SQL = r"""
WITH rows_ AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || coalesce(text, '-')) AS o FROM documents
), sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM rows_ GROUP BY source
), weighed AS (
  SELECT *, CASE (k - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, 2.0::DOUBLE * source_size AS lim FROM sizes
), ranked AS (
  SELECT *, lim / w AS lev,
    1.5::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT) - (sum(lim) OVER u - lim) AS rest,
    sum(w) OVER () - (sum(w) OVER u - w) AS ws
  FROM weighed WINDOW u AS (ORDER BY lim / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)
), leveled AS (
  SELECT source, source_size, least(lim, coalesce((SELECT arg_min(rest / ws, lev) FROM ranked WHERE rest / ws < lev) * w, lim)) AS target FROM ranked
), queue AS (
  SELECT r.doc_id, r.size, l.source_size, l.target,
    CAST(sum(r.size) OVER (PARTITION BY r.source ORDER BY r.o, r.doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS own
  FROM rows_ r JOIN leveled l ON r.source IS NOT DISTINCT FROM l.source
), items AS (
  SELECT size, CAST(own AS DOUBLE) / nullif(target, 0) AS f FROM queue WHERE size > 0
  UNION ALL SELECT size, CAST(own + source_size AS DOUBLE) / nullif(target, 0) FROM queue WHERE size > 0
), served AS (
  SELECT f, sum(sum(size)) OVER (ORDER BY f) AS upto FROM items GROUP BY f
), cut AS (
  SELECT coalesce(max(f), -1) AS f FROM served WHERE upto <= (SELECT sum(target) FROM leveled) + 1e-6
)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN size = 0 THEN 0 ELSE size * (CASE WHEN CAST(own AS DOUBLE) / nullif(target, 0) <= cut.f THEN 1 ELSE 0 END + CASE WHEN CAST(own + source_size AS DOUBLE) / nullif(target, 0) <= cut.f THEN 1 ELSE 0 END) END AS BIGINT) AS taken
FROM queue, cut
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op4_mix_sources": OP4_SQL}
