"""Quality classification by a factorisation machine.

Features of a text: hashed words and hashed word shapes (log(1 + tf), each
family scaled to length one), and structure statistics and metadata (shares of
letters, capitals, digits, punctuation and symbols, mean word length, repeated
words and lines, length in characters, words and lines).  A factorisation machine
adds to the linear terms a weight for each pair of features, the inner product of
their factor vectors; by the sum-of-squares identity the pairs cost no more than
the features: 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).

It is fitted by Adagrad on at most `train_rows` labelled documents of each label
that are not held out, those with the smallest hashes of their ids; the bound on
rows also bounds what reaches the driver.  Where a label has more documents than
that, the bias is corrected for the shares that the sample changed.  Scoring reads
whole texts, very long ones too.  Labels, language, source and id are never inputs.

Defined cases: null and empty texts get a score from their (empty) statistics;
null ids count as not held out and have no label; labels that repeat an id count
once (the lowest quality wins); of several texts with one id, the one with the
smallest hash is learned from; without labels every score is 0.5; repeated rows
are scored alike, and so are texts with equal features (ties); an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import held_out, sample_rows

WORD_BITS, SHAPE_BITS = 16, 12
STATS = 16
DIM = (1 << WORD_BITS) + (1 << SHAPE_BITS) + STATS
RANK = 8
_SHAPE = bytes(97 if 97 <= i <= 122 or i >= 128 else 65 if 65 <= i <= 90 else 57 if 48 <= i <= 57 else i for i in range(256))
_RUNS = re.compile(rb"(.)\1+", re.S)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    data = (text or "").encode("utf-8", "replace")
    counts = Counter(data.split())
    words, shapes = Counter(), Counter()
    for word, n in counts.items():
        words[zlib.crc32(word.lower()) & (1 << WORD_BITS) - 1] += n
        shapes[_RUNS.sub(rb"\1", word.translate(_SHAPE))] += n
    shaped = Counter()
    for shape, n in shapes.items():
        shaped[(1 << WORD_BITS) + (zlib.crc32(shape) & (1 << SHAPE_BITS) - 1)] += n
    at, value = [], []
    for family in (words, shaped):
        v = np.log1p(np.fromiter(family.values(), np.float64, len(family)))
        at.append(np.fromiter(family.keys(), np.int64, len(family)))
        value.append(v / max(np.sqrt((v**2).sum()), 1e-12))
    by = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    size, n_words = max(1, len(data)), max(1, counts.total())
    lines = data.split(b"\n")
    upper, lower, digit = by[65:91].sum(), by[97:123].sum(), by[48:58].sum()
    stop = by[[33, 34, 39, 44, 46, 58, 59, 63]].sum()
    space = by[[9, 10, 11, 12, 13, 32]].sum()
    high = by[128:].sum()
    symbol = size - upper - lower - digit - stop - space - high if len(data) else 0
    stats = [
        1.0, upper / size, lower / size, digit / size, stop / size, symbol / size, high / size, np.sqrt(symbol / size), np.sqrt(upper / size),
        (size - space) / n_words / 20, 1 - len(counts) / n_words, 1 - len(set(lines)) / len(lines),
        np.log1p(len(data)) / 12, np.log1p(counts.total()) / 10, np.log1p(len(lines)) / 8, np.sqrt(by[33] / size),
    ]
    at.append(np.arange(DIM - STATS, DIM))
    value.append(np.array(stats))
    return np.concatenate(at), np.concatenate(value)


@dataclass
class FactorisationMachine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def logit(self, at: np.ndarray, value: np.ndarray) -> float:
        v = self.factors[at] * value[:, None]
        total = v.sum(axis=0)
        return float(self.bias + value @ self.linear[at] + 0.5 * ((total**2).sum() - (v**2).sum()))

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(*features(text)), -30, 30))))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 5, rate: float = 0.05, l2: float = 1e-5) -> FactorisationMachine:
    rng = np.random.default_rng(11)
    share = float(np.clip(labels.mean(), 0.01, 0.99)) if len(labels) else 0.5
    fm = FactorisationMachine(float(np.log(share / (1 - share))), np.zeros(DIM), rng.normal(0, 0.02, (DIM, RANK)))
    g_linear, g_factors, g_bias = np.full(DIM, 1e-3), np.full((DIM, RANK), 1e-2), 1.0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, value = rows[i]
            error = 1 / (1 + np.exp(-np.clip(fm.logit(at, value), -30, 30))) - labels[i]
            v = fm.factors[at]
            total = (v * value[:, None]).sum(axis=0)
            step = error * value + l2 * fm.linear[at]
            g_linear[at] += step**2
            fm.linear[at] -= rate * step / np.sqrt(g_linear[at])
            step = error * value[:, None] * (total[None, :] - v * value[:, None]) + l2 * v
            g_factors[at] += step**2
            fm.factors[at] -= rate * step / np.sqrt(g_factors[at])
            g_bias += error**2
            fm.bias -= rate * error / np.sqrt(g_bias)
    return fm


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", modulus: int = 4, train_rows: int = 3000) -> FactorisationMachine:
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y is not null")
    marks = marks.filter(~held_out(F.col("id"), modulus)).groupBy("id").agg(F.min("y").alias("y"))
    shares = {r.y: r.n for r in marks.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a label
    chosen = sample_rows(marks.withColumn("order", F.xxhash64("id", F.lit("sample"))), "y", "order", train_rows).select("id", "y")
    # at most train_rows ids a label: their size is bounded by the parameter
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")
    texts = texts.groupBy("id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "y")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([f[0].astype(np.int32).tobytes() for f in found], pa.binary()), pa.array([f[1].astype(np.float32).tobytes() for f in found], pa.binary())], ["y", "at", "value"])

    sample = [(r.y, np.frombuffer(r["at"], np.int32).astype(np.int64), np.frombuffer(r["value"], np.float32).astype(np.float64)) for r in texts.mapInArrow(sparse, "y int, at binary, value binary").collect()]
    sample.sort(key=lambda r: (len(r[1]), r[0], r[2].tobytes()))
    fm = train([r[1:] for r in sample], np.array([r[0] for r in sample], dtype=np.float64))
    here, there = [sum(r[0] == y for r in sample) for y in (0, 1)], [shares.get(y, 0) for y in (0, 1)]
    if min(here + there) > 0:
        fm.bias += float(np.log(there[1] / there[0]) - np.log(here[1] / here[0]))
    return fm


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", modulus: int = 4, train_rows: int = 3000, threshold: float = 0.7) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, label_col, modulus, train_rows))
    named = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col), modulus).alias("held_out"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([shared.value.score(t) for t in batch.column(2).to_pylist()], pa.float64())], ["doc_id", "held_out", "score"])

    scored = named.mapInArrow(run, named.drop("text").schema.add("score", "double"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
