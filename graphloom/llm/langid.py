"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Text is lower-cased and everything but letters becomes one space; features are
hashed n-grams of one to three characters, weighted log(1 + tf) times idf and
scaled to length one.  Weights are trained by follow-the-regularised-leader
(FTRL-proximal), whose closed form sets weights under the L1 penalty to exactly
zero and shrinks the rest by the L2 penalty (elastic net).  A temperature, fitted
on a fifth of the sample that training leaves out, calibrates the probabilities.

Document frequencies are counted over every training document.  The classifier
is fitted on at most `train_rows` labelled documents *of each language*, those with
the smallest hashes of id and text, so rare languages are learned too; that bound on
rows also bounds what reaches the driver.  The model (`DIM` x languages) is a small
broadcast.  Prediction reads whole texts, very long ones too.

Defined cases: a text that is null or has no letter is `und` with score 0; if no
label can be learned, so is every text; null ids count as training rows, as rows
that repeat an id with another text do; rows that repeat id and text are learned
from once and predicted alike; of equally likely languages the first by code point
is predicted; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import held_out, sample_rows

DIM_BITS = 15
DIM = 1 << DIM_BITS
ORDERS = (1, 2, 3)
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)], dtype=bool)


def counts(text: str | None) -> np.ndarray | None:
    """n-gram counts by bucket; None if the text has no letter."""
    if not text:
        return None
    chars = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    letter = _letters()[chars]
    if not letter.any():
        return None
    before = np.concatenate(([True], letter[:-1]))
    keep = letter | before  # one space for each run of others
    chars = np.concatenate(([32], np.where(letter, chars, 32)[keep], [32])).astype(np.uint32)
    total = np.zeros(DIM, dtype=np.int64)
    gram = np.zeros(len(chars), dtype=np.uint32)
    for n in ORDERS:
        gram = gram[: len(chars) - n + 1] * np.uint32(0x9E3779B1) + chars[n - 1 :] + np.uint32(n)
        mixed = (gram ^ gram >> np.uint32(15)) * np.uint32(0x85EBCA6B)
        total += np.bincount(mixed >> np.uint32(32 - DIM_BITS), minlength=DIM)
    return total


def features(total: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(total)
    value = np.log1p(total[at]) * idf[at]
    return at, value / max(np.sqrt((value**2).sum()), 1e-12)


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        return value @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        total = counts(text) if self.languages else None
        if total is None:
            return UNKNOWN, 0.0
        p = softmax(self.logits(*features(total, self.idf)) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, l1: float, l2: float, alpha: float = 1.0, beta: float = 1.0, epochs: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal over the rows in the order given; returns weights (DIM, classes) and the bias."""
    z, n = np.zeros((DIM + 1, classes)), np.zeros((DIM + 1, classes))

    def weights(at: np.ndarray) -> np.ndarray:
        zi, ni = z[at], n[at]
        shrunk = np.sign(zi) * np.maximum(np.abs(zi) - np.where(at[:, None] == DIM, 0, l1), 0)
        return -shrunk / ((beta + np.sqrt(ni)) / alpha + l2)

    for _ in range(epochs):
        for (at, value), y in zip(rows, labels, strict=True):
            at, value = np.append(at, DIM), np.append(value, 1.0)
            w = weights(at)
            error = softmax(value @ w)
            error[y] -= 1
            g = value[:, None] * error[None, :]
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / alpha * w
            n[at] = grown
    w = weights(np.arange(DIM + 1))
    return w[:DIM], w[DIM]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 4, train_rows: int = 1000, l1: float = 0.002, l2: float = 0.5) -> LanguageModel:
    train = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang"), held_out(F.col(id_col), modulus).alias("h")).filter("not h and text is not null and lang is not null")

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(DIM, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if (total := counts(text)) is not None:
                    seen += total > 0
                    n += 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIM)), pa.array(np.concatenate(([n], seen)))], ["bucket", "n"])

    found = train.select("text").mapInArrow(frequency, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # DIM + 1 rows
    by = {r.bucket: r.n for r in found}
    idf = np.log((by.get(-1, 0) + 1) / (np.array([by.get(i, 0) for i in range(DIM)]) + 1)) + 1

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(lang, *features(total, idf)) for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if (total := counts(text)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1].astype(np.int32).tobytes() for r in rows], pa.binary()), pa.array([r[2].astype(np.float32).tobytes() for r in rows], pa.binary())], ["lang", "at", "value"])

    labelled = train.select("text", "lang", F.xxhash64("id", "text", F.lit("sample")).alias("order"))
    sample = sample_rows(labelled, "lang", "order", train_rows).select("text", "lang").mapInArrow(sparse, "lang string, at binary, value binary").collect()  # train_rows a language
    sample = [(r.lang, np.frombuffer(r["at"], np.int32).astype(np.int64), np.frombuffer(r["value"], np.float32).astype(np.float64)) for r in sample]
    sample.sort(key=lambda r: (len(r[1]), r[0], r[2].tobytes()))
    sample = [sample[i] for i in np.random.default_rng(7).permutation(len(sample))]
    languages = sorted({r[0] for r in sample})
    if not languages:
        return LanguageModel([], idf, np.zeros((DIM, 0)), np.zeros(0))
    labels = np.array([languages.index(r[0]) for r in sample])
    cut = max(1, len(sample) * 4 // 5)
    weights, bias = ftrl([r[1:] for r in sample[:cut]], labels[:cut], len(languages), l1, l2)
    model = LanguageModel(languages, idf, weights, bias)
    if rest := sample[cut:]:
        z = np.array([model.logits(*r[1:]) for r in rest])
        loss = [(-np.log(softmax(z / t)[np.arange(len(z)), labels[cut:]] + 1e-12).mean(), t) for t in np.geomspace(0.05, 10, 80)]
        model.temperature = float(min(loss)[1])
    return model


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), carry_text: bool = False) -> DataFrame:
    """The columns `keep` of every row (and `text`, if asked for), with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(t) for t in batch.column(len(keep)).to_pylist()]
            kept_columns = batch.columns if carry_text else batch.columns[: len(keep)]
            yield pa.RecordBatch.from_arrays([*kept_columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], [*names, "lang_pred", "score"])

    names = [*keep, "text"] if carry_text else [*keep]
    kept = kept.withColumnRenamed("_text", "text") if carry_text else kept
    return kept.mapInArrow(run, kept.select(*names).schema.add("lang_pred", "string").add("score", "double"))


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 4, train_rows: int = 1000) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, lang_pred, score."""
    model = fit(docs, id_col, text_col, lang_col, modulus, train_rows)
    named = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col), modulus).alias("held_out"), F.col(text_col).alias("text"))
    return identify(named, model, keep=("doc_id", "held_out"))
