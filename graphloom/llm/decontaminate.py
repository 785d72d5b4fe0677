"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of anything but ASCII white space, lower-cased, without ASCII
punctuation at their ends.  From each position of a benchmark item two seeds are
taken: the shortest run of words, and the shortest run that leaves out every third
word, whose expected number of chance occurrences in the whole corpus is below
`chance`: the product of its words' relative frequencies times the number of words.
Frequencies are counted over all documents, so seeds get longer as the corpus grows
and chance hits don't multiply, while a passage that leaked into a thousand documents
is still found (its own n-grams' counts are not used).  Seeds have no longest length;
what has no seed (an item, all of it too common) is in :func:`unsearchable`.  Seeds
are joined with the documents' n-grams map-side, from a broadcast index of a block of
items of at most `block_bytes`; further blocks take further passes.  Hits of an item
in a document cluster by diagonal, and each cluster's stretch of the document is
aligned with the whole item by Smith-Waterman over words, forwards to find where the
best alignment ends and backwards from there to find where it starts.  The score is
the best alignment's over that of the item with itself: 1 for a verbatim copy.

Items of fewer than `min_words` words are too short for an alignment to mean much:
they are found where all their words stand in sequence, if chance alone would put
them there less than `chance` times, and not otherwise (a one-word answer is in half
of all texts).

Defined cases: null and empty texts and items match nothing; of several passages of
an item in one document the best is reported, of equally good ones the first; very
long texts are searched whole, with memory in proportion to the text; repeated rows
are reported each; a null document id is reported as null; repeated items are told
apart by id, items with a null id are ignored; empty tables give an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import word_blocks

MATCH, MISMATCH, GAP = 2, -1, -1
_EDGES = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def words_of(text: str | None) -> list[bytes]:
    return [w for block in word_blocks((text or "").lower().encode("utf-8", "replace")) for x in block if (w := x.strip(_EDGES))]


def _best(item: np.ndarray, passage: np.ndarray, until: int | None = None) -> tuple[int, int, int]:
    """(score, words of the item, words of the passage) of the best local alignment's end, row by row; `until`: stop once that score is met."""
    row = np.zeros(len(passage) + 1, dtype=np.int64)
    ramp = np.arange(len(passage) + 1, dtype=np.int64) * -GAP
    best = (0, 0, 0)
    for i, w in enumerate(item, 1):
        new = np.zeros_like(row)
        new[1:] = np.maximum(row[:-1] + np.where(passage == w, MATCH, MISMATCH), row[1:] + GAP)
        np.maximum(new, 0, out=new)
        new = np.maximum.accumulate(new + ramp) - ramp  # gaps within the row
        j = int(new.argmax())
        if new[j] > best[0]:
            best = (int(new[j]), i, j)
            if until is not None and best[0] >= until:
                return best
        row = new
    return best


def smith_waterman(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Score of the best local alignment of two arrays of word ids (linear gaps), and first and last (exclusive) place in the passage."""
    score, i, j = _best(item, passage)
    if not score:
        return 0, 0, 0
    _, _, back = _best(item[:i][::-1], passage[:j][::-1], until=score)
    return score, j - back, j


def _offsets(spaced: bool, n: int) -> tuple[int, ...]:
    """Places of the first n words of a run, of all words or without every third."""
    return tuple(i + i // 2 if spaced else i for i in range(n))


_MULT = 0x9E3779B97F4A7C15
FILTER_BITS = 20


class Index:
    """Seeds of a block of items, over the block's own vocabulary."""

    def __init__(self, items: list[tuple[int, list[bytes]]], frequency: dict[bytes, int], total: int, chance: float, min_words: int = 8):
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for _, ws in items for w in ws}))}
        rate = {w: max(1, frequency.get(w, 0)) / max(1, total) for w in self.vocabulary}
        self.items = [(item, np.array([self.vocabulary[w] for w in ws], dtype=np.int64), len(ws) < min_words) for item, ws in items]
        self.seeds: dict[tuple[int, ...], dict[tuple, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        self.seedless = []
        for at, (name, ids, short) in enumerate(self.items):
            rates, any_seed = [rate[w] for w in items[at][1]], False
            for i in range(len(ids)):
                for spaced in (False,) if short else (False, True):
                    expected, n = float(max(1, total)), 0
                    while (j := i + (n + n // 2 if spaced else n)) < len(ids) and (expected >= chance or (short and i == 0)):
                        expected, n = expected * rates[j], n + 1
                    if expected < chance and n:
                        at_ = _offsets(spaced, n)
                        self.seeds[at_][tuple(ids[[i + o for o in at_]].tolist())].append((at, i))
                        any_seed = True
                if short:
                    break  # the whole item is the only seed
            if not any_seed:
                self.seedless.append(name)
        self.seeds = {n: dict(s) for n, s in self.seeds.items()}
        self.filters = {}
        for offsets, seeds in self.seeds.items():
            bits = np.zeros(1 << FILTER_BITS, dtype=bool)
            h = np.uint64(0)
            for column in np.array(list(seeds), dtype=np.uint64).T:
                h = h * np.uint64(_MULT) + column
            bits[self._cells(h)] = True
            self.filters[offsets] = bits

    @staticmethod
    def _cells(h: np.ndarray) -> np.ndarray:
        return ((h ^ h >> np.uint64(31)) * np.uint64(_MULT) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)

    def matches(self, texts: list[list[bytes]], threshold: float) -> Iterator[tuple[int, int, float, int, int]]:
        """(text, item id, score, first word, last word) of each text's best passage for each item that reaches the threshold."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for words in texts for w in words), np.int64)
        ends = np.cumsum([len(words) for words in texts])
        hits: dict[tuple[int, int], set[int]] = defaultdict(set)
        plain = ids.view(np.uint64)
        hashed = {(): np.zeros(len(ids), dtype=np.uint64)}  # by the places of the words so far, which several kinds of seeds share
        for offsets, seeds in self.seeds.items():
            length = len(ids) - offsets[-1]
            if length <= 0:
                continue
            for n, o in enumerate(offsets):
                if offsets[: n + 1] not in hashed:
                    hashed[offsets[: n + 1]] = hashed[offsets[:n]][: len(ids) - o] * np.uint64(_MULT) + plain[o:]
            for at in np.flatnonzero(self.filters[offsets][self._cells(hashed[offsets])]).tolist():
                if found := seeds.get(tuple(ids[[at + o for o in offsets]].tolist())):
                    text = int(np.searchsorted(ends, at, "right"))
                    if at + offsets[-1] < ends[text]:  # not across two texts
                        for item, offset in found:
                            hits[text, item].add(at - offset)
        for (text, item), found in sorted(hits.items()):
            start = int(ends[text - 1]) if text else 0
            for match in self._passage(item, ids[start : ends[text]], sorted(x - start for x in found), threshold):
                yield (text, *match)

    def _passage(self, item: int, ids: np.ndarray, diagonals: list[int], threshold: float) -> Iterator[tuple[int, float, int, int]]:
        """The best passage of the item in a text, given where seeds would have it start."""
        name, own, short = self.items[item]
        if short:
            yield name, 1.0, diagonals[0], diagonals[0] + len(own)
            return
        slack, best = len(own) // 2 + 4, (0, 0, 0)
        first = last = diagonals[0]
        for diagonal in [*diagonals[1:], None]:
            if diagonal is not None and diagonal - last <= slack:
                last = diagonal
                continue
            a, b = max(0, first - slack), min(len(ids), last + len(own) + slack)
            score, start, end = smith_waterman(own, ids[a:b])
            best = max(best, (score, -(a + start), a + end))
            first = last = diagonal
        if (score := best[0] / (MATCH * len(own))) >= threshold:
            yield name, score, -best[1], best[2]


def _runs(texts: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Words of runs of texts of about `size` bytes (a longer text makes a run of its own), with the first one's place."""
    first, words, held = 0, [], 0
    for i, text in enumerate(texts):
        words.append(words_of(text.as_py()))
        held += len(text.as_buffer()) if text.is_valid else 0
        if held >= size:
            yield first, words
            first, words, held = i + 1, [], 0
    if words:
        yield first, words


RESULT = "doc_id long, item_id long, score double, window_start long, window_end long"


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    """Items as they come, at most `block_bytes` of text at once."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).filter("item_id is not null and text is not null")
    block, size = [], 0
    for r in items.toLocalIterator():
        if words := words_of(r["text"]):
            block.append((r["item_id"], words))
            size += len(r["text"])
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def _index(texts: DataFrame, block: list[tuple[int, list[bytes]]], chance: float, min_words: int) -> Index:
    """The block's index, with its words' frequencies in all of `texts`."""
    vocabulary = texts.sparkSession.sparkContext.broadcast({w for _, ws in block for w in ws})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total, wanted = Counter(), 0, vocabulary.value
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = words_of(text)
                total += len(words)
                seen.update(filter(wanted.__contains__, words))
        yield pa.RecordBatch.from_arrays([pa.array([*seen, b""], pa.binary()), pa.array([*seen.values(), total], pa.int64())], ["word", "n"])

    frequency = {bytes(r.word): r.n for r in texts.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}  # the block's words
    return Index(block, frequency, frequency.get(b"", 0), chance, min_words)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    threshold: float = 0.5,
    min_words: int = 8,
    chance: float = 0.01,
    block_bytes: int = 8 << 20,
) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, score, window_start, window_end (words, the last exclusive)."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for block in _blocks(benchmark, item_col, item_text_col, block_bytes):
        index = spark.sparkContext.broadcast(_index(texts, block, chance, min_words))

        def search(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, found = batch.column(0).to_pylist(), []
                for first, words in _runs(batch.column(1)):
                    found += [(ids[first + at], *m) for at, *m in index.value.matches(words, threshold)]
                columns = list(zip(*found, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "item_id", "score", "window_start", "window_end"])

        part = texts.mapInArrow(search, RESULT)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], RESULT)


def unsearchable(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_words: int = 8, chance: float = 0.01, block_bytes: int = 8 << 20) -> list[int]:
    """Ids of items that no seed stands for, since chance alone would put all of their words together: none of them can be reported."""
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    return sorted(i for block in _blocks(benchmark, item_col, item_text_col, block_bytes) for i in _index(texts, block, chance, min_words).seedless)
