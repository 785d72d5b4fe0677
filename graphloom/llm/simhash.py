"""SimHash near-duplicate detection with Golay-code fuzzy keys.

Words are runs of anything but ASCII white space, lower-cased in A-Z only;
features are the XXH64 hashes (seed 42) of `shingle` consecutive words joined by
one space, repeats counted.  A fingerprint bit is 1 if it is set in over half of
the features.  Documents whose fingerprints differ in at most three bits are
linked; a group is a connected component of links.  :func:`shingle_groups` looks
further (five bits) and verifies the shingles themselves.

Work is done on *distinct* fingerprints, so copies cost nothing after the first
aggregation.  Fuzzy keys (:mod:`graphloom.llm.golay`) bring near fingerprints
together; rows of a key are compared by XOR and popcount, and a key emits links
that span what it connects, not all its pairs.  A key with more than `block`
fingerprints is split into blocks, each pair of blocks in a task of its own.

Defined cases: null and empty texts have no feature, fingerprint zero, and are
linked like any other; texts with fewer words than a shingle have one feature,
the whole sequence; repeated rows share a component; a row with a null id gets
the component of its fingerprint, and null if it holds null ids alone; an empty
table gives an empty result; very long texts are hashed whole, block by block; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import likely_in, materialize, word_blocks
from graphloom.llm.components import connected_components
from graphloom.llm.golay import fuzzy_keys

SEED = 42


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The unsigned 64-bit fingerprint of one text, in bounded memory."""
    ones, total, tail, digest = np.zeros(64, dtype=np.int64), 0, [], xxhash.xxh64_intdigest
    for words in word_blocks(text.lower()):
        words = tail + words
        tail = words[max(0, len(words) - shingle + 1) :]
        if len(words) >= shingle:
            hashes = np.array([digest(b" ".join(x), SEED) for x in zip(*(words[i:] for i in range(shingle)), strict=False)], dtype=">u8")
            ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
            total += len(hashes)
    if total == 0:
        return digest(b" ".join(tail), SEED) if tail else 0  # fewer words than a shingle: the tail has them all
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def _span(prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that span the components of distinct fingerprints, found breadth first."""
    left, links = prints.view(np.uint64), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= radius
            if near.any():
                queue.extend(found := left[near])
                links.extend((at, x) for x in found)
                left = left[~near]
    return links


def _pairs(keys: np.ndarray, prints: np.ndarray, radius: int, few: int = 24) -> np.ndarray:
    """Verified links within runs of equal keys; runs over `few` are spanned, not paired."""
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    lengths = np.diff(np.append(starts, len(keys)))
    long = np.repeat(lengths > few, lengths)
    out = []
    k, p = keys[~long], prints[~long].view(np.uint64)
    for step in range(1, min(few, len(k))):
        same = np.flatnonzero(k[step:] == k[:-step])
        if not len(same):
            break
        a, b = p[same], p[same + step]
        near = np.bitwise_count(a ^ b) <= radius
        out.append(np.stack([a[near], b[near]], axis=1))
    for s, n in zip(starts[lengths > few], lengths[lengths > few], strict=True):
        if links := _span(np.unique(prints[s : s + n]), radius):
            out.append(np.array(links, dtype=np.uint64))
    found = np.concatenate(out) if out else np.empty((0, 2), dtype=np.uint64)
    return found.view(np.int64)


def _links(block: int, radius: int):
    """Over rows sorted by key: links, and the rows of keys with over `block` fingerprints, to be split."""

    def emit(a: np.ndarray, b: np.ndarray, key: np.ndarray | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(key) if key is not None else pa.nulls(len(a), pa.int64())], ["a", "b", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, prints = np.empty(0, np.int64), np.empty(0, np.int64)
        hot = None  # a key that was found too long: its rows stream through
        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            prints = np.concatenate([prints, batch.column(1).to_numpy()])
            if hot is not None:
                n = int(np.searchsorted(keys, hot, "right"))
                if n:
                    yield emit(prints[:n], prints[:n], np.full(n, hot))
                keys, prints = keys[n:], prints[n:]
                if not len(keys):
                    continue
                hot = None
            last = int(np.searchsorted(keys, keys[-1], "left"))  # the last run may go on
            yield from done(keys[:last], prints[:last])
            keys, prints = keys[last:], prints[last:]
            if len(keys) > block:
                hot = int(keys[0])
                yield emit(prints, prints, keys)
                keys, prints = keys[:0], prints[:0]
        yield from done(keys, prints)

    def done(keys: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(keys):
            return
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        lengths = np.diff(np.append(starts, len(keys)))
        hot = np.repeat(lengths > block, lengths)
        if hot.any():
            yield emit(prints[hot], prints[hot], keys[hot])
        found = np.unique(_pairs(keys[~hot], prints[~hot], radius), axis=0) if not hot.all() else np.empty((0, 2), np.int64)
        if len(found):
            yield emit(found[:, 0].copy(), found[:, 1].copy(), None)

    return run


def fingerprint_links(prints: DataFrame, block: int = 4096, radius: int = 3) -> DataFrame:
    """`prints`: distinct long column fp.  Links (a, b) that span all pairs within `radius` bits (3 or 5)."""

    def block_links(_key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        links = _span(np.unique(rows["a"].to_numpy()), radius)
        found = np.array(links, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy()
            for at in range(0, len(values), 4096):
                part = np.ascontiguousarray(values[at : at + 4096])
                rows, keys = fuzzy_keys(part, radius)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], ["key", "fp"])

    # fingerprints are few bytes each and become many rows: dealt out anew, so that a small table still uses all cores
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = prints.select("fp").repartition(tasks).mapInArrow(spread, "key long, fp long").repartition("key").sortWithinPartitions("key")
    found = materialize(keyed.mapInArrow(_links(block, radius), "a long, b long, key long"), "links")
    links = found.filter("key is null").select("a", "b")
    hot = found.filter("key is not null").select("key", "a")
    if not hot.isEmpty():
        sizes = hot.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).alias("blocks"))
        mine = F.pmod(F.xxhash64("a"), F.col("blocks"))
        split = (
            hot.join(sizes, "key")
            .withColumn("i", mine)
            .withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
            .select("key", "a", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
        )
        links = links.unionByName(split.groupBy("key", "i", "j").applyInPandas(block_links, "a long, b long"))
    return links


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, block: int = 4096, radius: int = 3) -> DataFrame:
    """One row per row of `docs`: doc_id, fp (the fingerprint as a signed long), component_id."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"", shingle) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, dtype=np.uint64).view(np.int64))], ["doc_id", "fp"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = materialize(chosen.mapInArrow(prints, "doc_id long, fp long"), "prints")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    nodes = connected_components(fingerprint_links(distinct, block, radius))
    grouped = distinct.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    named = grouped.join(smallest, "component").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def shingle_groups(docs: DataFrame, id_col: str, text_col: str = "text", shingle: int = 5, similarity: float = 0.8, radius: int = 5) -> DataFrame:
    """One row per row of `docs` whose `id_col` (a long that tells texts apart): node, group (a node that stands for it).

    Fingerprints of three-word shingles within `radius` bits make candidates, and
    each member of a candidate group is verified against one leader by the share
    of five-word shingles (`shingle`) that they have in common, `similarity` at
    least.  Those that fail are led anew, by one of themselves, until each is
    verified or leads: a document is in a group only if it is like its leader.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).cast("string").alias("text"))
    groups = materialize(simhash_groups(rows, "node", "text", radius=radius).select(F.col("doc_id").alias("node"), F.col("component_id").alias("component")).distinct(), "near")
    crowded = groups.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("component")
    members = materialize(groups.join(crowded, "component", "left_semi"), "crowded")

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_shingle_set(x.as_buffer().to_pybytes() if x.is_valid else b"", shingle) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], ["node", "component", "set"])

    texts = members.join(likely_in(rows, members.select("node"), "node").dropDuplicates(["node"]), "node").select("node", "component", "text")
    left = materialize(texts.mapInArrow(shingles, "node long, component long, set array<long>"), "sets")
    out = groups.join(crowded, "component", "left_anti").select("node", F.col("node").alias("group"))
    while True:
        leaders = left.groupBy("component").agg(F.min_by(F.struct("node", "set"), "node").alias("lead"))
        common = F.size(F.array_intersect("set", "lead.set"))
        enough = common >= similarity * (F.size("set") + F.size("lead.set") - common)
        checked = left.join(leaders, "component").select("node", "component", "set", F.col("lead.node").alias("group"), ((F.col("node") == F.col("lead.node")) | enough).alias("ok"))
        checked = materialize(checked, "led")
        out = out.unionByName(checked.filter("ok").select("node", "group"))
        left = checked.filter("not ok").select("node", "component", "set")
        if left.isEmpty():
            return out


def _shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """Hashes of the distinct shingles of a text; of the whole sequence, if it has fewer words."""
    found, tail = [], []
    for words in word_blocks(text.lower()):
        words = tail + words
        tail = words[max(0, len(words) - shingle + 1) :]
        found.append(np.array([xxhash.xxh64_intdigest(b" ".join(x), SEED) for x in zip(*(words[i:] for i in range(shingle)), strict=False)], dtype=np.uint64))
    hashes = np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64)
    return (hashes if len(hashes) or not tail else np.array([xxhash.xxh64_intdigest(b" ".join(tail), SEED)], dtype=np.uint64)).view(np.int64)
