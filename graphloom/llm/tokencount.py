"""Edit-aware token counts.

A document's pre-tokens (the pieces that a byte-level BPE tokenizer never merges
across) are cut into blocks of `LEAF`; a segment tree over the blocks holds at each
inner node the sums of its two children: characters, tokens.  A corpus is counted once:
:func:`count_corpus` gives each document with its text and its blocks' sums, a table to
be kept.  :func:`edit_counts` takes such rows and edits (stretches of characters to be
replaced), and gives rows of the same kind, to be kept in their turn: the trees are
rebuilt from the sums, and only the blocks that an edit touches and the block before
them are cut and encoded again, up to where a new block starts on an old one's start.
All other blocks keep their sums, and only sums on paths to changed blocks change.  That
is exact, since the pre-token pattern looks no further back than a match's start and no
further ahead than one character beyond its end.  The text is put together once, from
stretches of the old one, so many edits of a long text cost no more than its length.

Counts are those of the public vocabulary file given by path, without special
tokens.  Pieces recur, so each worker remembers the counts of short ones in a
bounded table.

Defined cases: null and empty texts have 0 tokens; edits with a null field are
ignored; positions are clipped to the text; edits of one document apply in order
of position, from the end backwards, and where they overlap, the one that starts
later goes first and the other ends where it starts; repeated rows are counted
each, and all get the edits of their id; rows with null ids get none; very long texts
are counted whole; an empty table gives an empty result; other columns are ignored.  The
vocabulary file is shipped with the job from the driver, by the given path.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import materialize

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the vocabulary's pre-token pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF = 16
_pieces = regex.compile(PATTERN)


class Counter:
    """Token counts of pre-tokens, with a bounded memory."""

    def __init__(self, vocabulary: bytes, remember: int = 400_000):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.encoding = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, int] = {}
        self.remember = remember

    def piece(self, text: str) -> int:
        n = self.known.get(text)
        if n is None:
            n = len(self.encoding.encode_ordinary(text))
            if len(text) <= 32:
                if len(self.known) >= self.remember:
                    self.known.clear()
                self.known[text] = n
        return n

    def text(self, text: str | None) -> int:
        return sum(map(self.piece, _pieces.findall(text))) if text else 0


class SegmentTree:
    """Sums of characters and tokens over blocks, as an implicit binary tree: node i has children 2i and 2i + 1."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.width = 1 << max(0, len(chars) - 1).bit_length()
        self.blocks = len(chars)
        self.chars, self.tokens = (self._sums(x) for x in (chars, tokens))

    def _sums(self, leaves: list[int]) -> list[int]:
        out = [0] * self.width + leaves + [0] * (self.width - len(leaves))
        for i in range(self.width - 1, 0, -1):
            out[i] = out[2 * i] + out[2 * i + 1]
        return out

    def find(self, char: int) -> tuple[int, int]:
        """Number and start of the block that holds character `char`; the last block's beyond the end."""
        if not self.blocks:
            return 0, 0
        at, start = 1, 0
        while at < self.width:
            at *= 2
            if char >= start + self.chars[at] and start + self.chars[at] < self.chars[1]:
                start += self.chars[at]
                at += 1
        return at - self.width, start

    def start(self, block: int) -> int:
        """Where a block starts."""
        at, total = block + self.width, 0
        while at > 1:
            if at & 1:
                total += self.chars[at - 1]
            at >>= 1
        return total

    def put(self, block: int, chars: int, tokens: int) -> None:
        """Changes a block's sums, and those of the nodes above it."""
        at = block + self.width
        more, most = chars - self.chars[at], tokens - self.tokens[at]
        while at:
            self.chars[at] += more
            self.tokens[at] += most
            at >>= 1


class CountedText:
    """A text with its segment tree."""

    def __init__(self, text: str | None, counter: Counter, blocks: list[tuple[int, int]] | None = None):
        """`blocks`: characters and tokens of each, if they are known."""
        self.text, self.counter, self.encoded = text or "", counter, 0
        known = blocks if blocks is not None else list(self._cut(0))
        self.tree = SegmentTree([b[0] for b in known], [b[1] for b in known])

    def _cut(self, at: int) -> Iterator[tuple[int, int]]:
        """Blocks of the text from a pre-token's start on."""
        chars = tokens = n = 0
        for match in _pieces.finditer(self.text, at):
            piece = match[0]
            chars, tokens, n = chars + len(piece), tokens + self.counter.piece(piece), n + 1
            if n == LEAF:
                yield chars, tokens
                chars = tokens = n = 0
        if n:
            yield chars, tokens

    @property
    def tokens(self) -> int:
        return self.tree.tokens[1]

    @property
    def blocks(self) -> list[tuple[int, int]]:
        first = self.tree.width
        return list(zip(self.tree.chars[first : first + self.tree.blocks], self.tree.tokens[first : first + self.tree.blocks], strict=True))

    def edit(self, edits: list[tuple[int, int, str]]) -> int:
        """Applies (start, end, replacement), all by places in the text as it is; returns how many."""
        ordered, bound = [], len(self.text)
        for start, end, by in sorted(edits, reverse=True):  # the one that starts later goes first
            start = max(0, min(start, bound))
            ordered.append((start, max(start, min(end, bound)), by))
            bound = start
        ordered.reverse()
        old, pieces, at = self.text, [], 0
        for start, end, by in ordered:
            pieces += [old[at:start], by]
            at = end
        self.text = "".join([*pieces, old[at:]])
        if not self.tree.blocks:
            fresh = list(self._cut(0))
            self.encoded += sum(1 for _ in _pieces.finditer(self.text))
            self.tree = SegmentTree([b[0] for b in fresh], [b[1] for b in fresh])
            return len(ordered)
        tree, out, kept, shift, i = self.tree, [], 0, 0, 0  # out: runs of new blocks by the old ones that they stand for
        while i < len(ordered):
            first = max(kept, tree.find(max(0, ordered[i][0] - 1))[0] - 1)
            at, fresh, until = tree.start(first) + shift, [], tree.blocks
            # `shift`: how much longer the text is before the place that is being cut
            clear, later = ordered[i][1] + 1, shift + len(ordered[i][2]) - (ordered[i][1] - ordered[i][0])
            i += 1
            new, chars, tokens, n = at, 0, 0, 0
            for match in _pieces.finditer(self.text, at):
                while i < len(ordered) and new - later >= ordered[i][0] - 1:  # the next edit is reached before an old block is met
                    clear, later = ordered[i][1] + 1, later + len(ordered[i][2]) - (ordered[i][1] - ordered[i][0])
                    i += 1
                if clear <= new - later < len(old):
                    number, start = tree.find(new - later)
                    if start == new - later:
                        until = number
                        break
                size = len(match[0])
                chars, tokens, n, new = chars + size, tokens + self.counter.piece(match[0]), n + 1, new + size
                self.encoded += 1
                if n == LEAF:
                    fresh.append((chars, tokens))
                    chars = tokens = n = 0
            else:
                i = len(ordered)
            if n:
                fresh.append((chars, tokens))
            out.append((first, until, fresh))
            kept, shift = until, later
        if all(until - first == len(fresh) for first, until, fresh in out):
            for first, _, fresh in out:
                for n, block in enumerate(fresh):
                    tree.put(first + n, *block)
        else:
            blocks, merged, at = self.blocks, [], 0
            for first, until, fresh in out:
                merged += blocks[at:first] + fresh
                at = until
            merged += blocks[at:]
            self.tree = SegmentTree([b[0] for b in merged], [b[1] for b in merged])
        return len(ordered)


BLOCKS = "array<struct<chars:int,tokens:int>>"
_blocks = pa.list_(pa.struct([("chars", pa.int32()), ("tokens", pa.int32())]))


def _vocabulary(docs: DataFrame, path: str):
    with open(path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def count_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per row of `docs`: doc_id, text, n_tokens, blocks.  To be written, and kept for :func:`edit_counts`."""
    shared = _vocabulary(docs, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for batch in batches:
            found = [CountedText(text, counter) for text in batch.column(1).to_pylist()]
            blocks = pa.array([[{"chars": c, "tokens": t} for c, t in f.blocks] for f in found], _blocks)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f.tokens for f in found], pa.int64()), blocks], ["doc_id", "text", "n_tokens", "blocks"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, text string, n_tokens long, blocks {BLOCKS}")


def edit_counts(counted: DataFrame, edits: DataFrame | None = None, vocabulary: str = VOCABULARY, find: str | None = None, replacement: str = "") -> DataFrame:
    """One row per row of `counted`: doc_id, text, n_tokens, blocks (after the edits), n_before, n_edits, n_encoded.

    `edits`: doc_id, start, end (0-based characters, end exclusive), replacement.
    Without them, each match of the regular expression `find` is an edit.
    n_encoded is how many pre-tokens the edits made it encode again.
    """
    shared = _vocabulary(counted, vocabulary)
    rows = counted.select("doc_id", "text", "n_tokens", "blocks")
    if edits is None:
        rows = rows.withColumn("edits", F.lit(None).cast("array<struct<s:long,e:long,r:string>>"))
    else:
        each = F.struct(F.col("start").cast("long").alias("s"), F.col("end").cast("long").alias("e"), F.col("replacement").alias("r"))
        usable = edits.filter("doc_id is not null and start is not null and end is not null and replacement is not null")
        rows = rows.join(usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.collect_list(each).alias("edits")), "doc_id", "left").select("doc_id", "text", "n_tokens", "blocks", "edits")
    pattern = regex.compile(find) if find and edits is None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for batch in batches:
            texts, n, blocks, out = batch.column(1).to_pylist(), batch.column(2).to_pylist(), [], []
            for i, given in enumerate(batch.column(4).to_pylist()):
                changes = [(e["s"], e["e"], e["r"]) for e in given or ()]
                if pattern and texts[i]:
                    changes = [(*m.span(), replacement) for m in pattern.finditer(texts[i])]
                known = batch.column(3)[i]
                if not changes:
                    blocks.append(known.as_py())
                    out.append((n[i], n[i], 0, 0))
                    continue
                now = CountedText(texts[i], counter, [(b["chars"], b["tokens"]) for b in known.as_py() or ()])
                done = now.edit(changes)
                texts[i] = now.text
                blocks.append([{"chars": c, "tokens": t} for c, t in now.blocks])
                out.append((now.tokens, n[i], done, now.encoded))
            after, before, done, encoded = (pa.array(c, pa.int64()) for c in zip(*out, strict=True)) if out else [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), after, pa.array(blocks, _blocks), before, done, encoded], ["doc_id", "text", "n_tokens", "blocks", "n_before", "n_edits", "n_encoded"])

    return rows.mapInArrow(run, f"doc_id long, text string, n_tokens long, blocks {BLOCKS}, n_before long, n_edits long, n_encoded long")


def token_counts(
    docs: DataFrame,
    edits: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = VOCABULARY,
    find: str | None = None,
    replacement: str = "",
) -> DataFrame:
    """One row per row of `docs`: doc_id, n_tokens, n_edits, n_tokens_after, n_encoded.

    Counts the corpus, writes it with its trees, and applies the edits to what was written.
    """
    counted = materialize(count_corpus(docs, id_col, text_col, vocabulary), "counted")
    return edit_counts(counted, edits, vocabulary, find, replacement).select("doc_id", F.col("n_before").alias("n_tokens"), "n_edits", F.col("n_tokens").alias("n_tokens_after"), "n_encoded")
