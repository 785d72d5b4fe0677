"""The corpus operators against brute force, and on awkward tables."""

import hashlib
import math
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from graphloom.llm import contextmix, golay, langid, linededup, mixing, pii, quality, simhash, tokencount
from graphloom.llm.components import connected_components
from graphloom.llm.decontaminate import contaminated, smith_waterman, unsearchable
from graphloom.llm.exact_dedup import exact_dedup

DOC = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = "on the re da mi so la ti ka to ru ne vo pi".split()


def words(r, n):
    return [("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 3)))) for _ in range(n)]


def docs_of(spark, texts, langs=None, sources=None):
    rows = [(i, t, (langs or ["en"] * len(texts))[i], (sources or ["a"] * len(texts))[i], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


#: Nulls, empty and white texts, ties, repeated rows, clashing extra columns, a long text.
def awkward(spark):
    r = random.Random(3)
    long = "\n".join(" ".join(words(r, 40)) for _ in range(200))
    rows = [
        (1, "Hello there, General", "en", "a"), (1, "Hello there, General", "en", "a"), (2, "HELLO there, general", None, None), (3, None, "en", "b"), (4, "", "en", "b"), (5, " \t\n ", None, "a"),
        (None, "no id here", "en", "a"), (None, None, None, None), (6, long, "en", "c"), (7, long, "en", "c"), (8, long + " end", "fr", "c"), (9, "ÀÉ ß naïve café", "fr", "b"), (10, "12345 !!!", "en", "a"),
    ]
    clash = [(*x, 1, "k", 2.0, "h", 7, "t", True, "f") for x in rows]
    return spark.createDataFrame(clash, "doc_id long, text string, lang string, source string, size long, key string, score double, h string, component_id long, target string, held_out boolean, kept string")


def run_all(spark, docs, benchmark, labels):
    return {
        "exact": exact_dedup(docs), "lines": linededup.dedup_lines(docs), "tokens": tokencount.token_counts(docs, find="here", replacement="there"), "mix": mixing.mix_sources(docs), "pii": pii.pseudonymise_checked(docs, "k"),
        "lm": contextmix.score_documents(docs), "lang": langid.language_id(docs), "quality": quality.quality_scores(docs, labels), "simhash": simhash.simhash_groups(docs), "leaks": contaminated(docs, benchmark),
    }


def test_awkward_tables(spark):
    docs = awkward(spark)
    benchmark = spark.createDataFrame([(1, None, 0), (None, "x y z", 0), (2, "", 0), (3, docs.filter("doc_id = 6").first().text[:300], 0), (3, "too short", 0)], "item_id long, text string, doc_id long")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 1), (6, None, 0), (9, 0, 0), (9, 0, 0)], "doc_id long, quality int, toxic int")
    n = docs.count()
    for name, out in run_all(spark, docs, benchmark, labels).items():
        got = out.collect()
        assert name == "leaks" or len(got) == n, name
        if name == "exact":
            by = defaultdict(list)
            for r in got:
                by[r.text_sha256].append(r)
            assert all(sum(r.kept for r in g) == 1 and {r.group_size for r in g} == {len(g)} for g in by.values())
            assert {(r.doc_id, r.keep_id) for r in got if r.doc_id in (1, 2)} == {(1, 2), (2, 2)} and {r.keep_id for r in got if r.doc_id in (3, 4)} == {4}
        if name == "leaks":
            assert {r.doc_id for r in got} == {6, 7, 8} and {r.item_id for r in got} == {3} and all(r.score > 0.95 for r in got)
        if name == "lang":
            assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (3, 4, 5, 10))
        if name == "tokens":
            assert all(r.n_tokens == 0 for r in got if r.doc_id in (3, 4))
        if name == "pii":
            assert [r.text for r in got if r.doc_id == 3] == [None]
        if name == "simhash":
            assert {r.component_id for r in got if r.doc_id in (3, 4, 5)} == {3} and {r.fp for r in got if r.doc_id in (3, 4, 5)} == {0}
            assert {r.component_id for r in got if r.doc_id in (6, 7, 8)} == {6}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOC)
    benchmark, labels = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for name, out in run_all(spark, docs, benchmark, labels).items():
        assert out.collect() == [] and out.columns, name


@pytest.mark.parametrize("width", [64, 1])
def test_exact_dedup_with_collisions(spark, width):
    r = random.Random(1)
    texts = [r.choice(["a", "B", "b", "cc", "CC ", "ÄÖ", "äö"]) * r.randint(1, 2) for _ in range(200)]
    got = exact_dedup(docs_of(spark, texts).repartition(5), digest=lambda sha: F.substring(sha, 1, width)).collect()
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[t.translate(table)].append(i)
    want = {(i, max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    assert {tuple(x) for x in got} == want and len(got) == len(texts)


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, None), (7, 7)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    nodes = {x for a, b in edges if b is not None and a != b for x in (a, b)}
    assert got == {n: find(n) for n in nodes}


def test_golay():
    rem, errors = golay.tables()
    codewords = np.arange(4096) << 11 | rem
    r = np.random.default_rng(1)
    weights = np.bitwise_count(codewords[1:])
    assert weights.min() == 7 and len(np.unique(golay.index(codewords))) == 4096
    for w in range(4):
        for c in r.choice(codewords, 50):
            noise = sum(1 << int(i) for i in r.choice(23, w, replace=False))
            assert golay.index(np.array([c ^ noise]))[0] == c >> 11
    for _ in range(300):
        x = int(r.integers(0, 1 << 63)) * 2 + int(r.integers(0, 2))
        y = x
        for i in r.choice(64, int(r.integers(0, 4)), replace=False):
            y ^= 1 << int(i)
        rows, keys = golay.fuzzy_keys(np.array([x, y], dtype=np.uint64).view(np.int64))
        assert set(keys[rows == 0]) & set(keys[rows == 1])
        for i in r.choice(64, int(r.integers(0, 3)), replace=False):  # five bits apart at most
            y ^= 1 << int(i)
        rows, keys = golay.fuzzy_keys(np.array([x, y], dtype=np.uint64).view(np.int64), 5)
        assert set(keys[rows == 0]) & set(keys[rows == 1])


@pytest.mark.parametrize("block", [4096, 12])
def test_simhash_links(spark, block):
    """Groups of fingerprints against all pairs, with keys that must be split (block 12)."""
    r = np.random.default_rng(2)
    base = r.integers(0, 1 << 63, 12, dtype=np.uint64)
    prints = set(base.tolist())
    for b in base.tolist():
        x = b
        for _ in range(30):
            x ^= 1 << int(r.integers(0, 64)) | 1 << int(r.integers(0, 64))
            prints.add(x)
    prints = np.array(sorted(prints), dtype=np.uint64)
    frame = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    got = connected_components(simhash.fingerprint_links(frame, block)).collect()
    comp = {int(x): int(x) for x in prints.view(np.int64)} | {g.node: g.component for g in got}
    label = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if int(prints[i] ^ prints[j]).bit_count() <= 3 and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    signed = prints.view(np.int64).tolist()
    assert len({(comp[s], x) for s, x in zip(signed, label, strict=True)}) == len(set(label)) == len(set(comp.values()))


def test_simhash_documents(spark):
    r = random.Random(4)
    texts = [" ".join(words(r, r.choice([0, 1, 2, 3, 50, 300]))) for _ in range(120)]
    texts += [t.upper() if i % 2 else t + " tail" for i, t in enumerate(texts)] + ["One  Two", "one\ttwo"]

    def print_of(t):
        w = t.lower().split()
        s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    got = {x.doc_id: x for x in simhash.simhash_groups(docs_of(spark, texts)).collect()}
    prints = [print_of(t) for t in texts]
    assert all(got[i].fp & (1 << 64) - 1 == p for i, p in enumerate(prints))
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 and group[i] != group[j]:
                a, b = sorted((group[i], group[j]))
                group = [a if x == b else x for x in group]
    assert [got[i].component_id for i in range(len(texts))] == group
    big = " ".join(words(r, 300_000))
    assert simhash.fingerprint(big.encode()) == print_of_fast(big)


def print_of_fast(t):
    w = t.lower().split()
    h = np.array([xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(len(w) - 2)], dtype=">u8")
    return int.from_bytes(np.packbits(2 * np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0) > len(h)).tobytes(), "big")


def line_keys(line, similarity=0.8):
    """The keys of a normalised line, by hand."""
    words = list(dict.fromkeys(line.split(" ")))
    hashes = [xxhash.xxh64_intdigest(w, 42) for w in words]
    xor = lambda hs: __import__("functools").reduce(lambda a, b: a ^ b, hs, 0)
    out = set()
    for level in {max(0, math.floor(math.log2(len(words) * share / linededup.PER_BLOCK))) for share in (0.85, 1.18)}:
        blocks = defaultdict(list)
        for h in hashes:
            blocks[h % (1 << level)].append(h)
        out |= {(level, c, xor(b)) for c, b in blocks.items() if len(b) >= linededup.LEAST}
    if 1 < len(words) <= linededup.SHORT:
        most = int(len(line) * (1 - similarity) + 1e-9) + 1
        out |= {(-1, xor(hashes))} | {(-1, xor(hashes) ^ h) for w, h in zip(words, hashes, strict=True) if len(w) <= most}
    return out


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def similar(a, b):
    return levenshtein(a, b) <= int(max(len(a), len(b)) * 0.2 + 1e-9)


def groups_of(n, linked):
    group = list(range(n))
    for i in range(n):
        for j in range(i):
            if group[i] != group[j] and linked(i, j):
                a, b = sorted((group[i], group[j]))
                group = [a if x == b else x for x in group]
    return group


def edited_lines(r, n_base=60, n=50, edits=(0, 0, 1, 2)):
    base = [" ".join(words(r, r.choice([2, 5, 9, 30, 60]))) for _ in range(n_base)]
    texts = []
    for _ in range(n):
        lines = []
        for line in r.sample(base, 6):
            w = line.split(" ")
            for _ in range(r.choice(edits)):
                w[r.randrange(len(w))] = "".join(r.choice(SYLLABLES) for _ in range(3))
            lines.append(r.choice(["", "  "]) + " ".join(w).replace("on", r.choice(["on", "ON"])))
        texts.append("\n".join([*lines, "", lines[0]]))
    return texts


def test_line_dedup_against_brute_force(spark):
    """All pairs: the groups are those of similar lines that share a key (no key here has over 32 lines)."""
    texts = edited_lines(random.Random(9))
    got = {x.doc_id: x for x in linededup.dedup_lines(docs_of(spark, texts)).collect()}
    norm = lambda x: x.lower().strip()
    distinct = sorted({norm(x) for t in texts for x in t.split("\n") if norm(x)})
    keys = [line_keys(x) for x in distinct]
    n = [len(set(x.split(" "))) for x in distinct]
    need = lambda i, j: 1 + min(n[i], n[j]) // linededup.WORDS_A_BLOCK_MORE
    group = groups_of(len(distinct), lambda i, j: len(keys[i] & keys[j]) >= need(i, j) and similar(distinct[i], distinct[j]))
    where = dict(zip(distinct, group, strict=True))
    seen, dropped = set(), 0
    for i, t in enumerate(texts):
        keep = []
        for x in t.split("\n"):
            if norm(x) and where[norm(x)] in seen:
                dropped += 1
                continue
            seen.add(where.get(norm(x)))
            keep.append(x)
        assert got[i].text == "\n".join(keep), i
        assert got[i].n_lines == 8 and got[i].n_removed == 8 - len(keep)
    assert dropped > 150 and len(set(group)) < len(distinct)


def test_line_recall(spark):
    """Of all pairs at edit similarity 0.8 or more, whatever their keys, nine in ten at least are in one group."""
    texts = edited_lines(random.Random(19), 80, 90)
    distinct = sorted({" ".join(x.lower().split()) for t in texts for x in t.split("\n") if x.strip()})
    rows = spark.createDataFrame([(x,) for x in distinct], "norm string").withColumn("h", F.xxhash64("norm"))
    name = {x.h: x.norm for x in rows.collect()}
    found = {frozenset((name[p.a], name[p.b])) for p in linededup.verified_pairs(linededup.candidate_pairs(linededup.line_keys(rows), rows), rows, 0.8).collect()}
    close = lambda a, b: abs(len(a) - len(b)) <= 0.2 * max(len(a), len(b)) and len(set(a.split()) & set(b.split())) * 3 >= len(set(a.split()))
    true = {frozenset((a, b)) for i, a in enumerate(distinct) for b in distinct[:i] if close(a, b) and similar(a, b)}
    at = {x: i for i, x in enumerate(distinct)}
    linked = {frozenset((at[a], at[b])) for a, b in map(tuple, found)}
    group = groups_of(len(distinct), lambda i, j: frozenset((i, j)) in linked)
    assert len(true) > 150 and sum(group[at[a]] == group[at[b]] for a, b in map(tuple, true)) >= 0.9 * len(true) and all(similar(*p) for p in found)


def test_line_dedup_large_keys(spark):
    """Hundreds of variants of one line are one group, as all pairs would make them; unrelated lines stay."""
    r = random.Random(10)
    base = words(r, 80)
    lines = []
    for i in range(300):
        w = list(base)
        w[r.randrange(80)] = f"x{i}"
        lines.append(" ".join(w))
    other = [" ".join(words(r, 40)) for _ in range(40)]
    got = linededup.dedup_lines(docs_of(spark, lines + other)).collect()
    assert sorted(x.doc_id for x in got if x.text) == [0, *range(300, 340)]
    assert not any("Python" in p or "Arrow" in p for p in linededup.dedup_lines(docs_of(spark, other))._jdf.queryExecution().executedPlan().toString().split("\n"))


def test_line_pairs_of_large_keys(spark):
    """Of a key with many lines all pairs count, also such as do not stand beside each other in any order."""
    r = random.Random(31)
    block = lambda w: xxhash.xxh64_intdigest(w, 42) % 4
    names = lambda c, n: r.sample([w for w in {"".join(r.choice(SYLLABLES) for _ in range(4)) for _ in range(900)} if block(w) == c], n)
    common = names(0, 5)  # 20 words are four blocks: this one all lines share, whatever the others are
    lines, pairs = [], [("aa", "zz"), ("ab", "zy"), ("ac", "zx")]
    for first, last in pairs:
        rest = [w for c in (1, 2, 3) for w in names(c, 5)]
        for x in (first, last):  # another word in each of the other three blocks, one of them where the line begins, one where it ends
            w = list(rest)
            for c, at in ((1, 0), (2, 5), (3, 14)):
                w[at] = next(y for i in range(99) for y in [f"{x}{i}{x[::-1]}"] if block(y) == c)
            lines.append(" ".join([*w[:9], *common, *w[9:]]))
    lines += [" ".join([f"m{i:02}", *names(1, 4), *common, *names(2, 5), *names(3, 4), f"{i:02}m"]) for i in range(60)]
    keys = [line_keys(x) for x in lines]
    assert all(similar(lines[i], lines[i + 1]) and len(keys[i] & keys[i + 1]) == 1 and sum(keys[i] & keys[i + 1] <= k for k in keys) > 40 for i in (0, 2, 4))
    group = groups_of(len(lines), lambda i, j: bool(keys[i] & keys[j]) and similar(lines[i], lines[j]))
    got = linededup.dedup_lines(docs_of(spark, lines)).collect()
    assert {x.doc_id for x in got if x.text} == set(group) and len(set(group)) < len(lines)


def test_line_keys(spark):
    """Keys of lines of all lengths against those by hand: as many, and shared by the same lines."""
    r = random.Random(12)
    lines = [" ".join(words(r, n)) for n in (1, 2, 3, 8, 15, 17, 40, 700, 5000)]
    lines += [" ".join(w if i % 9 else "other" for i, w in enumerate(x.split(" "))) for x in lines]
    got = defaultdict(set)
    for x in linededup.line_keys(spark.createDataFrame(list(enumerate(lines)), "h long, norm string")).collect():
        got[x.h].add(x.key)
    want = [line_keys(x) for x in lines]
    assert all(len(got[i]) == len(w) for i, w in enumerate(want)) and all(len(got[i] & got[j]) == len(want[i] & want[j]) for i in range(len(lines)) for j in range(i))


def test_common_words_bring_no_lines_together(spark):
    """Lines that share only words that many lines hold share no large key; similar ones among them and variants of a template are found."""
    r = random.Random(41)
    word = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    common, template = [word(3) for _ in range(12)], [word(5) for _ in range(40)]
    prose = [r.sample([*common, *(word(8) for _ in range(16))], 28) for _ in range(700)]
    old = [r.choice([x for x in line if len(x) == 8]) for line in prose[:30]]
    edited = [[word(8) if w == x else w for w in line] for line, x in zip(prose, old, strict=False)]
    variants = [[*template[: i % 40], f"v{i}x", *template[i % 40 + 1 :]] for i in range(600)]
    frame = lambda lines: spark.createDataFrame([(" ".join(x),) for x in lines], "norm string").withColumn("h", F.xxhash64("norm"))
    rows = frame(prose + edited)
    assert linededup.shared_keys(linededup.line_keys(rows), rows)[0].agg(F.max("lines")).first()[0] <= 8
    group = {x.node: x.component for x in linededup.line_groups(rows).collect()}
    h = {x.norm: x.h for x in rows.collect()}
    pairs = [(h[" ".join(a)], h[" ".join(b)]) for a, b in zip(prose, edited, strict=False) if similar(" ".join(a), " ".join(b))]
    assert len(pairs) == 30 and all(group.get(a, a) == group.get(b, b) for a, b in pairs) and len(set(group.values())) == len(pairs)
    assert linededup.line_groups(frame(variants)).agg(F.count("node"), F.count_distinct("component")).first() == (600, 1)


def test_line_dedup_ties_of_ids(spark):
    """Null ids come last and are ordered among themselves; rows that share an id are different documents unless their texts agree."""
    shared = "one line that all of these documents share"
    rows = [(None, f"{shared}\nfirst"), (None, f"{shared}\nsecond"), (7, f"{shared}\nthird"), (7, f"{shared}\nfourth"), (7, f"{shared}\nfourth"), (None, "lonely line of nobody else here"), (None, "lonely line of nobody else here\nx")]
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = [x for x in got if shared in x.text]
    assert len(got) == 7 and all(x.doc_id == 7 for x in kept) and len({x.text for x in kept}) == 1 and len(kept) in (1, 2)
    assert sum("lonely" in x.text for x in got) == 1


def test_line_blanks(spark):
    """Lines that differ in runs of white space alone are one line, short ones too."""
    texts = ["one two three four five", "one  two three four five", "one two\tthree four five", "\tone two three \t  four five ", "red green blue black white"]
    assert [bool(x.text) for x in linededup.dedup_lines(docs_of(spark, texts)).orderBy("doc_id").collect()] == [True, False, False, False, True]


def test_line_distance_bounds(spark):
    """Bounds of the edit distance hold, and tell most lines of one vocabulary apart without it."""
    r, d = random.Random(31), SYLLABLES
    vocabulary = ["".join(r.choice(d) for _ in range(r.randint(1, 3))) for _ in range(400)] + ["größe", "z😀z", "."]
    line = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    pairs = [(line(n), line(n)) for n in (1, 2, 20, 60, 60, 60, 60, 60, 60, 60, 60)]
    for n in (1, 3, 30, 60, 100):
        for edits in (1, 2, 3, n // 12, n // 8, n // 5, n // 3):
            a = line(n)
            w = a.split(" ")
            for _ in range(edits):
                w[r.randrange(len(w))] = r.choice(["", "x", "other", line(2)])
            pairs.append((a, " ".join(x for x in w if x) or "x"))
    frame = spark.createDataFrame([(a, b) for a, b in pairs + [(b, a) for a, b in pairs]], "norm string, lead_norm string")
    exact = F.levenshtein("norm", "lead_norm")
    got = frame.select(exact.alias("d"), linededup._most(0.8).alias("most"), linededup._at_most().alias("top"), linededup._apart(0.8).alias("apart"), linededup._similar(0.8).alias("similar"), (F.length("norm") > 150).alias("long")).collect()
    assert all(x.top >= x.d and x.similar == (x.d <= x.most) and not (x.apart and x.similar) for x in got)
    near = [x.top <= x.most for x in got if x.long and x.d <= x.most / 3]
    assert len(near) >= 10 and sum(near) >= 0.9 * len(near)
    far = [x.apart for x in got if x.long and x.d > 2 * x.most]
    assert len(far) >= 10 and sum(far) >= 0.8 * len(far)


def test_line_distance_of_long_lines_is_quick(spark):
    """Copies of 30,000 characters with scattered edits: no edit distance of whole lines."""
    r = random.Random(32)
    w = ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 3))) for _ in range(6000)]
    other = [x if r.random() > 0.08 else "other" for x in w if r.random() > 0.02]
    frame = spark.createDataFrame([(" ".join(w), " ".join(other))], "norm string, lead_norm string")
    began = time.time()
    assert frame.select(linededup._similar(0.8).alias("ok")).first().ok
    assert time.time() - began < 12


def test_long_lines_are_verified_by_edit_similarity(spark):
    """Lines of over 4096 characters: scattered small changes, dropped words, and another line."""
    r = random.Random(17)
    base = [x + x for x in words(r, 800)]
    changed = [w[:-1] + "q" if i % 20 == 0 else w for i, w in enumerate(base)]
    fewer = [w for i, w in enumerate(base) if i % 12]
    rows = [(" ".join(base), " ".join(x)) for x in (changed, fewer, [x + x for x in words(r, 800)])]
    assert min(len(x) for row in rows for x in row) > 4096
    frame = spark.createDataFrame(rows, "norm string, lead_norm string").coalesce(1)
    assert [x.ok for x in frame.select(linededup._similar(0.8).alias("ok")).collect()] == [True, True, False]


def test_token_counts(spark):
    """Saved blocks, edited twice over, against encoding the whole edited text."""
    with open(tokencount.VOCABULARY, "rb") as f:
        counter = tokencount.Counter(f.read())
    count = lambda text: len(counter.encoding.encode_ordinary(text))
    r = random.Random(6)
    alphabet = "ab C'sre1 \n  .,é!"
    for _ in range(300):
        text = "".join(r.choice(alphabet) for _ in range(r.choice([0, 5, 100, 400, 1500])))
        counted = tokencount.CountedText(text, counter)
        assert counted.tokens == count(text)
        for _ in range(2):
            text = counted.text
            edits = [(s, s + r.randint(0, 9), "".join(r.choice(alphabet) for _ in range(r.randint(0, 5)))) for s in (r.randint(0, len(text)) for _ in range(r.choice([1, 4, 12])))]
            want, bound = text, len(text)
            for start, end, by in sorted(edits, reverse=True):
                start = max(0, min(start, bound))
                end = max(start, min(end, bound))
                want, bound = want[:start] + by + want[end:], start
            counted = tokencount.CountedText(text, counter, counted.blocks)
            counted.edit(edits)
            assert counted.text == want and counted.tokens == count(want) and sum(b[0] for b in counted.blocks) == len(want)
    counted = tokencount.CountedText("hello world, it's a test. " * 5000, counter)
    counted.edit([(r.randrange(130_000), 0, "xx yy") for _ in range(50)])
    assert counted.encoded < 50 * 6 * tokencount.LEAF and counted.tokens == count(counted.text)
    long, began = tokencount.CountedText("a b " * 100_000, counter), time.process_time()
    long.edit([(i, i + 1, "cc") for i in range(0, 400_000, 8)])
    assert long.tokens == count(long.text) and time.process_time() - began < 10
    docs = docs_of(spark, ["mail me@x.org now", "nothing", None])
    edits = spark.createDataFrame([(0, 5, 13, "YOU"), (1, None, 3, "x"), (9, 0, 1, "x"), (1, 50, 60, "!")], "doc_id long, start long, end long, replacement string")
    got = {x.doc_id: x for x in tokencount.token_counts(docs, edits).collect()}
    assert got[0].n_tokens_after == count("mail YOU now") and got[1].n_tokens_after == count("nothing!") and got[2].n_tokens == 0
    found = {x.doc_id: x for x in tokencount.token_counts(docs, find=r"@\S+", replacement="@host").collect()}
    assert found[0].n_edits == 1 and found[0].n_tokens_after == count("mail me@host now")
    # a batch of edits on what an earlier batch has left
    once = tokencount.edit_counts(tokencount.count_corpus(docs), find="me", replacement="you")
    twice = {x.doc_id: x for x in tokencount.edit_counts(once, find="now", replacement="then").collect()}
    assert twice[0].text == "mail you@x.org then" and twice[0].n_tokens == count(twice[0].text) and twice[0].n_before == count("mail you@x.org now")


def targets_by_rounds(sizes, share=1.5):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_ = {}, set(sizes)
    budget = share * sum(sizes.values())
    while open_:
        left = budget - sum(target.values())
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total >= 2 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        target |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over
    return target


def test_mixing(spark):
    r = random.Random(8)
    texts = [" ".join(words(r, r.randint(0, 60))) for _ in range(900)]
    sources = [r.choice(["b", "a", None, "é", "z", "a", "a"]) for _ in texts]
    docs = docs_of(spark, texts, sources=sources)
    got = mixing.mix_sources(docs).collect()
    sizes = Counter()
    for t, s in zip(texts, sources, strict=True):
        sizes[s] += len(t.split())
    want = targets_by_rounds(sizes)
    taken = Counter()
    for x in got:
        assert x.size == len(texts[x.doc_id].split()) and x.source_size == sizes[x.source] and x.target == pytest.approx(want[x.source]) and 0 <= x.taken <= 2 * x.size and x.taken == x.copies * x.size
        taken[x.source] += x.taken
    assert all(abs(taken[s] - want[s]) <= 120 for s in sizes) and sum(taken.values()) <= sum(want.values()) + 1e-3
    again = mixing.mix_sources(docs.repartition(7)).collect()
    assert {tuple(x) for x in got} == {tuple(x) for x in again}
    # the order of service by hand: finish times ascending, cut where the budget ends
    items = []
    for s in sizes:
        queue = sorted((x for x in got if x.source == s), key=lambda x: (hashlib.md5(f"mix:{x.doc_id}:{texts[x.doc_id]}".encode()).hexdigest(), x.doc_id))
        upto = 0
        for n in range(2):
            for x in queue:
                upto += x.size
                items.append((upto / x.target if x.target else 0, x.size, x.doc_id))
    items.sort()
    count, total = Counter(), 0
    for f in sorted({i[0] for i in items}):
        level = [i for i in items if i[0] == f]
        if total + sum(i[1] for i in level) > sum(want.values()) + 1e-6:
            break
        total += sum(i[1] for i in level)
        count.update(i[2] for i in level if i[1])
    assert {x.doc_id: x.copies for x in got if x.copies} == dict(count)


def test_mixing_reruns_agree(spark):
    """Null and repeated ids, with one text or several: what each is taken does not depend on how rows are dealt out."""
    r = random.Random(18)
    rows = [(r.choice([None, 1, 2]), " ".join(words(r, r.randint(0, 20))), r.choice("ab"), r.choice(["x", "y"])) for _ in range(300)]
    rows += [(None, "the same text again", "a", "x")] * 50 + [(5, "the same text again", None, r.choice("xy")) for _ in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    one, two = (sorted(map(str, mixing.mix_sources(d, keep=("text", "lang")).collect())) for d in (docs.coalesce(1), docs.repartition(6, "text")))
    plain = Counter((x.doc_id, x.size, x.taken) for x in mixing.mix_sources(docs.repartition(4)).collect())
    assert one == two and len(one) == len(rows) and plain == Counter((x.doc_id, x.size, x.taken) for x in mixing.mix_sources(docs, keep=("text", "lang")).collect())


def test_pii(spark):
    text = 'Mail nt.26@mail6.example.com, +1 (136) 555-7479%%% 212-555-0199 5927243073274351!! 4111 1111 1111 1111 and 10.20.30.40 v. 2001:db8::1 TOKEN = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"!! Mr. John Smith met Frau Petra Klein, then John Smith left. DE89 3704 0044 0532 0130 00. GPL version 3, CC 4.0, 1,000,000 of 2024-05-06.'
    out, found = pii.replace(text, b"k")
    kinds = Counter(e["kind"] for e in found)
    assert kinds == {"email": 1, "phone": 2, "card": 2, "ipv4": 1, "ipv6": 1, "secret": 1, "name": 3, "iban": 1}, kinds
    for private in ("nt.26@mail6", "555-7479", "555-0199", "5927243073274351", "4111 1111", "10.20.30.40", "2001:db8::1", "9233A8EC", "John", "Smith", "Petra", "Klein", "3704 0044"):
        assert private not in out
    assert "GPL version 3, CC 4.0, 1,000,000 of 2024-05-06." in out and out.startswith("Mail ")
    people = [e["surrogate"] for e in found if e["kind"] == "name"]
    assert people[0].removeprefix("Mr. ") == people[2] and people[0].split()[1] in pii.FIRST_NAMES["m", "latin"] and people[1].split()[1] in pii.FIRST_NAMES["f", "latin"]
    assert pii.luhn(next(e["surrogate"] for e in found if e["surrogate"].startswith(("1", "2", "3", "4", "5", "6", "7", "8", "9", "0")) and " " in e["surrogate"] and e["kind"] == "card"))
    assert pii.replace(text, b"k")[0] == out != pii.replace(text, b"other")[0]
    for m in (2, 3, 10, 97, 1000):
        image = [pii.permute(x, m, b"k", "l") for x in range(m)]
        assert sorted(image) == list(range(m)) and all(a != b for a, b in enumerate(image))
    names = pii.FIRST_NAMES["f", "cyrillic"]
    assert {pii.surrogate("firstf", n, b"k") for n in names} == set(names)
    r = random.Random(2)
    many = docs_of(spark, [" ".join(f"{r.randint(1, 255)}.{r.randint(0, 255)}.1.2 u{r.randint(0, 99)}@d{r.randint(0, 9)}.org {r.randint(10**15, 10**16 - 1)}" for _ in range(20)) for _ in range(40)])
    assert pii.entity_collisions(many, "k").isEmpty()
    got = pii.pseudonymise(many, "k").collect()
    assert all(x.n_entities == 60 for x in got)
    with pytest.raises(ValueError):
        pii.pseudonymise(many, "")


def test_pii_coreference():
    """However an entity is written, its surrogates are one entity; check digits, zeros, case and compression stay."""
    s = lambda kind, value: pii.surrogate(kind, value, b"k")
    phones = [s("phone", x) for x in ("(212) 555-0199", "212-555-0199", "2125550199", "+1 (212) 555 0199")]
    assert len({pii.digits_only(x.removeprefix("+1")) for x in phones}) == 1 and phones[0][0] == "(" and phones[3].startswith("+1 (")
    assert s("email", "Ann.Lee@Mail.org").casefold() == s("email", "ann.lee@mail.org") and s("email", "Ann.Lee@Mail.org")[0].isupper()
    assert pii.digits_only(s("card", "4111 1111 1111 1111")) == s("card", "4111111111111111") and pii.luhn(s("card", "4111111111111111"))
    right = s("iban", "DE89 3704 0044 0532 0130 00")
    plain = right.replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1 and [len(x) for x in right.split()] == [4, 4, 4, 4, 4, 2]
    wrong = s("iban", "DE88 3704 0044 0532 0130 00").replace(" ", "")
    assert wrong[4:] == plain[4:] and wrong[2:4] != plain[2:4]
    assert s("ipv4", "010.002.000.001") == ".".join(f"{int(x):03d}" for x in s("ipv4", "10.2.0.1").split("."))
    assert s("ipv6", "2001:DB8:0:0:0:0:0:1").count(":") == 7 and pii.canonical("ipv6", s("ipv6", "2001:DB8:0:0:0:0:0:1")) == pii.canonical("ipv6", s("ipv6", "2001:db8::1"))
    out, found = pii.replace("My name is Olu Adeyemi. Contact: Zed Quill. Then Adeyemi wrote to Quill and Nobody.", b"k")
    assert [e["kind"] for e in found] == ["name"] * 4 and "Nobody" in out and out.count(found[0]["surrogate"].split()[1]) == 2
    assert all(x not in out for x in ("Olu", "Adeyemi", "Zed", "Quill"))


def test_pii_brute_force():
    """Every string of a small format: surrogates are as many, of that format, and none is itself."""
    for kind, texts in (
        ("ssn", [f"{i:03d}" for i in range(100, 1000)]), ("phone", [f"{i}-{j}" for i in range(1, 10) for j in range(10)]), ("surname", [a + b for a in "aeiou" for b in "bcdfghjklmnpqrstvwxyz"]),
        ("secret", [a + b + "!" for a in "0123456789" for b in "xyzabc"]), ("card", [f"{i:04d}" for i in range(10000) if pii.luhn(f"{i:04d}")]), ("ipv4", [f"{i}.0.0.{j}" for i in range(30) for j in range(30)]),
    ):
        found = [pii.surrogate(kind, t, b"k") for t in texts]
        assert len(set(found)) == len(texts) and all(f != t for f, t in zip(found, texts, strict=True)), kind
        if kind in ("phone", "card", "ssn", "surname"):
            assert set(found) == set(texts), kind


@pytest.mark.parametrize("piece", ["a-", "a", "a.", "@", "a@", "1 ", "1-", "token-", "token=", "eyJaaaaaaaa-", "Mr. ", "A", "Aa ", "a:", "::", "0", "abcdef0123456789", "aaaa.bbbb@", "+1 (", "DE89 ", "sk-", "x@a.", "name: ", "("])
def test_pii_takes_linear_time(piece):
    began = time.process_time()
    pii.detect((piece * 60_000)[:60_000])
    assert time.process_time() - began < 1


def crc(i, m):
    return zlib.crc32(str(i).encode()) % m


def corpus(r, n):
    parts = {"en": "the of and ing tion er with th".split(), "fr": "é le la eau tion oi ç des qu".split(), "de": "ß sch ung der ein ö ü ch keit".split()}
    langs = [r.choice(list(parts)) for _ in range(n)]
    return [" ".join("".join(r.choice(parts[x]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(2, 60))) for x in langs], langs


def test_language_id(spark):
    r = random.Random(13)
    texts, langs = corpus(r, 600)
    docs = docs_of(spark, texts, [None if i % 50 == 0 else x for i, x in enumerate(langs)])
    got = langid.language_id(docs).collect()
    assert all(x.held_out == (crc(x.doc_id, 4) == 2) for x in got)
    held = [x for x in got if x.held_out]
    assert sum(x.lang_pred == langs[x.doc_id] for x in held) / len(held) > 0.97 and all(0 <= x.score <= 1 for x in got)
    model = langid.fit(docs)
    assert (model.weights == 0).mean() > 0.5  # L1 makes most weights exactly zero
    # labels of held-out rows must not matter
    flipped = docs.withColumn("lang", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, "xx").otherwise(F.col("lang")))
    assert {(x.doc_id, x.lang_pred) for x in langid.language_id(flipped).collect()} == {(x.doc_id, x.lang_pred) for x in got}


def test_ftrl_by_hand():
    """Weights against a dictionary of numbers, one at a time."""
    r = np.random.default_rng(3)
    rows = [(np.sort(r.choice(40, 6, replace=False)), r.random(6)) for _ in range(30)]
    labels = r.integers(0, 3, 30)
    got, bias = langid.ftrl(rows, labels, 3, l1=0.05, l2=0.5, epochs=2)
    z, n = defaultdict(float), defaultdict(float)

    def weight(i, k):
        x = z[i, k]
        shrunk = max(0.0, abs(x) - (0 if i == langid.DIM else 0.05)) * (1 if x > 0 else -1)
        return -shrunk / (1 + math.sqrt(n[i, k]) + 0.5)

    for _ in range(2):
        for (at, value), y in zip(rows, labels, strict=True):
            x = dict(zip(at.tolist(), value.tolist(), strict=True)) | {langid.DIM: 1.0}
            w = {(i, k): weight(i, k) for i in x for k in range(3)}
            e = [math.exp(sum(w[i, k] * v for i, v in x.items())) for k in range(3)]
            for i, v in x.items():
                for k in range(3):
                    g = v * (e[k] / sum(e) - (k == y))
                    z[i, k] += g - (math.sqrt(n[i, k] + g * g) - math.sqrt(n[i, k])) * w[i, k]
                    n[i, k] += g * g
    assert got[:40] == pytest.approx(np.array([[weight(i, k) for k in range(3)] for i in range(40)])) and bias == pytest.approx([weight(langid.DIM, k) for k in range(3)])
    assert (got[:40] == 0).any() and not got[40:].any()


def test_factorisation_machine_by_hand():
    """Training against plain loops over pairs of features."""
    r = np.random.default_rng(4)
    rows = [(np.sort(r.choice(30, 5, replace=False)), r.random(5)) for _ in range(12)]
    labels = r.integers(0, 2, 12).astype(float)
    got = quality.train(rows, labels, epochs=2)
    rng = np.random.default_rng(11)
    v = rng.normal(0, 0.02, (quality.DIM, quality.RANK))[:30].tolist()
    w, gw, gv, gb = [0.0] * 30, [1e-3] * 30, [[1e-2] * quality.RANK for _ in range(30)], 1.0
    bias = math.log(labels.mean() / (1 - labels.mean()))
    for _ in range(2):
        for j in rng.permutation(12):
            x = dict(zip(rows[j][0].tolist(), rows[j][1].tolist(), strict=True))
            pairs = sum(v[a][f] * v[b][f] * x[a] * x[b] for a in x for b in x if a < b for f in range(quality.RANK))
            error = 1 / (1 + math.exp(-(bias + sum(w[i] * q for i, q in x.items()) + pairs))) - labels[j]
            sums = [sum(v[i][f] * q for i, q in x.items()) for f in range(quality.RANK)]
            for i, q in x.items():
                g = error * q + 1e-5 * w[i]
                gw[i] += g * g
                w[i] -= 0.05 * g / math.sqrt(gw[i])
                for f in range(quality.RANK):
                    g = error * q * (sums[f] - v[i][f] * q) + 1e-5 * v[i][f]
                    gv[i][f] += g * g
                    v[i][f] -= 0.05 * g / math.sqrt(gv[i][f])
            gb += error * error
            bias -= 0.05 * error / math.sqrt(gb)
    assert got.bias == pytest.approx(bias) and got.linear[:30] == pytest.approx(w) and got.factors[:30] == pytest.approx(np.array(v))


def test_samples_are_bounded_by_rows(spark):
    """A null or repeated id takes no more than its share; rare classes are kept; repeated rows count once."""
    from graphloom.llm.common import sample_rows

    rows = [(None, f"t{i}", "common") for i in range(500)] + [(1, "same", "common")] * 200 + [(2, f"r{i}", "rare") for i in range(5)]
    frame = spark.createDataFrame(rows, "id long, text string, lang string").withColumn("order", F.xxhash64("id", "text"))
    got = Counter(x.lang for x in sample_rows(frame, "lang", "order", 40).collect())
    assert got == {"common": 40, "rare": 5}
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(300)] + [(3, "other")], "doc_id long, text string")
    assert quality.fit(docs, labels, train_rows=1).bias == pytest.approx(0, abs=0.5)


def test_quality(spark):
    r = random.Random(14)
    texts, _ = corpus(r, 500)
    label = [int(r.random() < 0.7) for _ in texts]
    texts = [t if y else " ".join(w.upper() + r.choice(["!!", "***", "$$$"]) for w in t.split()) for t, y in zip(texts, label, strict=True)]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, y, 0) for i, y in enumerate(label)], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(docs, labels).collect()
    held = [x for x in got if x.held_out]
    assert sum(x.predicted == label[x.doc_id] for x in held) / len(held) > 0.95 and all(x.predicted == (x.score >= 0.7) and 0 <= x.score <= 1 for x in got)
    # the sum-of-squares identity against all pairs
    fm = quality.train([quality.features(t) for t in texts[:50]], np.array(label[:50], float), epochs=1)
    at, value = quality.features(texts[3])
    pairs = sum(fm.factors[at[i]] @ fm.factors[at[j]] * value[i] * value[j] for i in range(len(at)) for j in range(i))
    assert fm.logit(at, value) == pytest.approx(fm.bias + value @ fm.linear[at] + pairs)


def test_decontamination(spark):
    r = random.Random(16)
    items = [words(r, r.randint(15, 40)) for _ in range(30)]
    texts, want = [], set()
    for i in range(120):
        w = words(r, r.randint(30, 200))
        if i % 3 == 0:
            item = i % 30
            copy = list(items[item])
            if i % 2:  # an edited copy: every ninth word differs, one is left out
                copy = ["changed" if j % 9 == 4 else x for j, x in enumerate(copy) if j != 7]
            at = r.randrange(len(w))
            w[at:at] = [x.upper() + "," for x in copy]
            want.add((i, item))
        texts.append(" ".join(w))
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = contaminated(docs_of(spark, texts), benchmark, block_bytes=1000).collect()
    assert {(x.doc_id, x.item_id) for x in got} == want
    assert all(x.score == 1 for x in got if x.doc_id % 2 == 0) and all(0.5 <= x.score < 1 for x in got if x.doc_id % 2)

    def plain(a, b):
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        return h.max()

    for _ in range(50):
        a, b = np.array([r.randrange(5) for _ in range(r.randint(1, 12))]), np.array([r.randrange(5) for _ in range(r.randint(0, 20))])
        score, start, end = smith_waterman(a, b)
        assert score == plain(a, b) == plain(a, b[start:end])


def test_decontamination_short_and_edited(spark):
    """Short items verbatim, passages where they are, copies edited at every third word, and recall of random edits."""
    r = random.Random(26)
    pool = words(r, 3000)
    items = [[r.choice(pool) for _ in range(r.randint(15, 40))] for _ in range(60)]
    items[0], items[1] = [f"rare{i}" for i in range(6)], ["on"]
    docs, where = [], {}
    for i in range(240):
        item, w = i % 60, [r.choice(pool) for _ in range(r.randint(30, 120))]
        copy = [x if r.random() > (0, 0.1, 0.2)[i // 60 % 3] else r.choice(pool) for x in items[item]] if i < 180 else [r.choice(pool) if j % 3 == 2 else x for j, x in enumerate(items[item])]
        at = r.randrange(len(w))
        docs.append(" ".join([*w[:at], *copy, *w[at:]]))
        where[i] = (item, at, copy)
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    frame = docs_of(spark, docs)
    got = {(x.doc_id, x.item_id): x for x in contaminated(frame, benchmark).collect()}
    assert (0, 0) in got and not any(k[1] == 1 for k in got) and 1 in unsearchable(frame, benchmark)
    whole = [(i, item, at, copy) for i, (item, at, copy) in where.items() if item > 1]
    for i, item, at, copy in whole:
        if i < 60:
            x = got[i, item]
            assert x.score == 1 and (x.window_start, x.window_end) == (at, at + len(copy))
    ids = {w: i for i, w in enumerate(pool)}
    code = lambda ws: np.array([ids.get(w, -1) for w in ws])
    due = [(i, item) for i, item, _, _ in whole if smith_waterman(code(items[item]), code(docs[i].split()))[0] >= len(items[item])]
    assert len(due) > 200 and sum(k in got for k in due) >= 0.98 * len(due)


def test_materialize_leaves_no_shuffle_files(spark):
    """What was shuffled for a table that is written leaves the disk, and the session's setting stays as it was."""
    import os

    from graphloom.llm import common

    folders = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    size = lambda: sum(os.path.getsize(os.path.join(at, f)) for d in folders for at, _, files in os.walk(d) for f in files if f.startswith("shuffle_"))
    before = size()
    out = common.materialize(spark.range(200_000).groupBy((F.col("id") * 7919 % 150_001).alias("k")).agg(F.count(F.lit(1)).alias("n")))
    for _ in range(50):
        if size() <= before:
            break
        time.sleep(0.1)
    assert size() <= before and out.agg(F.sum("n")).first()[0] == 200_000 and spark.conf.get(common.CLEANUP, None) is None
