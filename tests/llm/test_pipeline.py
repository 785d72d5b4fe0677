"""The pipeline's stages on small tables: each stage against what its operator's definition says of its own input."""

import random

import pytest

import corpus_pipeline as P
from graphloom.llm.queries import OP4_SQL
from tests.llm.test_operators import DOC, corpus, words


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(21)
    texts, langs = corpus(r, 300)
    item = " ".join(words(r, 30))
    rows = [(i, t, lang, r.choice(["a", "b", None]), len(t)) for i, (t, lang) in enumerate(zip(texts, langs, strict=True))]
    long = "\n".join(" ".join(words(r, 25)) for _ in range(8))
    rows += [(400, long, "en", "a", 0), (401, long.upper(), "en", "a", 0), (402, texts[0] + " " + item, langs[0], "a", 0), (None, texts[1] + " " + item, langs[1], "b", 0), (None, "ing tion the of and with er th", "en", None, 0), (403, "12 34 !!", "en", "a", 0), (404, None, None, None, None), (405, "", "en", "b", 0)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, DOC).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "decontamination", "mixing"] and P.ORACLE_SQL is None
    kept = P.language(spark, docs, folder)
    gone = {r.doc_id for r in docs.select("doc_id").collect()} - {r.doc_id for r in kept.collect()}
    assert {403, 404, 405} <= gone and len(gone) < 20 and kept.columns == P.COLUMNS
    lines = P.lines(spark, docs, folder)
    assert lines.count() == docs.count() and lines.columns == P.COLUMNS
    got = {r.doc_id: r for r in lines.collect()}
    assert got[400].text.count("\n") == 7 and "\n" not in got[401].text and got[401].n_chars == len(got[401].text) and got[404].text is None
    near = {r.doc_id for r in P.near_copies(spark, docs, folder).collect()}
    assert 400 in near and 401 not in near and 404 in near and 405 not in near
    clean = P.decontaminate(spark, docs, folder).collect()
    assert 402 not in {r.doc_id for r in clean} and sum(r.doc_id is None for r in clean) == 1 and len(clean) == docs.count() - 2
    mixed = P.mix(spark, docs, folder).collect()
    assert all(r.copies in (1, 2) and r.taken == r.copies * r.size for r in mixed)
    final = P.run(spark, folder)
    assert {"doc_id", "text", "copies"} <= set(final.columns) and {r.doc_id for r in final.collect()}.isdisjoint({401, 402, 403, 404, 405})


def test_near_copies_keep_one_row(spark):
    """Repeated rows become one; of two texts with one id each is judged by itself; similar texts by five-word shingles, not by fingerprints alone."""
    r = random.Random(22)
    base = words(r, 300)
    near = [*base[:150], "changed", *base[151:]]
    other = words(r, 300)
    rows = [(5, " ".join(base), "en", "a", 1), (3, " ".join(near), "en", "a", 1), (3, " ".join(other), "en", "a", 1), (9, "rep eat ed", "en", "a", 1), (9, "rep eat ed", "en", "a", 1), (9, "rep eat ed", "fr", "b", 1), (None, "REP eat ed", None, None, None), (None, None, None, None, None), (None, "", None, None, None)]
    got = P.near_copies(spark, spark.createDataFrame(rows, DOC), "").collect()
    assert {(x.doc_id, x.text) for x in got} >= {(3, " ".join(near)), (3, " ".join(other)), (9, "rep eat ed")} and len(got) == 4
    sets = [set(zip(*(t[i:] for i in range(5)))) for t in (base, near)]
    assert len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1])


def test_empty(spark, tmp_path):
    spark.createDataFrame([], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []


def test_mixing_sql(spark, folder):
    import duckdb

    from graphloom.llm.mixing import mix_sources

    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id is not null")
    db = duckdb.connect()
    db.register("documents", docs.toPandas())
    want = {tuple(r) for r in db.execute(f"SELECT doc_id, size, source_size, round(target, 6), taken FROM ({OP4_SQL})").fetchall()}
    got = {(r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in mix_sources(docs).collect()}
    assert got == want
