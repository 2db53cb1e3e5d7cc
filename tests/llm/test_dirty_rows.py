"""Every operator over empty tables, NULLs in any column, long and empty texts, repeated rows, clashing extra columns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from textloom.llm import p01_token_budget as p1
from textloom.llm import p02_near_duplicates as p2
from textloom.llm import p03_quality as p3
from textloom.llm import p04_residue as p4
from textloom.llm import p05_splitting as p5
from textloom.llm import p06_main_content as p6
from textloom.llm import p07_repeated_lines as p7
from textloom.llm import p08_packing as p8
from textloom.llm import p09_contamination as p9
from textloom.llm import p10_subjects as p10

PAGE = "page_id long, url string, title string, headings array<struct<level: int, text: string>>, text string, source string, site string"
CHUNK = "id string, text string, metadata struct<url: string, title: string, section: string, chunk_index: int, source: string>, lang string, indexed_at timestamp"
DOC = "doc_id long, text string, lang string"
PROSE = "The quick brown fox reads a long book about foxes and other animals. It is quite a good book, all told. "
LONG = PROSE * 3000
CLASH = ("line_no", "line_key", "rep", "n", "salt", "lines", "mark", "labels", "part", "shard", "tokens", "key", "signature", "host")


def _clashing(df):
    return df.withColumns({c: F.lit("clash") for c in CLASH if c not in df.columns})


@pytest.fixture(scope="module")
def pages(spark):
    rows = [
        (1, None, None, None, None, None, None),
        (2, "u", "", [], "", None, "s"),
        (3, "u", "t", [(None, None), (2, "h")], LONG, None, "s"),
        (4, "u", "t", None, "x" * 200_000, None, "s"),
        (5, "u", "t", [], PROSE * 6, None, None),
        (5, "u", "t", [], PROSE * 6, None, None),
        (6, "u", "t", [], PROSE * 6, None, "s"),
        (7, "u", "t", [], " \n\t\n ", None, "s"),
        (8, "u", "t", [], "a퟿\u0000b \U0001f600 " * 40, None, "s"),
        (None, "u", "t", [], PROSE * 6, None, "s"),
    ]
    return _clashing(spark.createDataFrame(rows, PAGE))


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [
        ("a", None, None, None, None),
        ("b", "", ("u", None, None, None, None), "EN-us", None),
        ("c", LONG[:30_000], ("u", "t", "s", 1, "blog"), "de", None),
        ("c", LONG[:30_000], ("u", "t", "s", 1, "blog"), "de", None),
        ("d", "y" * 9001, ("u", "t", "s", 0, None), None, None),
        (None, LONG[:9000], ("u", "t", "s", 3, None), "en", None),
        ("e", "short", ("u", "t", "s", 2, None), "en", None),
    ]
    return _clashing(spark.createDataFrame(rows, CHUNK))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, None, None), (2, "", "en"), (3, LONG, "en"), (4, "z" * 100_000, None), (5, PROSE, "en"), (5, PROSE, "en"), (6, "日本語の文章です。" * 50, "ja"), (None, PROSE, "en")]
    return _clashing(spark.createDataFrame(rows, DOC))


def test_pages(pages):
    pairs = {tuple(r) for r in p2.similar_pairs(pages).collect()}
    assert pairs == {(3, 5), (3, 6), (5, 6)}  # the long text repeats the same sentences
    groups = {r.page_id: (r.class_id, r.group_id) for r in p2.groups(pages).collect()}
    assert groups[5] == groups[6] == groups[3] and groups[4 if 4 in groups else 5] is not None and 1 not in groups and 2 not in groups
    quality = {r.page_id: r for r in p3.quality(pages).collect()}
    assert set(quality) == {1, 2, 3, 4, 5, 6, 7, 8} and quality[1].words == 0 and quality[1].kind is None and quality[3].kind is None
    assert {r.page_id for r in p4.residue(pages, "text").collect()} <= {4, 8} and p4.residue(pages, "title").count() <= 1
    assert p4.without_residue(pages, F.array(F.lit("text"))).count() >= 6
    assert all(r.page_id is not None for r in p6.boilerplate_lines(pages).collect())
    bodies = {r.page_id: r.body for r in p6.main_bodies(pages).collect()}
    assert bodies[1] is None and bodies[2] == "" and PROSE.strip() in bodies[3]
    assert p7.repeated_lines(pages).isEmpty()
    clean = {(r.page_id, r.lines_cut) for r in p7.without_repeated_lines(pages).collect()}
    assert (1, 0) in clean and (3, 0) in clean


def test_chunks(chunks):
    tokens = {r.id: r for r in p1.chunk_tokens(chunks).collect()}
    assert set(tokens) == {"a", "b", "c", "d", "e"} and tokens["a"].tokens == 0 and tokens["a"].source == "docs"
    assert tokens["b"].language == "en" and tokens["a"].language == "und" and tokens["c"].tokens > 1000
    total = {(r.dimension, r.value): r.chunks for r in p1.totals(chunks).collect()}
    assert total[("source", "docs")] == 4 and total[("source", "blog")] == 1
    numbered = p5.renumbered(chunks).orderBy("chunk_index").collect()
    assert {r.id for r in numbered} == {"a", "b", "c", "d", "e"} and all((r.text is None) == (r.id in "abe") for r in numbered)
    mine = [r.chunk_index for r in numbered if r.id in "bcde"]
    assert sorted(mine) == list(range(len(mine)))
    parts = [r for r in numbered if r.text is not None]
    assert {r.id for r in parts} == {"c", "d"} and all(len(r.text) <= 4000 for r in parts)
    # a (no number) comes first in its own page; in page u the pieces of d (0), then c (1), then e
    mine = [r.chunk_index for r in parts]
    assert mine == sorted(set(mine)) and mine[-1] - mine[0] == len(mine) - 1
    assert {r.id for r in p5.oversized_pieces(chunks).select("id").distinct().collect()} == {"c", "d"}


def test_documents(spark, docs):
    packed = p8.packed(docs, 512).collect()
    assert {r.doc_id for r in packed} == {1, 2, 3, 4, 5, 6} and all(r.tokens <= 512 for r in packed)
    items = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (3, PROSE, "s"), (3, PROSE, "s"), (None, PROSE, "s")], "item_id long, text string, suite string")
    assert {tuple(r) for r in p9.contaminated(docs, items).collect()} == {(3, 3), (5, 3)}
    assert {r.item_id: r.documents for r in p9.leaked_items(docs, items).collect() if r.item_id} == {1: 0, 2: 0, 3: 2}
    labels = spark.createDataFrame([(5, " ANIMALS", None), (5, "animals", "x"), (None, "animals", "x"), (3, None, "x"), (3, "unknown", "x")], "doc_id long, subject string, annotator string")
    subjects = spark.createDataFrame([("animals", None), (None, None), ("tools", "")], "subject string, description string")
    found = p10.document_subjects(docs, labels, subjects).collect()
    assert all(r.subject in ("animals", "tools") and r.doc_id is not None for r in found)
    assert p10.composition(docs, labels, subjects).count() <= 2


def test_empty_tables(spark, pages, chunks, docs):
    none, no_chunks, no_docs = pages.limit(0), chunks.limit(0), docs.limit(0)
    items = spark.createDataFrame([], "item_id long, text string, suite string")
    labels = spark.createDataFrame([], "doc_id long, subject string, annotator string")
    subjects = spark.createDataFrame([], "subject string, description string")
    for result in (
        p1.totals(no_chunks), p2.similar_pairs(none), p2.groups(none), p3.quality(none), p4.residue(none, "text"), p4.residue(none, "title"), p5.renumbered(no_chunks),
        p6.boilerplate_lines(none), p7.without_repeated_lines(none), p8.packed(no_docs), p9.contaminated(no_docs, items), p9.contaminated(docs, items),
        p10.document_subjects(no_docs, labels, subjects), p10.document_subjects(docs, labels, subjects),
    ):
        assert result.isEmpty()
