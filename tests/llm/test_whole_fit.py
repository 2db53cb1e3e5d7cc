"""Models are fitted on all rows of their tables, however many there are."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import p03_quality as p3
from textloom.llm import p04_residue as p4
from textloom.llm import p06_main_content as p6
from textloom.llm import p10_subjects as p10
from textloom.llm import queries as Q
from textloom.llm.text import hash64

PAGE = "page_id long, url string, title string, headings array<struct<level: int, text: string>>, text string, source string, site string"


def _name(k):
    return "".join(chr(97 + (k * m + k // 26) % 26) for m in (3, 5, 7, 11, 15))


def _body(k):
    return [f"Sentence of {_name(k)} tells at length about the things of {_name(k + 7)}.", f"Another sentence has {_name(2 * k + 1)} in it, and only this page has it."]


# 6


def test_line_model_equals_a_fit_on_all_pages(spark, data):
    pages = Q._crawled(spark, data)
    frame = p6.page_frame(pages)
    got = p6.learned(p6.read_pages(pages, frame))
    rows = p6.with_frame(pages, frame).collect()
    want = p6.fit([(r.site, r.title, p6._headings([h.asDict() for h in r.headings] if r.headings is not None else None), r.text, set(r.lines or ()), r.large) for r in rows if r.text])
    assert want.openers and got.openers == {hash64(f) for f in want.openers}
    assert got.followers == {hash64(f): tell for f, tell in want.followers.items()}
    assert got.weight == pytest.approx(want.weight) and got.bias == pytest.approx(want.bias)
    assert got.common and got.common == want.common
    assert got.trigram == pytest.approx(want.trigram) and got.odd_below == pytest.approx(want.odd_below)


def test_rare_link_blocks_of_a_large_site_are_learned(spark):
    rows = []
    for k in range(600):
        links = ["Elsewhere"] + [f"{_name(31 * k + j)} {_name(17 * k + j)}" for j in range(3)] if k % 100 == 0 else []
        rows.append((k, f"u{k}", None, None, "\n".join(["Home", "Pricing", *_body(k), *links, "All rights reserved by us."]), None, "s"))
    found = {tuple(r) for r in p6.boilerplate_lines(spark.createDataFrame(rows, PAGE)).collect()}
    assert {(k, i) for k in range(0, 600, 100) for i in range(4, 8)} <= found
    assert not {(k, i) for k in range(600) for i in (2, 3)} & found


# 3


def test_kinds_are_fitted_on_the_lines_of_all_pages(spark, monkeypatch):
    told = []
    learn = p3.learn_kinds

    def spy(x, label, *args, lines=None, **kwargs):
        told.append(len(x) if lines is None else lines.sum())
        return learn(x, label, *args, **kwargs) if lines is None else learn(x, label, *args, lines=lines, **kwargs)

    monkeypatch.setattr(p3, "learn_kinds", spy)
    rows = [(k, f"u{k}", None, None, "\n".join(_body(k)), "blog", "s") for k in range(600)]
    assert p3.quality(spark.createDataFrame(rows, PAGE)).filter("kind is null").count() == 600
    assert told == [1200]


# 4


def test_residue_model_equals_a_fit_on_all_passages(spark, data):
    pages, fields = Q._docs_and_community(spark, data)
    records = pages.select("page_id", "title", "text", "headings", fields.alias("fields"))
    coded, models = p4.fitted(records)
    scored = coded.mapInArrow(p4._records(p4._gains(models)), "page_id long, field string, best double, positive boolean, ordinary boolean, mostly boolean").cache()
    for field in p4.FIELDS:
        passages, trusted, settled, record = [], [], [], []
        for r in records.filter(F.array_contains("fields", field)).collect():
            value = r.text if field == "text" else r.title
            if value and not value.isspace():
                p4.add_record(r.title, r.text, [h.asDict() for h in r.headings or ()], field, passages, trusted, settled)
                record += [r.page_id] * (len(passages) - len(record))
        want = p4.learn(passages, trusted, settled)
        got = models[field]
        assert any(trusted) and got.vocabulary == want.vocabulary and (got.pair_keys == want.pair_keys).all()
        assert got.word_gain == pytest.approx(want.word_gain) and got.pair_gain == pytest.approx(want.pair_gain) and got.prior == pytest.approx(want.prior)
        cut = p4.cut_of(want.scores(passages), np.array(record), np.array(trusted), np.array(settled), p4.LEAST_CUT[field])
        assert p4._cut_over(scored, field) == pytest.approx(cut)


def test_words_of_all_records_are_learned(spark):
    rows = [(k, "t", None, f"{_name(k // 2)} " + "long enough to be ordinary text of the site " * 11) for k in range(4600)] + [(9999, "t", None, "503 Service Unavailable")]
    records = spark.createDataFrame(rows, "page_id long, title string, headings array<struct<level: int, text: string>>, text string").withColumn("fields", F.array(F.lit("text")))
    assert {_name(k) for k in range(2300)} <= p4.fitted(records)[1]["text"].vocabulary.keys()


# 10


def test_subject_model_equals_a_fit_on_all_documents(spark, data):
    docs, labels, subjects = Q._subject_tables(spark, data)
    whole, got = p10.fitted(docs, labels, subjects)
    apart, told = {r.doc_id for r in whole.filter("apart").collect()}, {}
    for r in labels.filter("doc_id is not null and subject is not null").collect():
        told.setdefault(r.doc_id, set()).add(r.subject.strip().lower())
    rows = [(r.doc_id, p10.sentence_tokens(r.text), frozenset(told.get(r.doc_id, set()) & set(got.subjects))) for r in docs.collect()]
    want = p10._train([(s, own) for k, s, own in rows if k not in apart], got.subjects, p10.ROUNDS)
    assert apart and apart < told.keys()
    number = {hash64(w): k for w, k in want.vocabulary.items()}
    assert got.words.view(np.int64).tolist() and number.keys() == set(got.words.view(np.int64).tolist())
    to, size = np.array([0, *(number[h] for h in got.words.view(np.int64).tolist())]), len(number) + 1
    keys = to[got.pair_keys // size] * size + to[got.pair_keys % size]
    assert (np.sort(keys) == want.pair_keys).all()
    assert got.gains[:size] == pytest.approx(want.word_gain[to], abs=1e-3)
    assert got.gains[size:] == pytest.approx(want.pair_gain[np.searchsorted(want.pair_keys, keys)], abs=1e-3)
    assert got.margin == p10._calibrate(want, [(s, own) for k, s, own in rows if k in apart])


def test_words_of_all_labelled_documents_are_learned(spark):
    subject = lambda n: ("law", "sport")[n % 2]
    text = lambda n: f"Yesterday they spoke of place{n} and of place{n} again. The weather was fine on that day. Nobody knew what came next."
    rows = [(4 * n + k, text(n)) for n in range(2000) for k in range(4)]
    labels = [(4 * n + k, subject(n), None) for n in range(2000) for k in range(3)]
    found = p10.document_subjects(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, subject string, annotator string"), spark.createDataFrame([("law", ""), ("sport", "")], "subject string, description string"))
    found = {(r.doc_id, r.subject) for r in found.filter("doc_id % 4 = 3").collect()}
    assert len(found & {(4 * n + 3, subject(n)) for n in range(2000)}) >= 1900
