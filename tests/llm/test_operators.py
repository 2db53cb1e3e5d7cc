"""Operators against brute force, exact round trips and held-out rows of the small test tables."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

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
from textloom.llm import queries as Q
from textloom.llm.page_lines import tokens
from textloom.llm.text import WordIds, fold, word_hashes, words


def _table(spark, data, name):
    return spark.read.parquet(f"{data}/{name}.parquet")


# 1


def test_estimates_are_close_on_rows_that_were_not_fitted(spark, data):
    rows = _table(spark, data, "chunk").select("id", "text").dropDuplicates(["id"]).collect()
    enc = p1.encoder()
    true = {r.id: len(enc.encode_ordinary(r.text or "")) for r in rows}
    got = {r.id: r.tokens for r in Q.p1_chunk_tokens(spark, data).collect()}
    assert set(got) == set(true)
    assert abs(sum(got.values()) / sum(true.values()) - 1) < 0.02
    assert np.mean([abs(got[k] - true[k]) / max(1, true[k]) for k in true]) < 0.08


def test_byte_features(spark):
    import pyarrow as pa

    x = p1.features(pa.array(["Ab1 é", None, "", "日本"]))
    assert x[0, 1] == 6 and x[0, 2:6].tolist() == [1, 1, 1, 1] and x[1, 1] == x[2, 1] == 0 and x[3, 2 + 7] == 2
    assert (p1.features(pa.array(["zz", "Ab1 é", "q"]).slice(1, 1))[0] == x[0]).all()


# 2


def test_pairs_equal_brute_force(spark, data):
    rows = [(r.page_id, words(r.text)) for r in _table(spark, data, "raw_page").filter("source is null or source = 'github'").select("page_id", "text").collect()]
    sets = {p: set(zip(w, w[1:], w[2:])) for p, w in rows if len(w) >= 50}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    assert want and {tuple(r) for r in Q.p2_found(spark, data).collect()} == want
    parent = {p: p for p in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in want:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r.page_id: r.group_id for r in Q.p2_groups(spark, data).collect()}
    assert got == {p: root(p) for p in sets}


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 600).astype(np.uint64))
    b = np.unique(np.concatenate([a[:450], rng.integers(0, 2**63, 150).astype(np.uint64)]))
    shared = sum(x == y for x, y in zip(p2.byte_signature(a), p2.byte_signature(b)))
    assert shared >= p2.least_matches(len(np.intersect1d(a, b)) / len(np.union1d(a, b)))


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 101)], "a long, b long")
    assert {r.id: r.group for r in p2.components(links).collect()} == {**{k: 1 for k in range(1, 41)}, 100: 100, 101: 100}


# 3 and 6


PROSE = "We looked at the report again and the numbers did not change for the third time."


def test_labels_of_lines():
    model = p3.LineModel(common=frozenset("we at the and did not for".split()))

    def kind(text):
        lines = text.split("\n")
        words = [tokens(x) for x in lines]
        kinds = p3.settle([p3.kind_of(x, False, w, model) for x, w in zip(lines, words)], lines, words)
        odd = [p3.NAMES.get(k) for k in kinds]
        return max(set(odd), key=odd.count)

    assert kind("\n".join([PROSE] * 5)) is None
    assert kind("\n".join(f"- item {k} name" for k in range(9))) == "list"
    assert kind("\n".join(f"a{k}\tb\t{k}\tok" for k in range(9))) == "table"
    assert kind("\n".join(f"| a{k} | b | {k} |" for k in range(9))) == "table"
    assert kind("\n".join(f"a{k:<10}    b         {k:<8}    ok" for k in range(9))) == "table"
    assert kind("\n".join(["Zm9vYmFyYmF6" * 5] * 4)) == "junk"
    assert kind("\n".join(["wort wort wort wort wort wort"] * 4)) == "junk"
    assert kind("\n".join(["?%$&/()=*+#!" * 3] * 4)) == "junk"
    assert kind("\n".join([PROSE] * 6 + ["- a b", "- c d"])) is None


def test_alignment_of_neighbouring_lines():
    counts = np.array([p3.field_counts(x) for x in ("a\tb", "c\td", "e\tf", "plain")])
    same = p3.aligned(counts)
    assert same[0, 0] > 0.6 and same[3].max() == 0 and p3.aligned(counts[:1]).max() == 0
    assert p3.gap_columns(["ab   cd", "ef   gh", "x y"]).tolist() == [1.0, 1.0, 0.0]


def test_statistics_of_layout():
    assert p3.autocorrelation([10, 50] * 6)[0] == 2 and p3.autocorrelation([10, 50] * 6)[1] > 0.7
    assert p3.indent_period(["a", "  b", "a", "  b"]) == 2 and p3.indent_period(["a", "b"]) == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.floats(-5, 5, allow_nan=False), max_size=9))
def test_regions_have_the_largest_score(scores):
    def worth(keep):
        borders = sum(a != b for a, b in zip(keep, keep[1:]))
        return sum(s for s, k in zip(scores, keep) if k) - p6.BORDER * borders

    best = max(worth([bool(m >> i & 1) for i in range(len(scores))]) for m in range(1 << len(scores)))
    assert worth(p6.content_regions(scores)) == pytest.approx(best)


def test_standing_lines_go_and_the_body_stays(spark):
    body = lambda k: "\n".join([f"Title {k}", f"Sentence number {k} of this page tells about the things of {k} at length.", "ERROR x: failed (code 5)", f"Heading {k}", f"Another sentence {k} that only this page has, and it is long enough."])
    menu, foot = "Home\nProducts\nPricing", "Was this page helpful? Yes / No\n© 2024 Some Company. All rights reserved."
    names = ["".join(chr(97 + (k * m) % 26) for m in (3, 5, 7, 11)) for k in range(40)]
    rows = [(k, f"Title {n}", [(2, f"Heading {n}")], f"{menu}\n{body(n)}\n{foot}", None, "s") for k, n in enumerate(names)]
    pages = spark.createDataFrame(rows, "page_id long, title string, headings array<struct<level: int, text: string>>, text string, source string, site string")
    assert {r.page_id: r.body for r in p6.main_bodies(pages).collect()} == {k: body(n) for k, n in enumerate(names)}
    assert p6.boilerplate_lines(pages).count() == 40 * 5


# 4


def test_residue_is_told_from_talk_about_it(spark):
    talk = "A status of 404 means that the requested page was not found on the server. Write `{{x.name}}` in a template to insert a value. " + PROSE
    rows = [(k, f"About topic{k}", [(2, "h")], f"About topic{k}\n{talk} {PROSE} {k}\n" + f"{PROSE} {k}. " * 8) for k in range(60)]
    bad = {100: "404\nWe could not find /docs/x. It may have moved.", 101: "503 Service Unavailable\nPlease try again later.", 102: "You need to enable JavaScript to run this.", 103: f"About\n{PROSE} Contact {{{{team}}}} for help. " + PROSE * 9, 104: "Lorem ipsum dolor sit amet ipsum lorem.", 105: "We could not find /docs/other. It may have moved. 404"}
    rows += [(k, "About", None, v) for k, v in bad.items()]
    pages = spark.createDataFrame(rows, "page_id long, title string, headings array<struct<level: int, text: string>>, text string")
    assert {r.page_id for r in p4.residue(pages, "text").collect()} == set(bad)


def test_residue_titles(spark):
    posts = [(k, f"Error 503 when service{k} reads records, how to fix it?", f"Error 503 when service{k} reads records, how to fix it?\nThe service{k} reads records and fails.") for k in range(60)]
    bad = {100: "Untitled", 101: "undefined", 102: "Re: <%= subject %>", 103: "404 - page", 104: "Untitled document"}
    rows = posts + [(k, v, f"{v}\nThe service reads records and fails.") for k, v in bad.items()]
    pages = spark.createDataFrame([(a, b, None, c) for a, b, c in rows], "page_id long, title string, headings array<struct<level: int, text: string>>, text string")
    assert {r.page_id for r in p4.residue(pages, "title").collect()} == set(bad)


# 5


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from(["Alpha beta gamma. ", "delta\n", "\n\n", "epsilon", " ", "日本語。", "x" * 90]), min_size=1, max_size=120), st.integers(80, 200), st.integers(0, 30))
def test_pieces_give_the_text_back(parts, limit, overlap):
    text = "".join(parts)
    spans = p5.split(text, limit, overlap)
    assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert all(0 < e - s + overlap * (i > 0) <= limit for i, (s, e) in enumerate(spans)) or len(text) <= limit
    whole = p5.pieces("Head\n\n" + text, limit + 40, overlap)
    assert all(len(p) <= limit + 40 for p, _, _ in whole)
    assert "".join(("Head\n\n" + text)[s:e] for _, s, e in whole).endswith(text)


def test_cuts_fall_where_the_topic_changes():
    a = "The goalkeeper caught the ball before the referee stopped the match. "
    b = "Interest rates and bond yields moved the quarterly budget upwards. "
    text = a * 9 + b * 9
    assert p5.split(text, 900, 0)[0][1] == len(a * 9)


def test_depths_do_not_depend_on_stretches(monkeypatch):
    rng = random.Random(3)
    text = ". ".join(" ".join(rng.choices("alpha beta gamma delta epsilon zeta theta".split(), k=6)) for _ in range(300))
    cuts = p5.boundaries(text)
    strong = cuts[0][cuts[1] < 3]
    want = p5.valley_depths(text, strong)
    monkeypatch.setattr(p5, "STRETCH", 40)
    assert np.allclose(p5.valley_depths(text, strong), want)


def test_chunk_numbers_run_on(spark, data, monkeypatch):
    monkeypatch.setattr(p5, "RANGE", 3)
    chunks = _table(spark, data, "chunk")
    whole = [r for r in p5.renumbered(chunks).collect()]
    rows = [r for r in whole if r.text is not None]
    count = defaultdict(int)
    for r in rows:
        count[r.id] += 1
    last = {r.id: r for r in chunks.orderBy("indexed_at").collect()}
    offset = {}
    by_url = defaultdict(list)
    for r in last.values():
        by_url[r.metadata.url].append((r.metadata.chunk_index, r.id))
    for own in by_url.values():
        at = 0
        for _, i in sorted(own):
            offset[i] = at
            at += count.get(i, 1)
    assert rows and all(r.chunk_index == offset[r.id] + r.piece for r in rows)
    assert {r.id for r in rows} == {i for i, r in last.items() if len(r.text or "") > 4000}
    assert all(r.chunk_index == offset[r.id] for r in whole if r.text is None) and {r.id for r in whole} == set(last)


# 7


def test_repeated_lines_equal_brute_force(spark, data):
    seen = defaultdict(set)
    rows = _table(spark, data, "raw_page").filter("source in ('blog', 'community')").select("page_id", "site", "text").collect()
    spots = [(r.page_id, i, (r.site, fold(x))) for r in rows for i, x in enumerate((r.text or "").split("\n"))]
    for p, _, k in spots:
        if len(k[1]) >= 20:
            seen[k].add(p)
    want = {(p, i) for p, i, k in spots if len(seen.get(k, ())) >= 6}
    assert want and {tuple(r) for r in Q.p7_found(spark, data).collect()} == want
    clean = {r.page_id: r for r in Q.p7_clean(spark, data).collect()}
    assert sum(r.lines_cut for r in clean.values()) == len(want)


def test_chunks_depend_on_the_line_alone():
    long = [("".join(random.Random(k).choices("abcdefgh ", k=700))).encode() for k in range(6)]
    one = {k: p7.chunk_hashes([x])[0].tolist() for k, x in enumerate(long)}
    together, owner = p7.chunk_hashes(long)
    assert all(together[owner == k].tolist() == one[k] for k in one) and all(len(v) > 5 for v in one.values())
    assert p7.chunk_hashes([])[0].size == 0


# 8


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=80))
def test_packing_places_each_item_once_within_capacity(sizes):
    bins = p8.best_two_fit(sizes, 50)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 50 for b in bins)


def test_two_smaller_items_take_a_gap():
    bins = p8.best_two_fit([6, 3, 2, 2], 10)
    assert sorted(sum([6, 3, 2, 2][i] for i in b) for b in bins) == [3, 10]


def test_containers_are_full(spark, data):
    packed = Q.p8_packed(spark, data).toPandas()
    used = packed.groupby("container_id").tokens.sum()
    assert used.max() <= p8.CAPACITY and used.sum() / (p8.CAPACITY * len(used)) > 0.97
    enc = p1.encoder()
    true = {r.doc_id: len(enc.encode_ordinary(r.text or "")) for r in _table(spark, data, "documents").select("doc_id", "text").collect()}
    assert packed.groupby("doc_id").tokens.sum().to_dict() == true
    whole = packed.groupby("doc_id").piece.max()
    assert all(whole[k] == 0 for k, n in true.items() if n <= p8.CAPACITY)


# 9


def test_contamination_equals_brute_force(spark, data):
    runs = defaultdict(set)
    for r in _table(spark, data, "eval_item").select("item_id", "text").collect():
        w = words(r.text)
        for k in range(len(w) - 9):
            runs[tuple(w[k : k + 10])].add(r.item_id)
    want = set()
    for r in _table(spark, data, "documents").select("doc_id", "text").collect():
        w = words(r.text)
        want |= {(r.doc_id, i) for k in range(len(w) - 9) for i in runs.get(tuple(w[k : k + 10]), ())}
    assert want and {tuple(r) for r in Q.p9_found(spark, data).collect()} == want


def test_all_fingerprints_within_the_radius_are_found(monkeypatch):
    rng = np.random.default_rng(0)
    index = p9.ItemIndex([(k, " ".join(rng.choice(list("abcdefghij"), 30))) for k in range(20)])
    probes = index.prints[rng.integers(0, len(index.prints), 300)].copy()
    for k in range(300):
        for bit in rng.choice(64, k % 5, replace=False):
            probes[k] ^= np.uint64(1) << np.uint64(bit)
    at, member = index.within_radius(probes)
    want = {(i, j) for i, p in enumerate(probes) for j, q in enumerate(index.prints) if int(p ^ q).bit_count() <= p9.RADIUS}
    assert set(zip(at.tolist(), member.tolist())) == want


def test_fingerprints_equal_the_plain_form():
    ids = word_hashes("one two three four five six seven eight nine ten eleven".split(), WordIds())
    bits = np.unpackbits(p9.mix(ids).view(np.uint8).reshape(-1, 8), axis=1)
    for k in range(2):
        plain = np.packbits(bits[k : k + 10].sum(axis=0) > 5).view(np.uint64)[0]
        assert p9.window_fingerprints(ids)[k] == plain


def test_item_blocks(spark, data, monkeypatch):
    whole = {tuple(r) for r in Q.p9_found(spark, data).collect()}
    monkeypatch.setattr(p9, "ITEM_BLOCK", 70)
    assert {tuple(r) for r in Q.p9_found(spark, data).collect()} == whole


# 10


def test_subjects_on_documents_that_were_not_trained_on():
    rng = random.Random(5)
    nouns = {"sport": "goal match team coach referee".split(), "law": "court judge statute contract appeal".split(), "none": "thing page note view list".split()}
    frame = "the {} of the {} was shown to a {} yesterday."

    def text(kinds):
        return " ".join(frame.format(*rng.choices(nouns[k], k=3)).capitalize() for k in kinds)

    docs = [(text([s] * 6 + ["none"] * 3), frozenset([s])) for s in ("sport", "law") for _ in range(30)] + [(text(["sport"] * 3 + ["law"] * 3), frozenset(["sport", "law"])) for _ in range(10)] + [(text(["none"] * 6), frozenset()) for _ in range(40)]
    docs[0] = (docs[0][0], frozenset(["law"]))  # a wrong label
    model = p10.train(docs, ["law", "sport"])
    share = lambda kinds: dict(zip(model.subjects, model.subjects_of(p10.sentence_tokens(text(kinds)))))
    assert share(["sport"] * 5)["sport"] >= 0.8 and share(["law"] * 5)["law"] >= 0.8
    assert max(share(["none"] * 8).values()) < p10.SHARE
    both = share(["sport"] * 3 + ["law"] * 3 + ["none"] * 4)
    assert both["sport"] >= p10.SHARE and both["law"] >= p10.SHARE


def test_subject_query(spark, data):
    found = {tuple(r) for r in Q.p10_found(spark, data).collect()}
    labels = {(r.doc_id, r.subject.lower()) for r in _table(spark, data, "subject_label").collect()}
    assert len(found & labels) > 0.6 * len(labels)
