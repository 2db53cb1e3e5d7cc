"""What each operator owes whatever the size of its tables and samples."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.llm import p03_quality as p3
from textloom.llm import p04_residue as p4
from textloom.llm import p06_main_content as p6
from textloom.llm.page_lines import tokens
from textloom.operators import sampling

PROSE = "We looked at the report again and the numbers did not change for the third time."


# 4


def test_residue_prior_does_not_depend_on_the_sampling_rates(spark, monkeypatch):
    rows = [(k, f"About topic{k}", [(2, "h")], f"About topic{k}\nThe service{k % 7} writes {{{{name{k}}}}} here. " * (k % 50 == 0) + f"{PROSE} {k}. " * 9) for k in range(1200)]
    rows += [(k, "About", None, "503 Service Unavailable\nPlease try again later.") for k in range(2000, 2030)]
    pages = spark.createDataFrame(rows, "page_id long, title string, headings array<struct<level: int, text: string>>, text string")
    learned = []
    learn = p4.learn

    def spy(passages, *args, **kwargs):
        learned.append((len(passages), learn(passages, *args, **kwargs)))
        return learned[-1][1]

    monkeypatch.setattr(p4, "learn", spy)
    records = pages.withColumn("fields", F.array(F.lit("text")))
    p4.fit(records)
    monkeypatch.setattr(p4, "LONG_RECORDS", 120)
    p4.fit(records)
    (n_all, whole), (n_part, part) = [x for x in learned if x[0]]
    assert n_all == sum(len(p4.text_passages(r[1], r[3], r[2])) for r in rows)  # a record of two strata comes once
    assert n_part < 0.4 * n_all
    assert abs(whole.prior - part.prior) < 0.5


# 3


def test_layout_decides_where_lines_alone_do_not():
    names = "server cluster gateway balance invoice penalty harvest journey lantern".split()
    model = p3.LineModel(odd_below=-99.0)


    def kind(lines):
        words = [tokens(x) for x in lines]
        kinds = p3.settle([p3.kind_of(x, False, w, model) for x, w in zip(lines, words)], lines, words)
        chars = Counter()
        for x, k in zip(lines, kinds):
            chars[k] += len(x)
        return p3.NAMES.get(chars.most_common(1)[0][0])

    for delimiter in ("\t", " | ", ";", ","):
        assert kind([f"{x}{delimiter}{k * 37}" for k, x in enumerate(names)]) == "table"
    assert kind([y for k, x in enumerate(names) for y in (f"{x} {names[k - 1]}", f"  zone {names[k - 3]}", f"  load {k * 37}")]) == "table"
    assert kind([f"{k * 7919:08x}  " + " ".join(f"{(k * 31 + j * 77) % 256:02x}" for j in range(16)) for k in range(1, 12)]) == "junk"
    assert kind(["red apples", "old harbour lights", "tea", "broken promises of spring", "salt", "two winter coats", "grey paper boats"]) == "list"
    assert p3.record_period([x * n for _ in range(12) for x, n in (("a", 30), ("b", 4), ("c", 11))]) == 3
    assert p3.record_period(["x" * n for n in (30, 12, 31, 11, 28, 14, 12, 29)]) == 0  # by chance


WORDS = "we at the and did not for of to in is on it was with".split()
NOUNS = ["".join(a + b for a, b in zip(random.Random(k).choices("bdfglmnprst", k=4), random.Random(-k).choices("aeiou", k=4))) for k in range(1, 400)]


def _page(kind, seed):
    rng = random.Random(seed)
    noun, sentence = lambda: rng.choice(NOUNS), lambda: " ".join(rng.choice(WORDS) if rng.random() < 0.6 else rng.choice(NOUNS) for _ in range(rng.randint(9, 16))).capitalize() + "."
    n = rng.randint(9, 20)
    forms = {
        "list": [lambda k: f"- {noun()} {noun()}", lambda k: f"{k + 1}. {noun()} {noun()}", lambda k: f"{noun()} {noun()}"],
        "table": [lambda k: f"{noun()}\t{noun()}\t{rng.randint(1, 999)}", lambda k: f"| {noun()} | {noun()} | {k} |", lambda k: f"host={noun()} zone={noun()} n={k}", lambda k: f"{noun():<16}{noun():<16}{rng.randint(1, 99)}"],
        "junk": [lambda k: "".join(rng.choices("ABCDEFabcdef0123456789+/", k=60)), lambda k: "".join(rng.choices("!#$%&*+/<>=?@^_~", k=40)), lambda k: " ".join(rng.choices("bcdfghjkqwxz", k=30))],
        None: [lambda k: sentence() + " " + sentence()],
    }[kind]
    line = rng.choice(forms)
    return "\n".join([sentence()] + [line(k) for k in range(n)] + [sentence()] * (kind is not None and rng.random() < 0.5))


def test_learned_kinds_hold_on_pages_that_were_not_fitted():
    kinds = [None, None, "list", "table", "junk"]
    sample = [("s", None, None, _page(kinds[k % 5], k), set(), True) for k in range(400)]
    model = p6.fit(sample)
    network = p3.fit_kinds(sample, model)

    def kind(text):
        scores, page = p6.line_scores(text, None, None, "s", set(), model, True)
        return p3.page_statistics(page, [True] * len(page.lines), None, None, model, network)[-1]

    fresh = [(kinds[k % 5], _page(kinds[k % 5], k)) for k in range(1000, 1200)]
    right = sum(kind(text) == want for want, text in fresh)
    assert right >= 0.95 * len(fresh)


# samples


def test_samples_do_not_run_empty_at_any_size():
    for n in (1, 10**6, 10**11, 10**15):
        assert sampling.threshold(1000, n) > sampling.LOWEST and abs(sampling.rate(sampling.threshold(1000, n)) * n - min(n, 1000)) < 1
    with pytest.raises(RuntimeError):
        sampling.required(0, 10**11, "a model")


def test_site_samples_are_bounded_and_prefer_large_sites(spark):
    rows = spark.range(30_000).selectExpr("id as page_id", "id as row_key", "if(id < 20000, id % 4, id) as site_key", "if(id < 20000, 5000L, 1L) as site_pages", "cast(null as array<int>) as lines")
    got = p6.sampled_rows(rows, sites=8, site_pages=50).groupBy("site_key").count().collect()
    large = [r["count"] for r in got if r.site_key < 4]
    assert len(large) == 4 and all(20 < n < 90 for n in large) and len(got) < 30
