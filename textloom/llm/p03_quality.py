"""Per-document text quality statistics.

For each page: words, mean word length, symbol ratio, share of lines that end in
punctuation, share of common words (learned: words that stand in three tenths of a site's
pages), and from the layout of its main content the vertical alignment of
delimiters, the indentation period and the autocorrelation of line lengths. The main content is
what problem 6 leaves; a page of which more than half of the characters are no natural prose is
called ``list``, ``table`` or ``junk``.

The decision is learned. Every content line gets ``FEATURES``: the layout signals of its
neighbourhood (delimiters that come as often, gaps that end in the same column, indentation
period, autocorrelation of the run's line lengths) and the ratios of the line (words, word
length, symbols, punctuation, common words). A small network gives the probabilities of prose,
list, table and junk; a page's characters are shared out by them. It is fitted on the lines of all
crawled pages, labelled by line rules (``page_lines.kind_of``) and by ``settle``; the rules label
lines only and decide no page. The lines come to the fit as counts: features rounded to ``CELL`` and
the label make a cell, and every cell counts with the number of its lines. Program text, title and
headings count as neither prose nor list, table or junk.

Defined results: NULL and empty texts give a row with zero counts and kind NULL.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.p06_main_content import _pages_of, content_regions, learned, line_scores, page_frame, read_pages
from textloom.llm.page_lines import BROKEN, BULLET, END, GAP, JUNK, LIST, PROSE, SENTENCE_INNER, SHORT, TABLE, UNSPACED, LineModel, Page, kind_of, variety
from textloom.session import shared_path

ALIGNED = 3
#: Autocorrelation from which line lengths count as periodic, and share of characters in words under which bare lines are junk.
PERIODIC, WORDLESS = 0.5, 0.2
#: Standard errors of an autocorrelation (1 / square root of the lines) that no chance of a list's lengths reaches.
SURELY = 4.0
#: Lines on either side whose delimiters a line is compared with.
NEAR = 3
#: Delimiters of rows of two fields.
DELIMITERS = (re.compile(r"\t"), re.compile(r"\|"), re.compile(r";"), re.compile(r",(?! )"))
#: Assignments and wide gaps, delimiters of two more kinds of rows.
ASSIGNED, WIDE = re.compile(r"(?<=[\w\"'])\s?(?:=|:=|->)\s?(?=[^\s=])"), re.compile(r"\S {2,}(?=\S)")
CLASSES = (PROSE, LIST, TABLE, JUNK)
NAMES = {LIST: "list", TABLE: "table", JUNK: "junk"}
HIDDEN, EPOCHS, BATCH = 24, 12, 256
#: Steps to which features are rounded: of the lines that are decided, and of the cells that the network is fitted on.
FINE, CELL = 1 / 100, 1 / 20
#: Different cells that a task holds before it hands them on.
HELD = 300_000
STATS = (
    "page_id long, words long, mean_word_length double, symbol_ratio double, lines long, punctuated_lines double, common_words double, "
    "aligned_lines double, indent_period long, length_autocorrelation double, prose_chars long, list_chars long, table_chars long, junk_chars long, content_chars long, kind string"
)


def autocorrelation(lengths: list[int]) -> tuple[int, float]:
    """(period, value): the lag of 1 to 6 at which line lengths repeat best, and how well."""
    x = np.asarray(lengths, float)
    if len(x) < 6 or (spread := x.var()) == 0:
        return 0, 1.0 if len(x) >= 6 else 0.0
    x = x - x.mean()
    value, lag = max(((x[k:] * x[:-k]).mean() / spread, -k) for k in range(1, min(6, len(x) // 2) + 1))
    return -lag, float(value)


def indent_period(lines: list[str]) -> int:
    """Least distance at which indentation repeats through the lines; 0 if none is indented."""
    depth = [len(x) - len(x.lstrip()) for x in lines]
    if not any(depth):
        return 0
    for k in range(1, min(8, len(depth) - 1) + 1):
        if all(a == b for a, b in zip(depth, depth[k:])):
            return k
    return 0


def record_period(lines: list[str]) -> int:
    """Number of lines of a record if indentation or line lengths repeat through ``ALIGNED`` records or more, else 0."""
    lag, value = autocorrelation([len(x) for x in lines])
    period = indent_period(lines) or (lag if value > max(PERIODIC, SURELY / len(lines) ** 0.5) else 0)
    return period if period >= 2 and len(lines) >= ALIGNED * period else 0


def word_share(toks: list[str]) -> float:
    """Share of characters in words: letters only, three or more, or of a script without spaces."""
    return sum(len(t) for t in toks if t.isalpha() and len(t) > 2 or UNSPACED.match(t)) / max(1, sum(map(len, toks)))


def layout(kinds: list[tuple[int, int]], lines: list[str], words: list[list[str]]) -> dict[int, int]:
    """Kinds of bare lines that only their neighbours tell: two-field rows, records over several lines, lines without words."""
    out: dict[int, int] = {}
    for bare, group in groupby(range(len(kinds)), lambda i: kinds[i][0] == LIST and kinds[i][1] in (21, 22)):
        run = list(group)
        if not bare or len(run) < ALIGNED:
            continue
        for delimiter in DELIMITERS:
            for n, row in groupby(run, lambda i: len(delimiter.findall(lines[i]))):
                if n and len(rows := list(row)) >= ALIGNED:
                    out.update(dict.fromkeys(rows, TABLE))
        rest = [i for i in run if i not in out]
        if word_share([t for i in rest for t in words[i]]) < WORDLESS:
            out.update(dict.fromkeys(rest, JUNK))
        elif len(rest) == len(run) and record_period([lines[i] for i in run]):
            out.update(dict.fromkeys(run, TABLE))
    return out


def settle(kinds: list[tuple[int, int]], lines: list[str], words: list[list[str]]) -> list[int]:
    """Kinds by the layout of the whole body: aligned rows, records, runs of bare items."""
    n = len(kinds)
    forms = Counter(m for k, m in kinds if k == TABLE)
    out = []
    for kind, mark in kinds:
        if kind == TABLE:
            near = sum(forms[m] for m in (mark - 1, mark, mark + 1) if m // 100 == mark // 100)
            kind = TABLE if near >= ALIGNED else SHORT
        out.append(kind)
    items = Counter(m for k, m in kinds if k == LIST)
    for i, (kind, mark) in enumerate(kinds):
        if kind != LIST:
            continue
        if mark == 30:  # several items in one line
            continue
        if mark >= 20:  # bare lines: only side by side, or as many of one form
            beside = sum(1 for j in (i - 2, i - 1, i + 1, i + 2) if 0 <= j < n and kinds[j][0] == LIST)
            if not (beside >= 2 or items[mark] >= 4 and beside >= 1):
                out[i] = SHORT
        elif items[mark] < 2:
            out[i] = SHORT
    for i, kind in layout(kinds, lines, words).items():
        out[i] = kind
    return out


def aligned(counts: np.ndarray) -> np.ndarray:
    """[line, field delimiter]: share of the ``2 * NEAR`` lines around that hold the delimiter as often as the line does."""
    n = len(counts)
    same = np.zeros(counts.shape)
    for step in range(1, min(NEAR, n - 1) + 1):
        hit = (counts[step:] == counts[:-step]) & (counts[step:] > 0)
        same[step:] += hit
        same[: n - step] += hit
    around = np.minimum(np.arange(n), NEAR) + np.minimum(np.arange(n)[::-1], NEAR)
    return same / np.maximum(1, around)[:, None]


def gap_columns(lines: list[str]) -> np.ndarray:
    """Share of a line's wide gaps that end in a column in which a gap of a neighbouring line ends too."""
    ends = [{m.end() for m in GAP.finditer(x)} if "  " in x or "\t" in x else set() for x in lines]
    near = lambda i: set().union(*(ends[j] for j in (i - 1, i + 1) if 0 <= j < len(ends)))
    return np.array([len(e & near(i)) / len(e) if e else 0.0 for i, e in enumerate(ends)])


def field_counts(line: str) -> tuple[int, ...]:
    """How often each delimiter of fields stands in a line: tab, bar, semicolon, bare comma, assignment, wide gap."""
    return (
        line.count("\t"), line.count("|"), line.count(";"), line.count(",") - line.count(", "),
        len(ASSIGNED.findall(line)) if "=" in line or "->" in line else 0, len(WIDE.findall(line)) if "  " in line else 0,
    )


FEATURES = (
    "one common ends symbols word_length longest in_words variety odd marked marked_often digits single aligned fields columns indented periodic "
    "length broken colon items bare_around unspaced inner spaces aligned_rows"
).split()


def line_features(lines: list[str], words: list[list[str]], model: LineModel) -> np.ndarray:
    """[line, feature] of the content lines of one page; every value lies about between 0 and 2."""
    n = len(lines)
    x = np.zeros((n, len(FEATURES)))
    if not n:
        return x
    counts = np.array([field_counts(line) for line in lines])
    same = aligned(counts)
    best = same.argmax(axis=1)
    ends = np.array([END.search(line[-12:]) is not None for line in lines])
    marks = [m.lastindex if (m := BULLET.match(line)) else 0 for line in lines]
    forms = Counter(marks)
    for i, (line, toks) in enumerate(zip(lines, words)):
        k = max(1, len(toks))
        letters = sum(map(len, toks))
        parts = line.split()
        visible = max(1, sum(map(len, parts)))
        common = sum(map(model.common.__contains__, toks)) / k
        spaced = line.isascii() or UNSPACED.search(line) is None
        whole, different, odd, digits, single = 1.0, 1.0, 0.0, 0.0, 0.0
        if not (common >= 0.34 and ends[i]) or k < 3:  # the closer look at a line's words
            whole, different = word_share(toks), variety(toks) if toks else 0.0
            plain = [t for t in toks if len(t) > 2 and t.isalpha() and (spaced or not UNSPACED.search(t))]
            odd = sum(model.oddness(t) < model.odd_below for t in plain) / len(plain) if len(plain) >= 3 else 0.0
            digits, single = sum(map(str.isdigit, line)) / visible, sum(len(t) == 1 for t in toks) / k
        commas = line.count(", ")
        x[i, :13] = (
            1.0, common, ends[i], max(0, visible - letters) / visible, letters / k / 10, min(2.0, math.log2(1 + max(map(len, parts), default=0)) / 6) if spaced else 0.0, whole, different, odd,
            marks[i] > 0, min(forms[marks[i]], 8) / 8 if marks[i] else 0.0, digits, single,
        )
        x[i, 18:] = (
            math.log2(1 + len(line)) / 8, 0.0 if line.isascii() else min(2.0, 10 * len(BROKEN.findall(line)) / len(line)), ":" in line, commas >= 2 and not ends[i] and max(len(p.split()) for p in line.split(", ")) <= 6, 0.0,
            0.0 if spaced else len(UNSPACED.findall(line)) / visible, SENTENCE_INNER.search(line) is not None, (len(line) - visible) / max(1, len(line)), 0.0,
        )
    rows = np.arange(n)
    x[:, 13], x[:, 14] = same[rows, best], np.log2(1 + counts[rows, best] * (same[rows, best] > 0)) / 3
    x[:, 15] = gap_columns(lines)
    x[:, 26] = same[rows, best] * (counts[rows, best] >= 2)
    bare = ~ends & (x[:, 1] < 0.5)
    for is_bare, group in groupby(range(n), lambda i: bare[i]):
        run = list(group)
        if is_bare and len(run) >= ALIGNED:
            own = [lines[i] for i in run]
            period = indent_period(own)
            x[run, 16] = period >= 2 and len(run) >= ALIGNED * period
            lag, value = autocorrelation([len(line) for line in own])
            x[run, 17] = max(0.0, min(2.0, value * len(run) ** 0.5 / SURELY)) if lag >= 2 and len(run) >= ALIGNED * lag else 0.0
    beside, total = np.zeros(n), np.zeros(n)
    for step in (1, 2):
        beside[step:] += bare[:-step]
        beside[: max(0, n - step)] += bare[step:]
        total[step:] += 1
        total[: max(0, n - step)] += 1
    x[:, 22] = beside / np.maximum(1, total)
    return x


@dataclass
class KindModel:
    """One hidden layer between the features of a line and the probabilities of ``CLASSES``."""

    first: np.ndarray
    second: np.ndarray

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh(x @ self.first)
        score = np.hstack([hidden, np.ones((len(x), 1))]) @ self.second
        score = np.exp(score - score.max(axis=1, keepdims=True))
        return score / score.sum(axis=1, keepdims=True)


def learn_kinds(x: np.ndarray, label: np.ndarray, epochs: int = EPOCHS, lines: np.ndarray | None = None) -> KindModel:
    """Fit by small steps (Adam); classes that are rarer than a tenth of the lines weigh as a tenth.

    ``lines``: how many lines each row stands for, by default one. Rows of many lines are split over the
    batches, so that every line counts and none makes a step of its own.
    """
    rng = np.random.default_rng(0)
    k = len(CLASSES)
    weights = [rng.normal(0, 1 / np.sqrt(len(FEATURES)), (len(FEATURES), HIDDEN)), np.zeros((HIDDEN + 1, k))]
    if not len(x):
        weights[1][-1, 0] = 9.0
        return KindModel(*weights)
    lines = np.ones(len(x)) if lines is None else lines.astype(float)
    share = np.bincount(label, lines, minlength=k) / lines.sum()
    parts = np.ceil(lines / lines.mean()).astype(np.int64)
    worth = ((0.1 / np.clip(share, 0.005, 0.1))[label] * lines / parts / lines.sum() * parts.sum()).repeat(parts)
    rows = np.arange(len(x)).repeat(parts)
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in weights]
    batch = max(BATCH, len(rows) // 400)
    step, steps = 0, epochs * -(-len(rows) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for a in range(0, len(rows), batch):
            at, weigh = rows[order[a : a + batch]], worth[order[a : a + batch]]
            hidden = np.tanh(x[at] @ weights[0])
            wide = np.hstack([hidden, np.ones((len(at), 1))])
            score = wide @ weights[1]
            p = np.exp(score - score.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(at)), label[at]] -= 1
            p *= weigh[:, None] / len(at)
            back = (p @ weights[1][:-1].T) * (1 - hidden**2)
            step += 1
            rate = 0.02 * (1 - 0.95 * step / steps)
            for w, g, (m, v) in zip(weights, (x[at].T @ back + 1e-5 * weights[0], wide.T @ p), moments):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return KindModel(*weights)


def open_lines(page: Page, keep: list[bool], title: str | None, headings: list[str] | None) -> tuple[list[int], list[int]]:
    """Numbers of the content lines, and of those among them whose kind is open: no program text, title or heading."""
    mine = [i for i, k in enumerate(keep) if k and page.lines[i].strip()]
    own = {" ".join(x.lower().split()) for x in (*(headings or ()), title) if x}
    named = lambda i: page.fixed[i] == 1 and " ".join(page.lines[i].lower().split()) in own
    return mine, [i for i in mine if not page.code[i] and not named(i)]


NUMBER = {PROSE: 0, SHORT: 0, LIST: 1, TABLE: 2, JUNK: 3}


def labels_of(lines: list[str], words: list[list[str]], model: LineModel) -> list[int]:
    """Numbers of the classes that the rules tell the open lines of a page to be of."""
    return [NUMBER[k] for k in settle([kind_of(line, False, toks, model) for line, toks in zip(lines, words)], lines, words)]


def fit_kinds(sample: list[tuple], model: LineModel) -> KindModel:
    """Fit the network on pages at hand; ``quality`` fits it on all pages of its table."""
    x, y = [np.zeros((0, len(FEATURES)))], []
    for site, title, headings, text, often, large in sample:
        scores, page = line_scores(text, title, headings, site, often, model, large)
        _, mine = open_lines(page, content_regions(scores), title, headings)
        lines, words = [page.lines[i] for i in mine], [page.words[i] for i in mine]
        x.append(line_features(lines, words, model))
        y += labels_of(lines, words, model)
    return learn_kinds(np.concatenate(x), np.array(y, np.int64))


def rounded(x: np.ndarray, step: float = FINE) -> np.ndarray:
    return np.clip(np.rint(x / step), 0, 255).astype(np.uint8)


def page_layout(page: Page, mine: list[int], x: np.ndarray) -> tuple:
    """The statistics of a page that need no decision."""
    lines, toks = [page.lines[i] for i in mine], [t for i in mine for t in page.words[i]]
    visible = len("".join("".join(lines).split()))
    symbols = visible - sum(map(len, toks))
    lag, value = autocorrelation([len(line) for line in lines])
    period = indent_period(lines)
    return (
        len(toks),
        sum(map(len, toks)) / len(toks) if toks else 0.0,
        max(0, symbols) / visible if visible else 0.0,
        len(lines),
        sum(1 for line in lines if END.search(line)) / len(lines) if lines else 0.0,
        0.0,  # common words, by the caller
        float((x[:, 13] > 0.5).sum()) / len(lines) if lines else 0.0,
        period or lag if value > PERIODIC else period,
        value,
    )


def decided(x: np.ndarray, sizes: np.ndarray, total: int, kinds: KindModel) -> tuple:
    """Characters of each class, all characters and the kind, from the rounded features and lengths of a page's open lines."""
    chars = (kinds.probabilities(x * FINE) * sizes[:, None]).sum(axis=0) if len(x) else np.zeros(len(CLASSES))
    odd = chars[1:]
    kind = NAMES[CLASSES[1 + int(odd.argmax())]] if odd.sum() > 0.5 * total else None
    return (*(int(round(c)) for c in chars), total, kind)


def measured(page: Page, keep: list[bool], title: str | None, headings: list[str] | None, model: LineModel) -> tuple[tuple, np.ndarray, list[str], list[list[str]], int]:
    """(statistics, features, open lines, their words, all characters) of a page."""
    mine, undecided = open_lines(page, keep, title, headings)
    told, words = [page.lines[i] for i in undecided], [page.words[i] for i in undecided]
    x = line_features(told, words, model)
    own = list(page_layout(page, mine, x))
    own[5] = sum(map(model.common.__contains__, (t for i in mine for t in page.words[i]))) / own[0] if own[0] else 0.0
    return tuple(own), x, told, words, sum(len(page.lines[i]) for i in mine)


def page_statistics(page: Page, keep: list[bool], title: str | None, headings: list[str] | None, model: LineModel, kinds: KindModel) -> tuple:
    own, x, told, _, total = measured(page, keep, title, headings, model)
    return own + decided(rounded(x), np.array([len(line) for line in told]), total, kinds)


_TYPES = (pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
_NAMES = [c.split()[0] for c in STATS.split(", ")][1:]
_NONE = (0, 0.0, 0.0, 0, 0.0, 0.0, 0.0, 0, 0.0, 0, 0, 0, 0, 0, None)


_LAYOUT = pa.schema([("page_id", pa.int64()), *zip(_NAMES[:9], _TYPES[:9]), ("total", pa.int64()), ("x", pa.binary()), ("sizes", pa.list_(pa.int32()))])
_CELLS = pa.schema([("cell", pa.binary()), ("n", pa.int64())])
LAYOUT = f"{STATS.split(', prose_chars')[0]}, total long, x binary, sizes array<int>, cell binary, n long"


def _cells(cells: Counter) -> pa.RecordBatch:
    own = [pa.array(list(cells), pa.binary()), pa.array(list(cells.values()), pa.int64())]
    cells.clear()
    return pa.RecordBatch.from_arrays([pa.nulls(len(own[0]), f.type) for f in _LAYOUT] + own, schema=pa.schema([*_LAYOUT, *_CELLS]))


def _measure(model: LineModel):
    """What no network is needed for of the pages asked for, and the cells of all pages' lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: Counter = Counter()
        for batch in batches:
            rows = []
            for (page_id, title, heads, page, keep), mine in zip(_pages_of(batch, model), batch.column("mine").to_pylist()):
                if not page:
                    if mine:
                        rows.append((page_id, *_NONE[:9], 0, b"", []))
                    continue
                own, x, told, words, total = measured(page, keep, title, heads, model)
                coarse = np.hstack([rounded(x, CELL), np.array(labels_of(told, words, model), np.uint8).reshape(-1, 1)])
                cells.update(map(bytes, coarse))
                if mine:
                    rows.append((page_id, *own, total, rounded(x).tobytes(), list(map(len, told))))
            columns = list(zip(*rows)) or [()] * len(_LAYOUT)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _LAYOUT)] + [pa.nulls(len(rows), f.type) for f in _CELLS], schema=pa.schema([*_LAYOUT, *_CELLS]))
            if len(cells) > HELD:
                yield _cells(cells)
        yield _cells(cells)

    return run


def _decide(kinds: KindModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = []
            for x, sizes, total in zip(*(batch.column(k).to_pylist() for k in ("x", "sizes", "total"))):
                told.append(decided(np.frombuffer(x, np.uint8).reshape(-1, len(FEATURES)), np.array(sizes, np.int64), total, kinds))
            columns = list(zip(*told)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), *(batch.column(c) for c in _NAMES[:9]), *(pa.array(c, t) for c, t in zip(columns, _TYPES[9:]))], ["page_id", *_NAMES])

    return run


def quality(pages: DataFrame, only: Column | None = None) -> DataFrame:
    """One row of statistics for each page; ``kind`` is NULL for natural prose.

    ``only``: a condition on ``pages`` for which rows come out; models and counts are of all pages.
    """
    read = read_pages(pages, page_frame(pages), only)
    model = learned(read)
    path = shared_path(pages.sparkSession, "layout")
    read.filter("part is null").mapInArrow(_measure(model), LAYOUT).write.parquet(path)
    layout = pages.sparkSession.read.schema(LAYOUT).parquet(path)
    cells = layout.filter("cell is not null").groupBy("cell").agg(F.sum("n").alias("n")).toArrow().sort_by("cell")
    x = np.frombuffer(b"".join(cells["cell"].to_pylist()), np.uint8).reshape(-1, len(FEATURES) + 1)
    kinds = learn_kinds(x[:, :-1] * CELL, x[:, -1].astype(np.int64), lines=cells["n"].to_numpy())
    return layout.filter("cell is null").drop("cell", "n").mapInArrow(_decide(kinds), STATS)


def non_prose(pages: DataFrame, only: Column | None = None) -> DataFrame:
    """(page_id, kind) of the pages whose main content is mostly no natural prose."""
    return quality(pages, only).filter(F.col("kind").isNotNull()).select("page_id", "kind")

