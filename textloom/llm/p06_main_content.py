"""Page boilerplate mixed with main content.

Maximum-scoring content regions: every line has a score, the sum of the weights of its
words and of its shape tags (the part that tags play in marked-up pages); one linear scan
finds the set of contiguous regions with the largest total score, less a fixed cost for
each border inside the page, and what lies outside is boilerplate. With one region only this is the
maximum-scoring subsequence; several are allowed because notices and link blocks also
stand inside the body.

Counted over all pages: at how many addresses of its site a line of any length stands
(``MIN_ADDRESSES`` make it a standing line; scrapes of one address are one) and how many pages
a site has. The weights of words and tags and what follows on standing lines come from counts over
all lines of all pages too. No hand labels exist, so labels are distant: a standing line that is no
code, quote, separator, title or heading is labelled boilerplate, any other line content.

Texts are shuffled once, to meet the numbers of their standing lines, read once (``read_pages``) and
kept in the shared checkpoint folder with the parts that the pages tell themselves; the counts are
summed in each task before they are shuffled. Lines that links explain are few, so they are counted
as content first and moved in a second pass over the pages that have any (``_moved``).

Defined results: NULL and empty text gives no lines; NULL title, headings, site and address are
allowed (an address that is NULL is the page's own); of rows with one page id the one with the
least hash counts, once.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.page_lines import JUNK, LARGE_SITE, TABLE, LineModel, Page, kind_of, read_page, set_odd_below, set_trigrams, set_weights, tags, title_like, tokens, train, trigrams_of
from textloom.llm.text import fold, hash64
from textloom.operators.sampling import LOWEST, SPAN, drawn, threshold
from textloom.session import cut, shared_path

MIN_ADDRESSES = 6
SITES, SITE_PAGES = 32, 110
BORDER = 1.5
#: Parts into which the rows of a hot line or site are spread.
SALTS = 8
#: Scores of lines whose part is settled, and what a line of a large site gains by not standing elsewhere.
STANDING, FIXED, LINK, OWN = -12.0, 12.0, -3.0, 2.5
COLUMNS = ("page_id", "site", "title", "headings", "text", "lines", "large", "mine")
#: What a line is told to be by its page and its key, and counts of one task; rows of both kinds are written in one pass.
READ = "page_id long, site string, title string, headings array<string>, text string, lines array<int>, large boolean, mine boolean, marks binary, keys array<long>"
COUNTS = "part string, key long, host string, word string, n long, m long"
COUNTS_OF = tuple(c.split()[0] for c in COUNTS.split(", "))
#: Different counts that a task holds before it hands them on.
HELD = 600_000


def _with_key(pages: DataFrame) -> DataFrame:
    return pages.withColumn("row_key", F.xxhash64("page_id", "text"))


def _line_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sites, addresses, keys = [], [], []
        for page_id, site, url, text in zip(*(batch.column(k).to_pylist() for k in ("page_id", "site", "url", "text"))):
            salt = hash64(site if site is not None else "\0")
            sites.append(salt)
            addresses.append(hash64(url if url is not None else f"\0{page_id}"))
            # blank lines have key 0
            keys.append([hash64(f, salt & 0xFFFFFFFFFFFFFFFF) if (f := fold(line)) else 0 for line in text.split("\n")] if text else [])
        yield pa.RecordBatch.from_arrays([batch.column("row_key"), batch.column("page_id"), pa.array(sites, pa.int64()), pa.array(addresses, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["row_key", "page_id", "site_key", "address", "keys"])


def _salted(frame: DataFrame) -> DataFrame:
    return frame.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _salt(column: str) -> Column:
    return F.pmod(F.col(column), F.lit(SALTS)).cast("int")


def page_frame(pages: DataFrame, min_addresses: int = MIN_ADDRESSES) -> DataFrame:
    """(row_key, page_id, site_key, rows, site_pages, lines): one narrow row for each page.

    ``row_key`` names the row that counts, ``rows`` how many came with this page id, ``lines``
    the numbers of its standing lines; everything is counted over all pages.
    """
    url = F.col("url") if "url" in pages.columns else F.lit(None).cast("string")
    rows = _with_key(pages.filter("page_id is not null")).select("row_key", "page_id", "site", url.alias("url"), "text")
    keyed = cut(rows.mapInArrow(_line_keys, "row_key long, page_id long, site_key long, address long, keys array<long>"))
    at = keyed.select("address", F.explode(F.array_distinct("keys")).alias("line_key")).filter("line_key <> 0").groupBy("line_key", "address").agg(F.lit(1).alias("one"))
    often = at.groupBy("line_key").agg(F.count("*").alias("n")).filter(F.col("n") >= min_addresses).select("line_key")
    lines = keyed.select("row_key", F.posexplode("keys").alias("line_no", "line_key")).withColumn("salt", _salt("row_key"))
    standing = lines.join(_salted(often), ["line_key", "salt"], "left_semi").groupBy("row_key").agg(F.collect_set("line_no").alias("lines"))
    chosen = keyed.groupBy("page_id").agg(F.min(F.struct("row_key", "site_key")).alias("row"), F.count("*").alias("rows")).select("row.row_key", "page_id", "row.site_key", "rows")
    sizes = chosen.groupBy("site_key").agg(F.count("*").alias("site_pages"))
    sized = chosen.withColumn("salt", _salt("page_id")).join(_salted(sizes), ["site_key", "salt"]).drop("salt")
    return cut(sized.join(standing, "row_key", "left"))


def _headings(value: list | None) -> list[str] | None:
    return None if value is None else [h["text"] for h in value if h and h["text"]]


def _lead(fixed: list[int], i: int) -> bool:
    return i < 12 and 1 not in fixed[:i]


def sampled_rows(frame: DataFrame, sites: int = SITES, site_pages: int = SITE_PAGES) -> DataFrame:
    """Rows of the frame in a sample for trials: of at most about ``sites`` sites at most about ``site_pages`` pages each. No query uses it."""
    counts = frame.groupBy("site_key").agg(F.first("site_pages").alias("n")).agg(F.count_if(F.col("n") >= LARGE_SITE).alias("large"), F.count_if(F.col("n") < LARGE_SITE).alias("small")).first()
    large = F.col("site_pages") >= LARGE_SITE
    site = F.xxhash64("site_key", F.lit(3))
    chosen = F.when(large, F.lit(threshold(sites, counts.large))).otherwise(F.lit(threshold(sites - counts.large, counts.small) if counts.large < sites else LOWEST))
    share = F.when(F.col("site_pages") <= site_pages, F.lit(LOWEST + SPAN - 1)).otherwise((F.lit(float(LOWEST)) + F.lit(float(SPAN) * site_pages) / F.col("site_pages")).cast("long"))
    return frame.filter(((site < chosen) | (chosen == F.lit(LOWEST + SPAN - 1))) & drawn(F.col("page_id"), share))


def fit(sample: list[tuple]) -> LineModel:
    """Fit the line model on pages at hand; ``learned`` fits it on a table."""
    told = []
    for site, title, headings, text, often, _ in sample:
        page = read_page(text, title, headings)
        host, n = (site or "").lower(), len(page.lines)
        lines = []
        for i, line in enumerate(page.lines):
            if not line.strip():
                continue
            label = 2 * page.fixed[i] or (-1 if i in often else 1)
            lines.append((page.folded[i], page.words[i] + tags(line, host, len(page.words[i]), n - 1 - i, _lead(page.fixed, i)), max(label, -1), title_like(line), page.code[i]))
        told.append((host, lines))
    return train(told)


def line_scores(text: str, title: str | None, headings: list[str] | None, site: str | None, often: set[int], model: LineModel, large: bool = False, page: Page | None = None) -> tuple[list[float], Page]:
    """Score of each line (content is positive) and the page as read; ``large``: its site has many pages, ``page``: it was read before."""
    page = page or read_page(text, title, headings)
    host, n = (site or "").lower(), len(page.lines)
    scores = []
    in_links, last = False, ""
    for i, line in enumerate(page.lines):
        toks = page.words[i]
        if not toks and not line.strip():
            scores.append(0.0)
            continue
        if page.fixed[i]:
            s = FIXED if page.fixed[i] > 0 else STANDING
        elif i in often:
            s = STANDING
        else:
            shape = tags(line, host, len(toks), n - 1 - i, _lead(page.fixed, i))
            if large:  # menus of large sites stand; other lists are the pages' own
                shape = [t for t in shape if not t.startswith("\1bullet")]
            s = model.score(toks) + model.score(shape) - model.bias
            s = max(-8.0, min(8.0, s + OWN * large))
            if model.follows(last, toks):
                s = min(s, LINK)
            if s < 1 or in_links:
                kind = kind_of(line, page.code[i], toks, model)[0]
                if kind == JUNK or (kind == TABLE and large):  # rubbish and rows that stand nowhere else are the page's own
                    s = max(s, 1.0)
                elif in_links and kind != TABLE and title_like(line):
                    s = min(s, LINK)
        scores.append(s)
        last = page.folded[i]
        in_links = s < 0 and (in_links or last in model.openers)
    return scores, page


def content_regions(scores: list[float], border: float = BORDER) -> list[bool]:
    """Which lines lie in the contiguous regions of largest total score less ``border`` for each border
    between two lines; a page may begin and end inside. One linear scan with two running totals (inside, outside) and a walk back.
    """
    inside = outside = 0.0
    came_in, came_out = [], []
    for s in scores:
        stay_in, enter = inside, outside - border
        stay_out, leave = outside, inside - border
        came_in.append(stay_in >= enter)
        came_out.append(stay_out >= leave)
        inside, outside = max(stay_in, enter) + s, max(stay_out, leave)
    keep = [False] * len(scores)
    state = inside >= outside
    for i in range(len(scores) - 1, -1, -1):
        keep[i] = state
        state = (came_in[i] if state else not came_out[i])
    return keep


def _reread(text: str, marks: bytes, keys: list[int]) -> Page:
    """The page as ``read_page`` told it; the lines' keys stand for their folded texts."""
    lines = text.split("\n")
    return Page(lines, [(b & 3) - 1 for b in marks], keys, [b > 3 for b in marks], [tokens(x) for x in lines])


def _labels(lines: list[str], fixed: list[int], often: set[int]) -> list[tuple[int, int]]:
    """(number, label) of the lines that aren't blank; 2: content by form or place, 1: stands once, -1: no content."""
    return [(i, max(2 * fixed[i] or (-1 if i in often else 1), -1)) for i, line in enumerate(lines) if line.strip()]


class _Counts:
    """Counts of a task by (part, key, host); all add up, whatever they are split into."""

    def __init__(self) -> None:
        self.of: dict[tuple, Counter] = defaultdict(Counter)

    def __len__(self) -> int:
        return sum(map(len, self.of.values()))

    def rows(self) -> list[tuple]:
        """(part, key, host, word, n, m); of parts that tell two sides, ``m`` counts what is no content."""
        out = [(part[:-1] if part[-1] == "-" else part, key, host, word, *((0, n) if part[-1] == "-" else (n, 0))) for (part, key, host), own in self.of.items() for word, n in own.items()]
        self.of.clear()
        return out

    def page(self, page: Page, host: str, often: set[int]) -> None:
        n, of, seen = len(page.lines), self.of, set()
        labels = _labels(page.lines, page.fixed, often)
        spread, content, other = of["spread", 0, host], of["side", 0, ""], of["side-", 0, ""]
        of["pages", 0, host][""] += 1
        before = 0
        for at, (i, label) in enumerate(labels):
            line, mine = page.lines[i], set(page.words[i])
            shape = tags(line, host, len(page.words[i]), n - 1 - i, _lead(page.fixed, i))
            if label == 1:
                spread.update(mine)
                spread["\1"] += 1  # lines
                content.update(shape)
                if before:
                    of["follow-", before, ""][""] += title_like(line)
                    of["after", before, ""].update(mine)
                    of["where", before, host][""] += 1
            elif label == -1:
                other.update(mine)
                other.update(shape)
                other[""] += 1
            elif page.code[i]:
                content.update(mine)
                content.update(shape)
                content[""] += 1
            if label > 0 and not page.code[i] and len(page.words[i]) + len(shape) >= 8:
                seen |= mine
            before = page.folded[i] if label == -1 else 0
            if before and at + 1 < len(labels):
                of["follow", before, ""][""] += 1
        of["seen", 0, host].update(seen)


def _counts_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = dict(zip(COUNTS_OF, zip(*rows))) if rows else {}
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(len(rows), f.type) for f in schema], schema=schema)


_COUNTS = pa.schema([("part", pa.string()), ("key", pa.int64()), ("host", pa.string()), ("word", pa.string()), ("n", pa.int64()), ("m", pa.int64())])
_READ = pa.schema([("page_id", pa.int64()), ("site", pa.string()), ("title", pa.string()), ("headings", pa.list_(pa.string())), ("text", pa.string()), ("lines", pa.list_(pa.int32())), ("large", pa.bool_()), ("mine", pa.bool_()), ("marks", pa.binary()), ("keys", pa.list_(pa.int64())), *_COUNTS])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every page with its marks and keys, and the counts over the pages."""
    counts = _Counts()
    for batch in batches:
        rows = []
        for page_id, site, title, headings, text, often, large, mine in zip(*(batch.column(k).to_pylist() for k in COLUMNS)):
            heads, marks, keys = _headings(headings), None, None
            if text:
                page = read_page(text, title, heads)
                page.folded = [hash64(f) or 1 if f else 0 for f in page.folded]
                marks, keys = bytes(f + 1 + 4 * c for f, c in zip(page.fixed, page.code)), page.folded
                counts.page(page, (site or "").lower(), set(often or ()))
            rows.append((page_id, site, title, heads, text, often, large, mine, marks, keys))
        columns = list(zip(*rows)) or [()] * 10
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _READ)] + [pa.nulls(len(rows), f.type) for f in _COUNTS], schema=_READ)
        if len(counts) > HELD:
            yield _counts_batch(counts.rows(), _READ)
    yield _counts_batch(counts.rows(), _READ)


def read_pages(pages: DataFrame, frame: DataFrame, mine: Column | None = None) -> DataFrame:
    """The pages that count as read, once each, with rows of counts (``part`` tells them); ``mine`` marks those that are asked for."""
    path = shared_path(pages.sparkSession, "pages")
    once_a_page(with_frame(pages, frame, mine).drop("rows"), frame).mapInArrow(_read, f"{READ}, {COUNTS}").write.parquet(path)
    return pages.sparkSession.read.schema(f"{READ}, {COUNTS}").parquet(path)


def _moved(model: LineModel):
    """Counts of the lines that an opener or its follower explains, to be taken from content."""
    told = model.openers | model.followers.keys()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts()
        for batch in batches:
            for site, text, often, marks, keys in zip(*(batch.column(k).to_pylist() for k in ("site", "text", "lines", "marks", "keys"))):
                if told.isdisjoint(keys):
                    continue
                host, lines, fixed, often = (site or "").lower(), text.split("\n"), [(b & 3) - 1 for b in marks], set(often or ())
                moved, content, linked, last = [], [], False, 0
                for i, label in _labels(lines, fixed, often):
                    if label == 1 and (linked or last in model.followers) and ((linked and title_like(lines[i])) or model.follows(last, tokens(lines[i]))):
                        moved.append(i)
                    else:
                        linked = keys[i] in model.openers
                        if label > 0 and marks[i] < 4:
                            content.append(i)
                    last = keys[i]
                gone: set[str] = set()
                for i in moved:
                    toks = tokens(lines[i])
                    shape = tags(lines[i], host, len(toks), len(lines) - 1 - i, _lead(fixed, i))
                    for t in {*toks, *shape, ""}:
                        counts.of["side", 0, ""][t] -= 1
                        counts.of["side-", 0, ""][t] += 1
                    if len(toks) + len(shape) >= 8:
                        gone.update(toks)
                if gone:
                    for i in content:
                        toks = tokens(lines[i])
                        if not gone.isdisjoint(toks) and len(toks) + len(tags(lines[i], host, len(toks), len(lines) - 1 - i, _lead(fixed, i))) >= 8:
                            gone.difference_update(toks)
                    counts.of["seen", 0, host].subtract(gone)
            if len(counts) > HELD:
                yield _counts_batch(counts.rows(), _COUNTS)
        yield _counts_batch(counts.rows(), _COUNTS)

    return run


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: Counter = Counter()
    for batch in batches:
        for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
            for t in trigrams_of(word):
                out[t] += n
    yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array(list(out.values()), pa.int64())], ["t", "n"])


def learned(read: DataFrame) -> LineModel:
    """The model of ``page_lines.train`` from the counts over all pages of ``read_pages``."""
    counts = read.filter("part is not null").select(*COUNTS_OF)
    total = lambda part, *by: counts.filter(F.col("part") == part).groupBy(*by).agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    model = LineModel()
    follow = cut(total("follow", "key"))
    model.openers = frozenset(follow.filter("n >= 3 and m >= 0.5 * n").select("key").toArrow()["key"].to_pylist())
    spread = total("spread", "host", "word").withColumnRenamed("n", "s").drop("m")
    tell = total("after", "key", "word").select("key", "word", F.col("n").alias("c")).join(follow.filter("n >= 4 and m < 0.5 * n").select("key", "n"), "key").filter("c >= 0.8 * n").select("key", "word", "c")
    # a word tells if it comes far more often than in the other lines of the same sites
    at = total("where", "key", "host").select("key", "host", F.col("n").alias("k")).join(spread.filter(F.col("word") == "\1").select("host", F.col("s").alias("lines")), "host")
    usual = tell.join(at, "key").join(spread, ["host", "word"], "left").groupBy("key", "word", "c").agg(F.sum(F.col("k") * F.coalesce("s", F.lit(0)) / F.col("lines")).alias("u"))
    found = usual.filter("u < 0.25 * c").select("key", "word").toArrow().sort_by("key").to_pylist()
    model.followers = {k: frozenset(r["word"] for r in own) for k, own in groupby(found, lambda r: r["key"])}
    moved = cut(read.filter("marks is not null").select("site", "text", "lines", "marks", "keys").mapInArrow(_moved(model), COUNTS))
    counts = counts.filter("part in ('side', 'spread', 'seen', 'pages')").unionByName(moved)
    word = F.when((F.col("part") == "spread") & (F.col("word") == "\1"), "").otherwise(F.col("word"))
    sides = counts.filter("part in ('side', 'spread')").groupBy(word.alias("word")).agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    rows = sides.filter((F.col("n") + F.col("m") >= 4) | F.col("word").startswith("\1") | (F.col("word") == "")).toArrow()
    count = {w: (n, m) for w, n, m in zip(*(rows[k].to_pylist() for k in ("word", "n", "m")))}
    set_weights(model, count, *count.pop("", (0, 0)))
    seen = cut(total("seen", "host", "word").filter("n > 0").drop("m"))
    sizes = total("pages", "host").filter("n >= 8").select("host", F.col("n").alias("pages"))
    model.common = frozenset(seen.join(sizes, "host").filter("n >= 0.3 * pages").select("word").distinct().toArrow()["word"].to_pylist())
    by_word = seen.groupBy("word").agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 1).alias("sites"))
    spelled = by_word.mapInArrow(_spelled, "t string, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    set_trigrams(model, dict(zip(spelled["t"].to_pylist(), spelled["n"].to_pylist())))
    usual_words = by_word.filter((F.col("sites") > 0) & F.col("word").rlike("^[A-Za-z]{4,}$")).select("word", "sites").toArrow()
    set_odd_below(model, zip(usual_words["word"].to_pylist(), usual_words["sites"].to_pylist()))
    return model


def _pages_of(batch: pa.RecordBatch, model: LineModel) -> Iterator[tuple]:
    """(page_id, title, headings, page, keep) of each page with text; ``keep`` tells content lines."""
    for page_id, site, title, heads, text, often, large, marks, keys in zip(*(batch.column(k).to_pylist() for k in (*COLUMNS[:-1], "marks", "keys"))):
        if text:
            scores, page = line_scores(text, title, heads, site, set(often or ()), model, bool(large), _reread(text, marks, keys))
            yield page_id, title, heads, page, content_regions(scores)
        else:
            yield page_id, title, None, None, []


def _scan(model: LineModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spots = [(page_id, i) for page_id, _, _, page, keep in _pages_of(batch, model) for i, k in enumerate(keep) if not k and page.lines[i].strip()]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in spots], pa.int64()), pa.array([i for _, i in spots], pa.int64())], ["page_id", "line_no"])

    return run


def with_frame(pages: DataFrame, frame: DataFrame, mine: Column | None = None) -> DataFrame:
    """The rows that count with their standing lines; a row delivered several times still comes several times."""
    narrow = frame.select("row_key", "rows", "lines", (F.col("site_pages") >= LARGE_SITE).alias("large"))
    asked = F.lit(True) if mine is None else F.coalesce(mine, F.lit(False))
    return _with_key(pages.filter("page_id is not null").select("page_id", "site", "title", "headings", "text", asked.alias("mine"))).join(narrow, "row_key").select(*COLUMNS, "rows")


def _read_and_learned(pages: DataFrame) -> tuple[DataFrame, LineModel]:
    read = read_pages(pages, page_frame(pages))
    return read.filter("part is null"), learned(read)


def boilerplate_lines(pages: DataFrame) -> DataFrame:
    """(page_id, line_no) of the lines that are no content of their page."""
    read, model = _read_and_learned(pages)
    return read.mapInArrow(_scan(model), "page_id long, line_no long")


def once_a_page(rows: DataFrame, frame: DataFrame) -> DataFrame:
    """One row of each page, the one asked for if any is; only those that came several times are compared."""
    if frame.filter("rows > 1").isEmpty():
        return rows
    several = frame.filter("rows > 1").select("page_id")
    one = F.max(F.struct("mine", *(c for c in rows.columns if c not in ("page_id", "mine")))).alias("one")
    return rows.join(several, "page_id", "left_anti").unionByName(rows.join(several, "page_id", "left_semi").groupBy("page_id").agg(one).select("page_id", "one.*"))


def _body(model: LineModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = list(_pages_of(batch, model))
            bodies = ["\n".join(x for x, k in zip(page.lines, keep) if k) if page else text for (_, _, _, page, keep), text in zip(told, batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(bodies, pa.string())], ["page_id", "body"])

    return run


def main_bodies(pages: DataFrame) -> DataFrame:
    """(page_id, body): each page's main content; NULL text stays NULL."""
    read, model = _read_and_learned(pages)
    return read.mapInArrow(_body(model), "page_id long, body string")
