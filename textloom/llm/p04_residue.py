"""Template residue, filler, error pages and script notices.

Positive-unlabelled naive Bayes over passages (sentences and lines). Trusted records start
it: passages with an unfilled template slot outside code, and records known by a fixed
mark of an error or filler text. All other passages are unlabelled;
expectation-maximization estimates how likely each of them is residue and re-estimates
the word and word-pair probabilities of both classes from that. Passages inside records
of ordinary length are taken as negative in the first round, which teaches the model the
sentences that merely talk about placeholders, errors and scripts. Slots and marks are also
tokens of their passage, with weights learned like those of words.

The model decides: a record is residue if one of its passages scores above the model's cut, or if
its passages are residue together (more characters in passages above even odds than in others).
The cut is learned as well: it lies between the records with trusted passages and the
ordinary ones, nearer to the latter, as residue that is no seed scores lower than the seeds.

Texts and titles have a model each, fitted on all records (``fitted``): one pass makes tokens, two
number the words and pairs that come twice or more, and every round of the expectation-maximization
is a pass over the numbers. What is not residue is all less what is, so a round moves only the counts
of passages that may be residue. The last pass scores all records, for the cut and the result.
``fit`` is for trials on bounded samples; no query uses it. Defined results: NULL and empty fields are no residue; program text
in fences and between backticks never counts as a slot; rows without a page id are left out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.text import WORD
from textloom.operators.sampling import LOWEST, SPAN, rate, required, threshold
from textloom.session import cut, shared_path

SHORT_RECORDS, LONG_RECORDS, SLOT_RECORDS, TITLES = 3000, 2000, 1000, 12_000
SHORT_CHARS = 420
ROUNDS = 6
#: Pseudo counts of a word.
SMOOTH = 2.0
#: Characters on either side of a slot that make its passage.
BESIDE = 30
#: Log odds below which no cut lies: even odds for texts; titles are few words, so both classes lie far apart.
LEAST_CUT = {"text": 0.0, "title": -2.0}
#: Place of the cut between the best ordinary record and the worst trusted one.
PLACE = 0.15
#: Log odds above which passages inside ordinary records take part in learning.
SURE = 12.0
#: Log odds from which an unlabelled passage takes part in the next round.
TEACH = 4.0

#: Template slots of common notations, fixed values.
SLOT = re.compile(
    r"\{\{[^{}\n]*\}\}|\$\{[^{}\n]+\}|#\{[^{}\n]+\}|<%[^%\n]*%>|\{%[^%\n]*%\}|%%\w+%%|@@\w+@@|\b__[A-Za-z]\w*?__(?!\w)|\[\[[^\[\]\n]+\]\]|\[(?:insert|your|todo|placeholder)\b[^\]\n]*\]|<(?:your|insert|enter)\b[^<>\n]*>|(?<![\w{])\{\w+\}(?![\w}])",
    re.I,
)
#: Marks of well-known error, filler and notice texts, fixed values; they only start the learning.
MARK = re.compile(
    r"\blorem ipsum\b|\bdolor sit amet\b|\bTODO\b|\bTBD\b|\b(?:error|erreur|fehler)? ?(?:404|403|500|502|503|504)\b|\bnot found\b|\baccess denied\b|\bservice unavailable\b|\bserver error\b|\binterner fehler\b|\berreur interne\b|\berror interno\b|\bgateway\b|(?<![a-z])javascript(?![a-z])|\bnicht gefunden\b"
    r"|\bintrouvable\b|\bno encontrada\b|見つかりません|^\W*(?:untitled|undefined|null|no title|test(?: test)+|\[object object\])",
    re.I,
)
#: One of these stands, in lower case, in every text with a mark. Fixed values.
MARK_PARTS = (
    "lorem ipsum", "dolor sit amet", "todo", "tbd", "404", "403", "500", "502", "503", "504", "not found", "access denied", "service unavailable", "server error", "interner fehler", "erreur interne", "error interno", "gateway", "javascript",
    "nicht gefunden", "introuvable", "no encontrada", "見つかりません", "untitled", "undefined", "null", "no title", "test test", "[object object]",
)
FENCED = re.compile(r"^\s*```.*?(?:^\s*```\s*$|\Z)", re.M | re.S)
TICKED = re.compile(r"`[^`\n]*`")
PASSAGE = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])|\n+")
UNSPACED = re.compile(r"[぀-ヿ㐀-鿿ー]")
HEX = re.compile(r"^(?=.*\d)[0-9a-f]{5,16}$")


def marked(text: str, lowered: str) -> bool:
    """Whether the text holds a mark; plain search for its parts comes first, as hardly any text does."""
    return any(part in lowered for part in MARK_PARTS) and MARK.search(text) is not None


def tokens(passage: str, slots: bool = True, marks: bool = True) -> list[str]:
    """Words of a passage with slots, paths, numbers and hashes as classes; unspaced scripts as character pairs."""
    held = list(SLOT.finditer(passage)) if slots else []
    out = ["\1slot"] if held else []
    if held:  # of a passage with slots the words beside them count, not all that runs into it
        passage = " \2 ".join(passage[max(0, m.start() - BESIDE) : m.end() + BESIDE] for m in held)
    if marks and marked(passage, passage.lower()):
        out.append("\1mark")
    if " /" in passage or passage.startswith("/"):
        out.append("\1path")
    for w in WORD.findall(SLOT.sub(" ", passage).lower() if held else passage.lower()):
        if w.isalpha():
            if w.isascii() or not UNSPACED.search(w):
                out.append(w)
            else:
                out.extend(w[i : i + 2] for i in range(max(1, len(w) - 1)))
        elif w.isdigit():
            out.append(w if len(w) == 3 and w[0] in "45" else "\1num")
        elif len(w) > 16:
            out.append("\1blob")
        else:
            out.append("\1hex" if HEX.match(w) else w)
    return out


def text_passages(title: str | None, text: str, headings: list | None) -> list[tuple[str, list[str]]]:
    """The passages outside program text with their tokens, and what the record says of itself:
    whether headings were delivered and whether its title stands in it."""
    plain = TICKED.sub(" \2 ", FENCED.sub("\n", text) if "```" in text else text)
    slots, lowered = SLOT.search(plain) is not None, plain.lower()
    marks = any(part in lowered for part in MARK_PARTS)
    named = bool(title) and " ".join(title.lower().split()) in " ".join(lowered.split())
    about = [f"\3heads{int(bool(headings))}", f"\3named{int(named)}"]
    return [(p, t + about) for p in PASSAGE.split(plain) if p and not p.isspace() and (t := tokens(p, slots, marks))]


def title_passages(title: str, text: str | None) -> list[tuple[str, list[str]]]:
    """The title, with how many of its words its own page uses again."""
    body = (text or "").replace(title, " ").lower()
    mine = {w for w in WORD.findall(title.lower()) if len(w) > 3 or UNSPACED.search(w)}
    again = sum(1 for w in mine if w in body) if body.strip() else 0
    if not again and any(UNSPACED.search(w) for w in mine):
        again = sum(1 for w in mine for i in range(len(w) - 1) if UNSPACED.match(w[i]) and w[i : i + 2] in body)
    return [(title, tokens(title) + [f"\3echo{min(again, 2)}", f"\3len{min(len(mine), 4)}"])]


@dataclass
class ResidueModel:
    vocabulary: dict[str, int]
    word_gain: np.ndarray
    pair_keys: np.ndarray
    pair_gain: np.ndarray
    prior: float
    cut: float = 0.0  # log odds above which one passage makes its record residue

    def scores(self, passages: list[list[str]]) -> np.ndarray:
        """Log odds of residue of each passage (a list of tokens, none empty)."""
        ids, sizes, starts, keys = encode(passages, self.vocabulary)
        gain = self.word_gain[ids]
        if len(self.pair_keys):
            at = np.searchsorted(self.pair_keys, keys)
            at[at == len(self.pair_keys)] = 0
            known = self.pair_keys[at] == keys
            gain = gain + np.where(known, self.pair_gain[at], 0.0)
        return np.add.reduceat(gain, starts) + self.prior


def encode(passages: list[list[str]], vocabulary: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    get = vocabulary.get
    sizes = np.fromiter(map(len, passages), np.int64, len(passages))
    ids = np.fromiter((get(w, 0) for p in passages for w in p), np.int64, int(sizes.sum()))
    starts = np.cumsum(sizes) - sizes
    keys = np.empty(len(ids), np.int64)
    keys[1:] = np.where((ids[:-1] > 0) & (ids[1:] > 0), ids[:-1] * (len(vocabulary) + 1) + ids[1:], -1)
    keys[starts] = -1
    return ids, sizes, starts, keys


def learn(passages: list[list[str]], trusted: list[bool], settled: list[bool], rounds: int = ROUNDS, stands_for: list[float] | None = None) -> ResidueModel:
    """Fit on sampled passages; ``trusted`` are residue, ``settled`` are negative in the first round.

    ``stands_for``: of how many passages of the table each one is the sample; by default all of as many.
    """
    count = Counter(w for p in passages for w in set(p))
    vocabulary = {w: i + 1 for i, w in enumerate(sorted(w for w, c in count.items() if c >= 2))}
    size = len(vocabulary) + 1
    none = ResidueModel({}, np.zeros(1), np.zeros(0, np.int64), np.zeros(0), -9.0)
    if not passages or not any(trusted):
        return none
    ids, sizes, starts, keys = encode(passages, vocabulary)
    owner = np.repeat(np.arange(len(passages)), sizes)
    pair_keys, pair_of, pair_n = np.unique(keys, return_inverse=True, return_counts=True)
    keep = (pair_n >= 2) & (pair_keys >= 0)
    place = np.full(len(pair_keys), -1)
    place[keep] = np.arange(keep.sum())
    pair_keys, pair_of = pair_keys[keep], place[pair_of]
    paired = pair_of >= 0
    sure, calm = np.asarray(trusted), np.asarray(settled)
    # scaled to mean 1, so that the pseudo counts weigh the same at every table size
    weight = np.ones(len(passages)) if stands_for is None else np.asarray(stands_for, float) / np.mean(stands_for)
    posterior = sure.astype(float)
    model = none
    for _ in range(rounds):
        gains = []
        for index, n, use in ((ids, size, np.ones(len(ids), bool)), (pair_of, len(pair_keys), paired)):
            of = owner[use]
            w, all_w = (posterior * weight)[of], weight[of]
            yes = np.bincount(index[use], w, minlength=n)
            no = np.bincount(index[use], all_w - w, minlength=n)
            # pseudo counts spread in the classes' own proportion keeps unseen words neutral
            share = w.sum() / max(1e-9, all_w.sum())
            gains.append(np.log((yes + SMOOTH * share + 0.01) / (no + SMOOTH * (1 - share) + 0.01)) - np.log((share + 1e-9) / (1 - share + 1e-9)))
        word_gain, pair_gain = gains
        word_gain[0] = 0.0
        rate = min(0.5, max(1e-4, (posterior * weight).mean()))
        model = ResidueModel(vocabulary, word_gain, pair_keys, 0.5 * pair_gain, float(np.log(rate / (1 - rate))))
        score = model.scores(passages)
        posterior = np.where(sure, 1.0, 1 / (1 + np.exp(-np.clip(score, -30, 30))))
        # inside ordinary records only what is plainly residue may teach
        posterior = np.where(~sure & (score < np.where(calm, SURE, TEACH)), 0.0, posterior)
    return model


def cut_of(scores: np.ndarray, record: np.ndarray, trusted: np.ndarray, settled: np.ndarray, least: float = 0.0) -> float:
    """The cut between the greatest scores of settled records and of those with trusted passages.

    Settled records with a passage that the model is sure of are unlabelled residue themselves and
    left out; where the two overlap the cut lies where they change places (fewest records on the wrong side).
    """
    if not trusted.any():
        return float("inf")
    _, first = np.unique(record, return_index=True)
    best = np.maximum.reduceat(scores, first)
    positive = np.logical_or.reduceat(trusted, first)
    ordinary = np.logical_and.reduceat(settled, first) & ~positive & (best < SURE)
    if not ordinary.any():
        return 0.0
    high, low = np.sort(best[positive]), np.sort(best[ordinary])
    tried = np.unique(np.concatenate([high, low]))
    wrong = np.searchsorted(high, tried, "right") + len(low) - np.searchsorted(low, tried, "right")
    below = tried[wrong.argmin()]
    above = high[high > below].min(initial=below)
    return float(max(least, below + PLACE * (above - below)))


COLUMNS = ("page_id", "title", "text", "headings", "fields")
FIELDS = ("text", "title")
SAMPLED = "field string, record long, tokens array<string>, trusted boolean, settled boolean, stands_for double"


def _strata(field: str) -> tuple[tuple[Column, int], ...]:
    """The strata of a field's sample and how many records of each are wanted."""
    of = F.array_contains("fields", field)
    if field == "title":
        return ((of & (F.length("title") > 0), TITLES),)
    slots = F.col("text").rlike(r"\{\{|\$\{|#\{|<%|\{%|%%|@@|__|\[\[|(?i)lorem|<your|\[insert")
    short = F.length("text") < SHORT_CHARS
    return ((of & short & (F.length("text") > 0), SHORT_RECORDS), (of & ~short, LONG_RECORDS), (of & slots & ~short, SLOT_RECORDS))


def _as_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The passages of sampled records as tokens, so that texts stay where they are."""
    names = [c.split()[0] for c in SAMPLED.split(", ")]
    kinds = (pa.string(), pa.int64(), pa.list_(pa.string()), pa.bool_(), pa.bool_(), pa.float64())
    for batch in batches:
        rows = []
        for page_id, title, text, headings, *below in zip(*(batch.column(k).to_pylist() for k in ("page_id", "title", "text", "headings", "text_rate", "title_rate"))):
            for field, at in zip(("text", "title"), below):
                if at > LOWEST:
                    passages, trusted, settled = [], [], []
                    add_record(title, text, headings, field, passages, trusted, settled)
                    rows += [(field, page_id, p, t, s, 1 / rate(at)) for p, t, s in zip(passages, trusted, settled)]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 6, kinds)], names)


def fit(records: DataFrame) -> dict[str, ResidueModel]:
    """For trials: a model for each field, on bounded samples by hash of the page id: short records, ordinary ones, those with slot marks, titles."""
    strata = {field: _strata(field) for field in ("text", "title")}
    counts = records.agg(*[F.count_if(F.coalesce(condition, F.lit(False))).alias(f"{field}{k}") for field, own in strata.items() for k, (condition, _) in enumerate(own)]).first()
    part, hashed = records, F.xxhash64("page_id")
    for field, own in strata.items():
        # one draw for all strata: a record of two strata comes once, at the larger of their rates
        below = F.greatest(F.lit(LOWEST), *[F.when(condition, F.lit(threshold(wanted, counts[f"{field}{k}"]))).otherwise(F.lit(LOWEST)) for k, (condition, wanted) in enumerate(own)])
        part = part.withColumn(f"{field}_rate", F.when((hashed < below) | (below == F.lit(LOWEST + SPAN - 1)), below).otherwise(F.lit(LOWEST)))
    part = part.filter((F.col("text_rate") > LOWEST) | (F.col("title_rate") > LOWEST))
    got = part.select("page_id", "title", "text", "headings", "text_rate", "title_rate").mapInArrow(_as_tokens, SAMPLED).toArrow().sort_by([("field", "ascending"), ("record", "ascending")])
    models = {}
    for field, own in strata.items():
        rows = got.filter(pc.equal(got["field"], field))
        required(rows.num_rows, sum(counts[f"{field}{k}"] for k in range(len(own))) if field == "title" else counts["text1"], f"residue in the {field}")
        passages, trusted, settled = (rows[k].to_pylist() for k in ("tokens", "trusted", "settled"))
        weight = rows["stands_for"].to_numpy()
        models[field] = learn(passages, trusted, settled, stands_for=weight.tolist())
        if passages:
            models[field].cut = cut_of(models[field].scores(passages), rows["record"].to_numpy(), np.array(trusted), np.array(settled), LEAST_CUT[field])
    return models


def add_record(title: str | None, text: str | None, headings: list | None, field: str, passages: list, trusted: list, settled: list, chars: list | None = None) -> None:
    """Append a record's passages and what is known of them."""
    value = (text if field == "text" else title) or ""
    marked = MARK.search(value) is not None
    for passage, toks in text_passages(title, value, headings) if field == "text" else title_passages(value, text):
        if field == "text":
            known, calm = marked and len(value) < SHORT_CHARS and not headings, len(value) >= SHORT_CHARS
        else:
            known, calm = marked and len(value.split()) <= 5 and "\3echo0" in toks, "\3echo2" in toks
        passages.append(toks)
        if chars is not None:
            chars.append(len(passage))
        trusted.append(toks[0] == "\1slot" or known or "lorem ipsum" in passage.lower())
        settled.append(calm)


_TOLD = pa.schema([("page_id", pa.int64()), ("field", pa.string()), ("tokens", pa.list_(pa.string())), ("sizes", pa.list_(pa.int32())), ("chars", pa.list_(pa.int32())), ("flags", pa.list_(pa.int8())), ("word", pa.string()), ("n", pa.int64())])
TOLD = "page_id long, field string, tokens array<string>, sizes array<int>, chars array<int>, flags array<byte>, word string, n long"
CODED = "page_id long, field string, ids array<int>, pairs array<int>, sizes array<int>, chars array<int>, flags array<byte>"
#: Sums of a pass over words ``w``, pairs ``p`` and passages ``s``: of all (first round) and of residue.
SUMS = "field string, kind string, id long, n double, yes double"
#: Different words that a task counts before it hands them on.
HELD = 200_000


def _tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The passages of every record as tokens, and in how many passages of the task each word stands."""
    held: dict[str, Counter] = {f: Counter() for f in FIELDS}

    def counts() -> pa.RecordBatch:
        rows = [(f, w, n) for f, own in held.items() for w, n in own.items()]
        for own in held.values():
            own.clear()
        field, word, n = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.nulls(len(rows), pa.int64()), pa.array(field, pa.string()), *(pa.nulls(len(rows), _TOLD.field(k).type) for k in range(2, 6)), pa.array(word, pa.string()), pa.array(n, pa.int64())], schema=_TOLD)

    for batch in batches:
        rows = []
        for page_id, title, text, headings, fields in zip(*(batch.column(k).to_pylist() for k in COLUMNS)):
            for field in fields or ():
                value = text if field == "text" else title
                if not value or value.isspace():
                    continue
                passages, trusted, settled, chars = [], [], [], []
                add_record(title, text, headings, field, passages, trusted, settled, chars)
                for p in passages:
                    held[field].update(set(p))
                if passages:
                    rows.append((page_id, field, [t for p in passages for t in p], list(map(len, passages)), chars, [t + 2 * s for t, s in zip(trusted, settled)]))
        columns = list(zip(*rows)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, _TOLD.field(k).type) for k, c in enumerate(columns)] + [pa.nulls(len(rows), pa.string()), pa.nulls(len(rows), pa.int64())], schema=_TOLD)
        if sum(map(len, held.values())) > HELD:
            yield counts()
    yield counts()


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch]]:
    for field in FIELDS:
        if (own := batch.filter(pc.equal(batch.column("field"), field))).num_rows:
            yield field, own


def _flat(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False)


def _lists(values: np.ndarray, like: pa.Array) -> pa.Array:
    """``values`` in lists as long as those of ``like``."""
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(like).to_numpy(zero_copy_only=False))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))


def _keys(ids: np.ndarray, sizes: np.ndarray, size: int) -> np.ndarray:
    """The pair that ends at each token, -1 where it is none of two known words of one passage."""
    keys = np.full(len(ids), -1, np.int64)
    keys[1:] = np.where((ids[:-1] > 0) & (ids[1:] > 0), ids[:-1].astype(np.int64) * size + ids[1:], -1)
    keys[np.cumsum(sizes) - sizes] = -1
    return keys


def _encode(vocabulary: dict[str, dict[str, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for field, own in _parts(batch):
                get = vocabulary[field].get
                ids = np.fromiter((get(w, 0) for w in own.column("tokens").flatten().to_pylist()), np.int32)
                yield pa.RecordBatch.from_arrays([own.column("page_id"), own.column("field"), _lists(ids, own.column("tokens")), own.column("sizes"), own.column("chars"), own.column("flags")], ["page_id", "field", "ids", "sizes", "chars", "flags"])

    return run


def _pair_counts(sizes_of: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for field, own in _parts(batch):
                keys, n = np.unique(_keys(_flat(own, "ids"), _flat(own, "sizes"), sizes_of[field]), return_counts=True)
                keys, n = keys[keys >= 0], n[keys >= 0]
                yield pa.RecordBatch.from_arrays([pa.array([field] * len(keys), pa.string()), pa.array(keys), pa.array(n, pa.int64())], ["field", "id", "n"])

    return run


def _paired(pair_keys: dict[str, np.ndarray], sizes_of: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for field, own in _parts(batch):
                keys, known = _keys(_flat(own, "ids"), _flat(own, "sizes"), sizes_of[field]), pair_keys[field]
                at = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
                pairs = np.where(known[at] == keys, at, -1) if len(known) else np.full(len(keys), -1)
                yield pa.RecordBatch.from_arrays([own.column("page_id"), own.column("field"), own.column("ids"), _lists(pairs, own.column("ids")), own.column("sizes"), own.column("chars"), own.column("flags")], [c.split()[0] for c in CODED.split(", ")])

    return run


def _scored(own: pa.RecordBatch, gains: tuple[np.ndarray, np.ndarray, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(scores of the passages, words, pairs, sizes, flags); the last pair gain is that of no pair."""
    ids, pairs, sizes, flags = (_flat(own, k) for k in ("ids", "pairs", "sizes", "flags"))
    word_gain, pair_gain, prior = gains
    return np.add.reduceat(word_gain[ids] + pair_gain[pairs], np.cumsum(sizes) - sizes) + prior, ids, pairs, sizes, flags


def _round(gains: dict[str, tuple] | None, many: dict[str, tuple[int, int]]):
    """Sums of residue over all passages by the gains of the round before, in the first round by what is trusted, with the sums of all.

    ``many``: how many words and pairs there are; a task holds one number for each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple[str, str], np.ndarray] = {}
        yes: dict[tuple[str, str], np.ndarray] = {}

        def add(to: dict, key: tuple[str, str], values: np.ndarray) -> None:
            to[key] = to[key] + values if key in to else values

        for batch in batches:
            for field, own in _parts(batch):
                if gains is None:
                    ids, pairs, sizes, flags = (_flat(own, k) for k in ("ids", "pairs", "sizes", "flags"))
                    likely = (flags & 1).astype(float)
                else:
                    score, ids, pairs, sizes, flags = _scored(own, gains[field])
                    likely = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
                    likely = np.where(flags & 1 > 0, 1.0, np.where(score < np.where(flags & 2 > 0, SURE, TEACH), 0.0, likely))
                add(n, (field, "s"), np.array([float(len(sizes))]))
                add(yes, (field, "s"), np.array([likely.sum()]))
                of = likely.repeat(sizes)
                for kind, index, size in (("w", ids, many[field][0]), ("p", pairs, many[field][1])):
                    use = (index >= 0) & (of > 0)
                    add(yes, (field, kind), np.bincount(index[use], of[use], minlength=size))
                    if gains is None:
                        add(n, (field, kind), np.bincount(index[index >= 0], minlength=size).astype(float))
        for (field, kind), own in yes.items():
            total = n.get((field, kind), own)
            at = np.flatnonzero((own > 0) | (total > 0))
            yield pa.RecordBatch.from_arrays([pa.array([field] * len(at), pa.string()), pa.array([kind] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(total[at], pa.float64()), pa.array(own[at], pa.float64())], ["field", "kind", "id", "n", "yes"])

    return run


def _records(gains: dict[str, tuple]):
    """Of every record the greatest score, whether a passage is trusted, whether it is ordinary, and whether its passages are residue together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for field, own in _parts(batch):
                score, _, _, sizes, flags = _scored(own, gains[field])
                n = pc.list_value_length(own.column("sizes")).to_numpy(zero_copy_only=False)
                first, chars = np.cumsum(n) - n, _flat(own, "chars")
                best = np.maximum.reduceat(score, first)
                positive = np.logical_or.reduceat(flags & 1 > 0, first)
                ordinary = np.logical_and.reduceat(flags & 2 > 0, first) & ~positive & (best < SURE)
                mostly = np.add.reduceat(np.where(score > 0, chars, 0), first) > 0.5 * np.add.reduceat(chars, first)
                yield pa.RecordBatch.from_arrays([own.column("page_id"), own.column("field"), pa.array(best), pa.array(positive), pa.array(ordinary), pa.array(mostly)], ["page_id", "field", "best", "positive", "ordinary", "mostly"])

    return run


def _added(frame: DataFrame) -> dict[tuple[str, str], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, n, yes) of each field and kind."""
    got = frame.groupBy("field", "kind", "id").agg(F.sum("n").alias("n"), F.sum("yes").alias("yes")).toArrow().sort_by("id")
    return {(f, k): tuple((own := got.filter(pc.and_(pc.equal(got["field"], f), pc.equal(got["kind"], k))))[c].to_numpy() for c in ("id", "n", "yes")) for f in FIELDS for k in "wps"}


def fitted(records: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, dict[str, ResidueModel]]:
    """The records in numbers and a model for each field, as ``learn`` makes them of all passages; the cuts are not set."""
    spark, paths = records.sparkSession, [shared_path(records.sparkSession, f"residue{k}") for k in range(3)]
    records.mapInArrow(_tell, TOLD).write.parquet(paths[0])
    told = spark.read.schema(TOLD).parquet(paths[0])
    words = told.filter("word is not null").groupBy("field", "word").agg(F.sum("n").alias("n")).filter("n >= 2").select("field", "word").toArrow()
    vocabulary = {f: {w: k + 1 for k, w in enumerate(sorted(words.filter(pc.equal(words["field"], f))["word"].to_pylist()))} for f in FIELDS}
    size = {f: len(v) + 1 for f, v in vocabulary.items()}
    told.filter("word is null").mapInArrow(_encode(vocabulary), CODED.replace("pairs array<int>, ", "")).write.parquet(paths[1])
    coded = spark.read.parquet(paths[1])
    pairs = coded.mapInArrow(_pair_counts(size), "field string, id long, n long").groupBy("field", "id").agg(F.sum("n").alias("n")).filter("n >= 2").select("field", "id").toArrow().sort_by("id")
    pair_keys = {f: pairs.filter(pc.equal(pairs["field"], f))["id"].to_numpy() for f in FIELDS}
    coded.mapInArrow(_paired(pair_keys, size), CODED).write.parquet(paths[2])
    coded = spark.read.schema(CODED).parquet(paths[2])
    many = {f: (size[f], len(pair_keys[f])) for f in FIELDS}
    whole = sums = _added(coded.mapInArrow(_round(None, many), SUMS))
    models = {f: ResidueModel(vocabulary[f], np.zeros(size[f]), pair_keys[f], np.zeros(len(pair_keys[f])), -9.0) for f in FIELDS}
    trusted = [f for f in FIELDS if whole[f, "s"][2].sum() > 0]
    for step in range(rounds if trusted else 0):
        for f in trusted:
            gains = []
            for kind, n in (("w", size[f]), ("p", len(pair_keys[f]))):
                yes, everything = np.zeros(n), np.zeros(n)
                everything[whole[f, kind][0]] = whole[f, kind][1]
                yes[sums[f, kind][0]] = sums[f, kind][2]
                # pseudo counts spread in the classes' own proportion keeps unseen words neutral
                share = yes.sum() / max(1e-9, everything.sum())
                gains.append(np.log((yes + SMOOTH * share + 0.01) / (everything - yes + SMOOTH * (1 - share) + 0.01)) - np.log((share + 1e-9) / (1 - share + 1e-9)))
            gains[0][0] = 0.0
            likely = min(0.5, max(1e-4, sums[f, "s"][2].sum() / sums[f, "s"][1].sum()))
            models[f] = ResidueModel(vocabulary[f], gains[0], pair_keys[f], 0.5 * gains[1], float(np.log(likely / (1 - likely))))
        if step < rounds - 1:
            sums = _added(coded.mapInArrow(_round(_gains(models), many), SUMS))
    return coded, models


def _gains(models: dict[str, ResidueModel]) -> dict[str, tuple]:
    """The models as arrays over the numbers."""
    return {f: (m.word_gain, np.append(m.pair_gain, 0.0), m.prior) for f, m in models.items()}


def _cut_over(records: DataFrame, field: str) -> float:
    """``cut_of`` over all records: below the least positive score only the greatest ordinary one matters."""
    own = records.filter(F.col("field") == field)
    least = own.filter("positive").agg(F.min("best").alias("x")).first().x
    if least is None:
        return float("inf")
    ordinary = own.filter("ordinary and not positive")
    below = ordinary.filter(F.col("best") < least).agg(F.max("best").alias("x")).first().x
    told = own.filter("positive").select("best", F.lit(True).alias("high")).unionByName(ordinary.filter(F.col("best") >= least).select("best", F.lit(False).alias("high"))).groupBy("best").agg(F.count_if("high").alias("high"), F.count_if(~F.col("high")).alias("low")).orderBy("best").toArrow()
    score, high, low = (told[k].to_numpy() for k in ("best", "high", "low"))
    if below is not None:
        score, high, low = np.append(below, score), np.append(0, high), np.append(1, low)
    if not low.any():
        return 0.0
    at = int((np.cumsum(high) + low.sum() - np.cumsum(low)).argmin())
    above = score[at + 1 :][high[at + 1 :] > 0].min(initial=np.inf)
    return float(max(LEAST_CUT[field], score[at] + PLACE * ((above if above < np.inf else score[at]) - score[at])))


def residue_of(pages: DataFrame, fields: Column) -> DataFrame:
    """(page_id, field) of the pages whose text or title is or holds residue; ``fields`` names the fields of a row that count."""
    records = pages.filter("page_id is not null").select("page_id", "title", "text", "headings", fields.alias("fields")).filter(F.size("fields") > 0)
    coded, models = fitted(records)
    scored = cut(coded.mapInArrow(_records(_gains(models)), "page_id long, field string, best double, positive boolean, ordinary boolean, mostly boolean"))
    cuts = {f: _cut_over(scored, f) for f in FIELDS}
    over = F.when(F.col("field") == "text", F.lit(cuts["text"])).otherwise(F.lit(cuts["title"]))
    return scored.filter((F.col("best") > over) | F.col("mostly")).select("page_id", "field").distinct()


def residue(pages: DataFrame, field: str) -> DataFrame:
    """``residue_of`` one field of all rows."""
    return residue_of(pages, F.array(F.lit(field)))


def without_residue(pages: DataFrame, fields: Column) -> DataFrame:
    """(page_id, title, text) of the pages that may go into the index; only rows with a field that counts."""
    bad = residue_of(pages, fields).select("page_id").distinct()
    return pages.filter(F.size(fields) > 0).select("page_id", "title", "text").join(bad, "page_id", "left_anti")
