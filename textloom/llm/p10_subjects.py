"""Subject area of each document.

One interpolated bigram language model for each subject and one for the background. Labels are
of whole documents and partly wrong, so the sentences' subjects are hidden:
expectation-maximization weighs each sentence of a labelled document between its document's
subjects, the background and, with little weight, the others, and re-estimates the models from
those weights. The sentences of unlabelled documents join once the models tell subjects apart,
with a weight by which all of them together stay below the labelled ones.

The models are fitted on all documents (``fitted``): one pass makes words, one counts pairs, one
numbers both, and every round of the expectation-maximization is a pass over the numbers.
Words and pairs that come three times or more have a weight of their own.

Every sentence of every document is then compared: the per-token cross-entropy of each
subject model against the background's. A sentence deals with the subject of least
cross-entropy if that is below the background's by more than a margin, which is calibrated
on all labelled documents that are held out, a sixth of them by hash of the id, and train no
model. A document deals with the subjects of at least a fifth of its sentences.

Defined results: documents without a sentence (NULL, empty, no prose) deal with none;
labels are compared in lower case, subjects outside table ``subject`` are dropped, equal
labels of one document count once; every row of a repeated id counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.text import WORD, hash64, mix
from textloom.session import cut, discard, files_released, shared_path

#: One of so many labelled documents calibrates and trains no model.
HELD_OUT = 6
#: Times that a word or pair comes in training before it has a weight of its own.
LEAST = 3
ROUNDS = 6
#: Rounds before unlabelled documents join: the models must tell subjects apart by then.
JOIN = 2
#: Weight of all unlabelled tokens together, in those of labelled documents; at 1 for each token they would decide alone.
UNLABELLED = 0.375
#: Pseudo counts of a word and of what follows it, in proportion of the classes: a rare name must not vouch for its own document.
SMOOTH = 2.0
WEIGHTS = (0.35, 0.55, 0.10)  # bigram, word, background
SHARE = 0.2
#: Margins that are tried.
MARGINS = np.arange(0.0, 1.01, 0.05)
UNSPACED = re.compile(r"[぀-ヿ㐀-鿿豈-﫿ー]+")
_SPLIT = re.compile(r"(?<=[.!?…][\"'”’»)\]])\s+|(?<=[.!?…])\s+|(?<=[。！？])|\s*\n\s*")
#: The same where no ideographic mark stands; it starts at white space, which is quicker to search.
_SPLIT_SPACED = re.compile(r"\s(?:(?<=[.!?…]\s)\s*|(?<=[.!?…][\"'”’»)\]]\s)\s*|(?<=\n)\s*|\s*\n\s*)")
#: What is no letter or digit of ASCII, as a space.
_BLANK = {c: " " for c in range(128) if not chr(c).isalnum()}
_ENDS = re.compile(r"[.!?…。！？][\"'”’»)\]]*$")
#: A line without an end mark counts as a sentence from this length on.
LONG_LINE = 60


def sentence_tokens(text: str | None) -> list[list[str]]:
    """The words of each sentence; unspaced scripts give pairs of characters."""
    out = []
    text = (text or "").replace("\r\n", "\n")
    marked = not text.isascii() and any(c in text for c in "。！？")
    for part in (_SPLIT if marked else _SPLIT_SPACED).split(text):
        if not part or not (len(part) >= LONG_LINE or _ENDS.search(part)):
            continue
        toks: list[str] = []
        low = part.lower()
        if low.isascii():
            toks = low.translate(_BLANK).split()
        elif not UNSPACED.search(low):
            toks = WORD.findall(low)
        for w in () if toks else WORD.findall(low):
            if w.isascii() or not UNSPACED.search(w):
                toks.append(w)
                continue
            at = 0
            for run in UNSPACED.finditer(w):
                if run.start() > at:
                    toks.append(w[at : run.start()])
                r = run.group()
                toks.extend(r[i : i + 2] for i in range(max(1, len(r) - 1)))
                at = run.end()
            if at < len(w):
                toks.append(w[at:])
        if len(toks) >= 3:
            out.append(toks)
    return out


@dataclass
class SubjectModel:
    subjects: list[str]
    vocabulary: dict[str, int]  # 0 is any word outside
    word_gain: np.ndarray  # [word, subject]: log p(word | subject) - log p(word | background)
    pair_keys: np.ndarray  # sorted: previous word * size + word
    pair_gain: np.ndarray  # [pair, subject]
    margin: float = 0.0

    def sentence_gains(self, sentences: list[list[str]]) -> np.ndarray:
        """[sentence, subject]: how far the per-token cross-entropy lies below the background's."""
        get = self.vocabulary.get
        sizes = np.fromiter(map(len, sentences), np.int64, len(sentences))
        ids = np.fromiter((get(w, 0) for s in sentences for w in s), np.int64, int(sizes.sum()))
        starts = np.cumsum(sizes) - sizes
        gain = self.word_gain[ids]
        if len(self.pair_keys):
            keys = np.empty(len(ids), np.int64)
            keys[1:] = ids[:-1] * len(self.word_gain) + ids[1:]
            keys[starts] = -1
            at = np.searchsorted(self.pair_keys, keys)
            at[at == len(self.pair_keys)] = 0
            known = np.flatnonzero(self.pair_keys[at] == keys)
            gain[known] = self.pair_gain[at[known]]
        return np.add.reduceat(gain, starts, axis=0) / sizes[:, None]

    def subjects_of(self, sentences: list[list[str]]) -> np.ndarray:
        """Share of the sentences that deal with each subject."""
        if not sentences or not self.subjects:
            return np.zeros(len(self.subjects))
        gains = self.sentence_gains(sentences)
        best = gains.argmax(axis=1)
        sure = gains[np.arange(len(best)), best] > self.margin
        return np.bincount(best[sure], minlength=len(self.subjects)) / len(sentences)


def train(documents: list[tuple[str | list[list[str]], frozenset[str]]], subjects: list[str], rounds: int = ROUNDS) -> SubjectModel:
    """Fit on (text or its sentences, labels) in memory; no label means that nothing is known. Queries use ``fitted``.

    The margin is calibrated on every ``HELD_OUT``-th labelled document, which trains no model.
    """
    docs = [(sentence_tokens(t) if isinstance(t, str) or t is None else t, labels & set(subjects)) for t, labels in documents]
    known = [k for k, (sents, labels) in enumerate(docs) if labels and sents]
    apart = set(known[::HELD_OUT]) if len(known) >= 4 * HELD_OUT else set()
    model = _train([doc for k, doc in enumerate(docs) if k not in apart], subjects, rounds)
    model.margin = _calibrate(model, [docs[k] for k in (sorted(apart) if apart else known)])
    return model


def _train(docs: list[tuple[list[list[str]], frozenset[str]]], subjects: list[str], rounds: int) -> SubjectModel:
    count: dict[str, int] = {}
    for sents, _ in docs:
        for s in sents:
            for w in s:
                count[w] = count.get(w, 0) + 1
    vocabulary = {w: i + 1 for i, w in enumerate(sorted(w for w, c in count.items() if c >= LEAST))}
    size, k = len(vocabulary) + 1, len(subjects)
    flat = [s for sents, _ in docs for s in sents]
    if not flat or not subjects:
        return SubjectModel(subjects, {}, np.zeros((1, k), np.float32), np.zeros(0, np.int64), np.zeros((0, k), np.float32), 1e9)
    sizes = np.fromiter(map(len, flat), np.int64, len(flat))
    starts = np.cumsum(sizes) - sizes
    ids = np.fromiter((vocabulary.get(w, 0) for s in flat for w in s), np.int64, int(sizes.sum()))
    sent_of = np.repeat(np.arange(len(flat)), sizes)
    keys = np.empty(len(ids), np.int64)
    keys[1:] = ids[:-1] * size + ids[1:]
    keys[starts] = -1
    pair_keys, pair_of, pair_count = np.unique(keys, return_inverse=True, return_counts=True)
    keep = (pair_count >= LEAST) & (pair_keys >= 0) & (pair_keys % size > 0) & (pair_keys // size > 0)
    place = np.full(len(pair_keys), -1)
    place[keep] = np.arange(keep.sum())
    pair_keys, pair_of = pair_keys[keep], place[pair_of]
    paired = np.flatnonzero(pair_of >= 0)
    units = ids.copy()
    units[paired] = size + pair_of[paired]
    # what each sentence may deal with: its document's labels, the background (last), little for the rest
    prior = np.repeat([_prior(k, [subjects.index(x) for x in labels]) for _, labels in docs], [len(s) for s, _ in docs], axis=0)
    labelled = np.repeat([bool(labels) for _, labels in docs], [len(s) for s, _ in docs])
    total = np.bincount(ids, minlength=size)
    light = _light(sizes[labelled].sum(), sizes[~labelled].sum())
    weight = prior * labelled[:, None]
    for step in range(rounds + 1):
        sums = np.stack([np.bincount(units, w[sent_of], minlength=size + len(pair_keys)) for w in weight.T], axis=1)
        logs = _logs(sums, pair_keys, total)
        if step == rounds:
            break
        # unlabelled documents join once the models tell subjects apart
        weight = _posterior(logs, units, starts, prior) * np.where(labelled, 1.0, light if step >= JOIN else 0.0)[:, None]
    gains = _gains(logs)
    return SubjectModel(subjects, vocabulary, gains[:size], pair_keys, gains[size:])


def _light(known: int, free: int) -> float:
    """The weight of an unlabelled token; the counts are of tokens."""
    return min(1.0, UNLABELLED * known / max(1, free))


def _prior(k: int, labels: list[int]) -> np.ndarray:
    row = np.full(k + 1, 0.10 / k if labels else 0.5 / k)
    row[k] = 0.5
    row[labels] = 0.4 / max(1, len(labels))
    return row / row.sum()


def _logs(sums: np.ndarray, pair_keys: np.ndarray, total: np.ndarray, kind: type = np.float64) -> np.ndarray:
    """[word or pair, class]: log p(word | class) of the words, then log p(word | word before, class) of the pairs.

    ``sums``: weights of the words that end no known pair, then of the pairs; ``total``: how often each word comes.
    """
    size = len(total)
    background = (total + 0.5) / (total + 0.5).sum()
    before, second = pair_keys // size, pair_keys % size
    b2, b1, b0 = WEIGHTS
    whole = sums.sum(axis=1)
    words_whole = whole[:size] + np.bincount(second, whole[size:], minlength=size)
    pair_whole = whole[size:] / np.maximum(words_whole[before], 1e-9)
    out = np.empty(sums.shape, kind)
    for c in range(sums.shape[1]):
        words = sums[:size, c] + np.bincount(second, sums[size:, c], minlength=size)
        share = max(words.sum(), 1e-9) / max(words_whole.sum(), 1e-9)
        word_p = (words / share + SMOOTH) / (words_whole.sum() + SMOOTH * size)
        pair_p = (sums[size:, c] + SMOOTH * pair_whole) / (words[before] + SMOOTH)
        out[:size, c] = np.log((b1 + b2) * word_p + b0 * background)
        out[size:, c] = np.log(b2 * pair_p + b1 * word_p[second] + b0 * background[second])
    return out


def _posterior(logs: np.ndarray, units: np.ndarray, starts: np.ndarray, prior: np.ndarray) -> np.ndarray:
    score = np.add.reduceat(logs.take(units, axis=0), starts, axis=0) + np.log(prior)
    score -= score.max(axis=1, keepdims=True)
    weight = np.exp(score)
    return weight / weight.sum(axis=1, keepdims=True)


def _gains(logs: np.ndarray) -> np.ndarray:
    """[word or pair, subject]: log p(word | subject) - log p(word | background)."""
    gains = (logs[:, :-1] - logs[:, -1:]).astype(np.float32)
    gains[0] = 0.0
    return gains


def _calibrate(model: SubjectModel, known: list[tuple[list[list[str]], frozenset[str]]]) -> float:
    """The margin at which accepted subjects agree best with the labels (F1)."""
    told = np.zeros((len(MARGINS), 3))
    for sents, labels in known:
        told += _agreement(model.sentence_gains(sents), [model.subjects.index(x) for x in labels])
    return _margin(told)


def _agreement(gains: np.ndarray, labels: list[int]) -> np.ndarray:
    """[margin, (hit, extra, missed)]: subjects of a document's sentences against its labels, at every margin."""
    best = gains.argmax(axis=1)
    top = gains[np.arange(len(best)), best]
    got = np.stack([np.bincount(best[top > margin], minlength=gains.shape[1]) for margin in MARGINS]) >= SHARE * len(best)
    mine = np.zeros(gains.shape[1], bool)
    mine[labels] = True
    return np.stack([(got & mine).sum(axis=1), (got & ~mine).sum(axis=1), (~got & mine).sum(axis=1)], axis=1)


def _margin(told: np.ndarray) -> float:
    """The margin of best F1; of a flat best, the middle."""
    hit, extra, missed = told.T
    f1 = 2 * hit / np.maximum(1, 2 * hit + extra + missed)
    # few documents make a ragged curve: neighbouring margins are averaged
    curve = np.convolve(np.pad(f1, 2, mode="edge"), np.array([1, 2, 3, 2, 1]) / 9, "valid")
    good = MARGINS[curve >= curve.max() - 0.002]
    return float(good[len(good) // 2])


TOLD = "doc_id long, maybe boolean, words array<long>, sizes array<int>, word long, n long"
UNITS = "doc_id long, labels array<int>, apart boolean, units binary, sizes array<int>"  # units are 32-bit integers
_TOLD = pa.schema([("doc_id", pa.int64()), ("maybe", pa.bool_()), ("words", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("word", pa.int64()), ("n", pa.int64())])
#: Slots of the filter by which documents without a label are kept out of the join with the labels.
SLOTS = 1 << 24
#: Different words that a task counts before it hands them on.
HELD = 400_000
#: Tokens that are weighed at once.
AT_ONCE = 1 << 20
#: Words and pairs whose sums travel in one row.
BLOCK = 1 << 12


@dataclass
class UnitModel:
    """A model over numbers: 0 is any word outside, then the words, then the pairs."""

    subjects: list[str]
    words: np.ndarray  # sorted hashes
    pair_keys: np.ndarray  # previous word * (number of words + 1) + word
    gains: np.ndarray  # [word or pair, subject]
    margin: float


class _Codes(dict):
    """word -> number in order of appearance."""

    def __missing__(self, word: str) -> int:
        code = self[word] = len(self)
        return code


def _tell(bits: np.ndarray):
    """The words of every document as hashes, and how often each comes in those that have no label for certain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes()
        hashes, times = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def counts() -> pa.RecordBatch:
            at = np.flatnonzero(times)
            return pa.RecordBatch.from_arrays([*(pa.nulls(len(at), _TOLD.field(k).type) for k in range(4)), pa.array(hashes[at]), pa.array(times[at])], schema=_TOLD)

        for batch in batches:
            slot = batch.column("slot").to_numpy()
            maybe = (bits[slot >> 3] >> (slot & 7)) & 1 > 0
            rows, own, sizes, many = [], [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                if sents := sentence_tokens(text):
                    rows.append(k)
                    own.append(np.fromiter((codes[w] for s in sents for w in s), np.int64))
                    many.append(len(sents))
                    sizes += map(len, sents)
            if not rows:
                continue
            new = np.fromiter((hash64(w) for w in list(codes)[len(hashes) :]), np.int64)
            hashes, times = np.concatenate([hashes, new]), np.concatenate([times, np.zeros(len(new), np.int64)])
            if free := [o for o, k in zip(own, rows) if not maybe[k]]:
                times += np.bincount(np.concatenate(free), minlength=len(times))
            ends = np.cumsum([0, *map(len, own)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows)), pa.array(maybe[rows]), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(hashes[np.concatenate(own)])), pa.ListArray.from_arrays(pa.array(np.cumsum([0, *many]), pa.int32()), pa.array(sizes, pa.int32())), pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.int64())],
                schema=_TOLD,
            )
            if len(codes) > HELD:
                yield counts()
                codes.clear()
                hashes, times = hashes[:0], times[:0]
        yield counts()

    return run


def _flat(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        word, n = np.unique(_flat(batch, "words"), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(word, pa.int64()), pa.array(n, pa.int64())], ["word", "n"])


class _Places:
    """Places of 64-bit hashes in a sorted array."""

    def __init__(self, known: np.ndarray) -> None:
        self.known, self.shift = known, np.uint64(63 - len(known).bit_length())
        slots = np.arange(2 << len(known).bit_length(), dtype=np.uint64) << self.shift
        self.first = np.minimum(np.searchsorted(known, slots), max(0, len(known) - 1))

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """-1 for those that are not in it."""
        if not len(self.known):
            return np.full(len(hashes), -1)
        at = self.first[hashes >> self.shift]
        short = np.flatnonzero(self.known[at] < hashes)
        while len(short):
            short = short[at[short] < len(self.known) - 1]
            at[short] += 1
            short = short[self.known[at[short]] < hashes[short]]
        return np.where(self.known[at] == hashes, at, -1)


def _numbers(words: _Places, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(number of each word, key of the pair that ends at it or -1 where it is none of two known words of one sentence)."""
    sizes = _flat(batch, "sizes")
    ids = words.of(_flat(batch, "words").view(np.uint64)) + 1
    keys = np.full(len(ids), -1, np.int64)
    keys[1:] = np.where((ids[:-1] > 0) & (ids[1:] > 0), ids[:-1] * (len(words.known) + 1) + ids[1:], -1)
    keys[np.cumsum(sizes) - sizes] = -1
    return ids, keys


def _pair_counts(words: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _Places(words)
        for batch in batches:
            _, keys = _numbers(places, batch)
            keys, n = np.unique(keys[keys >= 0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], ["id", "n"])

    return run


def _encode(words: np.ndarray, pairs: np.ndarray):
    """Words as numbers; a word that ends a known pair as the pair's number. ``pairs``: mixed keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, pair_places = _Places(words), _Places(pairs)
        for batch in batches:
            units, keys = _numbers(places, batch)
            some = np.flatnonzero(keys >= 0)
            at = pair_places.of(mix(keys[some].view(np.uint64)))
            units[some[at >= 0]] = len(words) + 1 + at[at >= 0]
            ends = 4 * np.concatenate([[0], np.cumsum(batch.column("words").value_lengths().to_numpy(zero_copy_only=False))])
            blobs = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(units.astype(np.int32))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("labels"), batch.column("apart"), blobs, batch.column("sizes")], [c.split()[0] for c in UNITS.split(", ")])

    return run


def _sentences(batch: pa.RecordBatch) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(which sentences of the batch, their units, where each starts), at most ``AT_ONCE`` units at a time or one sentence."""
    if not batch.num_rows:
        return
    column, ends = batch.column("units"), np.cumsum(_flat(batch, "sizes"))
    _, offsets, blob = column.buffers()
    units = np.frombuffer(blob, np.int32, int(ends[-1]), int(np.frombuffer(offsets, np.int32)[column.offset]))
    first = 0
    while first < len(ends):
        begin = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, begin + AT_ONCE, "right")))
        yield slice(first, last), units[begin : ends[last - 1]], np.concatenate([[0], ends[first : last - 1] - begin])
        first = last


def _round(told: Broadcast | None, k: int, many: int, light: float):
    """Weights of every word and pair in each class, by the models of the round before; by the labels if there is none.

    A task holds one number for each of the ``many`` words and pairs and each class; it hands them on in blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, logs = np.zeros((k + 1, many)), told and told.value
        for batch in batches:
            many_of = batch.column("sizes").value_lengths().to_numpy(zero_copy_only=False)
            prior = np.repeat([_prior(k, labels or []) for labels in batch.column("labels").to_pylist()], many_of, axis=0)
            stands = np.where(batch.column("labels").is_null().to_numpy(zero_copy_only=False), light, 1.0).repeat(many_of)
            for part, units, starts in _sentences(batch):
                weight = (prior[part] if logs is None else _posterior(logs, units, starts, prior[part])) * stands[part, None]
                sizes, index = np.diff(starts, append=len(units)), units.astype(np.intp)
                for c in range(k + 1):
                    sums[c] += np.bincount(index, weight[:, c].repeat(sizes), minlength=many)
        for block in range(-(-many // BLOCK)):
            own = sums[:, block * BLOCK : (block + 1) * BLOCK]
            at = np.flatnonzero(own.any(axis=0))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([at.astype(np.int16).tobytes()], pa.binary()), pa.array([own[:, at].astype(np.float32).tobytes()], pa.binary())], ["block", "at", "sums"])

    return run


def _blocks(k: int):
    """The sums of all tasks for the blocks of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, at, sums in zip(*(c.to_pylist() for c in batch.columns)):
                at = np.frombuffer(at, np.int16)
                if block not in held:
                    held[block] = np.zeros((k + 1, BLOCK))
                held[block][:, at] += np.frombuffer(sums, np.float32).reshape(k + 1, -1)
        for block, own in held.items():
            at = np.flatnonzero(own.any(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([at.astype(np.int16).tobytes()], pa.binary()), pa.array([own[:, at].astype(np.float32).tobytes()], pa.binary())], ["block", "at", "sums"])

    return run


def _added(rows: DataFrame, logs: np.ndarray | None, k: int, many: int, light: float) -> np.ndarray:
    kind = "block long, at binary, sums binary"
    told = None if logs is None else rows.sparkSession.sparkContext.broadcast(logs)
    with files_released(rows.sparkSession):
        got = rows.mapInArrow(_round(told, k, many, light), kind).repartition("block").mapInArrow(_blocks(k), kind).toArrow()
    if told:
        told.destroy()  # its files would stay until the driver happens to collect its garbage
    sums = np.zeros((many, k + 1))
    for block, at, own in zip(*(got[c].to_pylist() for c in ("block", "at", "sums"))):
        sums[block * BLOCK + np.frombuffer(at, np.int16).astype(np.int64)] = np.frombuffer(own, np.float32).reshape(k + 1, -1).T
    return sums


def _document_gains(gains: np.ndarray, batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """[sentence, subject] of each document: how far the per-token cross-entropy lies below the background's."""
    sizes, many = _flat(batch, "sizes"), batch.column("sizes").value_lengths().to_numpy(zero_copy_only=False)
    out = np.concatenate([np.add.reduceat(gains.take(units, axis=0), starts, axis=0) for _, units, starts in _sentences(batch)]) / sizes[:, None]
    return iter(np.split(out, np.cumsum(many)[:-1]))


def _held_out(gains: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = np.zeros((len(MARGINS), 3), np.int64)
        for batch in batches:
            if batch.num_rows:
                for own, labels in zip(_document_gains(gains, batch), batch.column("labels").to_pylist()):
                    told += _agreement(own, labels)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(told))), *(pa.array(c) for c in told.T)], ["step", "hit", "extra", "missed"])

    return run


def fitted(documents: DataFrame, labels: DataFrame, subjects: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, UnitModel | None]:
    """All documents in numbers, and the model that ``train`` makes of them, with the held-out ones by hash; None without labels or words."""
    spark, paths = documents.sparkSession, [shared_path(documents.sparkSession, f"subjects{k}") for k in range(3)]
    names = sorted(r.subject for r in subjects.select(F.lower(F.trim("subject")).alias("subject")).filter("subject is not null").distinct().collect())
    k, slot = len(names), F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS))
    place = F.array_position(F.array(*map(F.lit, names)).cast("array<string>"), F.lower(F.trim("subject"))).cast("int") - 1
    marks = labels.filter("doc_id is not null").select("doc_id", place.alias("label")).filter("label >= 0").groupBy("doc_id").agg(F.sort_array(F.collect_set("label")).alias("labels"))
    bits = np.zeros(SLOTS, bool)
    bits[marks.select(slot.alias("slot")).distinct().toArrow()["slot"].to_numpy()] = True
    documents.filter("doc_id is not null and text is not null").select("doc_id", "text", slot.alias("slot")).mapInArrow(_tell(np.packbits(bits, bitorder="little")), TOLD).write.parquet(paths[0])
    told = spark.read.schema(TOLD).parquet(paths[0])
    # only documents that may have a label meet the labels
    met = cut(told.filter("maybe").select("doc_id", "words", "sizes").join(marks, "doc_id", "left"))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0
    n = met.filter("labels is not null").agg(F.count("*").alias("all"), F.count_if(draw).alias("apart")).first()
    met = met.withColumn("apart", F.col("labels").isNotNull() & draw if n.all >= 4 * HELD_OUT else F.lit(False))
    rest = told.filter("word is null and not maybe").select("doc_id", "words", "sizes", F.lit(None).cast("array<int>").alias("labels"), F.lit(False).alias("apart")).unionByName(met.filter("labels is null"))
    known = met.filter("labels is not null")
    if not n.all:
        return spark.createDataFrame([], UNITS), None

    counts = told.filter("word is not null").select("word", "n").unionByName(met.filter("not apart").select("words").mapInArrow(_counted, "word long, n long"))
    often = counts.groupBy("word").agg(F.sum("n").alias("n")).groupBy(F.when(F.col("n") >= LEAST, F.col("word")).alias("word")).agg(F.sum("n").alias("n")).toArrow().sort_by([("word", "ascending")])
    words, total = often["word"].drop_null().to_numpy().view(np.uint64), often["n"].to_numpy()
    order = np.argsort(words)
    words, total = words[order], np.concatenate([[total[len(words) :].sum()], total[: len(words)][order]])
    everything = rest.unionByName(known)
    pairs = everything.filter("not apart").select("words", "sizes").mapInArrow(_pair_counts(words), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST).select("id").toArrow()
    pair_keys = pairs["id"].to_numpy()
    mixed = mix(pair_keys.view(np.uint64))
    order = np.argsort(mixed)
    pair_keys, mixed = pair_keys[order], mixed[order]
    for path, part in zip(paths[1:], (rest, known)):
        part.select("doc_id", "words", "sizes", "labels", "apart").mapInArrow(_encode(words, mixed), UNITS).write.parquet(path)
    discard(spark, paths[0])
    known, whole = spark.read.schema(UNITS).parquet(paths[2]), spark.read.schema(UNITS).parquet(*paths[1:])

    tokens = (known.filter("not apart").agg(F.sum(F.length("units")).alias("n")).first().n or 0) // 4
    light = _light(tokens, int(total.sum()) - tokens)
    many, logs = len(total) + len(pair_keys), None
    for step in range(rounds + 1):
        logs = _logs(_added((known if step <= JOIN else whole).filter("not apart"), logs, k, many, light), pair_keys, total, np.float32)
    model = UnitModel(names, words, pair_keys, _gains(logs), 0.0)
    told = (known.filter("apart") if n.apart and n.all >= 4 * HELD_OUT else known).mapInArrow(_held_out(model.gains), "step long, hit long, extra long, missed long")
    told = told.groupBy("step").agg(*[F.sum(c).alias(c) for c in ("hit", "extra", "missed")]).toArrow().sort_by("step")
    model.margin = _margin(np.stack([told[c].to_numpy() for c in ("hit", "extra", "missed")], axis=1))
    return whole, model


def _assign(model: UnitModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, subject, share = [], [], []
            for doc_id, gains in zip(batch.column("doc_id").to_pylist(), _document_gains(model.gains, batch) if batch.num_rows else ()):
                best = gains.argmax(axis=1)
                sure = gains[np.arange(len(best)), best] > model.margin
                found = np.bincount(best[sure], minlength=len(model.subjects)) / len(best)
                for i in np.flatnonzero(found >= SHARE):
                    doc.append(doc_id)
                    subject.append(model.subjects[i])
                    share.append(float(found[i]))
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(subject, pa.string()), pa.array(share, pa.float64())], ["doc_id", "subject", "share"])

    return run


def document_subjects(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """(doc_id, subject, share): the subjects that at least a fifth of the document's sentences deal with."""
    whole, model = fitted(documents, labels, subjects)
    if model is None:
        return documents.sparkSession.createDataFrame([], "doc_id long, subject string, share double")
    return whole.mapInArrow(_assign(model), "doc_id long, subject string, share double")


def composition(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """(subject, documents, chars): how much of the corpus deals with each subject."""
    found = document_subjects(documents, labels, subjects)
    sized = documents.select("doc_id", F.length("text").alias("chars"))
    return found.join(sized, "doc_id").groupBy("subject").agg(F.countDistinct("doc_id").alias("documents"), F.sum("chars").alias("chars"))
