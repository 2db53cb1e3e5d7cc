"""Token budget by source, language and domain.

For each language a regression predicts the tokens of a text under a public tokenizer from
counts of bytes, words, digits, punctuation, white space and scripts. It is fitted on a
bounded sample (``FIT`` rows a language), corrected by the ratio of true to predicted tokens
on held-out rows (``HOLD``), and applied to all rows. Only sampled rows are tokenized.

Defined results: NULL text has 0 tokens; NULL source counts as ``docs``; languages are
lower-cased and cut at the region, NULL is ``und``; each id counts once with its latest text
(NULL ``indexed_at`` is the earliest, of equal times the greater text hash).
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.sampling import LOWEST, SPAN, drawn, required

#: Vocabulary file of a public tokenizer; the folder may be named by the environment.
TOKENIZER = os.path.join(os.environ.get("TEXTLOOM_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")
FIT, HOLD = 700, 500
LEAST_ROWS = 40

#: Classes of bytes: letters, capitals, digits, white space, line breaks, punctuation, lead bytes of two-byte letters, of ideographs and kana, of other long sequences, continuation bytes.
_CLASS = np.zeros(256, np.uint8)
for _byte in range(256):
    _c = chr(_byte)
    _CLASS[_byte] = (
        9 if 0x80 <= _byte < 0xC0 else 6 if 0xC0 <= _byte < 0xE0 else 7 if 0xE3 <= _byte < 0xEA else 8 if _byte >= 0xE0
        else 1 if "A" <= _c <= "Z" else 0 if "a" <= _c <= "z" else 2 if _c.isdigit() else 4 if _c == "\n" else 3 if _c.isspace() or _byte < 32 else 5
    )
FEATURES = 18


def features(texts: pa.Array) -> np.ndarray:
    """[row, feature] counts of every text, from the UTF-8 bytes of the whole batch at once."""
    texts = texts.cast(pa.large_string())
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts.to_pylist()] if texts.null_count or texts.offset else None
    if raw is None:
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1)
        data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
        data = data[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
    else:
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
    n = len(offsets) - 1
    out = np.zeros((n, FEATURES))
    out[:, 0] = 1.0
    out[:, 1] = np.diff(offsets)
    if not len(data):
        return out
    kind = _CLASS[data]
    owner = np.repeat(np.arange(n), np.diff(offsets))
    out[:, 2:12] = np.bincount(owner * 10 + kind, minlength=n * 10).reshape(n, 10)
    # runs of letters, of digits and of punctuation; long runs break into several tokens
    group = np.array([0, 0, 1, 2, 2, 3, 0, 4, 4, 5], np.int8)[kind]
    fresh = np.empty(len(kind), bool)
    fresh[0] = True
    fresh[1:] = (group[1:] != group[:-1]) | (owner[1:] != owner[:-1])
    fresh &= group != 5
    at = np.flatnonzero(fresh)
    size = np.diff(np.append(at, len(kind)))
    of, g = owner[at], group[at]
    for k, which in enumerate((0, 1, 3)):
        out[:, 12 + k] = np.bincount(of[g == which], minlength=n)
    letters = g == 0
    out[:, 15] = np.bincount(of[letters], np.maximum(0, size[letters] - 5), minlength=n)
    out[:, 16] = np.bincount(of[letters], (size[letters] > 7).astype(float), minlength=n)
    out[:, 17] = np.bincount(of[g == 3], np.maximum(0, size[g == 3] - 1), minlength=n)
    return out


def encoder(path: str = TOKENIZER):
    """The public byte-level tokenizer at ``path`` (ranks file)."""
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@dataclass
class TokenModel:
    weights: dict[str, np.ndarray]  # "" is the model of all other languages
    ratio: dict[str, float]

    def predict(self, x: np.ndarray, languages: list[str]) -> np.ndarray:
        own = np.array([self.weights.get(lang, self.weights[""]) for lang in languages]).reshape(len(languages), FEATURES)
        scale = np.array([self.ratio.get(lang, self.ratio[""]) for lang in languages])
        return np.where(x[:, 1] > 0, np.maximum(1.0, (x * own).sum(axis=1) * scale), 0.0)


def _solve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge regression with relative errors; weights of counts that never occur stay 0."""
    scale = 1.0 / np.sqrt(np.maximum(1.0, x[:, 1]))
    a, b = x * scale[:, None], y * scale
    norm = np.maximum(1e-9, np.sqrt((a * a).mean(axis=0)))
    a = a / norm
    return np.linalg.solve(a.T @ a + 1e-3 * len(a) * np.eye(FEATURES) * 0.1, a.T @ b) / norm


def fit(languages: list[str], x: np.ndarray, y: np.ndarray, held: np.ndarray) -> TokenModel:
    lang = np.asarray(languages, dtype=object)
    model = TokenModel({"": _solve(x[~held], y[~held]) if (~held).sum() >= 2 else np.eye(FEATURES)[1] / 4}, {"": 1.0})
    for name in [*sorted(set(languages)), ""]:
        rows = np.ones(len(lang), bool) if name == "" else lang == name
        if name and (rows & ~held).sum() >= LEAST_ROWS:
            model.weights[name] = _solve(x[rows & ~held], y[rows & ~held])
        if (test := rows & held).sum() >= (1 if not name else LEAST_ROWS // 2) and (name in model.weights):
            predicted = (x[test] @ model.weights[name]).sum()
            model.ratio[name] = float(y[test].sum() / predicted) if predicted > 0 else 1.0
    return model


def language(column: str = "lang"):
    return F.coalesce(F.regexp_extract(F.lower(F.trim(column)), "^([a-z]+)", 1), F.lit("und"))


def sample_model(rows: DataFrame, tokenizer: str = TOKENIZER, fit_rows: int = FIT, hold_rows: int = HOLD) -> TokenModel:
    """rows: (id, text, language). Samples by 64-bit hash of the id, at most about fit_rows + hold_rows of every language.

    Languages are as many as there are codes of letters; the pooled model serves those with few rows.
    """
    want = fit_rows + hold_rows
    texts = rows.filter("text is not null")
    counts = texts.groupBy("language").agg(F.count("*").alias("n"))
    share = F.when(F.col("n") <= want, F.lit(LOWEST + SPAN - 1)).otherwise((F.lit(float(LOWEST)) + F.lit(float(SPAN) * want) / F.col("n")).cast("long"))
    rates = {r.language: r.below for r in counts.select("language", share.alias("below")).collect()}
    if not rates:
        return TokenModel({"": np.eye(FEATURES)[1] / 4}, {"": 1.0})
    below = F.create_map(*[F.lit(v) for pair in rates.items() for v in pair])[F.col("language")]
    drawn_rows = texts.filter(drawn(F.col("id"), below))
    # another hash tells the two parts apart, so that either is a sample of the language
    held = F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(want)) < hold_rows

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            y = [len(enc.encode_ordinary(t)) for t in batch.column("text").to_pylist()]
            x = features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("language"), batch.column("held"), pa.array(y, pa.int64()), pa.array(list(x), pa.list_(pa.float64()))], ["language", "held", "tokens", "x"])

    got = drawn_rows.select("language", "text", held.alias("held")).mapInArrow(tokenize, "language string, held boolean, tokens long, x array<double>").toArrow()
    required(got.num_rows, len(rates), "the token model")
    return fit(got["language"].to_pylist(), np.array(got["x"].to_pylist()), np.array(got["tokens"].to_pylist(), float), np.array(got["held"].to_pylist()))


def _estimate(model: TokenModel):
    keep = ("id", "language", "source", "host", "mark")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = model.predict(features(batch.column("text")), batch.column("language").to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(tokens, pa.float64())], [*keep, "tokens"])

    return run


def chunk_tokens(chunks: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, language, source, host, tokens): the estimate for each id's latest text. Texts aren't shuffled."""
    rows = chunks.filter("id is not null").select(
        "id",
        "text",
        language().alias("language"),
        F.coalesce(F.col("metadata.source"), F.lit("docs")).alias("source"),
        F.lower(F.coalesce(F.regexp_extract("metadata.url", r"^[a-zA-Z]+://([^/:?#]+)", 1), F.lit(""))).alias("host"),
        F.struct(F.coalesce(F.unix_micros(F.col("indexed_at").cast("timestamp")), F.lit(-(2**62))).alias("at"), F.xxhash64("text").alias("hash")).alias("mark"),
    )
    model = sample_model(rows.select("id", "text", "language"), tokenizer)
    estimated = rows.mapInArrow(_estimate(model), "id string, language string, source string, host string, mark struct<at: long, hash: long>, tokens double")
    return estimated.groupBy("id").agg(F.max_by(F.struct("language", "source", "host", "tokens"), "mark").alias("row")).select("id", "row.*")


def totals(chunks: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(dimension, value, chunks, tokens) by source, by language and by host."""
    cells = chunk_tokens(chunks, tokenizer).groupBy("source", "language", "host").agg(F.count("*").alias("chunks"), F.sum("tokens").alias("tokens"))
    long = cells.select("chunks", "tokens", F.explode(F.create_map(F.lit("source"), "source", F.lit("language"), "language", F.lit("host"), "host")).alias("dimension", "value"))
    return long.groupBy("dimension", "value").agg(F.sum("chunks").alias("chunks"), F.round(F.sum("tokens")).cast("long").alias("tokens"))
