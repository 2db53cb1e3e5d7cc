"""Lines repeated across one site's documents.

Each line's folded form is cut into content-defined chunks (a rolling hash over the
last ``WINDOW`` bytes decides where), distinct pages are counted for every chunk of a
site, and lines made of nothing but excessively repeated chunks are cut. The rolling
hash starts afresh with each line, so equal lines always have equal chunks and a chunk
of a repeated line is repeated itself: chunk counts never lose a repeated line. Lines
that merely consist of chunks of other repeated lines are told apart by a last exact
count of the surviving lines.

Defined results: NULL text has no lines; NULL ``site`` is a site of its own; a page id
delivered twice counts once; lines under ``min_chars`` after folding never count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.text import MIX_A, fold, hash64, mix

MIN_CHARS, MIN_PAGES = 20, 6
#: Bytes the rolling hash looks back on; a cut follows where its low bits are zero.
WINDOW, MASK = 12, np.uint64(31)
SALTS = 16

_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * MIX_A)
_POWER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def chunk_hashes(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and line number of every content-defined chunk of ``lines``, in order."""
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    if not sizes.sum():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    value = _BYTE[np.frombuffer(b"".join(lines), np.uint8)]
    n = len(value)
    rolling = np.zeros(n, np.uint64)
    for back in range(min(WINDOW, n)):
        rolling[back:] += value[: n - back] * np.uint64(pow(int(_POWER), back, 1 << 64))
    inside = np.arange(n) - np.repeat(starts, sizes)
    first = (inside == 0) | ((inside > WINDOW) & ((mix(rolling) & MASK) == 0))
    at = np.flatnonzero(first)
    powers = np.full(n, _POWER)
    powers[0] = 1
    powers = np.cumprod(powers)
    back = np.full(n, _INVERSE)
    back[0] = 1
    back = np.cumprod(back)
    sums = np.add.reduceat(value * powers, at) * back[at]
    length = np.diff(np.append(at, n)).astype(np.uint64)
    return mix(sums ^ length * MIX_A), np.searchsorted(ends, at, "right")


LINES = "page_id long, line_no long, line_key long, chunk_keys array<long>"


def _page_lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            page, number, line_key, folded, site_of = [], [], [], [], []
            for page_id, site, text in zip(*(batch.column(k).to_pylist() for k in ("page_id", "site", "text"))):
                if not text:
                    continue
                salt = hash64(site if site is not None else "\0")
                for i, line in enumerate(text.split("\n")):
                    if len(line) >= min_chars and len(f := fold(line)) >= min_chars:
                        page.append(page_id)
                        number.append(i)
                        line_key.append(hash64(f, salt & 0xFFFFFFFFFFFFFFFF))
                        folded.append(f.encode("utf-8", "surrogatepass"))
                        site_of.append(salt)
            hashes, owner = chunk_hashes(folded)
            keys = mix(hashes + np.array(site_of, np.int64).astype(np.uint64)[owner] * MIX_A).astype(np.int64) if len(owner) else hashes.astype(np.int64)
            offsets = np.searchsorted(owner, np.arange(len(folded) + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(page, pa.int64()),
                    pa.array(number, pa.int64()),
                    pa.array(line_key, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys, pa.int64())),
                ],
                ["page_id", "line_no", "line_key", "chunk_keys"],
            )

    return run


def site_lines(pages: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Every line long enough to count, with its key and its chunks' keys (all keys hold the site)."""
    return pages.filter("page_id is not null").select("page_id", "site", "text").mapInArrow(_page_lines(min_chars), LINES)


def line_chunks(lines: DataFrame) -> DataFrame:
    """(page_id, line_no, line_key, chunk_key, parts): the different chunks of every line."""
    different = F.array_distinct("chunk_keys")
    return lines.select("page_id", "line_no", "line_key", F.explode(different).alias("chunk_key"), F.size(different).alias("parts"))


def repeated_chunks(chunks: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(chunk_key, pages): chunks that stand in at least ``min_pages`` different pages of their site."""
    once = chunks.groupBy("chunk_key", "page_id").agg(F.lit(1).alias("one"))
    return once.groupBy("chunk_key").agg(F.count("*").alias("pages")).filter(F.col("pages") >= min_pages)


def repeated_lines(pages: DataFrame, min_pages: int = MIN_PAGES, min_chars: int = MIN_CHARS) -> DataFrame:
    """(page_id, line_no) of every occurrence of a line that stands in ``min_pages`` pages of its site.

    Counts are summed before the shuffle; the joins' hot keys (a legal line on every page
    of a site) are spread over ``SALTS`` parts of the page id.
    """
    lines = site_lines(pages, min_chars)
    salted = F.pmod(F.col("page_id"), F.lit(SALTS))
    chunks = line_chunks(lines)
    often = repeated_chunks(chunks, min_pages).select("chunk_key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    kept = (
        chunks.withColumn("salt", salted.cast("int"))
        .join(often, ["chunk_key", "salt"], "left_semi")
        .groupBy("page_id", "line_no", "line_key")
        .agg(F.count("*").alias("seen"), F.max("parts").alias("parts"))
        .filter("seen >= parts")
        .select("page_id", "line_no", "line_key")
    )
    lines_often = (
        kept.groupBy("line_key", "page_id").agg(F.lit(1).alias("one")).groupBy("line_key").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    ).select("line_key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return kept.withColumn("salt", salted.cast("int")).join(lines_often, ["line_key", "salt"], "left_semi").select("page_id", "line_no").distinct()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist()):
            if text is not None and gone:
                drop = set(gone)
                text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop)
            texts.append(text)
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array([len(g or ()) for g in batch.column("gone").to_pylist()], pa.int64()), pa.array(texts, pa.string())], ["page_id", "lines_cut", "text"])


def without_repeated_lines(pages: DataFrame, min_pages: int = MIN_PAGES, min_chars: int = MIN_CHARS) -> DataFrame:
    """(page_id, lines_cut, text): each page's text without its site's repeated lines; NULL text stays NULL."""
    gone = repeated_lines(pages, min_pages, min_chars).groupBy("page_id").agg(F.collect_list("line_no").alias("gone"))
    return pages.select("page_id", "text").join(gone, "page_id", "left").mapInArrow(_cut, "page_id long, lines_cut long, text string")
