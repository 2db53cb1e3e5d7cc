"""Splitting oversized items at natural boundaries.

Lexical-cohesion segmentation: boundaries lie after sentences and lines (after words where
there are none). The word counts of the blocks of ``BLOCK`` units before and after each
boundary are compared; where the similarity has a valley the topic changes. Within the
window of sizes allowed for a piece the boundary with the deepest valley is taken, ends of
paragraphs and lines being preferred to ends of sentences. Text without any boundary is cut
at the limit. Every piece but the first repeats exactly ``overlap`` characters of its
predecessor, and every piece carries the item's header line, so each is an item by itself.

Defined results: NULL and empty texts are never oversized; of rows with one id the latest
``indexed_at`` counts (NULL is the earliest), of equal times the greater text hash; a header
that would fill half a piece is treated as text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LIMIT, OVERLAP = 4000, 200
BLOCK = 6
#: A piece is at least this part of the limit, the last one excepted.
LEAST = 0.5
#: Numbers of a page's chunks are summed up in ranges of this size.
RANGE = 4096
_DIMENSIONS = 512
STRETCH = 4000
_BOUNDARY = re.compile(r"\n[ \t]*\n\s*|\n|(?<=[.!?…;:])\s+|(?<=[。！？；])|\s+")
_WORD = re.compile(r"[^\W_]+")
#: Worth of a boundary besides its valley: blank line, line end, sentence end, any white space.
_WORTH = (0.5, 0.35, 0.25, 0.0)


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(position, class) of every place where the text may be cut; 0 is the best class."""
    at, kind = [], []
    for m in _BOUNDARY.finditer(text):
        gap = m.group()
        if 0 < m.end() < len(text):
            at.append(m.end())
            if gap.count("\n") > 1:
                kind.append(0)
            elif "\n" in gap:
                kind.append(1)
            else:
                kind.append(2 if text[m.start() - 1] in ".!?…;:。！？；" else 3)
    return np.asarray(at, np.int64), np.asarray(kind, np.int64)


def valley_depths(text: str, cuts: np.ndarray) -> np.ndarray:
    """How deep the lexical similarity dips at each of the cuts between units.

    Very long texts are worked through in overlapping stretches of ``STRETCH`` cuts, with
    the same result, as a depth depends on the ``2 * BLOCK`` units on either side only.
    """
    out = np.empty(len(cuts))
    for a in range(0, len(cuts), STRETCH):
        lo, hi = max(0, a - 3 * BLOCK), min(len(cuts), a + STRETCH + 3 * BLOCK)
        begin, end = int(cuts[lo - 1]) if lo else 0, int(cuts[hi]) if hi < len(cuts) else len(text)
        depth = _depths(text[begin:end], cuts[lo:hi] - begin)
        out[a : a + STRETCH] = depth[a - lo : a - lo + STRETCH]
    return out


def _depths(text: str, cuts: np.ndarray) -> np.ndarray:
    edges = [0, *cuts.tolist(), len(text)]
    units = len(edges) - 1
    counts = np.zeros((units + 1, _DIMENSIONS), np.float32)
    lowered = text.lower()
    if len(lowered) != len(text):  # letters whose lower case is longer
        lowered = text
    for k in range(units):
        for w in _WORD.findall(lowered[edges[k] : edges[k + 1]]):
            if len(w) > 3 or not w.isascii():
                for part in (w,) if w.isascii() or len(w) < 12 else (w[i : i + 2] for i in range(len(w) - 1)):
                    counts[k + 1, xxhash.xxh32_intdigest(part.encode("utf-8", "surrogatepass")) % _DIMENSIONS] += 1
    sums = np.cumsum(counts, axis=0)
    middle = np.arange(1, units)
    left = sums[middle] - sums[np.maximum(middle - BLOCK, 0)]
    right = sums[np.minimum(middle + BLOCK, units)] - sums[middle]
    norm = np.linalg.norm(left, axis=1) * np.linalg.norm(right, axis=1)
    similar = np.where(norm > 0, (left * right).sum(axis=1) / np.maximum(norm, 1e-9), 0.0)
    depth = np.empty(len(similar))
    for k, s in enumerate(similar):
        near_left, near_right = similar[max(0, k - BLOCK) : k + 1], similar[k : k + BLOCK + 1]
        depth[k] = (near_left.max() - s) + (near_right.max() - s)
    return depth


def split(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of the pieces' own parts; each but the first may take ``overlap`` more before its start."""
    if len(text) <= limit:
        return [(0, len(text))]
    at, kind = boundaries(text)
    strong = at[kind < 3]
    depth = dict(zip(strong.tolist(), valley_depths(text, strong).tolist())) if len(strong) else {}
    out, start = [], 0
    while len(text) - start + (overlap if out else 0) > limit:
        room = limit - (overlap if out else 0)
        low, high = start + max(1, int(room * LEAST)), start + room
        lo, hi = np.searchsorted(at, low), np.searchsorted(at, high, "right")
        choice = [(depth.get(int(p), 0.0) + _WORTH[k], int(p)) for p, k in zip(at[lo:hi], kind[lo:hi]) if k < 3]
        if choice:
            end = max(choice)[1]
        elif hi > lo:
            end = int(at[hi - 1])
        else:
            end = high
        out.append((start, end))
        start = end
    out.append((start, len(text)))
    return out


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[str, int, int]]:
    """(piece, start, end): the pieces of an item and the part of its body that is new in each."""
    header, gap, body = text.partition("\n\n")
    head = header + gap
    if not gap or "\n" in header or len(head) + overlap > limit // 2:
        head, body = "", text
    base = len(head)
    return [(head + body[max(0, s - overlap * (i > 0)) : e], base + s, base + e) for i, (s, e) in enumerate(split(body, limit - base, overlap))]


PIECES = "id string, url string, chunk_index int, piece int, text string, start int, end int"


def _split(limit: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, url, index, text in zip(*(batch.column(k).to_pylist() for k in ("id", "url", "chunk_index", "text"))):
                rows.extend((item, url, index, i, p, s, e) for i, (p, s, e) in enumerate(pieces(text, limit, overlap)))
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 7, kinds)], ["id", "url", "chunk_index", "piece", "text", "start", "end"])

    return run


def latest(chunks: DataFrame) -> DataFrame:
    """(id, mark, url, chunk_index, n_chars): of each id the row that counts, without its text."""
    mark = F.struct(F.coalesce(F.col("indexed_at").cast("timestamp"), F.timestamp_seconds(F.lit(-62135596800))).alias("at"), F.xxhash64("text").alias("hash"))
    narrow = chunks.filter("id is not null").select("id", mark.alias("mark"), F.col("metadata.url").alias("url"), F.col("metadata.chunk_index").alias("chunk_index"), F.length("text").alias("n_chars"))
    return narrow.groupBy("id").agg(F.max("mark").alias("mark"), F.max_by(F.struct("url", "chunk_index", "n_chars"), "mark").alias("row")).select("id", "mark", "row.*")


def oversized_pieces(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of every chunk whose latest text exceeds the limit; only those texts are shuffled."""
    last = latest(chunks).filter(F.col("n_chars") > limit)
    large = chunks.filter(F.length("text") > limit).select(
        "id",
        F.struct(F.coalesce(F.col("indexed_at").cast("timestamp"), F.timestamp_seconds(F.lit(-62135596800))).alias("at"), F.xxhash64("text").alias("hash")).alias("mark"),
        "text",
    )
    rows = large.join(last, ["id", "mark"]).dropDuplicates(["id"]).select("id", "url", "chunk_index", "text")
    return rows.mapInArrow(_split(limit, overlap), PIECES)


def renumbered(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(id, piece, chunk_index, text, start, end): pieces numbered on over all chunks of their page.

    Chunks within the limit come with their new number, piece 0 and no text, as theirs stays as it is.

    The running number is a prefix sum in two steps, over ranges of chunk numbers and within
    a range, so that a page with very many chunks isn't one task.
    """
    parts = oversized_pieces(chunks, limit, overlap)
    sizes = parts.groupBy("id").agg(F.count("*").alias("n"))
    rows = latest(chunks).join(sizes, "id", "left").select("id", "url", F.coalesce("chunk_index", F.lit(-1)).alias("k"), F.coalesce("n", F.lit(1)).alias("n"))
    rows = rows.withColumn("part", F.floor(F.col("k") / RANGE))
    before = rows.groupBy("url", "part").agg(F.sum("n").alias("s")).withColumn("base", F.sum("s").over(Window.partitionBy("url").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("s"))
    inside = F.sum("n").over(Window.partitionBy("url", "part").orderBy("k", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    first = rows.withColumn("inside", inside).join(before.select("url", "part", "base").withColumnRenamed("url", "page"), (F.col("url").eqNullSafe(F.col("page"))) & (rows["part"] == before["part"])).select("id", "n", (F.col("base") + F.col("inside")).alias("first"))
    cut_up = parts.join(first.filter("n > 1"), "id").select("id", "piece", (F.col("first") + F.col("piece")).cast("long").alias("chunk_index"), "text", "start", "end")
    whole = first.filter("n = 1").select("id", F.lit(0).alias("piece"), F.col("first").cast("long").alias("chunk_index"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"))
    return cut_up.unionByName(whole)
