"""Evaluation texts leaking into training text.

Every run of ``WIDTH`` words of an item and of a document is fingerprinted by SimHash
(64 bits, each the majority of the words' hash bits). The fingerprints of the items are
cut into ``RADIUS + 1`` blocks of bits; two fingerprints that differ in at most ``RADIUS``
bits agree in one block at least, so looking up every block finds all of them. Candidates
within the radius are verified by the exact similarity of their weighted shingles (pairs of
neighbouring words, weighted by their rarity among the items), and, where a run of equal
words is asked for, word by word.

A whole item, or the shortest part of it that counts, is covered by windows of the length
that counts: a shared run of WIDTH words has a window with distance 0, so none is lost.

The items are the stated query set. They go to the executors in blocks of at most
``ITEM_BLOCK`` rows, one pass over the documents for each block, so what is sent is bounded
however many items there are.

Defined results: NULL and empty texts, and texts under WIDTH words, match nothing;
repeated rows give one row.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.text import MIX_A, WordIds, mix, word_hashes, words

WIDTH, RADIUS = 10, 2
ITEM_BLOCK = 2000
_BLOCKS = ((0, 21), (21, 21), (42, 22))


def window_fingerprints(ids: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """SimHash of every run of ``width`` words, as unsigned 64-bit values."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    bits = np.unpackbits(mix(ids).view(np.uint8).reshape(-1, 8), axis=1)
    total, have, powers = None, 0, {1: bits}
    size = 1
    while size * 2 <= width:
        half = powers[size]
        powers[size * 2] = half[:-size] + half[size:]
        size *= 2
    for size in sorted(powers, reverse=True):
        while have + size <= width:
            part = powers[size][have : have + n]
            total = part.copy() if total is None else total + part
            have += size
    return np.packbits(total > width // 2, axis=1).view(np.uint64).ravel()


class ItemIndex:
    """Fingerprints of a bounded block of items with one lookup for each block of bits."""

    def __init__(self, items: list[tuple[int, str | None]], width: int = WIDTH) -> None:
        known = WordIds()
        self.width = width
        owner, starts, prints, flat = [], [], [], [np.zeros(0, np.uint64)]
        at = 0
        for item_id, text in items:
            ids = word_hashes(words(text), known)
            flat.append(ids)
            fp = window_fingerprints(ids, width)
            owner.append(np.full(len(fp), item_id, np.int64))
            starts.append(at + np.arange(len(fp)))
            prints.append(fp)
            at += len(ids)
        self.words = np.concatenate(flat)
        self.owner = np.concatenate(owner) if owner else np.zeros(0, np.int64)
        self.start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.prints = np.concatenate(prints) if prints else np.zeros(0, np.uint64)
        spread = Counter()
        for ids in flat[1:]:
            spread.update(set(pairs(ids).tolist()))
        self.weight = {k: float(np.log1p(len(items) / n)) for k, n in spread.items()}
        self.tables, self.order, self.sorted = [], [], []
        for low, size in _BLOCKS:
            block = self.block(self.prints, low, size)
            seen = np.zeros(1 << size, bool)
            seen[block] = True
            self.tables.append(seen)
            self.order.append(np.argsort(block, kind="stable"))
            self.sorted.append(block[self.order[-1]])

    @staticmethod
    def block(prints: np.ndarray, low: int, size: int) -> np.ndarray:
        return ((prints >> np.uint64(low)) & np.uint64((1 << size) - 1)).astype(np.int64)

    def within_radius(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, item window) of all pairs of fingerprints at most RADIUS bits apart."""
        at, window = [], []
        for (low, size), seen, order, values in zip(_BLOCKS, self.tables, self.order, self.sorted):
            block = self.block(prints, low, size)
            hit = np.flatnonzero(seen[block])
            left, right = np.searchsorted(values, block[hit], "left"), np.searchsorted(values, block[hit], "right")
            sizes = right - left
            where = np.repeat(hit, sizes)
            member = order[np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(left, sizes)]
            near = np.bitwise_count(prints[where] ^ self.prints[member]) <= RADIUS
            at.append(where[near])
            window.append(member[near])
        both = np.unique(np.stack([np.concatenate(at), np.concatenate(window)]), axis=1)
        return both[0], both[1]

    def similarity(self, a: np.ndarray, b: np.ndarray) -> float:
        """Weighted Jaccard similarity of the shingles of two runs of words."""
        x, y = set(pairs(a).tolist()), set(pairs(b).tolist())
        weigh = lambda s: sum(self.weight.get(k, 1.0) for k in s)
        union = weigh(x | y)
        return weigh(x & y) / union if union else 0.0


def pairs(ids: np.ndarray) -> np.ndarray:
    return mix(ids[:-1] * MIX_A + mix(ids[1:])) if len(ids) > 1 else ids


def _search(items: list[tuple[int, str | None]], least: float, exact: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, known = ItemIndex(items), WordIds()
        w = index.width
        for batch in batches:
            doc, item, best, windows = [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = word_hashes(words(text), known)
                if len(ids) < w or not len(index.prints):
                    continue
                where, member = index.within_radius(window_fingerprints(ids, w))
                found: dict[int, list[float]] = {}
                for at, m in zip(where.tolist(), member.tolist()):
                    mine, theirs = ids[at : at + w], index.words[index.start[m] : index.start[m] + w]
                    if exact and not np.array_equal(mine, theirs):
                        continue
                    if (s := index.similarity(mine, theirs)) >= least:
                        found.setdefault(int(index.owner[m]), []).append(s)
                for k, v in found.items():
                    doc.append(doc_id)
                    item.append(k)
                    best.append(max(v))
                    windows.append(len(v))
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(item, pa.int64()), pa.array(best, pa.float64()), pa.array(windows, pa.int64())],
                ["doc_id", "item_id", "similarity", "windows"],
            )

    return run


def leaks(documents: DataFrame, items: DataFrame, least: float = 1.0, exact: bool = True) -> DataFrame:
    """(doc_id, item_id, similarity, windows): documents with a window like one of an item.

    ``windows`` counts the pairs of windows of at least ``least`` similarity; with ``exact``
    only windows equal word by word count. Below 1.0 the radius loses most: one changed word
    moves about eight of the 64 bits of a ten-word window, so edited windows seldom meet.
    """
    own = items.filter("item_id is not null").select("item_id", "text").dropDuplicates()
    blocks = max(1, -(-own.count() // ITEM_BLOCK))
    numbered = own.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    parts = []
    for k in range(blocks):
        rows = [(r.item_id, r.text) for r in numbered.filter(F.col("block") == k).collect()]
        parts.append(documents.filter("doc_id is not null").select("doc_id", "text").mapInArrow(_search(rows, least, exact), "doc_id long, item_id long, similarity double, windows long"))
    return reduce(DataFrame.unionByName, parts)


def contaminated(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) with at least WIDTH consecutive words in common."""
    return leaks(documents, items).select("doc_id", "item_id").distinct()


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, suite, documents): into how many documents each item leaked by a run of WIDTH equal words.

    Of rows with one item id the suite is the least."""
    found = contaminated(documents, items).groupBy("item_id").agg(F.count("*").alias("documents"))
    return items.filter("item_id is not null").groupBy("item_id").agg(F.min("suite").alias("suite")).join(found, "item_id", "left").na.fill(0, ["documents"])
