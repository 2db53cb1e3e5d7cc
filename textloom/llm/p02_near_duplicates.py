"""Near-duplicate records with small edits.

Records are compared by the set of their runs of ``width`` consecutive words. Records
with the same set form a class; one representative of each goes on. Of every set,
``POSITIONS`` min-hashes are kept, one byte each: a positional byte signature. The
inverted index has one posting for each block of ``BLOCK`` neighbouring bytes, keyed by
its position and content; every pair that shares a posting is a candidate. Its shared
positional bytes are then tallied over the whole signature and the pair is kept if it
reaches the minimum that a pair at the threshold reaches in all but about one case in ten
million (``least_matches``). What remains is verified exactly on the sets.

Recall of the candidate step: a pair at similarity s shares no block with probability
(1 - s**BLOCK)**(POSITIONS/BLOCK), which is 0.00014 at 0.6 and under 1e-14 at 0.8.

Defined results: NULL and empty texts, and texts under ``min_words`` words or shorter
than ``width`` words, match nothing; repeated page ids are one row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.text import MIX_A, MIX_B, WordIds, mix, shingle_hashes, word_hashes, words
from textloom.session import cut

BLOCK, POSITIONS = 4, 256
#: A posting list longer than this is split, so that no task holds all pairs of one key.
SPLIT = 2000
#: Parts into which the rows of a hot class are spread.
SALTS = 16

_K = np.arange(1, POSITIONS + 1, dtype=np.uint64)
_FACTOR = (mix(_K * MIX_A) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_SHIFT = (mix(_K * MIX_B) >> np.uint64(32)).astype(np.uint32)


def shingle_set(text: str | None, ids: WordIds, width: int, min_words: int) -> np.ndarray | None:
    tokens = words(text)
    if len(tokens) < max(width, min_words):
        return None
    return np.unique(shingle_hashes(word_hashes(tokens, ids), width))


def byte_signature(shingles: np.ndarray) -> bytes:
    """One byte for each of POSITIONS min-hashes of the set."""
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(POSITIONS, np.uint32(0xFFFFFFFF))
    for at in range(0, len(h), 2048):
        least = np.minimum(least, (h[at : at + 2048, None] * _FACTOR + _SHIFT).min(axis=0))
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()


def least_matches(similarity: float) -> int:
    """Shared positional bytes that a pair of this similarity has but for 5.2 standard deviations."""
    p = similarity + (1 - similarity) / 256
    return max(1, math.floor(POSITIONS * p - 5.2 * math.sqrt(POSITIONS * p * (1 - p))))


def _signatures(width: int, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for batch in batches:
            page, class_key, signature = [], [], []
            for page_id, text in zip(batch.column("page_id").to_pylist(), batch.column("text").to_pylist()):
                if (s := shingle_set(text, ids, width, min_words)) is None:
                    continue
                page.append(page_id)
                signature.append(byte_signature(s))
                class_key.append(np.array([mix(s).sum(dtype=np.uint64), mix(s * MIX_B).sum(dtype=np.uint64)]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(page, pa.int64()), pa.array(class_key, pa.binary()), pa.array(signature, pa.binary())], ["page_id", "class_key", "signature"])

    return run


def _sets(width: int, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for batch in batches:
            sets = [shingle_set(t, ids, width, min_words) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array([None if s is None else s.tobytes() for s in sets], pa.binary())], ["page_id", "shingles"])

    return run


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, POSITIONS) for k in ("signature_a", "signature_b"))
            shared = (a == b).sum(axis=1)
        else:
            shared = np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(shared, pa.int32())], ["a", "b", "shared"])


def _jaccard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for x, y in zip(batch.column("shingles_a").to_pylist(), batch.column("shingles_b").to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both / (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out, pa.float64())], ["a", "b", "similarity"])


def classes(pages: DataFrame, width: int, min_words: int) -> DataFrame:
    """(page_id, rep, signature): rep is the least page id with the same shingle set."""
    signed = cut(pages.filter("page_id is not null").select("page_id", "text").mapInArrow(_signatures(width, min_words), "page_id long, class_key binary, signature binary"))
    reps = signed.groupBy("class_key").agg(F.min("page_id").alias("rep"), F.count("*").alias("n"))
    # most classes have one member: only the others need the join
    several = reps.filter("n > 1").select("class_key", "rep", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    # a page copied very often is one class: its rows are spread
    return signed.withColumn("salt", F.pmod("page_id", F.lit(SALTS)).cast("int")).join(several, ["class_key", "salt"], "left").select("page_id", F.coalesce("rep", "page_id").alias("rep"), "signature").dropDuplicates(["page_id"])


def candidates(reps: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a < b) of representatives that share a posting and enough positional bytes."""
    index = F.transform(F.sequence(F.lit(0), F.lit(POSITIONS // BLOCK - 1)), lambda i: F.xxhash64(i, F.substring(F.col("signature"), i * BLOCK + 1, F.lit(BLOCK))))
    postings = reps.select(F.col("page_id").alias("id"), F.explode(index).alias("key"))
    lists = postings.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key", F.ceil(F.col("n") / SPLIT).cast("int").alias("parts"))
    split = postings.join(lists, "key")
    # a list of more than SPLIT postings is cut into parts; each part of the one side meets each part of the other
    left = split.select("key", F.col("id").alias("a"), F.explode(F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))).alias("part"))
    right = split.select("key", F.col("id").alias("b"), F.when(F.col("parts") == 1, F.lit(0)).otherwise(F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).alias("part"))
    pairs = left.join(right, ["key", "part"]).filter("a < b").select("a", "b").distinct()
    signature = reps.select(F.col("page_id").alias("id"), "signature")
    tallied = (
        pairs.join(signature.withColumnsRenamed({"id": "a", "signature": "signature_a"}), "a")
        .join(signature.withColumnsRenamed({"id": "b", "signature": "signature_b"}), "b")
        .select("a", "b", "signature_a", "signature_b")
        .mapInArrow(_tally, "a long, b long, shared int")
    )
    return tallied.filter(F.col("shared") >= least_matches(similarity)).select("a", "b")


def similar_classes(pages: DataFrame, similarity: float, width: int, min_words: int) -> tuple[DataFrame, DataFrame]:
    """(members, links): page_id -> rep, and the verified pairs (a, b, similarity) of representatives."""
    members = cut(classes(pages, width, min_words))
    reps = members.filter("page_id = rep").select("page_id", "signature")
    found = cut(candidates(reps, similarity))
    needed = found.select(F.explode(F.array("a", "b")).alias("page_id")).distinct()
    sets = pages.select("page_id", "text").join(needed, "page_id", "left_semi").mapInArrow(_sets(width, min_words), "page_id long, shingles binary").dropDuplicates(["page_id"])
    verified = (
        found.join(sets.withColumnsRenamed({"page_id": "a", "shingles": "shingles_a"}), "a")
        .join(sets.withColumnsRenamed({"page_id": "b", "shingles": "shingles_b"}), "b")
        .select("a", "b", "shingles_a", "shingles_b")
        .mapInArrow(_jaccard, "a long, b long, similarity double")
        .filter(F.col("similarity") >= similarity)
    )
    return members.select("page_id", "rep"), verified


def similar_pairs(pages: DataFrame, similarity: float = 0.6, width: int = 3, min_words: int = 50) -> DataFrame:
    """All pairs of rows, copies included: (page_id_a < page_id_b).

    The number of rows is that of the pairs asked for; the work before the last two joins
    is in classes, so copies cost nothing until they are written out.
    """
    members, links = similar_classes(pages, similarity, width, min_words)
    links = links.select("a", "b")
    of_a = members.withColumnsRenamed({"page_id": "x", "rep": "a"})
    of_b = members.withColumnsRenamed({"page_id": "y", "rep": "b"})
    across = links.join(of_a, "a").join(of_b, "b").select(F.least("x", "y").alias("page_id_a"), F.greatest("x", "y").alias("page_id_b"))
    copies = members.filter("page_id <> rep").select("rep").distinct()
    copied = members.join(copies, "rep", "left_semi")
    within = copied.withColumnRenamed("page_id", "page_id_a").join(copied.withColumnRenamed("page_id", "page_id_b"), "rep").filter("page_id_a < page_id_b").select("page_id_a", "page_id_b")
    return across.unionByName(within)


def components(links: DataFrame) -> DataFrame:
    """(id, group): the least id reachable over links (a, b), by alternating large and small stars.

    Each round is written to the shared checkpoint folder; only two numbers reach the driver.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_of = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_of, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        after = cut(small)
        same = after.exceptAll(edges).isEmpty() and edges.exceptAll(after).isEmpty()
        edges = after
        if same:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("group")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("group"))).distinct()


def groups(pages: DataFrame, similarity: float = 0.6, width: int = 3, min_words: int = 50) -> DataFrame:
    """(page_id, class_id, group_id, links): one row per compared record.

    ``class_id`` is the least page id with the same shingle set, ``group_id`` the least one
    reachable over links, ``links`` the number of other classes the record's class is similar to.
    """
    members, links = similar_classes(pages, similarity, width, min_words)
    links = cut(links)
    linked = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    group = components(links).withColumnsRenamed({"id": "rep", "group": "group_id"})
    return members.join(group, "rep", "left").join(linked, "rep", "left").select("page_id", F.col("rep").alias("class_id"), F.coalesce("group_id", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
