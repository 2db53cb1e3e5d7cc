"""Nearest chunks of a query set, merging of neighbouring hits, contexts and sources."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.vectors import matrix, unit
from textloom.operators.sampling import drawn, required, threshold

#: Query vectors sent to the executors at a time; the bound of what is broadcast.
QUERY_BLOCK = 4096
#: Distances computed at a time in a worker.
TILE = 1 << 21
HITS = "query_id long, vec_id long, distance double"


class Nearest:
    """The k nearest vectors seen so far of each query of a block; ties go to the lesser id."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.bound = k, np.full(queries, np.inf)
        self.query, self.distance, self.owner = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def see(self, rows: np.ndarray, distances: np.ndarray, ids: np.ndarray) -> None:
        """``distances`` of the queries ``rows`` to the vectors ``ids``; NaN is near nothing."""
        distances = np.where(np.isnan(distances), np.inf, distances)
        reach = self.bound[rows]
        if distances.shape[1] > self.k:
            reach = np.minimum(reach, np.partition(distances, self.k - 1, axis=1)[:, self.k - 1])
        at, column = np.nonzero((distances <= reach[:, None]) & np.isfinite(distances))
        query, distance, owner = np.concatenate([self.query, rows[at]]), np.concatenate([self.distance, distances[at, column]]), np.concatenate([self.owner, ids[column]])
        order = np.lexsort((owner, distance, query))
        query, distance, owner = query[order], distance[order], owner[order]
        place = np.arange(len(query)) - np.searchsorted(query, query, "left")
        keep, last = place < self.k, place == self.k - 1
        self.query, self.distance, self.owner = query[keep], distance[keep], owner[keep]
        self.bound[query[last]] = distance[last]


def _best_of_partition(queries: np.ndarray, ids: np.ndarray, k: int, probes: np.ndarray | None = None):
    """Of each partition the best k vectors for each query, so that only k rows a query are shuffled.

    probes: [query, cell], the cells a query looks into; vectors then come with their cell.
    """
    q = unit(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Nearest(len(q), k)
        for batch in batches:
            if not batch.num_rows or not len(q):
                continue
            m = unit(matrix(batch.column("embedding")))
            if m.shape[1] != q.shape[1]:
                continue
            own = batch.column("vec_id").to_numpy(zero_copy_only=False)
            groups = [(np.arange(len(q)), np.arange(len(m)))]
            if probes is not None:
                cells = batch.column("cell").to_numpy(zero_copy_only=False)
                groups = [(np.flatnonzero((probes == c).any(axis=1)), np.flatnonzero(cells == c)) for c in np.unique(cells)]
            for asking, there in groups:
                step = max(1, TILE // max(1, len(asking)))
                for a in range(0, len(there) if len(asking) else 0, step):
                    part = there[a : a + step]
                    best.see(asking, 1.0 - q[asking] @ m[part].T, own[part])
        yield pa.RecordBatch.from_arrays([pa.array(ids[best.query], pa.int64()), pa.array(best.owner, pa.int64()), pa.array(best.distance, pa.float64())], ["query_id", "vec_id", "distance"])

    return run


def _query_blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of the query set in blocks of about ``QUERY_BLOCK`` rows."""
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    for b in range(blocks):
        rows = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) if blocks > 1 else queries
        held = rows.select("query_id", "embedding").filter("embedding is not null and query_id is not null").orderBy("query_id").toArrow()
        yield held.column("query_id").to_numpy(), matrix(held.column("embedding")) if held.num_rows else np.zeros((0, 1))


def rank_hits(hits: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query with their rank from 1; ties by id."""
    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """Exact cosine top k. queries: (query_id, embedding), corpus: (vec_id, embedding).

    The query set goes out in blocks of ``QUERY_BLOCK`` vectors, each compared with a
    partition's vectors by one matrix product; a filter on ``corpus`` is applied below the
    search. NULL, empty and zero vectors are near nothing.
    """
    parts = [corpus.filter("vec_id is not null").select("vec_id", "embedding").mapInArrow(_best_of_partition(vectors, ids, k), HITS) for ids, vectors in _query_blocks(queries)]
    return rank_hits(reduce(DataFrame.unionByName, parts), k)


class CellIndex:
    """Approximate search: every vector lies in the cell of its nearest centre; a query looks into the nearest cells.

    Centres are fitted on a bounded sample (``SAMPLE`` vectors by hash of the id, at most
    ``MOST_CELLS`` of them); all vectors are indexed. ``store`` writes them once, one folder a
    cell, and ``search`` reads the folders of the probed cells only. The number of cells to probe
    is chosen on sampled vectors that fitted no centre, so that nearly all of their true
    neighbours among the sample are met; p of c cells hold about p / c of the vectors.
    """

    SAMPLE, MOST_CELLS = 20_000, 4096

    def __init__(self, cells: int | None = None, probes: int | None = None, rounds: int = 8) -> None:
        self.cells, self.probes, self.rounds, self.centres, self.path = cells, probes, rounds, None, None

    def fit(self, corpus: DataFrame) -> CellIndex:
        corpus = corpus.filter("vec_id is not null and embedding is not null")
        n = corpus.count()
        held = corpus.filter(drawn(F.col("vec_id"), threshold(self.SAMPLE, n))).select("vec_id", "embedding").toArrow().sort_by("vec_id")
        required(held.num_rows, n, "the centres of cells")
        m = unit(matrix(held.column("embedding"))) if held.num_rows else np.zeros((0, 1))
        m = m[~np.isnan(m).any(axis=1)]
        cells = min(self.MOST_CELLS, self.cells or max(1, int(np.sqrt(n)) // 2))
        rng = np.random.default_rng(0)
        apart = np.zeros(len(m), bool)
        apart[:: max(2, len(m) // 256)] = len(m) > 20 * cells
        fitted = m[~apart]
        centres = fitted[rng.choice(len(fitted), min(cells, len(fitted)), replace=False)] if len(fitted) else np.zeros((1, m.shape[1]))
        for _ in range(self.rounds):
            near = (fitted @ centres.T).argmax(axis=1)
            for c in range(len(centres)):
                if (near == c).any():
                    v = fitted[near == c].sum(axis=0)
                    centres[c] = v / max(1e-12, np.linalg.norm(v))
        self.centres = centres
        self.probes = self.probes or self._probes_for(m, m[apart] if apart.any() else m[:: max(1, len(m) // 256)])
        return self

    def _probes_for(self, m: np.ndarray, q: np.ndarray, k: int = 10, share: float = 0.97) -> int:
        """Least number of cells in which ``share`` of the true neighbours of ``q`` among the sample lie."""
        if len(m) <= k or len(self.centres) == 1:
            return len(self.centres)
        near = np.argpartition(-(q @ m.T), k, axis=1)[:, : k + 1]
        cell = (m @ self.centres.T).argmax(axis=1)
        place = np.argsort(np.argsort(-(q @ self.centres.T), axis=1), axis=1)
        return int(np.quantile(np.take_along_axis(place, cell[near], axis=1), share)) + 1

    def nearest_cells(self, vectors: np.ndarray, count: int) -> np.ndarray:
        """[vector, place]: the nearest cells of each; vectors of another length or without direction lie anywhere."""
        m = unit(vectors)
        s = np.nan_to_num(m @ self.centres.T, nan=-2.0) if m.shape[1:] == self.centres.shape[1:] else np.full((len(m), len(self.centres)), -2.0)
        return np.argsort(-s, axis=1, kind="stable")[:, :count]

    def placed(self, corpus: DataFrame) -> DataFrame:
        """(vec_id, embedding, cell) of every vector."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                best = self.nearest_cells(matrix(batch.column("embedding")), 1)[:, 0] if batch.num_rows else np.zeros(0)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), pa.array(best.astype(np.int32))], ["vec_id", "embedding", "cell"])

        return corpus.filter("vec_id is not null").select("vec_id", "embedding").mapInArrow(run, "vec_id long, embedding array<float>, cell int")

    def store(self, corpus: DataFrame, path: str) -> CellIndex:
        """Write all vectors below ``path``, one folder for each cell; large cells are several files."""
        self.placed(corpus).hint("rebalance", "cell").write.partitionBy("cell").mode("overwrite").parquet(path)
        self.path = path
        return self

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """Like ``nearest``, among the stored vectors of the probed cells; queries go out in blocks, so a hot cell is no hot key."""
        stored = queries.sparkSession.read.schema("vec_id long, embedding array<float>, cell int").parquet(self.path)
        parts = []
        for ids, vectors in _query_blocks(queries):
            probes = self.nearest_cells(vectors, min(self.probes, len(self.centres))) if len(ids) else np.zeros((0, 1), int)
            wanted = np.unique(probes).tolist()  # at most MOST_CELLS
            rows = stored.filter(F.col("cell").isin(wanted) if wanted else F.lit(False))
            parts.append(rows.mapInArrow(_best_of_partition(vectors, ids, k, probes), HITS))
        return rank_hits(reduce(DataFrame.unionByName, parts), k)


def merge_adjacent(hits: DataFrame) -> DataFrame:
    """Hits (query_id, url, chunk_index, id, text, title, distance, rank) of neighbouring chunks become one.

    Islands of consecutive chunk numbers of a page: texts joined by a blank line in order of
    the number, least distance, id and title of the first. Output order (``place``): by
    distance, then by the first rank of the page, then by chunk number.
    """
    pages = Window.partitionBy("query_id", "url")
    marked = hits.withColumn("island", F.col("chunk_index") - F.row_number().over(pages.orderBy("chunk_index", "rank"))).withColumn("seen", F.min("rank").over(pages))
    merged = marked.groupBy("query_id", "url", "island").agg(
        F.min("chunk_index").alias("chunk_index"),
        F.max("chunk_index").alias("last_index"),
        F.min_by(F.struct("id", "title"), "chunk_index").alias("first"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"]), "\n\n").alias("text"),
        F.min("distance").alias("distance"),
        F.min("seen").alias("seen"),
    )
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "seen", "chunk_index"))
    return merged.select("query_id", "first.id", "url", "first.title", "chunk_index", "last_index", "text", "distance", place.alias("place"))


def top_contexts(hits: DataFrame, k: int) -> DataFrame:
    """The first ``k`` merged hits; merging comes before the cut."""
    return merge_adjacent(hits).filter(F.col("place") <= k)


def context_blocks(merged: DataFrame) -> DataFrame:
    """(query_id, context): numbered texts of a query's contexts, separated by blank lines."""
    part = F.concat(F.lit("--- Context "), F.col("place"), F.lit(" ---\n"), F.col("text"))
    return merged.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", part.alias("part")))), lambda x: x["part"]), "\n\n").alias("context"))


def cited_sources(merged: DataFrame) -> DataFrame:
    """(query_id, url, title, position): each address once, in order of first use, with the title met first."""
    first = merged.groupBy("query_id", "url").agg(F.min("place").alias("place"), F.coalesce(F.min_by("title", "place"), F.lit("")).alias("title"))
    return first.select("query_id", "url", "title", F.row_number().over(Window.partitionBy("query_id").orderBy("place")).alias("position"))


def source_links(title: Column, url: Column) -> Column:
    """Text of a link to a source: its title, else its address."""
    return F.coalesce(F.nullif(title, F.lit("")), url)
