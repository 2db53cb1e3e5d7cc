"""Search, merging of hits, contexts and sources, against brute force and worked cases."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from textloom.functions.vectors import HashingEmbedder, cosine_distance, embedded
from textloom.operators import retrieval as R

VECTORS = "vec_id long, embedding array<float>"


def _brute(vectors: dict[int, np.ndarray], q: np.ndarray, k: int) -> list[int]:
    d = sorted((round(1 - float(q @ v) / float(np.linalg.norm(q) * np.linalg.norm(v)), 12), i) for i, v in vectors.items())
    return [i for _, i in d[:k]]


def test_nearest_equals_brute_force_with_blocks(spark, data, monkeypatch):
    rows = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()}
    corpus = spark.read.parquet(f"{data}/embeddings.parquet").repartition(3)
    queries = corpus.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    monkeypatch.setattr(R, "QUERY_BLOCK", 7)
    got: dict = {}
    for r in R.nearest(queries, corpus, 8).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: _brute(rows, rows[q], 8) for q in rows if q % 20 == 0}


def test_cell_search_recall(spark, data, tmp_path):
    corpus = spark.read.parquet(f"{data}/embeddings.parquet")
    queries = corpus.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = {(r.query_id, r.vec_id) for r in R.nearest(queries, corpus, 8).collect()}
    near = {(r.query_id, r.vec_id) for r in R.CellIndex().fit(corpus).store(corpus, str(tmp_path / "cells")).search(queries, 8).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_dirty_vectors_and_ties(spark):
    rows = [(5, [1.0, 0.0]), (3, [2.0, 0.0]), (4, [0.0, 0.0]), (6, None), (7, [0.0, 1.0]), (3, [2.0, 0.0])]
    corpus = spark.createDataFrame(rows, VECTORS).withColumn("distance", F.lit("clash"))
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<float>")
    assert [r.vec_id for r in R.nearest(queries, corpus, 4).orderBy("rank").collect()] == [3, 3, 5, 7]
    assert R.nearest(queries.limit(0), corpus, 4).isEmpty() and R.nearest(queries, corpus.limit(0), 4).isEmpty()
    one = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0])], "a array<float>, b array<float>")
    assert one.select(cosine_distance(F.col("a"), F.col("b"))).first()[0] == 1.0


HIT = "query_id long, url string, chunk_index int, id string, text string, title string, distance double, rank int"


def test_adjacent_hits_merge(spark):
    hits = [("u1", 3, 0.10), ("u2", 0, 0.12), ("u1", 4, 0.15), ("u2", 2, 0.18), ("u1", 6, 0.20)]
    rows = [(1, u, k, f"{u}#chunk-{k}", f"t{k}", "T" if k else None, d, n + 1) for n, (u, k, d) in enumerate(hits)]
    merged = R.merge_adjacent(spark.createDataFrame(rows, HIT)).orderBy("place").collect()
    assert [(m.url, m.chunk_index, m.last_index, m.distance) for m in merged] == [("u1", 3, 4, 0.10), ("u2", 0, 0, 0.12), ("u2", 2, 2, 0.18), ("u1", 6, 6, 0.20)]
    assert merged[0].id == "u1#chunk-3" and merged[0].text == "t3\n\nt4"
    top = R.top_contexts(spark.createDataFrame(rows, HIT), 3)
    assert R.context_blocks(top).first().context == "--- Context 1 ---\nt3\n\nt4\n\n--- Context 2 ---\nt0\n\n--- Context 3 ---\nt2"
    assert [(s.url, s.title) for s in R.cited_sources(top).orderBy("position").collect()] == [("u1", "T"), ("u2", "")]


def test_equal_distances_keep_the_order_of_first_pages(spark):
    rows = [(1, "b", 9, "b9", "x", "", 0.5, 1), (1, "a", 1, "a1", "x", "", 0.5, 2), (1, "b", 2, "b2", "x", "", 0.5, 3)]
    assert [m.id for m in R.merge_adjacent(spark.createDataFrame(rows, HIT)).orderBy("place").collect()] == ["b2", "b9", "a1"]


def test_embedder_is_deterministic(spark):
    df = spark.createDataFrame([("Alpha beta",), ("alpha BETA",), (None,)], "t string").select(embedded(F.col("t"), HashingEmbedder(16)).alias("e")).collect()
    assert df[0].e == df[1].e and len(df[0].e) == 16 and not any(df[2].e)


def test_nearest_keeps_the_best_over_many_tiles(monkeypatch):
    rng = np.random.default_rng(1)
    best, all_d = R.Nearest(3, 4), []
    for start in range(0, 60, 20):
        d = np.round(rng.random((3, 20)), 1)
        best.see(np.arange(3), d, np.arange(start, start + 20))
        all_d.append(d)
    d = np.concatenate(all_d, axis=1)
    for q in range(3):
        assert best.owner[best.query == q].tolist() == sorted(range(60), key=lambda i: (d[q, i], i))[:4]


def test_thresholds_hold_at_any_size(spark):
    from textloom.operators import sampling as S

    assert S.threshold(10, 5) == S.LOWEST + S.SPAN - 1 and abs(S.rate(S.threshold(1000, 10**11)) - 1e-8) < 1e-15
    rows = spark.range(200_000).withColumnRenamed("id", "k")
    assert rows.filter(S.drawn(F.col("k"), S.threshold(9, 5))).count() == 200_000
    assert 800 < rows.filter(S.drawn(F.col("k"), S.threshold(1000, 200_000))).count() < 1200
    import pytest

    with pytest.raises(RuntimeError):
        S.required(0, 10**11, "anything")
