"""The chunk table, selection against the store, statistics, the engine end to end."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from textloom.config import EngineConfig
from textloom.operators import ingest
from textloom.operators.store import ChunkStore, ConcurrentChange, last_rows
from textloom.plans.engine import Engine

ROW = "id string, text string, metadata struct<url: string>, n int"


def _rows(spark, *rows):
    return spark.createDataFrame([(i, t, (u,), n) for i, t, u, n in rows], ROW)


def test_store(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"), ROW)
    assert store.count() == 0
    assert store.upsert(_rows(spark, ("a", "1", "u", 1), ("a", "2", "u", 2), ("b", "1", "v", 1)), F.col("n")) == 3
    store.upsert(_rows(spark, ("a", "3", "u", 0), ("c", "1", "u", 1)), F.col("n"))
    assert {(r.id, r.text) for r in store.read().collect()} == {("a", "3"), ("b", "1"), ("c", "1")}
    store.merge(_rows(spark, ("a", "old", "u", -1), ("b", "new", "v", 9)), F.col("n"))
    assert {(r.id, r.text) for r in store.read().collect()} == {("a", "3"), ("b", "new"), ("c", "1")}
    again = ChunkStore(spark, str(tmp_path / "s"), ROW)
    again.delete_by_url("v")
    assert store.count() == 2
    store.replace_page("u", _rows(spark, ("a", "4", "u", 1)))
    assert [r.text for r in store.read().collect()] == ["4"]
    assert store.vacuum() >= 3 and store.count() == 1
    store.clear()
    assert store.count() == 0 and store.read().columns == ["id", "text", "metadata", "n"]


def test_store_rewrites_touched_buckets_and_tells_two_writers_apart(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"), ROW, buckets=16)
    store.upsert(_rows(spark, *((f"u{k}#chunk-{n}", "x", f"u{k}", n) for k in range(12) for n in range(3))))
    before = store._manifest()[1]
    store.upsert(_rows(spark, ("u3#chunk-0", "y", "u3", 0), ("u3#chunk-9", "y", "u3", 9)))
    after = store._manifest()[1]
    assert sum(before[b] != after[b] for b in before) == 1 and store.count() == 37
    store.replace_pages(spark.createDataFrame([("u3",), ("u5",)], "url string"))
    assert store.count() == 30
    with pytest.raises(ConcurrentChange):
        store._write_manifest(store._manifest()[0], {})


def test_last_rows_with_ties_and_nulls(spark):
    rows = _rows(spark, ("a", "x", "u", None), ("a", "y", "u", 1), (None, "z", "u", 5), ("b", "p", "u", None))
    assert {(r.id, r.text) for r in last_rows(rows, "id", F.col("n")).collect()} == {("a", "y"), ("b", "p")}


def test_limit_before_and_after(spark):
    urls = spark.createDataFrame([(k,) for k in "abcd"], "url string")
    stored = spark.createDataFrame([("a",)], "url string")
    pick = lambda **k: [r.url for r in ingest.to_crawl(urls, stored, "url", 2, F.col("url"), **k).orderBy("url").collect()]
    assert pick() == ["b", "c"] and pick(limit_first=True) == ["b"] and pick(force=True) == ["a", "b"]
    assert ingest.to_crawl(urls, stored, "url", 0, F.col("url")).count() == 3
    listed = urls.withColumn("g", F.lit("s"))
    chosen = listed.filter("url in ('b', 'c')")
    outcome = spark.createDataFrame([("s", True), ("s", None)], "g string, ok boolean")
    stats = ingest.crawl_stats(listed, chosen, outcome, "g")
    assert stats.collect() == [("s", 1, 1, 2)]
    assert ingest.stats_by_source(stats, "g").first().stats["s"].skipped == 2


def test_source_choice(spark):
    rows = spark.createDataFrame([("a", None), ("b", "blog")], "url string, source string")
    assert ingest.chosen_sources(rows, ["docs", "x"], ("docs", "blog")).count() == 1
    with pytest.raises(ValueError):
        ingest.chosen_sources(rows, ["x"], ("docs",))
    more = spark.createDataFrame([("c",)], "url string")
    assert ingest.union_pages(rows, more).filter("source is null").count() == 2


def test_engine(spark, tmp_path, data):
    pages = spark.read.parquet(f"{data}/raw_page.parquet").filter("page_id % 6 = 0 and length(text) > 0")
    engine = Engine(spark, str(tmp_path), EngineConfig(chunk_tokens=120, max_part_tokens=160, overlap_tokens=10))
    row = engine.index(pages, clear=True).first()
    assert row.pages == pages.count() and row.chunks >= row.pages and engine.health()["index_size"] == engine.store.count()
    first = engine.ask("how do feature flags work")
    assert first["rewritten_query"] is None and first["answer"].startswith("[extract]") and 0 < len(first["sources"]) <= 5
    second = engine.ask("and then", first["session_id"])
    assert second["rewritten_query"] == "and then" and engine.messages().count() == engine.messages(first["session_id"]).count() == 4
    only = engine.retrieve(spark.createDataFrame([(1, "flags")], "query_id long, query string"), "metadata.source = 'blog'")
    assert all("/news/" in r.url for r in only.collect())
    class Echo:
        def generate(self, prompts):
            return prompts.map(lambda p: "rewritten" if "Rewritten standalone query" in p else "answer")

    third = Engine(spark, str(tmp_path), generator=Echo()).ask("and then", first["session_id"])
    assert third["rewritten_query"] == "rewritten" and third["answer"] == "answer"
    job = engine.ingest(pages, ["blog", "nothing"], 3)
    for _ in range(120):
        if engine.job(job)["status"] != "running":
            break
        time.sleep(0.5)
    state = engine.job(job)
    assert state["status"] == "done" and state["stats"]["blog"]["success"] == 3 and state["index_size"] == engine.store.count()
    # a later job of another source keeps what is stored, and another process reads its state
    other = Engine(spark, str(tmp_path), EngineConfig(chunk_tokens=120, max_part_tokens=160, overlap_tokens=10), admin_token="secret")
    with pytest.raises(PermissionError):
        other.ingest(pages, ["docs"], 2)
    later = other.ingest(pages, ["docs", "blog"], 2, "secret")
    other._futures[-1].result(120)
    state = engine.job(later)
    assert state["stats"]["docs"]["success"] == 2 and state["stats"]["blog"]["success"] == 2 and other.pages.count() == 7
    assert other.store.read().select("metadata.url").distinct().count() == 7
    with pytest.raises(ValueError):
        engine.ask("  ")
    with pytest.raises(KeyError):
        engine.job("none")


def test_config_from_environment(monkeypatch):
    monkeypatch.setenv("TEXTLOOM_TOP_K", "7")
    assert EngineConfig.from_env().top_k == 7 and EngineConfig.from_env().fan_in == 8
