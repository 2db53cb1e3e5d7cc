"""Histories, prompts and sessions; batch and stream give the same."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from textloom.operators import dialogue as D
from textloom.plans import queries as Q
from textloom.streaming import pipelines as P

MESSAGE = "session_id string, pos long, role string, content string, sent_at timestamp"


def _messages(spark, n, session="s"):
    return spark.createDataFrame([(session, k, "user" if k % 2 == 0 else "assistant", f"m{k}", None) for k in range(n)], MESSAGE)


def test_windows_of_history(spark):
    for n, most, left in ((14, 12, 12), (14, 6, 6), (42, 40, 40), (3, 12, 3)):
        rows = D.last_messages(_messages(spark, n), most).orderBy("pos").collect()
        assert [r.pos for r in rows] == list(range(n - left, n))


def test_transcript_labels_and_cut(spark):
    rows = spark.createDataFrame([("s", 0, "system", "x" * 600, None), ("s", 1, "user", None, None), ("s", 2, "user", "hi", None)], MESSAGE)
    lines = D.transcripts(rows).first().transcript.split("\n")
    assert lines == ["Assistant: " + "x" * 500, "User: ", "User: hi"]


def test_rewriting_skips_sessions_without_history(spark):
    class Upper:
        def generate(self, prompts: pd.Series) -> pd.Series:
            assert prompts.notna().all()
            return prompts.map(lambda p: "" if "empty" in p else "REWRITTEN")

    asked = spark.createDataFrame([("s", "what"), ("t", "first"), ("e", "empty")], "session_id string, message string")
    history = _messages(spark, 2).unionByName(_messages(spark, 2, "e"))
    got = {r.session_id: (r.rewritten, r.query) for r in D.rewritten_queries(asked, history, Upper()).collect()}
    assert got == {"s": ("REWRITTEN", "REWRITTEN"), "t": (None, "first"), "e": ("empty", "empty")}


def test_message_list_holds_the_original_message(spark):
    asked = spark.createDataFrame([("s", "what")], "session_id string, message string")
    context = spark.createDataFrame([("s", "CTX")], "session_id string, context string")
    got = D.message_lists(asked, _messages(spark, 14), context).first().messages
    assert len(got) == 13 and got[0].content == "m2" and got[-1].content.endswith("CTX\n\n---\n\nUser question: what")


def test_append_and_trim(spark):
    turns = spark.createDataFrame([("s", "q", "a"), ("new", "q", "a")], "session_id string, message string, answer string")
    grown = D.appended(_messages(spark, 40), turns)
    assert [r.pos for r in grown.filter("session_id = 's'").orderBy("pos").collect()] == list(range(2, 42))
    assert [(r.pos, r.content) for r in grown.filter("session_id = 'new'").orderBy("pos").collect()] == [(0, "q"), (1, "a")]


def test_sessions_end_after_more_than_the_gap(spark):
    rows = spark.sql("select 'k' as k, timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, s) as at, 1 as session from values (0), (1800), (3601), (null) as t(s)").unionByName(spark.sql("select 'k' as k, cast(null as timestamp) as at, 2 as session"))
    got = D.sessions(rows, "k", "at").orderBy("session").collect()
    assert [r.accesses for r in got] == [2, 1]
    assert sorted(r.accesses for r in D.windowed_sessions(rows.filter("at is not null"), "k", "at").collect()) == [1, 2]


def test_repeated_deliveries(spark):
    rows = spark.sql("select * from values ('s', 0L, 'user', 'a', timestamp'2024-01-01'), ('s', 0L, 'user', 'b', timestamp'2024-01-02'), ('s', 0L, 'user', 'c', null), (null, 0L, 'user', 'x', null) as t(session_id, pos, role, content, sent_at)")
    assert [r.content for r in D.clean_messages(rows).collect()] == ["b"]
    assert D.clean_messages(rows.limit(0)).isEmpty()


def test_streams_equal_batches(spark, data, tmp_path):
    key = lambda df: sorted(map(tuple, df.select(sorted(df.columns)).collect()))
    assert key(Q.stream_histories(spark, data)) == key(D.last_messages(spark.read.parquet(f"{data}/message.parquet").select("session_id", "pos", "role", "content"), 40))
    assert Q.stream_ingest(spark, data).count() == spark.read.parquet(f"{data}/chunk.parquet").select("id").distinct().count()
    # files that come one by one: late and repeated rows change nothing
    land = str(tmp_path / "land")
    chunks = spark.read.parquet(f"{data}/chunk.parquet").select("id", F.unix_micros(F.col("indexed_at").cast("timestamp")).alias("at"))
    chunks.repartition(5).write.parquet(land)
    store = P.ChunkStore(spark, str(tmp_path / "store"), "id string, at bigint")
    P.upsert_stream(P.table_stream(spark, f"{land}/part", "id string, at bigint", 1), store, "at", str(tmp_path / "c")).awaitTermination()
    assert key(store.read()) == key(chunks.groupBy("id").agg(F.max("at").alias("at")))


def test_idle_sessions_begin_anew(spark):
    rows = spark.sql("select 's' as session_id, cast(p as bigint) as pos, 'user' as role, 'm' as content, timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, s) as sent_at from values (0, 0), (1, 60), (2, 2000), (3, null), (4, 2100) as t(p, s)")
    at = lambda s: F.expr(f"timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, {s})")
    assert sorted(r.pos for r in D.live_messages(rows, at(3900)).collect()) == [2, 3, 4]
    assert D.live_messages(rows, at(3901)).isEmpty() and D.live_messages(rows.limit(0), at(0)).isEmpty()
