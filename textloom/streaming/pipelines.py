"""Structured Streaming forms: page ingestion, sessions, capped histories."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textloom.config import EngineConfig
from textloom.operators.store import ChunkStore


def table_stream(spark: SparkSession, path: str, schema: str | None = None, files_per_batch: int = 100) -> DataFrame:
    """A growing table as a stream, from the files whose path begins with ``path``; the schema is that of the files present unless given."""
    kind = schema or spark.read.parquet(path).schema
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path}*")  # a pattern may be a file as well as a folder


def upsert_stream(rows: DataFrame, store: ChunkStore, order: str, checkpoint: str, *ties: str, every: str | None = None):
    """Upsert each micro-batch by key, the row greatest by ``order`` and then ``ties`` winning whenever it comes.

    A batch delivered again, or rows that come late, change nothing, so the effect is once.
    ``every``: run on at this pace (a rate limit on what is read and written); else end with what is there.
    """

    def write(batch: DataFrame, _: int) -> None:
        store.merge(batch, *map(F.col, (order, *ties)))

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def session_stream(accesses: DataFrame, key: str, at: str, minutes: int = 30, late: str = "2 hours") -> DataFrame:
    """Sessions of a stream; a session is given out once the watermark has passed its end."""
    rows = accesses.withColumn(at, F.col(at).cast("timestamp")).filter(F.col(at).isNotNull()).withWatermark(at, late)
    return rows.groupBy(key, F.session_window(at, f"{minutes} minutes").alias("w")).agg(F.count("*").alias("accesses")).select(key, F.col("w.start").alias("started"), (F.col("w.end") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))).alias("last_access"), "accesses")


HISTORY = "session_id string, pos long, role string, content string"


def history_stream(messages: DataFrame, config: EngineConfig = EngineConfig(), expire: bool = True) -> DataFrame:
    """The last messages of each session, kept as state; every update gives the session's history out anew.

    State is one bounded list a session, dropped after the session's idle time with ``expire``;
    a stream that is to end by itself (``availableNow``) must run without, as a clock never ends.
    """
    most = 2 * config.session_turns

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = {p: (r, c) for p, r, c in zip(*state.get)} if state.exists else {}
        for batch in batches:
            for p, r, c in zip(batch["pos"], batch["role"], batch["content"]):
                held[int(p)] = (r, c)
        kept = sorted(held)[-most:]
        state.update(([int(p) for p in kept], [held[p][0] for p in kept], [held[p][1] for p in kept]))
        if expire:
            state.setTimeoutDuration(config.session_minutes * 60_000)
        yield pd.DataFrame({"session_id": [key[0]] * len(kept), "pos": kept, "role": [held[p][0] for p in kept], "content": [held[p][1] for p in kept]})

    rows = messages.filter("session_id is not null and pos is not null").select("session_id", "pos", "role", "content")
    return rows.groupBy("session_id").applyInPandasWithState(update, HISTORY, "pos array<long>, role array<string>, content array<string>", "update", GroupStateTimeout.ProcessingTimeTimeout if expire else GroupStateTimeout.NoTimeout)


def latest_output(stream: DataFrame, key: str, path: str, checkpoint: str) -> DataFrame:
    """Run an update stream over all that is there; of each key the rows it gave out last."""
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(stream.withColumn("_batch", F.lit(0)).schema).parquet(f"{path}/batch=*")
    last = rows.groupBy(key).agg(F.max("_batch").alias("_batch"))
    return rows.join(last, [key, "_batch"], "left_semi").drop("_batch")


def appended_to(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run an append stream over all that is there into Parquet files and give them."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
