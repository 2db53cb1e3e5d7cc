"""Histories, transcripts, prompts and sessions of conversations."""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.config import EngineConfig


#: Texts of the prompts, fixed values.
TOLD = "Conversation so far:\n"
ASKED = "\n\nFollow-up question: "
WANTED = "\n\nRewritten standalone query:"
CONTEXT = "Here is relevant documentation context:\n\n"
QUESTION = "\n\n---\n\nUser question: "


class Generator(Protocol):
    """Anything that turns prompts into text; called on batches inside the executors."""

    def generate(self, prompts: pd.Series) -> pd.Series: ...


class ExtractiveStub:
    """Stands in for a text generator: the first line of the prompt's first context, labelled as an extract."""

    def generate(self, prompts: pd.Series) -> pd.Series:
        return prompts.map(lambda p: "[extract] " + next((x for x in (p or "").split("\n\n")[1:] if x.strip()), "")[:300])


def clean_messages(messages: DataFrame) -> DataFrame:
    """Messages without repeated deliveries: of equal (session, pos) the one sent last, ties by content."""
    order = F.struct(F.coalesce(F.col("sent_at"), F.timestamp_seconds(F.lit(-62135596800))), F.coalesce("content", F.lit("")))
    kept = messages.filter(F.col("session_id").isNotNull()).groupBy("session_id", "pos").agg(F.max_by(F.struct("role", "content", "sent_at"), order).alias("m"))
    return kept.select("session_id", "pos", "m.*")


def last_messages(messages: DataFrame, n: int) -> DataFrame:
    """The last ``n`` messages of each session, or all if it has fewer."""
    order = Window.partitionBy("session_id").orderBy(F.desc("pos"))
    return messages.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= n).drop("_n")


def live_messages(messages: DataFrame, now: Column, minutes: int = 30) -> DataFrame:
    """Messages of the session as it is at ``now``: those since the last idle time of more than ``minutes``.

    A session idle for longer at ``now`` has none; messages without a time belong to what came before them.
    """
    gap, order = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes)), Window.partitionBy("session_id").orderBy("pos")
    at = F.last(F.col("sent_at"), True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    timed = messages.withColumn("_at", at)
    fresh = F.coalesce((F.col("_at") > F.lag("_at").over(order) + gap).cast("int"), F.lit(0))
    numbered = timed.withColumn("_fresh", fresh).withColumn("_part", F.sum("_fresh").over(order))
    whole = Window.partitionBy("session_id")
    kept = numbered.withColumn("_last", F.max("_part").over(whole)).withColumn("_until", F.max("_at").over(whole))
    return kept.filter((F.col("_part") == F.col("_last")) & (F.col("_until").isNull() | (F.col("_until") + gap >= now))).select(*messages.columns)


def in_order(item: Column) -> Column:
    """An aggregate: ``item`` of all rows in order of ``pos``."""
    return F.transform(F.array_sort(F.collect_list(F.struct("pos", item.alias("item")))), lambda x: x["item"])


def transcripts(messages: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(session_id, transcript) of the last turns for rewriting: every role but user is Assistant, contents are cut."""
    label = F.when(F.col("role") == "user", F.lit("User")).otherwise(F.lit("Assistant"))
    line = F.concat(label, F.lit(": "), F.substring(F.coalesce("content", F.lit("")), 1, config.rewrite_chars))
    recent = last_messages(messages, 2 * config.rewrite_turns)
    return recent.groupBy("session_id").agg(F.array_join(in_order(line), "\n").alias("transcript"))


def rewrite_prompts(questions: DataFrame, messages: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(session_id, message, prompt): NULL prompt where there is no history and nothing to rewrite."""
    told = questions.join(transcripts(messages, config), "session_id", "left")
    prompt = F.concat(F.lit(TOLD), F.col("transcript"), F.lit(ASKED), F.col("message"), F.lit(WANTED))
    return told.select("session_id", "message", prompt.alias("prompt"))


def standalone(message: Column, rewritten: Column) -> Column:
    """The rewritten query, or the message itself where there is none or an empty one."""
    return F.coalesce(F.nullif(F.trim(rewritten), F.lit("")), message)


def rewritten_queries(questions: DataFrame, messages: DataFrame, generator: Generator | None = None, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(session_id, message, rewritten, query). The generator only sees rows with history."""
    prompts = rewrite_prompts(questions, messages, config)
    if generator is None:
        told = prompts.withColumn("rewritten", F.when(F.col("prompt").isNotNull(), F.col("message")))
    else:
        run = F.pandas_udf(generator.generate, "string").asNondeterministic()
        with_history = prompts.filter("prompt is not null").withColumn("rewritten", standalone(F.col("message"), run("prompt")))
        told = with_history.unionByName(prompts.filter("prompt is null").withColumn("rewritten", F.lit(None).cast("string")))
    return told.select("session_id", "message", "rewritten", F.coalesce("rewritten", "message").alias("query"))


def message_lists(questions: DataFrame, messages: DataFrame, contexts: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(session_id, messages): the last turns, then the message itself (not its rewriting) with its context."""
    recent = last_messages(messages, 2 * config.answer_turns).groupBy("session_id").agg(in_order(F.struct("role", "content")).alias("history"))
    prompt = F.concat(F.lit(CONTEXT), F.coalesce("context", F.lit("")), F.lit(QUESTION), F.col("message"))
    own = F.struct(F.lit("user").alias("role"), prompt.alias("content"))
    joined = questions.join(recent, "session_id", "left").join(contexts, "session_id", "left")
    return joined.select("session_id", F.concat(F.coalesce("history", F.array().cast("array<struct<role:string,content:string>>")), F.array(own)).alias("messages"))


def appended(messages: DataFrame, turns: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Histories after a turn (session_id, message, answer), trimmed to what is kept of a session."""
    last = messages.groupBy("session_id").agg(F.max("pos").alias("last"))
    numbered = turns.join(last, "session_id", "left").withColumn("at", F.coalesce(F.col("last") + 1, F.lit(0)))
    new = numbered.select(
        "session_id",
        F.inline(F.array(F.struct(F.col("at").alias("pos"), F.lit("user").alias("role"), F.col("message").alias("content")), F.struct((F.col("at") + 1).alias("pos"), F.lit("assistant").alias("role"), F.col("answer").alias("content")))),
    )
    return last_messages(messages.select("session_id", "pos", "role", "content").unionByName(new), 2 * config.session_turns)


def sessions(accesses: DataFrame, key: str, at: str, minutes: int = 30) -> DataFrame:
    """(key, session, started, last_access, accesses): a session ends after more than ``minutes`` idle.

    An access exactly at the limit still belongs to the session. Rows without a time are left out.

    The accesses of each hour become sessions first, then neighbouring hours' sessions are put
    together, so that the window over a very busy key holds a row for each of its hourly sessions
    and not one for each access.
    """
    gap = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))
    rows = accesses.select(key, F.col(at).alias("_from"), F.col(at).alias("_to")).filter(F.col(at).isNotNull()).withColumn("_hour", F.date_trunc("hour", "_from")).withColumn("_n", F.lit(1))

    def joined(parts: DataFrame, *by: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy("_from", "_to")
        fresh = F.coalesce((F.col("_from") > F.lag("_to").over(order) + gap).cast("int"), F.lit(0))
        numbered = parts.withColumn("_new", fresh).withColumn("session", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        return numbered.groupBy(*by, "session").agg(F.min("_from").alias("_from"), F.max("_to").alias("_to"), F.sum("_n").alias("_n"))

    hourly = joined(rows, key, "_hour").drop("session")
    return joined(hourly, key).select(key, "session", F.col("_from").alias("started"), F.col("_to").alias("last_access"), F.col("_n").alias("accesses"))


def windowed_sessions(accesses: DataFrame, key: str, at: str, minutes: int = 30) -> DataFrame:
    """The same sessions by ``session_window``, which also runs on streams."""
    window = F.session_window(at, f"{minutes} minutes")
    return accesses.groupBy(key, window.alias("w")).agg(F.count("*").alias("accesses")).select(key, F.col("w.start").alias("started"), (F.col("w.end") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))).alias("last_access"), "accesses")
