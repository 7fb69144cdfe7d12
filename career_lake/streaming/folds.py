"""Incremental computations: batch forms and Structured Streaming forms of the same folds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from career_lake.session import settle

ANSWER_CAP = 40_000


def fold_answers(chunks: DataFrame) -> DataFrame:
    """Per message its text and status. chunks: (message_id, place, kind, text).

    Agent chunks are joined in order; a complete message after them replaces
    them; a message without a terminal, or with a failed or stopped one, is an
    error. Kinds: chunk, message, end, failed, stopped.
    """
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "chunk", F.struct("place", "text")))), lambda x: x["text"]), "")
    whole = F.max_by(F.when(F.col("kind") == "message", F.col("text")), F.when(F.col("kind") == "message", F.col("place")))
    out = chunks.groupBy("message_id").agg(ordered.alias("chunks"), whole.alias("whole"), F.count_if(F.col("kind").isin("failed", "stopped")).alias("bad"), F.count_if(F.col("kind") == "end").alias("ends"))
    status = F.when((F.col("bad") > 0) | (F.col("ends") == 0), "error").otherwise("complete")
    return out.select("message_id", F.substring(F.coalesce("whole", "chunks"), 1, ANSWER_CAP).alias("answer"), status.alias("status"))


QUOTA = "request_id long, address string, session string, ts double, allowed boolean"


def request_quota(requests: DataFrame, window: float = 60.0, per_session: int = 6, per_address: int = 20) -> DataFrame:
    """Z03, batch: whether each request is allowed. requests: (request_id, address, session, ts seconds).

    A key's window opens at its first request and lasts 60 s; a denied request
    counts on neither key. Sessions and addresses that requests connect share
    their counters, so they are one group; a group is read in order, in Arrow
    batches, and keeps only the open counters.
    """
    pairs = requests.select("address", "session").distinct()
    # Least address reached over shared sessions; groups are a few keys wide, so labels settle in a few rounds.
    label = pairs.select("address").distinct().withColumn("group", F.col("address"))
    while True:
        of_session = pairs.join(label, "address").groupBy("session").agg(F.min("group").alias("low"))
        new = settle(pairs.join(of_session, "session").groupBy("address").agg(F.min("low").alias("group")), "quota-groups")
        moved = new.join(label.withColumnRenamed("group", "old"), "address").where("group <> old").isEmpty()
        label = new
        if moved:
            break

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, state = None, {}
        for pdf in batches:
            allowed = []
            for g, address, session, ts in zip(pdf["group"], pdf["address"], pdf["session"], pdf["ts"], strict=True):
                if g != group:
                    group, state = g, {}
                cells = []
                for kind, key, most in (("a", address, per_address), ("s", session, per_session)):
                    cell = state.get((kind, key))
                    if cell is None or ts >= cell[0] + window:
                        cell = state[kind, key] = [ts, 0]
                    cells.append((cell, most))
                ok = all(cell[1] < most for cell, most in cells)
                for cell, _ in cells:
                    cell[1] += ok
                if len(state) > 10_000:  # closed windows tell nothing
                    state = {k: c for k, c in state.items() if ts < c[0] + window}
                allowed.append(ok)
            yield pdf.assign(allowed=allowed)[[c.split()[0] for c in QUOTA.split(", ")]]

    ordered = requests.join(label, "address").repartition("group").sortWithinPartitions("group", "ts", "request_id")
    return ordered.mapInPandas(run, QUOTA)


def sync_health(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Outcomes of sync events per tumbling window; a batch or a stream (with its watermark).

    events: (ts, source_id, kind).
    """
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    out = timed.groupBy(F.window("ts", window).alias("w")).agg(F.count("*").alias("events"), F.count_if(F.col("kind") == "error").alias("errors"), F.count_if(F.col("kind") == "changed").alias("changed"))
    return out.select(F.col("w.start").alias("start"), "events", "errors", "changed")


def error_rate(events: DataFrame, window: str = "2 days", slide: str = "1 day", late: str = "2 hours") -> DataFrame:
    """The share of errors per sliding window; a batch or a stream."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    out = timed.groupBy(F.window("ts", window, slide).alias("w")).agg(F.count("*").alias("events"), F.count_if(F.col("kind") == "error").alias("errors"))
    return out.select(F.col("w.start").alias("start"), "events", (F.col("errors") / F.col("events")).alias("rate"))


def sync_sessions(events: DataFrame, gap: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Sessions of a source: events without a longer gap; a batch or a stream."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    out = timed.groupBy("source_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"), F.count_if(F.col("kind") == "error").alias("errors"))
    return out.select("source_id", F.col("w.start").alias("start"), "events", "errors")
