"""Z05, whole: optimistic writes of workspaces as a keyed stream, and their batch form.

A write is accepted where it expects its subject's current revision, which then
grows by one; any other is a conflict. A write of more than 3 jobs or 200 tasks,
or of a malformed task id, is invalid and changes nothing. A workspace that no
accepted write has touched for 180 days is gone: its subject begins again at revision 0.
A subject's state is two numbers, and a timer removes it when it expires.

events: (subject string, event_id long, ts timestamp, expected int, jobs, tasks
array<string>). Output: OUTCOME, one row an event with a subject and a time.
Three tables follow from it: accepted writes, `snapshots` (the latest of each
subject), and `conflicts`. A subject's rows come in order of ts and event_id
inside a batch, and in order of arrival between batches. Repeated events count each.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTCOME = "subject string, event_id long, ts timestamp, outcome string, revision int, jobs array<string>, tasks array<string>"
COLUMNS = [c.split()[0] for c in OUTCOME.split(", ")]
MOST_JOBS, MOST_TASKS, KEEP_DAYS = 3, 200, 180
TASK_ID = "^[\\p{L}\\p{N}][\\p{L}\\p{N}:._/+~-]{0,159}$"
#: How late a row of the stream may come.
LATE = "1 hour"


def checked(events: DataFrame) -> DataFrame:
    """Events with distinct jobs and tasks, and whether the state that they carry is invalid."""
    none = F.array().cast("array<string>")
    jobs, tasks = F.coalesce("jobs", none), F.coalesce("tasks", none)
    bad = (F.size(jobs) > MOST_JOBS) | (F.size(tasks) > MOST_TASKS) | F.exists(tasks, lambda t: t.isNull() | ~t.rlike(TASK_ID)) | F.exists(jobs, lambda j: F.coalesce(F.trim(j), F.lit("")) == "") | F.col("expected").isNull() | (F.col("expected") < 0)
    out = events.where("subject is not null and ts is not null")
    return out.select(F.col("subject").cast("string").alias("subject"), F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"), F.coalesce("expected", F.lit(-1)).cast("int").alias("expected"), F.coalesce(bad, F.lit(True)).alias("bad"), F.array_distinct(jobs).alias("jobs"), F.array_distinct(tasks).alias("tasks"))


def _seconds(ts: pd.Series) -> list[float]:
    return (ts.astype("datetime64[us]").astype("int64") / 1e6).tolist()


def _decide(kept: tuple[int, float] | None, ts: float, expected: int, bad: bool) -> tuple[str, tuple[int, float] | None]:
    """An event's outcome and what is kept after it: (revision, time of the last accepted write)."""
    if kept is not None and ts - kept[1] > KEEP_DAYS * 86_400:
        kept = None
    if bad:
        return "invalid", kept
    revision = kept[0] if kept else 0
    return ("accepted", (revision + 1, ts)) if expected == revision else ("conflict", kept)


class Workspaces(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "revision int, last double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        before = kept = tuple(self.kept.get()) if self.kept.exists() else None
        outcomes, revisions = [], []
        for ts, expected, bad in zip(_seconds(pdf["ts"]), pdf["expected"], pdf["bad"], strict=True):
            outcome, kept = _decide(kept, ts, expected, bad)
            outcomes.append(outcome)
            revisions.append(kept[0] if kept else 0)
        if kept is None:
            self.kept.clear()
        elif kept != before:
            self.kept.update(kept)
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(int((kept[1] + KEEP_DAYS * 86_400) * 1000) + 1)
        yield pdf.assign(outcome=outcomes, revision=revisions)[COLUMNS]

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.kept.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def stream_workspace_writes(events: DataFrame, late: str = LATE) -> DataFrame:
    """OUTCOME of a stream of events; its state store must be RocksDB (session.build_session sets it)."""
    return checked(events).withWatermark("ts", late).groupBy("subject").transformWithStateInPandas(Workspaces(), OUTCOME, "Append", "EventTime")


def workspace_writes(events: DataFrame) -> DataFrame:
    """OUTCOME of a table of events. A subject's events are read in order, in Arrow batches; nothing but two numbers is kept."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        subject, kept = None, None
        for pdf in batches:
            outcomes, revisions = [], []
            for who, ts, expected, bad in zip(pdf["subject"], _seconds(pdf["ts"]), pdf["expected"], pdf["bad"], strict=True):
                if who != subject:
                    subject, kept = who, None
                outcome, kept = _decide(kept, ts, expected, bad)
                outcomes.append(outcome)
                revisions.append(kept[0] if kept else 0)
            yield pdf.assign(outcome=outcomes, revision=revisions)[COLUMNS]

    return checked(events).repartition("subject").sortWithinPartitions("subject", "ts", "event_id").mapInPandas(run, OUTCOME)


def snapshots(outcomes: DataFrame, now: str) -> DataFrame:
    """(subject, revision, event_id, ts, jobs, tasks) of the last accepted write of each subject that has not expired at `now`."""
    last = F.max_by(F.struct("revision", "event_id", "ts", "jobs", "tasks"), F.struct("ts", "event_id", "revision")).alias("last")
    live = F.col("last.ts") >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {KEEP_DAYS} DAYS")
    return outcomes.where("outcome = 'accepted'").groupBy("subject").agg(last).where(live).select("subject", "last.*")


def conflicts(outcomes: DataFrame) -> DataFrame:
    """The writes that expected another revision, with the one they met."""
    return outcomes.where("outcome = 'conflict'").select("subject", "event_id", "ts", "revision")
