"""Z03 by address: quotas of requests as a keyed stream, and its batch form.

A session belongs to the address of its first request until it has been silent
for FORGET seconds. A request of a session from another address is an error and
counts nowhere. So a session's counter lives with its address: the state of an
address is its own window and a map of its sessions' windows, whose timers remove
them. No state and no group grows with the history.

requests: (request_id long, address string, session string, ts timestamp).
Output: QUOTA; allowed is null for errors. Rows of a key come in order of ts and
request_id inside a batch, and in order of arrival between batches. Rows without an address,
session or time are left out. Repeated rows count each.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

QUOTA = "request_id long, address string, session string, ts timestamp, error boolean, allowed boolean"
OWNED = "request_id long, address string, session string, ts timestamp, error boolean"
#: Seconds of a window and of a session's silence; requests of a session and of an address in a window.
WINDOW, FORGET, PER_SESSION, PER_ADDRESS = 60.0, 86_400.0, 6, 20
#: How late a row of the stream may come.
LATE = "10 minutes"


def _seconds(ts: pd.Series) -> list[float]:
    return (ts.astype("datetime64[us]").astype("int64") / 1e6).tolist()


def _in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(["ts", "request_id"])


def _open(cell: tuple[float, int] | None, ts: float) -> tuple[float, int]:
    """The window that a request falls into: the one open, or a new one that begins with it."""
    return (ts, 0) if cell is None or ts >= cell[0] + WINDOW else cell


def _admit(address: tuple[float, int] | None, session: tuple[float, int] | None, ts: float) -> tuple[bool, tuple[float, int], tuple[float, int]]:
    """Whether a request is allowed, and both windows after it; a denied request counts on neither."""
    a, s = _open(address, ts), _open(session, ts)
    ok = a[1] < PER_ADDRESS and s[1] < PER_SESSION
    return ok, (a[0], a[1] + ok), (s[0], s[1] + ok)


class Owners(StatefulProcessor):
    """Tells requests that come from another address than their session's."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.owner = handle.getValueState("owner", "address string, last double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        pdf = _in_order(rows)
        address, last = self.owner.get() if self.owner.exists() else (None, None)
        errors = []
        for where, ts in zip(pdf["address"], _seconds(pdf["ts"]), strict=True):
            if last is None or ts - last > FORGET:
                address = where
            last = ts if last is None else max(last, ts)
            errors.append(where != address)
        self.owner.update((address, last))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(int((last + FORGET) * 1000) + 1)
        yield pdf.assign(error=errors)[["request_id", "address", "session", "ts", "error"]]

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.owner.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


class Quota(StatefulProcessor):
    """Decides an address's requests; its state is its window and those of its sessions."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "start double, count int")
        self.sessions = handle.getMapState("sessions", "session string", "start double, count int")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        pdf = _in_order(rows)
        own = tuple(self.window.get()) if self.window.exists() else None
        cells: dict[str, tuple[float, int] | None] = {}
        allowed: list[bool | None] = []
        for session, ts, error in zip(pdf["session"], _seconds(pdf["ts"]), pdf["error"], strict=True):
            if error:
                allowed.append(None)
                continue
            if session not in cells:
                cells[session] = tuple(self.sessions.getValue((session,))) if self.sessions.containsKey((session,)) else None
            ok, own, cells[session] = _admit(own, cells[session], ts)
            allowed.append(ok)
        if own is not None:
            self.window.update(own)
        for session, cell in cells.items():
            self.sessions.updateValue((session,), cell)
        if cells:
            self.handle.registerTimer(int((max(c[0] for c in cells.values()) + WINDOW) * 1000) + 1)
        yield pdf.assign(allowed=pd.Series(allowed, index=pdf.index, dtype="object"))[["request_id", "address", "session", "ts", "error", "allowed"]]

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() / 1000
        for k, cell in list(self.sessions.iterator()):
            if cell[0] + WINDOW <= now:
                self.sessions.removeKey(k)
        if self.window.exists() and self.window.get()[0] + WINDOW <= now:
            self.window.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def _known(requests: DataFrame) -> DataFrame:
    out = requests.select(F.col("request_id").cast("long").alias("request_id"), F.col("address").cast("string").alias("address"), F.col("session").cast("string").alias("session"), F.col("ts").cast("timestamp").alias("ts"))
    return out.where("address is not null and session is not null and ts is not null")


def stream_quota_by_address(requests: DataFrame, late: str = LATE) -> DataFrame:
    """QUOTA of a stream of requests; its state store must be RocksDB (session.build_session sets it)."""
    owned = _known(requests).withWatermark("ts", late).groupBy("session").transformWithStateInPandas(Owners(), OWNED, "Append", "EventTime", eventTimeColumnName="ts")
    return owned.groupBy("address").transformWithStateInPandas(Quota(), QUOTA, "Append", "EventTime")


def quota_by_address(requests: DataFrame) -> DataFrame:
    """QUOTA of a table of requests. An address's requests are read in order, in Arrow batches, with its open windows alone kept."""
    mine = Window.partitionBy("session").orderBy("ts", "request_id")
    at = F.unix_micros("ts") / 1_000_000
    last = F.max(at).over(mine.rowsBetween(Window.unboundedPreceding, -1))
    runs = _known(requests).withColumn("new", F.when(last.isNull() | (at - last > FORGET), F.monotonically_increasing_id()).cast("long"))
    owner = F.last(F.when(F.col("new").isNotNull(), F.col("address")), ignorenulls=True).over(mine)
    owned = runs.withColumn("error", F.col("address") != owner).drop("new")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        address, own, cells = None, None, {}
        for pdf in batches:
            allowed: list[bool | None] = []
            for where, session, ts, error in zip(pdf["address"], pdf["session"], _seconds(pdf["ts"]), pdf["error"], strict=True):
                if where != address:
                    address, own, cells = where, None, {}
                if error:
                    allowed.append(None)
                    continue
                ok, own, cells[session] = _admit(own, cells.get(session), ts)
                allowed.append(ok)
                if len(cells) > 10_000:  # closed windows tell nothing
                    cells = {k: c for k, c in cells.items() if ts < c[0] + WINDOW}
            yield pdf.assign(allowed=pd.Series(allowed, index=pdf.index, dtype="object"))[["request_id", "address", "session", "ts", "error", "allowed"]]

    return owned.repartition("address").sortWithinPartitions("address", "ts", "request_id").mapInPandas(run, QUOTA)
