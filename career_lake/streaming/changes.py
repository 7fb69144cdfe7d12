"""Z02, whole: versions of documents and decisions on them as one keyed stream, and its batch form.

An event is a version, an approval or a rejection of a document. A version whose
facts changed against the document's snapshot (the codes of F17) is staged: the
snapshot stays until the staged text is approved, and a staged version makes the
one before it void. Any other version becomes the snapshot. A rejected text is
remembered (the last MOST_REJECTED of a document) and its versions are ignored
from then on, also where the rejection arrives while the stream runs.

versions: (document_id, version_id, seq, title, content, ...); decisions:
(document_id, seq, kind: approve or reject, digest: sha256 of the content). seq orders
a document's events inside a batch; between batches they come in order of arrival. Output:
OUTCOME, one row an event. A decision on a text that is not staged is `none`, but
a rejection is remembered all the same. A null title or content counts as empty.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from career_lake.operators import facts as N
from career_lake.operators.governance import MOST_REJECTED
from career_lake.streaming.stateful import _reasons

OUTCOME = "document_id string, seq long, version_id string, digest string, outcome string, reasons array<string>"
COLUMNS = [c.split()[0] for c in OUTCOME.split(", ")]
_EVENT = ["document_id", "seq", "kind", "version_id", "digest", "facts", "n", "ocr"]
_KEPT = "facts string, n int, digest string, version_id string"


@dataclass
class Kept:
    """What a document's events leave: its snapshot, the staged version, and rejected texts, oldest first."""

    snapshot: tuple[str, int, str, str] | None = None
    staged: tuple[str, int, str, str] | None = None
    rejected: list[str] = field(default_factory=list)

    def apply(self, e: Any) -> tuple[str, list[str], str | None]:
        """(outcome, reasons, version) of the next event."""
        if e.kind == "version":
            row = (e.facts, int(e.n), e.digest, e.version_id)
            if e.digest in self.rejected:
                return "ignored", [], e.version_id
            if self.snapshot is not None and self.snapshot[2] == e.digest:
                return "unchanged", [], e.version_id
            reasons = [] if self.snapshot is None else _reasons(json.loads(e.facts), json.loads(self.snapshot[0]), row[1], self.snapshot[1], bool(e.ocr))
            if reasons:
                self.staged = row
                return "staged", reasons, e.version_id
            self.snapshot, self.staged = row, None
            return "current", [], e.version_id
        met = self.staged is not None and self.staged[2] == e.digest
        version = self.staged[3] if met else None
        if e.kind == "reject":
            self.rejected = [*(d for d in self.rejected if d != e.digest), e.digest][-MOST_REJECTED:]
            self.staged = None if met else self.staged
            return ("rejected" if met else "none"), [], version
        if e.kind == "approve" and met:
            self.snapshot, self.staged = self.staged, None
            return "approved", [], version
        return "none", [], version


def _folded(pdf: pd.DataFrame, kept: Kept) -> pd.DataFrame:
    rows = []
    for e in pdf.itertuples(index=False):
        outcome, reasons, version = kept.apply(e)
        rows.append((e.document_id, e.seq, version, e.digest, outcome, reasons))
    return pd.DataFrame(rows, columns=COLUMNS)


def document_events(versions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Both tables (or streams) as one of events."""
    ocr = F.coalesce("ocr_needs_review", F.lit(False)) if "ocr_needs_review" in versions.columns else F.lit(False)
    v = versions.withColumns({"content": F.coalesce("content", F.lit("")), "title": F.coalesce("title", F.lit("")), "ocr": ocr})
    v = N.with_facts(v.withColumn("digest", F.sha2("content", 256)))
    v = v.select("document_id", F.col("seq").cast("long").alias("seq"), F.lit("version").alias("kind"), "version_id", "digest", F.to_json("facts").alias("facts"), F.col("compact_length").alias("n"), "ocr")
    d = decisions.select("document_id", F.col("seq").cast("long").alias("seq"), "kind", F.lit(None).cast("string").alias("version_id"), "digest", F.lit(None).cast("string").alias("facts"), F.lit(0).alias("n"), F.lit(False).alias("ocr"))
    return v.union(d).where("document_id is not null")


class Changes(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.snapshot = handle.getValueState("snapshot", _KEPT)
        self.staged = handle.getValueState("staged", _KEPT)
        self.rejected = handle.getListState("rejected", "digest string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        value = lambda s: tuple(s.get()) if s.exists() else None
        kept = Kept(value(self.snapshot), value(self.staged), [r[0] for r in self.rejected.get()] if self.rejected.exists() else [])
        out = _folded(pd.concat(list(rows)).sort_values(["seq", "version_id"]), kept)
        for state, now in ((self.snapshot, kept.snapshot), (self.staged, kept.staged)):
            if now is None:
                state.clear()
            else:
                state.update(now)
        if kept.rejected:
            self.rejected.put([(d,) for d in kept.rejected])
        yield out

    def close(self) -> None:
        pass


def stream_document_changes(versions: DataFrame, decisions: DataFrame) -> DataFrame:
    """OUTCOME of streams of versions and decisions; their state store must be RocksDB (session.build_session sets it)."""
    return document_events(versions, decisions).groupBy("document_id").transformWithStateInPandas(Changes(), OUTCOME, "Append", "None")


def document_changes(versions: DataFrame, decisions: DataFrame) -> DataFrame:
    """OUTCOME of tables of versions and decisions. A document's events are read in order, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        document, kept = None, Kept()
        for pdf in batches:
            parts = []
            for name, part in pdf.groupby("document_id", sort=False):
                if name != document:
                    document, kept = name, Kept()
                parts.append(_folded(part, kept))
            yield pd.concat(parts) if parts else pd.DataFrame(columns=COLUMNS)

    events = document_events(versions, decisions).select(_EVENT)
    return events.repartition("document_id").sortWithinPartitions("document_id", "seq", "version_id").mapInPandas(run, OUTCOME)


def pending_reviews(outcomes: DataFrame) -> DataFrame:
    """(document_id, version_id, digest, reasons) of the version that is staged and undecided, one a document: the queue of V06."""
    told = outcomes.where(F.col("outcome").isin("staged", "approved", "rejected", "current"))
    last = F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("seq"), F.desc("version_id")))
    return told.withColumn("k", last).where("k = 1 and outcome = 'staged'").select("document_id", "version_id", "digest", "reasons")
