"""Keyed folds: workspace state, and page ingestion as a stream."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from career_lake.operators import facts as N
from career_lake.operators.corpus import canonical_url, normalise_text
from career_lake.session import together

WORKSPACE = "subject string, revision int, event_id long, conflicts int, expired boolean"


WRITES = "revision int, event_id long, at long, conflicts int"


def _write(pdf: pd.DataFrame, kept: tuple) -> tuple:
    """(revision, last event, its time in ns, conflicts) after a subject's events in order."""
    revision, last, at, conflicts = kept
    pdf = pdf.sort_values(["ts", "event_id"])
    for event, ts, expected in zip(pdf["event_id"], pdf["ts"], pdf["expected"], strict=True):
        if expected == revision:
            revision, last, at = revision + 1, int(event), int(pd.Timestamp(ts).as_unit("ns").value)
        else:
            conflicts += 1
    return revision, last, at, conflicts


def _workspace(subject: str, kept: tuple, now: str, keep_days: int) -> pd.DataFrame:
    revision, last, at, conflicts = kept
    old = at is not None and pd.Timestamp(now).as_unit("ns").value - at > pd.Timedelta(days=keep_days).as_unit("ns").value
    return pd.DataFrame([(subject, revision, last, conflicts, old)], columns=[c.split()[0] for c in WORKSPACE.split(", ")])


def workspace_state(events: DataFrame, now: str, keep_days: int = 180) -> DataFrame:
    """Z05, batch: each subject's revision, last accepted write and conflicts.

    events: (subject, event_id, ts, expected). A write is accepted where it
    expects the current revision. Only a few numbers are kept while a subject's
    events are read in order.
    """
    return events.groupBy("subject").applyInPandas(lambda pdf: _workspace(pdf["subject"].iloc[0], _write(pdf, (0, None, None, 0)), now, keep_days), WORKSPACE)


def stream_workspace_state(events: DataFrame, now: str, keep_days: int = 180) -> DataFrame:
    """workspace_state of a stream, a row for each subject that a batch touches; events come in order of arrival between batches."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = _write(pd.concat(list(batches)), state.get if state.exists else (0, None, None, 0))
        state.update(kept)
        yield _workspace(key[0], kept, now, keep_days)

    return events.groupBy("subject").applyInPandasWithState(run, WORKSPACE, WRITES, "update", GroupStateTimeout.NoTimeout)


CHANGES = "document_id string, version_id string, reasons array<string>, held boolean"
SNAPSHOT = "facts string, n int, digest string"


def _reasons(new: dict, old: dict, n: int, m: int, ocr: bool) -> list[str]:
    """The codes of N.version_diff for one version against the one kept."""
    enriched = m < 240 and n >= 400 and n >= m * 1.5
    codes = ["ocr_quality_pending"] if ocr else []
    if m >= 500 and n < m * 0.6 and not enriched:
        codes.append("content_regression")
    if new["lifecycle"] and new["lifecycle"] != old["lifecycle"]:
        codes.append("lifecycle_changed")
    for facet, (code, added) in N.CODES.items():
        has, had = new[facet], old[facet]
        if has and had and has != had:
            codes.append(code)
        elif had and not has and n >= m * 0.7 and not enriched:
            codes.append(f"{code}_removed")
        elif added and has and not had and not enriched:
            codes.append(f"{code}_added")
    return codes


_CHANGED = ["document_id", "version_id", "reasons", "held"]
_parsed = lru_cache(1024)(json.loads)


def _change(r: Any, kept: tuple | None) -> tuple[tuple | None, tuple | None]:
    """The change that a version is, if it is one, and the snapshot (facts, n, digest) after it."""
    if kept is not None and kept[2] == r.digest:
        return None, kept
    reasons = [] if kept is None else _reasons(_parsed(r.facts), _parsed(kept[0]), r.n, kept[1], r.ocr)
    return (r.document_id, r.version_id, reasons, bool(reasons)), kept if reasons else (r.facts, int(r.n), r.digest)


def _fold(pdf: pd.DataFrame, kept: tuple | None) -> tuple[pd.DataFrame, tuple | None]:
    """The changes of a document's versions in order, and the snapshot after them."""
    rows = []
    for r in pdf.sort_values(["version_no", "version_id"]).itertuples(index=False):
        row, kept = _change(r, kept)
        rows += [] if row is None else [row]
    return pd.DataFrame(rows, columns=_CHANGED), kept


def _told(versions: DataFrame, rejected: DataFrame | None) -> DataFrame:
    ocr = F.coalesce("ocr_needs_review", F.lit(False)) if "ocr_needs_review" in versions.columns else F.lit(False)
    whole = versions.withColumn("content", F.coalesce("content", F.lit(""))).withColumn("title", F.coalesce("title", F.lit("")))
    out = N.with_facts(whole.withColumn("digest", F.sha2("content", 256)).withColumn("ocr", ocr))
    out = out.select("document_id", "version_id", "version_no", F.to_json("facts").alias("facts"), F.col("compact_length").alias("n"), "digest", "ocr")
    return out if rejected is None else out.join(rejected.select("document_id", "digest").distinct(), ["document_id", "digest"], "left_anti")


def version_changes(versions: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """Z02, batch: CHANGES of versions(document_id, version_id, version_no, title, content, ...).

    A version with reasons is held and the snapshot stays; any other becomes
    the snapshot. The snapshot's own text and rejected(document_id, digest of
    the content) give no row. A null title or content counts as empty.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        document, kept = ..., None  # no document yet
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                if r.document_id != document:
                    document, kept = r.document_id, None
                row, kept = _change(r, kept)
                rows += [] if row is None else [row]
            yield pd.DataFrame(rows, columns=_CHANGED)

    # A document's versions are read in order, in Arrow batches: a table a document would be far more work than its rows.
    return together(_told(versions, rejected), "document_id").sortWithinPartitions("document_id", F.asc_nulls_last("version_no"), F.asc_nulls_last("version_id")).mapInPandas(run, CHANGES)


def stream_changes(versions: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """version_changes of a stream; a document's snapshot is its state, so versions come in order of arrival between batches."""

    def run(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows, kept = _fold(pd.concat(list(batches)), state.get if state.exists else None)
        if kept is not None:
            state.update(kept)
        yield rows

    return _told(versions, rejected).groupBy("document_id").applyInPandasWithState(run, CHANGES, SNAPSHOT, "append", GroupStateTimeout.NoTimeout)


def ingest(pages: DataFrame) -> DataFrame:
    """Rows (document_id, canonical_url, content, content_hash) of pages(url, content); equal for a batch and a stream."""
    text = normalise_text(F.col("content"))
    out = pages.select(canonical_url(F.col("url")).alias("canonical_url"), text.alias("content")).where("content <> ''")
    out = out.withColumn("content_hash", F.sha2("content", 256))
    return out.withColumn("document_id", F.sha2("canonical_url", 256)).dropDuplicates(["document_id", "content_hash"])


def stream_ingest(pages: DataFrame, target: str, checkpoint: str):  # noqa: ANN201
    """Append the pages of a stream to the Parquet corpus at target; a replayed batch adds nothing.

    (document, hash) is the key: a batch is written without the keys that the
    target has.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark, new = batch.sparkSession, ingest(batch)
        try:
            seen = spark.read.parquet(target).select("document_id", "content_hash")
        except Exception as e:  # the target does not exist before the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
            seen = new.select("document_id", "content_hash").limit(0)
        new.join(seen, ["document_id", "content_hash"], "left_anti").write.mode("append").parquet(target)

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
