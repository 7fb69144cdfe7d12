"""Bounded samples of labelled documents, and models fitted to them in one task."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(key: Column, parts: int) -> Column:
    """crc32 of the key as text, modulo parts."""
    return F.pmod(F.crc32(F.encode(key.cast("string"), "UTF-8")), F.lit(parts))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, learn: Column | None = None) -> DataFrame:
    """(doc_id, text, y) of about `most` labelled documents at most of either label.

    learn: a condition on labels. Rows are taken by a hash of doc_id, so the
    same rows are taken however the tables are partitioned. Labels other than
    0 and 1 are left out; repeated labels count once. The labels taken are
    broadcast: their number is bounded by 4 * most (24 bytes each).
    """
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label].cast("int").alias("y")).where("y in (0, 1) and doc_id is not null")
    if learn is not None:
        known = known.where(learn)
    n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    share = F.when(F.col("y") == 1, F.lit(min(1.0, most / max(1, n.get(1, 0))))).otherwise(F.lit(min(1.0, most / max(1, n.get(0, 0)))))
    some = known.where(place < share * (1 << 40)).groupBy("doc_id").agg(F.max("y").alias("y")).limit(4 * most)
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return docs.join(F.broadcast(some), "doc_id")


def fitted(sample: DataFrame, schema: pa.Schema, fit: Callable[[pa.Table], Any]) -> Any:
    """fit(the rows of a bounded sample, ordered by doc_id), run in one task; only the model comes to the driver."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches([rb.cast(schema) for rb in it], schema).sort_by("doc_id").combine_chunks()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(rows))], pa.binary())], names=["model"])

    row = sample.select(schema.names).repartition(1).mapInArrow(run, "model binary").first()
    return fit(schema.empty_table()) if row is None else pickle.loads(bytes(row["model"]))
