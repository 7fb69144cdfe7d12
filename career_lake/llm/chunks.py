"""Global lookups of text keys without moving one row per key.

Documents are dealt into chunks by a hash of doc_id. A chunk sends its sorted
distinct keys, packed, to the buckets of the key range; a bucket answers each
chunk with an array in the order of the keys sent; the answers meet the chunk
again in a cogroup. Every chunk sends a key once, so a key that half of all
documents share costs a bucket one entry a chunk: there are no hot keys. The
exchange of the documents by chunk is the same in every round, so Spark
reuses it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents of a chunk on average.
CHUNK_DOCS = 128
#: Documents whose keys a bucket holds on average, and the fewest buckets.
BUCKET_DOCS, LEAST_BUCKETS = 16_384, 64


def chunked(docs: DataFrame, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, int, int]:
    """(doc_id, text, missing, rest, chunk) of docs, the number of buckets and that of chunks.

    rest: the row's columns but its text, as a struct, whatever their names.
    """
    n = docs.count()
    chunks, buckets = max(64, n // CHUNK_DOCS), max(LEAST_BUCKETS, n // BUCKET_DOCS)
    rest = F.struct(*(docs[c] for c in docs.columns if c != text)).alias("rest")
    docs = docs.select(docs[key].cast("long").alias("doc_id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"), docs[text].isNull().alias("missing"), rest)
    return docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks))), buckets, chunks


def ordered(t: pa.Table) -> pa.Table:
    """The chunk's rows in an order that doesn't depend on how they arrived."""
    return t.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()


def deal(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's part of the sorted keys begins (buckets + 1 places)."""
    edges = (np.arange(1, buckets, dtype=np.float64) * (2.0**64 / buckets)).astype(np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)]))


def send(chunk: int, keys: np.ndarray, buckets: int, *more: np.ndarray, short: np.ndarray | None = None) -> pa.Table:
    """Rows (bucket, chunk, keys, more...) of a chunk's sorted distinct keys; empty parts are left out.

    short: what to send for the keys instead of themselves.
    """
    cut = deal(keys, buckets)
    full = np.flatnonzero(np.diff(cut))
    parts = [[a[cut[b] : cut[b + 1]].tobytes() for b in full] for a in (keys if short is None else short, *more)]
    return pa.table(
        [pa.array(full.astype(np.int32)), pa.array(np.full(len(full), chunk, np.int64)), *(pa.array(p, pa.binary()) for p in parts)],
        names=["bucket", "chunk", "keys", *(f"more{i}" for i in range(len(more)))],
    )


def received(col: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of a packed column in one array, and where each row's begin."""
    parts = [np.frombuffer(x, kind) for x in col.to_pylist()]
    return (np.concatenate(parts) if parts else np.zeros(0, kind)), np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)


def answer(t: pa.Table, values: np.ndarray, at: np.ndarray, keys: np.ndarray | None = None) -> pa.Table:
    """Rows (chunk, bucket, answer, of) from values in the order of the keys received.

    With keys, only values that are not 0 are told, with their keys in `of`.
    """
    packed, of = [], []
    for a, b in zip(at[:-1], at[1:], strict=True):
        some = slice(a, b) if keys is None else a + np.flatnonzero(values[a:b])
        packed.append(values[some].tobytes())
        of.append(b"" if keys is None else keys[some].tobytes())
    return pa.table([t["chunk"].combine_chunks(), t["bucket"].combine_chunks(), pa.array(packed, pa.binary()), pa.array(of, pa.binary())], names=["chunk", "bucket", "answer", "of"])


ANSWER = "chunk long, bucket int, answer binary, of binary"


def answered(t: pa.Table, kind: type, column: str = "answer") -> np.ndarray:
    """A chunk's answers in the order of its sorted keys."""
    if not t.num_rows:
        return np.zeros(0, kind)
    return np.frombuffer(b"".join(t.sort_by("bucket")[column].to_pylist()), kind)


def ask(sent: DataFrame, reduce: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """Each bucket's answers, as ANSWER."""
    return sent.groupBy("bucket").applyInArrow(reduce, ANSWER)


def meet(docs: DataFrame, answers: DataFrame, f: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """f(the chunk's documents, its answers) of each chunk."""
    return docs.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(f, schema)
