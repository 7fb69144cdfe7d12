"""Codes of vector parts by equal-average search (operator 12).

Vectors of integers are cut into equal parts. Each part position has a codebook
that begins as that part of the first vectors in id order and is improved in
rounds: every part goes to its nearest entry (squared Euclidean distance, ties
to the lower index), and an entry becomes the componentwise mean, rounded down, of its
parts. Unused entries stay.

The search keeps a codebook's entries sorted by the sum of their components. It
starts at a part's own sum and goes outward to the entry whose sum is nearer, and
ends when the squared gap of the sums over the dimension strictly exceeds the best
distance; no entry beyond can be as near. It runs in numpy on all parts of a batch
at once, on those that have not ended.

Each task adds up its parts by entry, so one row a task and entry is shuffled;
codebooks (parts x entries, of fixed size) are all that reaches the driver or is
sent to tasks. Errors of equal labels are added up from the written codes, and meet
their rows by a broadcast behind a count (MOST_BROADCAST), or else by a join.

No part takes: vectors that are null, empty or of a length that is no multiple of
the parts, that hold null or non-finite components, that are longer or shorter than the
first one in id order, or that hold components beyond +-2^29 over a part's length after
scaling (sums and distances then fit 64 bits). Repeated rows count each. Null ids come
last, ties of ids go by vector. With fewer vectors than entries, there are as many entries
as vectors. Null labels are one label. An empty table gives an empty result. Extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from career_lake.llm.topk import quantised
from career_lake.session import settle

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256.0
#: Largest sum of a part's components; vectors of a step in a task; labels (24 bytes each) that may be broadcast.
LARGEST, SLICE, MOST_BROADCAST = 1 << 29, 4096, 1_000_000


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of book (entries, d) to each row of x (n, d), ties to the lower index, and its squared distance."""
    n, d = x.shape
    sums = book.sum(1)
    order = np.argsort(sums, kind="stable")
    sums = sums[order]
    mine = x.sum(1)
    up = np.searchsorted(sums, mine)
    down = up - 1
    far = np.int64(1 << 31)
    best, arg = np.full(n, (1 << 62) // d, np.int64), np.full(n, len(book), np.int64)
    rest = np.arange(n)
    while len(rest):
        u, w, s = up[rest], down[rest], mine[rest]
        above = np.where(u < len(sums), sums[np.minimum(u, len(sums) - 1)] - s, far)
        below = np.where(w >= 0, s - sums[np.maximum(w, 0)], far)
        gap = np.minimum(above, below)
        go = (gap < far) & (gap * gap <= d * best[rest])
        rest, u, w, upward = rest[go], u[go], w[go], (above <= below)[go]
        entry = order[np.where(upward, u, w)]
        dist = ((x[rest] - book[entry]) ** 2).sum(1)
        nearer = (dist < best[rest]) | (dist == best[rest]) & (entry < arg[rest])
        at = rest[nearer]
        best[at], arg[at] = dist[nearer], entry[nearer]
        up[rest] += upward
        down[rest] -= ~upward
    return arg, best


def codes(v: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each part of the vectors v (n, parts * d), as arrays (n, parts); books: (parts, entries, d)."""
    x = v.reshape(len(v), books.shape[0], books.shape[2])
    found = [nearest(x[:, p], books[p]) for p in range(books.shape[0])]
    return np.stack([a for a, _ in found], 1), np.stack([b for _, b in found], 1)


def _vectors(rb: pa.RecordBatch, dim: int) -> Iterator[tuple[int, int, np.ndarray]]:
    col = rb.column("v")
    flat = col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    for lo in range(0, len(flat), SLICE):
        yield lo, min(lo + SLICE, len(flat)), flat[lo : lo + SLICE]


def kept_vectors(rows: DataFrame, scale: float = SCALE, parts: int = PARTS) -> DataFrame:
    """(vec_id, label, v) of the rows (vec_id, embedding, label) that take part."""
    out = rows.select(rows["vec_id"].cast("long").alias("vec_id"), rows["label"].alias("label"), quantised(rows["embedding"], scale).alias("v"))
    return out.where(F.col("v").isNotNull() & (F.size("v") % parts == 0) & F.forall("v", lambda x: F.abs(x) <= F.floor(F.lit(LARGEST * parts) / F.size("v"))))


def first_books(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray | None:
    """The codebooks (parts, entries, d) cut from the first vectors; None without vectors."""
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(1).select(F.size("v").alias("n")).first()
    if first is None:
        return None
    some = kept.where(F.size("v") == first["n"]).orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    v = np.array([r["v"] for r in some], np.int64)
    return np.ascontiguousarray(v.reshape(len(v), parts, -1).transpose(1, 0, 2))


def improved(kept: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round over all vectors."""
    parts, entries, d = books.shape

    def sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts * entries, d), np.int64), np.zeros(parts * entries, np.int64)
        for rb in it:
            for _, _, v in _vectors(rb, parts * d):
                at = (codes(v, books)[0] + np.arange(parts) * entries).ravel()
                count += np.bincount(at, minlength=parts * entries)
                order = np.argsort(at, kind="stable")
                begin = np.flatnonzero(np.diff(at[order], prepend=-1))
                total[at[order][begin]] += np.add.reduceat(v.reshape(-1, d)[order], begin)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), pa.array(list(total[used]), pa.list_(pa.int64()))], names=["entry", "n", "total"])

    told = kept.select("v").mapInArrow(sums, "entry long, n long, total array<long>").select("entry", "n", F.posexplode("total").alias("place", "value"))
    rows = told.groupBy("entry", "place").agg(F.sum("n").alias("n"), F.sum("value").alias("value")).collect()  # one a component of a codebook
    out = books.copy().reshape(-1, d)
    for r in rows:
        out[r["entry"], r["place"]] = r["value"] // r["n"]
    return out.reshape(books.shape)


def coded(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of each vector; code: two hexadecimal digits a part."""
    parts, _, d = books.shape
    digits = np.array([list(f"{i:02x}".encode()) for i in range(256)], np.uint8)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            for lo, hi, v in _vectors(rb, parts * d):
                entry, dist = codes(v, books)
                text = digits[entry].reshape(len(v), -1).view(f"S{2 * parts}").ravel().astype(str)
                yield pa.RecordBatch.from_arrays([rb.column("vec_id")[lo:hi], rb.column("label")[lo:hi], pa.array(text), pa.array(dist.sum(1))], names=["vec_id", "label", "code", "error"])

    kind = kept.schema["label"].dataType.simpleString()
    return kept.select("vec_id", "label", "v").mapInArrow(run, f"vec_id long, label {kind}, code string, error long")


def part_codes(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE) -> tuple[DataFrame, np.ndarray | None]:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of each kept row (vec_id, embedding, label), and the codebooks; at most 256 entries."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hexadecimal digits a part: 1 to 256 entries")
    kept = kept_vectors(rows, scale, parts)
    books = first_books(kept, parts, entries)
    if books is None:
        return kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256")), None
    kept = kept.where(F.size("v") == parts * books.shape[2])
    for _ in range(rounds):
        books = improved(kept, books)
    out = settle(coded(kept, books), "part-codes")
    total = settle(out.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "part-label-errors")
    out = out.join(F.broadcast(total) if total.count() <= MOST_BROADCAST else total, F.col("label").eqNullSafe(F.col("of")))
    told = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return out.select("vec_id", "label", "code", "error", "label_error", F.lit(told).alias("codebooks_sha256")), books
