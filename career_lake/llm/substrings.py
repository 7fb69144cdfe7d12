"""Substring dedup by a compacted De Bruijn graph (operator 3).

Token k-mers (k = `window` words) are edges between the (k-1)-mers. Only
repeated edges matter, so the graph is thinned first: the smallest hash among
the `SEED`-word sequences of a window is the same wherever the window occurs,
and windows whose seed occurs once are no repeated edges.

1. Seeds of each chunk of documents go to their buckets, which tell the
   repeated ones (chunks.py; the answers join the documents again).
2. Edges with a repeated seed go to their buckets as two hashes (96 bits) with
   a mark of the edge before and after. A bucket tells which edges are repeated
   and where paths branch.
3. In the sources, runs of repeated edges that do not branch compact to paths.
   A path's source coordinates (document, first word, words) give its span;
   the words that spans cover are removed.

Words are `[^\\x20\\x09-\\x0D]+`, unchanged. Null or word-less texts have no
words and stay empty; texts under `window` words have no edge and stay whole.
Repeated rows are documents of their own, so they repeat each other. Extra
columns of any name go along in the struct `rest`. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from career_lake.llm.chunks import answer, answered, ask, chunked, meet, ordered, received, send
from career_lake.llm.text import Rolling, Words, column_bytes

#: Words of a window, and of the sequences of which a window's seed is one.
WINDOW, SEED = 35, 16
SENT = "bucket int, chunk long, keys binary"
_NONE, _FORK = 0, 65535


class Edges:
    """The windows of a chunk's documents: start word, hash and seed of each."""

    def __init__(self, docs: pa.Table, window: int) -> None:
        self.docs = ordered(docs)
        self.words = Words(*column_bytes(self.docs["text"]))
        self.roll = Rolling(self.words.hashes())
        n = np.maximum(self.words.counts() - window + 1, 0)
        self.row = np.repeat(np.arange(len(n)), n)
        self.at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + self.words.first[:-1][self.row]
        low = self.roll.window(min(SEED, window))
        width, have = max(window - SEED, 0) + 1, 1
        while have < width:  # minimum of the next `width` values, by doubling
            step = min(have, width - have)
            low = np.minimum(low[: max(len(low) - step, 0)], low[step:])  # no value is left of a chunk with few words
            have += step
        self.seed = low[self.at]
        self.hash = self.roll.window(window)[self.at]
        self.follows = np.zeros(len(self.at), bool)  # the edge before is of the same document
        self.follows[1:] = self.row[1:] == self.row[:-1]

    def second(self, window: int) -> np.ndarray:
        return Rolling(self.words.hashes(), 1).window(window)[self.at].astype(np.uint32)


def _chunk_of(t: pa.Table) -> int:
    return t["chunk"][0].as_py()


def _count_seeds(t: pa.Table) -> pa.Table:
    """Which seeds came from two chunks, or have an edge that one chunk has twice."""
    keys, at = received(t["keys"], np.uint64)
    more, _ = received(t["more0"], np.bool_)
    _, inv, cnt = np.unique(keys, return_inverse=True, return_counts=True)
    cnt = cnt + np.bincount(inv, more, len(cnt)).astype(np.int64)
    return answer(t, cnt[inv] > 1, at)


def _join_edges(t: pa.Table) -> pa.Table:
    """Per edge sent: bit 0 repeated, bit 1 the path before it branches, bit 2 after it."""
    keys, at = received(t["keys"], np.uint64)
    second, _ = received(t["more0"], np.uint32)
    more, _ = received(t["more1"], np.bool_)
    before, _ = received(t["more2"], np.uint16)
    after, _ = received(t["more3"], np.uint16)
    order = np.lexsort((second, keys))
    sent, keys, second = keys, keys[order], second[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (second[1:] != second[:-1])
    begin = np.flatnonzero(fresh)
    group = np.cumsum(fresh) - 1
    bits = ((np.diff(np.append(begin, len(keys))) + np.add.reduceat(more[order].astype(np.int64), begin)) > 1).astype(np.uint8)
    for marks, bit in ((before[order], 2), (after[order], 4)):
        high = np.maximum.reduceat(marks, begin)
        bits |= np.where((high == _FORK) | (high != np.minimum.reduceat(marks, begin)), bit, 0).astype(np.uint8)
    out = np.empty(len(keys), np.uint8)
    out[order] = np.where(bits & 1, bits, 0)[group]
    return answer(t, out, at, sent)


def _edge_rounds(docs: DataFrame, buckets: int, window: int) -> DataFrame:
    """The answers about the repeated edges of each chunk."""

    def seeds(t: pa.Table) -> pa.Table:
        e = Edges(t, window)
        _, inv, n = np.unique(e.hash, return_inverse=True, return_counts=True)
        keys, inv2 = np.unique(e.seed, return_inverse=True)
        twice = np.bincount(inv2, n[inv] > 1, len(keys)) > 0
        return send(_chunk_of(t), keys, buckets, twice)

    def edges(t: pa.Table, told: pa.Table) -> pa.Table:
        if not t.num_rows:
            return send(0, np.zeros(0, np.uint64), buckets, *[np.zeros(0, np.uint64)] * 4)
        e = Edges(t, window)
        ok = answered(told, np.bool_)[np.searchsorted(np.unique(e.seed), e.seed)] if len(e.seed) else np.zeros(0, bool)
        mark = (e.hash >> np.uint64(48)).astype(np.int64) % 65534 + 1
        before, after = np.full(len(mark), _NONE), np.full(len(mark), _NONE)
        before[1:] = np.where(e.follows[1:], mark[:-1], _NONE)
        after[:-1] = np.where(e.follows[1:], mark[1:], _NONE)
        keys, first, inv, n = np.unique(e.hash[ok], return_index=True, return_inverse=True, return_counts=True)
        marks = []
        for m in (before[ok], after[ok]):
            high, low = np.zeros(len(keys), np.int64), np.full(len(keys), _FORK)
            np.maximum.at(high, inv, m)
            np.minimum.at(low, inv, m)
            marks.append(np.where(high == low, high, _FORK).astype(np.uint16))
        return send(_chunk_of(t), keys, buckets, e.second(window)[ok][first], n > 1, *marks)

    sent = docs.groupBy("chunk").applyInArrow(seeds, f"{SENT}, more0 binary")
    sent = meet(docs, ask(sent, _count_seeds), edges, f"{SENT}, more0 binary, more1 binary, more2 binary, more3 binary")
    return ask(sent, _join_edges)


def _paths(e: Edges, told: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """First edge and number of edges of each compacted path of a chunk."""
    keys, bits = answered(told, np.uint64, "of"), answered(told, np.uint8)
    if not len(keys) or not len(e.hash):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.minimum(np.searchsorted(keys, e.hash), len(keys) - 1)
    hit = keys[place] == e.hash
    bits = np.where(hit, bits[place], 0)
    joins = np.zeros(len(hit), bool)
    joins[1:] = e.follows[1:] & hit[1:] & hit[:-1] & (bits[1:] & 2 == 0) & (bits[:-1] & 4 == 0)
    first = np.flatnonzero(hit & ~joins)
    ends = np.flatnonzero(hit & ~np.append(joins[1:], False))
    return first, ends - first + 1


def repeated_paths(docs: DataFrame, window: int = WINDOW, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, start (word, from 0), n_words, path_id (a hash of the words) of each compacted path."""
    docs, buckets, _ = chunked(docs, text, key)

    def run(t: pa.Table, told: pa.Table) -> pa.Table:
        if not t.num_rows:
            first = n = np.zeros(0, np.int64)
            return pa.table([first, first, first, first], names=["doc_id", "start", "n_words", "path_id"])
        e = Edges(t, window)
        first, n = _paths(e, told)
        ids = e.docs["doc_id"].to_numpy()
        start = e.at[first]
        return pa.table(
            [ids[e.row[first]], start - e.words.first[:-1][e.row[first]], n + window - 1, e.roll.spans(start, n + window - 1).astype(np.int64)],
            names=["doc_id", "start", "n_words", "path_id"],
        )

    return meet(docs, _edge_rounds(docs, buckets, window), run, "doc_id long, start long, n_words long, path_id long")


def without_repeats(docs: DataFrame, window: int = WINDOW, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, rest, text, n_words, n_removed, kept_sha256 of each row.

    text: the kept words joined by one space, where words were removed; else
    unchanged. kept_sha256: of the kept words joined by one space.
    """
    docs, buckets, _ = chunked(docs, text, key)
    fields = [f"{f.name}" for f in docs.schema if f.name in ("doc_id", "missing", "rest")]

    def run(t: pa.Table, told: pa.Table) -> pa.Table:
        e = Edges(t, window)
        w = e.words
        first, n = _paths(e, told)
        cover = np.zeros(len(w) + 1, np.int64)
        np.add.at(cover, e.at[first], 1)
        np.add.at(cover, e.at[first] + n + window - 1, -1)
        gone = np.cumsum(cover[:-1]) > 0
        buf = np.append(w.buf, np.uint8(32))
        keep = np.zeros(len(buf), bool)
        keep[:-1][w.inside] = np.repeat(~gone, w.ends - w.starts)
        tail = w.ends[~gone]
        tail = tail[(tail < len(w.buf)) & ~np.append(w.inside, False)[tail]]
        own = np.searchsorted(w.off, tail, "right") == np.searchsorted(w.off, tail - 1, "right")  # the delimiter is of the same document
        buf = buf.copy()
        buf[tail[own]] = 32
        keep[tail[own]] = True
        at = np.concatenate(([0], np.cumsum(keep[:-1])))[w.off]
        kept = buf[:-1][keep[:-1]].tobytes()
        kept = [kept[a:b].removesuffix(b" ") for a, b in zip(at[:-1], at[1:], strict=True)]
        lost = np.bincount(w.row_of_word()[gone], minlength=t.num_rows)
        texts = [k.decode() if x else old for k, x, old in zip(kept, lost, e.docs["text"].to_pylist(), strict=True)]
        return pa.table(
            [
                *(e.docs[f] for f in fields),
                pa.array(texts, pa.string()),
                pa.array(w.counts(), pa.int64()),
                pa.array(lost, pa.int64()),
                pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
            ],
            names=[*fields, "text", "n_words", "n_removed", "kept_sha256"],
        )

    types = ", ".join(f"{f} {docs.schema[f].dataType.simpleString()}" for f in fields)
    out = meet(docs, _edge_rounds(docs, buckets, window), run, f"{types}, text string, n_words long, n_removed long, kept_sha256 string")
    return out.select("doc_id", "rest", F.when(~F.col("missing"), F.col("text")).alias("text"), "n_words", "n_removed", "kept_sha256")
