"""Mixture-controlled packing of token sequences (operator 10).

Documents queue by source. Deficit round-robin serves the queues: each earns
credit in proportion to its target and is served one quantum of tokens whenever
its credit allows, so at every window's end each queue's share is within one
quantum of its target, and what is owed carries over to the next window. The
order of service has a closed form: quantum u of a queue with target w is
served at virtual time (u + 0.5) / w. Hence every task finds the place of its
quanta from the queues' totals alone, and credit carries across windows and
partitions with no task that sees all of them.

1. Documents are tokenised where they are read and written with their place in
   (partition, queue).
2. Totals of (partition, queue) give each partition's first place in a queue.
3. Each document is cut at quantum and window ends and takes its sequence and
   offset from the closed form.

All windows are full. What is left after the last full window is cut to powers
of two, so that nothing is padded. The default targets are the sources' own
shares, which keep the mixture the same from the first to the last window; with
other targets, a queue that runs empty leaves its share to the rest.

Null or empty texts are one end token. A null source is a queue of its own. A
null doc_id stays null. A repeated row is packed again. An empty table gives an empty result. Extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from career_lake.session import settle

WINDOW, QUANTUM = 2048, 256
#: More sources than this share queues by hash, so that the totals that each task gets are bounded.
MOST_QUEUES = 4096
#: Rows of first places that may be broadcast (24 bytes each).
MOST_BROADCAST = 100_000
END = 1
_encodings: dict[str, tiktoken.Encoding] = {}


def encoding(path: str, pattern: str, special: tuple[tuple[str, int], ...]) -> tiktoken.Encoding:
    if path not in _encodings:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(special))
    return _encodings[path]


def tokenised(docs: DataFrame, path: str, pattern: str, special: tuple[tuple[str, int], ...]) -> DataFrame:
    """docs(doc_id, queue, text) as doc_id, queue, part, local (first place in part and queue), n, ids (uint16)."""
    names = frozenset(s for s, _ in special)
    lone = re.compile("[\ud800-\udfff]")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, place = encoding(path, pattern, special), TaskContext.get().partitionId(), {}
        for rb in it:
            for lo in range(0, rb.num_rows, 512):
                some = rb.slice(lo, 512)
                queues, known, local, sizes, ids = some.column(1).to_pylist(), {}, [], [], []
                for q, text in zip(queues, some.column(2).to_pylist(), strict=True):
                    text = text or ""
                    if text not in known:
                        try:
                            got = enc.encode_to_numpy(text, allowed_special=names, disallowed_special=())
                        except UnicodeEncodeError:
                            got = enc.encode_to_numpy(lone.sub("�", text), allowed_special=names, disallowed_special=())
                        known[text] = np.append(got, END).astype("<u2").tobytes()
                    ids.append(known[text])
                    n = len(known[text]) // 2
                    sizes.append(n)
                    local.append(place.get(q, 0))
                    place[q] = place.get(q, 0) + n
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array(np.full(some.num_rows, part, np.int32)), pa.array(local, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "queue", "part", "local", "n", "ids"],
                )

    return docs.mapInArrow(run, "doc_id long, queue string, part int, local long, n long, ids binary")


class Schedule:
    """The order in which deficit round-robin serves the quanta of some queues.

    totals: tokens of each queue; targets: their shares, in any unit.
    """

    def __init__(self, totals: np.ndarray, targets: np.ndarray, window: int = WINDOW, quantum: int = QUANTUM) -> None:
        self.totals, self.targets = np.asarray(totals, np.int64), np.asarray(targets, np.float64)
        self.units = -(-self.totals // quantum)
        self.window, self.quantum = window, quantum
        self.full, left = divmod(int(self.totals.sum()), window)
        sizes = [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]
        #: Where the sequences after the last full window begin.
        self.tail = self.full * window + np.cumsum([0, *sizes])

    def begins(self, queue: int, unit: np.ndarray) -> np.ndarray:
        """The place in the packed stream where each of a queue's quanta begins."""
        at = (unit + 0.5) / self.targets[queue]
        place = np.zeros(len(unit), np.int64)
        for q, (w, units, total) in enumerate(zip(self.targets, self.units, self.totals, strict=True)):
            if q == queue:
                served = unit
            else:
                served = np.clip(np.ceil(at * w - 0.5), 0, units).astype(np.int64)
                for _ in range(2):  # the same comparison of rounded times as any other task makes
                    back = (served > 0) & ~self._before(q, np.maximum(served - 1, 0), at, queue)
                    served = served - back
                    more = (served < units) & self._before(q, served, at, queue)
                    served = served + more
            place += np.minimum(served * self.quantum, total)
        return place

    def _before(self, q: int, unit: np.ndarray, at: np.ndarray, queue: int) -> np.ndarray:
        mine = (unit + 0.5) / self.targets[q]
        return (mine < at) | ((mine == at) & (q < queue))

    def pieces(self, queue: int, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, start, length, sequence, offset) of the pieces of some documents of one queue.

        Document i has n[i] > 0 tokens from the queue's place first[i] on.
        """
        low = first // self.quantum
        k = (first + n - 1) // self.quantum - low + 1
        doc = np.repeat(np.arange(len(n)), k)
        units = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + low[doc]
        begin = np.maximum(units * self.quantum, first[doc])
        length = np.minimum((units + 1) * self.quantum, (first + n)[doc]) - begin
        place = self.begins(queue, units) + begin - units * self.quantum
        start = begin - first[doc]
        while True:  # cut at the ends of sequences
            over = self.sequence(place) != self.sequence(place + length - 1)
            if not over.any():
                break
            take = self.sequence_end(place[over]) - place[over]
            rest = (doc[over], start[over] + take, length[over] - take, place[over] + take)
            length[over] = take
            doc, start, length, place = (np.concatenate(x) for x in zip((doc, start, length, place), rest, strict=True))
            order = np.lexsort((start, doc))
            doc, start, length, place = doc[order], start[order], length[order], place[order]
        seq = self.sequence(place)
        fresh = np.ones(len(start), bool)  # join what is next to each other in document and sequence
        fresh[1:] = (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + length[:-1]) | (seq[1:] != seq[:-1])
        head = np.flatnonzero(fresh)
        length = np.add.reduceat(length, head)
        doc, start, place, seq = doc[head], start[head], place[head], seq[head]
        return doc, start, length, seq, place - np.where(seq < self.full, seq * self.window, self.tail[np.clip(seq - self.full, 0, len(self.tail) - 1)])

    def sequence(self, place: np.ndarray) -> np.ndarray:
        late = np.searchsorted(self.tail, place, "right") - 1 + self.full
        return np.where(place < self.full * self.window, place // self.window, late)

    def sequence_end(self, place: np.ndarray) -> np.ndarray:
        late = self.tail[np.minimum(np.searchsorted(self.tail, place, "right"), len(self.tail) - 1)]
        return np.where(place < self.full * self.window, (place // self.window + 1) * self.window, late)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string, ids binary"


def packed(
    docs: DataFrame,
    path: str,
    pattern: str,
    special: tuple[tuple[str, int], ...] = (("<|endoftext|>", 50256),),
    targets: dict[str | None, float] | None = None,
    window: int = WINDOW,
    quantum: int = QUANTUM,
    text: str = "text",
    key: str = "doc_id",
    source: str = "source",
    with_ids: bool = True,
) -> DataFrame:
    """The pieces (PIECES) of all rows of docs. ids: the piece's ids as little-endian uint32, if wanted.

    path: a vocabulary of ranks (at most 65,536 ids) on every worker; pattern:
    its pre-token pattern. targets: a weight for each source, else its tokens.
    """
    if targets is not None and any(w <= 0 for w in targets.values()):
        raise ValueError("targets must be above 0")
    queue = docs[source].cast("string")
    if docs.select(queue.alias("queue")).distinct().count() > MOST_QUEUES:
        if targets is not None:
            raise ValueError(f"targets are for {MOST_QUEUES} sources at most")
        queue = F.pmod(F.xxhash64(queue), F.lit(MOST_QUEUES)).cast("string")
    tok = settle(tokenised(docs.select(docs[key].cast("long").alias("doc_id"), queue.alias("queue"), docs[text].cast("string").alias("text")), path, pattern, special), "packing-tokens")
    parts = tok.groupBy("part", "queue").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = settle(parts.select("part", "queue", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "packing-places")
    totals = {r["queue"]: r["n"] for r in parts.groupBy("queue").agg(F.sum("n").alias("n")).collect()}  # MOST_QUEUES rows at most
    names = sorted(totals, key=lambda q: (q is not None, q))
    number = {q: i for i, q in enumerate(names)}
    n = [totals[q] for q in names]
    schedule = Schedule(np.array(n, np.int64), np.array(n if targets is None else [targets.get(q, 1.0) for q in names], np.float64), window, quantum)
    place = parts.select(F.col("part").alias("p"), F.col("queue").alias("q"), "base")
    if parts.count() <= MOST_BROADCAST:
        place = F.broadcast(place)
    placed = tok.join(place, (tok.part == place.p) & tok.queue.eqNullSafe(place.q)).select("doc_id", "queue", (F.col("base") + F.col("local")).alias("first"), "n", "ids")

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            for lo in range(0, rb.num_rows, 1024):
                some = rb.slice(lo, 1024)
                ids = [np.frombuffer(x, "<u2") for x in some.column(4).to_pylist()]
                docs_of, queues = some.column(0), some.column(1).to_pylist()
                first, n = some.column(2).to_numpy(), some.column(3).to_numpy()
                of = np.array([number[q] for q in queues])
                for q in np.unique(of):
                    rows = np.flatnonzero(of == q)
                    doc, start, length, seq, off = schedule.pieces(int(q), first[rows], n[rows])
                    doc = rows[doc]
                    raw = [ids[d][a : a + m].astype("<u4").tobytes() for d, a, m in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)]
                    cols = [docs_of.take(pa.array(doc)), start, length, np.fromiter(map(zlib.crc32, raw), np.int64, len(raw)), n[doc], seq, off]
                    tail = [pa.array([queues[rows[0]]] * len(raw), pa.string()), pa.array(raw if with_ids else [None] * len(raw), pa.binary())]
                    yield pa.RecordBatch.from_arrays([cols[0], *map(pa.array, cols[1:]), *tail], names=[f.split()[0] for f in PIECES.split(", ")])

    return placed.mapInArrow(cut, PIECES)
