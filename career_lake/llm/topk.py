"""Exact top-k inner-product search by an impact-ordered index (operator 1).

Vectors are lists of integers. Rows are dealt into blocks by a hash. A block's
index keeps, for each dimension and each quantised impact (the component
divided by STEP, rounded down), the posting segment of its rows. Queries take
segments score-at-a-time, BLOCK_QUERIES at once: in rounds of descending
contribution, each posting adds its quantised impact times a query's component
to its row's accumulator for that query, as one matrix product a round. After a
round, what a row can still gain is bounded by the largest contributions left
in its dimensions. A row that cannot reach the k-th lower bound any more is no
possible member; a query is done when its possible members are few, or all
segments are. Possible members are rescored exactly.

A block of rows is indexed once; all queries are sent to each block and stream
through its index, so a task holds one block and one lot of queries. The k best
of each block are merged by a window over (query). Vectors that are null, empty
or of another length than the query's, or that hold null or non-finite
components, take no part. Rows that share the query's id are no candidates for
it; a repeated row is a candidate each time. Ties go to the smaller id. An
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a block on average, and queries that read its segments together.
BLOCK_ROWS, BLOCK_QUERIES = 8192, 128
#: Width of a quantised impact; shares of the largest contribution at which rounds end.
STEP = 16
ROUNDS = (0.5, 0.25, 0.12, 0.05, 0.0)
#: Possible members few enough to rescore at once.
FEW = 4


def quantised(vector: Column, scale: float) -> Column:
    """floor(scale * x) of each component as long; null if any component is null or not finite."""
    x = F.transform(vector, lambda v: v.cast("double"))
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & good, F.transform(x, lambda v: F.floor(v * F.lit(scale)).cast("long")))


class ImpactIndex:
    """Posting segments of a block of integer vectors (rows, dimensions), by dimension and quantised impact."""

    def __init__(self, m: np.ndarray) -> None:
        self.m = m
        level = m // STEP
        dim = np.broadcast_to(np.arange(m.shape[1]), m.shape)
        low = int(level.min())
        width = int(level.max()) - low + 1
        code = (dim * width + (level - low)).ravel()
        order = np.argsort(code, kind="stable")
        self.rows = order // m.shape[1]
        self.begin = np.flatnonzero(np.append(True, np.diff(code[order]) != 0))
        self.size = np.diff(np.append(self.begin, len(order)))
        first = code[order][self.begin]
        self.dim = first // width
        self.low = (first % width + low) * STEP  # a segment's components are low to high
        self.high = self.low + STEP - 1
        ends = np.flatnonzero(np.append(True, np.diff(self.dim) != 0))  # of the dimensions; segments go by level
        self.least, self.most = self.low[ends], self.high[np.append(ends[1:], len(self.dim)) - 1]

    def search(self, q: np.ndarray, k: int, ban: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(rows, exact scores) of possible members, for each query of q (queries, dimensions).

        Among them are the k best rows that aren't banned (queries, rows). The
        queries read segments together: a round's are those that can still give
        any of the queries so much.
        """
        x = q.astype(np.float64)
        # Contributions count from the dimension's least one on, so that none is negative.
        floor = np.minimum(x * self.least, x * self.most)
        width = np.abs(x) * (STEP - 1) / 2
        up, down = np.maximum(q, 0).max(0)[self.dim], np.maximum(-q, 0).max(0)[self.dim]
        gain = np.maximum(up * (self.high - self.least[self.dim]), down * (self.most[self.dim] - self.low))
        top = int(gain.max(initial=0))
        # What sums of doubles may be off by, generously.
        error = 1e-13 * len(self.least) * (np.abs(x) @ np.maximum(np.abs(self.least), np.abs(self.most)))
        total, read = np.zeros((len(q), len(self.m))), np.zeros(self.m.shape)
        done = np.zeros(len(self.dim), bool)
        open_, out = np.arange(len(q)), [(np.zeros(0, np.int64),) * 2] * len(q)
        for share in ROUNDS:
            segs = np.flatnonzero(~done & (gain >= share * top))
            done[segs] = True
            if len(segs):
                size = self.size[segs]
                at = np.repeat(self.begin[segs] - np.cumsum(size) + size, size) + np.arange(size.sum())
                rows, dims = self.rows[at], np.repeat(self.dim[segs], size)
                impact = np.zeros(self.m.shape)
                impact[rows, dims] = np.repeat((self.low[segs] + self.high[segs]) / 2, size)
                read[rows, dims] = 1
                total += x[open_] @ impact.T
            if done.all():
                sure = (width - floor)[open_].sum(1)[:, None], (width + floor)[open_].sum(1)[:, None]
            else:  # rest: the largest contribution not read yet, by query and dimension
                some = np.flatnonzero(~done)
                low, high = np.full(len(self.least), np.iinfo(np.int64).max), np.full(len(self.least), np.iinfo(np.int64).min)
                np.minimum.at(low, self.dim[some], self.low[some])
                np.maximum.at(high, self.dim[some], self.high[some])
                left = low <= high
                rest = np.where(left, np.maximum(x * np.where(left, low, 0), x * np.where(left, high, 0)) - floor, 0.0)[open_]
                sure = ((width - floor)[open_] - rest) @ read.T + rest.sum(1)[:, None], (width + floor)[open_] @ read.T
            upper, lower = total + sure[0] + error[open_, None], total - sure[1] - error[open_, None]
            upper[ban[open_]] = lower[ban[open_]] = -np.inf
            going = []
            for i, j in enumerate(open_):
                least = -np.inf
                if lower.shape[1] > k and (share == ROUNDS[-1] or lower[i].max() > upper[i].min()):  # else nothing can be told apart
                    least = np.partition(lower[i], -k)[-k]
                possible = np.flatnonzero((upper[i] >= least) & ~ban[j])
                if len(possible) <= FEW * k or share == ROUNDS[-1]:
                    out[j] = possible, self.m[possible] @ q[j]
                else:
                    going.append(i)
            open_, total = open_[going], total[going]
            if not len(open_):
                break
        return out


CELL = "query_id long, mark long, vec_id long, score long"


class _Block:
    """A block of rows, by length of vector; searched for lots of queries."""

    def __init__(self, rows: pd.DataFrame) -> None:
        self.of = {size: (ImpactIndex(np.stack(some["v"].to_list()).astype(np.int64)), some["id"].to_numpy()) for size, some in rows.groupby(rows["v"].map(len))}

    def best(self, queries: pd.DataFrame, k: int) -> Iterator[pd.DataFrame]:
        for size, asked in queries.groupby(queries["v"].map(len)):
            index, ids = self.of.get(size, (None, None))
            if index is None:
                continue
            for lo in range(0, len(asked), BLOCK_QUERIES):
                some = asked.iloc[lo : lo + BLOCK_QUERIES]
                qids, out = some["id"].to_numpy(), []
                found = index.search(np.stack(some["v"].to_list()).astype(np.int64), k, qids[:, None] == ids)
                for qid, mark, (at, scores) in zip(qids, some["mark"], found, strict=True):
                    best = np.lexsort((ids[at], -scores))[:k]
                    out.append((np.full(len(best), qid), np.full(len(best), mark), ids[at][best], scores[best]))
                yield pd.DataFrame(dict(zip(("query_id", "mark", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)), dtype="int64")


def _searched(k: int):  # noqa: ANN202
    """Rows of one block after another, each time followed by the queries; the k best of each block."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, rows, block = None, [], None
        for batch in it:
            for (r, asks), some in batch.groupby(["r", "asks"]):
                if r != at:
                    at, rows, block = r, [], None
                if not asks:
                    rows.append(some)
                elif rows or block:
                    if block is None:
                        block, rows = _Block(pd.concat(rows)), []
                    yield from block.best(some, k)

    return run


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best rows, for (id long, v array<long>) of rows and queries.

    Inner products must fit 63 bits.
    """
    rows, queries = (x.where("id is not null and v is not null").select("id", "v") for x in (rows, queries))
    queries = queries.distinct().withColumn("mark", F.xxhash64("v"))  # a repeated id with another vector is a query of its own
    blocks = max(1, -(-rows.count() // BLOCK_ROWS))
    left = rows.select(F.pmod(F.xxhash64("id", "v", F.lit(1)), F.lit(blocks)).cast("int").alias("r"), F.lit(False).alias("asks"), "id", F.lit(0).cast("long").alias("mark"), "v")
    right = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("r"), F.lit(True).alias("asks"), "id", "mark", "v")
    # A number of tasks that adaptive execution keeps: a block is few bytes and much work.
    tasks = max(2 * blocks, 4 * rows.sparkSession.sparkContext.defaultParallelism)
    found = left.union(right).repartition(tasks, "r").sortWithinPartitions("r", "asks").mapInPandas(_searched(k), CELL)
    place = F.row_number().over(Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
