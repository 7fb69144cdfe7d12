"""Facts of texts by their pieces: what is read often is extracted once.

A piece ends behind a full stop, which no pattern of facts crosses, so the facts
of a text follow from those of its pieces. Pieces that are read twice or more are
extracted once, the most frequent MOST_PIECES of them, and texts of such pieces
look their facts up; other texts are read as a whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from career_lake import rules

MOST_PIECES, PIECE_LENGTH = 50_000, 400
#: Fewer texts are read as a whole, which takes less time than to plan for both.
FEW_TEXTS = 100_000
#: Pieces that a task counts at a time, and those read once that it tells of them.
MOST_COUNTED, MOST_SINGLE = 100_000, 20_000
_PIECE = re.compile("[^。]*。|[^。]+")
_SPACE = re.compile(f"[{rules.WHITE_SPACE}]+")
_LIFE = re.compile("|".join(rules.LIFECYCLE_WORDS.values()))
#: Facets that are read from the raw text; the others read the compact one.
RAW = ("major_requirements", "work_locations")
_DEGREES = [d for d, _ in rules.DEGREE_FACTS]
_number = lambda v: int(v.rpartition("=")[2])
_MERGED: dict[str, Callable[[list[str]], list[str]]] = {
    "minimum_degree": lambda v: [min(v, key=_DEGREES.index)],
    "application_limits": lambda v: sorted(set(v), key=_number),
    "recruitment_headcounts": lambda v: sorted(v, key=_number),
}


def _compact(text: str) -> str:
    """facts.compact."""
    if text.split() == [text]:  # no white space
        return text
    return _SPACE.sub(" ", text).strip(" ")


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(piece, n) of what a task reads twice or more, and of MOST_SINGLE others: unlike texts are not shuffled as a whole; the number of texts under null."""
    seen: Counter[str | None] = Counter()
    left = MOST_SINGLE

    def out() -> pa.RecordBatch:
        nonlocal left
        often, single = {p: n for p, n in seen.items() if n > 1 or p is None}, [p for p, n in seen.items() if n == 1 and p is not None][:left]
        left -= len(single)
        often |= dict.fromkeys(single, 1)
        return pa.RecordBatch.from_arrays([pa.array(list(often), pa.string()), pa.array(list(often.values()), pa.int64())], ["piece", "n"])

    for batch in batches:
        seen[None] += batch.num_rows
        for text in batch.column(0).to_pylist():
            if text:
                short = _compact(text)
                seen.update(p for p in (_PIECE.findall(short) if short == text else {*_PIECE.findall(short), *_PIECE.findall(text)}) if len(p) <= PIECE_LENGTH)
        if len(seen) > MOST_COUNTED:
            yield out()
            seen.clear()
    yield out()


def _lookup(shared: Broadcast, facets: list[str]) -> Callable[[pa.Array, pa.Array], pa.Array]:
    raw = {i for i, f in enumerate(facets) if f in RAW}
    merged = [_MERGED.get(f, lambda v: sorted(set(v))) for f in facets]

    def facts_of(known: dict, text: str) -> tuple[bool, dict[int, list], int] | None:
        """Whether a text has a word of a status, its facts by facet, and its compact length; null if a piece is not known."""
        short, life, found = _compact(text), False, {}
        reads = ((short, None),) if short == text else ((short, False), (text, True))
        for part, which in reads:
            for p in _PIECE.findall(part):
                told = known.get(p)
                if told is None:
                    return None
                life = life or told[0]
                for i, values in told[1]:
                    if which is None or (i in raw) == which:
                        found.setdefault(i, []).append(values)
        return life, found, len(short)

    def look(content: pa.Array, title: pa.Array) -> pa.Array:
        known, rows = shared.value, len(content)
        counts, values = np.zeros((len(facets), rows + 1), np.int32), [[] for _ in facets]
        is_known, life, length = np.zeros(rows, bool), np.zeros(rows, bool), np.zeros(rows, np.int32)
        for row, (text, name) in enumerate(zip(content.to_pylist(), title.to_pylist(), strict=True)):
            got = None if text is None else facts_of(known, text)
            if got is None:
                continue
            is_known[row], life[row], length[row] = True, got[0] or bool(name and _LIFE.search(name)), got[2]
            for i, told in got[1].items():
                all_of = told[0] if len(told) == 1 else merged[i]([v for vs in told for v in vs])
                values[i] += all_of
                counts[i, row + 1] = len(all_of)
        at = np.cumsum(counts, axis=1, dtype=np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(at[i]), pa.array(values[i], pa.string())) for i in range(len(facets))]
        return pa.StructArray.from_arrays([pa.array(is_known), pa.array(life), pa.array(length), *lists], ["known", "life", "length", *facets])

    return look


def looked_up(docs: DataFrame, facts: Callable[[Column], dict[str, Column]]) -> Column | None:
    """A struct of docs(title, content): whether all its pieces are known, whether a lifecycle word is in it (life), its compact length, and the facets of facts(text).

    It reads the contents once to find the frequent pieces; null where there are under FEW_TEXTS.
    """
    spark = docs.sparkSession
    often = docs.select("content").mapInArrow(_frequent, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    often = often.where("n > 1 or piece is null").orderBy(F.col("piece").isNotNull(), F.desc("n"), "piece").limit(MOST_PIECES + 1).collect()
    if not often or often[0]["piece"] is not None or often[0]["n"] < FEW_TEXTS:
        return None
    pieces = spark.createDataFrame([(r["piece"],) for r in often[1:]], "piece string").repartition(4 * spark.sparkContext.defaultParallelism)
    found = facts(F.col("piece"))
    facets = list(found)
    each = F.array(*(F.struct(F.lit(i).alias("i"), v.alias("values")) for i, v in enumerate(found.values())))
    rows = pieces.select("piece", F.filter(each, lambda x: x["values"].isNull() | (F.size(x["values"]) > 0)).alias("facts")).collect()
    # A text with a value that is no text is read as a whole.
    known = {r.piece: (bool(_LIFE.search(r.piece)), tuple((x.i, tuple(x["values"])) for x in r.facts)) for r in rows if all(x["values"] is not None and None not in x["values"] for x in r.facts)}
    schema = ", ".join(["known boolean", "life boolean", "length int", *(f"{f} array<string>" for f in facets)])
    return F.arrow_udf(_lookup(spark.sparkContext.broadcast(known), facets), schema)("content", "title")
