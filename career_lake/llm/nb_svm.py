"""Quality classifier: Naive Bayes support vectors (operator 2).

A text's n-gram indicators are scaled by their log-count ratios between the
classes; a linear hinge-loss model is fitted to the scaled indicators by dual
coordinate descent (Wang and Manning 2012; Hsieh et al. 2008). The n-grams are
byte trigrams and 1- to 3-grams of word shapes, where a shape tells kinds of
characters, punctuation and whether a word repeats the one before. They are
hashed to a fixed number of features.

The model is fitted in one task to a bounded sample (SAMPLE documents of
either label); every document is scored whole, where it is read. Null and empty
texts have no n-gram and get the score of the bias alone. If the sample lacks a
label, scores are that of the label present (0.5 without any). Repeated rows
are scored alike. An empty table gives an empty result. Other columns are no
input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from career_lake.llm.labelled import fitted
from career_lake.llm.text import BYTE_VALUE, STEP, Words, batches, mix, powers

#: Documents of either label that a fit takes at most.
SAMPLE = 3000
BITS = 17
FEATURES = 2 << BITS  # trigrams, then shapes
#: Kinds of bytes: letters by case, digits, bytes of other characters; each ASCII mark is its own kind.
KIND = np.arange(256, dtype=np.uint8)
KIND[97:123], KIND[65:91], KIND[48:58] = 97, 65, 48
KIND[0x80:0x9F], KIND[0x9F:0xC0], KIND[0xC0:] = 65, 97, 97


def _word_shapes(w: Words) -> np.ndarray:
    """A hash of each word's runs of byte kinds, with the length (1, 2, more) of runs of marks."""
    inside = np.flatnonzero(w.inside)
    kind = KIND[w.buf[inside]]
    lead = w.buf[inside] >= 0xC0  # counted with the byte after it
    word = np.repeat(np.arange(len(w)), w.ends - w.starts)
    inside, kind, word = inside[~lead], kind[~lead], word[~lead]
    fresh = np.ones(len(kind), bool)
    fresh[1:] = (kind[1:] != kind[:-1]) | (word[1:] != word[:-1])
    at = np.flatnonzero(fresh)
    run = np.minimum(np.diff(np.append(at, len(kind))), 3)
    code = kind[at].astype(np.int64)
    mark = ~np.isin(code, (97, 65, 48)) & (code < 128)
    owner = word[at]
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
    step = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    value = (BYTE_VALUE[code] + np.where(mark, run, 0).astype(np.uint64)) * powers(STEP[1], int(step.max()) + 1 if len(step) else 1)[step]
    out = np.zeros(len(w), np.uint64)
    if len(first):
        out[owner[first]] = mix(np.add.reduceat(value, first))
    return out


def feature_ids(buf: np.ndarray, off: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct features of each row."""
    shift = np.uint64(64 - BITS)
    tri = np.zeros(0, np.int64)
    if len(buf) > 2:
        b = buf.astype(np.uint64)
        tri = (mix(b[:-2] * np.uint64(65536) + b[1:-1] * np.uint64(256) + b[2:]) >> shift).astype(np.int64)
    w = Words(buf, off)
    shape, h = _word_shapes(w), w.hashes()
    if len(h):
        same = np.zeros(len(h), np.uint64)
        same[1:] += h[1:] == h[:-1]
        shape = mix(shape + same * STEP[0] + np.uint64(1))
    one = shape
    two = mix(shape[:-1] * np.uint64(3) + mix(shape[1:]))
    three = mix(two[:-1] * np.uint64(5) + mix(shape[2:])) if len(two) else two
    grams = [((g >> shift).astype(np.int64) + (1 << BITS)) for g in (one, two, three)]
    seen = np.zeros(FEATURES, bool)
    for lo, hi, a, b in zip(off[:-1], off[1:], w.first[:-1], w.first[1:], strict=True):
        seen[tri[lo : max(lo, hi - 2)]] = True
        for k, g in enumerate(grams):
            seen[g[a : max(a, b - k)]] = True
        ids = np.flatnonzero(seen)
        seen[ids] = False
        yield ids


@dataclass
class Model:
    weight: np.ndarray  # per feature: log-count ratio times the fitted weight
    ratio2: np.ndarray  # per feature: the ratio's square
    bias: float

    def score(self, ids: np.ndarray) -> float:
        norm = float(self.ratio2[ids].sum()) ** 0.5
        margin = float(self.weight[ids].sum()) / norm + self.bias if norm > 0 else self.bias
        return float(1 / (1 + np.exp(-np.clip(4 * margin, -40, 40))))


def fit(rows: list[np.ndarray], y: np.ndarray, cost: float = 1.0, passes: int = 12) -> Model:
    """The hinge-loss model of feature rows and their labels (0 or 1)."""
    none = np.zeros(FEATURES, np.float32)
    if len(set(y.tolist())) < 2:
        return Model(none, none, 10.0 * (2 * int(y[0]) - 1) if len(y) else 0.0)
    count = [np.ones(FEATURES), np.ones(FEATURES)]
    for ids, label in zip(rows, y, strict=True):
        count[label][ids] += 1
    ratio = (np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())).astype(np.float32)
    norms = [max(float((ratio[ids] ** 2).sum()) ** 0.5, 1e-9) for ids in rows]
    values = [ratio[ids] / n for ids, n in zip(rows, norms, strict=True)]
    squares = np.array([float((v**2).sum()) + 1 for v in values])
    sign = np.where(y == 1, 1.0, -1.0)
    bound = cost * len(y) / (2 * np.where(y == 1, (y == 1).sum(), (y == 0).sum()))  # both labels weigh alike
    w, bias, dual = np.zeros(FEATURES, np.float32), 0.0, np.zeros(len(y))
    rng = np.random.default_rng(7)
    for _ in range(passes):
        for i in rng.permutation(len(y)):
            grad = sign[i] * (float(w[rows[i]] @ values[i]) + bias) - 1
            new = min(max(dual[i] - grad / squares[i], 0.0), bound[i])
            if new != dual[i]:
                step = (new - dual[i]) * sign[i]
                w[rows[i]] += np.float32(step) * values[i]
                bias += step
                dual[i] = new
    return Model((w * ratio).astype(np.float32), ratio**2, bias)


def fit_sample(sample: DataFrame) -> Model:
    """The model of a bounded sample (doc_id, text, y)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            for lo, hi, buf, off in batches(rb, "text"):
                ids = [x.astype(np.uint32).tobytes() for x in feature_ids(buf, off)]
                yield pa.RecordBatch.from_arrays([rb.column(0)[lo:hi], rb.column(2)[lo:hi], pa.array(ids, pa.binary())], names=["doc_id", "y", "ids"])

    rows = sample.select("doc_id", "text", "y").mapInArrow(run, "doc_id long, y int, ids binary")
    schema = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("ids", pa.binary())])
    return fitted(rows, schema, lambda t: fit([np.frombuffer(x, np.uint32).astype(np.int64) for x in t["ids"].to_pylist()], t["y"].to_numpy().astype(np.int64)))


def quality_scores(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text, ...) with score (0 to 1, higher: label 1 likelier); a column of that name is replaced."""
    docs = docs.drop("score")
    at, names = docs.columns.index("text"), [*docs.columns, "score"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            scores = [model.score(ids) for _, _, buf, off in batches(rb, at) for ids in feature_ids(buf, off)]
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(scores, pa.float64())], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, score double")
