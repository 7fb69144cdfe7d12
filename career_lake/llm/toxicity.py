"""Toxicity: a bidirectional gated recurrent network with attention pooling (operator 7).

Every word of a text has four inputs: one of the word itself and three of its
characters (its first 4 to 6 bytes, its strongest 4-gram, its mean 4-gram),
each looked up in tables learned from the sample. Two gated recurrent units
read each window of words in either direction, attention pools their states,
and a logistic unit scores the window. Windows overlap by half and cover the
whole text; a document's score is that of its worst window.

All is trained in numpy in one task, on a bounded sample (SAMPLE documents of
either label). Table inputs for training come from the other half of the
sample, so that no document is judged by its own words. Null and empty texts
are one window without words. If the sample lacks a label, scores are that of
the label present (0.5 without any). Repeated rows are scored alike. An empty
table gives an empty result. Other columns are no input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from career_lake.llm.labelled import fitted
from career_lake.llm.text import STEP, Words, batches, column_bytes, mix, powers

#: Documents of either label that training takes at most.
SAMPLE = 2500
#: Words of a window, and from one window to the next.
WINDOW, STRIDE = 32, 16
HIDDEN, INPUTS = 8, 4
BITS = 18
_HEADS = (4, 5, 6)


def _slots(h: np.ndarray) -> np.ndarray:
    return (mix(h) >> np.uint64(64 - BITS)).astype(np.int64)


class Features:
    """Table slots of the words of some rows: word, word heads, and 4-grams by byte."""

    def __init__(self, buf: np.ndarray, off: np.ndarray) -> None:
        self.words = w = Words(buf, off, lower=True)
        self.word = _slots(w.hashes())
        n = len(w.buf)
        wide = np.append(w.buf, np.zeros(8, np.uint8))
        four = wide[:n].astype(np.uint64)
        for k in (1, 2, 3):
            four |= wide[k : n + k].astype(np.uint64) << np.uint64(8 * k)
        lens = w.ends - w.starts
        self.heads = []
        head = four[w.starts] if len(w) else np.zeros(0, np.uint64)
        for k in _HEADS:
            if k > 4 and len(w):
                head = head | wide[w.starts + k - 1].astype(np.uint64) << np.uint64(8 * (k - 1))
            slots = _slots(head + powers(STEP[1], 8)[k])
            self.heads.append(np.where(lens >= k, slots, -1))
        left = np.zeros(n, np.int64)
        if len(w):
            left[w.inside] = np.repeat(w.ends, lens) - np.flatnonzero(w.inside)
        self.gram_at = np.flatnonzero(left >= 4)
        self.gram = _slots(four[self.gram_at])
        self.gram_word = np.searchsorted(w.starts, self.gram_at, "right") - 1


@dataclass
class Tables:
    """Log-odds of toxic documents by slot, for words, word heads and 4-grams."""

    word: np.ndarray
    heads: np.ndarray
    gram: np.ndarray

    def inputs(self, f: Features) -> np.ndarray:
        x = np.zeros((len(f.words), INPUTS), np.float32)
        if not len(x):
            return x
        x[:, 0] = self.word[f.word]
        for slots in f.heads:
            x[:, 1] = np.maximum(x[:, 1], np.where(slots >= 0, self.heads[slots], 0))
        if len(f.gram):
            value = self.gram[f.gram]
            first = np.flatnonzero(np.append(True, f.gram_word[1:] != f.gram_word[:-1]))
            owner = f.gram_word[first]
            x[owner, 2] = np.maximum.reduceat(value, first)
            x[owner, 3] = np.add.reduceat(value, first) / np.diff(np.append(first, len(value)))
        return x


def count_tables(rows: list[Features], y: np.ndarray) -> Tables:
    """Tables from the documents (one Features each) that have a slot, by label."""
    seen = [np.zeros((2, 1 << BITS), np.float32) for _ in range(3)]
    for f, label in zip(rows, y, strict=True):
        heads = np.concatenate(f.heads)
        for table, slots in zip(seen, (f.word, heads[heads >= 0], f.gram), strict=True):
            table[label][np.unique(slots)] += 1
    n = np.maximum(np.bincount(y, minlength=2), 1)
    odds = []
    for t in seen:
        lo = np.log((t[1] + 0.25) / (n[1] + 0.5)) - np.log((t[0] + 0.25) / (n[0] + 0.5))
        total = t.sum(0)
        odds.append((np.clip(lo, -4, 8) * total / (total + 2) / 4).astype(np.float32))
    return Tables(*odds)


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, words) of each window; rows have words first[r]..first[r+1]-1."""
    n = np.diff(first)
    k = np.maximum(1, -(-(n - (WINDOW - STRIDE)) // STRIDE))
    row = np.repeat(np.arange(len(n)), k)
    at = (np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)) * STRIDE
    return row, first[:-1][row] + at, np.minimum(n[row] - at, WINDOW)


def gather(x: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inputs (step, window, input) and the mask of steps that have a word."""
    step = np.arange(WINDOW)
    mask = step[:, None] < n[None, :]
    place = np.minimum(at[None, :] + step[:, None], max(len(x) - 1, 0))
    got = x[place] * mask[:, :, None] if len(x) else np.zeros((*mask.shape, INPUTS), np.float32)
    return got.astype(np.float32), mask


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-v))


@dataclass
class Network:
    """Weights by name. f and b: the two directions; rows of U and W: update, reset, candidate."""

    p: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def fresh(seed: int = 11) -> Network:
        r, p = np.random.default_rng(seed), {}
        for d in "fb":
            p[f"W{d}"] = r.normal(0, 0.5, (INPUTS, 3 * HIDDEN))
            p[f"U{d}"] = r.normal(0, 0.3, (HIDDEN, 3 * HIDDEN))
            p[f"c{d}"] = np.zeros(3 * HIDDEN)
        p["v"] = r.normal(0, 0.3, 2 * HIDDEN)
        p["u"] = r.normal(0, 0.3, 2 * HIDDEN)
        p["o"] = np.zeros(1)
        return Network({k: v.astype(np.float32) for k, v in p.items()})

    def _read(self, x: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """States (step, window, hidden) of one direction."""
        H, U = HIDDEN, self.p[f"U{d}"]
        inner = x @ self.p[f"W{d}"] + self.p[f"c{d}"]
        out = np.empty((*x.shape[:2], H), np.float32)
        h = np.zeros((x.shape[1], H), np.float32)
        for t in range(len(x)) if d == "f" else reversed(range(len(x))):
            gates = _sigmoid(inner[t, :, : 2 * H] + h @ U[:, : 2 * H])
            z, reset = gates[:, :H], gates[:, H:]
            new = np.tanh(inner[t, :, 2 * H :] + (reset * h) @ U[:, 2 * H :])
            if keep is not None:
                keep.append((t, h, z, reset, new))
            h = h + z * (new - h)
            out[t] = h
        return out

    def logits(self, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        steps = {d: [] if keep is not None else None for d in "fb"}
        s = np.concatenate([self._read(x, d, steps[d]) for d in "fb"], 2)
        a = np.where(mask, s @ self.p["v"], -30.0).astype(np.float32)
        a = np.exp(a - a.max(0))
        a /= a.sum(0)
        pooled = (s * a[:, :, None]).sum(0)
        if keep is not None:
            keep |= {"s": s, "a": a, "pooled": pooled, "steps": steps}
        return pooled @ self.p["u"] + self.p["o"][0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss."""
        k: dict = {}
        d_logit = (_sigmoid(self.logits(x, mask, k)) - y) / len(y)
        p, H, s, a = self.p, HIDDEN, k["s"], k["a"]
        g = {"o": np.array([d_logit.sum()]), "u": k["pooled"].T @ d_logit}
        d_pooled = d_logit[:, None] * p["u"]
        d_a = (s * d_pooled).sum(2)
        d_e = a * (d_a - (a * d_a).sum(0)) * mask
        g["v"] = np.einsum("tn,tnh->h", d_e, s)
        d_s = a[:, :, None] * d_pooled + d_e[:, :, None] * p["v"]
        for i, d in enumerate("fb"):
            U, gU, d_inner = p[f"U{d}"], np.zeros_like(p[f"U{d}"]), np.zeros((*x.shape[:2], 3 * H), np.float32)
            d_h = np.zeros((x.shape[1], H), np.float32)
            for t, h, z, reset, new in reversed(k["steps"][d]):
                d_h = d_h + d_s[t, :, i * H : (i + 1) * H]
                d_n = d_h * z * (1 - new * new)
                d_rh = d_n @ U[:, 2 * H :].T
                d_g = np.concatenate([d_h * (new - h) * z * (1 - z), d_rh * h * reset * (1 - reset)], 1)
                gU[:, 2 * H :] += (reset * h).T @ d_n
                gU[:, : 2 * H] += h.T @ d_g
                d_inner[t] = np.concatenate([d_g, d_n], 1)
                d_h = d_h * (1 - z) + d_rh * reset + d_g @ U[:, : 2 * H].T
            g[f"U{d}"], g[f"c{d}"] = gU, d_inner.sum((0, 1))
            g[f"W{d}"] = np.einsum("tni,tnk->ik", x, d_inner, optimize=True)
        return g

    def train(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, epochs: int = 8, size: int = 256, rate: float = 0.01, steps: int = 300) -> None:
        """Adam on shuffled batches, for so many epochs and steps at least."""
        rng, m1, m2, n = np.random.default_rng(5), {}, {}, 0
        size = max(1, min(size, len(y) // 4))
        epochs = max(epochs, -(-steps // max(1, len(y) // size)))
        for epoch in range(epochs):
            for some in np.array_split(rng.permutation(len(y)), max(1, len(y) // size)):
                n += 1
                for name, grad in self.gradients(x[:, some], mask[:, some], y[some]).items():
                    m1[name] = 0.9 * m1.get(name, 0) + 0.1 * grad
                    m2[name] = 0.99 * m2.get(name, 0) + 0.01 * grad**2
                    step = rate * 0.8 ** (8 * epoch / epochs) * (m1[name] / (1 - 0.9**n)) / (np.sqrt(m2[name] / (1 - 0.99**n)) + 1e-7)
                    self.p[name] = (self.p[name] - step).astype(np.float32)


@dataclass
class Model:
    tables: Tables | None
    network: Network | None
    constant: float = 0.5

    def window_scores(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, first word in the row, score) of every window of some rows."""
        f = Features(buf, off)
        row, at, n = windows(f.words.first)
        place = at - f.words.first[:-1][row]
        if self.network is None:
            return row, place, np.full(len(row), self.constant)
        x, scores = self.tables.inputs(f), []
        for lo in range(0, len(row), 4096):
            scores.append(self.network.logits(*gather(x, at[lo : lo + 4096], n[lo : lo + 4096])))
        return row, place, _sigmoid(np.concatenate(scores).astype(np.float64)) if scores else np.zeros(0)

    def scores(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """The worst window's score of each row."""
        row, _, score = self.window_scores(buf, off)
        out = np.zeros(len(off) - 1)
        np.maximum.at(out, row, score)
        return out


def fit(texts: pa.Array, y: np.ndarray) -> Model:
    """The model of some texts and their labels (0 or 1)."""
    if len(set(y.tolist())) < 2:
        return Model(None, None, float(y[0]) if len(y) else 0.5)
    buf, off = column_bytes(texts)
    rows = [Features(buf[off[i] : off[i + 1]], np.array([0, off[i + 1] - off[i]])) for i in range(len(y))]
    half = np.arange(len(y)) % 2
    rng = np.random.default_rng(3)
    xs, masks, ys = [], [], []
    for side in (0, 1):
        other = np.flatnonzero(half != side)
        tables = count_tables([rows[i] for i in other], y[other])
        for i in np.flatnonzero(half == side):
            x = tables.inputs(rows[i])
            _, at, n = windows(rows[i].words.first)
            got, mask = gather(x, at, n)
            worst = int(got.max((0, 2)).argmax())
            # A toxic document's worst window is toxic; of a clean one, all are clean.
            take = [worst] if y[i] else sorted({worst, *rng.integers(0, len(at), 2).tolist()})
            xs.append(got[:, take])
            masks.append(mask[:, take])
            ys += [y[i]] * len(take)
    network = Network.fresh()
    network.train(np.concatenate(xs, 1), np.concatenate(masks, 1), np.array(ys, np.float32))
    return Model(count_tables(rows, y), network)


def fit_sample(sample: DataFrame) -> Model:
    """The model of a bounded sample (doc_id, text, y)."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("y", pa.int32())])
    return fitted(sample, schema, lambda t: fit(t["text"].combine_chunks(), t["y"].to_numpy().astype(np.int64)))


def toxicity_scores(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text, ...) with score (0 to 1, higher: label 1 likelier); a column of that name is replaced."""
    docs = docs.drop("score")
    at, names = docs.columns.index("text"), [*docs.columns, "score"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            scores = [model.scores(buf, off) for _, _, buf, off in batches(rb, at, 1 << 20)]
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, score double")
