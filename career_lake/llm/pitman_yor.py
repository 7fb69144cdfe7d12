"""Language-model scoring by a hierarchical Pitman-Yor model (operator 4).

Tokens are lower-cased words and one end per text. Every training token has a
context restaurant for the tokens that follow it; the context of a text's first
token is the end. All context restaurants share the root restaurant as parent,
whose own parent is uniform over the training words and one unknown word.

A dish's customers are seated by Gibbs sampling: given all else, its number of
tables has a probability proportional to the generalised Stirling number times
the parent's odds to the power of the tables; up to EXACT customers it is drawn
from that, beyond it (a large dish) customers are seated in growing blocks, each
at the odds its block begins with. Predictive probabilities are averaged over
the samples kept and summed as log10.

Where the work is: words of at least 1/CONTEXTS of the training tokens are
frequent; this decides where a token is dealt, not what it is scored by. Tokens
after other words go to buckets by their context, which hold the whole
restaurants; other words after frequent ones go to buckets by word; frequent
words after frequent ones are at most CONTEXTS**2 counts, which partial
aggregation gathers.

1. A bucket seats the restaurants of its contexts, with a root of its own, and
   tells the tables of each word to the bucket of that word.
2. A bucket of words seats them after frequent contexts, given these tables,
   with totals over all words extrapolated from its own; it answers with the
   words' customers and tables at the root, and tells its sums.
3. With the sums and the answers, the same samples are drawn again (the same
   seeds, in the order of the hashes) and score the tokens, so that the
   probabilities after each context add up to one.

All is one plan, whose exchange of the tokens Spark reuses in each step.

Words are told apart by 64-bit hashes. Null and empty texts are one end token.
Repeated rows are scored each, and learned each. A null doc_id stays null. Without training rows every
token has the probability 1. An empty table gives an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from career_lake.llm.text import Words, batches, mix, row_slices
from career_lake.session import settle

#: A frequent word holds at least one of so many training tokens; hence there are at most so many.
CONTEXTS = 2048
#: Discount and strength of the context restaurants and of the root.
DISCOUNT, STRENGTH, ROOT_DISCOUNT, ROOT_STRENGTH = 0.8, 1.0, 0.6, 10.0
BURN_IN, SAMPLES = 2, 3
EXACT = 32
#: Bytes of text whose tokens a bucket holds on average, and the fewest buckets.
BUCKET_BYTES, LEAST_BUCKETS = 12_000_000, 40
SLICE = 4 << 20
#: Bytes of a slice that are hashed at once, and tokens that are scored at once: temporary arrays are a multiple of them.
PART, SCORED = 1 << 19, 1 << 17
END = np.uint64(0x5EED0FE2D5EED0FE)


def _stirling(most: int, d: float) -> np.ndarray:
    """log of the generalised Stirling numbers S(c, t) with discount d, for c, t up to most."""
    s = np.full((most + 1, most + 1), -np.inf)
    s[0, 0] = 0
    for c in range(most):
        t = np.arange(1, most + 1)
        with np.errstate(divide="ignore"):
            s[c + 1, 1:] = np.logaddexp(s[c, :-1], np.log(np.maximum(c - t * d, 1e-300)) + s[c, 1:])
    return s


_TABLES = {d: _stirling(EXACT, d) for d in (DISCOUNT, ROOT_DISCOUNT)}


def sample_tables(c: np.ndarray, odds: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """The number of tables of dishes with c customers (0: none), given the parent's odds of a new table."""
    t = np.minimum(c, 1).astype(np.int64)
    log_odds = np.log(np.maximum(odds, 1e-300))
    for n in range(2, EXACT + 1):
        at = np.flatnonzero(c == n)
        if len(at):
            score = _TABLES[d][n, 1 : n + 1] + log_odds[at, None] * np.arange(1, n + 1)
            t[at] = 1 + (score + rng.gumbel(size=score.shape)).argmax(1)
    at = np.flatnonzero(c > EXACT)
    if len(at):
        left, seated, tables, a = c[at] - 1, np.ones(len(at), np.int64), np.ones(len(at), np.int64), odds[at]
        while left.any():
            block = np.minimum(left, np.maximum(1, seated // 8))
            tables += rng.binomial(block, np.clip(a / (a + seated - d * tables), 0, 1))
            seated, left = seated + block, left - block
        t[at] = np.minimum(tables, c[at])
    return t


@dataclass
class Dishes:
    """Customers of some dishes: pairs (dish, ctx, c), sorted; direct: other customers of the root by dish, or by sample and dish."""

    pair_dish: np.ndarray
    pair_ctx: np.ndarray
    pair_c: np.ndarray
    direct: np.ndarray

    def samples(self, context_c: np.ndarray, n_train: int, n_words: int, seed: int, whole: bool, n_own: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(tables of pairs, customers of dishes at the root, their tables) of each sample kept.

        context_c: all customers of each context. whole: these are all dishes;
        else totals are extrapolated from them, who have n_own training tokens.
        """
        rng = np.random.default_rng(seed)
        own_c = np.bincount(self.pair_ctx, self.pair_c, len(context_c))
        given = np.broadcast_to(self.direct, (SAMPLES, self.direct.shape[-1]))
        scale = np.where(own_c > 0, context_c / np.maximum(own_c, 1), 1.0)
        grow = 1.0 if whole or not n_own else n_train / n_own
        t = np.minimum(self.pair_c, 1)
        for sweep in range(BURN_IN + SAMPLES):
            direct = given[max(sweep - BURN_IN, 0)]
            root_c = direct + np.bincount(self.pair_dish, t, len(direct)).astype(np.int64)
            if sweep == 0:
                root_t = np.minimum(root_c, 1)
            t0 = root_t.sum() * grow
            root_t = sample_tables(root_c, np.full(len(root_c), (ROOT_STRENGTH + ROOT_DISCOUNT * t0) / (n_words + 1)), ROOT_DISCOUNT, rng)
            parent = root_probability(root_c, root_t, root_c.sum() * grow, root_t.sum() * grow, n_words)
            t_u = np.bincount(self.pair_ctx, t, len(context_c)) * scale
            t = sample_tables(self.pair_c, (STRENGTH + DISCOUNT * t_u[self.pair_ctx]) * parent[self.pair_dish], DISCOUNT, rng)
            if sweep >= BURN_IN:
                root_c = direct + np.bincount(self.pair_dish, t, len(direct)).astype(np.int64)
                yield t, root_c, np.minimum(root_t, root_c)


def root_probability(c: np.ndarray, t: np.ndarray, all_c: float, all_t: float, n_words: int) -> np.ndarray:
    return (c - ROOT_DISCOUNT * t + (ROOT_STRENGTH + ROOT_DISCOUNT * all_t) / (n_words + 1)) / (ROOT_STRENGTH + all_c)


def totals(dishes: Dishes, samples: Iterator, n_ctx: int) -> np.ndarray:
    """Per sample: tables of each context, then customers and tables of the root."""
    return np.array([[*np.bincount(dishes.pair_ctx, t, n_ctx), c.sum(), r.sum()] for t, c, r in samples], np.int64)


def predictions(dishes: Dishes, samples: Iterator, sums: np.ndarray, context_c: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Averages over samples: probability of each pair; of each dish at the root; and of each dish after each context it has not followed: dish value times context value is summed by sample, so the parts are returned.

    Returns (pairs, root (sample, dish), back-off (sample, context)).
    """
    pairs, roots, backs = [], [], []
    for (t, c, r), total in zip(samples, sums, strict=True):
        root = root_probability(c, r, total[-2], total[-1], n_words)
        back = (STRENGTH + DISCOUNT * total[:-2]) / (STRENGTH + context_c)
        u = dishes.pair_ctx
        pairs.append((dishes.pair_c - DISCOUNT * t) / (STRENGTH + context_c[u]) + back[u] * root[dishes.pair_dish])
        roots.append(root)
        backs.append(back)
    return np.mean(pairs, 0), np.array(roots), np.array(backs)


def token_logs(dish: np.ndarray, ctx: np.ndarray, d: Dishes, pairs: np.ndarray, roots: np.ndarray, backs: np.ndarray) -> np.ndarray:
    """log10 of each token's probability. dish -1: never seen in training; ctx 0: the root alone."""
    known = dish >= 0
    floor = roots[:, -1]  # the last dish stands for the unknown word
    root = np.where(known, roots[:, dish], floor[:, None])
    p = np.where(ctx > 0, backs[:, ctx] * root, root).mean(0)
    n_ctx = backs.shape[1]
    keys = d.pair_dish.astype(np.int64) * n_ctx + d.pair_ctx
    want = dish.astype(np.int64) * n_ctx + ctx
    if len(keys):
        at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        p = np.where(known & (ctx > 0) & (keys[at] == want), pairs[at], p)
    return np.log10(p)


def _tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each token, of the token before it or END, row) of some rows, a part at a time."""
    parts = [(lo, _part_tokens(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])) for lo, hi in row_slices(off, PART)]
    return tuple(np.concatenate(x) for x in zip(*((h, before, row + lo) for lo, (h, before, row) in parts), strict=True))


def _part_tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    w = Words(buf, off, lower=True)
    h, n = w.hashes(), w.counts()
    row = np.repeat(np.arange(len(n)), n + 1)
    first = np.cumsum(n + 1) - (n + 1)
    out = np.full(len(row), END, np.uint64)
    word = np.ones(len(row), bool)
    word[first + n] = False
    out[word] = np.where(h == END, ~END, h)
    before = np.zeros(len(row), np.uint64)
    before[1:] = out[:-1]
    before[first] = END
    return out, before, row


def _slices(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Rows (doc_id, mark, learn, text) with their tokens."""
    for rb in it:
        for lo, hi, buf, off in batches(rb, 3, SLICE):
            yield rb.slice(lo, hi - lo), _tokens(buf, off)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _places(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Where sorted keys have h, else -1."""
    if not len(keys):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, at, -1)


def _cut(bucket: np.ndarray, buckets: int) -> np.ndarray:
    return np.searchsorted(bucket, np.arange(buckets + 1))


@dataclass
class Vocabulary:
    """Totals of the training tokens and the frequent words (sorted hashes and counts)."""

    n_tokens: int
    n_words: int
    keys: np.ndarray
    counts: np.ndarray


def vocabulary(docs: DataFrame, buckets: int) -> Vocabulary:
    def send(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb, (h, _, row) in _slices(it):
            learn = rb.column(2).to_numpy(zero_copy_only=False)
            keys, n = np.unique(h[learn[row]], return_counts=True)
            cut = _cut(_bucket(keys, buckets), buckets)
            full = np.flatnonzero(np.diff(cut))
            yield pa.RecordBatch.from_arrays(
                [pa.array(full.astype(np.int32)), pa.array([keys[cut[b] : cut[b + 1]].tobytes() for b in full], pa.binary()), pa.array([n[cut[b] : cut[b + 1]].astype(np.uint32).tobytes() for b in full], pa.binary())],
                names=["bucket", "keys", "n"],
            )

    def reduce(t: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(x, np.uint64) for x in t["keys"].to_pylist()])
        n = np.concatenate([np.frombuffer(x, np.uint32) for x in t["n"].to_pylist()])
        keys, inv = np.unique(keys, return_inverse=True)
        n = np.bincount(inv, n, len(keys)).astype(np.int64)
        top = n * CONTEXTS >= n.sum()  # a word frequent over all buckets is so in its own
        return pa.table([[int(n.sum())], [len(keys)], [keys[top].tobytes()], [n[top].tobytes()]], names=["tokens", "words", "keys", "n"])

    sent = docs.mapInArrow(send, "bucket int, keys binary, n binary")
    found = settle(sent.groupBy("bucket").applyInArrow(reduce, "tokens long, words long, keys binary, n binary"), "pitman-yor-words")
    total = found.agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words")).first()
    n_tokens = total["tokens"] or 0

    def frequent(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            for keys, n in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
                k, c = np.frombuffer(keys, np.int64), np.frombuffer(n, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(k[c * CONTEXTS >= n_tokens]), pa.array(c[c * CONTEXTS >= n_tokens])], names=["key", "n"])

    top = found.select("keys", "n").mapInArrow(frequent, "key long, n long").toArrow()  # CONTEXTS rows at most
    keys, n = top["key"].to_numpy().astype(np.uint64), top["n"].to_numpy()
    order = np.argsort(keys)
    return Vocabulary(n_tokens, total["words"] or 0, keys[order], n[order])


def _frequent_pairs(docs: DataFrame, v: Vocabulary) -> Dishes:
    """Dishes of the frequent words after each other: at most CONTEXTS**2 counts."""
    width = len(v.keys) + 1

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(v.keys) * width, np.int64)
        for rb, (h, before, row) in _slices(it):
            learn = rb.column(2).to_numpy(zero_copy_only=False)
            dish = _places(v.keys, h)
            ctx = _places(v.keys, before) + 1
            use = learn[row] & (dish >= 0) & (ctx > 0)
            np.add.at(total, dish[use] * width + ctx[use], 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["pair", "n"])

    got = docs.mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow().sort_by("pair")
    pair, n = got["pair"].to_numpy(), got["n"].to_numpy()
    return Dishes(pair // width, pair % width, n, np.zeros(len(v.keys), np.int64))


BY_WORD, BY_CONTEXT, FREQUENT = range(3)
STREAM = "bucket int, kind int, keys binary, n binary, near binary, far binary, of binary, mark binary, learn binary, ids binary, known binary"


def _stream(docs: DataFrame, v: Vocabulary, buckets: int) -> DataFrame:
    """All tokens, packed by bucket and kind: keys (hash, tokens) that they are sorted by, then of each token the other word and the row.

    The other word is the number of a frequent word (near), or 0 and a hash (far).
    FREQUENT: tokens of a slice whose words are both frequent, with all its rows and their doc_ids.
    """

    def send(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb, (h, before, row) in _slices(it):
            (ids, known), mark, learn = _ids(rb), rb.column(1).to_numpy(), rb.column(2).to_numpy(zero_copy_only=False)
            word, ctx = _places(v.keys, h) + 1, _places(v.keys, before) + 1
            out: list[list] = [[] for _ in range(11)]

            def put(b: int, kind: int, keys: np.ndarray, n: np.ndarray, near: np.ndarray, far: np.ndarray, rows: np.ndarray, of: np.ndarray, ids: bytes = b"", known: bytes = b"") -> None:
                for col, x in zip(out, (b, kind, keys, n.astype(np.uint32), near.astype(np.uint16), far, of.astype(np.uint16), mark[rows], learn[rows], ids, known), strict=True):
                    col.append(x if isinstance(x, int | bytes) else x.tobytes())

            for kind, use, by, other in ((BY_WORD, (word == 0) & (ctx > 0), h, ctx), (BY_CONTEXT, ctx == 0, before, word)):
                at = np.flatnonzero(use)
                at = at[np.argsort(by[at], kind="stable")]
                cut = _cut(_bucket(by[at], buckets), buckets)
                for b in np.flatnonzero(np.diff(cut)):
                    part = at[cut[b] : cut[b + 1]]
                    rows, of = np.unique(row[part], return_inverse=True)
                    put(int(b), kind, *np.unique(by[part], return_counts=True), other[part], h[part][other[part] == 0], rows, of)
            at = np.flatnonzero((word > 0) & (ctx > 0))
            b = int(_bucket(mix(np.add.reduce(h, keepdims=True)), buckets)[0])
            put(b, FREQUENT, ctx[at].astype(np.uint16), np.zeros(0), word[at], h[:0], np.arange(rb.num_rows), row[at], ids.tobytes(), known.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()), *(pa.array(c, pa.binary()) for c in out[2:])], names=[f.split()[0] for f in STREAM.split(", ")])

    return docs.mapInArrow(send, STREAM)


def _joined(parts: list, kind: type) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in parts]) if parts else np.zeros(0, kind)


def _pack(a: np.ndarray) -> bytes:
    """Counts as 32 bits, the high bytes apart, which are mostly 0."""
    return np.ascontiguousarray(a.astype("<u4").reshape(-1, 1).view(np.uint8).T).tobytes()


def _unpack(parts: list[bytes], width: int) -> np.ndarray:
    """(width, n) counts from packed parts of (width, some)."""
    one = lambda x: np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(4, -1).T).view("<u4").reshape(width, -1)
    return np.concatenate([np.zeros((width, 0), np.int64), *map(one, parts)], 1).astype(np.int64)


class Tokens:
    """The tokens of one kind in a bucket: place among the sorted keys, other word, row."""

    def __init__(self, t: pa.Table, kind: int) -> None:
        t = t.filter(pa.compute.equal(t["kind"], kind))
        get = lambda name: t[name].to_pylist()
        learn = get("learn")
        base = np.cumsum([0, *map(len, learn)])
        of = [np.frombuffer(o, np.uint16).astype(np.int64) + b for o, b in zip(get("of"), base[:-1], strict=True)]
        self.of = np.concatenate(of) if of else np.zeros(0, np.int64)
        self.learn, self.mark = _joined(learn, np.bool_)[self.of], _joined(get("mark"), np.int64)
        self.near, self.far = _joined(get("near"), np.uint16).astype(np.int64), _joined(get("far"), np.uint64)
        if kind == FREQUENT:
            self.ctx = _joined(get("keys"), np.uint16).astype(np.int64)
            self.ids = pa.array(_joined(get("ids"), np.int64), mask=~_joined(get("known"), np.bool_))
        else:
            self.keys, inv = np.unique(_joined(get("keys"), np.uint64), return_inverse=True)
            self.at = np.repeat(inv, _joined(get("n"), np.uint32))
            self.seed = int(self.keys[0] >> np.uint64(33)) if len(self.keys) else 0


def _pairs(dish: np.ndarray, ctx: np.ndarray, n_ctx: int, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Dish, context and customers of each pair, and the pair of each token. Pairs of other rows than those to learn from have no customers."""
    pair, inv = np.unique(dish * n_ctx + ctx, return_inverse=True)
    return pair // n_ctx, pair % n_ctx, np.bincount(inv[learn], minlength=len(pair)), inv


class Contexts:
    """Whole restaurants of a bucket. Dishes: the frequent words, then the bucket's other words by hash (keys)."""

    def __init__(self, t: pa.Table, v: Vocabulary) -> None:
        self.tokens = k = Tokens(t, BY_CONTEXT)
        self.keys, far = np.unique(k.far, return_inverse=True)
        word = k.near - 1
        word[k.near == 0] = far + len(v.keys)
        n_dish = len(v.keys) + len(self.keys)
        dish, ctx, c, self.pair = _pairs(word, k.at, max(len(k.keys), 1), k.learn)
        self.word, self.customers = word, np.bincount(ctx, c, len(k.keys)).astype(np.int64)
        self.count = np.bincount(word[k.learn], minlength=n_dish)
        self.dishes = Dishes(dish, ctx, c, np.zeros(n_dish, np.int64))
        self.n_words = v.n_words

    def samples(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        return self.dishes.samples(self.customers, 0, self.n_words, self.tokens.seed, True)


class ByWord:
    """Words of a bucket after frequent contexts, given what buckets of contexts told of them (SAMPLES counts of tables, and tokens)."""

    def __init__(self, t: pa.Table, told: pa.Table, v: Vocabulary) -> None:
        self.tokens = k = Tokens(t, BY_WORD)
        told = told.sort_by("src")
        self.src, self.asked = told["src"].to_pylist(), [np.frombuffer(x, np.uint64) for x in told["keys"].to_pylist()]
        told = _unpack(told["body"].to_pylist(), SAMPLES + 1)
        keys = np.concatenate([k.keys, *self.asked])
        self.words, at = np.unique(keys, return_inverse=True)
        self.dish, at = at[: len(k.keys)][k.at], at[len(k.keys) :]
        direct = np.array([np.bincount(at, x, len(self.words)) for x in told]).astype(np.int64)
        self.told = direct  # by word
        self.count = direct[-1] + np.bincount(self.dish[k.learn], minlength=len(self.words))
        self.at = np.split(at, np.cumsum([len(x) for x in self.asked])[:-1]) if self.asked else []
        dish, ctx, c, self.pair = _pairs(self.dish, k.near, len(v.keys) + 1, k.learn)
        self.dishes = Dishes(dish, ctx, c, direct[:-1])
        self.v = v

    def samples(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        seed = int(self.words[0] >> np.uint64(33)) if len(self.words) else 0
        n_own = int(self.count.sum())
        return self.dishes.samples(_context_counts(self.v), self.v.n_tokens, self.v.n_words, seed, False, n_own)


def _context_counts(v: Vocabulary) -> np.ndarray:
    """Customers of each frequent context."""
    return np.concatenate(([0], v.counts)).astype(np.int64)


SUMS = "doc_id long, mark long, rows long, n_tokens long, n_known long, base double, score double"


def _ids(rb: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The doc_ids (0 for null) and whether they are known."""
    return rb.column(0).fill_null(0).to_numpy(), rb.column(0).is_valid().to_numpy(zero_copy_only=False)


def _sum_rows(mark: np.ndarray, ids: pa.Array | None, of: np.ndarray, count: np.ndarray, logs: np.ndarray) -> pa.RecordBatch:
    """Sums of the tokens of each row. ids: the rows' doc_ids, in the one part that has them."""
    m = len(mark)
    add = lambda x: np.bincount(of, x, m).astype(np.float64)
    cols = [pa.nulls(m, pa.int64()) if ids is None else ids, mark, np.full(m, int(ids is not None)), np.bincount(of, minlength=m), add(count > 0).astype(np.int64), add(np.log10(count + 1.0)), add(logs)]
    return pa.RecordBatch.from_arrays([cols[0], *map(pa.array, cols[1:])], names=[f.split()[0] for f in SUMS.split(", ")])


def document_scores(docs: DataFrame, learn: Column, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, learned, n_tokens, n_known, train_tokens, base_score, score of each row of docs.

    learn: a condition on docs; the model learns from the rows that meet it.
    """
    plain = F.coalesce(docs[text].cast("string"), F.lit(""))
    docs = docs.select(docs[key].cast("long").alias("doc_id"), F.xxhash64(docs[key].cast("long"), plain).alias("mark"), F.coalesce(learn, F.lit(False)).alias("learn"), plain.alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(max(LEAST_BUCKETS, size // BUCKET_BYTES))
    v = vocabulary(docs, buckets)
    width, context_c = len(v.keys) + 1, _context_counts(v)
    frequent = _frequent_pairs(docs, v)
    stream = _stream(docs, v, buckets)
    n_frequent = len(v.keys)

    def frequent_samples(given: np.ndarray) -> tuple[Dishes, list]:
        d = Dishes(frequent.pair_dish, frequent.pair_ctx, frequent.pair_c, given.reshape(SAMPLES, n_frequent))
        return d, list(d.samples(context_c, v.n_tokens, v.n_words, 1, False, int(v.counts.sum())))

    def tell(t: pa.Table) -> pa.Table:
        b, src = Contexts(t, v), t["bucket"][0].as_py()
        tables = np.array([c for _, c, _ in b.samples()])
        rows = [(-1, src, b"", tables[:, :n_frequent].astype(np.int64).tobytes())]
        told = np.concatenate((tables, [b.count]))[:, n_frequent:]
        cut = _cut(_bucket(b.keys, buckets), buckets)
        rows += [(int(to), src, b.keys[cut[to] : cut[to + 1]].tobytes(), _pack(told[:, cut[to] : cut[to + 1]])) for to in np.flatnonzero(np.diff(cut))]
        return pa.Table.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "src", "keys", "body"])

    def reply(key: tuple, t: pa.Table, told: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:  # what was told of the frequent words
            given = np.sum([np.frombuffer(x, np.int64) for x in told["body"].to_pylist()], 0)
            d, samples = frequent_samples(given)
            rows = [(-2, -2, b"", given.tobytes()), (-1, -1, b"", totals(d, samples, width).tobytes())]
        else:
            b = ByWord(t, told, v)
            samples = list(b.samples())
            rows = [(-1, -1, b"", totals(b.dishes, samples, width).tobytes()), (key[0].as_py(), -3, b.words.tobytes(), _pack(b.told))]
            root = np.array([*(c for _, c, _ in samples), *(r for _, _, r in samples), b.count])
            rows += [(src, key[0].as_py(), b"", _pack(root[:, at])) for src, at in zip(b.src, b.at, strict=True)]
        return pa.Table.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "src", "keys", "body"])

    def add_up(t: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x, np.int64) for x in t["body"].to_pylist()], 0)
        return pa.table([t["src"][:1], t["keys"][:1], pa.array([total.tobytes()], pa.binary())], names=["src", "keys", "body"])

    def score(t: pa.Table, got: pa.Table) -> pa.Table:
        if not t.num_rows:
            none = np.zeros(0, np.int64)
            return pa.Table.from_batches([_sum_rows(none, None, none, none, none)])
        told = got.filter(pa.compute.equal(got["src"], -3))
        got = got.sort_by("src")
        src, body = got["src"].to_pylist(), got["body"].to_pylist()
        sums = np.frombuffer(body[src.index(-1)], np.int64).reshape(SAMPLES, -1)
        d, samples = frequent_samples(np.frombuffer(body[src.index(-2)], np.int64))
        root = _unpack([x for s, x in zip(src, body, strict=True) if s >= 0], 2 * SAMPLES + 1)
        out = []

        def add(k: Tokens, count: np.ndarray, logs: np.ndarray, ids: pa.Array | None = None) -> None:
            out.append(_sum_rows(k.mark, ids, k.of, count, logs if v.n_tokens else np.zeros(len(logs))))

        k = Tokens(t, FREQUENT)
        p = predictions(d, samples, sums, context_c, v.n_words) if n_frequent else ()
        logs = [token_logs(k.near[i : i + SCORED] - 1, k.ctx[i : i + SCORED], d, *p) for i in range(0, len(k.near), SCORED)]
        add(k, v.counts[k.near - 1], np.concatenate([np.zeros(0), *logs]), k.ids)
        del k, p, logs  # before the next kind's tokens take memory
        b = ByWord(t, told, v)
        p = predictions(b.dishes, b.samples(), sums, context_c, v.n_words)[0]
        add(b.tokens, b.count[b.dish], np.log10(p[b.pair]))
        del b, p
        b = Contexts(t, v)
        count, p, u = np.concatenate((v.counts, root[-1])), 0, b.dishes.pair_ctx
        for i, (tables, _, _) in enumerate(b.samples()):
            c, r = np.concatenate((samples[i][1], root[i])), np.concatenate((samples[i][2], root[SAMPLES + i]))
            parent = root_probability(c, r, sums[i, -2], sums[i, -1], v.n_words)
            back = STRENGTH + DISCOUNT * np.bincount(u, tables, len(b.customers))
            p = p + (b.dishes.pair_c - DISCOUNT * tables + back[u] * parent[b.dishes.pair_dish]) / (STRENGTH + b.customers[u])
        add(b.tokens, count[b.word], np.log10(p / SAMPLES)[b.pair])
        return pa.Table.from_batches(out)

    told = stream.groupBy("bucket").applyInArrow(tell, "bucket int, src int, keys binary, body binary")
    replies = stream.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(reply, "bucket int, src int, keys binary, body binary")
    all_sums = replies.where("bucket < 0").groupBy("bucket").applyInArrow(add_up, "src int, keys binary, body binary")  # two rows of SAMPLES * (CONTEXTS + 3) counts at most
    to_all = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).crossJoin(F.broadcast(all_sums))
    answers = replies.where("bucket >= 0").union(to_all)
    parts = stream.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(score, SUMS)
    names = ["rows", "n_tokens", "n_known", "base", "score"]
    out = parts.groupBy("mark").agg(F.max("doc_id").alias("doc_id"), *(F.sum(c).alias(c) for c in names))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows"))))  # one, but for repeated rows
    n = (F.col("n_tokens") / F.col("rows")).cast("long")
    return out.select(
        "doc_id",
        n.alias("n_tokens"),
        (F.col("n_known") / F.col("rows")).cast("long").alias("n_known"),
        F.lit(v.n_tokens).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("rows") - n * float(np.log10(v.n_tokens + v.n_words + 1))).alias("base_score"),
        (F.col("score") / F.col("rows")).alias("score"),
    )
