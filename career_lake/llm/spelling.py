"""Spelling variants by Bloom-guided neighbourhoods (operator 13).

Two words are near if one inserted, deleted or replaced code point makes one
the other. The edits of every word are probed against Bloom filters of the
vocabulary; only edits that a filter knows are made into strings and shuffled to
an exact join with the vocabulary, which removes the false positives. Of each
pair one direction is probed: the deletion from the longer word (at the first of equal
neighbouring letters), and the replacement by the greater letter, so that a pair is found
once; the join's pairs are then turned both ways.

Edits are not built to be probed. A word's hash is a sum over its letters, so that
an edit's hash follows from the word's in a few numpy operations.

Filters are blocked (all bits of a word lie in one block of 512) and sharded by length.
They are broadcast in rounds of at most MOST_BLOCKS blocks: a round holds shards, or
slices by hash of a shard that is too long, and probes what belongs to them; so their
size never grows with the vocabulary. Ranges of blocks are filled in tasks.

A word's form is its commonest near word if that is `share` times as common as the word.
As forms grow, following them ends after a logarithm of the largest count;
roots are found by joins that double the steps.

Words: null texts have none, null ids read as an empty id. Vocabulary rows of null
or empty words take no part; repeated words are added up. An empty table gives an
empty result. Ties go to the smaller word by code points. Very long words cost as many
probes as they have letters, times the letters of the vocabulary. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from career_lake.llm.text import LOWER, STEP, column_bytes, inverse, mix, powers
from career_lake.session import discard, settle

#: Maximal runs of so many letters at least, in texts whose A-Z are lower-cased.
SHORTEST, LEAST = 5, 3
RUN = re.compile(f"[a-zÀ-ÿ]{{{SHORTEST},}}")
#: Words counted in a task before it sends them.
REMEMBER = 250_000
#: Filters: bits a word, bits set of them, blocks broadcast at once (64 bytes each), blocks of a range, and the last length with a shard of its own.
BITS, SET, MOST_BLOCKS, RANGE, LAST = 24, 6, 1 << 20, 256, 64
#: Letters whose edits are probed together.
LETTERS = 1 << 15


def word_counts(docs: DataFrame, text: str = "text", key: str = "doc_id", drop_every: int | None = None) -> DataFrame:
    """(word, n) of the words of at least SHORTEST letters, over all texts.

    drop_every: of the runs whose crc32 of `<id>:<run>` it divides, the letter at
    that crc32 modulo the length is left out (planted misspellings).
    """

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

        total: Counter[str] = Counter()
        crc = zlib.crc32
        for rb in it:
            buf, off = column_bytes(rb.column(1))
            low = LOWER[buf].tobytes()
            for i, doc in enumerate(rb.column(0).to_pylist()):
                runs = Counter(RUN.findall(low[off[i] : off[i + 1]].decode()))
                if drop_every is None:
                    total.update(runs)
                else:
                    of = crc(f"{'' if doc is None else doc}:".encode())
                    for w, n in runs.items():
                        h = crc(w.encode(), of)
                        if h % drop_every == 0:
                            at = h % len(w)
                            w = w[:at] + w[at + 1 :]
                            if len(w) < SHORTEST:
                                continue
                        total[w] += n
                if len(total) >= REMEMBER:
                    yield told()
                    total.clear()
        yield told()

    docs = docs.select(docs[key].cast("long").alias("id"), docs[text].cast("string").alias("text"))
    return docs.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def letter_values(letters: np.ndarray) -> np.ndarray:
    """A 64-bit value of each code point."""
    return mix((letters.astype(np.uint64) + np.uint64(1)) * STEP[1])


class Words:
    """The letters of some words in one array, and the hashes of their edits."""

    def __init__(self, words: list[str]) -> None:
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.first = np.concatenate(([0], np.cumsum(self.size)))
        self.word = np.repeat(np.arange(len(words)), self.size)
        self.place = np.arange(len(self.letters)) - self.first[self.word]
        self.power = powers(STEP[0], int(self.size.max(initial=0)) + 1)[self.place]
        self.value = letter_values(self.letters)
        self.cum = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.value * self.power, dtype=np.uint64)))
        self.total = self.cum[self.first[1:]] - self.cum[self.first[:-1]]

    @staticmethod
    def _done(total: np.ndarray, size: np.ndarray) -> np.ndarray:
        return mix(total + size.astype(np.uint64) * STEP[1])

    def hashes(self) -> np.ndarray:
        return self._done(self.total, self.size)

    def deletions(self) -> tuple[np.ndarray, np.ndarray]:
        """(place in letters, hash of the word without it), at the first of equal neighbours."""
        equal = np.zeros(len(self.letters), bool)
        equal[1:] = (self.letters[1:] == self.letters[:-1]) & (self.word[1:] == self.word[:-1])
        at = np.flatnonzero(~equal)
        w = self.word[at]
        left, right = self.cum[at] - self.cum[self.first[w]], self.cum[self.first[w + 1]] - self.cum[at + 1]
        return at, self._done(left + right * inverse(STEP[0]), self.size[w] - 1)

    def replacements(self, letter: int, value: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        """(place in letters, hash of the word with `letter` there), where the letter is a smaller one."""
        at = np.flatnonzero(self.letters < letter)
        w = self.word[at]
        return at, self._done(self.total[w] + (value - self.value[at]) * self.power[at], self.size[w])


@dataclass(frozen=True)
class Filters:
    """Where a round's filters lie: shard s is cut into slices[s] units from first[s] on; unit u has blocks[u] blocks from base[u] on, or is not in this round (base -1)."""

    slices: np.ndarray
    first: np.ndarray
    blocks: np.ndarray
    base: np.ndarray

    def place(self, h: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The block of each hash of a word of so many letters; -1 if it is in no filter of this round."""
        shard = np.minimum(size, len(self.slices) - 1)
        unit = self.first[shard] + (h & np.uint64(0xFFFF)).astype(np.int64) % self.slices[shard]
        base = self.base[unit]
        return np.where(base >= 0, base + (((h >> np.uint64(32)) * self.blocks[unit]) >> np.uint64(32)).astype(np.int64), -1)

    def shards(self) -> list[int]:
        """The lengths whose words are in this round."""
        return [s for s in range(len(self.slices)) if (self.base[self.first[s] : self.first[s] + self.slices[s]] >= 0).any()]


def planned(words: dict[int, int]) -> list[Filters]:
    """The rounds for so many words of each shard."""
    slices, first, blocks = np.ones(LAST + 1, np.int64), np.zeros(LAST + 1, np.int64), []
    for s in range(LAST + 1):
        need = -(-words.get(s, 0) * BITS // 512)
        slices[s] = max(1, -(-need // MOST_BLOCKS))
        first[s] = len(blocks)
        blocks += [-(-need // int(slices[s]))] * int(slices[s])
    rounds, base, at = [], np.full(len(blocks), -1, np.int64), 0
    for u, n in enumerate(blocks):
        if n and at + n > MOST_BLOCKS and at:
            rounds.append(base)
            base, at = np.full(len(blocks), -1, np.int64), 0
        if n:
            base[u], at = at, at + n
    if at:
        rounds.append(base)
    return [Filters(slices, first, np.array(blocks, np.uint64), b) for b in rounds]


def _bit(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th bit (0 to 511) of a word in its block."""
    return ((mix(h ^ STEP[1]) >> np.uint64(9 * k)) & np.uint64(511)).astype(np.int64)


def filled(vocabulary: DataFrame, filters: Filters) -> np.ndarray:
    """The round's filters as 64-bit words; tasks fill ranges of blocks."""

    def hashes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            w = Words(rb.column(0).to_pylist())
            h = w.hashes()
            at = filters.place(h, w.size)
            some = np.flatnonzero(at >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(at[some] // RANGE), pa.array(at[some] % RANGE, pa.int32()), pa.array(h[some].view(np.int64))], names=["range", "block", "h"])

    def fill(t: pa.Table) -> pa.Table:
        bits = np.zeros(RANGE * 8, np.uint64)
        block, h = t["block"].to_numpy().astype(np.int64), t["h"].to_numpy().view(np.uint64)
        for k in range(SET):
            b = _bit(h, k)
            np.bitwise_or.at(bits, block * 8 + (b >> 6), np.uint64(1) << (b & 63).astype(np.uint64))
        return pa.table({"range": t["range"][:1], "bits": pa.array([bits.tobytes()], pa.binary())})

    told = vocabulary.where(F.least(F.length("word"), F.lit(LAST)).isin(filters.shards())).select("word")
    parts = told.mapInArrow(hashes, "range long, block int, h long").groupBy("range").applyInArrow(fill, "range long, bits binary").collect()  # at most MOST_BLOCKS blocks
    out = np.zeros((max(r["range"] for r in parts) + 1) * RANGE * 8, np.uint64)
    for r in parts:
        out[r["range"] * RANGE * 8 : (r["range"] + 1) * RANGE * 8] = np.frombuffer(r["bits"], np.uint64)
    return out


def _known(bits: np.ndarray, filters: Filters, h: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which of the hashes a filter knows, as indexes."""
    block = filters.place(h, size)
    left = np.flatnonzero(block >= 0)
    for k in range(SET):
        b = _bit(h[left], k)
        left = left[(bits[block[left] * 8 + (b >> 6)] >> (b & 63).astype(np.uint64)) & np.uint64(1) == 1]
        if not len(left):
            break
    return left


def probed(vocabulary: DataFrame, filters: Filters, bits: np.ndarray, alphabet: np.ndarray) -> DataFrame:
    """(near, word, n): the edits of the vocabulary's words that the round's filters know."""
    shared = vocabulary.sparkSession.sparkContext.broadcast(bits)
    values = letter_values(alphabet)

    def edits(words: list[str]) -> Iterator[tuple[int, str]]:
        w, bits = Words(words), shared.value
        at, h = w.deletions()
        for i in at[_known(bits, filters, h, w.size[w.word[at]] - 1)]:
            k, p = int(w.word[i]), int(w.place[i])
            yield k, words[k][:p] + words[k][p + 1 :]
        for letter, value in zip(alphabet, values, strict=True):
            at, h = w.replacements(letter, value)
            for i in at[_known(bits, filters, h, w.size[w.word[at]])]:
                k, p = int(w.word[i]), int(w.place[i])
                yield k, words[k][:p] + chr(letter) + words[k][p + 1 :]

    def probe(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            words, counts = rb.column(0).to_pylist(), rb.column(1).to_pylist()
            lo = 0
            while lo < len(words):
                hi, letters = lo + 1, len(words[lo])
                while hi < len(words) and letters + len(words[hi]) <= LETTERS:
                    letters += len(words[hi])
                    hi += 1
                found = list(edits(words[lo:hi]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([e for _, e in found], pa.string()), pa.array([words[lo + k] for k, _ in found], pa.string()), pa.array([counts[lo + k] for k, _ in found], pa.int64())],
                    names=["near", "word", "n"],
                )
                lo = hi

    lengths = {x for s in filters.shards() for x in (s, s + 1)}
    own = F.length("word").isin(*lengths) | (F.length("word") >= LAST if LAST in lengths else F.lit(False))
    return vocabulary.where(own).select("word", "n").mapInArrow(probe, "near string, word string, n long")


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """(word, n, near, near_n), both ways, of all near words of vocabulary (word, n; each word once)."""

    def told(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            words = rb.column(0).to_pylist()
            sizes, letters = Counter(min(len(w), LAST) for w in words), sorted(set("".join(words)))
            yield pa.RecordBatch.from_arrays([pa.array([None] * len(sizes) + letters, pa.string()), pa.array([*sizes.keys(), *([None] * len(letters))], pa.int32()), pa.array([*sizes.values(), *([0] * len(letters))], pa.int64())], names=["letter", "shard", "n"])

    rows = vocabulary.select("word").mapInArrow(told, "letter string, shard int, n long").groupBy("letter", "shard").agg(F.sum("n").alias("n")).collect()  # one a letter or shard
    alphabet = np.array(sorted(ord(r["letter"]) for r in rows if r["letter"] is not None), np.uint32)
    pairs = None
    for filters in planned({r["shard"]: r["n"] for r in rows if r["letter"] is None}):
        some = probed(vocabulary, filters, filled(vocabulary, filters), alphabet)
        pairs = some if pairs is None else pairs.union(some)
    if pairs is None:
        return vocabulary.select("word", "n", F.col("word").alias("near"), F.col("n").alias("near_n"))
    exact = vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    found = pairs.join(exact, "near").select(F.explode(F.array(F.struct("word", "n", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))).alias("p"))
    return found.select("p.*")


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of links (word, form; no cycles): the last form that is reached."""
    now = settle(links.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "spelling-links")
    while not now.where("moved").isEmpty():
        on = now.select(F.col("word").alias("at"), F.col("root").alias("further"))
        before, now = now, settle(now.join(on, now["root"] == on["at"], "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        discard(before)
    return now.select("word", "root")


def spelling_groups(vocabulary: DataFrame, share: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of vocabulary (word, n)."""
    words = settle(vocabulary.where("word is not null and word <> ''").groupBy("word").agg(F.sum("n").alias("n")), "spelling-words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    near = near.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))
    is_form = F.col("near_n") >= F.col("n") * share
    forms = words.join(near, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(is_form, F.col("near")).alias("form"),
        F.when(is_form, F.col("near_n")).alias("form_n"),
    )
    forms = settle(forms, "spelling-forms")
    last = roots(forms.where("form is not null"))
    return forms.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
