"""Token counts by heap-and-linked-list byte-pair merging (operator 6).

The symbols of a pre-token form a linked list; a heap holds each adjacent pair
by (rank, position). The lowest pair is popped and merged until none is left;
the count is the number of first symbols minus the number of merges. No
identifier is made. Counts of pre-tokens are remembered in each Python worker,
in a table of bounded size.

Null text counts as empty (0 tokens). Repeated rows are counted each. An empty
table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Entries of the table of remembered pre-tokens.
REMEMBER = 400_000
#: White space by the Unicode property White_Space.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNK = re.compile(f"[^{SPACE}]+")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


def merged_length(symbols: list[str], rank: dict[tuple[str, str], int]) -> int:
    """How many symbols are left after all merges."""
    n = len(symbols)
    if n == 1:
        return 1
    heap = []
    for i in range(n - 1):
        r = rank.get((symbols[i], symbols[i + 1]))
        if r is not None:
            heap.append((r, i))
    if not heap:
        return n
    heapq.heapify(heap)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    left, size = n, n
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        r, i = pop(heap)
        a = symbols[i]
        j = after[i]
        if a is None or j >= size or rank.get((a, symbols[j])) != r:
            continue
        a += symbols[j]
        symbols[i], symbols[j] = a, None
        left -= 1
        k = after[i] = after[j]
        if k < size:
            before[k] = i
            r = rank.get((a, symbols[k]))
            if r is not None:
                push(heap, (r, i))
        h = before[i]
        if h >= 0:
            r = rank.get((symbols[h], a))
            if r is not None:
                push(heap, (r, h))
    return left


class Counter49k:
    """Counts tokens as the vocabulary file says: NFC, lower case, pre-tokens with a word end."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(spec["model"]["merges"])}
        self.end = spec["model"]["end_of_word_suffix"] or ""
        self.symbol = byte_symbols()
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))))
        self.known: dict[str, int] = {}

    def chunk(self, text: str) -> int:
        """Tokens of a run without white space."""
        total = 0
        for piece in self.pattern.findall(text):
            symbols = [self.symbol[b] for b in piece.encode()]
            symbols[-1] += self.end
            total += merged_length(symbols, self.rank)
        return total

    def plain(self, text: str) -> int:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        total, known = 0, self.known
        for w, n in Counter(CHUNK.findall(text.lower())).items():
            c = known.get(w)
            if c is None:
                c = self.chunk(w)
                if len(known) >= REMEMBER:
                    known.clear()
                if len(w) <= 64:
                    known[w] = c
            total += c * n
        return total

    def count(self, text: str) -> int:
        if "<|" not in text:
            return self.plain(text)
        total, at = 0, 0
        for m in self.special.finditer(text):
            total += self.plain(text[at : m.start()]) + 1
            at = m.end()
        return total + self.plain(text[at:])


_counters: dict[str, Counter49k] = {}


def counter(path: str) -> Counter49k:
    if path not in _counters:
        _counters[path] = Counter49k(path)
    return _counters[path]


def token_counts(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row of docs; path: the vocabulary file, on every worker."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for rb in it:
            texts = [x or "" for x in rb.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [rb.column(0).cast(pa.int64()), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(map(c.count, texts), pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(run, SCHEMA)
