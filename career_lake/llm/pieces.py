"""SentencePiece encoding and decoding by streaming Viterbi (operator 8).

A text's ids are those of the segmentation into pieces of the model with the
highest sum of scores (ties: the longest last piece). A text is read forward
by an automaton over the beginnings of pieces (Aho-Corasick): a character is
one step, its state names the pieces that end there, and its depth how far back
a piece can begin that is not complete. Only the boundaries of that window are
open, at most `longest`. When the backpointer paths of all of them meet in one
boundary, everything before it is settled: its ids are committed and forgotten.

A boundary between two characters that are neighbours in no piece of the model
is such a meeting point for any text; texts are cut there into runs, at spaces
and other marks, and the runs all go through the stream. The ids that it gave
for runs of up to REMEMBERED characters are remembered in each Python worker in
two tables of bounded size: when one is full it becomes the older one, and runs
that are asked for again move on.

As the model has it, a space is written U+2581 and one is put before the text.
Characters without a piece, and U+2581 itself, become the byte pieces of their
UTF-8 bytes, so decoding gives back every text exactly. The file is a BPE model
whose scores are merge ranks: ids are the best by score and may differ from
those of the library's merges (of 120 documents of the smallest test tables
none has all of its ids; there are 14 % more pieces).

Null texts have null ids and decode to null; empty texts have none. Repeated
rows are encoded each. An empty table gives an empty result. Extra columns are
ignored.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Entries of the two tables of remembered runs (and of remembered steps), and the longest run in them.
REMEMBER, REMEMBERED = 400_000, 48
#: Letters and digits that may count as marks; with more, only spaces cut.
MARKS = 64
#: How much worse than the worst piece a character without a piece is.
UNKNOWN = 10.0


class Model:
    def __init__(self, path: str) -> None:
        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        self.piece = [m.id_to_piece(i) for i in range(n)]
        self.byte = {int(self.piece[i][1:-1], 16): i for i in range(n) if m.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.silent = {i for i in range(n) if m.is_control(i) or m.is_unknown(i)}
        self.vocab = {self.piece[i]: (m.get_score(i), i) for i in range(n) if i not in self.silent and i not in self.byte_of and not m.is_unused(i)}
        self.longest = max(map(len, self.vocab))
        self.unknown = min(s for s, _ in self.vocab.values()) - UNKNOWN
        self.cut = re.compile(_runs_pattern(self.vocab))
        #: A state: steps by character, the state of the longest ending that is a state, (length, score) of the pieces that end here from the longest on (the last: of one character, or none), depth.
        self.root: tuple = ({}, None, ((1, self.unknown),), 0)
        made = {"": self.root}
        for p in sorted({p[:k] for p in self.vocab for k in range(1, len(p) + 1)}, key=len):
            before, ch = made[p[:-1]], p[-1]
            end = self.root if before is self.root else self._step(before[1], ch)
            mine = ((len(p), self.vocab[p][0]),) if p in self.vocab else ()
            made[p] = before[0][ch] = ({}, end, mine if mine and len(p) == 1 else mine + end[2], len(p))
        self.room = REMEMBER
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.said = [b"" if i in self.silent else bytes([self.byte_of[i]]) if i in self.byte_of else self.piece[i].replace(SPACE, " ").encode() for i in range(n)]

    def _step(self, state: tuple, ch: str) -> tuple:
        while (to := state[0].get(ch)) is None:
            if state is self.root:
                return state
            state = state[1]
        return to

    def stream(self, run: str) -> Iterator[list[int]]:
        """Ids of a run of characters, in the parts in which they are settled.

        Open are the boundaries at which a piece can begin that ends behind
        `at`, and `at` itself. From `longest` boundaries after the last commit
        on, it is looked whether their backpointers meet; what lies before that
        is committed. While they don't, looks become rarer as the window grows,
        so that they cost no more than reading.
        """
        state, low, due = self.root, 0, self.longest
        score, back = [0.0], [0]  # from boundary low on; back is the length of the last piece
        for at, ch in enumerate(run, 1):
            to = state[0].get(ch)
            if to is None:
                to = self._step(state, ch)
                if self.room:
                    self.room -= 1
                    state[0][ch] = to
            state = to
            best, length = -1e300, 1
            for k, worth in state[2]:
                worth += score[-k]
                if worth > best:
                    best, length = worth, k
            score.append(best)
            back.append(length)
            if at >= due:
                live = set(range(at - state[3], at + 1))
                while len(live) > 1:
                    last = max(live)
                    live.discard(last)
                    live.add(last - back[last - low])
                meet = live.pop()
                if meet > low:
                    yield self._ids(run, back, low, meet)
                    del score[: meet - low], back[: meet - low]
                    low = meet
                due = max(low + self.longest, at + max(1, (at - low) // self.longest))
        if len(run) > low:
            yield self._ids(run, back, low, len(run))

    def _ids(self, run: str, back: list[int], low: int, high: int) -> list[int]:
        """Ids between two boundaries on the best path; back begins at boundary low."""
        out, first = [], low
        while high > low:
            start = high - back[high - first]
            found = self.vocab.get(run[start:high])
            if found is not None:
                out.append(found[1])
            else:
                out.extend(self.byte[b] for b in reversed(run[start:high].encode()))
            high = start
        return out[::-1]

    def packed(self, text: str) -> bytes:
        """The ids of a text as little-endian int32."""
        if not text:
            return b""
        if SPACE in text:  # it stays what it is, as bytes
            parts = re.split(f"([{SPACE}])", text)
            out = [self.packed(parts[0]) if parts[0] else _pack([self.vocab[SPACE][1]])]
            for i in range(1, len(parts), 2):
                out += [_pack([self.byte[b] for b in parts[i].encode()]), self._runs(parts[i + 1])]
            return b"".join(out)
        return self._runs(" " + text)

    def _runs(self, text: str) -> bytes:
        runs = self.cut.findall(text.replace(" ", SPACE))
        out = list(map(self.known.get, runs))
        if None in out:
            out = [self._told(run) if ids is None else ids for run, ids in zip(runs, out, strict=True)]
        return b"".join(out)

    def _told(self, run: str) -> bytes:
        ids = self.known.get(run)
        if ids is not None:
            return ids
        ids = self.older.get(run)
        if ids is None:
            ids = b"".join(map(_pack, self.stream(run)))
        if len(run) <= REMEMBERED:
            if len(self.known) >= REMEMBER // 2:
                self.known, self.older = {}, self.known
            self.known[run] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<i4").tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.said.__getitem__, ids)).decode(errors="replace").removeprefix(" ")


def _runs_pattern(pieces: Iterable[str]) -> str:
    """Runs of a text: spaces, then letters and digits or else marks, where pieces hold to that.

    Letters and digits that are next to a mark in a piece count as marks.
    """
    inside = {(a, b) for p in pieces for a, b in zip(p, p[1:])}
    if any(b == SPACE != a for a, b in inside):
        return "(?s:.+)"
    near = {(a, b) for a, b in inside if a != SPACE}
    marks: set[str] = set()
    letter = lambda c: c.isalnum() and c not in marks
    while odd := {a if letter(a) else b for a, b in near if letter(a) != letter(b)}:
        marks |= odd
    if len(marks) > MARKS:
        return f"{SPACE}*[^{SPACE}]+|{SPACE}+"
    marks_ = re.escape("".join(sorted(marks)))
    return f"{SPACE}*(?:[^\\W_{marks_}]+|(?:(?!{SPACE})[\\W_{marks_}])+)|{SPACE}+"


def _pack(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


_models: dict[str, Model] = {}


def model(path: str) -> Model:
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def piece_ids(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, ids, n_ids, round_trip of each row; path: the model file, on every worker."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for rb in it:
            for lo in range(0, rb.num_rows, 512):
                some = rb.slice(lo, 512)
                texts = some.column(1).to_pylist()
                packed = [b"" if x is None else m.packed(x) for x in texts]
                same = [x is None or m.decode(np.frombuffer(p, "<i4").tolist()) == x for x, p in zip(texts, packed, strict=True)]
                n = np.array([len(p) // 4 for p in packed], np.int32)
                ends = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                flat = pa.array(np.frombuffer(b"".join(packed), "<i4"))
                ids = pa.ListArray.from_arrays(pa.array(ends), flat, mask=pa.array([x is None for x in texts]))
                yield pa.RecordBatch.from_arrays([some.column(0), ids, pa.array(n), pa.array(same)], names=["doc_id", "ids", "n_ids", "round_trip"])

    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>, n_ids int, round_trip boolean")


def decoded(ids: Column, path: str) -> Column:
    """The text of a column of ids."""

    @F.pandas_udf("string")
    def decode(col):  # noqa: ANN001, ANN202
        return col.map(lambda x: None if x is None else model(path).decode(list(x)))

    return decode(ids)
