"""Word splitting and hashing on whole Arrow text columns, as numpy array work.

A word is ``[^\\x20\\x09-\\x0D]+``. All delimiters are ASCII, so words are found
on the UTF-8 bytes. Hashes are 64-bit multilinear sums with fixed random
tables; equal words have equal hashes on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

DELIM = np.zeros(256, bool)
DELIM[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_RNG = np.random.default_rng(20240229)
BYTE_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))
_powers: dict[int, np.ndarray] = {}


def powers(base: int | np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    key = int(base)
    if key not in _powers or len(_powers[key]) < n:
        steps = np.full(max(n, 1024), key, np.uint64)
        steps[0] = 1
        _powers[key] = np.cumprod(steps, dtype=np.uint64)
    return _powers[key][:n]


def inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 2**64))


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a hash, so that all bits depend on all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and each row's offsets; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    if not wide and not pa.types.is_string(col.type):
        col = col.cast(pa.string())
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def row_slices(off: np.ndarray, limit: int = 1 << 21, rows: int = 60_000) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes (one row at least) and `rows` rows, so that temporary arrays stay small."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = min(lo + rows, max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1))
        yield lo, min(hi, n)
        lo = min(hi, n)


class Words:
    """The words of some rows: word i is buf[starts[i]:ends[i]]; row r has words first[r]..first[r+1]-1."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, lower: bool = False) -> None:
        self.buf = LOWER[buf] if lower else buf
        self.off = off
        inside = ~DELIM[buf]
        fresh = np.zeros(len(buf) + 1, bool)
        fresh[off] = True
        fresh[-1:] = True
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1] | fresh[1:-1]
        end[:-1] &= ~inside[1:] | fresh[1:-1]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, off)
        self.inside = inside

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self):
            return np.zeros(0, np.uint64)
        lens = self.ends - self.starts
        cum = np.concatenate(([0], np.cumsum(lens)))
        at = np.arange(cum[-1]) - np.repeat(cum[:-1], lens)
        value = BYTE_VALUE[self.buf[self.inside]] * powers(STEP[0], int(lens.max()))[at]
        return mix(np.add.reduceat(value, cum[:-1]) + lens.astype(np.uint64))

    def texts(self, row: int) -> list[bytes]:
        raw = self.buf.tobytes() if self.buf.base is None else bytes(self.buf)
        return [raw[a:b] for a, b in zip(self.starts[self.first[row] : self.first[row + 1]], self.ends[self.first[row] : self.first[row + 1]], strict=True)]


class Rolling:
    """Hashes of word windows, by prefix sums of word hashes."""

    def __init__(self, h: np.ndarray, seed: int = 0) -> None:
        base = STEP[seed]
        n = len(h)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(h * powers(base, n), out=self.prefix[1:])
        self.back = powers(inverse(base), n + 1)

    def window(self, k: int) -> np.ndarray:
        """Hash of words i..i+k-1 for every i that has so many after it in the array."""
        n = len(self.prefix) - 1 - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.prefix[k : k + n] - self.prefix[:n]) * self.back[:n] + np.uint64(k))

    def spans(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        return mix((self.prefix[start + length] - self.prefix[start]) * self.back[start] + length.astype(np.uint64))


def batches(rb: pa.RecordBatch, column: str | int, limit: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of a record batch with their bytes and offsets."""
    buf, off = column_bytes(rb.column(column))
    for lo, hi in row_slices(off, limit):
        yield lo, hi, buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
