import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from career_lake.llm import packing
from career_lake.llm.packing import Schedule, packed

ARGS = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def check(rows, pieces, window):
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((i, tuple([*lib.encode(t or "", add_special_tokens=False).ids, 1])) for i, t, _ in rows)
    docs, seqs = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(bytes(p.ids), "<u4")
        assert len(ids) == p.length and zlib.crc32(bytes(p.ids)) == p.ids_crc32
        docs[p.doc_id].append((p.start, ids, p.doc_tokens))
        seqs[p.sequence_id].append((p.offset, p.length))
    for i, ids in want:
        got = sorted(docs[i], key=lambda x: x[0])
        assert sum(len(x[1]) for x in got) % len(ids) == 0
        if len(ids) == sum(len(x[1]) for x in got):
            assert np.concatenate([x[1] for x in got]).tolist() == list(ids) and all(x[2] == len(ids) for x in got)
    padding = 0
    for parts in seqs.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    assert padding == 0 and sorted(seqs) == list(range(len(seqs)))


@pytest.mark.parametrize("quantum", [16, 256])
def test_every_id_once_and_no_padding(spark, quantum):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(["the", "ñandú", "x<|endoftext|>y", "12", "\n\n"]) for _ in range(r.choice([0, 5, 900]))), r.choice(["a", "a", "a", "b", None])) for i in range(150)]
    rows += [(1000, None, "c"), (1001, "", "d"), (1002, "z " * 9000, "a"), (3, rows[3][1], rows[3][2])]
    docs = spark.createDataFrame([(*x, "q") for x in rows], "doc_id long, text string, source string, queue string").repartition(5)
    check(rows, packed(docs, *ARGS, quantum=quantum).collect(), 2048)
    assert packed(docs.limit(0), *ARGS).count() == 0


def test_many_sources_and_given_places_by_join(spark, monkeypatch):
    monkeypatch.setattr(packing, "MOST_QUEUES", 3)
    monkeypatch.setattr(packing, "MOST_BROADCAST", 0)
    rows = [(i, "some words here " * (i % 40), f"s{i % 9}") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    check(rows, packed(docs, *ARGS, window=512, quantum=64).collect(), 512)


def test_windows_follow_the_targets():
    totals = np.array([900_000, 90_000, 9_000, 700, 1])
    s = Schedule(totals, totals.astype(float))
    share = np.zeros((s.full + 20, len(totals)))
    for q, n in enumerate(totals):
        _, _, length, seq, _ = s.pieces(q, np.array([0]), np.array([n]))
        np.add.at(share[:, q], seq, length)
    assert share.sum(0).tolist() == totals.tolist() and (share[: s.full].sum(1) == 2048).all()
    owed = np.abs(np.cumsum(share[: s.full], 0) - np.arange(1, s.full + 1)[:, None] * 2048 * totals / totals.sum())
    assert owed.max() <= 2 * 256


def test_other_targets_first_then_the_rest():
    s = Schedule(np.array([4096, 40960]), np.array([0.5, 0.5]))
    _, _, length, seq, _ = s.pieces(0, np.array([0]), np.array([4096]))
    assert seq.max() == 3 and length.sum() == 4096


def test_null_ids_stay_null(spark):
    rows = [(None, "first text", "a"), (None, "second longer text here", "b"), (7, "third", "a")]
    out = packed(spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1), *ARGS).collect()
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, t, q in rows:
        want = [*lib.encode(t, add_special_tokens=False).ids, 1]
        got = sorted((p.start, np.frombuffer(bytes(p.ids), "<u4").tolist()) for p in out if p.doc_id == i and p.doc_tokens == len(want))
        assert [x for _, part in got for x in part] == want
