import hashlib
import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from career_lake.llm.substrings import Edges, repeated_paths, without_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, k):
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    seen = Counter(tuple(w[a : a + k]) for _, w in words for a in range(len(w) - k + 1))
    out = []
    for i, w in words:
        gone = set()
        for a in range(len(w) - k + 1):
            if seen[tuple(w[a : a + k])] > 1:
                gone.update(range(a, a + k))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"wö{i}" for i in range(200)] + ["a", "b"]
    make = lambda n: [r.choice(vocab) for _ in range(n)]
    passages = [make(r.choice([20, 34, 35, 36, 50, 90])) for _ in range(8)]
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "De " * 34), (4, "De " * 36), (5, "x y " * 40), (6, " ".join(make(35))), (6, " ".join(make(60)))]
    for i in range(10, 90):
        parts = []
        for _ in range(r.choice([1, 2, 3, 5])):
            parts += make(r.choice([0, 3, 40, 100])) + (r.choice(passages) if r.random() < 0.5 else [])
        rows.append((i, r.choice([" ", "\n", "  ", "\x0b"]).join(parts) + r.choice(["", " ", "\n"])))
    rows += [(200, rows[20][1]), (201, rows[20][1]), (7, "tail word\x1fnot cut ")]
    return rows


@pytest.mark.parametrize(("seed", "k"), [(1, 35), (2, 35), (3, 12)])
def test_removal_equals_brute_force(spark, seed, k):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, i, "z") for i, t in rows], "doc_id long, text string, chunk long, rest string")
    out = without_repeats(docs, k).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out) == brute(rows, k)
    assert all(r.rest.chunk == r.doc_id and r.rest.rest == "z" for r in out)
    same = {(i, t) for i, t in rows}
    assert all(r.n_removed or (r.doc_id, r.text) in same for r in out)


def test_paths_cover_what_is_removed_and_repeat(spark):
    rows = corpus(4)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    paths = repeated_paths(docs).collect()
    ids = Counter(p.path_id for p in paths)
    assert paths and all(n > 1 for n in ids.values())
    words = {i: WORD.findall(t or "") for i, t in rows if i != 6}
    texts = {}
    for p in paths:
        if p.doc_id != 6:
            assert texts.setdefault(p.path_id, words[p.doc_id][p.start : p.start + p.n_words]) == words[p.doc_id][p.start : p.start + p.n_words]


def test_empty_table(spark):
    assert without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("window", [5, 16, 17, 35])
def test_edges_of_one_document_of_every_length(window):
    for n in range(61):
        for texts in ([" ".join(f"w{i}" for i in range(n))], ["w"] * n):  # one text, or texts that add up to the length
            e = Edges(pa.table([list(range(len(texts))), pa.array(texts, pa.string())], names=["doc_id", "text"]), window)
            assert len(e.seed) == len(e.hash) == sum(max(len(WORD.findall(t)) - window + 1, 0) for t in texts)


@pytest.mark.parametrize("n", [20, 21, 27, 33, 35])
def test_table_of_one_short_document(spark, n):
    rows = [(1, " ".join(f"w{i}" for i in range(n)))]
    out = without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out) == brute(rows, 35)
