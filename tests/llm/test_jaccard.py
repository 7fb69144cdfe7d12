import random
import re

import pytest

from career_lake.llm import jaccard
from career_lake.llm.jaccard import ngram_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, n, num, den):
    sets = {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[a : a + n]) for a in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i)) for i in ids)


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    rows = [(0, None), (1, ""), (2, " \n "), (3, "One two"), (4, "one TWO"), (5, "x"), (6, "three word text"), (7, "three word text")]
    i = 10
    for _ in range(40):
        base = [r.choice(vocab) for _ in range(r.choice([4, 9, 12, 30, 80, 200, 600]))]
        for _ in range(r.choice([1, 1, 2, 3, 8])):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3, 5, 10])):
                t[r.randrange(len(t))] = r.choice(vocab)
            if r.random() < 0.3:
                t = t[: int(len(t) * r.uniform(0.85, 1))]
            rows.append((i, " ".join(t)))
            i += 1
    base = [r.choice(vocab) for _ in range(120)]
    for _ in range(60):
        t = list(base)
        for _ in range(2):
            t[r.randrange(len(t))] = r.choice(vocab)
        rows.append((i, " ".join(t)))
        i += 1
    return rows


@pytest.mark.parametrize(("seed", "n", "num", "den", "chunk"), [(1, 3, 90, 100, 384), (2, 5, 4, 5, 384), (3, 3, 90, 100, 12), (4, 2, 6, 10, 20), (5, 3, 8, 10, 16)])
def test_components_equal_brute_force(spark, monkeypatch, seed, n, num, den, chunk):
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    monkeypatch.setattr(jaccard, "BLOCK", max(4, chunk // 4))
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string")
    got = sorted(tuple(r) for r in ngram_components(docs, n, num, den).collect())
    assert got == brute(rows, n, num, den)


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (2, "a b c d")], "doc_id long, text string")
    assert sorted(tuple(r) for r in ngram_components(docs, 3, 9, 10).collect()) == [(1, 2, 1), (1, 2, 1), (2, 2, 1)]
    assert ngram_components(docs.limit(0)).count() == 0


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b c d"), (None, "x y z w"), (7, "a b c d"), (7, "q r s t"), (None, None), (8, "q r s t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in ngram_components(docs, 3, 9, 10).collect()), key=str)
    assert got == sorted([(None, 2, 7), (None, 2, None), (7, 2, 7), (7, 2, 7), (None, 0, None), (8, 2, 7)], key=str)


def test_groups_whose_members_are_barely_alike(spark):
    """Copies of one text with many edits: some pairs link, many do not."""
    r = random.Random(11)
    base, rows = [f"w{r.randrange(200)}" for _ in range(150)], []
    for i in range(70):
        t = list(base)
        for _ in range(r.choice([3, 5, 6, 7])):
            t[r.randrange(len(t))] = f"v{r.randrange(40)}"
        rows.append((i, " ".join(t)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(x) for x in ngram_components(docs, 3, 8, 10).collect()) == brute(rows, 3, 8, 10)
