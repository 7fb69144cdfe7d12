import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from career_lake.llm import registry, spelling


def brute_counts(docs, every=None):
    total = Counter()
    for i, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if every and h % every == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            if len(w) >= 5:
                total[w] += 1
    return total


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_groups(n):
    near = defaultdict(list)
    for a in n:
        for b in n:
            if one_edit(a, b):
                near[a].append(b)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= 2 * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out, key=repr)


def variants(r, base, n):
    out = {}
    for _ in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 1, 1, 2, 3])):
            k = r.randrange(len(w))
            r.choice([lambda: w.pop(k), lambda: w.insert(k, r.choice("abcé")), lambda: w.__setitem__(k, r.choice("abcÿ"))])() if len(w) > 5 else None
        out["".join(w)] = r.choice([3, 5, 9, 20, 90, 400])
    return out


@pytest.mark.parametrize("most,last,letters", [(1 << 20, 64, 1 << 15), (3, 64, 40), (1, 6, 1)])
def test_groups_equal_brute_force(spark, monkeypatch, most, last, letters):
    """Also with filters of a few blocks, that is in many rounds and slices, and with shared shards."""
    r = random.Random(7)
    monkeypatch.setattr(spelling, "MOST_BLOCKS", most)
    monkeypatch.setattr(spelling, "LETTERS", letters)
    monkeypatch.setattr(spelling, "LAST", last)
    n = variants(r, ["abcabc", "aabbcc", "abcdefgh", "ééabcé", "aaaaaaa", "zyxwvutsrq"], 600)
    rows = [(w, k, "x") for w, k in n.items()] + [(None, 5, "x"), ("", 9, "x")]
    got = spelling.spelling_groups(spark.createDataFrame(rows, "word string, n long, root string"))
    assert sorted((tuple(x) for x in got.collect()), key=repr) == brute_groups(n)
    assert any(x[2] != x[1] and x[1] for x in brute_groups(n))


def test_filters_never_lose_a_word(spark):
    r = random.Random(1)
    words = {"".join(r.choice("abcdefgh") for _ in range(r.randrange(5, 90))) for _ in range(4000)}
    vocabulary = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    filters = spelling.planned(Counter(min(len(w), spelling.LAST) for w in words))
    bits = spelling.filled(vocabulary, filters[0])
    w = spelling.Words(sorted(words))
    assert len(filters) == 1 and len(spelling._known(bits, filters[0], w.hashes(), w.size)) == len(words)
    other = spelling.Words(["".join(r.choice("abcdefgh") for _ in range(12)) for _ in range(20_000)])
    assert len(spelling._known(bits, filters[0], other.hashes(), other.size)) < 200


def test_query_equals_brute_force(spark, tmp_path):
    r = random.Random(2)
    words = ["Straße", "maison", "Éleverai", "planning", "planing", "plannings", "naïves", "colour", "color", "abcd", "ÄÖÜäöü"]
    docs = [(i, " ".join(r.choice(words) for _ in range(60)) + r.choice([", ", " ", "1"])) for i in range(150)]
    docs += [(None, "planning colour " * 5), (7, None), (8, ""), docs[0], (10**12, ("k" * 40_000 + " ") * 3 + "k" * 39_999)]
    spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, word string").write.parquet(str(tmp_path / "documents.parquet"))
    n = {w: k for w, k in brute_counts(docs, 97).items() if k >= 3}
    got = [tuple(x) for x in registry.op13_spelling_variants(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == brute_groups(n) and max(len(w) for w in n) == 40_000
    assert dict(spelling.word_counts(spark.createDataFrame(docs, "doc_id long, text string")).collect()) == brute_counts(docs)


def test_counts_are_sent_in_parts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "REMEMBER", 3)
    docs = [(i, f"alpha{'abc'[i % 3] * 5} bravo charlie") for i in range(30)]
    assert dict(spelling.word_counts(spark.createDataFrame(docs, "doc_id long, text string")).collect()) == brute_counts(docs)


def test_empty_and_no_neighbours(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "e/documents.parquet"))
    assert registry.op13_spelling_variants(spark, str(tmp_path / "e")).count() == 0
    spark.createDataFrame([(1, "single " * 3)], "doc_id long, text string").write.parquet(str(tmp_path / "o/documents.parquet"))
    assert [tuple(x) for x in registry.op13_spelling_variants(spark, str(tmp_path / "o")).collect()] == [("single", None, "single", 3, 0, None)]
