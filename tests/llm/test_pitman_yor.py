import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

from career_lake.llm import pitman_yor, registry
from career_lake.llm.pitman_yor import Dishes, predictions, sample_tables, totals

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(t):
    return [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]


def brute(rows):
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    out = []
    for i, t in rows:
        w = tokens(t)
        out.append((i, held(i), len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)))
    return out


@pytest.mark.parametrize("contexts", [2048, 20])
def test_query(spark, tmp_path, monkeypatch, contexts):
    monkeypatch.setattr(pitman_yor, "CONTEXTS", contexts)
    r = random.Random(2)
    follows = {f"w{i}": [f"w{r.randrange(60)}" for _ in range(3)] for i in range(60)}
    rows = []
    for i in range(150):
        w = ["W0"]
        for _ in range(r.choice([3, 30, 120])):
            w.append(r.choice(follows[w[-1].lower()]) if r.random() < 0.9 else r.choice(list(follows)))
        rows.append((i, " ".join(w) + (" only%d" % i if i % 5 == 0 else "")))
    rows += [(500, None), (501, ""), (502, "w1 " * 4000), (3, rows[3][1]), (4, "another text")]
    at = str(tmp_path)
    spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, mark string").repartition(4).write.parquet(f"{at}/documents.parquet")
    got = registry.op4_pitman_yor(spark, at).collect()
    key = lambda x: (x[0], x[2], x[5])
    mine = sorted(((x.doc_id, x.held_out, x.n_tokens, x.n_known, x.train_tokens, x.base_score) for x in got), key=key)
    for a, b in zip(mine, sorted(brute(rows), key=key), strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9)
    held = [x for x in got if x.held_out]
    assert sum(x.score for x in held) > (0.9 if contexts > 60 else 1) * sum(x.base_score for x in held)  # fewer contexts tell less
    assert all(x.score < 0 for x in got)
    again = {(x.doc_id, x.n_tokens): x.score for x in registry.op4_pitman_yor(spark, at).collect()}
    assert all(math.isclose(again[x.doc_id, x.n_tokens], x.score, rel_tol=1e-9) for x in got)


def test_empty_table_and_nothing_to_learn(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "a/documents.parquet"))
    assert registry.op4_pitman_yor(spark, str(tmp_path / "a")).count() == 0
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    spark.createDataFrame([(only, "a b")], "doc_id long, text string").write.parquet(str(tmp_path / "b/documents.parquet"))
    r = registry.op4_pitman_yor(spark, str(tmp_path / "b")).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0)


def test_probabilities_add_up_to_one():
    r = np.random.default_rng(1)
    n_ctx, n_dish = 6, 40
    pair = np.unique(r.integers(0, n_dish * n_ctx, 120))
    ctx = pair % n_ctx
    d = Dishes((pair // n_ctx)[ctx > 0], ctx[ctx > 0], r.integers(1, 90, (ctx > 0).sum()), np.append(r.integers(0, 5, n_dish), 0))
    c = np.bincount(d.pair_ctx, d.pair_c, n_ctx)
    n = int(d.pair_c.sum() + d.direct.sum())
    sums = totals(d, d.samples(c, n, n_dish, 3, True), n_ctx)
    pairs, roots, backs = predictions(d, d.samples(c, n, n_dish, 3, True), sums, c, n_dish)
    assert np.allclose(roots.sum(1), 1)
    for u in range(1, n_ctx):
        logs = pitman_yor.token_logs(np.append(np.arange(n_dish), -1), np.full(n_dish + 1, u), d, pairs, roots, backs)
        assert math.isclose((10**logs).sum(), 1, rel_tol=1e-9)


def test_tables_follow_the_seating_process():
    """The exact draw agrees with seats taken one by one, weighed by the process itself."""
    rng = np.random.default_rng(4)
    t = sample_tables(np.full(20000, 5), np.full(20000, 0.7), 0.8, rng)
    weight = Counter()

    def seat(sizes, p):
        if sum(sizes) == 5:
            weight[len(sizes)] += p
            return
        for i, s in enumerate(sizes):
            seat([*sizes[:i], s + 1, *sizes[i + 1 :]], p * (s - 0.8))
        seat([*sizes, 1], p * 0.7)

    seat([1], 0.7)
    total = sum(weight.values())
    for k, w in weight.items():
        assert abs((t == k).mean() - w / total) < 0.02
    big = sample_tables(np.array([1, 0, 33, 100000]), np.array([1.0, 1.0, 1e-9, 2.0]), 0.8, rng)
    assert big[0] == 1 and big[1] == 0 and big[2] == 1 and 1 < big[3] < 100000


def test_null_ids_stay_null(spark, tmp_path):
    rows = [(None, "one two three"), (None, "four five"), (2**60 + 1, "one two"), (2**60 + 3, "five one two three")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.op4_pitman_yor(spark, str(tmp_path)).collect()
    assert Counter((x.doc_id, x.n_tokens) for x in got) == Counter((i, len(tokens(t))) for i, t in rows)


def test_rare_contexts_tell_as_much_at_every_size(spark, tmp_path):
    """One word follows each of 1500 words, which are rarer than 1/CONTEXTS of the tokens; so do the first tokens of texts."""
    r = random.Random(6)
    after = {f"w{i}": f"w{r.randrange(3000)}" for i in range(3000)}
    rows = []
    for i in range(600):
        w = ["zfirst"]
        for _ in range(40):
            a = f"w{r.randrange(3000)}"
            w += [a, after[a]]
        rows.append((i, " ".join(w)))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    held = [x for x in registry.op4_pitman_yor(spark, str(tmp_path)).collect() if x.held_out]
    assert sum(x.score for x in held) > 0.75 * sum(x.base_score for x in held)


@pytest.mark.parametrize("contexts", [2048, 6, 1])
def test_probabilities_after_every_context_add_up_to_one(spark, monkeypatch, contexts):
    """Of all words and the end after each other: the matrix, but for a change of scale, comes from texts of up to two words."""
    monkeypatch.setattr(pitman_yor, "CONTEXTS", contexts)
    r = random.Random(9)
    words = [f"w{i}" for i in range(9)]
    learn = [(i, " ".join(r.choice(words[: 2 + i % 8]) for _ in range(r.randrange(20)))) for i in range(80)]
    states = [*words, "new"]
    texts = ["", *states, *(f"{a} {b}" for a in states for b in states)]
    rows = [*((*x, True) for x in learn), *((1000 + i, t, False) for i, t in enumerate(texts))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, learn boolean").repartition(4)
    got = {x.doc_id: x.score for x in pitman_yor.document_scores(docs, docs["learn"]).collect()}
    p = {t: 10 ** got[1000 + i] for i, t in enumerate(texts)}
    m = np.array([[p[""], *(1.0 for _ in states)], *([p[a], *(p[f"{a} {b}"] / p[b] for b in states)] for a in states)])
    assert math.isclose(np.abs(np.linalg.eigvals(m)).max(), 1, rel_tol=1e-9)


def test_hashing_takes_memory_by_the_part_not_by_the_slice():
    buf = np.frombuffer(b"One more long word or two " * 80_000, np.uint8)
    off = np.arange(0, len(buf) + 1, 260)
    tracemalloc.start()
    got = pitman_yor._tokens(buf, off)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 15 * len(buf) and all((a == b).all() for a, b in zip(got, pitman_yor._part_tokens(buf, off), strict=True))
