import hashlib
import random

import pytest
from pyspark.sql import functions as F

from career_lake.llm import registry
from career_lake.llm.sketches import containment, likeness, merged, neighbours, shingle_hashes, with_sketch, word_hashes


def brute_edits(rows):
    rows = sorted((i, t or "") for i, t in rows)
    out = {}
    for k, (i, t) in enumerate(rows):
        q = len(t) // 4
        nxt = rows[(k + 1) % len(rows)][1]
        out[i] = (len(t), hashlib.sha256((t[: len(t) - q] + nxt[:q]).encode()).hexdigest())
    return out


@pytest.fixture
def rows():
    r = random.Random(5)
    rows = [(i * r.choice([1, 7, 1000]) + i, " ".join(f"w{r.randrange(400)}" for _ in range(r.choice([3, 40, 300])))) for i in range(60)]
    return list(dict(rows).items()) + [(-5, None), (10**12, ""), (-70, "ñandú 😀 Ünïcode text with some words more"), (10**12 + 1, "one")]


def test_query(spark, rows, tmp_path):
    spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fingerprint string").write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.op9_fingerprints(spark, str(tmp_path)).collect()
    want = brute_edits(rows)
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in got} == want and len(got) == len(rows)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    long = [r for r in got if r.n_chars > 1000]
    assert sum(r.near_edited for r in long) / len(long) > 0.4 and max(r.near_next for r in long) < 0.2


def test_equal_texts_have_equal_sketches_and_merge(spark):
    words = [f"t{i}" for i in range(500)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "\n".join(words).upper()), (3, " ".join(words[:250])), (4, ""), (5, None)], "id long, text string")
    s = {r.id: r.s for r in with_sketch(docs, "text", "s").collect()}
    assert s[1] == s[2] and s[4] == s[5] == [] and 30 < len(s[1]) < 100
    pair = spark.createDataFrame([(s[3], s[1])], "a array<long>, b array<long>").select(containment(F.col("a"), F.col("b")).alias("c"), merged(F.col("a"), F.col("b")).alias("m")).first()
    assert pair.c == 1.0 and pair.m == s[1]


def test_sketch_equals_brute_force_and_union_of_sketches(spark):
    """The threshold alone decides: every hash below it and no other; so a union of sketches is the sketch of both texts."""
    r = random.Random(9)
    rows = [(i, " ".join(f"w{r.randrange(50)}" for _ in range(r.choice([0, 1, 4, 5, 8, 60])))) for i in range(120)]
    docs = spark.createDataFrame(rows, "id long, text string")
    hashes = docs.select("id", word_hashes(F.col("text")).alias("h")).select("id", shingle_hashes(F.col("h"), 5).alias("s"))
    every = {x.id: x.s for x in hashes.collect()}
    got = {x.id: x.s for x in with_sketch(docs, "text", "s").collect()}
    limit = -(2**63) + 2**61
    assert got == {i: sorted({h for h in s if h < limit}) for i, s in every.items()}
    pairs = spark.createDataFrame([(i, got[i], got[i + 1]) for i in range(0, 118)], "id long, a array<long>, b array<long>")
    for x in pairs.select("id", merged(F.col("a"), F.col("b")).alias("m"), likeness(F.col("a"), F.col("b")).alias("n")).collect():
        both = {h for h in every[x.id] + every[x.id + 1] if h < limit}
        assert x.m == sorted(both)
        assert x.n == (len(set(got[x.id]) & set(got[x.id + 1])) / len(both) if both else 0.0)


def test_far_and_null_ids(spark):
    rows = [(i, 1) for i in range(2000)] + [(10**15, 1), (None, 5)]
    got = {x.id: x.next_id for x in neighbours(spark.createDataFrame(rows, "doc_id long, n_chars long"), bucket_rows=100).collect()}
    assert got == {i: i + 1 for i in range(1999)} | {1999: 10**15, 10**15: 0}


def test_neighbours_over_many_ranges(spark, rows):
    ids = sorted(i for i, _ in rows)
    got = neighbours(spark.createDataFrame([(i, len(t or "")) for i, t in rows], "doc_id long, n_chars long"), bucket_rows=3).collect()
    size = {i: len(t or "") for i, t in rows}
    assert {r.id: (r.next_id, r.n_prev) for r in got} == {i: (ids[(k + 1) % len(ids)], size[ids[k - 1]]) for k, i in enumerate(ids)}


def test_empty_and_repeated(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "e/documents.parquet"))
    assert registry.op9_fingerprints(spark, str(tmp_path / "e")).count() == 0
    spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "d")], "doc_id long, text string").write.parquet(str(tmp_path / "r/documents.parquet"))
    assert registry.op9_fingerprints(spark, str(tmp_path / "r")).count() == 3
