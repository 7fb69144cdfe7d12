import duckdb
import numpy as np
import pandas as pd
import pytest

from career_lake.llm import registry, topk


def brute(rows, queries, k):
    out = []
    for qi, qv in queries:
        s = sorted((-int(np.dot(np.array(v, object), np.array(qv, object))), i) for i, v in rows if i != qi and len(v) == len(qv))
        out += [(qi, r + 1, i, -sc) for r, (sc, i) in enumerate(s[:k])]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(8192, 1024), (40, 3)])
def test_equals_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(topk, "BLOCK_ROWS", blocks[0])
    monkeypatch.setattr(topk, "BLOCK_QUERIES", blocks[1])
    r = np.random.default_rng(8)
    base = r.normal(0, 120, (5, 16))
    rows = [(i, (base[i % 5] + r.normal(0, 60, 16)).astype(int).tolist()) for i in range(400)]
    rows += [(i, rows[0][1]) for i in (1000, 1001, 1002)] + [(7, rows[7][1]), (2000, [1, 2]), (2001, [3, -4]), (2002, [0] * 16), (2003, [10**7] * 16)]
    queries = [rows[i] for i in (0, 7, 20, 399)] + [(2000, [1, 2]), (2002, [0] * 16)]
    df = lambda x: spark.createDataFrame([(i, v, "e") for i, v in x] + [(None, [1] * 16, "e"), (5, None, "e")], "id long, v array<long>, score string")
    got = sorted(tuple(x) for x in topk.top_k(df(rows), df(queries), 10).collect() if x.query_id is not None)
    assert got == brute(rows, queries, 10)


def test_query_equals_oracle(spark, tmp_path):
    src = "/root/testdata/sf0.001/embeddings.parquet"
    db = duckdb.connect()
    db.execute(f"create view embeddings as select * from '{src}'")
    want = sorted(db.execute(registry.ORACLES["op1_topk_search"]).fetchall())
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in registry.op1_topk_search(spark, "/root/testdata/sf0.001").collect())
    assert got == want and len(got) == 50
    odd = [(0, [0.5, float("nan")], 1), (100, [0.5, None], 1), (200, None, 1), (300, [1.0, 2.0], 1), (1, [1.0, float("inf")], 1), (2, [0.1, 0.2], 1), (3, [], 1)]
    spark.createDataFrame(odd, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert [tuple(r) for r in registry.op1_topk_search(spark, str(tmp_path)).collect()] == [(300, 1, 2, 102 * 1024 + 204 * 2048)]
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "e/embeddings.parquet"))
    assert registry.op1_topk_search(spark, str(tmp_path / "e")).count() == 0


@pytest.mark.parametrize("scale", [1, 10**6])
def test_queries_read_segments_together(scale):
    r = np.random.default_rng(3)
    m = np.vstack([r.normal(0, 120 * scale, (300, 8)), 40 * np.eye(8) * 120 * scale, np.zeros((3, 8))]).astype(np.int64)
    q = np.vstack([m[:20], m[300:], -m[:5]])
    ban = np.zeros((len(q), len(m)), bool)
    ban[np.arange(20), np.arange(20)] = True
    found = topk.ImpactIndex(m).search(q, 10, ban)
    assert len(found) == len(q)
    for v, no, (at, scores) in zip(q, ban, found, strict=True):
        assert (scores == m[at] @ v).all() and not no[at].any()
        assert sorted(scores)[::-1][:10] == sorted((m @ v)[~no])[::-1][:10]
    assert min(len(at) for at, _ in found) < 50  # bounds leave few rows to rescore


def test_a_cell_of_several_lots_of_queries_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 7)
    r = np.random.default_rng(4)
    rows = [(i, r.integers(-600, 600, 6).tolist()) for i in range(150)]
    df = lambda x: spark.createDataFrame(x, "id long, v array<long>")
    assert sorted(tuple(x) for x in topk.top_k(df(rows), df(rows[:40]), 10).collect()) == brute(rows, rows[:40], 10)


@pytest.mark.parametrize("size", [1, 7, 50, 1000])
def test_a_block_is_indexed_once_for_all_queries(monkeypatch, size):
    built, real = [], topk.ImpactIndex
    monkeypatch.setattr(topk, "ImpactIndex", lambda m: built.append(len(m)) or real(m))
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 5)
    r = np.random.default_rng(5)
    rows, queries = [(i, r.integers(-600, 600, 6)) for i in range(90)], [(1000 + i, r.integers(-600, 600, 6)) for i in range(12)]
    said = pd.DataFrame([(b, asks, i, 0, v) for b in (0, 1, 3) for asks, some in ((False, rows[b::4]), (True, queries)) for i, v in some], columns=["r", "asks", "id", "mark", "v"])
    out = pd.concat(topk._searched(3)(said.iloc[i : i + size] for i in range(0, len(said), size)))
    assert sorted(built) == [22, 23, 23]
    want = [x for b in (0, 1, 3) for x in brute(rows[b::4], queries, 3)]
    assert sorted(zip(out["query_id"], out["vec_id"], out["score"], strict=True)) == sorted((q, i, s) for q, _, i, s in want)
