import hashlib

import duckdb
import numpy as np
import pytest

from career_lake.llm import part_codes, registry


def brute(rows, parts, entries, rounds, scale):
    """Plain loops over all distances; rows: (id, vector, label)."""
    kept = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in v], lab) for i, v, lab in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    kept = sorted((k for k in kept if len(k[1]) % parts == 0), key=lambda k: (k[0] is None, k[0] or 0, k[1]))
    kept = [k for k in kept if len(k[1]) == len(kept[0][1])]
    d = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * d : (p + 1) * d]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v, p: min((dist(cut(v, p), c), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        new = [list(b) for b in books]
        for p in range(parts):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(near(v, p)[1], []).append(cut(v, p))
            for e, g in groups.items():
                new[p][e] = [sum(c) // len(g) for c in zip(*g, strict=True)]
        books = new
    out, total = [], {}
    for i, v, lab in kept:
        found = [near(v, p) for p in range(parts)]
        out.append((i, lab, "".join(f"{e:02x}" for _, e in found), sum(x for x, _ in found)))
        total[lab] = total.get(lab, 0) + out[-1][3]
    told = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((*r, total[r[1]], told) for r in out), key=repr)


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_equals_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(part_codes, "MOST_BROADCAST", most)
    monkeypatch.setattr(part_codes, "SLICE", 50)
    r = np.random.default_rng(3)
    rows = [(int(i) * 3 - 100, r.normal(0, 1, 8).round(1).tolist(), None if i % 7 == 0 else int(i) % 3) for i in r.permutation(300)]
    rows += [rows[0], rows[1], (5, None, 1), (6, [0.1, None] * 4, 1), (7, [float("nan")] * 8, 2), (8, [float("inf")] * 8, 2), (9, [], 0), (None, rows[2][1], 0), (10**9, [0.5] * 4, 1), (10**9 + 1, [-0.001] * 8, 9)]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "vec_id long, embedding array<float>, label int, code string")
    out, books = part_codes.part_codes(df, parts=4, entries=10, rounds=2)
    assert sorted((tuple(x) for x in out.collect()), key=repr) == brute(rows, 4, 10, 2, 256.0) and books.shape == (4, 10, 2)


def test_search_equals_all_distances_with_ties():
    r = np.random.default_rng(4)
    for spread in (2, 40, 1 << 26):
        book, x = r.integers(-spread, spread, (64, 4)), r.integers(-spread, spread, (3000, 4))
        book[40:50] = book[:10]
        d = ((x[:, None, :].astype(object) - book[None]) ** 2).sum(2)
        arg, best = part_codes.nearest(x, book)
        assert (best == d.min(1)).all() and (arg == d.argmin(1)).all()
    same = np.zeros((64, 4), np.int64)
    assert (part_codes.nearest(np.zeros((5, 4), np.int64), same)[0] == 0).all()


def test_fewer_vectors_than_entries_and_empty_tables(spark, tmp_path):
    rows = [(4, [1.0, 2.0, 3.0, 4.0], 1), (2, [1.0, 2.0, 3.5, 4.0], None), (2, [1.0, 2.0, 3.5, 4.0], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    out, _ = part_codes.part_codes(df, parts=2)
    assert sorted((tuple(x) for x in out.collect()), key=repr) == brute(rows, 2, 64, 2, 256.0)
    far = spark.createDataFrame([(1, [1e30] * 16, 1), (2, [0.0] * 16, 1)], "vec_id long, embedding array<float>, label int")
    assert [x.vec_id for x in part_codes.part_codes(far)[0].collect()] == [2]
    for k, some in enumerate(([], [(1, None, 1)])):
        spark.createDataFrame(some, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / f"{k}/embeddings.parquet"))
        assert registry.op12_part_codes(spark, str(tmp_path / str(k))).count() == 0


def test_query_equals_oracle(spark):
    db = duckdb.connect()
    db.execute("create view embeddings as select * from '/root/testdata/sf0.001/embeddings.parquet'")
    df = registry.op12_part_codes(spark, "/root/testdata/sf0.001")
    found = db.execute(registry.ORACLES["op12_part_codes"])
    at = [[c[0] for c in found.description].index(c) for c in df.columns]
    got = sorted(tuple(r) for r in df.collect())
    assert got == sorted(tuple(r[i] for i in at) for r in found.fetchall()) and len(got) >= 200
