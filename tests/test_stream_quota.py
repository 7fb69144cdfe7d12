"""Quotas by address as a stream, restarted on the way, and in a batch."""

import random
from datetime import UTC, datetime, timedelta

import pytest

from career_lake.streaming import quota as Z

T0 = datetime(2026, 7, 22, tzinfo=UTC)


def plain(requests):
    """The rule in one loop over all requests in order."""
    owner, cells, out = {}, {}, {}
    for i, a, s, t in sorted(requests, key=lambda r: (r[3], r[0])):
        if s not in owner or t - owner[s][1] > Z.FORGET:
            owner[s] = (a, t)
        owner[s] = (owner[s][0], t)
        if owner[s][0] != a:
            out[i] = None
            continue
        for k in (("a", a), ("s", s)):
            if k not in cells or t >= cells[k][0] + 60:
                cells[k] = [t, 0]
        ok = cells["a", a][1] < 20 and cells["s", s][1] < 6
        out[i] = ok
        cells["a", a][1] += ok
        cells["s", s][1] += ok
    return out


@pytest.fixture(scope="module")
def requests():
    """Five addresses, one of them busy; some sessions move between addresses, some come back after days."""
    r, t, out = random.Random(4), 0.0, []
    for i in range(3000):
        t += r.choice([0.2, 0.5, 2, 30 if i % 40 == 0 else 1, 100_000 if i % 700 == 699 else 1])
        address = r.choice(["a", "a", "a", "b", "c", "d", "e"])
        session = f"{r.choice('abcde') if r.random() < 0.05 else address}{r.randrange(6)}"
        out.append((i, address, session, round(t, 3)))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, a, s, T0 + timedelta(seconds=t)) for i, a, s, t in rows], "request_id long, address string, session string, ts timestamp")


def test_batch_equals_one_loop(spark, requests):
    got = {r.request_id: (r.allowed, r.error) for r in Z.quota_by_address(frame(spark, requests)).collect()}
    want = plain(requests)
    assert got == {i: (ok, ok is None) for i, ok in want.items()} and {True, False, None} == set(want.values())
    bare = spark.createDataFrame([(1, None, "s", T0), (2, "a", None, T0), (3, "a", "s", None), (4, "a", "s", T0), (4, "a", "s", T0)], "request_id long, address string, session string, ts timestamp")
    assert [(r.request_id, r.allowed) for r in Z.quota_by_address(bare).collect()] == [(4, True), (4, True)]
    assert Z.quota_by_address(bare.limit(0)).count() == 0


def test_stream_with_a_restart_equals_the_batch(spark, requests, tmp_path):
    path, seen = str(tmp_path / "in"), {}

    def keep(batch, _):
        seen.update({r.request_id: r.allowed for r in batch.collect()})

    cuts, states = [0, 900, 1500, 3000], []
    for k in range(3):
        frame(spark, requests[cuts[k] : cuts[k + 1]]).coalesce(1).write.mode("append").parquet(path)
        if k == 0:
            continue  # the first start reads two files, the second goes on from its checkpoint
        stream = spark.readStream.schema("request_id long, address string, session string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(path)
        q = Z.stream_quota_by_address(stream).writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(240)
        states.append([sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in q.recentProgress])
    assert seen == plain(requests)
    assert states[-1][-1] < 400  # keys, windows and timers of what is open, not of 3000 requests
