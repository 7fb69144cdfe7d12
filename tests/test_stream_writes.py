"""Writes of workspaces: the batch form against one loop, and a restarted stream against the batch form."""

import random
from datetime import UTC, datetime, timedelta

import pytest

from career_lake.streaming import workspace as Z

T0 = datetime(2026, 1, 1, tzinfo=UTC)
EVENT = "subject string, event_id long, ts timestamp, expected int, jobs array<string>, tasks array<string>"


@pytest.fixture(scope="module")
def events():
    """Subjects of different diligence; some rest for more than 180 days; some write nonsense."""
    r, t, out, seen = random.Random(6), 0.0, [], {}
    for i in range(800):
        t += r.choice([5, 60, 4000, 200 * 86_400 if i in (300, 650) else 30])
        s = r.choice("aaaaabcd")
        expected = r.choice([seen.get(s, 0), seen.get(s, 0), r.randrange(4)])
        jobs = [f"j{k}" for k in range(r.choice([0, 1, 3, 3, 5]))]
        tasks = r.choice([None, ["t:1", "t:1"], ["Bad Id"] if i % 50 == 0 else ["x"]])
        out.append((s, i, T0 + timedelta(seconds=t), expected, jobs, tasks))
        seen[s] = expected + 1
    return out


def loop(events):
    kept, out = {}, {}
    for s, i, ts, expected, jobs, tasks in sorted(events, key=lambda e: (e[2], e[1])):
        rev, last = kept.get(s, (0, ts))
        if (ts - last).total_seconds() > 180 * 86_400:
            rev, last = 0, ts
            kept.pop(s)
        if len(jobs) > 3 or "Bad Id" in (tasks or []):
            out[i] = ("invalid", rev)
        elif expected == rev:
            kept[s] = (rev + 1, ts)
            out[i] = ("accepted", rev + 1)
        else:
            out[i] = ("conflict", rev)
    return out


def test_batch_equals_one_loop_and_gives_three_tables(spark, events):
    out = Z.workspace_writes(spark.createDataFrame(events, EVENT)).cache()
    want = loop(events)
    assert {r.event_id: (r.outcome, r.revision) for r in out.collect()} == want and len({o for o, _ in want.values()}) == 3
    assert {r.event_id for r in Z.conflicts(out).collect()} == {i for i, (o, _) in want.items() if o == "conflict"}
    live = {r.subject: (r.revision, r.event_id, r.tasks) for r in Z.snapshots(out, str(events[-1][2].date())).collect()}
    last = {}
    for s, i, ts, *_ in events:
        if want[i][0] == "accepted" and (events[-1][2] - ts).days < 180:
            last[s] = (want[i][1], i)
    assert {s: x[:2] for s, x in live.items()} == last and all(x[2] in ([], ["t:1"], ["x"]) for x in live.values())
    odd = [(None, 1, T0, 0, None, None), ("s", 2, None, 0, None, None), ("s", 3, T0, None, None, None), ("s", 4, T0, 0, [None], None), ("s", 5, T0, 0, None, None)]
    assert sorted((r.event_id, r.outcome) for r in Z.workspace_writes(spark.createDataFrame(odd, EVENT)).collect()) == [(3, "invalid"), (4, "invalid"), (5, "accepted")]
    assert Z.workspace_writes(spark.createDataFrame([], EVENT)).count() == 0


def test_stream_with_a_restart_equals_the_batch(spark, events, tmp_path):
    path, seen, sizes = str(tmp_path / "in"), {}, []

    def keep(batch, _):
        seen.update({r.event_id: (r.outcome, r.revision) for r in batch.collect()})

    for k, (a, b) in enumerate([(0, 200), (200, 500), (500, 800)]):
        spark.createDataFrame(events[a:b], EVENT).coalesce(1).write.mode("append").parquet(path)
        if k == 0:
            continue
        stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(path)
        q = Z.stream_workspace_writes(stream).writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(240)
        sizes += [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert seen == loop(events) and max(sizes) <= 4 * 4  # a state and a timer a subject
