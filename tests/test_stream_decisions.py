"""Versions and decisions as one stream: a text rejected on the way is ignored by the next batch."""

import hashlib

from career_lake.streaming import changes as Z

VERSION = "document_id string, version_id string, seq long, title string, content string"
DECISION = "document_id string, seq long, kind string, digest string"
TEXT = "报名时间：2026年1月1日至2026年8月{d}日截止。学历要求：{e}及以上。" + "其他说明文字。" * 20


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


A, B, C, D = (TEXT.format(d=d, e=e) for d, e in ((1, "本科"), (2, "本科"), (3, "硕士"), (1, "本科")))
VERSIONS = [[("x", "x1", 1, "公告", A), ("y", "y1", 1, "公告", A)], [("x", "x2", 2, "公告", B), ("y", "y2", 2, "公告", B)], [("x", "x3", 4, "公告", B), ("y", "y3", 4, "公告", C)], [("x", "x4", 6, "公告", C), ("y", "y4", 6, None, None), ("x", "x5", 7, "公告", D + "补充。")]]
DECISIONS = [[], [("x", 3, "reject", sha(B))], [("y", 5, "approve", sha(B)), ("y", 5, "approve", sha(C))], [("z", 1, "reject", sha(A))]]
WANT = {
    ("x", 1): "current", ("x", 2): "staged", ("x", 3): "rejected", ("x", 4): "ignored", ("x", 6): "staged", ("x", 7): "current",
    ("y", 1): "current", ("y", 2): "staged", ("y", 4): "staged", ("y", 6): "current", ("z", 1): "none",
}


def told(rows):
    return {(r.document_id, r.seq): r.outcome for r in rows if not (r.document_id == "y" and r.seq == 5)}


def test_batch_and_restarted_stream(spark, tmp_path):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    whole = Z.document_changes(frame(sum(VERSIONS, []), VERSION), frame(sum(DECISIONS, []), DECISION)).collect()
    assert told(whole) == WANT and sorted(r.outcome for r in whole if r.document_id == "y" and r.seq == 5) == ["approved", "none"]
    assert {r.version_id for r in whole if r.outcome == "approved"} == {"y3"}
    assert set(next(r for r in whole if r.version_id == "x2").reasons) == {"deadline_changed"}
    left = {r.document_id: r.version_id for r in Z.pending_reviews(frame([tuple(r) for r in whole], Z.OUTCOME)).collect()}
    assert left == {}
    early = [tuple(r) for r in whole if r.seq <= 4]
    assert {r.document_id: r.version_id for r in Z.pending_reviews(frame(early, Z.OUTCOME)).collect()} == {"y": "y3"}
    seen, paths = [], [str(tmp_path / "v"), str(tmp_path / "d")]
    for k, (v, d) in enumerate(zip(VERSIONS, DECISIONS, strict=True)):
        frame(v, VERSION).coalesce(1).write.mode("append").parquet(paths[0])
        frame(d, DECISION).coalesce(1).write.mode("append").parquet(paths[1])
        if k < 2:
            continue  # the first start finds three files of each
        streams = [spark.readStream.schema(s).option("maxFilesPerTrigger", 1).parquet(p) for s, p in zip((VERSION, DECISION), paths, strict=True)]
        q = Z.stream_document_changes(*streams).writeStream.foreachBatch(lambda b, _: seen.extend(b.collect())).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(240)
    assert told(seen) == WANT and len(seen) == len(whole)


def test_empty(spark):
    assert Z.document_changes(spark.createDataFrame([], VERSION), spark.createDataFrame([], DECISION)).count() == 0
