"""Changes of versions as a stream, in a batch, and against the window form."""

from pyspark.sql import functions as F

from career_lake.operators import facts as N
from career_lake.plans import queries_facts as QF
from career_lake.streaming import stateful as Z

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((r.document_id, r.version_id, tuple(r.reasons), r.held) for r in df.collect())


def test_stream_equals_batch_and_window(spark, tmp_path):
    docs = QF.docs(spark, SF)
    want = rows(Z.version_changes(docs))
    window = {(r.document_id, r.version_id): tuple(r.reasons) for r in N.version_diff(docs).where(F.size("reasons") > 0).collect()}
    assert {(d, v): c for d, v, c, _ in want if c} == window and window
    path = str(tmp_path / "in")
    for no in (1, 2):
        docs.where(F.col("version_no") == no).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = Z.stream_changes(stream).writeStream.format("memory").queryName("z02").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(150)
    assert rows(spark.table("z02")) == want


def test_held_versions_leave_the_snapshot_and_rejected_ones_give_nothing(spark):
    texts = ["招聘公告", "招聘公告。决定取消财务岗位招聘计划", "招聘公告", "招聘公告。"]
    v = spark.createDataFrame([("d", f"v{i}", i, "公告", t) for i, t in enumerate(texts)], "document_id string, version_id string, version_no int, title string, content string")
    got = rows(Z.version_changes(v))
    assert [(x[1], x[3]) for x in got] == [("v0", False), ("v1", True), ("v3", False)] and "lifecycle_changed" in got[1][2]
    rejected = v.where("version_id = 'v1'").select("document_id", F.sha2("content", 256).alias("digest"))
    assert [x[1] for x in rows(Z.version_changes(v, rejected))] == ["v0", "v3"]
    bare = spark.createDataFrame([("d", "a", 1, None, None), ("d", "b", 2, None, "招聘公告")], v.schema)
    assert [(x[1], x[3]) for x in rows(Z.version_changes(bare))] == [("a", False), ("b", False)]
    assert rows(Z.version_changes(v.limit(0))) == []
