"""The workspace state as a stream ends where the batch form does."""

from pyspark.sql import functions as F

from career_lake.session import table
from career_lake.streaming import stateful as Z

SF = "/root/testdata/sf0.001"
NOW = "2026-07-22"


def test_stream_ends_where_the_batch_does(spark, tmp_path):
    ev = table(spark, SF, "events").select(F.col("user_id").cast("string").alias("subject"), F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 3).cast("int").alias("expected"))
    middle = ev.agg(F.expr("percentile(unix_micros(ts), 0.5)").alias("m")).first()["m"]
    path = str(tmp_path / "in")
    early = F.unix_micros("ts") <= F.lit(int(middle))
    for part in (early, ~early):
        ev.where(part).coalesce(1).write.mode("append").parquet(path)
    seen = {}

    def keep(batch, _):
        seen.update({r.subject: tuple(r) for r in batch.collect()})

    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = Z.stream_workspace_state(stream, NOW).writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).outputMode("update").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    want = {r.subject: tuple(r) for r in Z.workspace_state(ev, NOW).collect()}
    assert seen == want and any(r[1] > 1 for r in want.values())
