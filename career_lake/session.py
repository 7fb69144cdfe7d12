"""Session settings and table access shared by every module."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "career_lake", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A UTC, adaptive session; sizes come from the cluster unless they are given."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    )
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Deal the rows over all cores, by the hash of columns: a small file is one task, however much work its rows are.

    Spark moves filters below a repartition, into that one task. The columns come
    out of a generator, which filters on them do not pass.
    """
    dealt = df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *by)
    for c in by:
        dealt = dealt.withColumn(c, F.explode(F.array(c)))
    return dealt


def together(df: DataFrame, *by: str) -> DataFrame:
    """Bring rows with equal columns together, in a number of tasks that adaptive execution does not lower: it goes by compressed sizes, and memory does not."""
    spark = df.sparkSession
    return df.repartition(max(16 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *by)


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir).

    Only a local session, where there is one machine, may fall back to a
    temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):  # local-cluster has executors of its own
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = os.environ.get("CAREER_LAKE_TMP") or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def settle(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write df as a Parquet table in the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def discard(*settled: DataFrame) -> None:
    """Delete tables that settle wrote and that no later step reads."""
    for df in settled:
        path = getattr(df, "_settled_at", None)
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
