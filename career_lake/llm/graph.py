"""Connected components by alternating stars, as Spark joins and aggregations.

Each round settles its edges in the shared folder, so that a lost executor
costs one round at most. A node with very many neighbours is not gathered: its
smallest neighbour comes from a partial aggregation, and the join back to the
edges is a plain equi-join that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from career_lake.session import discard, settle


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, component) of every node of edges(a long, b long); component: the smallest node reached.

    Self-links and repeated links do no harm. Without edges the result is empty.
    """
    now = settle(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{label}-edges")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    seen = mark(now)
    while seen[0]:
        before, now = now, settle(_small_star(_large_star(now)), f"{label}-star")
        discard(before)
        last, seen = seen, mark(now)
        if last == seen:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
