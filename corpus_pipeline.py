"""A pipeline from raw documents to packed training sequences.

Each stage takes all documents that the stage before kept. Stages hand on the
columns of documents; the last returns the pieces of packed sequences.
"""

from __future__ import annotations

import gc

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from career_lake.llm import nb_svm, registry, toxicity
from career_lake.llm.jaccard import ngram_groups
from career_lake.llm.packing import packed
from career_lake.llm.substrings import without_repeats
from career_lake.session import settle, table

#: Duplicates' ids (8 bytes each) that may be broadcast.
MOST_BROADCAST = 2_000_000
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.5 or more."""
    return nb_svm.quality_scores(docs.select(COLUMNS), registry.quality_model(spark, sf_dir)).where("score >= 0.5").drop("score")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.3."""
    return toxicity.toxicity_scores(docs.select(COLUMNS), registry.toxicity_model(spark, sf_dir)).where("score < 0.3").drop("score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 or more of word 5-grams: that of the smallest doc_id (nulls last).

    Rows are told apart by doc_id and text, so other texts of the same or of no
    doc_id are documents of their own; equal rows of words collapse to one.
    """
    docs = docs.select(COLUMNS)
    found = settle(ngram_groups(docs, n=5, num=4, den=5).where("group is not null"), "pipeline-groups")
    docs = docs.withColumn("row_key", F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")
    first = found.groupBy("group").agg(F.min_by("row_key", rank).alias("first"), F.count("*").alias("rows")).where("rows > 1").select("group", "first")
    gone = settle(found.join(first, "group").where("row_key <> first").select("row_key").distinct(), "pipeline-gone")
    kept = docs.join(F.broadcast(gone) if gone.count() <= MOST_BROADCAST else gone, "row_key", "left_anti")
    again = settle(found.groupBy("row_key").count().where("count > 1").select("row_key"), "pipeline-again")
    n = again.count()
    if n:
        near = F.broadcast(again) if n <= MOST_BROADCAST else again
        kept = kept.join(near, "row_key", "left_anti").select(COLUMNS).union(kept.join(near, "row_key", "left_semi").dropDuplicates(["row_key"]).select(COLUMNS))
    return kept.select(COLUMNS)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that repeated windows of 35 words cover."""
    out = without_repeats(docs.select(COLUMNS))
    return out.select("doc_id", "text", "rest.lang", "rest.source", F.length("text").cast("long").alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of at most 2048 tokens."""
    return packed(docs, public_tokenizers.path(registry.BYTE_BPE), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality),
    ("toxicity", clean),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", substrings),
    ("packing", packing),
]

#: The stages fit models, follow links and call a tokenizer; tests/llm/test_pipeline.py compares them with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        gc.collect()  # a stage's model and sample leave the driver before the next stage
    return STAGES[-1][1](spark, docs, sf_dir)
