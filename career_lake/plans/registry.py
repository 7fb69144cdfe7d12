"""Registered queries of the library's own operators, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from career_lake.plans import queries_corpus, queries_excerpts, queries_external, queries_facts, queries_governance, queries_jobs, queries_market, queries_more, queries_report, queries_rest, queries_retrieval

_PARTS = [queries_jobs, queries_corpus, queries_excerpts, queries_external, queries_facts, queries_governance, queries_market, queries_more, queries_report, queries_rest, queries_retrieval]
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The portfolio of every profile."""
    return QUERIES["d06_portfolio"](spark, sf_dir)
