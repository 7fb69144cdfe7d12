"""Queries of external decision records and bounded contexts, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from career_lake.operators import external as E
from career_lake.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_RECORD = """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE concat('职位 ', CAST(o_custkey AS STRING)) END AS job_title,
 CASE o_orderkey % 6 WHEN 0 THEN 'direct-apply' WHEN 1 THEN 'high-risk-long-term' WHEN 2 THEN 'alternative-opportunity' WHEN 3 THEN 'elsewhere' ELSE 'prepare-and-verify' END AS route,
 CASE o_custkey % 4 WHEN 0 THEN 'met' WHEN 1 THEN 'not_met' WHEN 2 THEN 'unknown' ELSE 'not_applicable' END AS education,
 CASE o_orderkey % 10 WHEN 0 THEN 'not_met' WHEN 1 THEN 'unknown' WHEN 2 THEN 'open' ELSE 'met' END AS deadline,
 CASE o_custkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS grade, CASE WHEN o_custkey % 7 = 0 THEN 'pending' ELSE 'verified' END AS verified,
 CASE WHEN o_orderkey % 8 = 0 THEN 'ftp://x' ELSE 'https://x' END AS url, o_custkey % 5 <> 0 AS proven,
 CASE o_custkey % 11 WHEN 0 THEN 'live' WHEN 1 THEN 'live' WHEN 2 THEN 'live-check-failed' WHEN 3 THEN 'live-check-failed' WHEN 4 THEN 'stale' WHEN 5 THEN 'live' ELSE NULL END AS fresh,
 CASE o_custkey % 11 WHEN 0 THEN 'verified' WHEN 1 THEN 'verified' WHEN 2 THEN 'failed' WHEN 3 THEN 'failed' WHEN 4 THEN 'perhaps' WHEN 6 THEN 'failed' ELSE NULL END AS live,
 CASE o_orderkey % 9 WHEN 0 THEN NULL WHEN 1 THEN 'soon' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS verified_at, o_orderkey % 13 = 0 AS persisted,
 CASE o_orderkey % 14 WHEN 0 THEN TRUE WHEN 1 THEN NULL ELSE FALSE END AS sent FROM {orders}"""


def responses(s: SparkSession, d: str) -> DataFrame:
    """One decision record for each order."""
    r = s.sql(_RECORD, orders=table(s, d, "orders"))
    gate = lambda code, status: F.struct(F.lit(code).alias("code"), F.col(status).alias("status"), F.lit(f"{code} gate").alias("statement"), F.lit(None).cast("string").alias("raw_value"))
    proof = F.struct(F.col("k").cast("string").alias("id"), F.lit("公告").alias("title"), "url", F.col("grade").alias("source_grade"), F.col("verified").alias("verification_status"), F.lit("2026-07-01").alias("fetched_at"))
    return r.select(
        F.col("k").alias("decision_id"), F.col("k").cast("string").alias("external_job_id"), "job_title", F.lit("公司").alias("company_name"), F.col("route").alias("route_state"), F.lit("路线").alias("route_label"),
        F.array(gate("education", "education"), gate("application-deadline", "deadline")).alias("gates"), F.array(F.lit("核对")).alias("actions"),
        F.when(F.col("proven"), F.array(proof)).otherwise(F.array_remove(F.array(proof), proof)).alias("evidence"),
        F.col("persisted").alias("profile_persisted"), F.lit(False).alias("profile_logged"), F.lit(None).cast("boolean").alias("direct_identifiers"), F.col("sent").alias("sent_to_official"),
        F.when(F.col("fresh").isNotNull() | F.col("live").isNotNull(), F.struct(F.col("fresh").alias("freshness"), F.col("live").alias("live_status"), F.col("verified_at").alias("live_verified_at"))).alias("boundary"),
        (F.coalesce("live", F.lit("")) == "verified").alias("has_official_evidence"),
    )


_BROKEN = f"""WITH r AS ({_RECORD.replace("{orders}", "orders")}), b AS (SELECT *, CASE WHEN fresh IS NOT NULL OR live IS NOT NULL THEN verified_at END AS checked, proven AND grade IN ('A', 'B') AND verified = 'verified' AS sound FROM r),
 v AS (SELECT *, concat_ws(',', CASE WHEN job_title IS NULL THEN 'job' END, CASE WHEN route = 'elsewhere' THEN 'evaluation' END, CASE WHEN persisted OR coalesce(sent, FALSE) THEN 'privacy' END,
  CASE WHEN (fresh IS NULL) <> (live IS NULL) THEN 'live_pair' END, CASE WHEN fresh = 'stale' THEN 'freshness' END, CASE WHEN live = 'perhaps' THEN 'live_status' END, CASE WHEN checked = 'soon' THEN 'checked_at' END,
  CASE WHEN live = 'verified' AND checked IS NULL THEN 'live_verified' END, CASE WHEN live = 'failed' AND (fresh IS NULL OR checked IS NULL) THEN 'live_failed' END, CASE WHEN deadline = 'open' THEN 'gates' END,
  CASE WHEN live IS NOT NULL AND sent IS NULL THEN 'live_privacy' END, CASE WHEN live = 'verified' AND NOT sound THEN 'verified_evidence' END,
  CASE WHEN live = 'failed' AND (route <> 'prepare-and-verify' OR proven) THEN 'failed_route' END) AS violations FROM b)"""

QUERIES["g05_valid_decisions"] = lambda s, d: E.valid_decisions(responses(s, d)).select("decision_id", F.concat_ws(",", "violations").alias("violations"), "valid")
ORACLES["g05_valid_decisions"] = _BROKEN + " SELECT k AS decision_id, violations, violations = '' AS valid FROM v"

QUERIES["g06_eligibility_from_decisions"] = lambda s, d: E.eligibility_from_decisions(responses(s, d)).select(
    "decision_id", "job_id", "status", "can_apply", F.array_join(F.transform("checks", lambda c: F.concat_ws(":", c["kind"], c["outcome"], F.size(c["evidence"]).cast("string"))), ",").alias("checks"), F.array_join("reasons", "|").alias("reasons"), "verification", "checked_at"
)
ORACLES["g06_eligibility_from_decisions"] = _BROKEN + f""", t AS (SELECT *, sound AND url = 'https://x' AS trusted FROM v WHERE violations = ''),
 o AS (SELECT *, CASE education WHEN 'not_applicable' THEN 'pass' WHEN 'unknown' THEN 'unknown' ELSE CASE WHEN NOT trusted THEN 'unknown' WHEN education = 'met' THEN 'pass' ELSE 'fail' END END AS e,
  CASE deadline WHEN 'unknown' THEN 'unknown' ELSE CASE WHEN NOT trusted THEN 'unknown' WHEN deadline = 'met' THEN 'pass' ELSE 'fail' END END AS x FROM t),
 z AS (SELECT *, CASE WHEN 'fail' IN (e, x) THEN 'not_eligible_current_batch' WHEN 'unknown' IN (e, x) THEN 'unknown' ELSE 'eligible' END AS status FROM o)
 SELECT k AS decision_id, CAST(k AS VARCHAR) AS job_id, status, status = 'eligible' AS can_apply,
  concat('degree:', e, ':', CASE WHEN e <> 'unknown' AND trusted THEN '1' ELSE '0' END, ',deadline:', x, ':', CASE WHEN x <> 'unknown' AND trusted THEN '1' ELSE '0' END) AS checks,
  concat_ws('|', CASE WHEN e <> 'pass' THEN concat('education gate', CASE WHEN education <> 'unknown' AND NOT trusted THEN '{E.UNTRUSTED}' ELSE '' END) END,
   CASE WHEN x <> 'pass' THEN concat('application-deadline gate', CASE WHEN deadline <> 'unknown' AND NOT trusted THEN '{E.UNTRUSTED}' ELSE '' END) END) AS reasons,
  CASE live WHEN 'verified' THEN 'live-verified' WHEN 'failed' THEN 'live-failed' ELSE 'stored-snapshot' END AS verification, CASE WHEN live IN ('verified', 'failed') THEN checked END AS checked_at FROM z"""


def contexts(s: SparkSession, d: str) -> DataFrame:
    """The documents of six neighbouring ids as the sources of one question."""
    q = F.floor(F.col("doc_id") / 6)
    return table(s, d, "documents").select(q.alias("query_id"), (F.col("doc_id") - q * 6 + 1).cast("int").alias("rank"), F.concat(F.lit("来源 "), "source").alias("title"), F.col("text").alias("snippet"), F.concat(F.lit("https://x/"), F.col("doc_id").cast("string")).alias("url"), F.lit(None).cast("string").alias("published_at"))


QUERIES["a02_context_budget"] = lambda s, d: E.context_budget(contexts(s, d))
