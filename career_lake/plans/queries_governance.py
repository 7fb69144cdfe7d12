"""Queries of routing, staging and review decisions, with oracle SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from career_lake.operators import governance as V
from career_lake.plans.bindings import VIEWS, oracle, view

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

VIEWS |= {
    "gdocs_v": """
SELECT CAST(o_orderkey AS STRING) AS document_id, concat('src', CAST(o_orderkey % 20 AS STRING)) AS source_id, concat('https://h', CAST(o_orderkey % 7 AS STRING), '.example.com/a/', CAST(o_orderkey AS STRING)) AS canonical_url,
       concat('公告', CAST(o_orderkey AS STRING)) AS title, concat('h', CAST(o_custkey AS STRING)) AS content_hash, concat(CAST(o_orderkey AS STRING), '-1') AS current_version_id,
       CASE o_orderkey % 6 WHEN 0 THEN 'review_pending' WHEN 1 THEN 'superseded' ELSE 'active' END AS status, CAST(o_orderdate AS STRING) AS updated_at,
       CASE WHEN o_orderkey % 5 = 0 THEN 'discovery' ELSE 'evidence' END AS role, CASE WHEN o_orderkey % 8 = 0 THEN 'required' ELSE NULL END AS ocr_status,
       CASE WHEN o_orderkey % 4 = 0 THEN concat(CAST(o_orderkey AS STRING), CASE WHEN o_orderkey % 44 = 0 THEN '-9' ELSE '-2' END) ELSE NULL END AS pending_version_id,
       CASE WHEN o_orderkey % 4 = 0 THEN concat('c', CAST(o_custkey AS STRING)) ELSE NULL END AS pending_hash,
       CASE o_orderkey % 3 WHEN 0 THEN concat('c', CAST(o_custkey AS STRING)) WHEN 1 THEN 'a,b,c,d,e,f,g,h,i,j' ELSE '' END AS rejected_list,
       CASE WHEN o_orderkey % 9 <> 0 THEN concat('r', CAST(o_orderkey - 1 AS STRING)) ELSE NULL END AS hold_review_id, CASE WHEN o_orderkey % 5 = 0 THEN concat('h', CAST(o_custkey AS STRING)) ELSE 'old' END AS original_hash, o_orderkey
FROM {orders}""",
    "gsources_v": """
SELECT DISTINCT concat('src', CAST(o_orderkey % 20 AS STRING)) AS source_id, concat('source ', CAST(o_orderkey % 20 AS STRING)) AS name, CASE o_orderkey % 20 % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'b' WHEN 2 THEN 'C' ELSE 'D' END AS source_grade,
       CASE WHEN o_orderkey % 20 % 5 = 0 THEN 'media' WHEN o_orderkey % 20 % 5 = 1 THEN 'Official' ELSE NULL END AS authority
FROM {orders}""",
    "gversions_v": """
SELECT CAST(o_orderkey AS STRING) AS document_id, concat(CAST(o_orderkey AS STRING), '-', CAST(v AS STRING)) AS version_id, v AS version_no, concat(CASE WHEN v = 1 THEN 'h' ELSE 'c' END, CAST(o_custkey AS STRING)) AS content_hash,
       CASE WHEN v = 2 AND o_orderkey % 3 = 0 THEN concat('新公告', CAST(o_orderkey AS STRING)) ELSE NULL END AS title, CASE WHEN o_orderkey % 8 < 4 THEN 'required' ELSE 'done' END AS ocr_status
FROM {orders} CROSS JOIN (SELECT 1 AS v UNION ALL SELECT 2 AS v) AS vs WHERE v = 1 OR o_orderkey % 2 = 0""",
    "greviews_v": """
SELECT concat('r', CAST(o_orderkey AS STRING)) AS review_id, CAST(o_orderkey AS STRING) AS candidate_id, CASE o_orderkey % 5 WHEN 0 THEN 'withdrawn' WHEN 1 THEN 'resumed' WHEN 2 THEN 'paused' WHEN 3 THEN 'delayed' ELSE 'corrected' END AS relation_type,
       CASE WHEN o_orderkey % 2 = 0 THEN 'whole' ELSE 'partial' END AS change_scope, CASE WHEN o_orderkey % 5 = 1 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'status_only' ELSE 'complete' END ELSE NULL END AS resume_completeness,
       CASE WHEN o_orderkey % 4 <> 2 THEN 'supersede' ELSE 'reconcile' END AS resolution_mode, CASE WHEN o_orderkey % 8 < 4 THEN 'pending' WHEN o_orderkey % 8 = 7 THEN 'rejected' ELSE 'approved_reconciliation' END AS status,
       CASE WHEN o_orderkey % 8 >= 4 THEN CAST(o_orderkey + 1 AS STRING) ELSE NULL END AS target_id, CAST(o_orderdate AS STRING) AS created_at, concat('2026-', CAST(o_custkey AS STRING)) AS resolved_at, o_orderkey
FROM {orders} WHERE o_orderkey % 3 <> 1 OR o_orderkey % 5 < 3""",
    "gedges_v": """
SELECT concat('r', CAST(o_orderkey AS STRING)) AS review_id, CAST(o_orderkey + k AS STRING) AS document_id, CAST(o_orderkey % 50 + k AS DOUBLE) * 0.01 AS score, (o_orderkey + k) % 3 = 0 AND (k < 3 OR o_orderkey % 2 = 0) AS blocked, 'title_similarity' AS evidence
FROM {orders} CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 AS k UNION ALL SELECT 3 AS k UNION ALL SELECT 6 AS k) AS ks WHERE k < 6 OR o_orderkey % 4 = 0""",
    "gdecisions_v": """
SELECT concat('r', CAST(o_orderkey AS STRING)) AS review_id, CASE WHEN o_orderkey % 31 = 0 THEN 'maybe' WHEN o_orderkey % 7 = 0 THEN 'reject' ELSE 'approve' END AS decision,
       CASE WHEN o_orderkey % 11 = 0 THEN CAST(o_orderkey AS STRING) WHEN o_orderkey % 13 = 0 THEN 'none' WHEN o_orderkey % 5 = 1 THEN CAST(o_orderkey + 1 AS STRING) WHEN o_orderkey % 17 = 0 THEN CAST(o_orderkey + 7 AS STRING) WHEN o_orderkey % 19 = 0 THEN CAST(o_orderkey + 9 AS STRING) ELSE ' ' END AS target_id
FROM {orders} WHERE o_orderkey % 2 = 0 OR o_orderkey % 5 = 1""",
    "gcandidates_v": """
SELECT concat('src', CAST(o_orderkey % 20 AS STRING)) AS source_id, concat('https://h', CAST(o_orderkey % 7 AS STRING), '.example.com/', CASE WHEN o_orderkey % 3 = 0 THEN 'n/' ELSE 'a/' END, CAST(o_orderkey AS STRING)) AS canonical_url,
       concat(CASE o_orderkey % 4 WHEN 0 THEN 'h' WHEN 1 THEN 'c' ELSE 'n' END, CAST(o_custkey AS STRING)) AS content_hash, CASE WHEN o_orderkey % 6 < 4 THEN 'evidence' ELSE 'discovery' END AS role,
       CASE o_orderkey % 5 WHEN 0 THEN 'withdrawn' WHEN 1 THEN 'resumed' WHEN 2 THEN '' ELSE NULL END AS relation_type, CASE WHEN o_orderkey % 7 < 5 THEN 'deadline_changed' ELSE '' END AS reason, CAST(o_orderdate AS STRING) AS created_at, o_orderkey
FROM {orders}""",
}


def _add(name: str, f, sql: str, *views: str) -> None:  # noqa: ANN001
    QUERIES[name] = f
    ORACLES[name] = oracle(sql, *views)


def docs(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "gdocs_v").withColumn("rejected", F.filter(F.split("rejected_list", ","), lambda x: x != "")).drop("rejected_list", "o_orderkey")


def outcomes(s: SparkSession, d: str) -> DataFrame:
    return V.apply_review_decisions(view(s, d, "gdecisions_v"), view(s, d, "greviews_v"), docs(s, d), view(s, d, "gedges_v"))


def candidates(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "gcandidates_v").withColumn("relation_type", F.nullif("relation_type", F.lit(""))).withColumn("reasons", F.filter(F.array("reason"), lambda x: x != ""))


_REJ = "list_filter(string_split(rejected_list, ','), lambda x: x <> '')"
_add(
    "v04_route_candidates",
    lambda s, d: V.route_candidates(candidates(s, d), docs(s, d).select("source_id", "canonical_url", F.col("content_hash").alias("old_hash"), F.col("role").alias("old_role"), F.col("status").alias("old_status"), "rejected")).select("source_id", "canonical_url", "route"),
    f"""SELECT c.source_id, c.canonical_url, CASE WHEN g.document_id IS NULL AND c.role = 'evidence' AND nullif(c.relation_type, '') IS NOT NULL THEN 'cross_review' WHEN g.status = 'review_pending' THEN 'passthrough'
 WHEN list_contains({_REJ}, c.content_hash) THEN 'ignored' WHEN g.content_hash <> c.content_hash AND reason <> '' AND (c.role = 'evidence' OR g.role = 'evidence') THEN 'staged' ELSE 'upsert' END AS route
FROM gcandidates_v c LEFT JOIN gdocs_v g ON c.source_id = g.source_id AND c.canonical_url = g.canonical_url""",
    "gcandidates_v", "gdocs_v",
)
_add(
    "v05_stage_versions",
    lambda s, d: V.stage_versions(view(s, d, "gcandidates_v"), docs(s, d), view(s, d, "gversions_v")),
    """, l AS (SELECT document_id, max(version_no) AS last FROM gversions_v GROUP BY 1)
SELECT g.document_id, c.content_hash AS candidate_hash, CAST(coalesce(v.version_no, l.last + 1) AS INT) AS version_no, coalesce(v.version_id, concat(g.document_id, '-', CAST(l.last + 1 AS VARCHAR))) AS version_id, g.pending_hash IS DISTINCT FROM c.content_hash AS changed
FROM gcandidates_v c JOIN gdocs_v g ON c.source_id = g.source_id AND c.canonical_url = g.canonical_url JOIN l ON l.document_id = g.document_id LEFT JOIN gversions_v v ON v.document_id = g.document_id AND v.content_hash = c.content_hash""",
    "gcandidates_v", "gdocs_v", "gversions_v",
)
_add(
    "v06_fact_reviews",
    lambda s, d: V.list_fact_reviews(docs(s, d), view(s, d, "gsources_v"), 200),
    "SELECT document_id, source_id, name AS source_name, title, canonical_url, content_hash, pending_version_id, pending_hash FROM gdocs_v JOIN gsources_v USING (source_id) WHERE pending_version_id IS NOT NULL ORDER BY updated_at, document_id LIMIT 200",
    "gdocs_v", "gsources_v",
)


def _fact_decisions(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "gdocs_v").where("o_orderkey % 2 = 0").select("document_id", F.when(F.col("o_orderkey") % 3 == 1, "approve").when(F.col("o_orderkey") % 3 == 2, "reject").otherwise(F.when(F.col("o_orderkey") % 9 == 0, "wait").otherwise("reject")).alias("decision"))


_add(
    "v07_fact_decisions",
    lambda s, d: V.apply_fact_decisions(docs(s, d), view(s, d, "gversions_v"), _fact_decisions(s, d)).withColumn("rejected", F.array_join("rejected", ",")),
    f""", dc AS (SELECT document_id, CASE WHEN o_orderkey % 3 = 1 THEN 'approve' WHEN o_orderkey % 3 = 2 THEN 'reject' WHEN o_orderkey % 9 = 0 THEN NULL ELSE 'reject' END AS decision FROM gdocs_v WHERE o_orderkey % 2 = 0)
, j AS (SELECT g.*, dc.decision, v.version_id AS v_id, v.content_hash AS v_hash, v.title AS v_title, v.ocr_status AS v_ocr, {_REJ} AS old FROM gdocs_v g LEFT JOIN dc ON dc.document_id = g.document_id LEFT JOIN gversions_v v ON v.document_id = g.document_id AND v.version_id = g.pending_version_id)
, k AS (SELECT *, coalesce(decision = 'approve' AND v_id IS NOT NULL, false) AS yes, coalesce(decision = 'reject' AND v_id IS NOT NULL, false) AS nay, CASE WHEN list_contains(old, v_hash) THEN old ELSE list_append(old, v_hash) END AS grown FROM j)
SELECT document_id, CASE WHEN yes THEN coalesce(v_title, title) ELSE title END AS title, CASE WHEN yes THEN v_hash ELSE content_hash END AS content_hash, CASE WHEN yes THEN v_id ELSE current_version_id END AS current_version_id, CASE WHEN yes THEN 'active' ELSE status END AS status,
 CASE WHEN yes AND v_ocr = 'required' THEN 'human_approved' WHEN yes THEN v_ocr ELSE ocr_status END AS ocr_status, array_to_string(CASE WHEN nay THEN grown[greatest(1, len(grown) - 9):] ELSE old END, ',') AS rejected, CASE WHEN yes OR nay THEN NULL ELSE pending_version_id END AS pending_version_id,
 CASE WHEN decision IS NOT NULL AND pending_version_id IS NULL THEN 'not_pending' WHEN decision IS NOT NULL AND v_id IS NULL THEN 'no_candidate' END AS error FROM k""",
    "gdocs_v", "gversions_v",
)


def _opened(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = candidates(s, d)
    near = lambda k: F.struct((F.col("o_orderkey") + k).cast("string").alias("document_id"), (F.lit(k) * 0.25).alias("score"), ((F.col("o_orderkey") + k) % 2 == 0).alias("blocked"), F.array(F.lit("title")).alias("evidence"))
    c = c.withColumn("suggestions", F.array(near(1), near(2), near(1), near(10_000_000))).withColumn("change_scope", F.when(F.col("o_orderkey") % 2 == 0, "whole")).withColumn("resume_completeness", F.lit(None).cast("string")).withColumn("resolution_mode", F.lit(None).cast("string")).withColumn("title", F.lit("t"))
    return V.open_reviews(c, docs(s, d))


_NEW = ", n AS (SELECT c.*, sha256(concat(c.source_id, '|', c.canonical_url)) AS candidate_id FROM gcandidates_v c WHERE nullif(relation_type, '') IS NOT NULL AND NOT EXISTS (SELECT 1 FROM gdocs_v g WHERE g.source_id = c.source_id AND g.canonical_url = c.canonical_url))"
_add(
    "x05_open_reviews",
    lambda s, d: _opened(s, d)[0].drop("title", "version_no"),
    _NEW + "SELECT concat('cross:', candidate_id) AS review_id, candidate_id, source_id, canonical_url, content_hash, 'review_pending' AS candidate_status, relation_type, CASE WHEN o_orderkey % 2 = 0 THEN 'whole' ELSE 'unknown' END AS change_scope, CASE WHEN relation_type = 'resumed' THEN 'status_only' END AS resume_completeness, 'reconcile' AS resolution_mode, 'pending' AS status, created_at FROM n",
    "gcandidates_v", "gdocs_v",
)
_add(
    "x05_review_edges",
    lambda s, d: _opened(s, d)[1].select("review_id", "document_id", "score", "blocked"),
    _NEW + ", e AS (SELECT concat('cross:', candidate_id) AS review_id, CAST(o_orderkey + k AS VARCHAR) AS document_id, k * 0.25 AS score, (o_orderkey + k) % 2 = 0 AS blocked FROM n CROSS JOIN (SELECT unnest([1, 2]) AS k)) SELECT review_id, document_id, CAST(score AS DOUBLE) AS score, blocked FROM e WHERE document_id IN (SELECT document_id FROM gdocs_v)",
    "gcandidates_v", "gdocs_v",
)
_add(
    "x06_list_reviews",
    lambda s, d: V.list_reviews(view(s, d, "greviews_v"), docs(s, d), view(s, d, "gsources_v"), view(s, d, "gedges_v"), 300).withColumn("targets", F.array_join(F.transform("targets", lambda t: F.concat_ws(":", t["document_id"], t["target_status"], F.when(t["open"], "open").otherwise("blocked"))), ",")),
    """, r AS (SELECT review_id, candidate_id, g.title AS candidate_title, g.status AS candidate_status, name AS source_name, relation_type, created_at FROM greviews_v r JOIN gdocs_v g ON g.document_id = r.candidate_id JOIN gsources_v USING (source_id) WHERE r.status = 'pending' ORDER BY created_at, review_id LIMIT 300)
, t AS (SELECT review_id, string_agg(concat(e.document_id, ':', g.status, ':', CASE WHEN blocked THEN 'blocked' ELSE 'open' END), ',' ORDER BY blocked DESC, score DESC, e.document_id) AS targets FROM gedges_v e JOIN gdocs_v g ON g.document_id = e.document_id GROUP BY 1) SELECT r.*, coalesce(targets, '') AS targets FROM r LEFT JOIN t USING (review_id)""",
    "greviews_v", "gdocs_v", "gsources_v", "gedges_v",
)
_HOST = "regexp_extract({x}, '//([^/]*)', 1)"
OUT = f"""
, b AS (SELECT review_id, count(*) AS n, min(document_id) AS only_id FROM gedges_v WHERE blocked AND document_id IN (SELECT document_id FROM gdocs_v) GROUP BY 1)
, r0 AS (SELECT dc.review_id, dc.decision, nullif(trim(dc.target_id), '') AS named, r.candidate_id, r.relation_type, r.change_scope, r.resume_completeness, r.resolution_mode AS asked, r.status AS was, r.created_at, coalesce(nullif(trim(dc.target_id), ''), CASE WHEN n = 1 AND decision = 'approve' THEN only_id END) AS target_id
  FROM gdecisions_v dc JOIN greviews_v r ON r.review_id = dc.review_id LEFT JOIN b ON b.review_id = dc.review_id)
, r1 AS (SELECT r0.*, c.source_id AS cs, t.source_id AS ts, {_HOST.format(x="c.canonical_url")} AS ch, {_HOST.format(x="t.canonical_url")} AS th, EXISTS (SELECT 1 FROM gedges_v e WHERE e.review_id = r0.review_id AND e.document_id = r0.target_id) AS known
  FROM r0 JOIN gdocs_v c ON c.document_id = r0.candidate_id LEFT JOIN gdocs_v t ON t.document_id = r0.target_id)
, r2 AS (SELECT *, CASE WHEN decision = 'maybe' THEN 'unknown_decision' WHEN was <> 'pending' THEN 'not_pending' WHEN decision = 'approve' AND target_id IS NULL THEN 'ambiguous_target' WHEN decision = 'approve' AND ts IS NULL THEN 'unknown_target'
   WHEN decision = 'approve' AND named = candidate_id THEN 'own_target' WHEN decision = 'approve' AND named IS NOT NULL AND ts <> cs AND th <> ch AND NOT known THEN 'untrusted_target' END AS error,
   CASE WHEN asked = 'supersede' AND ((relation_type = 'withdrawn' AND change_scope = 'whole') OR (relation_type = 'resumed' AND resume_completeness = 'complete')) THEN 'supersede' ELSE 'reconcile' END AS resolution_mode FROM r1)
, oc AS (SELECT review_id, candidate_id, target_id, decision, resolution_mode, CASE WHEN error IS NOT NULL THEN was WHEN decision = 'reject' THEN 'rejected' WHEN resolution_mode = 'supersede' THEN 'approved' ELSE 'approved_reconciliation' END AS status, relation_type, created_at, error FROM r2)"""
_GV = ("gdecisions_v", "greviews_v", "gdocs_v", "gedges_v")
_add("x07_review_decisions", outcomes, OUT + "SELECT * FROM oc", *_GV)
_add(
    "x07_decided_statuses",
    lambda s, d: V.decided_statuses(outcomes(s, d)),
    OUT + ", u AS (SELECT candidate_id AS document_id, 'active' AS status, created_at, review_id FROM oc WHERE error IS NULL UNION ALL SELECT target_id, CASE WHEN resolution_mode = 'supersede' THEN 'superseded' ELSE 'review_pending' END, created_at, review_id FROM oc WHERE error IS NULL AND decision = 'approve') SELECT document_id, status FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, review_id DESC, status DESC) AS k FROM u) WHERE k = 1",
    *_GV,
)
_add(
    "x08_reconciliations",
    lambda s, d: V.list_reconciliations(view(s, d, "greviews_v"), docs(s, d), 250),
    "SELECT review_id, relation_type, candidate_id, c.title AS candidate_title, target_id, t.title AS target_title, t.content_hash AS target_hash, t.status AS target_status, resolved_at FROM greviews_v r JOIN gdocs_v c ON c.document_id = candidate_id JOIN gdocs_v t ON t.document_id = target_id WHERE r.status = 'approved_reconciliation' ORDER BY resolved_at, review_id LIMIT 250",
    "greviews_v", "gdocs_v",
)


def _requests(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    other = F.when(k % 7 == 0, k + 21).when(k % 7 == 1, k + 2).when(k % 7 == 2, k).when(k % 7 == 3, k + 10_000_000).otherwise(k + 1)
    return view(s, d, "greviews_v").select("review_id", other.cast("string").alias("replacement_id"))


_add(
    "x09_apply_reconciliations",
    lambda s, d: V.apply_reconciliations(_requests(s, d), view(s, d, "greviews_v"), docs(s, d), view(s, d, "gsources_v")),
    f""", q AS (SELECT review_id, CAST(o_orderkey + CASE o_orderkey % 7 WHEN 0 THEN 21 WHEN 1 THEN 2 WHEN 2 THEN 0 WHEN 3 THEN 10000000 ELSE 1 END AS VARCHAR) AS replacement_id FROM greviews_v)
, sx AS (SELECT source_id, upper(source_grade) IN ('A', 'B') AND lower(coalesce(authority, 'official')) = 'official' AS trusted FROM gsources_v), dx AS (SELECT g.*, {_HOST.format(x="canonical_url")} AS host, trusted FROM gdocs_v g JOIN sx USING (source_id))
, j AS (SELECT q.*, r.candidate_id, r.target_id, r.status AS was, t.hold_review_id AS hold, t.content_hash AS th, t.original_hash AS oh, p.document_id AS pid, p.status AS ps, p.source_id = t.source_id OR p.host = t.host OR (p.trusted AND t.trusted) AS ok FROM q JOIN greviews_v r USING (review_id) JOIN dx t ON t.document_id = r.target_id LEFT JOIN dx p ON p.document_id = q.replacement_id)
, e AS (SELECT *, CASE WHEN was <> 'approved_reconciliation' THEN 'not_held' WHEN pid IS NULL THEN 'unknown_replacement' WHEN replacement_id = candidate_id THEN 'change_notice' WHEN hold IS DISTINCT FROM review_id THEN 'other_hold' WHEN replacement_id = target_id AND th = oh THEN 'not_updated' WHEN replacement_id <> target_id AND ps <> 'active' THEN 'not_active' WHEN replacement_id <> target_id AND NOT ok THEN 'untrusted_replacement' END AS error FROM j)
SELECT review_id, target_id, replacement_id, CASE WHEN error IS NULL THEN CASE WHEN replacement_id = target_id THEN 'reactivated_updated_target' ELSE 'superseded_by_replacement' END END AS resolution, CASE WHEN error IS NULL THEN CASE WHEN replacement_id = target_id THEN 'active' ELSE 'superseded' END END AS target_status, error FROM e""",
    "greviews_v", "gdocs_v", "gsources_v",
)
_add(
    "x10_pause_chains",
    lambda s, d: V.close_pause_chains(outcomes(s, d), view(s, d, "greviews_v")),
    OUT + ", f AS (SELECT review_id AS resume_review_id, candidate_id AS resume_id, target_id AS touched FROM oc WHERE error IS NULL AND decision = 'approve' AND relation_type = 'resumed' AND resolution_mode = 'supersede'), h AS (SELECT * FROM greviews_v WHERE status = 'approved_reconciliation' AND relation_type = 'paused'), u AS (SELECT resume_review_id, review_id, resume_id, unnest([candidate_id, target_id]) AS document_id FROM f JOIN h ON touched = candidate_id OR touched = target_id) SELECT DISTINCT resume_review_id, review_id, document_id FROM u WHERE document_id <> resume_id",
    *_GV,
)
