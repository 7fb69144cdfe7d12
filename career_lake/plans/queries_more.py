"""Queries of search, strategy, evidence and folds, with oracle SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from career_lake.operators import corpus as C
from career_lake.operators import evidence as A
from career_lake.operators import search as K
from career_lake.operators import strategy as N
from career_lake.plans import queries_jobs as QJ
from career_lake.plans.bindings import NOW, oracle, view
from career_lake.plans.queries_corpus import ROLE
from career_lake.session import table
from career_lake.streaming import folds as Z
from career_lake.streaming import quota as ZQ

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _add(name: str, f, sql: str | None = None, *views: str) -> None:  # noqa: ANN001
    QUERIES[name] = f
    if sql:
        ORACLES[name] = oracle(sql, *views)


def requests(s: SparkSession, d: str) -> DataFrame:
    b = table(s, d, "benchmark")
    return b.select(F.col("item_id").alias("request_id"), "text", K.search_terms(F.col("text"), F.array().cast("array<string>")).alias("terms"))


def library(s: SparkSession, d: str) -> DataFrame:
    v = C.with_role(C.current_versions(view(s, d, "doc_versions_v")).where("status = 'active'")).where("role = 'evidence'")
    return v.select(F.col("document_id").alias("doc_id"), "title", "content", F.col("version_id").alias("updated_at"))


_LAT = "regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9_.+-]{1,39}')"
_TERMS = f"list_filter({_LAT}, lambda t, i: list_position(list_transform({_LAT}, lambda x: lower(x)), lower(t)) = i)[1:28]"
REQ = f", rq AS (SELECT item_id AS request_id, text, {_TERMS} AS terms FROM benchmark)"
LIB = ROLE + ", lib AS (SELECT document_id AS doc_id, title, content, version_id AS updated_at FROM cur WHERE status = 'active' AND role = 'evidence')"
_add("k01_search_terms", lambda s, d: requests(s, d).select("request_id", F.array_join("terms", " ").alias("terms")), "WITH " + REQ[2:] + " SELECT request_id, array_to_string(terms, ' ') AS terms FROM rq")
_add(
    "k02_trigram_index",
    lambda s, d: K.trigram_index(library(s, d)).groupBy("field").agg(F.count("*").alias("postings"), F.sum("tf").alias("grams")),
    LIB + ", g AS (SELECT doc_id, 'title' AS field, lower(title)[i:i+2] AS gram FROM lib, unnest(range(1, length(title) - 1)) u(i) UNION ALL SELECT doc_id, 'content', lower(content)[i:i+2] FROM lib, unnest(range(1, length(content) - 1)) u(i)), p AS (SELECT gram, doc_id, field, count(*) AS tf FROM g GROUP BY ALL) SELECT field, count(*) AS postings, CAST(sum(tf) AS BIGINT) AS grams FROM p GROUP BY 1",
    "doc_versions_v",
)
BM25 = (
    LIB + REQ
    + f"""
, tq AS (SELECT DISTINCT request_id, lower(unnest(terms)) AS term FROM rq), tt AS (SELECT DISTINCT term FROM tq WHERE length(term) >= 3)
, hit AS (SELECT term, doc_id, 5.0 * (length(title) - length(replace(lower(title), term, ''))) / length(term) + 1.0 * (length(content) - length(replace(lower(content), term, ''))) / length(term) AS tf, length(title) + length(content) AS size FROM tt JOIN lib ON contains(lower(title), term) OR contains(lower(content), term))
, st AS (SELECT count(*) AS n, avg(length(title) + length(content)) AS mean FROM lib), dfs AS (SELECT term, count(*) AS df FROM hit GROUP BY 1)
, sc AS (SELECT hit.term, doc_id, greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * {K.K1 + 1} / (tf + {K.K1} * ({1 - K.B} + {K.B} * size / mean)) AS part FROM hit JOIN dfs USING (term) CROSS JOIN st)
, rk AS (SELECT request_id, doc_id, -round(CAST(sum(CAST(round(part * 1e9) AS BIGINT)) AS DOUBLE) / 1e9, 6) AS rank FROM tq JOIN sc USING (term) GROUP BY ALL), fnd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY rank, doc_id) AS place FROM rk) WHERE place <= 50)"""
)
_add("k03_bm25_search", lambda s, d: K.bm25_search(requests(s, d), library(s, d), 5).select("request_id", "doc_id", F.when(F.round("rank", 3) == 0, 0.0).otherwise(F.round("rank", 3)).alias("rank"), "place"), BM25 + "SELECT request_id, doc_id, CASE WHEN round(rank, 3) = 0 THEN 0.0 ELSE round(rank, 3) END AS rank, CAST(place AS INT) AS place FROM fnd", "doc_versions_v")


def _short(s: SparkSession, d: str) -> DataFrame:
    r = requests(s, d)
    none = r.select("request_id", F.lit("").alias("doc_id")).limit(0)
    return K.like_search(r, library(s, d), none, 2).select("request_id", "doc_id", "place")


_add(
    "k04_like_search",
    _short,
    LIB + REQ + ", x AS (SELECT request_id, lower(unnest(terms[1:8])) AS term FROM rq), h AS (SELECT DISTINCT request_id, doc_id, updated_at FROM x JOIN lib ON contains(lower(concat_ws(chr(10), title, content)), term)), p AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY updated_at DESC, doc_id) AS place FROM h) SELECT request_id, doc_id, CAST(place AS INT) AS place FROM p WHERE place <= 20",
    "doc_versions_v",
)
_add(
    "k05_visible",
    lambda s, d: K.visible(C.with_role(C.current_versions(view(s, d, "doc_versions_v"))).withColumn("fact_review", F.col("published_at").isNull() & (F.col("version_no") == 2)).withColumn("ocr_review", F.col("ocr_status") == "required"), view(s, d, "sources_v"), view(s, d, "reviews_v").where("status = 'pending'")).select("document_id", "version_id"),
    ROLE + "SELECT document_id, version_id FROM cur WHERE status = 'active' AND role = 'evidence' AND NOT (published_at IS NULL AND version_no = 2) AND coalesce(ocr_status, '') <> 'required' AND source_id IN (SELECT source_id FROM sources_v WHERE enabled) AND document_id NOT IN (SELECT document_id FROM reviews_v WHERE status = 'pending')",
    "doc_versions_v", "sources_v", "reviews_v",
)
_add(
    "k07_snippets",
    lambda s, d: library(s, d).select("doc_id", F.sha2(K.snippet(F.col("content"), F.array(F.lit("and"), F.lit("tion"))), 256).alias("snippet_hash")),
    LIB + """, c AS (SELECT doc_id, trim(regexp_replace(content, '[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g')) AS t FROM lib), q AS (SELECT *, coalesce(least(nullif(strpos(lower(t), 'and'), 0), nullif(strpos(lower(t), 'tion'), 0)), 1) AS p FROM c), w AS (SELECT *, greatest(0, p - 1 - 250) AS s FROM q)
SELECT doc_id, sha256(CASE WHEN length(t) <= 1000 THEN t ELSE concat(CASE WHEN s > 0 THEN '…' ELSE '' END, t[s + 1 : least(length(t), s + 1000)], CASE WHEN s + 1000 < length(t) THEN '…' ELSE '' END) END) AS snippet_hash FROM w""",
    "doc_versions_v",
)
_add("k09_local_results", lambda s, d: K.local_results(K.bm25_search(requests(s, d), library(s, d), 5), 5).select("request_id", "doc_id", F.round("score", 3).alias("score")), BM25 + "SELECT request_id, doc_id, round(1 / (1 + ln(1 + abs(rank))), 3) AS score FROM fnd WHERE place <= 5", "doc_versions_v")


def targets(s: SparkSession, d: str) -> DataFrame:
    """Each profile's first 3 candidates of its portfolio."""
    p = QJ.pairs(s, d).where("rank <= 3")
    return p.select("profile_id", F.col("id").alias("job_id"), F.col("company_name").alias("company"), F.col("job_title").alias("title"))


def gaps(s: SparkSession, d: str) -> DataFrame:
    return N.capability_gaps(QJ.profiles(s, d), targets(s, d))


def tasks(s: SparkSession, d: str) -> DataFrame:
    g, t = gaps(s, d), targets(s, d)
    shared = N.shared_tasks(g)
    return N.with_schedule(shared.unionByName(N.target_tasks(g, t, shared)))


GAPS = (
    QJ.PAIRS
    + """
, tg AS (SELECT profile_id, id AS job_id FROM pairs WHERE rank <= 3)
, gp AS (SELECT * FROM (SELECT profile_id, job_id, unnest(['resume', 'project_evidence', 'application', 'interview']) AS capability, unnest([true, true, false, false]) AS shareable, unnest(['high', 'high', 'high', 'medium']) AS priority, unnest([coalesce(resume, 'missing'), coalesce(project_evidence, 'missing'), coalesce(application, 'missing'), coalesce(interview, 'missing')]) AS level FROM tg JOIN profiles_v USING (profile_id)) WHERE level <> 'ready')
, sh AS (SELECT profile_id, capability FROM gp WHERE shareable GROUP BY ALL HAVING count(DISTINCT job_id) >= 2)
, tk AS (SELECT profile_id, concat('task:shared:', capability) AS task_id, capability, 'shared' AS scope FROM sh UNION ALL SELECT profile_id, concat('task:', job_id, ':eligibility'), NULL, 'target' FROM tg UNION ALL SELECT profile_id, concat('task:', job_id, ':research'), 'target_research', 'target' FROM tg
  UNION ALL SELECT profile_id, concat('task:', job_id, ':', capability), capability, 'target' FROM gp WHERE NOT (shareable AND EXISTS (SELECT 1 FROM sh WHERE sh.profile_id = gp.profile_id AND sh.capability = gp.capability)) UNION ALL SELECT DISTINCT profile_id, 'task:shared:weekly-review', NULL, 'shared' FROM tg)
, ts AS (SELECT *, CASE WHEN task_id LIKE '%:eligibility' THEN 1 WHEN capability IS NULL THEN 7 WHEN capability = 'target_research' THEN 2 WHEN capability IN ('resume', 'project_evidence') THEN 3 WHEN capability = 'application' THEN 4 ELSE 5 END AS day, CASE WHEN capability IS NULL THEN 45 WHEN capability = 'target_research' THEN 60 WHEN capability = 'project_evidence' THEN 150 WHEN capability = 'application' THEN 90 ELSE 120 END AS minutes FROM tk)"""
)
_JP = ("jobs_v", "profiles_v")
_add("n01_capability_gaps", lambda s, d: gaps(s, d).select("profile_id", "job_id", "capability", "priority"), GAPS + "SELECT profile_id, job_id, capability, priority FROM gp", *_JP)
_add("n02_shared_tasks", lambda s, d: N.shared_tasks(gaps(s, d)).select("profile_id", "task_id", "priority"), GAPS + "SELECT profile_id, concat('task:shared:', capability) AS task_id, 'high' AS priority FROM sh", *_JP)
_add("n03_tasks", lambda s, d: tasks(s, d).select("profile_id", "task_id", "scope", "day", "minutes"), GAPS + "SELECT profile_id, task_id, scope, day, minutes FROM ts", *_JP)
_add(
    "n04_seven_day_plan",
    lambda s, d: N.seven_day_plan(tasks(s, d), NOW).select("profile_id", "day", F.col("date").cast("string").alias("date"), F.array_join("task_ids", ",").alias("task_ids")),
    GAPS + f", pd AS (SELECT DISTINCT profile_id, CAST(d AS INT) AS day FROM tg CROSS JOIN range(1, 8) r(d)) SELECT pd.profile_id, pd.day, CAST(DATE '{NOW}' + pd.day - 1 AS VARCHAR) AS date, coalesce(string_agg(task_id, ',' ORDER BY task_id), '') AS task_ids FROM pd LEFT JOIN ts ON ts.profile_id = pd.profile_id AND ts.day = pd.day GROUP BY 1, 2",
    *_JP,
)
_add(
    "n05_cost_summary",
    lambda s, d: N.cost_summary(tasks(s, d), QJ.profiles(s, d)),
    GAPS + ", a AS (SELECT profile_id, CAST(sum(minutes) AS BIGINT) AS minutes, count(*) FILTER (capability IS NOT NULL) AS gaps, count(*) FILTER (scope = 'target') AS target_tasks FROM ts GROUP BY 1), b AS (SELECT a.*, CASE WHEN weekly_hours IS NOT NULL THEN greatest(1, least(80, weekly_hours)) * 60 END AS capacity FROM a JOIN profiles_v USING (profile_id)) SELECT *, CAST(floor(minutes / capacity * 100 + 0.5) AS BIGINT) AS utilisation, CASE WHEN capacity IS NULL THEN 0 ELSE greatest(0, minutes - capacity) END AS overflow FROM b",
    *_JP,
)
_add(
    "n08_route_lanes",
    lambda s, d: N.route_lanes(QJ.pairs(s, d).select("profile_id", F.col("company_name").alias("company"), F.col("id").alias("job_id"), F.col("apply_end_date").alias("date"), (F.col("rank") == 5).alias("selected"))),
    QJ.PAIRS + ", h AS (SELECT *, max(CASE WHEN rank = 5 THEN 1 ELSE 0 END) OVER (PARTITION BY profile_id, company_name) AS head FROM pairs), l AS (SELECT profile_id, company_name AS company, id AS job_id, CAST(dense_rank() OVER (PARTITION BY profile_id ORDER BY head DESC, company_name) AS INT) AS lane, CAST(row_number() OVER (PARTITION BY profile_id, company_name ORDER BY apply_end_date NULLS LAST, id) AS INT) AS place, CASE WHEN apply_end_date IS NULL THEN 'pending' ELSE 'dated' END AS kind FROM h) SELECT * FROM l WHERE lane <= 3 AND place <= 4",
    *_JP,
)


def _answers(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "conversations")
    marks = F.when(F.col("turn") % 4 == 0, F.lit("根据资料1，岗位开放")).when(F.col("turn") % 4 == 1, F.lit("（资料9）说明要求")).when(F.col("turn") % 4 == 2, F.lit("[资料2]")).otherwise(F.lit("没有引用"))
    return c.select("conv_id", "turn", F.concat(marks, F.lit("\n"), F.coalesce("text", F.lit(""))).alias("answer"))


_ANS = "SELECT conv_id, turn, concat(CASE turn % 4 WHEN 0 THEN '根据[资料1]，岗位开放' WHEN 1 THEN '[资料9]说明要求' WHEN 2 THEN '[资料2]' ELSE '没有引用' END, chr(10), coalesce(text, '')) AS answer FROM conversations"
_add(
    "a03_citations",
    lambda s, d: _answers(s, d).select("conv_id", "turn", A.normalise_citations(F.col("answer")).alias("answer")).select("conv_id", "turn", A.valid_citations(F.col("answer"), F.lit(5)).alias("valid"), F.array_join(A.cited(F.col("answer")), ",").alias("cited")),
    f"WITH n AS ({_ANS}) SELECT conv_id, turn, turn % 4 = 0 AS valid, CASE turn % 4 WHEN 0 THEN '1' WHEN 1 THEN '9' WHEN 2 THEN '2' ELSE '' END AS cited FROM n",
)
_add(
    "a07_evidence_deadlines",
    lambda s, d: A.with_timeliness(view(s, d, "announcements_v").withColumn("snippet", F.concat(F.lit("报名截止时间："), F.regexp_extract("content", "至(20\\d\\d年\\d+月\\d+日)", 1))), NOW).select("version_id", F.col("deadline").cast("string").alias("deadline"), "expired"),
    f", x AS (SELECT version_id, TRY_CAST(concat(regexp_extract(content, '至(20\\d\\d)年', 1), '-', lpad(regexp_extract(content, '至20\\d\\d年(\\d+)月', 1), 2, '0'), '-', lpad(regexp_extract(content, '至20\\d\\d年\\d+月(\\d+)日', 1), 2, '0')) AS DATE) AS d FROM announcements_v) SELECT version_id, CAST(d AS VARCHAR) AS deadline, d < DATE '{NOW}' AS expired FROM x",
    "announcements_v",
)


def _chunks(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "conversations")
    kind = F.when(F.col("conv_id") % 7 == 0, "stopped").when(F.col("role") == "user", "chunk").when(F.col("conv_id") % 3 == 0, "message").otherwise("end")
    return c.select(F.col("conv_id").alias("message_id"), F.col("turn").alias("place"), kind.alias("kind"), F.coalesce("text", F.lit("")).alias("text"))


_add(
    "z04_answer_fold",
    lambda s, d: Z.fold_answers(_chunks(s, d)).select("message_id", F.sha2("answer", 256).alias("answer_hash"), "status"),
    """WITH c AS (SELECT conv_id AS message_id, turn AS place, CASE WHEN conv_id % 7 = 0 THEN 'stopped' WHEN role = 'user' THEN 'chunk' WHEN conv_id % 3 = 0 THEN 'message' ELSE 'end' END AS kind, coalesce(text, '') AS text FROM conversations)
, g AS (SELECT message_id, coalesce(arg_max(text, place) FILTER (kind = 'message'), string_agg(text, '' ORDER BY place, text) FILTER (kind = 'chunk'), '') AS answer, count(*) FILTER (kind = 'stopped') AS bad, count(*) FILTER (kind = 'end') AS ends FROM c GROUP BY 1) SELECT message_id, sha256(answer[1:40000]) AS answer_hash, CASE WHEN bad > 0 OR ends = 0 THEN 'error' ELSE 'complete' END AS status FROM g""",
)
_add(
    "z03_request_quota",
    lambda s, d: Z.request_quota(table(s, d, "events").select(F.col("event_id").alias("request_id"), (F.col("user_id") % 20).cast("string").alias("address"), F.col("user_id").cast("string").alias("session"), F.col("ts").cast("timestamp").cast("double").alias("ts"))).groupBy("allowed").agg(F.count("*").alias("requests")),
)
def _requests(s: SparkSession, d: str) -> DataFrame:
    """Events as requests; now and then a session's request comes from the next address."""
    return table(s, d, "events").select(F.col("event_id").alias("request_id"), ((F.col("user_id") + (F.col("event_id") % 97 == 0).cast("int")) % 20).cast("string").alias("address"), F.col("user_id").cast("string").alias("session"), F.col("ts").cast("timestamp").alias("ts"))


_add("z03_quota_by_address", lambda s, d: ZQ.quota_by_address(_requests(s, d)).select("request_id", "address", "session", "error", "allowed"))
_add(
    "z06_sync_health",
    lambda s, d: Z.sync_health(view(s, d, "sync_events_v"), "1 day").select(F.col("start").cast("date").cast("string").alias("day"), "events", "errors", "changed"),
    "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS events, count(*) FILTER (kind = 'error') AS errors, count(*) FILTER (kind = 'changed') AS changed FROM sync_events_v GROUP BY 1",
    "sync_events_v",
)
