"""Queries of index requests and hits, evidence windows and decision checks, with oracle SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from career_lake import rules
from career_lake.operators import decision_checks as W
from career_lake.operators import jobs as J
from career_lake.operators import retrieval as K
from career_lake.plans import queries_jobs as QJ
from career_lake.plans.bindings import VIEWS, oracle, view
from career_lake.session import settle
from career_lake.streaming import folds as Z

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

VIEWS |= {
    "asked_v": "SELECT doc_id AS request_id, coalesce(text, '') AS query, CASE doc_id % 3 WHEN 0 THEN concat(source, ',', upper(source), ', ,second  name') WHEN 1 THEN '' ELSE source END AS companies, CASE WHEN doc_id % 4 = 0 THEN lang ELSE '' END AS titles, CASE WHEN doc_id % 5 < 3 THEN concat(lang, ',2027') ELSE '' END AS profile FROM {documents}",
    "hits_v": """
SELECT l_orderkey AS request_id, l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey % 1000 AS place, CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE CAST(l_partkey % 20 AS STRING) END AS remote_id, CASE WHEN l_suppkey % 7 = 0 THEN repeat(concat(l_returnflag, 'x '), 500) ELSE concat(' ', l_returnflag, '  ', l_linestatus, CAST(l_suppkey % 3 AS STRING)) END AS snippet, CAST(l_linenumber AS DOUBLE) + l_quantity AS score FROM {lineitem}""",
    "remote_v": "SELECT CAST(p_partkey AS STRING) AS remote_id, CAST(p_partkey + 100 AS STRING) AS document_id, CASE WHEN p_partkey % 6 = 0 THEN 'pending' ELSE 'synced' END AS status, concat('h', CAST(p_partkey % 5 AS STRING)) AS content_hash FROM {part} WHERE p_partkey < 20",
    "rdocs_v": "SELECT CAST(p_partkey + 100 AS STRING) AS document_id, p_name AS title, CASE WHEN p_partkey % 5 = 4 THEN 'other' ELSE concat('h', CAST(p_partkey % 5 AS STRING)) END AS content_hash, CASE WHEN p_partkey % 11 = 0 THEN 'superseded' ELSE 'active' END AS status, p_partkey % 13 = 0 AS blocked FROM {part} WHERE p_partkey < 20",
    "payloads_v": """
SELECT CAST(doc_id AS STRING) AS query_id, doc_id, CASE WHEN doc_id % 13 = 0 THEN 'none' ELSE translate(concat(CASE doc_id % 3 WHEN 0 THEN '[' WHEN 1 THEN '⟨"records":[' ELSE '⟨"data":⟨"items":[' END,
 '⟨"title":" A  ', source, '","snippet":"first","url":"https://a.example.com/1","score":0.5⟩,⟨"title":"A ', source, '","content":"first","url":"https://a.example.com/1"⟩,⟨"segment":⟨"content":"deep","document":⟨"name":"D"⟩⟩,"metadata":⟨"source_url":"ftp://x","url":"http://m/', CAST(doc_id AS STRING), '"⟩⟩,⟨"title":"no text"⟩,⟨"name":"n3","text":"t3","id":7⟩,⟨"documentName":"n4","text":"t4"⟩,⟨"title":"n5","text":"t5"⟩,⟨"title":"n6","text":"t6"⟩,⟨"title":"n7","text":"t7"⟩]',
 CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN '⟩' ELSE '⟩⟩' END), '⟨⟩', concat(chr(123), chr(125))) END AS payload FROM {documents}""",
    "queries_v": "SELECT o_orderkey AS query_id, CASE o_orderkey % 7 WHEN 0 THEN concat(CAST(year(o_orderdate) + 30 AS STRING), '届毕业生学历要求') WHEN 1 THEN '报名截止时间是什么 CET-4' WHEN 2 THEN '北京有哪些岗位类别 Java' WHEN 3 THEN '笔试时间' WHEN 4 THEN 'salary Salary' WHEN 5 THEN '最多可应聘几个招聘单位' ELSE '' END AS query FROM {orders}",
}


def _add(name: str, f, sql: str, *views: str) -> None:  # noqa: ANN001
    QUERIES[name] = f
    ORACLES[name] = oracle(sql, *views)


_WS = "[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"
_add(
    "k10_index_queries",
    lambda s, d: K.compose_index_query(view(s, d, "asked_v").withColumns({"companies": F.split("companies", ","), "job_titles": F.split("titles", ","), "profile": F.split("profile", ",")})).select("request_id", F.sha2("index_query", 256).alias("index_query"), F.length("index_query").alias("n_chars")),
    """, v AS (SELECT *, CASE request_id % 3 WHEN 0 THEN concat(split_part(companies, ',', 1), '/second name')[1:48] ELSE companies END AS c, CASE WHEN profile <> '' THEN replace(profile, ',', '/') ELSE '' END AS p FROM asked_v), t AS (SELECT *, concat_ws('|', nullif(c, ''), nullif(titles, '')) AS tg FROM v)
, x AS (SELECT request_id, query, concat_ws('；', CASE WHEN tg <> '' THEN concat('目标:', tg)[1:56] END, CASE WHEN p <> '' THEN concat('学生:', p)[1:56] END) AS ctx FROM t), q AS (SELECT request_id, CASE WHEN ctx = '' THEN query[1:250] ELSE concat(query[1:greatest(1, 250 - length(ctx) - 1)], '；', ctx) END AS index_query FROM x) SELECT request_id, sha256(index_query) AS index_query, length(index_query) AS n_chars FROM q""",
    "asked_v",
)
_add(
    "k11_grounded_hits",
    lambda s, d: K.ground_external_hits(view(s, d, "hits_v"), view(s, d, "remote_v"), view(s, d, "rdocs_v"), 3),
    f""", h AS (SELECT request_id, place, remote_id, d.document_id, d.title, score, trim(regexp_replace(snippet, '{_WS}', ' ', 'g')) AS t FROM hits_v JOIN remote_v m USING (remote_id) JOIN rdocs_v d ON d.document_id = m.document_id AND d.content_hash = m.content_hash WHERE m.status = 'synced' AND d.status = 'active' AND NOT d.blocked)
, f AS (SELECT request_id, remote_id, document_id, title, lower(t) AS k, min(place) AS place, (list(t ORDER BY place, score))[1] AS t, (list(score ORDER BY place, score))[1] AS score FROM h GROUP BY ALL), g AS (SELECT *, row_number() OVER (PARTITION BY request_id, remote_id ORDER BY place, score, k) AS seg FROM f)
, e AS (SELECT request_id, remote_id, document_id, title, min(place) AS p0, (list(score ORDER BY place, score))[1] AS score, list(t ORDER BY place, score, t) AS ts FROM g WHERE seg <= 3 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY p0, remote_id) AS place FROM e)
SELECT request_id, document_id, title, array_to_string(list_transform(ts, lambda x: x[1:greatest(1, CAST(floor((1200 - 3 * (len(ts) - 1)) / len(ts)) AS INT))]), ' … ')[1:1200] AS snippet, score, CAST(place AS INT) AS place FROM r WHERE place <= 3""",
    "hits_v", "remote_v", "rdocs_v",
)


def _targets(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    j = view(s, d, "jobs_v").select((F.col("id").cast("long") % 20).alias("request_id"), F.col("id").alias("doc_id"), F.concat_ws(" ", "company_name", "job_title").alias("text"))
    k = F.col("request_id") % 4
    t = j.select("request_id").distinct().select("request_id", F.when(k == 0, F.array(F.lit("铁路局集团公司"))).when(k == 1, F.array(F.lit("电网公司"), F.lit("铁路局集团公司"))).alias("companies"), F.when(k != 3, F.array(F.lit("软件开发工程师"))).alias("job_titles"))
    return j, t


_add(
    "e04_filter_by_target",
    lambda s, d: K.filter_by_target(*_targets(s, d)),
    ", r AS (SELECT CAST(id AS BIGINT) % 20 AS request_id, id AS doc_id, concat_ws(' ', company_name, job_title) AS t FROM jobs_v) SELECT request_id, doc_id FROM r WHERE CASE request_id % 4 WHEN 0 THEN contains(t, '铁路局') WHEN 1 THEN contains(t, '铁路局') OR contains(t, '电网公司') WHEN 2 THEN contains(t, '软件开发工程师') ELSE true END",
    "jobs_v",
)
_add(
    "a01_normalise_sources",
    lambda s, d: K.normalise_sources(view(s, d, "payloads_v")).select("query_id", "place", "source_id", "title", "snippet", "url", "score"),
    """, u AS (SELECT query_id, doc_id, unnest([1, 2, 3, 4, 5, 6]) AS place FROM payloads_v WHERE doc_id % 13 <> 0) SELECT query_id, place, CASE place WHEN 3 THEN '7' ELSE concat('source-', CAST(place AS VARCHAR)) END AS source_id, CASE place WHEN 1 THEN concat('A ', source) WHEN 2 THEN 'D' ELSE concat('n', CAST(place AS VARCHAR)) END AS title, CASE place WHEN 1 THEN 'first' WHEN 2 THEN 'deep' ELSE concat('t', CAST(place AS VARCHAR)) END AS snippet,
 CASE place WHEN 1 THEN 'https://a.example.com/1' WHEN 2 THEN concat('http://m/', query_id) END AS url, CASE place WHEN 1 THEN 0.5 END::DOUBLE AS score FROM u JOIN documents USING (doc_id)""",
    "payloads_v",
)
_FAC = "list_concat(" * (len(rules.EVIDENCE_FACETS) - 1) + ", ".join(f"CASE WHEN regexp_matches(query, '{p}') THEN [{', '.join(chr(39) + w + chr(39) for w in ws)}] ELSE [] END" + ")" * (i > 0) for i, (p, ws) in enumerate(rules.EVIDENCE_FACETS))
_GR = "flatten(list_transform([6, 5, 4, 3, 2], lambda n: list_transform(range(1, greatest(length(g) - n + 2, 1)), lambda i: g[i:i + n - 1])))"
_add(
    "a04_evidence_terms",
    lambda s, d: view(s, d, "queries_v").select("query_id", F.array_join(K.evidence_terms(F.col("query")), "|").alias("terms")),
    f", e AS (SELECT query_id, list_concat(list_concat({_FAC}, list_transform(regexp_extract_all(query, '[A-Za-z0-9][A-Za-z0-9_.+-]{{1,39}}'), lambda x: lower(x))), flatten(list_transform(regexp_extract_all(query, '[\\x{{3400}}-\\x{{9fff}}]{{2,40}}'), lambda g: {_GR}))) AS t FROM queries_v) SELECT query_id, array_to_string(list_filter(t, lambda x, i: list_position(t, x) = i)[1:160], '|') AS terms FROM e",
    "queries_v",
)
_TERMS = ["tion", "and", "ing", "er", "a"]
_add(
    "a05_best_windows",
    lambda s, d: K.best_windows(s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("pair_id"), F.coalesce("text", F.lit("")).alias("content"), F.array(*map(F.lit, _TERMS)).alias("terms")), 300).select("pair_id", "start", F.sha2("window", 256).alias("window_hash")),
    f"""WITH c AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents), o AS (SELECT rid, w, unnest(string_split(t, w)) AS piece, generate_subscripts(string_split(t, w), 1) AS i, len(string_split(t, w)) AS m FROM c CROSS JOIN (SELECT unnest({_TERMS[:4]}) AS w))
, p AS (SELECT rid, i, m, sum(length(piece) + length(w)) OVER (PARTITION BY rid, w ORDER BY i) - length(w) AS pos FROM o), s AS (SELECT DISTINCT rid, greatest(0, least(n - 300, CAST(pos AS BIGINT) - 84)) AS st FROM (SELECT rid, pos FROM p WHERE i < m UNION ALL SELECT rid, 0 FROM c) JOIN c USING (rid))
, k AS (SELECT rid, st, {" + ".join(f"CASE WHEN contains(t[st + 1:st + 300], '{w}') THEN {1_000_000 + len(w) ** 2} ELSE 0 END" for w in _TERMS)} AS score FROM s JOIN c USING (rid)), b AS (SELECT rid, st FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, st) AS r FROM k) WHERE r = 1)
SELECT doc_id AS pair_id, CAST(CASE WHEN n > 300 THEN st ELSE 0 END AS INT) AS start, sha256(CASE WHEN n <= 300 THEN t ELSE concat(CASE WHEN st > 0 THEN '…' ELSE '' END, t[st + CASE WHEN st > 0 THEN 2 ELSE 1 END : st + 300 - CASE WHEN st + 300 < n THEN 1 ELSE 0 END], CASE WHEN st + 300 < n THEN '…' ELSE '' END) END) AS window_hash FROM c JOIN b USING (rid)""",
)


def _evaluated(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    # The lists of the few codes are made once; what profiles take of them is told in joins with small tables.
    pool = settle(J.code_pool(QJ.jobs(s, d), 20).select("code", "id", "rank"), "decision-pool")
    p = QJ.profiles(s, d).select(F.col("profile_id").alias("case_id"), F.col("profile_id").cast("long").alias("k"), J.inferred_code(F.col("major")).alias("code"))
    a = p.join(pool, "code").select("case_id", "id", "rank", "k")
    grade = F.when(F.col("rank") % 5 == 0, "expired").when((F.col("rank") % 5 == 1) & (F.col("k") % 2 == 0), "high-risk").when(F.col("rank") % 5 == 2, "raw-fields-aligned").otherwise("needs-verification")
    assessed = a.select("case_id", "id", grade.alias("qualification"), (F.col("rank") * (F.col("k") % 7)).alias("score"), ((F.col("rank") % 5 == 2) & (F.col("k") % 9 != 0)).alias("all_pass"), (F.col("k") % 8 != 0).alias("late"))
    first = pool.where("rank <= 4").groupBy("code").agg(F.collect_list(F.struct("rank", "id")).alias("first"))
    pick = lambda x: F.struct(F.when(x["rank"] <= 2, "primary").otherwise("steady").alias("tier"), F.when((F.col("k") % 10 == 0) & (x["rank"] == 3), "gone").otherwise(x["id"]).alias("id"))
    portfolio = F.coalesce(F.transform("first", pick), F.array())
    blockers = F.array(F.struct(F.when(F.col("k") % 6 == 0, "at-once").otherwise("after-target-selected").alias("trigger"), F.when(F.col("k") % 4 == 0, "travel").when(F.col("k") % 4 == 1, "resume").alias("product")))
    reports = p.join(first, "code", "left").select("case_id", (F.col("k") % 11 != 0).alias("contract"), (F.col("k") % 100).alias("readiness"), F.array(F.when(F.col("k") % 3 == 0, "其他专业相关方向").otherwise("技术")).alias("directions"), portfolio.alias("portfolio"), blockers.alias("blockers"))
    cases = p.select("case_id", F.lit(20).alias("min_candidates"), F.lit(2).alias("min_primary"), F.when(F.col("k") % 5 == 0, 1).otherwise(0).alias("min_high_risk"), F.lit(10).alias("score_min"), F.lit(80).alias("score_max"), F.when(F.col("k") % 2 == 0, F.array(F.lit("技术"))).otherwise(F.array().cast("array<string>")).alias("directions"))
    return W.evaluate_decisions(cases, reports, a.select("case_id", "id"), assessed), assessed


def _told(s: SparkSession, d: str) -> DataFrame:
    return _evaluated(s, d)[0].select("case_id", F.array_join("failures", ",").alias("failures"), F.array_join("warnings", ",").alias("warnings"))


_W02 = QJ.PAIRS + """, a AS (SELECT profile_id, rank, CAST(profile_id AS BIGINT) AS k, CASE WHEN rank % 5 = 0 THEN 'e' WHEN rank % 5 = 1 AND CAST(profile_id AS BIGINT) % 2 = 0 THEN 'h' WHEN rank % 5 = 2 THEN 'r' ELSE 'v' END AS q FROM pairs WHERE rank <= 20)
, g AS (SELECT profile_id, count(*) AS n, count(*) FILTER (q = 'h') AS hi, count(*) FILTER (q = 'e') AS ex, count(*) FILTER (rank <= 2) AS pr, count(*) FILTER (rank = 1 AND q = 'h') AS ph, count(*) FILTER (rank = 3) AS third, count(*) FILTER (q = 'r') AS al, max(rank * (k % 7)) AS top, count(*) FILTER (rank * (k % 7) = 100 AND NOT (q = 'r' AND k % 9 <> 0)) AS perfect FROM a GROUP BY 1)
, j AS (SELECT profile_id AS case_id, CAST(profile_id AS BIGINT) AS k, coalesce(n, 0) AS n, coalesce(hi, 0) AS hi, coalesce(ex, 0) AS ex, coalesce(pr, 0) AS pr, coalesce(ph, 0) AS ph, coalesce(third, 0) AS third, coalesce(al, 0) AS al, coalesce(top, 0) AS top, coalesce(perfect, 0) AS perfect FROM profiles_v LEFT JOIN g USING (profile_id))
SELECT case_id, concat_ws(',', CASE WHEN k % 11 = 0 THEN 'contract' END, CASE WHEN n < 20 THEN 'candidates' END, CASE WHEN k % 10 = 0 AND third > 0 THEN 'unknown_reference' END, CASE WHEN ph > 0 THEN 'risk_in_portfolio' END, CASE WHEN al > 0 AND k % 9 = 0 THEN 'aligned_without_pass' END, CASE WHEN ex > 0 AND k % 8 = 0 THEN 'expired_without_deadline' END, CASE WHEN top > 100 THEN 'score_range' END,
 CASE WHEN k % 6 = 0 THEN 'early_blocker' END, CASE WHEN k % 4 = 0 THEN 'unknown_product' END, CASE WHEN k % 100 NOT BETWEEN 10 AND 80 THEN 'readiness' END, CASE WHEN k % 2 = 0 AND k % 3 = 0 THEN 'direction' END, CASE WHEN k % 5 = 0 AND hi < 1 THEN 'high_risk' END, CASE WHEN pr < 2 THEN 'primary' END, CASE WHEN perfect > 0 THEN 'perfect_without_pass' END) AS failures, CASE WHEN k % 3 = 0 THEN 'broad_direction' ELSE '' END AS warnings FROM j"""
_add("w02_evaluate_decisions", _told, _W02, "jobs_v", "profiles_v")
_W = _W02.replace("SELECT case_id, concat_ws", ", w AS (SELECT case_id, concat_ws", 1) + ")"
_add(
    "w03_decision_summary",
    lambda s, d: W.decision_summary(_evaluated(s, d)[0]),
    _W + " SELECT count(*) AS cases, count(*) FILTER (failures = '') AS passed, count(*) FILTER (failures <> '') AS failed, count(*) FILTER (regexp_matches(failures, '(^|,)contract(,|$)')) AS infrastructure, count(*) FILTER (failures <> '' AND NOT regexp_matches(failures, '(^|,)contract(,|$)')) AS decision, CAST(sum(len(list_filter(string_split(warnings, ','), lambda x: x <> ''))) AS BIGINT) AS warnings FROM w",
    "jobs_v", "profiles_v",
)
_add(
    "w03_qualification_counts",
    lambda s, d: W.qualification_counts(_evaluated(s, d)[1]).select("case_id", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("counts")),
    QJ.PAIRS + """, q AS (SELECT profile_id AS case_id, CASE WHEN rank % 5 = 0 THEN 'expired' WHEN rank % 5 = 1 AND CAST(profile_id AS BIGINT) % 2 = 0 THEN 'high-risk' WHEN rank % 5 = 2 THEN 'raw-fields-aligned' ELSE 'needs-verification' END AS q FROM pairs WHERE rank <= 20), n AS (SELECT case_id, q, count(*) AS n FROM q GROUP BY ALL) SELECT case_id, string_agg(concat(q, '=', n), ',' ORDER BY q) AS counts FROM n GROUP BY 1""",
    "jobs_v", "profiles_v",
)
_add("z06_error_rate", lambda s, d: Z.error_rate(view(s, d, "sync_events_v")).select(F.col("start").cast("date").cast("string").alias("day"), "events", F.round("rate", 6).alias("rate")), ", w AS (SELECT CAST(CAST(ts AS DATE) - k AS DATE) AS day, kind FROM sync_events_v CROSS JOIN (SELECT unnest([0, 1]) AS k)) SELECT CAST(day AS VARCHAR) AS day, count(*) AS events, round(count(*) FILTER (kind = 'error') / count(*), 6) AS rate FROM w GROUP BY 1", "sync_events_v")
_add(
    "z06_sync_sessions",
    lambda s, d: Z.sync_sessions(view(s, d, "sync_events_v")).select("source_id", F.col("start").cast("string").alias("start"), "events", "errors"),
    ", o AS (SELECT source_id, ts, kind, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 1 HOUR THEN 1 ELSE 0 END AS new FROM sync_events_v WINDOW w AS (PARTITION BY source_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY source_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM o) SELECT source_id, CAST(min(ts) AS VARCHAR) AS start, count(*) AS events, count(*) FILTER (kind = 'error') AS errors FROM s GROUP BY source_id, no",
    "sync_events_v",
)
