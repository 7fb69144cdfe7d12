"""Queries of the corpus operators, with oracle SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from career_lake import rules
from career_lake.operators import corpus as C
from career_lake.plans.bindings import oracle, view
from career_lake.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _add(name: str, f, sql: str | None = None, *views: str) -> None:  # noqa: ANN001
    QUERIES[name] = f
    if sql:
        ORACLES[name] = oracle(sql, *views)


def versions(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "doc_versions_v")


def runs(s: SparkSession, d: str) -> DataFrame:
    ev = view(s, d, "sync_events_v")
    source = ev.groupBy("run_id").agg(F.max("source_id").alias("source_id"), F.min("ts").alias("started_at"))
    return C.sync_run_rollup(ev).join(source, "run_id")


_TR = ", ".join(f"'{k}'" for k in rules.TRACKING_KEYS)
_RX = "'^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:[?]([^#]*))?'"
_HOST = "lower(regexp_replace(regexp_replace(regexp_extract({u}, " + _RX + ", 2), '^.*@', ''), ':[0-9]*$', ''))"
_PORT = "regexp_extract(regexp_extract({u}, " + _RX + ", 2), ':([0-9]+)$', 1)"
_SCH = "lower(regexp_extract({u}, " + _RX + ", 1))"
_QS = "list_sort(list_filter(list_transform(list_filter(string_split(regexp_extract({u}, " + _RX + ", 4), '&'), lambda x: x <> ''), lambda x: {{'k': regexp_extract(x, '^([^=]*)', 1), 'v': regexp_extract(x, '^[^=]*=(.*)$', 1)}}), lambda p: lower(p.k) NOT IN (" + _TR + ")))"
_QT = "array_to_string(list_transform(" + _QS + ", lambda p: concat(p.k, '=', p.v)), '&')"
CANON = (
    "concat(" + _SCH + ", '://', " + _HOST + ", CASE WHEN " + _PORT + " = '' OR (" + _SCH + " = 'http' AND " + _PORT + " = '80') OR (" + _SCH + " = 'https' AND " + _PORT + " = '443') THEN '' ELSE concat(':', " + _PORT + ") END, coalesce(nullif(regexp_extract({u}, " + _RX + ", 3), ''), '/'), CASE WHEN " + _QT + " = '' THEN '' ELSE concat('?', " + _QT + ") END)"
)
_C = CANON.format(u="url")
_add("t01_canonical_urls", lambda s, d: C.page_groups(table(s, d, "pages")), f"SELECT {_C} AS canonical_url, count(*) AS pages, min(page_id) AS first_page FROM pages_v GROUP BY 1", "pages_v")
_add(
    "t02_scope",
    lambda s, d: table(s, d, "pages").select("page_id", C.in_scope(F.col("url"), F.lit("https://site1.example.com/"), F.array(), F.array(F.lit("/"),), F.array(F.lit("/page/1"))).alias("in_scope")),
    f"SELECT page_id, {_HOST.format(u='url')} = 'site1.example.com' AND NOT starts_with(coalesce(nullif(regexp_extract(url, {_RX}, 3), ''), '/'), '/page/1') AS in_scope FROM pages_v",
    "pages_v",
)
_WS = "\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
_NORM = "array_to_string(list_filter(list_transform(string_split_regex(replace({x}, chr(0), ''), '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda l: trim(regexp_replace(l, '[" + _WS.replace("{", "{{").replace("}", "}}") + "]+', ' ', 'g'))), lambda l: l <> ''), chr(10))"
_add("t04_normalise_text", lambda s, d: table(s, d, "documents").select("doc_id", F.sha2(C.normalise_text(F.col("text")), 256).alias("text_hash")), f"SELECT doc_id, sha256({_NORM.format(x='text')}) AS text_hash FROM documents")
_add("t07_duplicates", lambda s, d: C.duplicate_groups(table(s, d, "documents")), "SELECT sha256(text) AS content_hash, count(*) AS documents, min(doc_id) AS first_doc FROM documents GROUP BY 1")
_SIG, _CJK = "[A-Za-z0-9\\x{4e00}-\\x{9fff}]", "[\\x{4e00}-\\x{9fff}]"
_OCR = "array_to_string(list_filter(string_split(" + _NORM.format(x="text") + f", chr(10)), lambda x: x <> '' AND (len(regexp_extract_all(x, '{_CJK}')) > 0 OR len(regexp_extract_all(x, '{_SIG}')) > 1)), chr(10))[1:100000]"
_add("t08_ocr_text", lambda s, d: table(s, d, "documents").select("doc_id", F.sha2(C.normalise_ocr(F.col("text")), 256).alias("text_hash")), f"SELECT doc_id, sha256({_OCR}) AS text_hash FROM documents")
_LN = "list_filter(string_split_regex(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]'), lambda x: x <> '')"
_add(
    "t09_ocr_quality",
    lambda s, d: C.ocr_quality(table(s, d, "documents")).select("doc_id", "characters", "cjk", "lines", F.round("short_ratio", 4).alias("short_ratio"), F.round("signal_ratio", 4).alias("signal_ratio"), "replaced", "score", "needs_review"),
    f""", m AS (SELECT doc_id, CAST(length(text) AS INT) AS characters, CAST(len(regexp_extract_all(text, '{_CJK}')) AS INT) AS cjk, CAST(len({_LN}) AS INT) AS lines, len(list_filter({_LN}, lambda x: len(regexp_extract_all(x, '{_SIG}')) <= 2)) AS short, len(regexp_extract_all(text, '{_SIG}')) AS sig, CAST(len(regexp_extract_all(text, '\\x{{fffd}}')) AS INT) AS replaced FROM documents)
, r AS (SELECT *, CASE WHEN lines > 0 THEN short / lines ELSE 1.0 END AS sr, sig / greatest(characters, 1) AS gr FROM m)
, z AS (SELECT *, CAST(greatest(0, 100 - CASE WHEN characters < 200 THEN 35 WHEN characters < 500 THEN 15 ELSE 0 END - CASE WHEN cjk < 80 THEN 25 WHEN cjk < 200 THEN 10 ELSE 0 END - CASE WHEN sr > 0.35 THEN 25 WHEN sr > 0.20 THEN 10 ELSE 0 END - CASE WHEN gr < 0.45 THEN 15 ELSE 0 END - CASE WHEN replaced > 0 THEN 20 ELSE 0 END) AS INT) AS score FROM r)
SELECT doc_id, characters, cjk, lines, round(sr, 4) AS short_ratio, round(gr, 4) AS signal_ratio, replaced, score, score < 70 AS needs_review FROM z""".replace(", m AS", "WITH m AS", 1),
)
_CMP = "trim(regexp_replace(coalesce({x}, ''), '[" + _WS.replace("{", "{{").replace("}", "}}") + "]+', ' ', 'g'))"
_SG = "regexp_replace(lower({x}), '[^0-9a-z\\x{{3400}}-\\x{{9fff}}]+', '', 'g')"
_TT = f"trim(regexp_replace({_CMP.format(x='title')}, '{rules.PUBLISHER_SUFFIX}', ''))"
_HD, _BD = _SG.format(x=_TT), _SG.format(x=_CMP.format(x="content"))
_GEN = ", ".join(f"'{t}'" for t in rules.GENERIC_TITLES)
ROLE = f"""
, r0 AS (SELECT *, {_TT} AS tt, {_HD} AS hd, {_BD} AS bd, length({_CMP.format(x="content")}) AS cl FROM doc_versions_v)
, roles AS (SELECT * EXCLUDE (tt, hd, bd, cl), CASE WHEN regexp_full_match(tt, 'index(?:_[0-9]+)+(?:\\.s?html?)?', 'i') OR (tt IN ({_GEN}) AND starts_with(lower(regexp_extract(canonical_url, '([^/?]*)(?:[?].*)?$', 1)), 'index')) THEN 'discovery_index'
  WHEN (coalesce(ocr_status, '') IN ('required', 'failed') AND cl < 200) OR bd = '' OR (hd <> '' AND length(bd) < 180 AND length(bd) % length(hd) = 0 AND bd = repeat(hd, length(bd) // length(hd))) THEN 'content_stub' ELSE 'evidence' END AS role FROM r0)
, cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, document_id ORDER BY version_no DESC, version_id) AS p FROM roles) WHERE p = 1)"""
_DV = "doc_versions_v"
_add("q01_roles", lambda s, d: C.with_role(versions(s, d)).select("version_id", "role", F.array_join("reasons", ",").alias("reasons")), ROLE + "SELECT version_id, role, CASE role WHEN 'discovery_index' THEN 'listing_page' WHEN 'content_stub' THEN 'missing_substantive_body' ELSE '' END AS reasons FROM roles", _DV)
_add("q02_role_counts", lambda s, d: C.role_counts(versions(s, d)), ROLE + "SELECT role, count(*) AS documents FROM cur WHERE status = 'active' GROUP BY 1", _DV)
_add("v01_current", lambda s, d: C.current_versions(versions(s, d)).select("source_id", "document_id", "version_id", "version_no", "content_hash"), ROLE + "SELECT source_id, document_id, version_id, version_no, content_hash FROM cur", _DV)


def _new_versions(s: SparkSession, d: str) -> DataFrame:
    v = versions(s, d)
    later = v.where("version_no = 2").withColumn("candidate_order", F.col("version_id").cast("long"))
    return C.append_versions(v.where("version_no = 1"), later.drop("version_no")).select("document_id", "content_hash", "version_no", "changed")


_add(
    "v02_append_versions",
    _new_versions,
    """, a AS (SELECT * FROM doc_versions_v WHERE version_no = 1), b AS (SELECT document_id, content_hash, min(CAST(version_id AS BIGINT)) AS o FROM doc_versions_v WHERE version_no = 2 GROUP BY ALL), n AS (SELECT * FROM b ANTI JOIN a USING (document_id, content_hash))
, l AS (SELECT document_id, max(version_no) AS last_no FROM a GROUP BY 1) SELECT document_id, content_hash, CAST(row_number() OVER (PARTITION BY document_id ORDER BY o) + coalesce(last_no, 0) AS INT) AS version_no, last_no IS NOT NULL AS changed FROM n LEFT JOIN l USING (document_id)""",
    _DV,
)
_add("v08_searchable", lambda s, d: C.searchable(versions(s, d), view(s, d, "sources_v")).select("version_id", "source_id"), ROLE + "SELECT version_id, source_id FROM cur WHERE status = 'active' AND role = 'evidence' AND source_id IN (SELECT source_id FROM sources_v WHERE enabled)", _DV, "sources_v")
RUNS = """
, rr AS (SELECT run_id, max(source_id) AS source_id, min(ts) AS started_at, count(*) FILTER (kind IN ('seen', 'changed')) AS seen, count(*) FILTER (kind = 'changed') AS changed, count(*) FILTER (kind = 'error') AS errors, max(ts) AS finished_at, coalesce(string_agg(message, chr(10) ORDER BY ts, message) FILTER (kind = 'error'), '')[1:4000] AS message FROM sync_events_v GROUP BY 1)
, runs AS (SELECT *, CASE WHEN errors > 0 AND seen = 0 THEN 'failed' WHEN errors > 0 THEN 'partial' ELSE 'success' END AS status FROM rr)"""
_SE = "sync_events_v"
_add("v09_sync_runs", lambda s, d: C.sync_run_rollup(view(s, d, _SE)).drop("finished_at"), RUNS + "SELECT run_id, seen, changed, errors, status, message FROM runs", _SE)
_add(
    "v10_batch_summary",
    lambda s, d: C.batch_summary(runs(s, d), view(s, d, "sources_v"), 5),
    RUNS + """, f AS (SELECT source_id FROM sources_v WHERE enabled ORDER BY 1 LIMIT 5), j AS (SELECT f.source_id AS sid, runs.* FROM f LEFT JOIN runs USING (source_id)) SELECT count(DISTINCT sid) AS sources, count(status) AS runs, count(*) FILTER (status = 'failed') AS failed, CAST(coalesce(sum(seen), 0) AS BIGINT) AS seen, CAST(coalesce(sum(changed), 0) AS BIGINT) AS changed,
 CASE WHEN count(status) = 0 THEN 'noop' WHEN count(*) FILTER (status = 'failed') = count(status) THEN 'failed' WHEN count(*) FILTER (status IN ('failed', 'partial')) > 0 THEN 'completed_with_errors' ELSE 'success' END AS status FROM j""",
    _SE, "sources_v",
)


def _coverage(s: SparkSession, d: str) -> DataFrame:
    return C.source_coverage(view(s, d, "sources_v"), versions(s, d), runs(s, d).withColumn("started_at", F.to_date("started_at")), view(s, d, "reviews_v"), "2024-02-01", 30)


COVER = (
    ROLE + RUNS
    + """
, cv AS (SELECT source_id, count(DISTINCT document_id) AS documents, count(DISTINCT CASE WHEN published_at IS NOT NULL THEN document_id END) AS dated FROM cur GROUP BY 1)
, cs AS (SELECT source_id, max(CAST(started_at AS DATE)) FILTER (status <> 'failed') AS last_synced FROM runs GROUP BY 1)
, cq AS (SELECT source_id, count(*) AS pending_reviews FROM reviews_v WHERE status = 'pending' GROUP BY 1)
, cover AS (SELECT source_id, enabled, tags, coalesce(documents, 0) AS documents, coalesce(dated, 0) AS dated, coalesce(pending_reviews, 0) AS pending_reviews, enabled AND (last_synced IS NULL OR last_synced < DATE '2024-02-01' - 30) AS stale FROM sources_v LEFT JOIN cv USING (source_id) LEFT JOIN cs USING (source_id) LEFT JOIN cq USING (source_id))"""
)
_CV = (_DV, _SE, "reviews_v", "sources_v")
_add("c01_source_coverage", lambda s, d: _coverage(s, d).drop("last_status"), COVER + "SELECT * EXCLUDE (tags) FROM cover", *_CV)
_add(
    "c02_coverage_by_tag",
    lambda s, d: C.coverage_by_tag(view(s, d, "sources_v"), _coverage(s, d)),
    COVER + "SELECT tag, count(*) AS registered, count(*) FILTER (enabled) AS enabled, CAST(sum(documents) AS BIGINT) AS documents FROM (SELECT unnest(string_split(tags, ',')) AS tag, * FROM cover WHERE tags <> '') GROUP BY 1",
    *_CV,
)
_add(
    "c03_coverage_summary",
    lambda s, d: C.coverage_summary(_coverage(s, d)).drop("failing"),
    COVER + "SELECT count(*) AS registered, count(*) FILTER (enabled) AS enabled, count(*) FILTER (documents > 0) AS with_documents, CAST(sum(documents) AS BIGINT) AS documents, CAST(sum(dated) AS BIGINT) AS dated, count(*) FILTER (stale) AS stale, CAST(sum(pending_reviews) AS BIGINT) AS pending_reviews FROM cover",
    *_CV,
)
_add(
    "c04_corpus_stats",
    lambda s, d: C.corpus_stats(view(s, d, "sources_v"), versions(s, d), view(s, d, "reviews_v"), runs(s, d)),
    ROLE + RUNS + """SELECT (SELECT count(*) FROM sources_v) AS sources, (SELECT count(*) FROM sources_v WHERE enabled) AS enabled_sources, (SELECT count(*) FROM doc_versions_v) AS versions, (SELECT count(*) FROM cur) AS documents, (SELECT count(*) FROM cur WHERE status = 'active') AS documents_active, (SELECT count(*) FROM cur WHERE status = 'review_pending') AS documents_review_pending,
 (SELECT count(*) FROM cur WHERE status = 'superseded') AS documents_superseded, (SELECT count(*) FROM reviews_v WHERE status = 'pending') AS pending_reviews, (SELECT count(*) FROM reviews_v WHERE status = 'resolved') AS resolved_reviews, (SELECT count(*) FROM runs) AS runs, (SELECT count(*) FROM runs WHERE status = 'failed') AS failed_runs""",
    *_CV,
)


def _enqueued(s: SparkSession, d: str) -> DataFrame:
    r = view(s, d, "reviews_v").withColumn("document_id", F.lit(None).cast("string")).withColumn("payload", F.create_map(F.lit("runId"), F.col("created_at")))
    again = F.concat("message", F.when(F.col("created_at").cast("long") % 2 == 0, "").otherwise(" again"))
    return C.enqueue_reviews(r, r.withColumn("message", again)).select("source_id", "kind", "message")


_add(
    "r01_enqueue_reviews",
    _enqueued,
    "SELECT DISTINCT source_id, kind, message FROM (SELECT source_id, kind, concat(message, CASE WHEN CAST(created_at AS BIGINT) % 2 = 0 THEN '' ELSE ' again' END) AS message FROM reviews_v) a WHERE NOT EXISTS (SELECT 1 FROM reviews_v b WHERE b.status = 'pending' AND a.source_id = b.source_id AND a.kind = b.kind AND a.message = b.message)",
    "reviews_v",
)
_add(
    "r02_resolve_reviews",
    lambda s, d: C.resolve_reviews(view(s, d, "reviews_v"), view(s, d, "doc_versions_v").select(F.col("version_id").alias("document_id"), F.when(F.col("status") == "active", "content_quality").otherwise("fact_change").alias("kind"))).groupBy("kind", "status").agg(F.count("*").alias("reviews")),
    "SELECT r.kind, CASE WHEN r.status = 'pending' AND v.version_id IS NOT NULL THEN 'resolved' ELSE r.status END AS status, count(*) AS reviews FROM reviews_v r LEFT JOIN doc_versions_v v ON v.version_id = r.document_id AND r.kind = CASE WHEN v.status = 'active' THEN 'content_quality' ELSE 'fact_change' END GROUP BY ALL",
    "reviews_v", _DV,
)


def _mappings(s: SparkSession, d: str, no: int) -> DataFrame:
    n = F.col("version_id").cast("long")
    return versions(s, d).where(F.col("version_no") == no).select("document_id", F.when(n % 4 != 0, F.concat(F.lit("r"), "version_id")).alias("remote_id"), F.when(n % 3 != 0, F.concat(F.lit("b"), "version_id")).alias("batch_id"), "content_hash", F.when(n % 5 == 0, "error").when(n % 5 == 1, "pending").otherwise("synced").alias("status"))


def _map_sql(no: int) -> str:
    return f"SELECT document_id, CASE WHEN CAST(version_id AS BIGINT) % 4 <> 0 THEN concat('r', version_id) END AS remote_id, CASE WHEN CAST(version_id AS BIGINT) % 3 <> 0 THEN concat('b', version_id) END AS batch_id, content_hash, CASE CAST(version_id AS BIGINT) % 5 WHEN 0 THEN 'error' WHEN 1 THEN 'pending' ELSE 'synced' END AS status FROM doc_versions_v WHERE version_no = {no}"


MAPS = f", m1 AS ({_map_sql(1)}), m2 AS ({_map_sql(2)})"
_add(
    "m01_upsert_mappings",
    lambda s, d: C.upsert_mappings(_mappings(s, d, 1), _mappings(s, d, 2)),
    MAPS + "SELECT document_id, coalesce(m2.remote_id, m1.remote_id) AS remote_id, coalesce(m2.batch_id, m1.batch_id) AS batch_id, CASE WHEN m2.status IS NOT NULL THEN m2.content_hash ELSE m1.content_hash END AS content_hash, CASE WHEN m2.status IS NOT NULL THEN m2.status ELSE m1.status END AS status FROM m1 FULL JOIN m2 USING (document_id)",
    _DV,
)
_add(
    "m02_needs_sync",
    lambda s, d: C.needs_sync(C.searchable(versions(s, d), view(s, d, "sources_v")), _mappings(s, d, 1)).select("document_id", "version_id"),
    ROLE + MAPS + "SELECT document_id, version_id FROM cur LEFT JOIN (SELECT document_id, content_hash AS h, status AS st FROM m1) USING (document_id) WHERE status = 'active' AND role = 'evidence' AND source_id IN (SELECT source_id FROM sources_v WHERE enabled) AND (st IS NULL OR st <> 'synced' OR h <> content_hash)",
    _DV, "sources_v",
)


def _queued(s: SparkSession, d: str) -> DataFrame:
    q = _mappings(s, d, 1).join(C.current_versions(versions(s, d)).select("document_id", F.col("content_hash").alias("current_hash")), "document_id")
    n = F.col("version_id").cast("long")
    feed = versions(s, d).where(n % 7 != 0).select(F.concat(F.lit("r"), "version_id").alias("remote_id"), F.when(n % 6 == 0, "error").when(n % 6 == 1, "indexing").when(n % 6 == 2, "paused").otherwise("completed").alias("remote_status"))
    return C.reconcile_mappings(q.select("document_id", "remote_id", "content_hash", "current_hash"), feed)


_M03 = ROLE + MAPS + """, fd AS (SELECT concat('r', version_id) AS remote_id, CASE CAST(version_id AS BIGINT) % 6 WHEN 0 THEN 'error' WHEN 1 THEN 'indexing' WHEN 2 THEN 'paused' ELSE 'completed' END AS rs FROM doc_versions_v WHERE CAST(version_id AS BIGINT) % 7 <> 0)
, q AS (SELECT m1.document_id, m1.remote_id, m1.content_hash AS h, cur.content_hash AS ch FROM m1 JOIN cur USING (document_id)), rc AS (SELECT document_id, remote_id, CASE WHEN rs IS NULL THEN 'error' WHEN rs = 'completed' AND h = ch THEN 'synced' WHEN rs IN ('completed', 'error', 'paused') THEN 'error' ELSE 'pending' END AS status, CASE WHEN rs IS NULL THEN 'missing' WHEN rs = 'completed' AND h <> ch THEN 'stale' WHEN rs IN ('error', 'paused') THEN rs END AS reason FROM q LEFT JOIN fd USING (remote_id))"""
_add("m03_reconcile_mappings", lambda s, d: _queued(s, d).select("document_id", "status", "reason"), _M03 + " SELECT document_id, status, reason FROM rc", _DV)
_add(
    "m03_mapping_reviews",
    lambda s, d: C.mapping_reviews(_queued(s, d)).select("document_id", "kind", "message", F.element_at("payload", F.lit("remoteDocumentId")).alias("remote_id"), F.element_at("payload", F.lit("indexingStatus")).alias("index_status")),
    _M03 + f" SELECT document_id, 'index_failure' AS kind, CASE reason {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {chr(39)}{v}{chr(39)}' for k, v in C.FAILED_MAPPINGS.items())} END AS message, remote_id, CASE WHEN reason IN ('error', 'paused') THEN reason END AS index_status FROM rc WHERE status = 'error'",
    _DV,
)
_add("m03_run_summary", lambda s, d: C.reconcile_summary(_queued(s, d)), _M03 + " SELECT CASE WHEN count(*) = 0 THEN 'noop' WHEN count(*) FILTER (status = 'error') > 0 THEN 'completed-with-errors' ELSE 'success' END AS run_status, count(*) AS selected, count(*) FILTER (status = 'synced') AS synced, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'error') AS failed FROM rc", _DV)


def _url_reviews(s: SparkSession, d: str) -> DataFrame:
    """Reviews with the URL of their document; runs settle those of versions that are active."""
    queue = view(s, d, "reviews_v").withColumn("url", F.concat(F.lit("https://h/"), (F.col("document_id").cast("long") % 50).cast("string")))
    done = view(s, d, "doc_versions_v").where("status = 'active'").select(F.concat(F.lit("src"), (F.col("version_id").cast("long") % 20).cast("string")).alias("source_id"), F.lit(" content_quality").alias("kind"), F.concat(F.lit("https://h/"), (F.col("document_id").cast("long") % 50).cast("string")).alias("url"))
    return C.resolve_url_reviews(queue, done)


_add(
    "r02_resolve_url_reviews",
    lambda s, d: _url_reviews(s, d).select("document_id", "kind", "url", "status"),
    ", r AS (SELECT *, concat('https://h/', CAST(CAST(document_id AS BIGINT) % 50 AS VARCHAR)) AS url FROM reviews_v), a AS (SELECT DISTINCT concat('src', CAST(CAST(version_id AS BIGINT) % 20 AS VARCHAR)) AS source_id, concat('https://h/', CAST(CAST(document_id AS BIGINT) % 50 AS VARCHAR)) AS url FROM doc_versions_v WHERE status = 'active') SELECT document_id, kind, r.url, CASE WHEN status = 'pending' AND kind = 'content_quality' AND a.url IS NOT NULL THEN 'resolved' ELSE status END AS status FROM r LEFT JOIN a USING (source_id, url)",
    "reviews_v", _DV,
)
_add(
    "m04_retry_plan",
    lambda s, d: C.retry_plan(_mappings(s, d, 1).where("status = 'error'").select("document_id"), C.with_role(C.current_versions(versions(s, d))).join(view(s, d, "sources_v").select("source_id", "enabled"), "source_id").select("document_id", "enabled", "status", "role", (F.col("version_no") == 9).alias("fact_review"), F.coalesce(F.col("ocr_status") == "required", F.lit(False)).alias("ocr_review")), view(s, d, "reviews_v").where("status = 'pending'")),
    ROLE + MAPS + """, k AS (SELECT m1.document_id, cur.status AS st, role, enabled, coalesce(ocr_status = 'required', false) AS ocr, m1.document_id IN (SELECT document_id FROM reviews_v WHERE status = 'pending') AS held FROM m1 LEFT JOIN cur USING (document_id) LEFT JOIN sources_v ON cur.source_id = sources_v.source_id WHERE m1.status = 'error')
, w AS (SELECT document_id, CASE WHEN st IS NULL THEN 'missing' WHEN NOT enabled THEN 'source_disabled' WHEN st <> 'active' THEN 'inactive' WHEN held THEN 'cross_review' WHEN ocr THEN 'ocr_review' WHEN role <> 'evidence' THEN 'not_evidence' END AS reason FROM k) SELECT document_id, CASE WHEN reason IS NULL THEN 'requeue' ELSE 'blocked' END AS plan, reason FROM w""",
    _DV, "reviews_v", "sources_v",
)
