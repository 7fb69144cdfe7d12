"""Queries of handed-over snapshots, products and the market report, with oracle SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from career_lake import rules
from career_lake.operators import contracts as B
from career_lake.operators import report as R
from career_lake.plans import queries_jobs as QJ
from career_lake.plans.bindings import NOW, VIEWS, oracle, view

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
SOURCE, VERSION = "main-site", "3"

VIEWS |= {
    "snapshots_v": """
SELECT CAST(c_custkey AS STRING) AS snapshot_id, c_custkey, CASE WHEN c_custkey % 29 = 0 THEN 'no json' ELSE translate(concat(
  '⟨"source":"', CASE WHEN c_custkey % 23 = 0 THEN 'elsewhere' ELSE 'main-site' END, '","schemaVersion":"', CASE WHEN c_custkey % 19 = 0 THEN '2' ELSE '3' END,
  '","privacy":⟨"mode":"', CASE WHEN c_custkey % 17 = 0 THEN 'silent' ELSE 'explicit-user-handoff' END, '","persistence":"none-at-source"⟩',
  CASE WHEN c_custkey % 13 = 0 THEN '' ELSE concat(',"access":⟨"features":[⟨"code":"resume_ai","name":"简历优化","routePath":"/resume","allowed":true,"dailyLimit":', CAST(c_custkey % 7 - 2 AS STRING),
    '⟩,⟨"code":"mock","name":"模拟面试","routePath":"//evil","allowed":true⟩,⟨"code":"job_push","name":"岗位推送 ","routePath":"/push","allowed":', CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END,
    ',"dailyLimit":900000⟩,⟨"code":"interview.pro","name":"面试","routePath":"/i","allowed":true⟩,⟨"code":"resume_ai","name":"again","routePath":"/again","allowed":true⟩,⟨"code":"x y","name":"简历","routePath":"/x","allowed":true⟩],"legacyMembership":⟨"status":"',
    CASE c_custkey % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'odd' ELSE 'expired' END, '"', CASE WHEN c_custkey % 5 = 0 THEN ',"effectiveTier":"vip"' ELSE '' END, '⟩⟩') END,
  ',"workspace":⟨"persistence":"agent-owned","purpose":"career-path-state","subject":"ws1_', CASE WHEN c_custkey % 11 = 0 THEN 'short' ELSE concat('abcdefghijklmnopqrstuvwxyz-_0123456', lpad(CAST(c_custkey AS STRING), 8, '0')) END, '"', CASE WHEN c_custkey % 31 = 0 THEN ',"more":"1"' ELSE '' END, '⟩',
  ',"profile":⟨"education":⟨"university":"', CASE WHEN c_custkey % 7 = 0 THEN ' ' ELSE c_name END, '","universityTier":"', CASE c_custkey % 5 WHEN 0 THEN '985高校' WHEN 1 THEN '双一流建设' WHEN 2 THEN '境外' WHEN 3 THEN '高职院校' ELSE '' END,
  '","educationLevel":"', CASE c_custkey % 6 WHEN 0 THEN '博士' WHEN 1 THEN '硕士研究生' WHEN 2 THEN '本科' WHEN 3 THEN '大专' WHEN 4 THEN '中专' ELSE '其他' END, '","major":"会计学","graduateYear":"', CASE WHEN c_custkey % 8 = 0 THEN '待定' ELSE concat(CAST(2025 + c_custkey % 4 AS STRING), '届') END,
  '"⟩,"targets":⟨"locations":["北京","上海"],"industries":[', CASE WHEN c_custkey % 2 = 0 THEN '"能源"' ELSE '' END, '],"positions":[', CASE WHEN c_custkey % 3 = 0 THEN '"会计"' ELSE '' END, ']⟩,"experience":⟨"projects":[', CASE WHEN c_custkey % 2 = 0 THEN '⟨"t":"p"⟩' ELSE '' END,
  '],"internships":[]⟩,"capabilities":⟨"awards":["奖"],"certificates":[]⟩,"resume":⟨"available":', CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END, CASE WHEN c_custkey % 37 = 0 THEN ',"phone":"1"' ELSE '' END, '⟩',
  CASE WHEN c_custkey % 41 = 0 THEN ',"rows":[⟨"k":1⟩,⟨"email":⟨"openId":"o"⟩⟩]' ELSE '' END, '⟩⟩'), '⟨⟩', concat(chr(123), chr(125))) END AS snapshot
FROM {customer}""",
    "products_v": """
SELECT CASE WHEN p_partkey % 31 = 0 THEN ' ' ELSE CAST(p_partkey AS STRING) END AS id, p_name AS name, CASE WHEN p_partkey % 17 = 0 THEN 'Bad Slug' ELSE concat('p-', CAST(p_partkey AS STRING)) END AS slug, CASE p_partkey % 5 WHEN 0 THEN 'vip' WHEN 1 THEN 'svip' WHEN 2 THEN 'gold' ELSE 'normal' END AS grant_level,
       CASE p_partkey % 4 WHEN 0 THEN '简历与面试' WHEN 1 THEN '网申指导' WHEN 2 THEN '其他' ELSE NULL END AS description, CASE p_partkey % 6 WHEN 0 THEN '0' WHEN 1 THEN '1234.50' WHEN 2 THEN 'free' WHEN 3 THEN '19.9' ELSE NULL END AS monthly_price,
       CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size * 1000 AS STRING) ELSE NULL END AS quarterly_price, CAST(NULL AS STRING) AS yearly_price, CASE WHEN p_partkey % 3 = 0 THEN '88.00' ELSE '-1' END AS lifetime_price, CASE WHEN p_partkey % 7 = 0 THEN '岗位匹配' ELSE '' END AS feature
FROM {part}""",
}


def _add(name: str, f, sql: str, *views: str) -> None:  # noqa: ANN001
    QUERIES[name] = f
    ORACLES[name] = oracle(sql, *views)


def snapshots(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "snapshots_v").select("snapshot_id", "snapshot")


_KEYS = ", ".join(f"'{k}'" for k in rules.FORBIDDEN_KEYS)
_FOUND = f", ok AS (SELECT * FROM snapshots_v WHERE c_custkey % 29 <> 0), ff AS (SELECT snapshot_id, replace(t.fullkey, '$', 'root') AS path FROM ok, json_tree(ok.snapshot) t WHERE t.key IN ({_KEYS}))"
_add("b01_forbidden_keys", lambda s, d: B.forbidden_keys(snapshots(s, d)).select("snapshot_id", "path"), _FOUND + " SELECT snapshot_id, path FROM ff", "snapshots_v")
_add(
    "b02_profile_contract",
    lambda s, d: B.profile_contract(snapshots(s, d), SOURCE, VERSION),
    _FOUND + """, v AS (SELECT s.*, CASE WHEN c_custkey % 29 = 0 THEN 'format' WHEN snapshot_id IN (SELECT snapshot_id FROM ff) THEN 'forbidden_fields' WHEN c_custkey % 23 = 0 THEN 'source' WHEN c_custkey % 19 = 0 THEN 'version' WHEN c_custkey % 17 = 0 THEN 'privacy' WHEN c_custkey % 13 = 0 THEN 'access' WHEN c_custkey % 11 = 0 OR c_custkey % 31 = 0 THEN 'workspace' END AS violation FROM snapshots_v s)
 SELECT snapshot_id, violation, CASE WHEN violation IS NULL THEN json_extract_string(snapshot, '$.workspace.subject') END AS subject FROM v""",
    "snapshots_v",
)
_add(
    "b03_normalise_profiles",
    lambda s, d: B.normalise_profiles(snapshots(s, d)),
    """, e AS (SELECT *, json_extract_string(snapshot, '$.profile.education.university') AS u, json_extract_string(snapshot, '$.profile.education.universityTier') AS ut, json_extract_string(snapshot, '$.profile.education.educationLevel') AS el, json_extract_string(snapshot, '$.profile.education.graduateYear') AS gy FROM (SELECT c_custkey, snapshot_id, nullif(snapshot, 'no json') AS snapshot FROM snapshots_v) WHERE snapshot IS NOT NULL)
SELECT snapshot_id, trim(u) AS school, CASE WHEN regexp_matches(ut, '985|211') THEN '985 / 211' WHEN contains(ut, '双一流') THEN '双一流' WHEN regexp_matches(ut, '海外|境外') THEN '海外院校' WHEN regexp_matches(ut, '高职|专科') THEN '高职高专' ELSE '普通本科' END AS school_tier,
 CASE WHEN contains(el, '博士') THEN 'doctorate' WHEN contains(el, '硕士') THEN 'master' WHEN contains(el, '本科') THEN 'bachelor' WHEN contains(el, '大专') THEN 'associate' WHEN contains(el, '中专') THEN 'vocational' ELSE 'unknown' END AS degree_level, '会计学' AS major, CAST(regexp_extract(gy, '20\\d\\d') AS INT) AS graduation_year, '北京、上海' AS preferred_cities,
 CASE WHEN c_custkey % 6 = 0 THEN '能源、会计' WHEN c_custkey % 2 = 0 THEN '能源' WHEN c_custkey % 3 = 0 THEN '会计' ELSE '央企 / 国企校招' END AS target_sector, CASE WHEN c_custkey % 2 = 0 THEN 'ready' ELSE 'missing' END AS resume, 'missing' AS application, 'missing' AS interview, CASE WHEN c_custkey % 2 = 0 THEN 'developing' ELSE 'missing' END AS project_evidence,
 'missing' AS internship, 'developing' AS competition, 'missing' AS qualification FROM e WHERE trim(u) <> '' AND regexp_extract(gy, '20\\d\\d') <> ''""",
    "snapshots_v",
)
_add(
    "b04_entitlements",
    lambda s, d: B.entitlements(snapshots(s, d)),
    """, a AS (SELECT * FROM snapshots_v WHERE c_custkey % 29 <> 0 AND c_custkey % 13 <> 0), f AS (SELECT snapshot_id, 1 AS p, 'resume_ai' AS code, '简历优化' AS name, 'resume' AS category, '/resume' AS route, CASE WHEN c_custkey % 7 >= 1 THEN c_custkey % 7 - 2 END AS daily_limit FROM a
 UNION ALL SELECT snapshot_id, 2, 'job_push', '岗位推送', 'application', '/push', 100000 FROM a WHERE c_custkey % 2 = 0 UNION ALL SELECT snapshot_id, 3, 'interview.pro', '面试', 'interview', '/i', NULL FROM a)
SELECT snapshot_id, code, name, category, route, CAST(daily_limit AS BIGINT) AS daily_limit, CAST(row_number() OVER (PARTITION BY snapshot_id ORDER BY p) AS INT) AS k FROM f""",
    "snapshots_v",
)
_add("b04_membership", lambda s, d: B.membership(snapshots(s, d)), "SELECT snapshot_id, CASE WHEN c_custkey % 5 = 0 AND c_custkey % 13 <> 0 AND c_custkey % 29 <> 0 THEN 'vip' ELSE 'free' END AS tier, CASE WHEN c_custkey % 13 = 0 OR c_custkey % 29 = 0 THEN 'none' WHEN c_custkey % 3 = 0 THEN 'active' WHEN c_custkey % 3 = 2 THEN 'expired' ELSE 'none' END AS status FROM snapshots_v", "snapshots_v")


def _products(s: SparkSession, d: str) -> DataFrame:
    p = view(s, d, "products_v")
    return B.normalise_products(p.withColumn("features", F.array(F.struct(F.nullif("feature", F.lit("")).alias("title"), F.lit(None).cast("string").alias("description")))))


_PRICE = "CASE WHEN {c} IS NULL OR NOT regexp_full_match({c}, '\\d{{1,9}}(\\.\\d{{1,2}})?') THEN NULL WHEN CAST({c} AS DECIMAL(11, 2)) = 0 THEN '免费{s}' ELSE concat('¥', regexp_replace(regexp_replace(format('{{:,.2f}}', CAST({c} AS DOUBLE)), '\\.00$', ''), '(\\.\\d)0$', '\\1'), '{s}') END"
_add(
    "n07_product_offerings",
    lambda s, d: B.product_offerings(_products(s, d)),
    f""", q AS (SELECT *, coalesce({", ".join(_PRICE.format(c=c, s=x) for c, x in B.PRICES)}, '价格以主站为准') AS price, concat_ws(' ', name, description, feature) AS t FROM products_v WHERE trim(id) <> '' AND slug <> 'Bad Slug' AND grant_level <> 'gold')
, c AS (SELECT *, unnest(list_filter([CASE WHEN contains(t, '简历') THEN 'resume' END, CASE WHEN regexp_matches(t, '网申|投递|岗位推送|岗位匹配') THEN 'application' END, CASE WHEN contains(t, '面试') THEN 'interview' END], lambda x: x IS NOT NULL)) AS category FROM q) SELECT concat(id, ':', category) AS offering_id, id AS product_id, name, category, price FROM c""",
    "products_v",
)
_SCHOOL = "CASE CAST(profile_id AS BIGINT) % 4 WHEN 0 THEN '天津 大学' WHEN 1 THEN 'TJU' WHEN 2 THEN '某某学院' ELSE ' ' END"


def profiles(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "profiles_v").withColumn("school", F.expr(_SCHOOL))


_LVT = "CASE coalesce({k}, 'missing') WHEN 'missing' THEN '尚未开始' WHEN 'developing' THEN '已有基础' ELSE '可直接使用' END"
_DEG = "CASE degree_level " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.DEGREE_TEXTS.items()) + " END"
_PREF = "coalesce(nullif(trim(coalesce(preferred_cities, '')), ''), nullif(trim(coalesce(city, '')), ''))"
_PS = f", ps AS (SELECT *, {_SCHOOL} AS school FROM profiles_v)"
_add(
    "p10_qualification_matrix",
    lambda s, d: R.qualification_matrix(profiles(s, d)),
    _PS + "".join(f"{' UNION ALL ' if i else ' '}SELECT profile_id, {i} AS place, '{item}' AS item, {v} AS value, {st} AS status FROM ps" for i, (item, v, st) in enumerate([
        ("school", "coalesce(nullif(trim(school), ''), '待补充')", "CASE WHEN trim(school) = '' THEN 'missing' ELSE 'known' END"), ("degree", _DEG, "CASE WHEN degree_level = 'unknown' THEN 'missing' ELSE 'known' END"),
        ("major", "major", "'known'"), ("graduation-year", "concat(CAST(graduation_year AS VARCHAR), ' 届')", "'known'"), ("location", f"coalesce({_PREF}, '待补充')", f"CASE WHEN {_PREF} IS NULL THEN 'missing' ELSE 'known' END"),
        *((k, _LVT.format(k=k), f"coalesce({k}, 'missing')") for k in rules.MATRIX_ROWS),
    ])),
    "profiles_v",
)
_ACTS = ", ".join(f"{{'r': CASE coalesce({k}, 'missing') WHEN 'missing' THEN 0 WHEN 'developing' THEN 1 ELSE 2 END, 'o': {i}, 'c': '{k}', 't': '{t}', 'p': CASE coalesce({k}, 'missing') WHEN 'missing' THEN 'high' ELSE 'medium' END, 'h': {h}}}" for i, (k, t, h) in enumerate(rules.REPORT_ACTIONS))
_FALL = ", ".join(f"{{'r': 3, 'o': {i}, 'c': '{k}', 't': '{t}', 'p': '{p}', 'h': {h}}}" for i, (k, t, h, p) in enumerate(rules.FALLBACK_ACTIONS))
_add(
    "p11_action_ranking",
    lambda s, d: R.action_ranking(profiles(s, d)),
    f", u AS (SELECT profile_id, unnest([{_ACTS}, {_FALL}]) AS a FROM profiles_v), k AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY a.r, a.o) AS place FROM u WHERE a.r <> 2) SELECT profile_id, CAST(place AS INT) AS place, a.c AS capability, a.t AS title, a.p AS priority, a.h AS hours FROM k WHERE place <= 3",
    "profiles_v",
)


def _schools(s: SparkSession) -> DataFrame:
    return s.sql("SELECT '天津大学' AS school_name, array('天大', 'tju') AS aliases, '法学' AS major_name, array('会计 学', '自动化') AS major_aliases")


_add(
    "p13_school_lookup",
    lambda s, d: R.school_lookup(profiles(s, d), _schools(s)),
    _PS + ", x AS (SELECT *, trim(school) AS own, CAST(profile_id AS BIGINT) % 4 < 2 AS known FROM ps) SELECT profile_id, CASE WHEN known AND major IN ('法学', '会计学', '自动化') THEN 'available' ELSE 'unavailable' END AS status, CASE WHEN own = '' THEN 'no_school' WHEN NOT known THEN 'school_unknown' WHEN major NOT IN ('法学', '会计学', '自动化') THEN 'major_unknown' END AS reason, CASE WHEN known THEN '天津大学' ELSE own END AS school_name FROM x",
    "profiles_v",
)


def _assessed(s: SparkSession, d: str) -> DataFrame:
    p, k = profiles(s, d), F.col("profile_id").cast("long")
    known = R.school_lookup(p, _schools(s)).select("profile_id", (F.col("status") == "available").alias("school_known"))
    return R.assessment(p.join(known, "profile_id").withColumns({"strict_total": k % 3, "targeted_total": k % 2, "preferred_count": k % 5}), NOW)


_add(
    "p12_assessment",
    lambda s, d: _assessed(s, d).withColumn("strengths", F.array_join("strengths", ",")).withColumn("constraints", F.array_join("constraints", ",")),
    _PS + f""", x AS (SELECT *, CAST(profile_id AS BIGINT) AS k, coalesce(CAST(profile_id AS BIGINT) % 4 < 2 AND major IN ('法学', '会计学', '自动化'), false) AS sk FROM ps)
, y AS (SELECT *, list_filter([CASE WHEN sk THEN 'school' END, CASE WHEN k % 3 > 0 THEN 'entry' END, CASE WHEN graduation_year > {NOW[:4]} THEN 'window' END], lambda v: v IS NOT NULL) AS st,
  list_concat(list_concat(list_filter([CASE WHEN NOT sk AND trim(school) <> '' THEN 'school' END, CASE WHEN k % 3 = 0 AND k % 2 > 0 THEN 'unverified' END], lambda v: v IS NOT NULL), list_filter([{", ".join(f"CASE WHEN coalesce({c}, 'missing') <> 'ready' THEN 'gap:{c}' END" for c in rules.MATRIX_ROWS)}], lambda v: v IS NOT NULL)[1:2]),
  CASE WHEN (coalesce(preferred_cities, '') LIKE '%北京%' OR coalesce(preferred_cities, '') LIKE '%杭州%' OR (preferred_cities IS NULL AND city IS NOT NULL)) AND k % 5 = 0 THEN ['city'] ELSE [] END) AS co FROM x)
, z AS (SELECT *, CASE WHEN len(st) = 0 THEN ['basics'] ELSE st END AS s2, CASE WHEN len(co) = 0 THEN ['no_direction'] ELSE co END AS c2 FROM y)
SELECT profile_id, array_to_string(s2[1:3], ',') AS strengths, CAST(len(s2) AS INT) AS n_strengths, array_to_string(c2[1:3], ',') AS constraints, CAST(len(c2) AS INT) AS n_constraints, greatest({NOW[:4]}, graduation_year - 1) AS autumn_year FROM z""",
    "profiles_v",
)


def _paths(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = QJ.profiles(s, d)
    k = F.col("profile_id").cast("long")
    paths = p.select(F.col("profile_id").alias("path_id"), (k % 3 != 0).alias("live"), (k % 2 == 0).alias("report_live"), F.when(k % 5 == 0, F.lit("x")).alias("selected_id"))
    return paths, QJ.pairs(s, d).where("rank <= 12").select(F.col("profile_id").alias("path_id"), "id", "company_name", "apply_end_date")


_add(
    "d09_decision_layers",
    lambda s, d: R.decision_layers(*_paths(s, d)),
    QJ.PAIRS + """, n AS (SELECT profile_id, count(DISTINCT id) AS n, count(DISTINCT nullif(trim(company_name), '')) AS companies, count(DISTINCT id) FILTER (apply_end_date IS NOT NULL) AS deadlines FROM pairs WHERE rank <= 12 GROUP BY 1)
, j AS (SELECT profile_id AS path_id, CAST(profile_id AS BIGINT) AS k, coalesce(n, 0) AS n, coalesce(companies, 0) AS companies, coalesce(deadlines, 0) AS deadlines FROM profiles_v LEFT JOIN n USING (profile_id)), l AS (SELECT *, k % 3 <> 0 AND n > 0 AS live FROM j)
SELECT path_id, CASE WHEN live AND k % 2 = 0 THEN 'live' WHEN live THEN 'partial' ELSE 'pending' END AS data, CASE WHEN live THEN 'ready' ELSE 'provisional' END AS route, CASE WHEN live OR k % 5 = 0 THEN 'prepare-and-verify' ELSE 'structure-only' END AS decision, n, companies, deadlines FROM l""",
    "jobs_v", "profiles_v",
)


def _events(s: SparkSession, d: str) -> DataFrame:
    p = QJ.pairs(s, d).where("rank <= 9")
    return p.select("profile_id", F.col("id").alias("event_id"), F.when(F.col("profile_id").cast("long") % 4 != 0, F.col("apply_end_date")).alias("date"), F.col("rank").alias("place"))


_SEA = "CASE WHEN {d} IS NOT NULL THEN concat(CAST(year({d}) AS VARCHAR), ' ', CASE WHEN month({d}) BETWEEN 3 AND 5 THEN '春' WHEN month({d}) BETWEEN 6 AND 8 THEN '夏' WHEN month({d}) BETWEEN 9 AND 11 THEN '秋' ELSE '冬' END) END"
_add(
    "n09_season_chapters",
    lambda s, d: R.season_chapters(_events(s, d)).withColumn("date", F.col("date").cast("string")),
    QJ.PAIRS + f", e AS (SELECT profile_id, id AS event_id, CASE WHEN CAST(profile_id AS BIGINT) % 4 <> 0 THEN apply_end_date END AS date, rank AS place FROM pairs WHERE rank <= 9), w AS (SELECT *, min(date) OVER (PARTITION BY profile_id) AS d0, ceil(count(*) OVER (PARTITION BY profile_id) / 2) AS half, row_number() OVER (PARTITION BY profile_id ORDER BY place, event_id) AS k FROM e) SELECT profile_id, event_id, CAST(date AS VARCHAR) AS date, {_SEA.format(d='d0')} AS season, CASE WHEN (d0 IS NOT NULL AND coalesce({_SEA.format(d='date')} = {_SEA.format(d='d0')}, false)) OR (d0 IS NULL AND k <= half) THEN 1 ELSE 2 END AS chapter FROM w",
    "jobs_v", "profiles_v",
)


def _wanted(s: SparkSession, d: str) -> DataFrame:
    return QJ.profiles(s, d).select("profile_id", F.expr("CASE degree_level WHEN 'doctorate' THEN '博士' WHEN 'master' THEN '硕士' WHEN 'associate' THEN '大专' ELSE '本科' END").alias("degree_text"), "graduation_year", F.array(F.substring("major", 1, 2), F.lit("电气"), F.lit("岗")).alias("keywords"))


_REL = QJ.JOBS_N + f"""
, jx AS (SELECT id, apply_end_date, coalesce(education_level, '') AS edu, coalesce(graduate_year, '') AS yr, lower(concat_ws(' ', job_title, major_requirements)) AS t FROM jobs_n WHERE company_type IN ('央企', '国企') AND job_type IN ('校招', '实习') AND (apply_end_date IS NULL OR apply_end_date >= DATE '{NOW}'))
, px AS (SELECT profile_id, CASE degree_level WHEN 'doctorate' THEN '博士' WHEN 'master' THEN '硕士' WHEN 'associate' THEN '大专' ELSE '本科' END AS dt, CAST(graduation_year AS VARCHAR) AS gy, major[1:2] AS w FROM profiles_v)
, fx AS (SELECT profile_id, id, apply_end_date, contains(t, w) OR contains(t, '电气') OR contains(t, '岗') AS hit FROM px JOIN jx ON (edu = '' OR contains(edu, '不限') OR contains(edu, dt)) AND (yr = '' OR contains(yr, '不限') OR contains(yr, gy)))"""  # fmt: skip
_add("l05_relevant_totals", lambda s, d: R.relevant_pool(QJ.jobs(s, d), _wanted(s, d), NOW)[0], _REL + ", c AS (SELECT profile_id, count(*) FILTER (hit) AS relevant, count(*) AS broad FROM fx GROUP BY 1) SELECT profile_id, coalesce(relevant, 0) AS relevant, coalesce(broad, 0) AS broad FROM profiles_v LEFT JOIN c USING (profile_id)", "jobs_v", "profiles_v")
_add("l05_relevant_sample", lambda s, d: R.relevant_pool(QJ.jobs(s, d), _wanted(s, d), NOW)[1].select("profile_id", "id", "place"), _REL + " SELECT profile_id, id, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY apply_end_date NULLS LAST, id) AS place FROM fx WHERE hit) WHERE place <= 50", "jobs_v", "profiles_v")
