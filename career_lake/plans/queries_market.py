"""Queries of candidate pools and the whole market report, with oracle SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from career_lake import rules
from career_lake.operators import market_report as M
from career_lake.operators import pools as L
from career_lake.plans import queries_jobs as QJ
from career_lake.plans import queries_report as QR
from career_lake.plans.bindings import NOW, oracle, view

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
SINCE = "2025-07-22"


def _add(name: str, f, sql: str, *views: str) -> None:  # noqa: ANN001
    QUERIES[name] = f
    ORACLES[name] = oracle(sql, *views)


def _coded(s: SparkSession, d: str) -> DataFrame:
    return QJ.profiles(s, d).withColumn("code", QJ.J.inferred_code(F.col("major")))


_WORDS = f"list_concat([major], {QJ._KW})[1:6]"
_SAME = "concat_ws('|', regexp_replace(regexp_replace(company_name, '^(?i:Moka|北森|猎聘|智联招聘)\\s*', ''), '\\s+', '', 'g'), regexp_replace(job_title, '\\s+', '', 'g'), regexp_replace(coalesce(work_location, ''), '\\s+', '', 'g'), coalesce(CAST(apply_end_date AS VARCHAR), ''))"
#: Every question's jobs, the first hundred of each, the first of equal postings, and the first two hundred of a key.
POOLS = (
    QJ.JOBS_N
    + f"""
, pw AS (SELECT *, {QJ.CODE} AS code, CASE degree_level WHEN 'associate' THEN '大专' WHEN 'bachelor' THEN '本科' WHEN 'master' THEN '硕士' WHEN 'doctorate' THEN '博士' ELSE '' END AS w FROM profiles_v)
, pk AS (SELECT *, concat(major, '|', coalesce(code, ''), '|', w, '|', CAST(graduation_year AS VARCHAR)) AS pool_key FROM pw)
, keys AS (SELECT DISTINCT pool_key, major, code, w, graduation_year AS y FROM pk)
, named AS (SELECT *, unnest({_WORDS}) AS word, unnest(range(2, len({_WORDS}) + 2)) AS q FROM keys)
, jt AS (SELECT id, concat_ws(' ', job_title, major_requirements) AS t, {_SAME} AS same, apply_end_date, coalesce(education_level, '') AS edu, coalesce(graduate_year, '') AS yrs, major_category_ids FROM jobs_n)
, hit AS (SELECT word, jt.* FROM (SELECT DISTINCT word FROM named UNION SELECT DISTINCT major FROM keys) u(word) JOIN jt ON contains(t, word))
, found AS (
  SELECT pool_key, 0 AS q, id, same, apply_end_date FROM keys JOIN hit ON word = major AND contains(edu, w) AND contains(yrs, CAST(y AS VARCHAR))
  UNION ALL SELECT pool_key, 1, id, same, apply_end_date FROM keys JOIN jt ON code IS NOT NULL AND list_contains(major_category_ids, code)
  UNION ALL SELECT pool_key, q, id, same, apply_end_date FROM named JOIN hit USING (word))
, lists AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pool_key, q ORDER BY apply_end_date NULLS LAST, id) AS k FROM found) WHERE k <= 100)
, firsts AS (SELECT *, row_number() OVER (PARTITION BY pool_key ORDER BY q, k) AS place, count(*) OVER (PARTITION BY pool_key) AS found FROM (SELECT *, row_number() OVER (PARTITION BY pool_key, same ORDER BY q, k) AS r FROM lists) WHERE r = 1)
, won AS (SELECT pool_key, id, place, q = 0 AS strict, found FROM firsts WHERE place <= 200)
, asked AS (SELECT pool_key, 0 AS q FROM keys UNION ALL SELECT pool_key, 1 FROM keys WHERE code IS NOT NULL UNION ALL SELECT pool_key, q FROM named)
, told AS (SELECT asked.pool_key, asked.q, coalesce(n, 0) AS total FROM asked LEFT JOIN (SELECT pool_key, q, count(*) AS n FROM found GROUP BY ALL) USING (pool_key, q))
, cut AS (SELECT pool_key, max(total) AS most, bool_or(total > 100) OR coalesce((SELECT max(found) FROM firsts f WHERE f.pool_key = told.pool_key), 0) > 200 AS sample_limited FROM told GROUP BY 1)"""
)
_add("l02_decision_pool", lambda s, d: L.decision_pool(QJ.jobs(s, d), _coded(s, d)), POOLS + " SELECT pool_key, id, CAST(place AS INT) AS place, strict, CAST(found AS INT) AS found FROM won", "jobs_v", "profiles_v")
_add("l03_sample_limited", lambda s, d: L.sample_limited(L.decision_pool(QJ.jobs(s, d), _coded(s, d)), L.query_summaries(QJ.jobs(s, d), _coded(s, d))), POOLS + " SELECT pool_key, sample_limited FROM cut", "jobs_v", "profiles_v")


# ---- P14 -----------------------------------------------------------------


def _heat(src: str, key: str, x: str) -> str:
    """x_rows (key, heat), x_best (key, best) and x_k (cells with ranks) of src(key, region, category)."""
    return f"""
, {x}_c AS (SELECT {key}, region, category, count(*) AS n FROM {src} GROUP BY ALL)
, {x}_t AS (SELECT *, sum(n) OVER (PARTITION BY {key}, region) AS rn, sum(n) OVER (PARTITION BY {key}, category) AS cn FROM {x}_c)
, {x}_k AS (SELECT *, dense_rank() OVER (PARTITION BY {key} ORDER BY rn DESC, region) AS rk, dense_rank() OVER (PARTITION BY {key} ORDER BY cn DESC, category) AS ck FROM {x}_t)
, {x}_m AS (SELECT {key}, region, rk, category, ck, coalesce(n, 0) AS n FROM (SELECT DISTINCT {key}, region, rk FROM {x}_k WHERE rk <= 5) JOIN (SELECT DISTINCT {key}, category, ck FROM {x}_k WHERE ck <= 5) USING ({key}) LEFT JOIN {x}_c USING ({key}, region, category))
, {x}_rows AS (SELECT {key}, string_agg(concat(region, ':', v), '|' ORDER BY rk) AS heat FROM (SELECT {key}, region, rk, string_agg(CAST(n AS VARCHAR), ',' ORDER BY ck) AS v FROM {x}_m GROUP BY ALL) GROUP BY 1)
, {x}_best AS (SELECT {key}, string_agg(concat(region, ':', category, ':', n), '|' ORDER BY p) AS best FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY n DESC, region, ck) AS p FROM {x}_m WHERE n > 0) WHERE p <= 3 GROUP BY 1)"""


_STATE = "CASE WHEN {n} <= 0 THEN 'unavailable' WHEN {n} >= 5 AND {n} / sample >= 0.3 THEN 'available' ELSE 'partial' END"
_RULED = " UNION ALL ".join(f"SELECT pool_key, '{k}' AS kind, '{label}' AS label, count(*) FILTER (regexp_matches({QJ._TEXT}, '{p}')) AS n FROM pj GROUP BY 1" for k, rs in rules.SIGNALS.items() for label, p in rs)
_NUM = "regexp_replace(CAST({x} AS VARCHAR), '\\.0$', '')"
_SAL = f"CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN concat('已标年薪中位区间 ', {_NUM.format(x='lo')}, '–', {_NUM.format(x='hi')}, ' 万') WHEN lo IS NOT NULL THEN concat('已标年薪下限中位数 ', {_NUM.format(x='lo')}, ' 万') WHEN hi IS NOT NULL THEN concat('已标年薪上限中位数 ', {_NUM.format(x='hi')}, ' 万') ELSE '当前样本缺少结构化薪资' END"


def _told(kind: str, other: str, most: int) -> str:
    return f"concat('{kind}:', {_STATE.format(n='any_' + kind)}, ':', any_{kind}, ':', coalesce((SELECT string_agg(label, '、' ORDER BY r) FROM sg WHERE sg.pool_key = pf.pool_key AND kind = '{kind}' AND r <= {most}), '{other}'), ':', coalesce((SELECT string_agg(concat(label, '=', n), ',' ORDER BY r) FROM sg WHERE sg.pool_key = pf.pool_key AND kind = '{kind}'), ''))"


_LABEL = "CASE direction " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.DIRECTION_LABELS.items()) + " ELSE concat(major, '相关岗位') END"
REPORT = (
    POOLS
    + f"""
, pj AS (SELECT won.pool_key, place, strict, keys.major, jobs_n.*, {QJ.REGION} AS region, {QJ.CATEGORY} AS category FROM won JOIN jobs_n USING (id) JOIN keys USING (pool_key))"""
    + _heat("pj", "pool_key", "hp")
    + f"""
, sg AS (SELECT *, row_number() OVER (PARTITION BY pool_key, kind ORDER BY n DESC, label) AS r FROM ({_RULED}) WHERE n > 0)
, city AS (SELECT pool_key, string_agg(region, '、' ORDER BY r) AS labels, string_agg(concat(region, '=', rn), ',' ORDER BY r) AS counts FROM (SELECT *, row_number() OVER (PARTITION BY pool_key ORDER BY rn DESC, region) AS r FROM (SELECT DISTINCT pool_key, region, rn FROM hp_k WHERE region <> '{rules.UNKNOWN_REGION}')) WHERE r <= 3 GROUP BY 1)
, pf AS (SELECT pool_key, count(*) AS sample, count(DISTINCT company_name) AS companies, count(DISTINCT region) AS regions, count(*) FILTER (contains(coalesce(source, ''), '官方')) AS official, count(*) FILTER (apply_end_date IS NOT NULL) AS deadline_known,
  count(*) FILTER (coalesce(salary_min, 0) > 0 OR coalesce(salary_max, 0) > 0) AS paid, floor(median(salary_min) * 10 + 0.5) / 10 AS lo, floor(median(salary_max) * 10 + 0.5) / 10 AS hi,
  {", ".join(f"count(*) FILTER (regexp_matches({QJ._TEXT}, '{QJ._ANY[k]}')) AS any_{k}" for k in rules.SIGNALS)} FROM pj GROUP BY 1)
, cond AS (SELECT pf.pool_key, concat_ws('|', concat('salary:', {_STATE.format(n="paid")}, ':', paid, ':', CASE WHEN paid BETWEEN 1 AND 2 THEN concat('仅', paid, '条样本 · ', regexp_replace({_SAL}, '^已标', '')) ELSE {_SAL} END, ':', CASE WHEN paid > 0 THEN concat('已标薪资=', paid) ELSE '' END),
  {_told("development", "岗位正文较少披露培养路径", 2)}, concat('city:', CASE WHEN labels IS NULL THEN 'unavailable' ELSE 'available' END, ':', sample, ':', coalesce(concat('岗位较多：', labels), '当前样本缺少工作地点'), ':', coalesce(counts, '')),
  {_told("intensity", "岗位正文暂无足够工时信息", 2)}, {_told("benefit", "当前样本缺少福利明细", 3)}) AS conditions FROM pf LEFT JOIN city USING (pool_key))
, dx AS (SELECT *, {QJ._DIR} AS direction FROM pj)
, da AS (SELECT pool_key, major, direction, count(*) AS jobs, count(DISTINCT company_name) AS companies, count(*) FILTER (contains(regexp_replace(coalesce(major_requirements, ''), '\\s+', '', 'g'), major)) AS mentions FROM dx GROUP BY ALL)
, dk AS (SELECT *, row_number() OVER (PARTITION BY pool_key ORDER BY jobs DESC, mentions DESC, direction) AS r, {_LABEL} AS label FROM da)
, dirs AS (SELECT pool_key, string_agg(concat(label, ':', jobs, ':', companies, ':', mentions), '|' ORDER BY r) AS directions, min_by(label, r) AS lead FROM dk WHERE r <= 3 GROUP BY 1)
, hd AS (SELECT major, j.*, row_number() OVER (PARTITION BY major ORDER BY r DESC, id) AS k FROM (SELECT DISTINCT major FROM keys) JOIN (SELECT id, job_title, concat_ws(' ', job_title, major_requirements) AS t, {QJ.REGION} AS region, {QJ.CATEGORY} AS category, coalesce(created_at, apply_start_date, updated_at) AS r FROM jobs_n) j ON contains(t, major) WHERE r >= DATE '{SINCE}')
, hs AS (SELECT * FROM hd WHERE k <= 300), hn AS (SELECT major, count(*) AS total FROM hd GROUP BY 1)"""
    + _heat("hs", "major", "hh")
    + QJ.LAYERS
    + """
, pairs AS (SELECT pk.*, pj.* EXCLUDE (pool_key, major, place, strict, region, category) FROM pk JOIN pj USING (pool_key))"""
    + QJ.TIERED[len(QJ.PAIRS) :]
    + f"""
, dc AS (SELECT profile_id, count(*) FILTER (qualification = 'raw-fields-aligned') AS aligned, count(*) FILTER (tier = 'watchlist') AS watchlist, count(*) FILTER (qualification = 'high-risk') AS high_risk, count(*) FILTER (qualification = 'expired') AS expired,
  count(*) FILTER (len({QJ._PREF}) = 0 OR len(list_filter({QJ._PREF}, lambda x: contains(coalesce(work_location, ''), x))) > 0) AS preferred, string_agg(concat(tier, ':', id, ':', score), '|' ORDER BY tier, score DESC, id) FILTER (tier IN ('primary', 'steady')) AS portfolio FROM tiered GROUP BY 1)
, ps AS (SELECT *, {QR._SCHOOL} AS school FROM profiles_v)
, x0 AS (SELECT ps.*, pk.pool_key, coalesce(sample, 0) AS sample, coalesce(companies, 0) AS companies, coalesce(regions, 0) AS regions, coalesce(official, 0) AS official, coalesce(deadline_known, 0) AS deadline_known, conditions, directions, lead, hp_rows.heat, hp_best.best,
   coalesce(least(hn.total, 300), 0) AS history_size, coalesce(hn.total > 300, false) AS history_limited, hh_rows.heat AS history_heat, hh_best.best AS history_best, full_market, state_owned, campus_intern, strict_profile, most, cut.sample_limited,
   coalesce(preferred, 0) AS preferred, coalesce(aligned, 0) AS aligned, coalesce(watchlist, 0) AS watchlist, coalesce(high_risk, 0) AS high_risk, coalesce(expired, 0) AS expired, portfolio,
   CAST(ps.profile_id AS BIGINT) % 4 < 2 AND ps.major IN ('法学', '会计学', '自动化') AS sk
  FROM ps JOIN pk USING (profile_id) JOIN layers USING (profile_id) LEFT JOIN cut USING (pool_key) LEFT JOIN pf USING (pool_key) LEFT JOIN cond USING (pool_key) LEFT JOIN dirs USING (pool_key) LEFT JOIN hp_rows USING (pool_key) LEFT JOIN hp_best USING (pool_key)
  LEFT JOIN hn ON hn.major = ps.major LEFT JOIN hh_rows ON hh_rows.major = ps.major LEFT JOIN hh_best ON hh_best.major = ps.major LEFT JOIN dc USING (profile_id))
, f AS (SELECT *, CASE WHEN regexp_matches(school_tier, '985|211') THEN 90 WHEN regexp_matches(school_tier, '双一流') THEN 84 WHEN regexp_matches(school_tier, '海外') THEN 70 WHEN regexp_matches(school_tier, '高职|专科') THEN 48 WHEN school_tier <> '' THEN 62 ELSE 50 END AS c_school,
 {QJ._CL.format(x="CASE WHEN strict_profile > 0 THEN 55 + least(35.0, CASE WHEN campus_intern > 0 THEN strict_profile / campus_intern ELSE 0.0 END * 280) WHEN campus_intern > 0 THEN 38.0 ELSE 30.0 END")} AS c_major,
 CASE degree_level {" ".join(f"WHEN '{k}' THEN {v}" for k, v in rules.DEGREE_SCORE.items())} END AS c_degree,
 CASE WHEN strict_profile <= 0 THEN 25 ELSE {QJ._CL.format(x="least(95.0, 35 + log2(strict_profile + 1.0) * 8.5) * 0.72 + least(95.0, 32 + log2(greatest(1, companies) + 1.0) * 10) * 0.28")} END AS c_market,
 {QJ._CL.format(x="round((" + " + ".join(f"CASE {QJ._LV[k]} WHEN 'ready' THEN 92 WHEN 'developing' THEN 65 ELSE 35 END" for k, _, _ in rules.CAPABILITIES) + ") / 6, 6)")} AS c_ready FROM x0)
, g AS (SELECT *, round(c_school * 0.25 + c_major * 0.25 + c_degree * 0.15 + c_market * 0.2 + c_ready * 0.15, 6) AS cw FROM f)
, z0 AS (SELECT *, {QJ._CL.format(x="cw")} AS score, {QJ._CL.format(x="round(cw + (92 - c_ready) * 0.15, 6)")} AS potential,
  list_filter([CASE WHEN sk THEN 'school' END, CASE WHEN strict_profile > 0 THEN 'entry' END, CASE WHEN graduation_year > {NOW[:4]} THEN 'window' END], lambda v: v IS NOT NULL) AS st,
  list_concat(list_concat(list_filter([CASE WHEN NOT sk AND trim(school) <> '' THEN 'school' END, CASE WHEN strict_profile <= 0 AND sample > 0 THEN 'unverified' END], lambda v: v IS NOT NULL), list_filter([{", ".join(f"CASE WHEN coalesce({c}, 'missing') <> 'ready' THEN 'gap:{c}' END" for c in rules.MATRIX_ROWS)}], lambda v: v IS NOT NULL)[1:2]),
  CASE WHEN len({QJ._PREF}) > 0 AND preferred = 0 THEN ['city'] ELSE [] END) AS co,
  list_transform(list_sort(list_filter([{QR._ACTS}, {QR._FALL}], lambda a: a.r <> 2))[1:3], lambda a: a) AS acts FROM g)
SELECT profile_id, CASE WHEN sample > 0 THEN 'live' ELSE 'partial' END AS status, CASE WHEN strict_profile >= 50 THEN '央国企机会较多' WHEN strict_profile > 0 THEN '已有可关注岗位' WHEN sample > 0 THEN '有岗位，条件待核验' ELSE '暂无足够岗位' END AS conclusion,
 sample, sample_limited, concat_ws('|', concat('school:', CASE WHEN trim(school) = '' THEN '待补充' ELSE trim(school) END), concat('degree:', {QR._DEG}), concat('major:', major), concat('graduation-year:', graduation_year, ' 届'), concat('location:', coalesce({QR._PREF}, '待补充')), {", ".join(f"concat('{k}:', {QR._LVT.format(k=k)})" for k in rules.MATRIX_ROWS)}) AS matrix,
 CASE WHEN sk THEN 'available' ELSE 'unavailable' END AS school_status, score, CASE WHEN score >= 80 THEN 'strong' WHEN score >= 70 THEN 'fairly-strong' WHEN score >= 55 THEN 'medium' WHEN score >= 40 THEN 'fairly-weak' ELSE 'weak' END AS band, greatest(0, potential - score) AS room,
 array_to_string(CASE WHEN len(st) = 0 THEN ['basics'] ELSE st[1:3] END, ',') AS strengths, array_to_string(CASE WHEN len(co) = 0 THEN ['no_direction'] ELSE co[1:3] END, ',') AS constraints, coalesce(conditions, '') AS conditions,
 full_market, state_owned, campus_intern, strict_profile, coalesce(directions, '') AS directions, greatest(campus_intern, most) AS broad, companies, regions, official, deadline_known, preferred AS preferred_region, coalesce(heat, '') AS heat, coalesce(best, '') AS best,
 history_size, history_limited, coalesce(history_heat, '') AS history_heat, coalesce(history_best, '') AS history_best, aligned, watchlist, high_risk, expired, coalesce(portfolio, '') AS portfolio,
 concat(greatest({NOW[:4]}, graduation_year - 1), '.03–06') AS next_period,
 concat('优先确认', coalesce(lead, concat(major, '相关方向')), '是否为主方向|其次', acts[1].t, '|再从', CASE WHEN strict_profile > 0 THEN strict_profile ELSE sample END, '个资料字段匹配中选择目标岗位') AS steps,
 array_to_string(list_transform(acts, lambda a: concat(a.c, ':', a.p, ':', a.h)), '|') AS actions,
 array_to_string(list_transform(acts, lambda a: concat(regexp_replace(a.t, '^(完成|开始|补充|整理|准备)', ''), ':', CASE WHEN a.r = 0 THEN '尚未开始' WHEN a.r = 1 THEN '已有基础' ELSE '待处理' END)), '|') AS levers,
 concat('主站实时查询：相关岗位', full_market, '个，央国企', state_owned, '个，校招或实习', campus_intern, '个。') AS caveat FROM z0"""
)


def report(s: SparkSession, d: str) -> DataFrame:
    return M.market_report(QR.profiles(s, d), QJ.jobs(s, d), view(s, d, "jobs_v"), QR._schools(s), NOW, SINCE)


def _line(array: str | Column, *fields: str) -> Column:
    """A list of structs as text: its fields with ':' between, '|' between structs."""
    return F.array_join(F.transform(array, lambda x: F.concat_ws(":", *(x[f].cast("string") for f in fields))), "|")


def _flat(r: DataFrame) -> DataFrame:
    heat = lambda h: F.array_join(F.transform(h, lambda x: F.concat(x["region"], F.lit(":"), F.array_join(F.transform(x["values"], lambda v: v.cast("string")), ","))), "|")
    signals = lambda x: F.array_join(F.transform(x["signals"], lambda s: F.concat(s["label"], F.lit("="), s["count"].cast("string"))), ",")
    told = F.array_join(F.transform("conditions", lambda x: F.concat_ws(":", x["id"], x["status"], x["jobs"].cast("string"), x["headline"], signals(x))), "|")
    return r.select(
        "profile_id", "status", "conclusion", F.col("metrics.sample").alias("sample"), "source.sample_limited", _line("qualification_matrix", "item", "value").alias("matrix"), F.col("school.status").alias("school_status"),
        "competitiveness.score", "competitiveness.band", "competitiveness.room", F.array_join("assessment.strengths", ",").alias("strengths"), F.array_join("assessment.constraints", ",").alias("constraints"), told.alias("conditions"),
        "market_layers.full_market", "market_layers.state_owned", "market_layers.campus_intern", "market_layers.strict_profile", _line("directions", "label", "jobs", "companies", "mentions").alias("directions"),
        *(f"metrics.{c}" for c in ("broad", "companies", "regions", "official", "deadline_known", "preferred_region")), heat("heatmap.rows").alias("heat"), _line("heatmap.best", "region", "category", "count").alias("best"),
        F.col("history.size").alias("history_size"), F.col("history.limited").alias("history_limited"), heat("history.heatmap.rows").alias("history_heat"), _line("history.heatmap.best", "region", "category", "count").alias("history_best"),
        *(F.coalesce(f"decision.{c}", F.lit(0)).alias(c) for c in ("aligned", "watchlist", "high_risk", "expired")), F.coalesce(_line("decision.portfolio", "tier", "id", "score"), F.lit("")).alias("portfolio"),
        F.col("milestones")[1]["period"].alias("next_period"), F.array_join("priority_steps", "|").alias("steps"), _line("actions", "capability", "priority", "hours").alias("actions"), _line("levers", "label", "status").alias("levers"), F.col("caveats")[0].alias("caveat"),
    )


_add("p14_market_report", lambda s, d: _flat(report(s, d)), REPORT, "jobs_v", "profiles_v")
