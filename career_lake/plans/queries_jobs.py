"""Queries of the job, decision and market operators, with oracle SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from career_lake import rules
from career_lake.operators import decision as D
from career_lake.operators import jobs as J
from career_lake.operators import market as P
from career_lake.plans.bindings import NOW, oracle, view

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _add(name: str, f, sql: str | None = None, *views: str) -> None:  # noqa: ANN001
    QUERIES[name] = f
    if sql:
        ORACLES[name] = oracle(sql, *views)


def jobs(s: SparkSession, d: str) -> DataFrame:
    return J.normalise_jobs(view(s, d, "jobs_v"))


def profiles(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "profiles_v")


def coded(s: SparkSession, d: str) -> DataFrame:
    """Profiles whose major has a code."""
    return profiles(s, d).withColumn("code", J.inferred_code(F.col("major"))).where("code is not null")


def pairs(s: SparkSession, d: str) -> DataFrame:
    """Profiles with the first 100 jobs by deadline of their major's code. The bounded pool is broadcast: a shuffle on a few codes would bring all profiles of a code into one task."""
    return coded(s, d).join(F.broadcast(J.code_pool(jobs(s, d))), "code")


def kind_pairs(s: SparkSession, d: str, columns: list[str]) -> DataFrame:
    """The pairs of each kind of profiles (profile_id: the kind) instead of each profile."""
    return D.kinds_of(coded(s, d), columns).join(J.code_pool(jobs(s, d)), "code")


def gated(s: SparkSession, d: str) -> DataFrame:
    """The gates (profile_id: a kind of profiles by D.GATED)."""
    return D.gated_kinds(coded(s, d), J.code_pool(jobs(s, d)), NOW)


def assessed(s: SparkSession, d: str) -> DataFrame:
    """The assessed pairs (profile_id: a kind of profiles by D.KIND)."""
    return D.assessed_kinds(coded(s, d), J.code_pool(jobs(s, d)), NOW)


def told(s: SparkSession, d: str, answers: DataFrame, columns: list[str]) -> DataFrame:
    return D.told_to_profiles(coded(s, d), answers, columns)


# ---- oracle parts -------------------------------------------------------


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^[\\s\\x{{a0}}\\x{{3000}}\\x{{feff}}]+|[\\s\\x{{a0}}\\x{{3000}}\\x{{feff}}]+$', '', 'g')"


def _clean(x: str, n: int) -> str:
    return f"nullif(substring({_trim(f'regexp_replace({x}, ' + chr(39) + '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]' + chr(39) + ', ' + chr(39) * 2 + ', ' + chr(39) + 'g' + chr(39) + ')')}, 1, {n}), '')"


def _q(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _case(x: str, found: list[tuple[str, str]], other: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, '{p}') THEN '{label}'" for label, p in found) + f" ELSE {other} END"


def _uniq(x: str) -> str:
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


_RAW_CODES = "CASE WHEN major_category_ids LIKE '[%' THEN regexp_extract_all(major_category_ids, '\"([^\"]*)\"', 1) ELSE string_split_regex(major_category_ids, '[,，\\s]+') END"
_PLACES = "regexp_extract_all(work_location, '\"([^\"]*)\"', 1)"
JOBS_N = f"""
, jobs_0 AS (SELECT *, list_filter({_RAW_CODES}, lambda c: regexp_full_match(c, '[A-Za-z0-9][A-Za-z0-9_-]{{1,31}}')) AS codes_0 FROM jobs_v)
, jobs_n AS (
SELECT {_clean("id", 64)} AS id, {_clean("company_name", 200)} AS company_name, company_type, {_clean("job_title", 200)} AS job_title, job_type,
       {_clean("job_description", 12000)} AS job_description, {_clean("education_level", 50)} AS education_level, {_clean("graduate_year", 80)} AS graduate_year,
       CASE WHEN work_location LIKE '[%]' THEN array_to_string({_uniq(_PLACES)}, ' / ') ELSE {_clean("work_location", 200)} END AS work_location,
       {_clean("major_requirements", 4000)} AS major_requirements, coalesce({_uniq("codes_0")}, []) AS major_category_ids,
       TRY_CAST(apply_start_date AS DATE) AS apply_start_date, TRY_CAST(apply_end_date AS DATE) AS apply_end_date, announcement_url, {_clean("source", 160)} AS source,
       CASE WHEN salary_min > 0 AND salary_min <= 10000 THEN salary_min END AS salary_min, CASE WHEN salary_max > 0 AND salary_max <= 10000 THEN salary_max END AS salary_max,
       TRY_CAST(created_at AS DATE) AS created_at, TRY_CAST(updated_at AS DATE) AS updated_at, status, view_count
FROM jobs_0
WHERE {_clean("company_name", 200)} IS NOT NULL AND {_clean("job_title", 200)} IS NOT NULL AND company_type IN ({_q(rules.COMPANY_TYPES)}) AND job_type IN ({_q(rules.JOB_TYPES)})
)"""
CODE = _case("major", [(c, p) for p, c in rules.INFER_CODE], "NULL")
PAIRS = (
    JOBS_N
    + f"""
, coded AS (SELECT DISTINCT id, c[1:4] AS code FROM (SELECT id, unnest(major_category_ids) AS c FROM jobs_n) WHERE length(c) >= 4)
, pool AS (SELECT * FROM (SELECT jobs_n.*, code, row_number() OVER (PARTITION BY code ORDER BY apply_end_date ASC NULLS LAST, id) AS rank FROM jobs_n JOIN coded USING (id)) WHERE rank <= 100)
, pairs AS (SELECT p.*, pool.* EXCLUDE (code) FROM (SELECT *, {CODE} AS code FROM profiles_v) p JOIN pool ON p.code = pool.code)"""
)
_EDU = "coalesce(education_level, '')"
_MIN_RANK = "list_min(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(education_level, '{p}') THEN {rules.DEGREES.index(x)} END" for x, p in rules.DEGREE_SEEN) + "], lambda v: v IS NOT NULL))"
_LEVEL = "CASE degree_level " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(rules.DEGREES)) + " END"
_FAM = "CASE " + " ".join(f"WHEN regexp_matches(major, '{p}') THEN {i}" for i, (p, _, _) in enumerate(rules.GATE_FAMILIES)) + " END"
_FCODE = "CASE fam " + " ".join(f"WHEN {i} THEN '{c}'" for i, (_, c, _) in enumerate(rules.GATE_FAMILIES)) + " END"
_MINE = "coalesce(CASE fam " + " ".join(f"WHEN {i} THEN regexp_matches(coalesce(major_requirements, ''), '{t}')" for i, (_, _, t) in enumerate(rules.GATE_FAMILIES)) + " END, false)"
_OTHERS = "(fam IS NOT NULL AND (" + " OR ".join(f"(fam <> {i} AND regexp_matches(coalesce(major_requirements, ''), '{t}'))" for i, (_, _, t) in enumerate(rules.GATE_FAMILIES)) + "))"
_PLAIN = "regexp_replace(regexp_replace({x}, '\\s+', '', 'g'), '专业|类|工程及其', '')"
_TITLE_YEARS = "list_transform(regexp_extract_all(job_title, '(20\\d\\d)\\s*(?:届|校招|校园招聘|毕业生)', 1), lambda y: CAST(y AS INT))"
_YEARS = f"list_filter(list_concat(list_transform(regexp_extract_all(coalesce(graduate_year, ''), '((?:20)?\\d\\d)\\s*届', 1), lambda y: CASE WHEN CAST(y AS INT) < 100 THEN CAST(y AS INT) + 2000 ELSE CAST(y AS INT) END), list_transform(regexp_extract_all(coalesce(graduate_year, ''), '20\\d\\d', 0), lambda y: CAST(y AS INT)), {_TITLE_YEARS}), lambda y: y BETWEEN 2020 AND 2040)"
GATED = (
    PAIRS
    + f"""
, gated AS (SELECT *,
  CASE WHEN {_EDU} = '' THEN 'unknown' WHEN regexp_matches({_EDU}, '不限') THEN 'pass' WHEN degree_level = 'unknown' THEN 'unknown' WHEN {_MIN_RANK} IS NULL THEN 'unknown' WHEN {_LEVEL} >= {_MIN_RANK} THEN 'pass' ELSE 'mismatch' END AS p_degree,
  CASE WHEN coalesce(major_requirements, '') = '' AND len(major_category_ids) = 0 THEN 'unknown'
       WHEN regexp_matches(coalesce(major_requirements, ''), '不限专业|专业不限|不限') THEN 'pass'
       WHEN fam IS NOT NULL AND len(list_filter(major_category_ids, lambda c: starts_with(c, {_FCODE}))) > 0 THEN 'pass'
       WHEN {_PLAIN.format(x="major")} <> '' AND contains({_PLAIN.format(x="coalesce(major_requirements, '')")}, {_PLAIN.format(x="major")}) THEN 'pass'
       WHEN {_MINE} THEN 'conditional'
       WHEN regexp_matches(coalesce(major_requirements, ''), '理工科|工科|管理类|专业不限') OR (contains(coalesce(major_requirements, ''), '相关专业') AND NOT {_OTHERS}) THEN 'unknown'
       ELSE 'mismatch' END AS p_major,
  CASE WHEN coalesce(graduate_year, '') = '' AND len({_TITLE_YEARS}) = 0 THEN 'unknown' WHEN regexp_matches(coalesce(graduate_year, ''), '不限|均可|长期') AND len({_TITLE_YEARS}) = 0 THEN 'pass'
       WHEN len({_YEARS}) = 0 THEN 'unknown' WHEN list_contains({_YEARS}, graduation_year) THEN 'pass' ELSE 'mismatch' END AS p_year,
  CASE WHEN apply_end_date IS NULL THEN 'unknown' WHEN apply_end_date < DATE '{NOW}' THEN 'mismatch' ELSE 'pass' END AS p_deadline
  FROM (SELECT *, {_FAM} AS fam FROM pairs))"""
)
_LV = {k: f"coalesce({k}, 'missing')" for k, _, _ in rules.CAPABILITIES}
READY = "floor(round(" + " + ".join(f"{w} * CASE {_LV[k]} WHEN 'ready' THEN 1.0 WHEN 'developing' THEN 0.55 ELSE 0.0 END" for k, w, _ in rules.CAPABILITIES) + ", 6) + 0.5)"
HOURS = " + ".join(f"floor({h} * CASE {_LV[k]} WHEN 'missing' THEN 1.0 WHEN 'developing' THEN 0.5 ELSE 0.0 END + 0.5)" for k, _, h in rules.CAPABILITIES)
_FRESH = f"CASE WHEN updated_at IS NULL THEN 0 WHEN date_diff('day', updated_at, DATE '{NOW}') <= 7 THEN 10 WHEN date_diff('day', updated_at, DATE '{NOW}') <= 30 THEN 6 ELSE 1 END"
_WANT = "list_filter(list_transform(string_split_regex(coalesce(nullif(preferred_cities, ''), city, ''), '[,，/、;；\\s]+'), lambda x: regexp_replace(x, '[省市]', '', 'g')), lambda x: x <> '' AND NOT regexp_matches(x, '全国|不限'))"
_NEAR = f"(len({_WANT}) = 0 OR len(list_filter({_WANT}, lambda x: contains(regexp_replace(coalesce(work_location, ''), '[省市]', '', 'g'), x))) > 0)"


def _n(v: str) -> str:
    return "(" + " + ".join(f"CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END" for c in D.PRELIM) + ")"


_POINTS = " + ".join(f"CASE {c} WHEN 'pass' THEN {16 if c == 'p_major' else 8} WHEN 'conditional' THEN 4 WHEN 'mismatch' THEN {-32 if c == 'p_deadline' else -18} ELSE 0 END" for c in D.PRELIM)
ASSESSED = (
    GATED
    + f"""
, scored AS (SELECT *, CASE WHEN p_deadline = 'mismatch' THEN 'expired' WHEN {_n("mismatch")} > 0 THEN 'high-risk' WHEN {_n("unknown")} + {_n("conditional")} > 0 THEN 'needs-verification' ELSE 'raw-fields-aligned' END AS qualification,
  greatest(0, least(100, 42 + {_FRESH} + floor({READY} * 0.12 + 0.5) + {_POINTS} + CASE WHEN {_NEAR} THEN 8 ELSE 0 END)) AS points,
  {HOURS} + 2 * {_n("unknown")} + 3 * {_n("conditional")} + 8 * {_n("mismatch")} AS hours FROM gated)
, assessed AS (SELECT *, CAST(least(points, CASE qualification WHEN 'expired' THEN 39 WHEN 'high-risk' THEN 59 WHEN 'needs-verification' THEN 89 ELSE 100 END) AS INT) AS score FROM scored)"""
)
TIERED = (
    ASSESSED
    + """
, ranked AS (SELECT *, row_number() OVER (PARTITION BY profile_id, qualification ORDER BY score DESC, id) AS r, count(*) FILTER (qualification = 'raw-fields-aligned') OVER (PARTITION BY profile_id) AS aligned FROM assessed)
, tiered AS (SELECT *, CASE WHEN qualification IN ('expired', 'high-risk') THEN 'excluded' WHEN qualification = 'raw-fields-aligned' AND r <= 3 THEN 'primary' WHEN qualification = 'raw-fields-aligned' AND r <= 6 THEN 'steady'
  WHEN qualification = 'needs-verification' AND r <= greatest(0, 3 - greatest(0, aligned - 3)) THEN 'steady' ELSE 'watchlist' END AS tier FROM ranked)"""
)
_JV, _PV = "jobs_v", "profiles_v"
_TEXT = "concat_ws(' ', job_title, job_description)"
_FIRST = _trim("string_split_regex(" + _trim("work_location") + ", '[,，/、;；]|\\s{2,}')[1]")
REGION = (
    f"CASE WHEN work_location IS NULL OR {_trim('work_location')} = '' THEN '{rules.UNKNOWN_REGION}' WHEN contains({_FIRST}, '北京市') THEN '北京' WHEN contains({_FIRST}, '上海市') THEN '上海' WHEN contains({_FIRST}, '天津市') THEN '天津' WHEN contains({_FIRST}, '重庆市') THEN '重庆' "
    f"ELSE coalesce(nullif(regexp_extract({_FIRST}, '^(.{{2,4}}?)(?:省|自治区|特别行政区)', 1), ''), nullif(regexp_extract({_FIRST}, '^(.{{2,4}}?)市', 1), ''), nullif(substring({_FIRST}, 1, 8), ''), '{rules.UNKNOWN_REGION}') END"
)
CATEGORY = _case("job_title", rules.CATEGORIES, f"'{rules.OTHER_CATEGORY}'")


def _days(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(f.name).cast("string").alias(f.name) if f.dataType.simpleString() == "date" else F.array_join(f.name, ",").alias(f.name) if f.dataType.simpleString().startswith("array<") else F.col(f.name) for f in df.schema))


_SHOW = "CAST(apply_start_date AS VARCHAR) AS apply_start_date, CAST(apply_end_date AS VARCHAR) AS apply_end_date, CAST(created_at AS VARCHAR) AS created_at, CAST(updated_at AS VARCHAR) AS updated_at, array_to_string(major_category_ids, ',') AS major_category_ids"

_add("j01_normalise_jobs", lambda s, d: _days(jobs(s, d)), JOBS_N + f"SELECT * EXCLUDE (apply_start_date, apply_end_date, created_at, updated_at, major_category_ids), {_SHOW} FROM jobs_n", _JV)
_add(
    "j02_major_codes",
    lambda s, d: jobs(s, d).select(F.explode("major_category_ids").alias("code")).groupBy("code").agg(F.count("*").alias("jobs")),
    JOBS_N + "SELECT code, count(*) AS jobs FROM (SELECT unnest(major_category_ids) AS code FROM jobs_n) GROUP BY code",
    _JV,
)
_add("j03_locations", lambda s, d: jobs(s, d).groupBy("work_location").agg(F.count("*").alias("jobs")), JOBS_N + "SELECT work_location, count(*) AS jobs FROM jobs_n GROUP BY 1", _JV)
_add(
    "j04_filter_jobs",
    lambda s, d: J.filter_jobs(jobs(s, d), keyword="工程师", code="0809", order="view_count", descending=True, page=2, size=5).select("id", "job_title", "view_count", "rank"),
    JOBS_N
    + f""", m AS (SELECT id, job_title, view_count, CAST(row_number() OVER (ORDER BY view_count DESC NULLS LAST, id) AS INT) AS rank FROM jobs_n WHERE contains({_TEXT}, '工程师') AND list_contains(major_category_ids, '0809')
 AND (coalesce(major_requirements, '') = '' OR regexp_matches(regexp_replace(major_requirements, '\\s+', '', 'g'), '{rules.MAJOR_TEXT_OPEN}|{rules.MAJOR_TEXT["0809"]}'))) SELECT * FROM m WHERE rank BETWEEN 6 AND 10""",
    _JV,
)
_add(
    "j05_major_text",
    lambda s, d: jobs(s, d).agg(*(F.count_if(J.fits_major_text(F.col("major_requirements"), c)).alias(f"fits_{c}") for c in rules.MAJOR_TEXT)),
    JOBS_N + "SELECT " + ", ".join(f"count(*) FILTER (coalesce(major_requirements, '') = '' OR regexp_matches(regexp_replace(major_requirements, '\\s+', '', 'g'), '{rules.MAJOR_TEXT_OPEN}|{p}')) AS fits_{c}" for c, p in rules.MAJOR_TEXT.items()) + " FROM jobs_n",
    _JV,
)
_DMAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in rules.DEGREE_WORDS.items()) + "}"
_DTEXT = "regexp_replace(regexp_replace(education_level, '\\s+', '', 'g'), '^学历(?:要求)?[:：]?', '')"
_DTOK = f"list_transform(string_split_regex(regexp_replace({_DTEXT}, '学历$', ''), '[、,，/]|或|和'), lambda t: ({_DMAP})[t])"
_DMIN = f"({_DMAP})[nullif(regexp_extract({_DTEXT}, '^(高中|中专|高职|专科|大专|本科|大学本科|学士|硕士|硕士研究生|博士|博士研究生)及以上(?:学历)?$', 1), '')]"
_SURE = f"len(list_filter({_DTOK}, lambda t: t IS NULL)) = 0"
_YTEXT = "regexp_replace(regexp_replace(regexp_replace(graduate_year, '\\s+', '', 'g'), '(?:高校)?(?:应届)?毕业生$', ''), '应届生$', '')"
_YALL = f"regexp_extract_all({_YTEXT}, '20\\d\\d', 0)"
_MTEXT = f"regexp_replace(regexp_replace(regexp_replace({_trim('major_requirements')}, '^专业(?:要求)?[:：]?', ''), '(?:等)?相关专业$', ''), '专业$', '')"
_AMAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in rules.MAJOR_ALIAS.items()) + "}"
_CMAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in rules.CODE_MAJOR.items()) + "}"
_MTOK = f"list_transform(string_split_regex({_MTEXT}, '[、,，/；;]|或|和'), lambda t: ({_AMAP})[trim(t)])"
_NAMED = f"CASE WHEN coalesce({_MTEXT}, '') = '' THEN [] WHEN {_MTEXT} IN ('不限', '专业不限', '不限专业') THEN ['不限'] WHEN regexp_matches({_MTEXT}, '优先|建议|包括但不限于') THEN [] WHEN len(list_filter({_MTOK}, lambda t: t IS NULL)) = 0 THEN {_MTOK} ELSE [] END"
_CODED = f"list_filter(list_transform(list_filter(major_category_ids, lambda c: regexp_full_match(c, '\\d{{4}}(?:\\d{{2}})?')), lambda c: ({_CMAP})[c[1:4]]), lambda m: m IS NOT NULL)"
REQ = f"""
, req_0 AS (SELECT *, list_concat({_CODED}, {_NAMED}) AS m0, {_YALL} AS y0, {_DTOK} AS d0 FROM jobs_n)
, req AS (SELECT *, CASE WHEN education_level IS NULL OR {_DTEXT} IN ('不限', '不限学历', '学历不限') THEN NULL WHEN {_DMIN} IS NOT NULL THEN {_DMIN} WHEN {_SURE} AND len(d0) = 1 THEN d0[1] END AS degree_minimum,
  CASE WHEN education_level IS NULL THEN NULL WHEN {_DTEXT} IN ('不限', '不限学历', '学历不限') THEN [{_q(rules.DEGREES)}] WHEN {_DMIN} IS NOT NULL THEN NULL WHEN {_SURE} AND len(d0) > 1 THEN {_uniq("d0")} END AS degrees_accepted,
  CASE WHEN regexp_full_match({_YTEXT}, '20\\d\\d(?:年)?(?:届)?(?:(?:[、,，/]|或|和)20\\d\\d(?:年)?(?:届)?)*') THEN list_transform({_uniq("y0")}, lambda y: CAST(y AS INT)) END AS years_accepted,
  CASE WHEN len(m0) > 0 THEN {_uniq("m0")} END AS majors_accepted FROM req_0)"""
_add(
    "j06_requirements",
    lambda s, d: J.with_requirements(jobs(s, d)).select("id", "degree_minimum", *(F.array_join(c, ",").alias(c) for c in ("degrees_accepted", "years_accepted", "majors_accepted"))),
    JOBS_N + REQ + "SELECT id, degree_minimum, array_to_string(degrees_accepted, ',') AS degrees_accepted, array_to_string(years_accepted, ',') AS years_accepted, array_to_string(majors_accepted, ',') AS majors_accepted FROM req",
    _JV,
)
STATUS = f"CASE WHEN apply_end_date < DATE '{NOW}' THEN 'closed' WHEN lower(trim(status)) IN ('closed', 'inactive', '已截止', '已结束', '结束') THEN 'closed' WHEN apply_start_date > DATE '{NOW}' THEN 'unknown' WHEN lower(trim(status)) IN ('open', 'active', '招聘中', '报名中') THEN 'open' WHEN apply_end_date >= DATE '{NOW}' THEN 'open' ELSE 'unknown' END"
_add("j07_job_status", lambda s, d: jobs(s, d).select("id", J.job_status(NOW).alias("job_status")), JOBS_N + f"SELECT id, {STATUS} AS job_status FROM jobs_n", _JV)
_add(
    "j08_openings",
    lambda s, d: J.to_openings(jobs(s, d), NOW).select("job_id", "company", "title", "job_status", F.col("degree.minimum").alias("minimum"), F.array_join("years.accepted", ",").alias("years"), F.array_join("major_requirement.accepted", ",").alias("majors"), F.col("deadline.date").cast("string").alias("deadline"), F.col("evidence")[0]["id"].alias("evidence_id")),
    JOBS_N + REQ + f"SELECT id AS job_id, company_name AS company, job_title AS title, {STATUS} AS job_status, degree_minimum AS minimum, array_to_string(years_accepted, ',') AS years, array_to_string(majors_accepted, ',') AS majors, CAST(apply_end_date AS VARCHAR) AS deadline, concat('live-job:', id, ':record') AS evidence_id FROM req",
    _JV,
)
_KW = f"CASE WHEN regexp_matches(major, '{rules.KEYWORDS_OF[0]}') THEN list_filter([{_q(rules.KEYWORDS_OF[1])}], lambda k: k <> major) ELSE [] END"
_add(
    "j09_codes_and_keywords",
    lambda s, d: profiles(s, d).select("profile_id", J.inferred_code(F.col("major")).alias("code"), F.array_join(J.expanded_keywords(F.col("major")), ",").alias("keywords")),
    f"SELECT profile_id, {CODE} AS code, array_to_string(list_concat([major], {_KW})[1:12], ',') AS keywords FROM profiles_v",
    _PV,
)
_WORD = "CASE degree_level WHEN 'secondary' THEN '高中' WHEN 'vocational' THEN '大专' WHEN 'associate' THEN '大专' WHEN 'bachelor' THEN '本科' WHEN 'master' THEN '硕士' WHEN 'doctorate' THEN '博士' END"
LAYERS = f"""
, kinds AS (SELECT concat_ws(' ', job_title, major_requirements) AS t, coalesce(company_type IN ({_q(rules.COMPANY_TYPES)}), false) AS owned, coalesce(company_type IN ({_q(rules.COMPANY_TYPES)}) AND job_type IN ({_q(rules.JOB_TYPES)}), false) AS campus, coalesce(education_level, '') AS edu, coalesce(graduate_year, '') AS yrs, count(*) AS n FROM jobs_v GROUP BY ALL)
, layers AS (SELECT profile_id, major AS keyword, CAST(coalesce(sum(n), 0) AS BIGINT) AS full_market, CAST(coalesce(sum(n) FILTER (owned), 0) AS BIGINT) AS state_owned, CAST(coalesce(sum(n) FILTER (campus), 0) AS BIGINT) AS campus_intern,
  CAST(coalesce(sum(n) FILTER (campus AND ({_WORD} IS NULL OR contains(edu, {_WORD})) AND contains(yrs, CAST(graduation_year AS VARCHAR))), 0) AS BIGINT) AS strict_profile FROM profiles_v LEFT JOIN kinds ON contains(t, major) GROUP BY 1, 2)"""
_add("l01_market_layers", lambda s, d: J.market_layers(view(s, d, "jobs_v"), profiles(s, d)), LAYERS + "SELECT * FROM layers", _JV, _PV)
_add(
    "l02_code_pool",
    lambda s, d: J.code_pool(jobs(s, d)).select("code", "id", "rank"),
    PAIRS + "SELECT code, id, CAST(rank AS INT) AS rank FROM pool",
    _JV, _PV,
)
_add(
    "l04_historical_sample",
    lambda s, d: J.historical_sample(jobs(s, d), "2026-01-01").select("id", F.col("reference_date").cast("string").alias("reference_date")),
    JOBS_N + "SELECT id, CAST(r AS VARCHAR) AS reference_date FROM (SELECT id, coalesce(created_at, apply_start_date, updated_at) AS r FROM jobs_n) WHERE r >= DATE '2026-01-01' ORDER BY r DESC, id LIMIT 300",
    _JV,
)
_MEMBER = "MAP {" + ", ".join(f"'{m}': '{f}'" for f, ms in rules.FAMILIES.items() for m in [f, *ms]) + "}"
_PM = "regexp_replace(regexp_replace({x}, '[·・\\s（）()]', '', 'g'), '专业$', '')"


def openings_pairs(s: SparkSession, d: str) -> DataFrame:
    """Kinds of profiles (profile_id: a kind by D.GATED) with the openings of their code's pool; the record counts as an official page where the source is official."""
    pool = J.code_pool(jobs(s, d))
    official = F.coalesce(F.col("source").contains("官方"), F.lit(False))
    open_ = J.to_openings(pool.dropDuplicates(["id"]), NOW)
    kind = pool.select(F.col("id").alias("job_id"), "code", official.alias("official"))
    open_ = open_.join(kind, "job_id").withColumn("evidence", F.transform("evidence", lambda e: F.struct(e["id"].alias("id"), F.when(F.col("official"), "official_job_page").otherwise(e["source_type"]).alias("source_type"), e["url"].alias("url"))))
    return D.kinds_of(coded(s, d), D.GATED).join(open_, "code")


_EX = f"len(list_filter(majors_accepted, lambda a: {_PM.format(x='a')} IN ('不限', '不限专业', '所有专业') OR {_PM.format(x='a')} = {_PM.format(x='major')} OR coalesce(({_MEMBER})[{_PM.format(x='a')}] = ({_MEMBER})[{_PM.format(x='major')}], false))) > 0"
_OFF = "coalesce(contains(source, '官方'), false)"
GATES = (
    PAIRS.replace(", coded AS", REQ + "\n, coded AS").replace("SELECT jobs_n.*, code", "SELECT req.*, code").replace("FROM jobs_n JOIN coded", "FROM req JOIN coded")
    + f"""
, hard AS (SELECT profile_id, id AS job_id,
  CASE WHEN NOT {_OFF} OR (degree_minimum IS NULL AND degrees_accepted IS NULL) OR degree_level = 'unknown' THEN 'unknown' WHEN degrees_accepted IS NOT NULL THEN CASE WHEN list_contains(degrees_accepted, degree_level) THEN 'pass' ELSE 'fail' END
       WHEN {_LEVEL} >= CASE degree_minimum {" ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(rules.DEGREES))} END THEN 'pass' ELSE 'fail' END AS gate_degree,
  CASE WHEN NOT {_OFF} OR majors_accepted IS NULL THEN 'unknown' WHEN {_EX} THEN 'pass' ELSE 'fail' END AS gate_major,
  CASE WHEN NOT {_OFF} OR years_accepted IS NULL THEN 'unknown' WHEN list_contains(years_accepted, graduation_year) THEN 'pass' ELSE 'fail' END AS gate_year,
  CASE WHEN NOT {_OFF} OR apply_end_date IS NULL THEN 'unknown' WHEN {STATUS} = 'closed' OR apply_end_date < DATE '{NOW}' THEN 'fail' ELSE 'pass' END AS gate_deadline FROM pairs)"""
)
_add("g02_hard_gates", lambda s, d: told(s, d, D.hard_gates(openings_pairs(s, d), NOW).select("profile_id", "job_id", *D.GATES), D.GATED), GATES + "SELECT * FROM hard", _JV, _PV)
_FAIL = " OR ".join(f"{g} = 'fail'" for g in D.GATES)
_UNK = " OR ".join(f"{g} = 'unknown'" for g in D.GATES)
_add(
    "g04_eligibility",
    lambda s, d: told(s, d, D.eligibility(openings_pairs(s, d), NOW).select("profile_id", "job_id", "eligibility", "can_apply"), D.GATED),
    GATES + f"SELECT profile_id, job_id, CASE WHEN {_FAIL} THEN 'not_eligible_current_batch' WHEN {_UNK} THEN 'unknown' ELSE 'eligible' END AS eligibility, NOT ({_FAIL}) AND NOT ({_UNK}) AS can_apply FROM hard",
    _JV, _PV,
)
_add("d01_prelim_gates", lambda s, d: told(s, d, gated(s, d).select("profile_id", "id", *D.PRELIM), D.GATED), GATED + f"SELECT profile_id, id, {', '.join(D.PRELIM)} FROM gated", _JV, _PV)
_add("d02_freshness", lambda s, d: jobs(s, d).groupBy(D.freshness(F.col("updated_at"), NOW).alias("freshness")).agg(F.count("*").alias("jobs")), JOBS_N + f"SELECT {_FRESH} AS freshness, count(*) AS jobs FROM jobs_n GROUP BY 1", _JV)
_add("d03_region_match", lambda s, d: told(s, d, kind_pairs(s, d, D.PLACED).select("profile_id", "id", D.region_match(F.col("preferred_cities"), F.col("city"), F.col("work_location")).alias("region_ok")), D.PLACED), PAIRS + f"SELECT profile_id, id, {_NEAR} AS region_ok FROM pairs", _JV, _PV)
_add(
    "d04_readiness",
    lambda s, d: D.readiness(profiles(s, d)).select("profile_id", "readiness", "readiness_band", "blocker_hours"),
    f"SELECT profile_id, CAST({READY} AS INT) AS readiness, CASE WHEN {READY} >= 75 THEN 'ready' WHEN {READY} >= 45 THEN 'basic' ELSE 'early' END AS readiness_band, CAST({HOURS} AS INT) AS blocker_hours FROM profiles_v",
    _PV,
)
_add(
    "d04_blockers",
    lambda s, d: D.blockers(profiles(s, d)),
    "SELECT * FROM ("
    + " UNION ALL ".join(f"SELECT profile_id, '{k}' AS capability, {_LV[k]} AS level, CAST(floor({h} * CASE {_LV[k]} WHEN 'missing' THEN 1.0 WHEN 'developing' THEN 0.5 ELSE 0.0 END + 0.5) AS INT) AS hours FROM profiles_v" for k, _, h in rules.CAPABILITIES)
    + ") WHERE hours > 0",
    _PV,
)
_add("d05_opportunity_score", lambda s, d: told(s, d, assessed(s, d).select("profile_id", "id", "qualification", "score", "hours"), D.KIND), ASSESSED + "SELECT profile_id, id, qualification, score, CAST(hours AS INT) AS hours FROM assessed", _JV, _PV)
_add("d06_portfolio", lambda s, d: told(s, d, D.portfolio(assessed(s, d)).select("profile_id", "id", "qualification", "score", "tier"), D.KIND), TIERED + "SELECT profile_id, id, qualification, score, tier FROM tiered", _JV, _PV)
def _summaries(s: SparkSession, d: str) -> DataFrame:
    counts = D.portfolio_summary(D.portfolio(assessed(s, d)), D.kinds_of(coded(s, d), D.KIND), NOW)
    out = profiles(s, d).select("profile_id").join(told(s, d, counts, D.KIND), "profile_id", "left")
    return out.fillna(0, counts.columns[1:])


_add(
    "d07_portfolio_summary",
    _summaries,
    TIERED + f", pc AS (SELECT profile_id, count(*) AS candidates, count(DISTINCT company_name) AS companies, count(DISTINCT work_location) AS regions, count(*) FILTER (date_diff('day', updated_at, DATE '{NOW}') <= 30) AS recent, count(*) FILTER (apply_end_date IS NOT NULL) AS deadline_known, count(*) FILTER (qualification = 'raw-fields-aligned') AS aligned, count(*) FILTER (tier = 'watchlist') AS watchlist, count(*) FILTER (qualification = 'high-risk') AS high_risk, count(*) FILTER (qualification = 'expired') AS expired FROM tiered GROUP BY 1) SELECT profile_id, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in ("candidates", "companies", "regions", "recent", "deadline_known", "aligned", "watchlist", "high_risk", "expired")) + " FROM profiles_v LEFT JOIN pc USING (profile_id)",
    _JV, _PV,
)
_add(
    "d08_dedupe_candidates",
    lambda s, d: D.dedupe_candidates(jobs(s, d), ["id"]).select("id", "company_name", "job_title"),
    JOBS_N + "SELECT id, company_name, job_title FROM (SELECT *, row_number() OVER (PARTITION BY company_name, job_title, work_location, apply_end_date ORDER BY id) AS p FROM jobs_n) WHERE p = 1",
    _JV,
)
_add(
    "p01_heatmap",
    lambda s, d: P.heatmap(jobs(s, d)),
    JOBS_N + f""", k AS (SELECT {REGION} AS region, {CATEGORY} AS category FROM jobs_n), c AS (SELECT region, category, count(*) AS n FROM k GROUP BY ALL), r AS (SELECT region FROM k GROUP BY 1 ORDER BY count(*) DESC, region LIMIT 5), g AS (SELECT category FROM k GROUP BY 1 ORDER BY count(*) DESC, category LIMIT 5)
, m AS (SELECT region, category, coalesce(n, 0) AS n FROM r CROSS JOIN g LEFT JOIN c USING (region, category)), b AS (SELECT *, CAST(row_number() OVER (ORDER BY n DESC, region, category) AS INT) AS p FROM m) SELECT region, category, n, CASE WHEN n > 0 AND p <= 3 THEN p END AS best FROM b""",
    _JV,
)
_add("p02_categories", lambda s, d: jobs(s, d).groupBy(P.job_category(F.col("job_title")).alias("category")).agg(F.count("*").alias("jobs")), JOBS_N + f"SELECT {CATEGORY} AS category, count(*) AS jobs FROM jobs_n GROUP BY 1", _JV)
_add("p03_regions", lambda s, d: jobs(s, d).groupBy(P.region_of(F.col("work_location")).alias("region")).agg(F.count("*").alias("jobs")), JOBS_N + f"SELECT {REGION} AS region, count(*) AS jobs FROM jobs_n GROUP BY 1", _JV)
_SEC = "concat_ws(' ', company_name, job_title, company_type, source)"
_SECL = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({_SEC}, '{p}') THEN '{k}' END" for k, p in rules.SECTORS) + "], lambda v: v IS NOT NULL)"
_add("p04_sectors", lambda s, d: P.sectors_of(jobs(s, d)).groupBy("sector").agg(F.count("*").alias("jobs")), JOBS_N + f"SELECT sector, count(*) AS jobs FROM (SELECT unnest(CASE WHEN len({_SECL}) > 0 THEN {_SECL} ELSE ['{rules.OTHER_SECTOR}'] END) AS sector FROM jobs_n) GROUP BY 1", _JV)
_DIR = "CASE " + " ".join(f"WHEN regexp_matches(major, '{p}') THEN " + _case("job_title", rules.DIRECTIONS[k], "'other-related'") for k, p in rules.DIRECTION_SETS) + " ELSE " + _case("job_title", rules.DIRECTIONS["general"], "'other-related'") + " END"
_add(
    "p05_directions",
    lambda s, d: told(s, d, P.directions(kind_pairs(s, d, ["code", "major"]).withColumn("place", F.col("rank"))), ["code", "major"]).select("profile_id", "direction", "jobs", "companies", "mentions", "rank", F.array_join("sample_titles", "|").alias("sample_titles")),
    PAIRS + f""", x AS (SELECT *, {_DIR} AS direction FROM pairs), t AS (SELECT profile_id, direction, job_title, min(rank) AS f FROM x GROUP BY ALL), st AS (SELECT profile_id, direction, array_to_string(list(job_title ORDER BY f)[1:3], '|') AS sample_titles FROM t GROUP BY ALL)
, a AS (SELECT profile_id, direction, count(*) AS jobs, count(DISTINCT company_name) AS companies, count(*) FILTER (contains(regexp_replace(coalesce(major_requirements, ''), '\\s+', '', 'g'), major)) AS mentions FROM x GROUP BY ALL)
, k AS (SELECT *, CAST(row_number() OVER (PARTITION BY profile_id ORDER BY jobs DESC, mentions DESC, direction) AS INT) AS rank FROM a) SELECT k.*, sample_titles FROM k JOIN st USING (profile_id, direction) WHERE rank <= 3""",
    _JV, _PV,
)
_PREF = "CASE WHEN coalesce(nullif(preferred_cities, ''), city, '') = '' OR regexp_matches(coalesce(nullif(preferred_cities, ''), city, ''), '全国|不限') THEN [] ELSE list_filter(list_transform(string_split_regex(coalesce(nullif(preferred_cities, ''), city, ''), '[,，/、;；\\s]+'), lambda x: regexp_replace(x, '(?:省|市)$', '')), lambda x: x <> '') END"
_add(
    "p06_market_metrics",
    lambda s, d: told(s, d, P.market_metrics(kind_pairs(s, d, D.PLACED)), D.PLACED),
    PAIRS + f"SELECT profile_id, count(*) AS sample, count(DISTINCT company_name) AS companies, count(DISTINCT {REGION}) AS regions, count(*) FILTER (contains(coalesce(source, ''), '官方')) AS official, count(*) FILTER (apply_end_date IS NOT NULL) AS deadline_known, count(*) FILTER (len({_PREF}) = 0 OR len(list_filter({_PREF}, lambda x: contains(coalesce(work_location, ''), x))) > 0) AS preferred_region FROM pairs GROUP BY 1",
    _JV, _PV,
)
_add("p07_salary_bands", lambda s, d: P.salary_bands(jobs(s, d), "company_type"), JOBS_N + "SELECT company_type, floor(median(salary_min) * 10 + 0.5) / 10 AS median_min, floor(median(salary_max) * 10 + 0.5) / 10 AS median_max FROM jobs_n GROUP BY 1", _JV)
_ANY = {k: "|".join(p for _, p in rs) for k, rs in rules.SIGNALS.items()}
_add(
    "p08_signal_counts",
    lambda s, d: P.signal_counts(jobs(s, d)),
    JOBS_N
    + ", c AS ("
    + " UNION ALL ".join(f"SELECT '{k}' AS kind, '{label}' AS signal, count(*) FILTER (regexp_matches({_TEXT}, '{p}')) AS jobs, count(*) FILTER (regexp_matches({_TEXT}, '{_ANY[k]}')) AS any_jobs, count(*) AS total FROM jobs_n" for k, rs in rules.SIGNALS.items() for label, p in rs)
    + ") SELECT *, CASE WHEN any_jobs <= 0 THEN 'unavailable' WHEN any_jobs >= 5 AND any_jobs / total >= 0.3 THEN 'available' ELSE 'partial' END AS status FROM c",
    _JV,
)
_CL = "CAST(greatest(0, least(100, floor({x} + 0.5))) AS INT)"
_add(
    "p09_competitiveness",
    lambda s, d: P.competitiveness(profiles(s, d), J.market_layers(view(s, d, "jobs_v"), profiles(s, d)), told(s, d, kind_pairs(s, d, ["code"]).groupBy("profile_id").agg(F.count_distinct("company_name").alias("companies")), ["code"])),
    PAIRS + LAYERS + f""", co AS (SELECT profile_id, count(DISTINCT company_name) AS companies FROM pairs GROUP BY 1)
, f AS (SELECT profile_id, CASE WHEN regexp_matches(school_tier, '985|211') THEN 90 WHEN regexp_matches(school_tier, '双一流') THEN 84 WHEN regexp_matches(school_tier, '海外') THEN 70 WHEN regexp_matches(school_tier, '高职|专科') THEN 48 WHEN school_tier <> '' THEN 62 ELSE 50 END AS school,
 {_CL.format(x="CASE WHEN strict_profile > 0 THEN 55 + least(35.0, CASE WHEN campus_intern > 0 THEN strict_profile / campus_intern ELSE 0.0 END * 280) WHEN campus_intern > 0 THEN 38.0 ELSE 30.0 END")} AS major_entry,
 CASE degree_level {" ".join(f"WHEN '{k}' THEN {v}" for k, v in rules.DEGREE_SCORE.items())} END AS degree_base,
 CASE WHEN strict_profile <= 0 THEN 25 ELSE {_CL.format(x="least(95.0, 35 + log2(strict_profile + 1.0) * 8.5) * 0.72 + least(95.0, 32 + log2(greatest(1, coalesce(companies, 0)) + 1.0) * 10) * 0.28")} END AS opportunity,
 {_CL.format(x="round((" + " + ".join(f"CASE {_LV[k]} WHEN 'ready' THEN 92 WHEN 'developing' THEN 65 ELSE 35 END" for k, _, _ in rules.CAPABILITIES) + ") / 6, 6)")} AS prepared FROM profiles_v JOIN layers USING (profile_id) LEFT JOIN co USING (profile_id))
, w AS (SELECT *, round(school * 0.25 + major_entry * 0.25 + degree_base * 0.15 + opportunity * 0.2 + prepared * 0.15, 6) AS w FROM f), z AS (SELECT * EXCLUDE (w), {_CL.format(x="w")} AS score, {_CL.format(x="round(w + (92 - prepared) * 0.15, 6)")} AS potential FROM w)
SELECT *, CASE WHEN score >= 80 THEN 'strong' WHEN score >= 70 THEN 'fairly-strong' WHEN score >= 55 THEN 'medium' WHEN score >= 40 THEN 'fairly-weak' ELSE 'weak' END AS band, greatest(0, potential - score) AS room FROM z""",
    _JV, _PV,
)
