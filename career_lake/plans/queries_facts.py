"""Queries of facts, relations and entities, with oracle SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from career_lake import rules
from career_lake.operators import facts as N
from career_lake.operators import relations as X
from career_lake.plans.bindings import VIEWS, oracle, view

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_A = "announcements_v"


def _add(name: str, f, sql: str | None = None, *views: str) -> None:  # noqa: ANN001
    QUERIES[name] = f
    if sql:
        ORACLES[name] = oracle(sql, *views)


def docs(s: SparkSession, d: str) -> DataFrame:
    """The announcements; the view deals its small files over all cores, so their texts are not dealt again."""
    return view(s, d, _A)


def _compacted(df: DataFrame) -> DataFrame:
    """Texts are compacted once, in rows of their own: patterns inside array functions would each do it again."""
    return df.select("version_id", N.compact(F.col("content")).alias("text"))


def _facet(f):  # noqa: ANN001, ANN202
    def run(s: SparkSession, d: str) -> DataFrame:
        return _compacted(docs(s, d)).select("version_id", F.array_join(f(F.col("text")), ",").alias("found"))

    return run


S = ", s AS (SELECT version_id, unnest(regexp_extract_all(content, '[^。！？；;\\n]{1,220}[。！？；;]?')) AS t FROM announcements_v)"
_ALL = " SELECT v.version_id, coalesce(string_agg(DISTINCT x, ',' ORDER BY x), '') AS found FROM announcements_v v LEFT JOIN f USING (version_id) GROUP BY 1"
_add(
    "f01_deadlines",
    _facet(N.deadlines),
    S
    + """, f AS (SELECT version_id, concat(y, '-', lpad(m, 2, '0'), '-', lpad(dd, 2, '0'), CASE WHEN h <> '' AND CAST(h AS INT) < 24 THEN concat('T', lpad(h, 2, '0'), ':', CASE WHEN mi <> '' THEN mi ELSE '00' END) ELSE '' END) AS x FROM (SELECT version_id, regexp_extract(t, '至(20\\d\\d)年(\\d+)月(\\d+)日', 1) AS y, regexp_extract(t, '至(20\\d\\d)年(\\d+)月(\\d+)日', 2) AS m, regexp_extract(t, '至(20\\d\\d)年(\\d+)月(\\d+)日', 3) AS dd, regexp_extract(t, '日(\\d+)(?:[:：]|时)', 1) AS h, regexp_extract(t, '日\\d+[:：](\\d\\d)', 1) AS mi FROM s WHERE regexp_matches(t, '截止|报名时间')) WHERE y <> '')"""
    + _ALL,
    _A,
)
_add(
    "f02_minimum_degree",
    lambda s, d: docs(s, d).select("version_id", N.minimum_degree(N.compact(F.col("content"))).alias("degree")),
    S + f", g AS (SELECT version_id, min(CASE WHEN regexp_matches(t, '大专|专科') THEN 0 WHEN contains(t, '本科') THEN 1 WHEN regexp_matches(t, '硕士|研究生及以上') THEN 2 WHEN contains(t, '博士') THEN 3 END) AS r FROM s WHERE regexp_matches(t, '{rules.DEGREE_CONTEXT}') GROUP BY 1) SELECT v.version_id, CASE r WHEN 0 THEN '专科' WHEN 1 THEN '本科' WHEN 2 THEN '硕士' WHEN 3 THEN '博士' END AS degree FROM announcements_v v LEFT JOIN g USING (version_id)",
    _A,
)
_add(
    "f03_graduation_years",
    _facet(N.graduation_years),
    S + ", f AS (SELECT version_id, unnest(list_concat(regexp_extract_all(t, '(20\\d\\d)(?:\\s*[-—–至到]\\s*(20\\d\\d))?\\s*届', 1), list_filter(regexp_extract_all(t, '(20\\d\\d)(?:\\s*[-—–至到]\\s*(20\\d\\d))?\\s*届', 2), lambda y: y <> ''))) AS x FROM s WHERE regexp_matches(t, '应届|毕业|校园招聘|校招'))" + _ALL,
    _A,
)
_add("f07_application_limits", _facet(N.application_limits), ", f AS (SELECT version_id, unnest(regexp_extract_all(content, '每人[^。；;\\n]{0,40}?(?:可|限|最多)[^。；;\\n]{0,20}?投递\\s*(\\d+)\\s*个', 1)) AS x FROM announcements_v)" + _ALL, _A)
_add(
    "f08_ages",
    _facet(N.age_requirements),
    ", f AS (SELECT version_id, unnest(CASE WHEN contains(content, '硕士年龄不超过35周岁，本科年龄未满30岁') THEN ['硕士=≤35', '本科=<30'] ELSE [] END) AS x FROM announcements_v)" + _ALL,
    _A,
)
_LOC = "list_transform(string_split_regex(replace(regexp_replace(regexp_replace(v0, '等地$', ''), '；.*$', ''), '和', '、'), '、'), lambda p: regexp_replace(replace(p, '自治区', ''), '市$', ''))"
_add(
    "f12_work_locations",
    _facet(N.work_locations),
    f", l AS (SELECT version_id, unnest(regexp_extract_all(content, '工作(?:地点|城市)(?:：|为)([^。]{{1,220}})', 1)) AS v0 FROM announcements_v), p AS (SELECT version_id, v0, unnest({_LOC}) AS p FROM l), f AS (SELECT version_id, concat('工作地点=', string_agg(DISTINCT replace(p, ' ', ''), '、' ORDER BY replace(p, ' ', ''))) AS x FROM p WHERE regexp_full_match(replace(p, ' ', ''), '[\\x{{3400}}-\\x{{9fff}}A-Za-z·-]{{1,18}}') GROUP BY version_id, v0)" + _ALL,
    _A,
)
_add(
    "f13_headcounts",
    _facet(N.headcounts),
    ", f AS (SELECT version_id, concat('招聘人数=', CASE h WHEN '二十三' THEN '23' WHEN '一百零五' THEN '105' ELSE h END) AS x FROM (SELECT version_id, regexp_extract(content, '招聘人数：([^人]+)人', 1) AS h FROM announcements_v))" + _ALL,
    _A,
)
_add(
    "f15_lifecycle",
    lambda s, d: docs(s, d).groupBy(F.array_join(N.lifecycle(F.col("title"), N.compact(F.col("content"))), ",").alias("lifecycle")).agg(F.count("*").alias("versions")),
    """SELECT CASE WHEN starts_with(title, '关于延期') THEN 'delayed' WHEN starts_with(title, '关于撤回') THEN 'withdrawn' WHEN starts_with(title, '关于更正公告') THEN 'corrected'
 WHEN regexp_matches(title, '暂停[^。；;\\n]{0,24}?招聘') THEN 'paused' ELSE '' END AS lifecycle, count(*) AS versions FROM announcements_v GROUP BY 1""",
    _A,
)
_add("f16_fact_coverage", lambda s, d: N.fact_coverage(docs(s, d)))
_add("f17_version_diff", lambda s, d: N.version_diff(docs(s, d)).select("document_id", "enriched", F.array_join("reasons", ",").alias("reasons")))
_add(
    "f18_length_regimes",
    lambda s, d: N.length_regimes(docs(s, d)).groupBy("regression", "enriched").agg(F.count("*").alias("documents")),
    ", n AS (SELECT document_id, version_no, length(content) AS n FROM announcements_v), p AS (SELECT a.n AS m, b.n AS n FROM n a JOIN n b ON a.document_id = b.document_id AND a.version_no = 1 AND b.version_no = 2) SELECT m >= 500 AND n < m * 0.6 AS regression, m < 240 AND n >= 400 AND n >= m * 1.5 AS enriched, count(*) AS documents FROM p GROUP BY ALL",
    _A,
)


_Y = "CAST(year(o_orderdate) + 30 AS STRING)"
VIEWS["conditions_v"] = f"""
SELECT CAST(o_orderkey AS STRING) AS version_id, o_orderkey, {_Y} AS y, concat(
  CASE o_orderkey % 4 WHEN 0 THEN concat('境外毕业生须在', {_Y}, '年7月31日前取得学历学位认证。') WHEN 1 THEN concat('毕业时间为', {_Y}, '年1月1日至', {_Y}, '年7月31日。') WHEN 2 THEN concat('国内应届生毕业证时间不早于', {_Y}, '年9月1日。') ELSE '' END,
  CASE o_orderkey % 5 WHEN 0 THEN concat('笔试时间：', {_Y}, '年3月5日。') WHEN 1 THEN '面试暂定于4月6日举行。' WHEN 2 THEN concat('招聘笔试安排在', {_Y}, '年5月1日至', {_Y}, '年5月3日。') WHEN 3 THEN concat('英语四级考试时间', {_Y}, '年6月1日。') ELSE '' END,
  CASE o_orderkey % 6 WHEN 0 THEN '硕士工作经验满三年。' WHEN 1 THEN '具有5年以上相关工作经验。' WHEN 2 THEN '本科从业经历不少于十二年，硕士任职至少2年。' ELSE '' END,
  CASE o_orderkey % 7 WHEN 0 THEN '要求英语六级425分以上。' WHEN 1 THEN '本科通过CET-4。' WHEN 2 THEN '英语四级。' ELSE '' END,
  CASE o_orderkey % 3 WHEN 0 THEN '专业要求：会计学、金融学；学历：本科。' WHEN 1 THEN '电子类：通信工程相关专业。' ELSE '' END,
  CASE o_orderkey % 8 WHEN 0 THEN concat('报名网址：https://www.job', CAST(o_orderkey % 9 AS STRING), '.example.com//apply/?utm_source=x&b=2&a=1。') WHEN 1 THEN concat('简历投递邮箱 HR', CAST(o_orderkey AS STRING), '@Example.com。') WHEN 2 THEN '请登录 zp.example.com:8080/x 报名。' WHEN 3 THEN '详见 www.example.com 。' ELSE '' END) AS content
FROM {{orders}}"""


def _condition(f):  # noqa: ANN001, ANN202
    return lambda s, d: _compacted(view(s, d, "conditions_v")).select("version_id", F.array_join(f(F.col("text")), "|").alias("found"))


def _told(name: str, f, key: str) -> None:  # noqa: ANN001
    _add(name, _condition(f), f" SELECT version_id, CASE {key} ELSE '' END AS found FROM conditions_v", "conditions_v")


_told("f04_graduation_dates", N.graduation_dates, "o_orderkey % 4 WHEN 0 THEN concat('境外:认证≤', y, '-07-31') WHEN 1 THEN concat('通用:毕业=', y, '-01-01..', y, '-07-31') WHEN 2 THEN concat('境内:毕业≥', y, '-09-01')")
_told("f06_assessment_dates", N.assessment_dates, "o_orderkey % 5 WHEN 0 THEN concat('笔试:确定=', y, '-03-05') WHEN 1 THEN '面试:暂定=--04-06' WHEN 2 THEN concat('笔试:确定=', y, '-05-01..', y, '-05-03')")
_told("f09_experience", N.experience_requirements, "o_orderkey % 6 WHEN 0 THEN '硕士=≥3' WHEN 1 THEN '通用=≥5' WHEN 2 THEN '本科=≥12|硕士=≥2'")
_told("f10_languages", N.language_requirements, "o_orderkey % 7 WHEN 0 THEN '通用=CET6≥425' WHEN 1 THEN '本科=CET4'")
_told("f11_majors", N.major_requirements, "o_orderkey % 3 WHEN 0 THEN '专业=会计学、金融学' WHEN 1 THEN '电子类=通信工程相关专业'")
_told("f14_channels", N.application_channels, "o_orderkey % 8 WHEN 0 THEN concat('网址=job', CAST(o_orderkey % 9 AS VARCHAR), '.example.com/apply?a=1&b=2') WHEN 1 THEN concat('邮箱=hr', version_id, '@example.com') WHEN 2 THEN '网址=zp.example.com:8080/x'")


def notices(s: SparkSession, d: str) -> DataFrame:
    # Each status gives a relation; a filter on the type would be pushed down as five copies of the status.
    n = X.change_attributes(docs(s, d).where("version_no = 1")).where("size(lifecycle) > 0")
    link = F.concat(F.regexp_extract("canonical_url", "^(.*/)", 1), F.lit(""))
    return n.withColumn("notice_id", F.col("document_id")).withColumn("url", F.col("canonical_url")).withColumn("links", F.array(F.concat(F.regexp_replace(link, "h\\d+", F.lit("h1")), (F.col("o_orderkey") + 1).cast("string"))))


def scored(s: SparkSession, d: str) -> DataFrame:
    return X.scored_pairs(notices(s, d), docs(s, d).where("version_no = 2"))


_add(
    "x01_change_attributes",
    lambda s, d: X.change_attributes(docs(s, d).where("version_no = 1")).groupBy("relation_type", "change_scope", "resume_completeness", "resolution_mode").agg(F.count("*").alias("documents")),
)
_add(
    "x02_candidate_pairs",
    lambda s, d: X.candidate_pairs(notices(s, d), docs(s, d).where("version_no = 2")).select("notice_id", "document_id", "linked"),
    """, n AS (SELECT document_id AS notice_id, source_id, canonical_url AS url, official, concat('https://h1.example.com/a/', CAST(o_orderkey + 1 AS VARCHAR)) AS link FROM announcements_v WHERE version_no = 1 AND (starts_with(title, '关于延期') OR starts_with(title, '关于撤回') OR starts_with(title, '关于更正公告') OR regexp_matches(title, '暂停[^。；;\\n]{0,24}?招聘')))
, d AS (SELECT * FROM announcements_v WHERE version_no = 2)
, p AS (SELECT notice_id, document_id, updated_at, link = d.canonical_url AND ((n.official AND d.official) OR n.source_id = d.source_id) AS linked FROM n JOIN d ON n.url <> d.canonical_url AND (n.source_id = d.source_id OR (n.official AND d.official AND (regexp_extract(n.url, '//([^/]*)', 1) = regexp_extract(d.canonical_url, '//([^/]*)', 1) OR link = d.canonical_url))))
, r AS (SELECT *, row_number() OVER (PARTITION BY notice_id ORDER BY updated_at DESC, document_id) AS k FROM p) SELECT notice_id, document_id, linked FROM r WHERE k <= 200 OR linked""",
    _A,
)
_add("x04_top_targets", lambda s, d: X.top_targets(scored(s, d)).select("notice_id", "document_id", "score", "blocked", "unresolved", "rank", F.array_join("evidence", ",").alias("evidence")))


def companies(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "jobs_v").select(F.trim("company_name").alias("entity")).where("entity <> ''").distinct()


_SUF = rules.COMPANY_SUFFIX
_ET = "regexp_replace(lower(entity), '[^a-z0-9\\x{3400}-\\x{9fff}]+', '', 'g')"
_add(
    "e01_entity_variants",
    lambda s, d: companies(s, d).select("entity", F.array_join(X.entity_variants(F.col("entity")), "|").alias("variants")),
    f", e AS (SELECT DISTINCT trim(company_name) AS entity FROM jobs_v WHERE trim(company_name) <> ''), c AS (SELECT entity, {_ET} AS fu, regexp_replace({_ET}, '{_SUF}', '') AS core FROM e) SELECT entity, array_to_string(list_filter(CASE WHEN core = fu THEN [fu] ELSE [fu, core] END, lambda v: length(v) >= 3), '|') AS variants FROM c",
    "jobs_v",
)


def _entities(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "jobs_v").select(F.when(F.col("company_name").contains("电网"), "电网公司").when(F.col("company_name").contains("银行"), "银行").when(F.col("company_name").contains("铁路"), "铁路局集团公司").otherwise("中国石油").alias("entity")).distinct()


_add(
    "e02_match_entities",
    lambda s, d: X.match_entities(view(s, d, "jobs_v").select(F.col("id").alias("text_id"), F.concat_ws(" ", "company_name", "job_title").alias("text")), _entities(s, d)).groupBy("entity").agg(F.count("*").alias("texts")),
    "SELECT '铁路局集团公司' AS entity, count(*) AS texts FROM jobs_v WHERE contains(concat_ws(' ', company_name, job_title), '铁路局') UNION ALL SELECT '电网公司', count(*) FROM jobs_v WHERE contains(concat_ws(' ', company_name, job_title), '电网公司')",
    "jobs_v",
)
