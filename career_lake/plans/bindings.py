"""Views of the test tables in the shape of the operators' inputs.

One SQL text serves Spark and DuckDB: {table} names are DataFrames in Spark and
views in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from career_lake.session import spread, table

NOW = "2026-07-22"

_DAY = "concat(CAST(year(o_orderdate) + 30 AS STRING), '-', lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '-', lpad(CAST(day(o_orderdate) AS STRING), 2, '0'))"
_YEAR = "CAST(year(o_orderdate) + 30 AS STRING)"
_MAJORS = "CASE {k} % 10 WHEN 0 THEN '计算机科学与技术' WHEN 1 THEN '软件工程专业' WHEN 2 THEN '电气工程及其自动化' WHEN 3 THEN '自动化' WHEN 4 THEN '金融学' WHEN 5 THEN '会计学' WHEN 6 THEN '酒店管理' WHEN 7 THEN '法学' WHEN 8 THEN '考古学' ELSE '通信工程' END"

VIEWS = {
    "jobs_v": f"""
SELECT CAST(o_orderkey AS STRING) AS id,
       CASE WHEN o_orderkey % 53 = 0 THEN '' ELSE concat('  ', c_name, CASE o_orderkey % 6 WHEN 0 THEN '电网公司' WHEN 1 THEN '银行' WHEN 2 THEN '铁路局' WHEN 3 THEN '酒店集团' WHEN 4 THEN '化工厂' ELSE '' END, ' ') END AS company_name,
       CASE o_orderkey % 4 WHEN 0 THEN '央企' WHEN 3 THEN '民企' ELSE '国企' END AS company_type,
       CASE WHEN o_orderkey % 47 = 0 THEN NULL ELSE concat(CASE c_mktsegment WHEN 'AUTOMOBILE' THEN '软件开发工程师' WHEN 'BUILDING' THEN '会计' WHEN 'FURNITURE' THEN '行政综合岗' WHEN 'HOUSEHOLD' THEN '客户服务专员' ELSE '电气设备检修' END, CASE WHEN o_orderkey % 13 = 0 THEN concat('（', {_YEAR}, '届校招）') ELSE '' END) END AS job_title,
       CASE o_orderkey % 3 WHEN 0 THEN '校招' WHEN 1 THEN '实习' ELSE '社招' END AS job_type,
       CASE o_orderkey % 8 WHEN 0 THEN '提供五险一金和企业年金，需要倒班' WHEN 1 THEN '导师制培养，定期轮岗，偶有出差' WHEN 2 THEN '六险二金，补充医疗，带薪年假，人才公寓' WHEN 3 THEN '野外作业，晋升通道清晰' WHEN 4 THEN '工作餐和通勤班车' WHEN 5 THEN '' ELSE NULL END AS job_description,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CASE o_orderkey % 7 WHEN 0 THEN '本科及以上' WHEN 1 THEN '学历要求：硕士' WHEN 2 THEN '大专、本科' WHEN 3 THEN '不限' WHEN 4 THEN '本科或硕士' WHEN 5 THEN '博士研究生' ELSE '优秀者优先' END END AS education_level,
       CASE o_orderkey % 9 WHEN 0 THEN NULL WHEN 1 THEN concat({_YEAR}, '届') WHEN 2 THEN concat({_YEAR}, '、', CAST(year(o_orderdate) + 31 AS STRING), '届毕业生') WHEN 3 THEN '不限' WHEN 4 THEN '26届' WHEN 5 THEN concat({_YEAR}, '年应届毕业生') WHEN 6 THEN '长期有效' WHEN 7 THEN '待定' ELSE concat({_YEAR}, '届') END AS graduate_year,
       CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 6 = 0 THEN concat('[["', n_name, '","上海市"],["', n_name, '"]]') ELSE CASE o_orderkey % 5 WHEN 0 THEN '北京市海淀区' WHEN 1 THEN '广东省、深圳市' WHEN 2 THEN '杭州市' WHEN 3 THEN '内蒙古自治区 ' ELSE n_name END END AS work_location,
       CASE WHEN o_orderkey % 12 = 0 THEN NULL WHEN o_orderkey % 12 = 1 THEN '专业不限' WHEN o_orderkey % 12 = 2 THEN '计算机、软件工程等相关专业' WHEN o_orderkey % 12 = 3 THEN '工科类相关专业' WHEN o_orderkey % 12 = 4 THEN '电气工程及其自动化，自动化' WHEN o_orderkey % 12 = 5 THEN '金融、会计优先' ELSE {_MAJORS.format(k="o_orderkey")} END AS major_requirements,
       CASE o_orderkey % 5 WHEN 0 THEN '["0809","0807","0809"]' WHEN 1 THEN '0806, 080601，x' WHEN 2 THEN '' WHEN 3 THEN '["0203"]' ELSE NULL END AS major_category_ids,
       CASE WHEN o_orderkey % 19 = 0 THEN '2026-09-01' ELSE NULL END AS apply_start_date,
       CASE WHEN o_orderkey % 14 = 0 THEN NULL ELSE {_DAY} END AS apply_end_date,
       CASE WHEN o_orderkey % 2 = 0 THEN concat('https://jobs.example.com/', CAST(o_orderkey AS STRING)) ELSE NULL END AS announcement_url,
       CASE o_orderkey % 4 WHEN 0 THEN '官方网站' WHEN 1 THEN '转载' ELSE NULL END AS source,
       CASE WHEN o_orderkey % 4 < 2 THEN CAST(o_orderkey % 23 AS DOUBLE) ELSE NULL END AS salary_min,
       CASE WHEN o_orderkey % 4 < 2 THEN CAST(o_orderkey % 23 + 5 AS DOUBLE) ELSE NULL END AS salary_max,
       {_DAY} AS created_at,
       CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE concat('2026-07-', lpad(CAST(1 + o_orderkey % 28 AS STRING), 2, '0')) END AS updated_at,
       CASE o_orderkey % 21 WHEN 0 THEN '已截止' WHEN 1 THEN ' Active ' ELSE NULL END AS status,
       o_orderkey % 1000 AS view_count
FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} ON c_nationkey = n_nationkey""",
    "profiles_v": f"""
SELECT CAST(c_custkey AS STRING) AS profile_id,
       CASE c_custkey % 7 WHEN 0 THEN 'unknown' WHEN 1 THEN 'associate' WHEN 2 THEN 'bachelor' WHEN 3 THEN 'bachelor' WHEN 4 THEN 'master' WHEN 5 THEN 'doctorate' ELSE 'bachelor' END AS degree_level,
       {_MAJORS.format(k="c_custkey")} AS major,
       2025 + CAST(c_custkey % 5 AS INT) AS graduation_year,
       CASE c_custkey % 4 WHEN 0 THEN '北京市、广东省' WHEN 1 THEN '全国' WHEN 2 THEN NULL ELSE '杭州，上海' END AS preferred_cities,
       CASE c_custkey % 3 WHEN 0 THEN '北京' ELSE NULL END AS city,
       CASE c_custkey % 5 WHEN 0 THEN '985' WHEN 1 THEN '双一流' WHEN 2 THEN '海外院校' WHEN 3 THEN '' ELSE '普通本科' END AS school_tier,
       CASE c_custkey % 3 WHEN 0 THEN 'missing' WHEN 1 THEN 'developing' ELSE 'ready' END AS resume,
       CASE c_custkey % 2 WHEN 0 THEN 'developing' ELSE NULL END AS application,
       CASE c_custkey % 4 WHEN 0 THEN 'ready' ELSE 'missing' END AS interview,
       CASE c_custkey % 5 WHEN 0 THEN 'ready' WHEN 1 THEN 'developing' ELSE NULL END AS project_evidence,
       CASE c_custkey % 6 WHEN 0 THEN 'developing' ELSE 'missing' END AS internship,
       CASE c_custkey % 2 WHEN 0 THEN 'ready' ELSE 'developing' END AS competition,
       CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE CAST(c_custkey % 50 AS INT) END AS weekly_hours
FROM {{customer}}""",
    "sources_v": """
SELECT source AS source_id, concat('https://', source, '.example.com/list') AS url, source AS name,
       CASE min(doc_id) % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'D' END AS source_grade,
       CASE min(doc_id) % 3 WHEN 0 THEN '央企,校招' WHEN 1 THEN '校招' ELSE '' END AS tags,
       min(doc_id) % 5 <> 0 AS enabled
FROM {documents} GROUP BY source""",
    "doc_versions_v": """
SELECT CAST(doc_id AS STRING) AS version_id, CAST(doc_id - doc_id % 40 + doc_id % 20 AS STRING) AS document_id,
       source AS source_id, concat('https://', source, '.example.com/d/', CAST(doc_id - doc_id % 40 + doc_id % 20 AS STRING)) AS canonical_url,
       CASE WHEN doc_id % 40 < 20 THEN 1 ELSE 2 END AS version_no,
       CASE doc_id % 9 WHEN 0 THEN '招聘信息' WHEN 1 THEN 'index_2.html' ELSE concat('招聘公告', CAST(doc_id AS STRING)) END AS title,
       text AS content, sha256_hex(text) AS content_hash,
       CASE doc_id % 6 WHEN 0 THEN 'review_pending' WHEN 1 THEN 'superseded' ELSE 'active' END AS status,
       CASE WHEN doc_id % 3 = 0 THEN '2026-05-01' ELSE NULL END AS published_at,
       CASE doc_id % 8 WHEN 0 THEN 'failed' WHEN 1 THEN 'required' ELSE NULL END AS ocr_status
FROM {documents}""",
}

_DATE = "concat(CAST(year(o_orderdate) + 30 AS STRING), '年', CAST(month(o_orderdate) AS STRING), '月', CAST(day(o_orderdate) AS STRING), '日')"
VIEWS |= {
    "announcements_v": f"""
SELECT CAST(o_orderkey AS STRING) AS document_id, concat(CAST(o_orderkey AS STRING), '-', CAST(v AS STRING)) AS version_id, v AS version_no, concat('src', CAST(o_orderkey % 20 AS STRING)) AS source_id,
       concat('https://h', CAST(o_orderkey % 7 AS STRING), '.example.com/a/', CAST(o_orderkey AS STRING)) AS canonical_url,
       CASE WHEN o_orderkey % 10 = 0 THEN concat('关于', CASE o_orderkey % 50 WHEN 0 THEN '延期' WHEN 10 THEN '暂停' WHEN 20 THEN '恢复' WHEN 30 THEN '撤回' ELSE '更正公告：' END, c_name, '招聘的通知') ELSE concat(c_name, {_YEAR}, '年校园招聘公告') END AS title,
       concat(CASE WHEN v = 2 AND o_orderkey % 7 = 0 THEN '' ELSE concat('报名时间：', CAST(year(o_orderdate) + 30 AS STRING), '年1月1日至', {_DATE}, CASE o_orderkey % 3 WHEN 0 THEN '17:30' WHEN 1 THEN '24时' ELSE '' END, '截止。') END,
         CASE WHEN v = 2 AND o_orderkey % 5 = 0 THEN '学历要求：硕士研究生及以上。' WHEN o_orderkey % 9 = 0 THEN '我们欢迎本科生。' ELSE '学历要求大专、本科及以上均可。' END,
         '面向', {_YEAR}, '届高校毕业生和退役军人招聘；', CASE WHEN o_orderkey % 6 = 0 THEN concat({_YEAR}, '-', CAST(year(o_orderdate) + 31 AS STRING), '届应届毕业生可报名。') ELSE '' END,
         '招聘人数：', CASE o_orderkey % 4 WHEN 0 THEN '二十三' WHEN 1 THEN '一百零五' ELSE CAST(1 + (o_orderkey + v) % 90 AS STRING) END, '人。', '每人最多可投递', CAST(1 + o_orderkey % 3 AS STRING), '个岗位。',
         CASE o_orderkey % 8 WHEN 0 THEN '工作地点：北京市、上海市和广州市。' WHEN 1 THEN '工作地点为内蒙古自治区；具体详见公告。' ELSE concat('工作城市：杭州、', n_name, '等地。') END,
         CASE WHEN o_orderkey % 5 = 1 THEN '硕士年龄不超过35周岁，本科年龄未满30岁。' ELSE '' END,
         CASE WHEN v = 1 AND o_orderkey % 7 = 0 THEN '{"其他说明文字。" * 60}' ELSE '其他说明。' END) AS content,
       CASE WHEN o_orderkey % 11 = 0 THEN 'superseded' ELSE 'active' END AS status, o_orderkey % 3 <> 0 AS official, CAST(o_orderdate AS STRING) AS updated_at, o_orderkey
FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} ON c_nationkey = n_nationkey CROSS JOIN (SELECT 1 AS v UNION ALL SELECT 2 AS v) AS vs""",
    "sync_events_v": """
SELECT concat(CAST(user_id AS STRING), '-', CAST(CAST(ts AS DATE) AS STRING)) AS run_id, concat('src', CAST(user_id % 20 AS STRING)) AS source_id,
       CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'changed' ELSE 'seen' END AS kind, ts, concat(event_type, ' ', CAST(event_id AS STRING)) AS message, event_id
FROM {events}""",
    "reviews_v": """
SELECT CAST(doc_id AS STRING) AS document_id, concat('src', CAST(doc_id % 20 AS STRING)) AS source_id, CASE WHEN toxic = 1 THEN 'fact_change' ELSE 'content_quality' END AS kind,
       concat('review ', CAST(doc_id % 30 AS STRING)) AS message, CASE WHEN quality = 0 THEN 'pending' ELSE 'resolved' END AS status, CAST(doc_id AS STRING) AS created_at
FROM {labels}""",
    "pages_v": "SELECT page_id, url, html FROM {pages}",
}
_SPARK = {"sha256_hex(text)": "sha2(text, 256)"}
_DUCK = {"sha256_hex(text)": "sha256(text)"}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: Small files whose rows make much work: views deal them over all cores before they read them.
SPREAD = {"customer": "c_custkey", "orders": "o_orderkey"}


def _input(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = table(spark, sf_dir, name)
    return spread(df, SPREAD[name]) if name in SPREAD else df


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A bound view as a DataFrame."""
    sql = VIEWS[name]
    for a, b in _SPARK.items():
        sql = sql.replace(a, b)
    return spark.sql(sql, **{t: _input(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in sql})


def oracle(body: str, *views: str) -> str:
    """DuckDB SQL: the bound views as common tables, then body (", x AS (...) SELECT ..." or "SELECT ...")."""
    parts = []
    for name in views:
        sql = VIEWS[name]
        for a, b in _DUCK.items():
            sql = sql.replace(a, b)
        for t in TABLES:
            sql = sql.replace(f"{{{t}}}", t)
        parts.append(f"{name} AS ({sql})")
    head = f"WITH {', '.join(parts)}" if parts else ""
    return f"{head}{body if body.lstrip().startswith(',') else ' ' + body}"
