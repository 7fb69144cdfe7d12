"""Cases with known results, for what SQL does not tell; and every query without oracle runs."""

import json

import pytest
from pyspark.sql import functions as F

from career_lake.operators import facts as N
from career_lake.operators import pages as T
from career_lake.operators import relations as X
from career_lake.operators.corpus import canonical_url
from career_lake.operators.pools import decision_pool
from career_lake.plans import registry
from career_lake.sources import readers as S
from career_lake.streaming import folds as Z
from career_lake.streaming import stateful as W

SF = "/root/testdata/sf0.001"


def one(spark, f, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("t"))).collect()]


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs_and_is_stable(spark, name):
    rows = sorted(map(str, registry.QUERIES[name](spark, SF).collect()))
    assert rows
    again = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    assert sorted(map(str, registry.QUERIES[name](spark, SF).collect())) == rows
    spark.conf.set("spark.sql.shuffle.partitions", again)


def test_deadlines(spark):
    got = one(
        spark, N.deadlines,
        "报名时间：2026年3月1日至3月20日18:00。", "报名截止日期2026年1月5日，3月2日面试。", "网申时间为5月1日至5月20日。", "报名时间，2026-07-01至2026-07-15", "招聘会2026年3月1日举行。", "截止时间：2026年12月20日至1月5日。",
    )
    assert got == [["2026-03-20T18:00"], ["2026-01-05"], ["--05-20"], ["2026-07-15"], [], ["--01-05"]]


def test_numbers_ages_places_audiences(spark):
    assert one(spark, N.chinese_number, "十", "二十三", "一百零五", "三千二百", "两万", "12", "0", "十万") == [10, 23, 105, 3200, 20000, 12, None, 100000]
    assert one(spark, N.age_requirements, "年龄不超过35周岁", "硕士年龄未满30岁", "年龄18周岁以上，35周岁以下") == [["通用=≤35"], ["硕士=<30"], ["通用=≤35"]]
    assert one(spark, N.work_locations, "工作地点：北京市、上海市和广州市。", "工作地点：详见公告。", "工作城市：内蒙古自治区等地") == [["工作地点=上海、北京、广州"], [], ["工作地点=内蒙古"]]
    rows = spark.createDataFrame([("社会招聘", "正文"), ("t", "面向2026届高校毕业生和退役军人"), ("t", "面向未就业高校毕业生"), ("t", "招聘对象：应往届毕业生；系统内外人员")], "a string, b string")
    got = {tuple(r[0]) for r in rows.select(N.audiences(F.col("a"), F.col("b"))).collect()}
    assert got == {("社会人员",), ("退役军人", "高校毕业生"), ("未就业毕业生",), ("应届毕业生", "往届毕业生")}


def test_changes_between_versions(spark):
    rows = [("d", "d1", 1, "公告", "报名截止2026年3月1日。招聘人数：5人。"), ("d", "d2", 2, "公告", "报名截止2026年3月9日。学历要求：本科。"), ("e", "e1", 1, "x", "字" * 600), ("e", "e2", 2, "延期公告", "字" * 100)]
    got = {r.document_id: r.reasons for r in N.version_diff(spark.createDataFrame(rows, "document_id string, version_id string, version_no int, title string, content string")).collect()}
    assert got == {"d": ["deadline_changed", "recruitment_headcount_changed_removed"], "e": ["content_regression", "lifecycle_changed"]}


def test_relations(spark):
    n = spark.createDataFrame([("n", "s1", "关于延期某某能源集团2026年校园招聘的公告", "某某能源集团2026年校园招聘公告，报名延期。")], "notice_id string, source_id string, title string, content string")
    d = spark.createDataFrame([("d1", "某某能源集团2026年校园招聘公告")], "document_id string, title string")
    pairs = spark.createDataFrame([("n", "d1", "s1", "http://a/1", "某某能源集团2026年校园招聘公告", "2026", False)], "notice_id string, document_id string, d_source string, d_url string, d_title string, updated_at string, linked boolean")
    r = X.top_targets(X.score_pairs(pairs, n, d)).first()
    assert (r.score, r.blocked, r.evidence) == (0.96, True, ["explicit_title"])
    e = spark.createDataFrame([("中国石油天然气集团有限公司",), ("华东勘测设计研究院",)], "entity string")
    t = spark.createDataFrame([(1, "中国石油化工招聘"), (2, "中国石油招聘"), (3, "华东勘测设计研究所招聘"), (4, "无")], "text_id int, text string")
    assert {(r.text_id, r.entity[:4]) for r in X.match_entities(t, e).collect()} == {(2, "中国石油")}
    assert {(r.text_id, r.entity[:4]) for r in X.fuzzy_match(t, e).collect()} == {(3, "华东勘测")}


def test_pages():
    html = "<html><head><title>T</title><meta name='date' content='2026-01-02'></head><body><nav><a href='/n'>n</a></nav><article><h1>Head &amp; more</h1><p>" + "word " * 20 + "</p><script>no()</script><a href='mailto:x@y'>m</a><a href='b?x=1'>b</a><a href='http://other/'>o</a><img src='/i.png'></article></body></html>"
    got = T.extract("http://h/a/", html)
    assert (got["title"], got["published_at"], got["links"], got["images"]) == ("Head & more", "2026-01-02", ["http://h/n", "http://h/a/b?x=1"], ["http://h/i.png"])
    assert "no()" not in got["content"] and T.extract("http://h/", "<p>short") is None


def test_urls_are_canonical_once(spark):
    urls = ["HTTP://Ex.COM:80/a?b=2&utm_source=x&a=1#f", "https://u@h.org:8443?q=a%20b&from=1", "http://h"]
    first = one(spark, canonical_url, *urls)
    assert first == ["http://ex.com/a?a=1&b=2", "https://h.org:8443/?q=a+b", "http://h/"]
    assert one(spark, canonical_url, *first) == first


def test_sources_feed_and_payloads(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"sources": [{"name": "n", "url": "u", "tags": ["b", "a", "b"], "max_documents": 900, "include_paths": ["x"]}, {"url": "no name"}]}))
    r = S.load_sources(spark, str(tmp_path / "s.json")).collect()
    assert len(r) == 1 and (r[0].tags, r[0].max_documents, r[0].include_paths, r[0].source_grade, r[0].enabled) == (["a", "b"], 500, ["/x"], "A", False)
    feed = spark.createDataFrame([('[{"result":{"data":{"json":{"jobs":[{"id":1},{"id":2}]}}}}]',), ('{"error":1,"result":{"data":{"jobs":[{"id":3}]}}}',), ('{"result":{"data":{"jobs":[{"id":4}]}}}',), ("bad",)], "value string")
    assert sorted(x[0] for x in S.load_job_feed(feed).select(F.try_variant_get("job", "$.id", "int")).collect()) == [1, 2, 4]
    pay = spark.createDataFrame([(1, '{"data":{"records":[{"t":"a"},{"t":"b"}]}}'), (2, '[{"t":"c"}]'), (3, "{}")], "query_id int, value string")
    assert sorted((x.query_id, x.t) for x in S.load_retrieval_payloads(pay).select("query_id", F.try_variant_get("item", "$.t", "string").alias("t")).where("t is not null").collect()) == [(1, "a"), (1, "b"), (2, "c")]


def test_snapshots(spark, tmp_path):
    root = str(tmp_path)
    for n in (1, 2):
        S.write_corpus({"documents": spark.range(n).withColumn("status", F.lit("active"))}, root, {"documents": "status"})
    assert S.read_corpus(spark, root, "documents").count() == 2


def test_stream_equals_batch_and_replays(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    rows = [("http://h/a", "x  y"), ("http://h/a?utm_source=1", "x y"), ("http://h/b", "\n"), ("http://h/c", "z")]
    pages = spark.createDataFrame(rows, "url string, content string")
    pages.write.parquet(src)
    for n in (1, 2):
        W.stream_ingest(spark.readStream.schema(pages.schema).parquet(src), out, str(tmp_path / f"c{n}")).awaitTermination()
    assert sorted(map(str, spark.read.parquet(out).select("canonical_url", "content").collect())) == sorted(map(str, W.ingest(pages).select("canonical_url", "content").collect()))


def test_quota_and_workspace(spark):
    rows = [(i, "a", "s", float(i)) for i in range(8)] + [(20, "a", "s", 61.0), (21, "a", "t", 5.0)]
    got = {r.request_id: r.allowed for r in Z.request_quota(spark.createDataFrame(rows, "request_id long, address string, session string, ts double")).collect()}
    assert [got[i] for i in range(8)] == [True] * 6 + [False] * 2 and got[20] and got[21]
    ev = spark.createDataFrame([("u", 1, "2026-07-01", 0), ("u", 2, "2026-07-02", 0), ("u", 3, "2026-07-03", 1), ("v", 4, "2025-01-01", 0)], "subject string, event_id long, t string, expected int").withColumn("ts", F.to_timestamp("t"))
    assert {r.subject: (r.revision, r.event_id, r.conflicts, r.expired) for r in W.workspace_state(ev, "2026-07-22").collect()} == {"u": (2, 3, 1, False), "v": (1, 4, 0, True)}


def test_quota_counts_a_session_over_all_its_addresses(spark):
    rows = [(i, "ab"[i % 2], "s", float(i)) for i in range(12)] + [(50, "c", "u", 3.0)]
    got = {r.request_id: r.allowed for r in Z.request_quota(spark.createDataFrame(rows, "request_id long, address string, session string, ts double")).collect()}
    assert sum(got[i] for i in range(12)) == 6 and got[50]


def test_decided_and_applied_partial_withdrawals(spark):
    rows = spark.createDataFrame([("公告", "经研究决定取消财务岗位招聘计划"), ("公告", "岗位情况：核减技术岗位。招聘"), ("公告", "决定不取消本次岗位")], "a string, b string")
    assert [r[0] for r in rows.select(N.lifecycle(F.col("a"), F.col("b"))).collect()] == [["withdrawn"], ["withdrawn"], []]


def test_pool_is_first_wins_under_both_keys(spark):
    jobs = spark.createDataFrame(
        [("1", "软件", "猎聘 甲", "北京", "本科", "2026届", ["0809"]), ("2", "软件", "甲", "北京", "本科", "2026届", ["0809"]), ("3", "软件", "乙", "上海", "硕士", "2026届", ["0809"]), ("4", "软件工程岗", "丙", None, None, None, [])],
        "id string, job_title string, company_name string, work_location string, education_level string, graduate_year string, major_category_ids array<string>",
    ).withColumn("major_requirements", F.lit("软件工程")).withColumn("apply_end_date", F.lit(None).cast("date"))
    p = spark.createDataFrame([("p", "软件工程", "0809", "bachelor", 2026)], "profile_id string, major string, code string, degree_level string, graduation_year int")
    assert [(r.id, r.strict) for r in decision_pool(jobs, p).orderBy("place").collect()] == [("1", True), ("3", False), ("4", False)]
