"""The ingest chain: scope, decoding, roles, routes; a stream, a repeated run, and what a run reads."""

import pytest

from career_lake.operators import pages as T
from career_lake.streaming import ingest as Z

PAGES = "page_id long, source_id string, url string, body binary, content_type string"
BODY = "报名时间：2026年1月1日至2026年8月{d}日截止。学历要求：{e}及以上。面向2026届高校毕业生招聘，招聘人数：20人。" + "其他说明文字。" * 20


def page(i, url, title, text, code="utf-8", source="s"):
    html = f"<html><head><title>{title}</title></head><body><article><p>{text}</p></article></body></html>"
    return (i, source, url, html.encode(code), "text/html")


@pytest.fixture(scope="module")
def sources(spark):
    return spark.createDataFrame([("s", "https://a.example.com/list", None, ["/jobs"], ["/jobs/old"])], "source_id string, url string, allowed_hosts array<string>, include_paths array<string>, exclude_paths array<string>")


RUNS = [
    [
        page(1, "https://A.example.com/jobs/1?utm_source=x", "某某公司招聘公告", BODY.format(d=1, e="本科"), "gb18030"),
        page(2, "https://a.example.com/jobs/2", "关于延期某某公司招聘的通知", BODY.format(d=9, e="本科")),
        page(3, "https://a.example.com/jobs/old/3", "旧公告", BODY.format(d=1, e="本科")),
        page(4, "https://b.example.com/jobs/4", "别处", BODY.format(d=1, e="本科")),
        page(5, "https://a.example.com/jobs/5", "短公告标题", "短公告标题" * 10),
        page(6, "https://a.example.com/jobs/1", "某某公司招聘公告", BODY.format(d=2, e="本科")),
        page(7, "https://a.example.com/jobs/7", "unknown", BODY.format(d=1, e="本科"), source="none"),
    ],
    [
        page(8, "https://a.example.com/jobs/1", "某某公司招聘公告", BODY.format(d=3, e="硕士")),
        page(9, "https://a.example.com/jobs/2", "关于延期某某公司招聘的通知", BODY.format(d=9, e="本科") + "补充。"),
        page(10, "https://a.example.com/jobs/5", "短公告标题", "短公告标题" * 10),
    ],
    [page(11, "https://a.example.com/jobs/1", "某某公司招聘公告", BODY.format(d=2, e="本科") + "补充说明。")],
]
WANT = [
    ("/jobs/1", 1, "evidence", "upsert", "active"), ("/jobs/1", 2, "evidence", "staged", "staged"), ("/jobs/1", 3, "evidence", "upsert", "active"),
    ("/jobs/2", 1, "evidence", "cross_review", "review_pending"), ("/jobs/2", 2, "evidence", "passthrough", "review_pending"), ("/jobs/5", 1, "content_stub", "upsert", "active"),
]


def told(spark, target):
    return sorted((r.canonical_url.removeprefix("https://a.example.com"), r.version_no, r.role, r.route, r.status) for r in Z.corpus_versions(spark, target).collect())


def test_stream_equals_runs_and_repeats_add_nothing(spark, sources, tmp_path):
    by_run, by_stream, path = str(tmp_path / "runs"), str(tmp_path / "stream"), str(tmp_path / "in")
    for k, rows in enumerate(RUNS):
        df = spark.createDataFrame(rows, PAGES)
        Z.ingest_run(df, sources, by_run)
        df.coalesce(1).write.mode("append").parquet(path)
        if k == 1:
            continue  # the second start finds two new files
        stream = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", 1).parquet(path)
        assert Z.stream_corpus(stream, sources, by_stream, str(tmp_path / "cp")).awaitTermination(240)
    assert told(spark, by_run) == told(spark, by_stream) == WANT
    reviews = sorted((r.kind, tuple(r.reasons)) for r in Z.corpus_reviews(spark, by_run).collect())
    assert [k for k, _ in reviews] == ["content_quality", "cross_document_change", "fact_change"]
    assert {"deadline_changed", "minimum_degree_changed"} <= set(reviews[2][1])
    Z.ingest_run(spark.createDataFrame(RUNS[0] + RUNS[1][1:], PAGES), sources, by_run)
    assert told(spark, by_run) == WANT and Z.corpus_reviews(spark, by_run).count() == 3
    plan = Z._held(spark, f"{by_run}/versions", Z.VERSION, ["00", "a1"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [prefix" in plan


def test_rejected_texts_stay_out(spark, sources, tmp_path):
    target = str(tmp_path / "t")
    Z.ingest_run(spark.createDataFrame(RUNS[0], PAGES), sources, target)
    again = spark.createDataFrame(RUNS[1], PAGES)
    gone = Z.fetched_documents(again, sources).where("canonical_url like '%/jobs/1'").select("document_id", "content_hash")
    Z.ingest_run(again, sources, target, gone)
    assert ("/jobs/1", 2, "evidence", "staged", "staged") not in told(spark, target) and len(told(spark, target)) == 4
    Z.ingest_run(again.limit(0), sources, target)
    assert len(told(spark, target)) == 4


def test_three_encodings_give_one_text(spark):
    text = "<p>" + "招聘公告 Straße " * 10 + "</p>"
    rows = [(i, "https://h/x", text.encode(c), t) for i, (c, t) in enumerate([("utf-8", None), ("gb18030", "text/html; charset=nope"), ("utf-16-le", "text/html; Charset=UTF-16-LE"), ("utf-8", "text/html; charset=ascii")])]
    rows += [(8, "https://h/x", None, None), (9, None, b"\xff\xfe\x00\x80", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, body binary, content_type string")
    got = {r.page_id: r.html for r in T.decode_pages(df).collect()}
    assert got[0] == got[1] == got[2] == got[3] == text and got[8] == "" and len(got[9]) > 0
    assert {r.content for r in T.extract_html(df.where("page_id < 4")).collect()} == {" ".join(("招聘公告 Straße " * 10).split())}
