"""Facet windows, excerpts and appendices: known cases."""

import pytest
from pyspark.sql import functions as F

from career_lake.operators import excerpts as X

SOURCE = "answer_id int, place int, title string, url string, snippet string"
ANSWER = "answer_id int, query string, answer string, companies array<string>, job_titles array<string>, valid_at string"


def appendix(spark, answer, query, sources, companies=(), titles=(), day="2026-07-17"):
    a = spark.createDataFrame([(1, query, answer, list(companies), list(titles), day)], ANSWER)
    s = spark.createDataFrame([(1, i + 1, *x) for i, x in enumerate(sources)], SOURCE)
    return X.verified_appendix(a, s).first()


CLOUD = ("某云公告", "https://e.example.com/cloud", "工作地点：北京、上海、广州、深圳。每人只有1次投递机会。 … 引才方向：智算网络、大数据、云操作系统。")
MODEL = ("某模型人才计划", "https://e.example.com/model", "前沿领域包括具身智能。投递方式为邮箱投递，邮箱 hr@example.com。")


def test_appendix_follows_a_grounded_answer(spark):
    r = appendix(spark, " 已核验招聘方向。（资料1）", "有哪些技术方向、工作城市和投递要求？", [CLOUD])
    assert r.grounded and r.answer.startswith("已核验招聘方向。[资料1]\n\n已核验资料原文：\n- ") and r.cited_sources == [1]
    assert all(x in r.answer for x in ("北京、上海", "1次投递", "智算网络、大数据"))


def test_two_sources_only_where_the_answer_compares(spark):
    said = "前者限投一次。[资料1]\n后者邮箱投递。[资料2]"
    both = appendix(spark, said, "对比两个计划的技术方向与投递方式", [CLOUD, MODEL], ["某云", "某模型"])
    assert "智算网络" in both.answer and "hr@example.com" in both.answer and both.cited_sources == [1, 2]
    one = appendix(spark, "限投一次。[资料1]", "投递方式", [CLOUD, MODEL], ["某云", " 某云 "])
    assert "hr@example.com" not in one.answer and one.cited_sources == [1]


def test_failed_citations_leave_evidence_only(spark):
    for said in ("没有引用", "引用过多。[资料3]", "", None):
        r = appendix(spark, said, "报名何时截止", [("招聘 - 列表", "https://e.example.com/a", "列表"), ("公告", "https://e.example.com/b", "报名截止时间：2026年7月16日17:30。")])
        assert not r.grounded and r.answer.split("\n")[0] == X.EVIDENCE_ONLY and r.cited_sources == [2]
        assert r.answer.endswith("公告报名截止时间为2026年7月16日17:30；以2026-07-17为基准，已截止。[资料2]")
    lists = appendix(spark, "详见这份列表。[资料1]", "报名", [("公告", "https://e.example.com/index_1.html", "报名方式：网申。")])
    assert lists.grounded and "报名方式" in lists.answer  # only lists: they count
    a = spark.createDataFrame([(1, "报名", "回答。[资料1]", None, None, "2026-07-17")], ANSWER)
    bare = X.verified_appendix(a, spark.createDataFrame([], SOURCE)).first()
    assert (bare.grounded, bare.answer, bare.cited_sources) == (False, X.EVIDENCE_ONLY, [])


def test_excerpts_keep_every_facet_and_no_repetition(spark):
    text = "首页 收藏 " + "说明。" * 300 + "学历要求：本科及以上。" + "说明。" * 300 + "报多截止时间：2026年8月1日。" + "说明。" * 300 + "年龄要求：不超过35岁。（责任编辑：某）页脚"
    rows = [(1, "学历和年龄要求，报名何时截止？", text), (2, "年龄", "短文 短文"), (3, None, None), (4, "x", "")]
    got = {r.id: r.excerpts for r in X.evidence_excerpts(spark.createDataFrame(rows, "id int, query string, snippet string")).collect()}
    assert len(got[1]) <= 6 and all(any(w in e for e in got[1]) for w in ("学历要求：本科", "报名截止时间：2026年8月1日", "年龄要求：不超过35岁"))
    assert not any("页脚" in e or len(e) > 480 for e in got[1]) and got[2] == ["短文 短文"] and got[3] == got[4] == []
    many = [f"第{i}段 " + "招聘专业：电气工程。" * 3 + str(i) for i in range(9)]
    six = X.evidence_excerpts(spark.createDataFrame([(1, "", " … ".join(many))], "id int, query string, snippet string")).first().excerpts
    assert six == many[:6]
    fold = spark.createDataFrame([(["ab", "AB", "abc", "b", "", "xy", "1", "2", "3", "4", "5"],)], "l array<string>").select(X.distinct_excerpts(F.col("l")).alias("l")).first().l
    assert fold == ["ab", "xy", "1", "2", "3", "4"]


@pytest.mark.parametrize("gap", [10, 400])
def test_facet_windows_fill_what_the_snippet_lacks(spark, gap):
    content = "公告正文。" * 400 + "招聘对象：2027届高校毕业生。" + "字" * gap + "需求学科：人工智能、软件工程。" + "字" * gap + "投递方式：官网。" + "字" * 2000
    rows = [(1, "招聘对象、专业和投递方式", content, "公告正文。"), (2, "招聘对象", content, "招聘对象：见公告"), (3, "天气", content, "公告"), (4, None, None, None)]
    got = {r.id: r for r in X.facet_windows(spark.createDataFrame(rows, "id int, query string, content string, snippet string")).collect()}
    s = got[1].merged_snippet
    assert s.startswith("公告正文。 … …") and len(s) <= 2500 and all(x in s for x in ("2027届高校毕业生", "人工智能、软件工程", "投递方式：官网"))
    assert s.count(" … ") == (1 if gap == 10 else 3)
    assert got[2].merged_snippet == "招聘对象：见公告" and got[3].merged_snippet == "公告" and got[4].merged_snippet == ""
