"""Facts that are looked up by piece are those that the patterns read from whole texts."""

import random

from pyspark.sql import functions as F

from career_lake.operators import fact_pieces as P
from career_lake.operators import facts as N
from career_lake.plans import queries_facts  # noqa: F401  its views
from career_lake.plans.bindings import view
from career_lake.streaming import stateful as Z

SF = "/root/testdata/sf0.001"
ODD = [
    "报名时间：2027年1月1日至3月4日17:30，逾期不候", "网申截止", "，2027年5月6日24时", "学历要求：硕士研究生及以上", "博士研究生及以上；学历不限", "应聘条件：大专！本科？", "2026-2027届应届毕业生可报名", "招聘人数：二十三人", "招聘人数：5人；招聘计划：5人",
    "每人最多可投递3个岗位", "每人限投递12个；每人限投递 2 个", "年龄", "35岁", "硕士年龄不超过35周岁，本科年龄未满30岁", "具有5年以上相关工作经验", "硕士工作经验满三年！本科从业经历不少于二年", "英语六级425分以上", "专业要求：会计学、\n金融学；学历：本科", "电子类：通信工程相关专业", "工作地点\n：北京市、上海市\n和 广州",
    "工作城市为 杭州；详见", "报名网址：https://www.a.example.com//x/?utm_source=1&b=2", "简历投递邮箱 HR@Example.com", "笔试时间：2027年3月5日，面试暂定于4月6日举行", "面向社会公开招聘，退役军人", "毕业证时间不早于2027年9月1日", "原公告调整如下，报名延期", "暂停招聘", "　\x85 ", "", "！", " x ", "\x1c", "长" * 230 + "学历本科", "甲" * 450,
]
TITLES = ["公告", "社会招聘公告", "校园招聘 ", "关于延期 招聘的通知", "关于撤回某某公司招聘公告的通知", "", None]


def odd_texts(n):
    pick = random.Random(11)
    return [("d", str(i), pick.choice(TITLES), "".join(pick.choice(ODD) + pick.choice(["。", "。", "。 ", "；", "\n", "。。"]) for _ in range(pick.randint(0, 6)))[: pick.choice([None, None, -1])]) for i in range(n)] + [("d", "null", "社招", None)]


def test_looked_up_facts_are_those_of_the_patterns(spark, monkeypatch):
    odd = spark.createDataFrame(odd_texts(600) * 2, "document_id string, version_id string, title string, content string")
    docs = odd.union(view(spark, SF, "announcements_v").select(odd.columns).limit(300)).union(view(spark, SF, "conditions_v").selectExpr("'c'", "version_id", "'校招'", "content").limit(300)).repartition(2).localCheckpoint()
    columns = [docs.schema[c].name for c in ("document_id", "version_id")]
    facts = lambda: {(r.document_id, r.version_id): (r.facts, r.compact_length) for r in N.with_facts(docs).select(*columns, "facts", "compact_length").collect()}
    want = facts()  # a small table, read by the patterns
    monkeypatch.setattr(P, "FEW_TEXTS", 0)
    told = []
    look = P._lookup
    monkeypatch.setattr(P, "_lookup", lambda shared, facets: told.append(shared.value) or look(shared, facets))
    assert facts() == want and len(told) == 1
    texts = docs.select("content").collect()
    assert sum(all(p in told[0] for t in (P._compact(r.content), r.content) for p in P._PIECE.findall(t)) for r in texts if r.content is not None) > 0.3 * len(texts)
    assert {f for row, _ in want.values() for f in N.FACETS if row[f]} == set(N.FACETS)


def test_texts_are_compact_as_before(spark):
    space = "".join(chr(c) for c in range(1, 0x3100))
    texts = [f"a{c}{c}b{c}" for c in space] + [" a  b ", "", "ab", "\x1ca"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", N.compact(F.col("t")).alias("c"), F.trim(F.regexp_replace("t", "(?U)\\s+", " ")).alias("want"))
    assert all(r.c == r.want == P._compact(r.t) for r in df.collect())


def test_unlike_texts_are_not_shuffled_as_a_whole(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(P, "MOST_COUNTED", 100)
    monkeypatch.setattr(P, "MOST_SINGLE", 10)
    batches = [pa.record_batch([pa.array([f"{b}-{i}。同。" for i in range(200)] + [None])], ["content"]) for b in range(3)]
    told = [(p, n) for rb in P._frequent(iter(batches)) for p, n in zip(*(c.to_pylist() for c in rb.columns), strict=True)]
    assert sum(n for p, n in told if p == "同。") == 600 and len([p for p, n in told if n == 1]) == 10 and sum(n for p, n in told if p is None) == 603


def test_changes_need_no_table_a_document(spark):
    v = spark.createDataFrame([(d, f"v{i}", i, "公告", t) for d in ("a", "b", None) for i, t in enumerate(["招聘公告", "招聘公告。决定取消财务岗位招聘计划", "招聘公告。"])], "document_id string, version_id string, version_no int, title string, content string")
    changes = Z.version_changes(v)
    plan = changes._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "MapInPandas" in plan
    got = sorted((r.document_id or "", r.version_id, r.held) for r in changes.collect())
    assert got == [(d, x, h) for d in ("", "a", "b") for x, h in (("v0", False), ("v1", True), ("v2", False))]
