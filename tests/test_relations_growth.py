"""Relations: what is shuffled, and that cuts before shuffles and the comparison of many pairs together change no row."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from career_lake.operators import relations as X


@pytest.fixture
def no_broadcast(spark):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for k in keys:
        spark.conf.set(k, "-1")
    yield
    for k in keys:
        spark.conf.unset(k)


def shuffled(df):
    """The column names of each shuffle in df's plan, run."""
    df.collect()
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "ShuffleExchangeExec":
            found.append({node.output().apply(i).name() for i in range(node.output().size())})
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


def tables(spark, url="'https://h' || id % 3 || '/' || id"):
    docs = spark.range(600).selectExpr("concat('d', id) AS document_id", "concat('s', id % 2) AS source_id", f"{url} AS canonical_url", "concat('某某能源', id % 9, '集团2026年校园招聘公告') AS title", "id % 4 > 0 AS official", "'active' AS status", "lpad(id % 50, 4, '0') AS updated_at")
    notices = spark.range(90).selectExpr("concat('n', id) AS notice_id", "concat('s', id % 2) AS source_id", "'https://h' || id % 3 || '/' || (599 - id % 7) AS url", "id % 2 = 0 AS official", "array('https://h1/5', 'https://h2/8', 'https://h2/8') AS links", "concat('关于延期某某能源', id % 9, '招聘的通知') AS title", "concat('某某能源', id % 5, '集团2026年校园招聘公告') AS content")
    return notices, docs


def plain_pairs(notices, docs, most):
    """X02 in plain Python."""
    host, out = (lambda u: u.split("/")[2]), set()
    for n in notices.collect():
        met = []
        for d in docs.collect():
            linked = d.canonical_url in n.links and ((n.official and d.official) or n.source_id == d.source_id)
            near = n.source_id == d.source_id or (n.official and d.official and host(n.url) == host(d.canonical_url))
            if n.url != d.canonical_url and (linked or near):
                met.append((d.updated_at, d.document_id, linked))
        met.sort(key=lambda x: x[1])
        met.sort(key=lambda x: x[0], reverse=True)
        out |= {(n.notice_id, d, linked) for i, (_, d, linked) in enumerate(met) if i < most or linked}
    return out


def test_lists_are_in_no_shuffle(spark, no_broadcast):
    got = X.candidate_pairs(*tables(spark), 10)
    assert not [c for c in shuffled(got) if "list" in c]


@pytest.mark.parametrize("url", ["'https://h' || id % 3 || '/' || id", "CASE WHEN id > 400 THEN 'https://h0/599' ELSE 'https://h' || id % 3 || '/' || id END"])
def test_candidates_equal_plain_python(spark, url):
    notices, docs = tables(spark, url)
    rows = X.candidate_pairs(notices, docs, 10).collect()
    assert len(rows) == len({(r.notice_id, r.document_id) for r in rows})
    assert {(r.notice_id, r.document_id, r.linked) for r in rows} == plain_pairs(notices, docs, 10)


def test_pairs_are_in_no_shuffle_before_the_best_are_cut(spark, no_broadcast):
    notices, docs = tables(spark)
    pairs = X.scored_pairs(notices, docs, 10)
    assert not [c for c in shuffled(pairs) if "core" in c and "n_core" in c]
    columns = ["notice_id", "document_id", "score", F.array_join("evidence", ",").alias("evidence"), "linked"]
    want = X.score_pairs(X.candidate_pairs(notices, docs, 10), notices, docs)
    assert sorted(pairs.select(columns).collect()) == sorted(want.select(columns).collect()) and want.count() > 500
    best = X.top_targets(pairs)
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 5, Partial" in plan and {r["rank"] for r in best.collect()} == {1, 2, 3, 4, 5}


def test_short_cores_take_places(spark):
    notices, docs = tables(spark)
    docs = docs.withColumn("title", F.expr("CASE WHEN updated_at >= '0040' THEN '公告' ELSE title END"))
    want = X.score_pairs(X.candidate_pairs(notices, docs, 10), notices, docs).select("notice_id", "document_id").collect()
    assert sorted(X.scored_pairs(notices, docs, 10).select("notice_id", "document_id").collect()) == sorted(want)


def test_ratios_of_many_pairs_are_those_of_each():
    pick = random.Random(4)
    text = lambda letters, most: "".join(pick.choice(letters) for _ in range(pick.randint(0, most)))
    a = [text(pick.choice(["ab", "abc0", "招聘公告20", "\x00\x01￿\U00020000"]), 30) for _ in range(3000)] + [text("ab", 400) for _ in range(20)]
    b = [text(pick.choice(["ab", "abc0", "招聘公告20", "\x00\x01￿\U00020000"]), 40) for _ in range(3000)] + [text("abc", 199) for _ in range(20)]
    assert list(X.matching_ratios(a, b)) == [SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)]
    assert list(X.matching_ratios([], [])) == [] and list(X.matching_ratios([""], [""])) == [1.0]


def test_long_cores_are_compared_as_before(spark):
    a, b = "某集团" + "招聘甲乙" * 30, "某集团" + "招聘甲丙" * 60
    assert len(b) >= X.AUTOJUNK
    (row,) = spark.createDataFrame([(a, b)], "a string, b string").select(X._similarity("a", "b").alias("r")).collect()
    assert row.r == SequenceMatcher(None, a, b).ratio()
