"""How many rows steps make, and over how many tasks they are dealt: for what must not grow faster than the input."""

import time

import pytest
from pyspark.sql import functions as F

from career_lake.operators import decision as D
from career_lake.operators import decision_checks as W
from career_lake.operators import facts as N
from career_lake.operators import relations as X
from career_lake.operators import report as R
from career_lake.operators import retrieval as K
from career_lake.plans import queries_excerpts, queries_facts, queries_report, registry  # noqa: F401  their views
from career_lake.plans.bindings import view

SF = "/root/testdata/sf0.001"


def collected(df):
    """The rows of df, and the most rows that a step of its plan put out."""
    rows, most, todo = df.collect(), 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        n = node.metrics().get("numOutputRows")
        most = max(most, n.get().value() if n.isDefined() else 0)
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return rows, most


def job_rows(spark, n):
    return spark.range(n).selectExpr(
        "CAST(id AS STRING) AS id", "'国企' AS company_type", "'校招' AS job_type", "CAST(NULL AS DATE) AS apply_end_date", "'电气岗' AS job_title", "'' AS major_requirements", "'本科' AS education_level", "'2027届' AS graduate_year"
    )


def test_relevant_pool_joins_kinds_not_profiles_and_jobs(spark):
    profiles = spark.range(200).select(F.col("id").cast("string").alias("profile_id"), F.lit("本科").alias("degree_text"), F.lit(2027).alias("graduation_year"), F.array(F.lit("电气"), F.lit("岗")).alias("keywords"))
    totals, sample = R.relevant_pool(job_rows(spark, 300), profiles, "2026-07-22", 5)
    rows, most = collected(totals)
    assert {(r.relevant, r.broad) for r in rows} == {(300, 300)} and len(rows) == 200 and most <= 1000
    rows, most = collected(sample)
    assert sorted(r.id for r in rows if r.profile_id == "7") == ["0", "1", "10", "100", "101"] and len(rows) == 1000 and most <= 1000


def test_small_files_are_dealt_over_the_cores(spark):
    for name in ("profiles_v", "evidence_v", "cases_v", "snapshots_v", "jobs_v"):
        assert view(spark, SF, name).rdd.getNumPartitions() > 1


def test_fuzzy_match_compares_equal_texts_once(spark):
    texts = spark.range(500).selectExpr("id AS text_id", "'offer large copper ring' AS text").union(spark.sql("SELECT 900L, 'small tin'"))
    rows, most = collected(X.fuzzy_match(texts, spark.sql("SELECT 'Large Copper Ring' AS entity UNION ALL SELECT 'Another Name'")))
    assert sorted(r.text_id for r in rows) == list(range(500)) and {r.entity for r in rows} == {"Large Copper Ring"} and most <= 2000


def test_pairs_are_assessed_once_a_kind(spark):
    same = ["'bachelor' AS degree_level", "'会计学' AS major", "2027 AS graduation_year", "'北京' AS preferred_cities", "CAST(NULL AS STRING) AS city", "'0203' AS code"]
    p = spark.range(400).selectExpr("CAST(id AS STRING) AS profile_id", *same, *(f"'ready' AS {k}" for k in ("resume", "application", "interview", "project_evidence", "internship", "competition")))
    pool = job_rows(spark, 50).selectExpr("*", "'0203' AS code", "'a' AS company_name", "'北京' AS work_location", "array('0203') AS major_category_ids", "CAST(NULL AS DATE) AS updated_at")
    rows, most = collected(D.portfolio(D.assessed_kinds(p, pool, "2026-07-22")))
    assert len(rows) == 50 and most <= 400
    told, _ = collected(D.told_to_profiles(p, D.assessed_kinds(p, pool, "2026-07-22").select("profile_id", "id", "score"), D.KIND))
    assert len(told) == 20_000 and len({(r.profile_id, r.id) for r in told}) == 20_000


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lengths_need_no_facts_and_texts_are_not_dealt_again(spark):
    assert "regexp_extract" not in plan(queries_facts.QUERIES["f18_length_regimes"](spark, SF))
    for name in ("f01_deadlines", "f08_ages", "f10_languages"):
        df = queries_facts.QUERIES[name](spark, SF)
        assert plan(df).count("REPARTITION_BY_NUM") <= 2 and not any("document_id" in x or "version_id" in x for x in plan(df).split("\n") if "REPARTITION_BY_NUM" in x)


def test_coverage_counts_facts_before_they_are_dealt(spark):
    docs = spark.range(300).selectExpr("CAST(id AS STRING) AS document_id", "CAST(id AS STRING) AS version_id", "'校园招聘公告' AS title", "'报名截止2027年1月2日。报名截止2027年1月3日。招聘人数：5人。' AS content")
    rows, most = collected(N.fact_coverage(docs.union(docs.limit(1))))
    assert {(r.facet, r.versions, r.facts) for r in rows} == {("deadlines", 300, 602), ("recruitment_headcounts", 300, 301), ("recruitment_audiences", 300, 301)} and most <= 1000


def test_sentences_are_the_matches_of_their_pattern(spark):
    texts = ["", "。", "a。。b！c", "长" * 220 + "。x", "长" * 221 + "；", "长" * 500 + "\n。y", "a\nb；"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(N.sentences(F.col("t")).alias("a"), N._all(F.col("t"), N.rules.SENTENCE).alias("b"))
    assert all(r.a == r.b for r in df.collect())


def test_windows_of_a_long_text_take_no_quadratic_time(spark):
    terms = F.array(F.lit("aa"), F.lit("end"), F.lit("x"), F.lit(None))
    long = spark.range(1).select(F.col("id").alias("pair_id"), F.concat(F.expr("repeat('aaab ', 100000)"), F.lit("aax end")).alias("content"), terms.alias("terms"))
    at = time.time()
    (row,) = K.best_windows(long, 50).collect()
    assert row.start == 499_957 and "aax end" in row.window and time.time() - at < 20
    short = spark.range(400).select(F.col("id").alias("pair_id"), F.concat(*(F.element_at(F.array(*map(F.lit, ("aa", "a", "bend", "x ", "招聘"))), ((F.col("id") * p) % 5 + 1).cast("int")) for p in (1, 2, 3, 7, 11, 13, 17, 19)), F.lit("aaaend")).alias("content"), terms.alias("terms"))
    assert all(r.start == r.want for r in K.best_windows(short, 9).join(short.select("pair_id", K.window_start(F.col("content"), F.col("terms"), F.lit(9)).alias("want")), "pair_id").collect())


def test_candidates_are_ordered_once_a_source_and_host(spark):
    docs = spark.range(400).selectExpr("concat('d', id) AS document_id", "concat('s', id % 2) AS source_id", "concat('https://h/', id) AS canonical_url", "'t' AS title", "true AS official", "'active' AS status", "lpad(id, 4, '0') AS updated_at")
    notices = spark.range(300).selectExpr("concat('n', id) AS notice_id", "concat('s', id % 2) AS source_id", "concat('https://h/', 399 - id % 3) AS url", "true AS official", "array('https://h/5') AS links")
    rows, most = collected(X.candidate_pairs(notices, docs, 10))
    of = lambda n: {r.document_id: r.linked for r in rows if r.notice_id == n}
    assert of("n0") == {f"d{i}": False for i in range(389, 399)} | {"d5": True} and len(rows) == 3300 and most <= 3300


def below_deals(df):
    """The plans below the steps that deal rows over a number of tasks."""
    found, todo = [], [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        children = [node.children().apply(i) for i in range(node.children().size())]
        if node.getClass().getSimpleName() == "RepartitionByExpression":
            found += [c.toString() for c in children]
        todo += children
    return found


@pytest.mark.parametrize("name", ["b03_normalise_profiles", "b04_entitlements", "s05_factual_cases", "w01_factual_guards", "j01_normalise_jobs"])
def test_no_filter_runs_in_the_one_task_that_reads_a_small_file(spark, name):
    below = [x for x in below_deals(registry.QUERIES[name](spark, SF)) if "parquet" in x and "RepartitionByExpression" not in x]
    assert below and not any("from_json" in x or "parse_json" in x or "regexp_replace" in x for x in below)


def test_texts_are_parsed_once(spark):
    for name, what in (("b03_normalise_profiles", "from_json("), ("b04_entitlements", "from_json("), ("s05_factual_cases", "from_json("), ("s05_factual_cases", "parsejson(")):
        text = registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString().lower()
        assert text.count(what) == 1, (name, what)


def test_rows_of_a_case_are_shuffled_once(spark):
    n = 300
    profile = spark.range(n).selectExpr("CAST(id AS STRING) AS case_id")
    listed = profile.crossJoin(spark.range(20).selectExpr("CAST(id AS STRING) AS id"))
    assessed = listed.selectExpr("*", "CASE id WHEN '0' THEN 'expired' WHEN '1' THEN 'high-risk' ELSE 'needs-verification' END AS qualification", "50 AS score", "true AS all_pass", "true AS late")
    reports = profile.selectExpr("case_id", "true AS contract", "50 AS readiness", "array('技术') AS directions", "array(named_struct('tier', 'primary', 'id', CASE case_id WHEN '7' THEN '0' WHEN '8' THEN '1' WHEN '9' THEN 'gone' WHEN '10' THEN NULL ELSE '2' END), named_struct('tier', 'steady', 'id', CASE case_id WHEN '11' THEN '2' ELSE '3' END)) AS portfolio", "array(named_struct('trigger', 'after-target-selected', 'product', 'resume')) AS blockers")
    cases = profile.selectExpr("case_id", "20 AS min_candidates", "1 AS min_primary", "1 AS min_high_risk", "10 AS score_min", "80 AS score_max", "array('技术') AS directions")
    again = listed.where("case_id = '12' AND id < 3")
    got = W.evaluate_decisions(cases, reports, listed.union(again), assessed.union(assessed.where("case_id = '13' AND id = '5'")).union(assessed.where("case_id = '10' AND id = '5'").selectExpr("case_id", "CAST(NULL AS STRING)", "'expired'", "50", "true", "true")))
    text = plan(got)
    assert "Aggregate(key=" not in text.replace("Hash", "") and text.count("REPARTITION_BY_NUM") == 3  # cases, reports and what is said of them
    assert not any(f"Exchange hashpartitioning({c}" in x and "ENSURE" in x for c in ("case_id", "id") for x in text.split("\n"))
    told = {r.case_id: r.failures for r in got.collect() if r.failures}
    assert told == {
        "7": ["expired_in_portfolio"], "8": ["risk_in_portfolio"], "9": ["unknown_reference"], "10": ["repeated_assessments", "counts_differ", "unknown_reference", "repeated_reference"],
        "11": ["repeated_reference"], "12": ["repeated_candidates", "counts_differ"], "13": ["repeated_assessments", "counts_differ"],
    }


def test_hits_are_shuffled_once_and_snippets_cleaned_once(spark):
    text = plan(registry.QUERIES["k11_grounded_hits"](spark, SF))
    assert text.count("Exchange hashpartitioning(request_id") == 1 and "Exchange hashpartitioning(remote_id" not in text
    df = spark.range(1).select(K.merged_snippet(F.array(F.lit(" A  b "), F.lit("a B"), F.lit(""), F.lit("c"))).alias("s"))
    assert df.first().s == "A b … c"
    assert plan(spark.range(1).selectExpr("array(string(id)) AS x").select(K.merged_snippet(F.col("x")).alias("s"))).count("regexp_replace") == 1
