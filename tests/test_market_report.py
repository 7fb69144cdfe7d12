"""The market report on a few jobs: known numbers, and profiles without candidates."""

import pytest

from career_lake.operators import jobs as J
from career_lake.operators import market_report as M

RAW = "id string, company_name string, company_type string, job_title string, job_type string, job_description string, education_level string, graduate_year string, work_location string, major_requirements string, major_category_ids string, apply_start_date string, apply_end_date string, announcement_url string, source string, salary_min double, salary_max double, created_at string, updated_at string, status string, view_count long"
PROFILE = "profile_id string, school string, school_tier string, degree_level string, major string, graduation_year int, preferred_cities string, city string, resume string, application string, interview string, project_evidence string, internship string, competition string"
NOW, SINCE = "2026-07-20", "2025-07-20"


def job(i, company, title, place, wants, text, pay, source, end="2026-08-31", degree="本科", year="2027届"):
    return (str(i), company, "国企", title, "校招", text, degree, year, place, wants, None, None, end, None, source, pay[0], pay[1], "2026-07-01", "2026-07-18", None, i)


JOBS = [
    job(1, "国企一", "商业运营实习生", "湖南省,长沙市", "酒店管理、工商管理等相关专业", "五险一金，导师制，需要值班", (12.0, 18.0), "官方网站"),
    job(2, "国企二", "前台接待", "北京市朝阳区", "酒店管理", "五险一金，轮岗，夜班", (12.0, 18.0), "官方网站", degree="大专及以上"),
    job(3, "国企三", "业务代表", None, "酒店管理", "", (None, None), None, end=None, year=None),
    job(4, " 国企一", "商业运营实习生", "湖南省,长沙市", "酒店管理、工商管理等相关专业", "同一岗位", (None, None), None),
    job(5, "国企五", "会计", "上海市", "会计学", "", (None, None), None),
]
PROFILES = [
    ("hotel", "某大学", "双一流", "bachelor", "酒店管理", 2027, "全国", None, "missing", None, None, "ready", "developing", None),
    ("hotel-far", "某大学", "双一流", "bachelor", "酒店管理", 2027, "拉萨", None, "ready", "ready", "ready", "ready", "ready", "ready"),
    ("none", None, None, "unknown", "考古学", 2025, None, None, None, None, None, None, None, None),
    ("bare", None, None, None, None, None, None, None, None, None, None, None, None, None),
]
SCHOOLS = "school_name string, aliases array<string>, major_name string, major_aliases array<string>"


@pytest.fixture(scope="module")
def reports(spark):
    raw = spark.createDataFrame(JOBS, RAW)
    out = M.market_report(spark.createDataFrame(PROFILES, PROFILE), J.normalise_jobs(raw), raw, spark.createDataFrame([("某大学", ["某大"], "酒店管理", None)], SCHOOLS), NOW, SINCE)
    return {r.profile_id: r for r in out.collect()}


def test_numbers_come_from_the_jobs_alone(reports):
    r = reports["hotel"]
    assert (r.status, r.conclusion, r.school.status) == ("live", "已有可关注岗位", "available")
    m = r.metrics  # the repeated posting counts once
    assert (m.sample, m.companies, m.regions, m.official, m.deadline_known, m.preferred_region) == (3, 3, 3, 2, 2, 3)
    assert (r.market_layers.full_market, r.market_layers.strict_profile, r.market_layers.personalised) == (4, 2, 3)
    assert [(d.id, d.jobs, d.mentions) for d in r.directions] == [("commercial-operation-planning", 2, 2), ("customer-service-reception", 1, 1)] and r.directions[0].label == "商业运营与活动策划"
    told = {c.id: c for c in r.conditions}
    assert (told["salary"].status, told["salary"].headline) == ("partial", "仅2条样本 · 年薪中位区间 12–18 万") and told["benefit"].headline == "五险一金" and told["intensity"].jobs == 2
    assert told["city"].headline.startswith("岗位较多：") and "地域待确认" not in told["city"].headline
    assert sum(v for row in r.heatmap.rows for v in row["values"]) == 3 and len(r.qualification_matrix) == 11
    assert r.actions[0].capability == "resume" and r.priority_steps[2] == "再从2个资料字段匹配中选择目标岗位" and r.milestones[1].period == "2026.03–06"
    assert r.history.size == 4 and r.decision.candidates == 3 and r.competitiveness.factors.school == 84


def test_wishes_and_readiness_are_the_profiles_own(reports):
    r = reports["hotel-far"]
    assert r.metrics.preferred_region == 0 and "city" in r.assessment.constraints and r.competitiveness.factors.prepared == 92
    assert [a.capability for a in r.actions] == ["verification", "target_research"] and {x.status for x in r.levers} == {"待处理"}
    assert r.competitiveness.score > reports["hotel"].competitiveness.score and r.heatmap == reports["hotel"].heatmap


@pytest.mark.parametrize("name", ["none", "bare"])
def test_profiles_without_candidates(reports, name):
    r = reports[name]
    assert (r.status, r.conclusion, r.metrics.sample, r.history.size, r.directions, r.conditions) == ("partial", "暂无足够岗位", 0, 0, [], [])
    assert r.heatmap.rows == [] and len(r.qualification_matrix) == 11 and r.competitiveness.factors.opportunity == 25


def test_empty_tables(spark):
    raw = spark.createDataFrame([], RAW)
    empty = M.market_report(spark.createDataFrame([], PROFILE), J.normalise_jobs(raw), raw, spark.createDataFrame([], SCHOOLS), NOW, SINCE)
    assert empty.count() == 0
