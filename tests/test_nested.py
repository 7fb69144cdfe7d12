"""Nested reference tables, and the factual evaluation that reads one of them."""

import json

from pyspark.sql import functions as F

from career_lake.operators import evidence as A
from career_lake.operators import report as R
from career_lake.sources import nested as S

GUARD = {"subjectTerms": ["甲计划"], "claimTerm": "1次投递", "requiredQualifierTerms": ["未说明", "仅乙计划"]}
CASE = {
    "id": "a", "message": "m", "profile": {"degreeLevel": "bachelor", "graduationYear": 2027, "extra": 1}, "filters": {"validAt": "2026-07-17"}, "expectedStatus": 200, "expectedAvailable": True, "expectedEvidenceRetrieved": True,
    "requiredCitationUrlIncludes": ["/c1/"], "minimumCitationCount": 1, "allowedCitationHosts": ["h.example.com"], "requiredAnswerTerms": ["北京"], "requiredAnswerAnyOf": [["甲", "乙"]], "forbiddenAnswerTerms": ["保证"], "scopedClaimGuards": [GUARD],
}
RESPONSE = "case_id string, status int, available boolean, evidence_retrieved boolean, error_code string, answer string, citations array<struct<id:string,url:string>>, cited_ids array<string>"
CITES = [("x", "https://h.example.com/c1/a.html"), ("y", "https://other.example.com/c2")]


def test_files_of_each_shape_load_and_bad_rows_are_told(spark, tmp_path):
    school = {"id": "t", "schoolName": "天津大学", "aliases": ["天大"], "majorName": "法学", "majorAliases": ["法律"], "signals": [{"id": "s", "evidenceIds": ["e"]}], "trainingProfile": {"practicalCredits": 30.5, "directionTracks": [{"courses": ["c"]}]}, "majorOutcome": {"total": 20}}
    (tmp_path / "school").mkdir()
    (tmp_path / "school/one.json").write_text(json.dumps(school, indent=2))
    (tmp_path / "school/more.json").write_text(json.dumps([{"id": "u", "schoolName": "某大学"}, {"id": "u"}, {"id": " "}, {"id": "v", "aliases": 3}]))
    (tmp_path / "school/bad.json").write_text("{no json")
    (tmp_path / "school/none.json").write_text("[]")
    got = S.load_records(spark, str(tmp_path / "school"), S.SCHOOL)
    told = sorted((r.source, r.place, r.rejected) for r in got.collect())
    assert told == [("bad.json", 0, "format"), ("more.json", 0, None), ("more.json", 1, "id"), ("more.json", 2, "id"), ("more.json", 3, "shape"), ("none.json", 0, "empty"), ("one.json", 0, None)]
    one = got.where("source = 'one.json'").first().record
    assert (one.trainingProfile.practicalCredits, one.majorOutcome.total, one.signals[0].evidenceIds, one.headline) == (30.5, 20, ["e"], None)
    profiles = spark.createDataFrame([("1", "天大", "法律"), ("2", "某大学", "法学"), ("3", "无", "法学")], "profile_id string, school string, major string")
    found = {r.profile_id: (r.status, r.school_name) for r in R.school_lookup(profiles, S.school_table(got)).collect()}
    assert found == {"1": ("available", "天津大学"), "2": ("unavailable", "某大学"), "3": ("unavailable", "无")}
    change = {"cases": [{"id": "c", "candidate": {"links": ["l"]}, "expected": {"targetScore": 0.9, "unresolved": False}}]}
    decision = {"version": "1", "cases": [{"id": "d", "profile": {"capabilityLevels": {"resume": "ready"}}, "expectations": {"readinessScoreMax": 10}}]}
    for name, data, shape in (("change", change, S.CHANGE_CASE), ("decision", decision, S.DECISION_CASE)):
        (tmp_path / f"{name}.json").write_text(json.dumps(data))
        row = S.load_records(spark, str(tmp_path / f"{name}.json"), shape).first()
        assert row.rejected is None and row.record.id in ("c", "d")


def evaluated(spark, tmp_path, case, *response):
    (tmp_path / "cases.json").write_text(json.dumps({"cases": [case]}))
    cases = S.load_records(spark, str(tmp_path / "cases.json"), S.FACTUAL_CASE).select("record.*")
    rows = [("a", *response)] if response else []
    return A.evaluate_facts(cases, spark.createDataFrame(rows, RESPONSE)).first().failures


def test_guards_markers_hosts_and_urls(spark, tmp_path):
    ok = (200, True, True, None, "甲计划在北京招聘。[资料1]\n乙计划1次投递", CITES, ["x"])
    assert evaluated(spark, tmp_path, CASE, *ok) == []
    assert evaluated(spark, tmp_path, CASE, 200, True, True, None, "北京。甲计划1次投递；[资料1]", CITES, ["x"]) == ["scoped_claim:1次投递"]
    assert evaluated(spark, tmp_path, CASE, 200, True, True, None, "北京。甲计划未说明1次投递。[资料1]", CITES, ["x"]) == []
    assert evaluated(spark, tmp_path, CASE, 200, True, True, None, "北京乙。[资料2][资料7]", CITES, ["x", "z"]) == ["marker:2", "marker:7", "cited_id:z"]
    assert evaluated(spark, tmp_path, CASE, 200, True, True, None, "北京乙保证。[资料2]", CITES, ["y"]) == ["citation_url:/c1/", "citation_host", "forbidden_term:保证"]
    assert evaluated(spark, tmp_path, CASE, 500, False, False, None, None, None, None) == ["status", "available", "evidence_retrieved", "citation_url:/c1/", "citation_count", "required_term:北京", "any_term:甲/乙", "no_marker", "no_cited_ids"]
    refused = {"id": "a", "expectedStatus": 422, "expectedAvailable": False, "expectedErrorCode": "NO_EVIDENCE"}
    assert evaluated(spark, tmp_path, refused, 422, False, False, "NO_EVIDENCE", "", [], []) == []
    assert evaluated(spark, tmp_path, refused, 422, False, False, "OTHER", "", CITES, ["x"]) == ["error_code", "exposed_citations", "exposed_cited_ids"]
    assert evaluated(spark, tmp_path, refused) == ["status", "available", "error_code"]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "source string, text string")
    assert S.parse_records(empty, S.FACTUAL_CASE).count() == 0
    cases = S.parse_records(empty, S.FACTUAL_CASE).select("record.*")
    assert A.evaluate_facts(cases, spark.createDataFrame([], RESPONSE)).where(F.size("failures") > 0).count() == 0
