"""Reference tables of nested JSON with declared shapes; what does not fit is told, not guessed.

A text holds one object, a list, or an object with the list under `cases`. Each
item becomes a row (source, place, record, rejected): rejected is `format` (no
JSON), `empty` (no items), `shape` (a field of another type) or `id` (no id or
repeated in its source: the first counts), else null. Fields that a shape does
not name are ignored; fields that an item lacks are null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_WORDS = "array<string>"
_BACKED = f"evidenceIds {_WORDS}"
_RATES = "cohort string, scopeLabel string, note string, destinationRate double"
SCHOOL = (
    f"id string, status string, schoolName string, aliases {_WORDS}, majorName string, majorAliases {_WORDS}, snapshotAt string, headline string, summary string, "
    f"signals array<struct<id string, label string, value string, detail string, scope string, {_BACKED}>>, "
    f"resources array<struct<id string, label string, detail string, action string, {_BACKED}>>, "
    f"trainingProfile struct<curriculumVersion string, professionalEducationCredits double, practicalCredits double, internshipCredits double, graduationDesignCredits double, directionTracks array<struct<label string, courses {_WORDS}, jobFamilies {_WORDS}, proof string>>, workloadSignals {_WORDS}, {_BACKED}>, "
    f"graduateVoice struct<cohort string, scopeLabel string, brandFoundationRate double, professionalRelevanceRate double, jobSearchGaps {_WORDS}, actions {_WORDS}, note string, {_BACKED}>, "
    f"campusRecruitmentAccess struct<cohort string, note string, items array<struct<employer string, sector string, opportunity string, action string, {_BACKED}>>>, "
    f"schoolOutcome struct<{_RATES}, domesticFurtherStudyRate double, recommendationRate double, overseasStudyRate double, directEmploymentRate double, {_BACKED}>, "
    f"majorOutcome struct<{_RATES}, total int, domesticFurtherStudy int, overseasStudy int, directEmployment int, pending int, {_BACKED}>, "
    f"employerExamples array<struct<name string, count int, note string>>, studentDecision struct<level string, whatItMeans {_WORDS}, nextActions {_WORDS}>, dataGaps {_WORDS}, "
    "sources array<struct<id string, title string, publisher string, url string, publishedAt string, grade string, scope string>>"
)
FACTUAL_CASE = (
    f"id string, message string, profileSummary string, targetSummary string, profile struct<degreeLevel string, major string, graduationYear int>, target struct<companies {_WORDS}, jobTitles {_WORDS}>, filters map<string, string>, "
    f"expectedStatus int, expectedAvailable boolean, expectedEvidenceRetrieved boolean, expectedErrorCode string, expectedCitationUrlIncludes string, requiredCitationUrlIncludes {_WORDS}, minimumCitationCount int, allowedCitationHosts {_WORDS}, "
    f"requiredAnswerTerms {_WORDS}, requiredAnswerAnyOf array<{_WORDS}>, forbiddenAnswerTerms {_WORDS}, scopedClaimGuards array<struct<subjectTerms {_WORDS}, claimTerm string, requiredQualifierTerms {_WORDS}>>"
)
DECISION_CASE = (
    "id string, label string, profile struct<degreeLevel string, major string, graduationYear int, preferredCities string, availableHoursPerWeek int, capabilityLevels map<string, string>>, "
    f"expectations struct<minimumCandidateCount int, minimumMarketTotal int, minimumPrimaryCount int, minimumHighRiskCount int, requiredSectorAnyOf {_WORDS}, requiredDirectionAnyOf {_WORDS}, minimumProductBlockers int, readinessScoreMin int, readinessScoreMax int>"
)
CHANGE_CASE = (
    f"id string, candidate struct<sourceId string, title string, url string, content string, links {_WORDS}>, existing struct<documentId string, sourceId string, title string, url string>, "
    f"expected struct<relationType string, changeScope string, resolutionMode string, unresolved boolean, targetExpected boolean, targetBlocked boolean, targetScore double, evidence {_WORDS}, crossRegisteredSource boolean>"
)


def parse_records(texts: DataFrame, shape: str) -> DataFrame:
    """The items of texts(source, text) as rows of a shape, and why some are rejected."""
    # Generators, which filters do not pass: texts and items are parsed once.
    v = texts.select("source", F.explode(F.array(F.expr("try_parse_json(text)"))).alias("v"))
    items = F.expr("coalesce(try_variant_get(v, '$.cases', 'array<variant>'), try_variant_get(v, '$', 'array<variant>'), array(v))")
    rows = v.select("source", F.col("v").isNull().alias("bad"), F.posexplode_outer(items).alias("place", "item"))
    rows = rows.withColumn("record", F.explode(F.array(F.from_json(F.to_json("item"), f"{shape}, unfit string", {"columnNameOfCorruptRecord": "unfit"}))))
    again = F.row_number().over(Window.partitionBy("source", F.col("record.id")).orderBy("place")) > 1
    why = (
        F.when(F.col("bad"), "format").when(F.col("place").isNull(), "empty").when(F.col("record").isNull() | F.col("record.unfit").isNotNull(), "shape")
        .when(F.coalesce(F.trim("record.id"), F.lit("")) == "", "id").when(again, "id")
    )
    told = rows.drop("item").withColumn("rejected", why)
    return told.select("source", F.coalesce("place", F.lit(0)).alias("place"), F.col("record").dropFields("unfit").alias("record"), "rejected")


def load_records(spark: SparkSession, path: str, shape: str) -> DataFrame:
    """parse_records of the files at a path; source: the file's name."""
    texts = spark.read.text(path, wholetext=True)
    return parse_records(texts.select(F.regexp_extract(F.input_file_name(), "([^/]*)$", 1).alias("source"), F.col("value").alias("text")), shape)


def school_table(records: DataFrame) -> DataFrame:
    """P13's schools of parsed SCHOOL records; rejected ones take no part."""
    return records.where("rejected is null").select(F.col("record.schoolName").alias("school_name"), "record.aliases", F.col("record.majorName").alias("major_name"), F.col("record.majorAliases").alias("major_aliases"))
