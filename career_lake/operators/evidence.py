"""Evidence: citations, deadlines and evaluation of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from career_lake import rules
from career_lake.session import together


def normalise_citations(c: Column) -> Column:
    """The spellings of citation markers in one form."""
    for pattern, text in rules.MARKERS:
        c = F.regexp_replace(c, pattern, text)
    return c


def cited(c: Column) -> Column:
    """The distinct numbers that an answer cites, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit("\\[资料(\\d+)\\]"), F.lit(1)), lambda x: x.cast("int")))


def valid_citations(answer: Column, sources: Column) -> Column:
    """Some citation, all within 1..sources, one of them on a line with 4 or more real characters."""
    lines = F.filter(F.split(answer, "\n"), lambda x: x.rlike("\\[资料\\d+\\]"))
    real = F.exists(lines, lambda x: F.length(F.regexp_replace(F.regexp_replace(x, "^(.*?)\\[资料\\d+\\]", "$1"), "[\\s*_#>`\\-:：。；，、.!?！？()\\[\\]（）]+", "")) >= 4)
    refs = cited(answer)
    return (F.size(refs) > 0) & real & F.forall(refs, lambda r: r.between(1, sources))


def evidence_deadline(c: Column) -> Column:
    """The day of the first deadline wording that holds a valid date, 2000 or later."""
    found = []
    for p in rules.EVIDENCE_DEADLINES:
        g = lambda i, p=p: F.regexp_extract(c, p, i)
        text = F.concat(g(1), F.lit("-"), F.lpad(g(2), 2, "0"), F.lit("-"), F.lpad(g(3), 2, "0"))
        day = F.try_to_date(text, "yyyy-MM-dd")
        found.append(F.when(F.year(day) >= 2000, day))
    return F.coalesce(*found)


def with_timeliness(sources: DataFrame, today: str) -> DataFrame:
    """sources(snippet, ...) with their deadline and whether it has passed."""
    return sources.withColumn("deadline", evidence_deadline(F.col("snippet"))).withColumn("expired", F.col("deadline") < F.lit(today).cast("date"))


def evaluate_answers(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """Each case's failures. cases: (case_id, required, any_of, forbidden: array<string>, min_sources); answers: (case_id, status, answer, n_sources)."""
    a = cases.join(answers, "case_id", "left")
    has = lambda t: F.coalesce(F.col("answer"), F.lit("")).contains(t)
    failures = F.array_compact(F.array(
        F.when(F.col("status").isNull() | (F.col("status") != "ok"), "status"),
        F.when(F.coalesce("n_sources", F.lit(0)) < F.col("min_sources"), "sources"),
        F.when(F.exists("required", lambda t: ~has(t)), "required_term"),
        F.when((F.size("any_of") > 0) & ~F.exists("any_of", has), "any_term"),
        F.when(F.exists("forbidden", has), "forbidden_term"),
        F.when(~F.coalesce(valid_citations(F.coalesce("answer", F.lit("")), F.coalesce("n_sources", F.lit(0))), F.lit(False)), "citations"),
    ))
    return a.select("case_id", failures.alias("failures")).withColumn("passed", F.size("failures") == 0)


_HOST = "(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def evaluate_facts(cases: DataFrame, responses: DataFrame) -> DataFrame:
    """W01, whole: (case_id, failures, passed) of cases and what was answered.

    cases: rows of the shape FACTUAL_CASE, as columns. responses: (case_id,
    status int, available, evidence_retrieved boolean, error_code, answer string,
    citations array<struct<id, url>>, cited_ids array<string>).

    A claim with a scope is judged in its own clause: a clause that names a
    guard's subject and its claim must hold one of its qualifiers. An inline
    marker must stand for a citation that the answer declares, and a declared id
    for a citation. Failures carry what they concern behind a colon. A case
    without response fails by its status; null lists are empty.
    """
    none = F.array().cast("array<string>")
    words = lambda c: F.coalesce(F.col(c), none)
    # By sorting: long answers in a small file would else be taken for a table to broadcast.
    r = together(cases, "id").join(together(responses.withColumnRenamed("case_id", "id"), "id").hint("merge"), "id", "left")
    cites = F.coalesce("citations", F.array().cast("array<struct<id:string,url:string>>"))
    r = r.withColumns({"answer": F.coalesce("answer", F.lit("")), "citations": cites, "cited_ids": words("cited_ids")})
    r = r.withColumn("used", F.filter("citations", lambda c: F.array_contains("cited_ids", c["id"])))
    r = r.withColumn("clauses", F.filter(F.transform(F.split("answer", "[\\n。；;]"), F.trim), lambda x: x != ""))
    grounded = F.coalesce("expectedEvidenceRetrieved", F.lit(False))
    hidden = ~F.coalesce("expectedAvailable", F.lit(False))
    named = lambda name, values: F.transform(values, lambda v: F.concat(F.lit(f"{name}:"), v.cast("string")))
    if_ = lambda c, name: F.when(F.coalesce(c, F.lit(False)), F.array(F.lit(name))).otherwise(none)
    urls = F.array_distinct(F.concat(F.array_compact(F.array("expectedCitationUrlIncludes")), words("requiredCitationUrlIncludes")))
    has = lambda t: F.col("answer").contains(t)
    hosts = words("allowedCitationHosts")
    strange = F.exists("used", lambda c: ~F.coalesce(F.array_contains(hosts, F.nullif(F.lower(F.regexp_extract(c["url"], _HOST, 1)), F.lit(""))), F.lit(False)))
    guards = F.coalesce("scopedClaimGuards", F.array().cast("array<struct<subjectTerms:array<string>,claimTerm:string,requiredQualifierTerms:array<string>>>"))
    unqualified = lambda g: F.exists("clauses", lambda s: F.exists(g["subjectTerms"], lambda t: s.contains(t)) & s.contains(g["claimTerm"]) & ~F.exists(g["requiredQualifierTerms"], lambda t: s.contains(t)))
    bound = lambda i: F.coalesce(F.array_contains("cited_ids", F.get("citations", i - 1)["id"]), F.lit(False))
    failures = F.concat(
        if_(~F.col("status").eqNullSafe(F.col("expectedStatus")), "status"),
        if_(~F.col("available").eqNullSafe(F.col("expectedAvailable")), "available"),
        if_(F.col("expectedEvidenceRetrieved").isNotNull() & ~F.col("evidence_retrieved").eqNullSafe(F.col("expectedEvidenceRetrieved")), "evidence_retrieved"),
        if_((F.coalesce("expectedErrorCode", F.lit("")) != "") & ~F.col("error_code").eqNullSafe(F.col("expectedErrorCode")), "error_code"),
        named("citation_url", F.filter(urls, lambda u: ~F.exists("used", lambda c: F.coalesce(c["url"].contains(u), F.lit(False))))),
        if_(F.size("used") < F.col("minimumCitationCount"), "citation_count"),
        if_((F.size(hosts) > 0) & strange, "citation_host"),
        named("required_term", F.filter(words("requiredAnswerTerms"), lambda t: ~has(t))),
        named("any_term", F.transform(F.filter(F.coalesce("requiredAnswerAnyOf", F.array().cast("array<array<string>>")), lambda ts: ~F.exists(ts, has)), lambda ts: F.array_join(ts, "/"))),
        named("forbidden_term", F.filter(words("forbiddenAnswerTerms"), has)),
        named("scoped_claim", F.transform(F.filter(guards, unqualified), lambda g: g["claimTerm"])),
        F.when(grounded, F.concat(
            if_(~F.col("answer").rlike("\\[资料\\d+\\]"), "no_marker"), if_(F.size("cited_ids") == 0, "no_cited_ids"),
            named("marker", F.filter(cited(F.col("answer")), lambda i: ~bound(i))),
            named("cited_id", F.filter("cited_ids", lambda x: ~F.exists("citations", lambda c: F.coalesce(c["id"] == x, F.lit(False))))),
        )).otherwise(none),
        if_(hidden & (F.size("citations") > 0), "exposed_citations"),
        if_(hidden & (F.size("cited_ids") > 0), "exposed_cited_ids"),
    )
    return r.select(F.col("id").alias("case_id"), failures.alias("failures")).withColumn("passed", F.size("failures") == 0)


def evaluation_summary(results: DataFrame) -> DataFrame:
    """Cases passed and failed, and failures of the infrastructure and of decisions."""
    infra = F.arrays_overlap("failures", F.array(F.lit("status"), F.lit("sources")))
    return results.agg(F.count("*").alias("cases"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed") & infra).alias("infrastructure"), F.count_if(~F.col("passed") & ~infra).alias("decision"))
