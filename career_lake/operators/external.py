"""Decision records of an external evaluator: contract, eligibility, and contexts within a size.

A record is a row (decision_id, external_job_id, job_title, company_name,
route_state, route_label, gates, actions, evidence, profile_persisted,
profile_logged, direct_identifiers, sent_to_official, boundary,
has_official_evidence) with
gates: array<struct<code, status, statement, raw_value>>,
actions: array<string>,
evidence: array<struct<id, title, url, source_grade, verification_status, fetched_at>>,
boundary: struct<freshness, live_status, live_verified_at>.
A null is a field that the record lacks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the contract.
ROUTE_STATES = ["direct-apply", "prepare-and-verify", "high-risk-long-term", "alternative-opportunity"]
GATE_STATUSES = ["met", "not_met", "unknown", "not_applicable"]
GATE_KINDS = {"education": "degree", "major": "major", "graduation-year": "graduation_year", "application-deadline": "deadline"}
TRUSTED_GRADES = ["A", "B"]
UNTRUSTED = "（缺少 A/B 级已核验证据，结论保持未知）"
SNIPPET_BUDGETS = [1000, 650, 400, 300, 220, 160]
CONTEXT_CHARS, LEAST_SNIPPET = 3900, 80
TITLE_CHARS, URL_CHARS, DAY_CHARS, SLACK = 120, 180, 32, 8


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _verified(e: Column) -> Column:
    return _true(e["source_grade"].isin(TRUSTED_GRADES) & (e["verification_status"] == "verified"))


def trusted_evidence(evidence: Column) -> Column:
    """The evidence of grade A or B that is verified and has a web address."""
    return F.filter(evidence, lambda e: _verified(e) & _true(e["url"].rlike("^https?://")))


def violations(responses: DataFrame) -> Column:
    """The codes of the rules that a record breaks, in the order of the contract."""
    c = responses.__getitem__
    fresh, live, at = c("boundary.freshness"), c("boundary.live_status"), c("boundary.live_verified_at")
    live_is = lambda s: _true(live == s)
    fresh_is = lambda s: _true(fresh == s)
    gate = lambda g: _true(g["code"].isin(list(GATE_KINDS)) & g["status"].isin(GATE_STATUSES) & g["statement"].isNotNull())
    whole = lambda e: F.forall(F.array(*(e[k] for k in ("id", "title", "url", "source_grade", "verification_status", "fetched_at"))), lambda x: x.isNotNull())
    rules = [
        ("job", c("external_job_id").isNull() | c("job_title").isNull() | c("company_name").isNull()),
        ("evaluation", ~_true(c("route_state").isin(ROUTE_STATES)) | c("route_label").isNull() | c("gates").isNull() | c("actions").isNull() | c("evidence").isNull()),
        ("privacy", F.coalesce("profile_persisted", F.lit(True)) | F.coalesce("profile_logged", F.lit(True)) | _true(c("direct_identifiers")) | _true(c("sent_to_official"))),
        ("live_pair", fresh.isNull() != live.isNull()),
        ("freshness", _true(~fresh.isin("live", "live-check-failed"))),
        ("live_status", _true(~live.isin("verified", "failed"))),
        ("checked_at", at.isNotNull() & F.try_to_timestamp(at).isNull()),
        ("live_verified", live_is("verified") & ~(fresh_is("live") & _true(c("has_official_evidence")) & at.isNotNull())),
        ("live_failed", live_is("failed") & ~(fresh_is("live-check-failed") & ~_true(c("has_official_evidence")) & at.isNotNull())),
        ("gates", _true(F.exists("gates", lambda g: ~gate(g)))),
        ("actions", _true(F.exists("actions", lambda a: a.isNull()))),
        ("evidence", _true(F.exists("evidence", lambda e: ~whole(e)))),
        ("live_privacy", live.isNotNull() & c("sent_to_official").isNull()),
        ("verified_evidence", live_is("verified") & ~_true(F.exists("evidence", _verified))),
        ("failed_route", live_is("failed") & ~(_true(c("route_state") == "prepare-and-verify") & _true(F.size("evidence") == 0))),
    ]
    return F.array_compact(F.array(*(F.when(broken, code) for code, broken in rules)))


def valid_decisions(responses: DataFrame) -> DataFrame:
    """Records with the rules that they break and whether they keep all."""
    return responses.withColumn("violations", violations(responses)).withColumn("valid", F.size("violations") == 0)


def eligibility_from_decisions(responses: DataFrame) -> DataFrame:
    """Per valid record the checks of its gates, a status and the state of its live verification.

    Met and not met gates count only beside trusted evidence; gates that do not
    apply pass and are not hard.
    """
    trusted = F.size("trusted") > 0

    def check(g: Column) -> Column:
        decided = g["status"].isin("met", "not_met")
        outcome = F.when(g["status"] == "not_applicable", "pass").when(decided & ~trusted, "unknown").when(g["status"] == "met", "pass").when(g["status"] == "not_met", "fail").otherwise("unknown")
        kind = F.element_at(F.create_map(*(F.lit(x) for kv in GATE_KINDS.items() for x in kv)), g["code"])
        summary = F.when(decided & ~trusted, F.concat(g["statement"], F.lit(UNTRUSTED))).otherwise(g["statement"])
        proof = F.when(outcome == "unknown", F.array().cast("array<string>")).otherwise(F.transform("trusted", lambda e: F.concat(F.lit("intelligence:"), e["id"])))
        return F.struct(kind.alias("kind"), (g["status"] != "not_applicable").alias("hard"), outcome.alias("outcome"), summary.alias("summary"), proof.alias("evidence"))

    hard = lambda o: F.exists("checks", lambda k: k["hard"] & (k["outcome"] == o))
    fresh, live = F.col("boundary.freshness"), F.col("boundary.live_status")
    verification = (
        F.when((fresh == "live") & (live == "verified"), "live-verified")
        .when((fresh == "live-check-failed") & (live == "failed"), "live-failed")
        .otherwise("stored-snapshot")
    )
    return (
        valid_decisions(responses).where("valid")
        .withColumn("trusted", trusted_evidence(F.col("evidence")))
        .withColumn("checks", F.transform("gates", check))
        .withColumn("status", F.when(hard("fail"), "not_eligible_current_batch").when(hard("unknown"), "unknown").otherwise("eligible"))
        .withColumn("verification", verification)
        .select(
            "decision_id", F.col("external_job_id").alias("job_id"), "status", (F.col("status") == "eligible").alias("can_apply"), "checks",
            F.transform(F.filter("checks", lambda k: k["outcome"] != "pass"), lambda k: k["summary"]).alias("reasons"),
            "verification", F.when(F.col("verification") != "stored-snapshot", F.col("boundary.live_verified_at")).alias("checked_at"),
        )
    )


def context_budget(sources: DataFrame) -> DataFrame:
    """Per query the JSON of its sources within CONTEXT_CHARS characters where their snippets allow it.

    sources: (query_id, rank from 1, title, snippet, url, published_at). Ranks
    beyond the budgets take no part, so a query gathers six rows at most; ranks
    do not repeat within a query.
    Snippets are cut by rank, then from the last source to the first by what is
    too long, down to LEAST_SNIPPET characters. Characters are code points. A
    null title or snippet counts as empty.
    """
    text = lambda name, n: F.substring(F.coalesce(F.col(name), F.lit("")), F.lit(1), F.lit(n))
    budget = F.element_at(F.array(*map(F.lit, SNIPPET_BUDGETS)), F.col("rank").cast("int"))
    source = F.struct(
        F.concat(F.lit("资料"), F.col("rank").cast("string")).alias("reference"), text("title", TITLE_CHARS).alias("title"), text("snippet", budget).alias("snippet"),
        F.substring("url", 1, URL_CHARS).alias("url"), F.substring(F.col("published_at").cast("string"), 1, DAY_CHARS).alias("publishedAt"),
    )
    kept = sources.where(F.col("rank").between(1, len(SNIPPET_BUDGETS)))
    out = kept.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", source.alias("source")))), lambda x: x["source"]).alias("s"))
    json = lambda: F.to_json("s", {"ignoreNullFields": "false"})
    over = F.length(json()) - CONTEXT_CHARS
    size = lambda x: F.length(x["snippet"])
    for back in range(1, len(SNIPPET_BUDGETS) + 1):
        last = F.size("s") - back

        def trim(x: Column, i: Column) -> Column:
            cut = F.substring(x["snippet"], F.lit(1), F.greatest(F.lit(LEAST_SNIPPET), size(x) - F.col("over") - SLACK))
            return F.when((i == last) & (F.col("over") > 0) & (size(x) > LEAST_SNIPPET), x.withField("snippet", cut)).otherwise(x)  # noqa: B023

        out = out.withColumn("over", over).withColumn("s", F.transform("s", trim))
    return out.select("query_id", F.size("s").cast("int").alias("sources"), json().alias("context"))
