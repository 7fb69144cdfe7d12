"""Evaluation of decision reports against their cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from career_lake.session import together

PRODUCTS = ["resume", "application", "interview"]


def evaluate_decisions(cases: DataFrame, reports: DataFrame, candidates: DataFrame, assessments: DataFrame) -> DataFrame:
    """(case_id, failures, warnings), codes in a fixed order.

    cases: (case_id, min_candidates, min_primary, min_high_risk, score_min,
    score_max, directions: array<string>). reports: (case_id, contract boolean,
    readiness, directions, portfolio: array<struct<tier, id>>, blockers:
    array<struct<trigger, product>>). candidates: (case_id, id). assessments:
    (case_id, id, qualification, score, all_pass, late).
    """
    q = F.col("qualification")
    wrong = ((q == "raw-fields-aligned") & ~F.col("all_pass"), (q == "expired") & ~F.col("late"), F.col("score").isNull() | ~F.col("score").between(0, 100), (F.col("score") == 100) & ~F.col("all_pass"))
    one, picked = F.lit(1), F.col("p.tier") == "primary"
    told = [
        candidates.select("case_id", "id", one.alias("n")),
        assessments.select(
            "case_id", "id", one.alias("m"), q.isNotNull().cast("int").alias("graded"),
            *(c.cast("int").alias(k) for k, c in (("expired", q == "expired"), ("high_risk", q == "high-risk"), ("over_expired", q > "expired"), ("over_risk", q > "high-risk"))), *(w.cast("int").alias(f"wrong{i}") for i, w in enumerate(wrong)),
        ),
        reports.select("case_id", F.explode("portfolio").alias("p")).select("case_id", "p.id", one.alias("chosen"), picked.cast("int").alias("primary")),
    ]
    # What a case says of an id meets in one row, and a case's rows in one task: they are shuffled once.
    rows = together(told[0].unionByName(told[1], allowMissingColumns=True).unionByName(told[2], allowMissingColumns=True), "case_id")
    sums = ["n", "m", "chosen", "primary", "expired", "high_risk", *(f"wrong{i}" for i in range(len(wrong)))]
    # An id that is assessed again has the greatest qualification; sums tell it, as they need no sorting.
    ids = rows.groupBy("case_id", "id").agg(*(F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in [*sums, "graded", "over_expired", "over_risk"]))
    known = (F.col("graded") > 0) & F.col("id").isNotNull()
    distinct = lambda c: F.count_if((F.col(c) > 0) & F.col("id").isNotNull())
    chosen = lambda c: F.sum(F.when(c, F.col("chosen")).otherwise(0))
    per = ids.groupBy("case_id").agg(
        *(F.sum(s).alias(s) for s in sums), distinct("n").alias("ids"), distinct("m").alias("m_ids"), distinct("chosen").alias("chosen_ids"),
        chosen(~known).alias("unknown"), chosen(known & (F.col("expired") > 0) & (F.col("over_expired") == 0)).alias("p_expired"), chosen(known & (F.col("high_risk") > 0) & (F.col("over_risk") == 0)).alias("p_risk"),
    )
    r = together(cases.withColumnRenamed("directions", "wanted"), "case_id").join(together(reports, "case_id").hint("merge"), "case_id", "left").join(per.hint("merge"), "case_id", "left")
    r = r.fillna(0, [*sums, "ids", "m_ids", "chosen_ids", "unknown", "p_expired", "p_risk"])
    blockers = F.coalesce("blockers", F.array())
    failures = F.array_compact(F.array(
        F.when(~F.coalesce("contract", F.lit(False)), "contract"), F.when(F.col("n") < F.col("min_candidates"), "candidates"), F.when(F.col("n") != F.col("ids"), "repeated_candidates"), F.when(F.col("m") != F.col("m_ids"), "repeated_assessments"),
        F.when(F.col("n") != F.col("m"), "counts_differ"), F.when(F.col("unknown") > 0, "unknown_reference"), F.when(F.col("chosen") != F.col("chosen_ids"), "repeated_reference"), F.when(F.col("p_expired") > 0, "expired_in_portfolio"),
        F.when(F.col("p_risk") > 0, "risk_in_portfolio"), F.when(F.col("wrong0") > 0, "aligned_without_pass"), F.when(F.col("wrong1") > 0, "expired_without_deadline"), F.when(F.col("wrong2") > 0, "score_range"),
        F.when(F.exists(blockers, lambda b: b["trigger"] != "after-target-selected"), "early_blocker"), F.when(F.exists(blockers, lambda b: b["product"].isNotNull() & ~b["product"].isin(PRODUCTS)), "unknown_product"),
        F.when(~F.coalesce(F.col("readiness").between(F.col("score_min"), F.col("score_max")), F.lit(False)), "readiness"), F.when((F.size("wanted") > 0) & ~F.coalesce(F.arrays_overlap("wanted", F.coalesce("directions", F.array().cast("array<string>"))), F.lit(False)), "direction"),
        F.when(F.col("high_risk") < F.col("min_high_risk"), "high_risk"), F.when(F.col("primary") < F.col("min_primary"), "primary"), F.when(F.col("wrong3") > 0, "perfect_without_pass"),
    ))
    warnings = F.array_compact(F.array(F.when((F.col("m") > 0) & (F.col("expired") >= F.col("m") * 0.5), "mostly_expired"), F.when(F.get("directions", F.lit(0)) == "其他专业相关方向", "broad_direction")))
    return r.select("case_id", failures.alias("failures"), warnings.alias("warnings"))


def qualification_counts(assessed: DataFrame) -> DataFrame:
    """(case_id, counts: map of qualification to assessments; those without one are `unknown`)."""
    n = assessed.groupBy("case_id", F.coalesce("qualification", F.lit("unknown")).alias("qualification")).agg(F.count("*").alias("n"))
    return n.groupBy("case_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("qualification", "n")))).alias("counts"))


def decision_summary(results: DataFrame) -> DataFrame:
    """One row about a suite: cases passed and failed, failures of the infrastructure (no report of the contract) and of decisions, and the number of warnings."""
    failed, infra = F.size("failures") > 0, F.array_contains("failures", "contract")
    return results.agg(
        F.count("*").alias("cases"), F.count_if(~failed).alias("passed"), F.count_if(failed).alias("failed"), F.count_if(failed & infra).alias("infrastructure"), F.count_if(failed & ~infra).alias("decision"),
        F.coalesce(F.sum(F.size("warnings")), F.lit(0)).alias("warnings"),
    )
