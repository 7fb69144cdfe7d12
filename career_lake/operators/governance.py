"""Routing, staging and review decisions of announcements, as joins of tables.

documents: (document_id, source_id, canonical_url, title, content_hash,
current_version_id, status, updated_at, ...). reviews: (review_id,
candidate_id, relation_type, change_scope, resume_completeness,
resolution_mode, status, target_id, created_at, resolved_at). edges:
(review_id, document_id, score, blocked, evidence).
A rule that is broken gives its name in a column `error`; such rows change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from career_lake.operators.corpus import host

#: Suggested targets of a review, rejected hashes that are kept, and rows of a list at most.
MOST_TARGETS, MOST_REJECTED, MOST_LISTED = 20, 10, 500


def _first_rule(*rules: tuple[Column, str]) -> Column:
    out = None
    for broken, name in rules:
        broken = F.coalesce(broken, F.lit(False))
        out = F.when(broken, name) if out is None else out.when(broken, name)
    return out


def route_candidates(candidates: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Candidates with their route: cross_review, passthrough, ignored, staged or upsert.

    candidates: (source_id, canonical_url, content_hash, role, relation_type,
    reasons). snapshot: (source_id, canonical_url, old_hash, old_role,
    old_status, rejected).
    """
    c = candidates.join(snapshot, ["source_id", "canonical_url"], "left")
    new, evidence = F.col("old_hash").isNull(), F.col("role") == "evidence"
    changed = (F.col("old_hash") != F.col("content_hash")) & (F.size("reasons") > 0) & (evidence | (F.col("old_role") == "evidence"))
    route = (
        F.when(new & evidence & F.col("relation_type").isNotNull(), "cross_review")
        .when(F.col("old_status") == "review_pending", "passthrough")
        .when(F.array_contains("rejected", F.col("content_hash")), "ignored")
        .when(changed, "staged")
        .otherwise("upsert")
    )
    return c.withColumn("route", route).select(*candidates.columns, "route")


def stage_versions(candidates: DataFrame, documents: DataFrame, versions: DataFrame) -> DataFrame:
    """The staged version of each candidate (one a document): known by its hash, or the next number; current stays.

    documents: with pending_hash. versions: (document_id, version_id,
    version_no, content_hash). changed: another hash than the pending one.
    """
    d = documents.select("document_id", "source_id", "canonical_url", "pending_hash")
    last = versions.groupBy("document_id").agg(F.max("version_no").alias("last"))
    known = versions.groupBy("document_id", "content_hash").agg(F.min(F.struct("version_no", "version_id")).alias("known"))
    c = candidates.select("source_id", "canonical_url", "content_hash").join(d, ["source_id", "canonical_url"]).join(last, "document_id", "left").join(known, ["document_id", "content_hash"], "left")
    number = F.coalesce("known.version_no", F.coalesce("last", F.lit(0)) + 1)
    version = F.coalesce("known.version_id", F.concat("document_id", F.lit("-"), number.cast("string")))
    return c.select("document_id", F.col("content_hash").alias("candidate_hash"), version.alias("version_id"), number.alias("version_no"), (~F.col("pending_hash").eqNullSafe(F.col("content_hash"))).alias("changed"))


def list_fact_reviews(documents: DataFrame, sources: DataFrame, most: int = 100) -> DataFrame:
    """Documents with a pending candidate, oldest first."""
    pending = documents.where("pending_version_id is not null").join(sources.select("source_id", F.col("name").alias("source_name")), "source_id")
    return pending.orderBy("updated_at", "document_id").limit(max(1, min(most, MOST_LISTED))).select("document_id", "source_id", "source_name", "title", "canonical_url", "content_hash", "pending_version_id", "pending_hash")


def apply_fact_decisions(documents: DataFrame, versions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Documents after approvals (the candidate becomes current) and rejections (its hash is remembered, the last 10).

    decisions: (document_id, decision), one a document; those without a pending
    candidate change nothing. versions: with title, ocr_status.
    """
    v = versions.select(F.col("document_id").alias("v_document"), F.col("version_id").alias("v_id"), F.col("content_hash").alias("v_hash"), F.col("title").alias("v_title"), F.col("ocr_status").alias("v_ocr"))
    d = documents.join(decisions.where(F.col("decision").isin("approve", "reject")), "document_id", "left").join(v, (F.col("document_id") == F.col("v_document")) & (F.col("pending_version_id") == F.col("v_id")), "left")
    error = F.when(F.col("decision").isNotNull() & F.col("pending_version_id").isNull(), "not_pending").when(F.col("decision").isNotNull() & F.col("v_id").isNull(), "no_candidate")
    d = d.withColumn("error", error)
    ok = F.col("decision").isNotNull() & F.col("error").isNull()
    yes, no = ok & (F.col("decision") == "approve"), ok & (F.col("decision") == "reject")
    old = F.coalesce("rejected", F.array().cast("array<string>"))
    grown = F.when(F.array_contains(old, F.col("v_hash")), old).otherwise(F.array_append(old, F.col("v_hash")))
    last = F.when(F.size(grown) > MOST_REJECTED, F.slice(grown, -MOST_REJECTED, MOST_REJECTED)).otherwise(grown)
    return d.select(
        "document_id",
        F.when(yes, F.coalesce("v_title", "title")).otherwise(F.col("title")).alias("title"),
        F.when(yes, F.col("v_hash")).otherwise(F.col("content_hash")).alias("content_hash"),
        F.when(yes, F.col("v_id")).otherwise(F.col("current_version_id")).alias("current_version_id"),
        F.when(yes, "active").otherwise(F.col("status")).alias("status"),
        F.when(yes & (F.col("v_ocr") == "required"), "human_approved").when(yes, F.col("v_ocr")).otherwise(F.col("ocr_status")).alias("ocr_status"),
        F.when(no, last).otherwise(old).alias("rejected"),
        F.when(ok, F.lit(None)).otherwise(F.col("pending_version_id")).alias("pending_version_id"),
        "error",
    )


def open_reviews(candidates: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reviews, edges) of candidates whose URL is new to its source.

    candidates: (source_id, canonical_url, title, content_hash, relation_type,
    change_scope, resume_completeness, resolution_mode, created_at,
    suggestions array<struct<document_id, score, blocked, evidence>>). The
    candidate becomes version 1 of a document in review; ids are hashes of
    source and URL. Of the first 20 suggestions those of known documents stay.
    """
    new = candidates.where("relation_type is not null and relation_type <> ''").join(documents.select("source_id", "canonical_url"), ["source_id", "canonical_url"], "left_anti")
    new = new.withColumn("candidate_id", F.sha2(F.concat_ws("|", "source_id", "canonical_url"), 256)).withColumn("review_id", F.concat(F.lit("cross:"), "candidate_id"))
    whole = F.when(F.col("relation_type") == "resumed", F.coalesce("resume_completeness", F.lit("status_only")))
    reviews = new.select(
        "review_id", "candidate_id", "source_id", "canonical_url", "title", "content_hash", F.lit(1).alias("version_no"), F.lit("review_pending").alias("candidate_status"), "relation_type",
        F.coalesce("change_scope", F.lit("unknown")).alias("change_scope"), whole.alias("resume_completeness"), F.coalesce("resolution_mode", F.lit("reconcile")).alias("resolution_mode"), F.lit("pending").alias("status"), "created_at",
    )
    edges = new.select("review_id", F.posexplode(F.slice("suggestions", 1, MOST_TARGETS)).alias("place", "s")).where("s.document_id <> ''")
    edges = edges.groupBy("review_id", F.col("s.document_id").alias("document_id")).agg(F.min_by("s", "place").alias("s"))
    edges = edges.join(documents.select("document_id"), "document_id", "left_semi")
    return reviews, edges.select("review_id", "document_id", F.coalesce("s.score", F.lit(0.0)).alias("score"), F.coalesce("s.blocked", F.lit(False)).alias("blocked"), "s.evidence")


def list_reviews(reviews: DataFrame, documents: DataFrame, sources: DataFrame, edges: DataFrame, most: int = 100) -> DataFrame:
    """Pending reviews, oldest first, each with its targets: blocked ones first, then by score and id."""
    d = documents.select(F.col("document_id").alias("candidate_id"), F.col("title").alias("candidate_title"), F.col("status").alias("candidate_status"), "source_id")
    r = reviews.where("status = 'pending'").join(d, "candidate_id").join(sources.select("source_id", F.col("name").alias("source_name")), "source_id")
    r = r.orderBy("created_at", "review_id").limit(max(1, min(most, MOST_LISTED)))
    t = edges.join(documents.select("document_id", F.col("title").alias("target_title"), F.col("status").alias("target_status")), "document_id")
    one = F.struct((~F.col("blocked")).alias("open"), (-F.col("score")).alias("order"), "document_id", "target_title", "target_status", "score")
    targets = r.select("review_id").join(t, "review_id").groupBy("review_id").agg(F.sort_array(F.collect_list(one)).alias("targets"))  # MOST_TARGETS a review
    return r.join(targets, "review_id", "left").select("review_id", "candidate_id", "candidate_title", "candidate_status", "source_name", "relation_type", "created_at", F.coalesce("targets", F.array()).alias("targets"))


def apply_review_decisions(decisions: DataFrame, reviews: DataFrame, documents: DataFrame, edges: DataFrame) -> DataFrame:
    """The outcome of each decision (review_id, decision, target_id), one a review.

    Approval needs the one blocked target, or a named one that is known to the
    review or of the candidate's source or host. A whole withdrawal or a
    complete resumption that asks for it supersedes its target; any other
    approval holds the target for reconciliation; rejection lets the candidate
    in. Rows: review_id, candidate_id, target_id, resolution_mode, status,
    relation_type, created_at, error.
    """
    d = documents.select("document_id", "source_id", host(F.col("canonical_url")).alias("host"))
    mine = d.toDF("candidate_id", "c_source", "c_host")
    blocked = edges.where("blocked").join(d.select("document_id"), "document_id", "left_semi").groupBy("review_id").agg(F.count("*").alias("n"), F.min("document_id").alias("only"))
    r = decisions.withColumn("named", F.nullif(F.trim("target_id"), F.lit(""))).drop("target_id").join(reviews.select("review_id", "candidate_id", "relation_type", "change_scope", "resume_completeness", F.col("resolution_mode").alias("asked"), F.col("status").alias("was"), "created_at"), "review_id")
    r = r.join(mine, "candidate_id", "left").join(blocked, "review_id", "left").withColumn("target_id", F.coalesce("named", F.when((F.col("n") == 1) & (F.col("decision") == "approve"), F.col("only"))))
    r = r.join(d.toDF("target_id", "t_source", "t_host"), "target_id", "left").join(edges.select("review_id", F.col("document_id").alias("target_id"), F.lit(True).alias("known")).distinct(), ["review_id", "target_id"], "left")
    yes, named = F.col("decision") == "approve", F.col("named").isNotNull()
    strange = named & (F.col("t_source") != F.col("c_source")) & (F.col("t_host") != F.col("c_host")) & F.col("known").isNull()
    error = _first_rule(
        (~F.col("decision").isin("approve", "reject"), "unknown_decision"), ((F.col("was") != "pending") | F.col("c_source").isNull(), "not_pending"), (yes & F.col("target_id").isNull(), "ambiguous_target"),
        (yes & named & F.col("t_source").isNull(), "unknown_target"), (yes & (F.col("named") == F.col("candidate_id")), "own_target"), (yes & strange, "untrusted_target"),
    )
    over = ((F.col("relation_type") == "withdrawn") & (F.col("change_scope") == "whole")) | ((F.col("relation_type") == "resumed") & F.coalesce(F.col("resume_completeness") == "complete", F.lit(False)))
    mode = F.when(over & (F.coalesce("asked", F.lit("reconcile")) == "supersede"), "supersede").otherwise("reconcile")
    status = F.when(F.col("error").isNotNull(), F.col("was")).when(~yes, "rejected").when(F.col("resolution_mode") == "supersede", "approved").otherwise("approved_reconciliation")
    return r.withColumn("error", error).withColumn("resolution_mode", mode).select("review_id", "candidate_id", "target_id", "decision", "resolution_mode", status.alias("status"), "relation_type", "created_at", "error")


def decided_statuses(outcomes: DataFrame) -> DataFrame:
    """(document_id, status) of the documents that outcomes change; of several, the newest review's."""
    ok = outcomes.where("error is null")
    own = ok.select(F.col("candidate_id").alias("document_id"), F.lit("active").alias("status"), "created_at", "review_id")
    held = F.when(F.col("resolution_mode") == "supersede", "superseded").otherwise("review_pending")
    other = ok.where("decision = 'approve'").select(F.col("target_id").alias("document_id"), held.alias("status"), "created_at", "review_id")
    return own.union(other).groupBy("document_id").agg(F.max_by("status", F.struct("created_at", "review_id", "status")).alias("status"))


def list_reconciliations(reviews: DataFrame, documents: DataFrame, most: int = 100) -> DataFrame:
    """Approved reviews whose target is held, by the time of approval."""
    d = documents.select("document_id", "title", "canonical_url", "content_hash", "status")
    c = d.select(F.col("document_id").alias("candidate_id"), F.col("title").alias("candidate_title"))
    t = d.select(F.col("document_id").alias("target_id"), F.col("title").alias("target_title"), F.col("content_hash").alias("target_hash"), F.col("status").alias("target_status"))
    r = reviews.where("status = 'approved_reconciliation'").join(c, "candidate_id").join(t, "target_id")
    return r.orderBy("resolved_at", "review_id").limit(max(1, min(most, MOST_LISTED))).select("review_id", "relation_type", "candidate_id", "candidate_title", "target_id", "target_title", "target_hash", "target_status", "resolved_at")


def apply_reconciliations(requests: DataFrame, reviews: DataFrame, documents: DataFrame, sources: DataFrame) -> DataFrame:
    """The resolution of each request (review_id, replacement_id), one a review.

    The held target itself must have other content than when it was held
    (original_hash, with hold_review_id on documents) and is active again;
    another replacement must be active and of the same source, the same host or
    of two official sources of grade A or B, and supersedes the target.
    """
    s = sources.select("source_id", (F.upper("source_grade").isin("A", "B") & (F.coalesce(F.lower("authority"), F.lit("official")) == "official")).alias("trusted"))
    d = documents.join(s, "source_id", "left").select("document_id", "source_id", host(F.col("canonical_url")).alias("host"), "status", "content_hash", F.coalesce("trusted", F.lit(False)).alias("trusted"), "hold_review_id", "original_hash")
    t = d.select(*(F.col(c).alias(f"t_{c}") for c in d.columns))
    p = d.select(*(F.col(c).alias(f"p_{c}") for c in d.columns if c not in ("hold_review_id", "original_hash")))
    r = requests.join(reviews.select("review_id", "candidate_id", "target_id", F.col("status").alias("was")), "review_id").join(t, F.col("target_id") == F.col("t_document_id")).join(p, F.col("replacement_id") == F.col("p_document_id"), "left")
    same = F.col("replacement_id") == F.col("target_id")
    trusted = (F.col("p_source_id") == F.col("t_source_id")) | ((F.col("p_host") == F.col("t_host")) & (F.col("t_host") != "")) | (F.col("p_trusted") & F.col("t_trusted"))
    error = _first_rule(
        (F.col("was") != "approved_reconciliation", "not_held"), (F.col("p_document_id").isNull(), "unknown_replacement"), (F.col("replacement_id") == F.col("candidate_id"), "change_notice"),
        (~F.col("t_hold_review_id").eqNullSafe(F.col("review_id")), "other_hold"), (same & (F.col("t_content_hash") == F.col("t_original_hash")), "not_updated"),
        (~same & (F.col("p_status") != "active"), "not_active"), (~same & ~F.coalesce(trusted, F.lit(False)), "untrusted_replacement"),
    )
    r = r.withColumn("error", error)
    resolution = F.when(F.col("error").isNull(), F.when(same, "reactivated_updated_target").otherwise("superseded_by_replacement"))
    return r.select("review_id", "target_id", "replacement_id", resolution.alias("resolution"), F.when(F.col("error").isNull(), F.when(same, "active").otherwise("superseded")).alias("target_status"), "error")


def close_pause_chains(outcomes: DataFrame, reviews: DataFrame) -> DataFrame:
    """(resume_review_id, review_id, document_id) of held pauses that a complete resumption of either of their documents closes.

    document_id: a document that the resumption supersedes, the pause or what
    it paused; never the resumption itself.
    """
    full = outcomes.where("error is null and decision = 'approve' and relation_type = 'resumed' and resolution_mode = 'supersede'").select(F.col("review_id").alias("resume_review_id"), F.col("candidate_id").alias("resume_id"), F.col("target_id").alias("touched"))
    held = reviews.where("status = 'approved_reconciliation' and relation_type = 'paused'").select("review_id", "candidate_id", "target_id")
    by = [full.join(held, full.touched == held[c]) for c in ("candidate_id", "target_id")]
    out = by[0].union(by[1]).select("resume_review_id", "review_id", "resume_id", F.explode(F.array("candidate_id", "target_id")).alias("document_id"))
    return out.where("document_id <> resume_id").select("resume_review_id", "review_id", "document_id").distinct()
