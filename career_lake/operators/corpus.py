"""Corpus: pages, document quality, versions, queues, mappings and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from career_lake import rules

_URL = "^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\\?([^#]*))?"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _URL, 1))


def host(url: Column) -> Column:
    """The lower-case host name, without user and port."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_extract(url, _URL, 2), "^.*@", ""), ":\\d*$", ""))


def path(url: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(url, _URL, 3), F.lit("")), F.lit("/"))


def canonical_url(url: Column) -> Column:
    """Lower scheme and host, no default port or fragment, tracking keys dropped, the rest of the query sorted."""
    port = F.regexp_extract(F.regexp_extract(url, _URL, 2), ":(\\d+)$", 1)
    default = ((scheme(url) == "http") & (port == "80")) | ((scheme(url) == "https") & (port == "443")) | (port == "")
    code = lambda x: F.replace(F.replace(F.url_encode(F.coalesce(F.try_url_decode(x), x)), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    split = lambda x: F.struct(F.regexp_extract(x, "^([^=]*)", 1).alias("k"), F.regexp_extract(x, "^[^=]*=(.*)$", 1).alias("v"))
    query = F.transform(F.filter(F.split(F.regexp_extract(url, _URL, 4), "&"), lambda x: x != ""), split)
    query = F.array_sort(F.filter(query, lambda p: ~F.lower(p["k"]).isin(rules.TRACKING_KEYS)))
    text = F.array_join(F.transform(query, lambda p: F.concat(code(p["k"]), F.lit("="), code(p["v"]))), "&")
    site = F.concat(host(url), F.when(default, "").otherwise(F.concat(F.lit(":"), port)))
    return F.concat(scheme(url), F.lit("://"), site, path(url), F.when(text == "", "").otherwise(F.concat(F.lit("?"), text)))


def page_groups(pages: DataFrame) -> DataFrame:
    """Pages by canonical URL."""
    return pages.groupBy(canonical_url(F.col("url")).alias("canonical_url")).agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page"))


def in_scope(url: Column, root: Column, hosts: Column, include: Column, exclude: Column) -> Column:
    """An allowed host (else the root's), an included path if there are any, and no excluded one."""
    none = F.array().cast("array<string>")
    allowed = F.filter(F.transform(F.coalesce(hosts, none), F.lower), lambda h: F.trim(h) != "")
    host_ok = F.when(F.size(allowed) > 0, F.array_contains(allowed, host(url))).otherwise(host(url) == host(root))
    starts = lambda prefixes: F.exists(F.coalesce(prefixes, none), lambda p: path(url).startswith(p))
    return host_ok & ((F.size(F.coalesce(include, none)) == 0) | starts(include)) & ~starts(exclude)


def normalise_text(c: Column) -> Column:
    """Blanks collapsed in each line, empty lines and NUL dropped."""
    lines = F.split(F.replace(c, F.lit("\x00"), F.lit("")), "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\u0085\u2028\u2029]")
    return F.array_join(F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, "(?U)\\s+", " "))), lambda x: x != ""), "\n")


def link_edges(pages: DataFrame) -> DataFrame:
    """Page, canonical link and its first position; same host, no mail, phone or script links.

    pages: (page_id, url, links array<string> in page order; absolute or rooted).
    """
    raw = pages.select("page_id", "url", F.posexplode("links").alias("pos", "link")).where(~F.lower("link").rlike("^(?:mailto|tel|javascript):"))
    absolute = F.when(F.col("link").rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), F.col("link")).when(F.col("link").startswith("/"), F.concat(F.regexp_extract("url", "^([^/]*//[^/?#]*)", 1), "link"))
    edges = raw.withColumn("target", canonical_url(absolute)).where(host(F.col("target")) == host(F.col("url")))
    return edges.groupBy("page_id", "target").agg(F.min("pos").alias("pos"))


def is_index_url(url: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(path(url), "/+$", ""), "([^/]*)$", 1).rlike(rules.INDEX_FILE)


def plan_frontier(edges: DataFrame, visited: DataFrame, sources: DataFrame) -> DataFrame:
    """New supported links of each source, details before listings, first in first out, at most 4 * max_documents.

    edges: (source_id, url, depth, pos). visited: (url). sources: (source_id, max_documents).
    """
    supported = ~F.lower(path(F.col("url"))).rlike("(?:" + "|".join(s.replace(".", "\\.") for s in rules.UNSUPPORTED_SUFFIXES) + ")$")
    new = edges.where(supported).join(visited.select("url").distinct(), "url", "left_anti")
    first = F.row_number().over(Window.partitionBy("source_id", "url").orderBy("depth", "pos"))
    new = new.withColumn("again", first).where("again = 1").drop("again").withColumn("is_index", is_index_url(F.col("url")))
    place = F.row_number().over(Window.partitionBy("source_id").orderBy("is_index", "depth", "pos", "url"))
    return new.withColumn("place", place).join(sources.select("source_id", "max_documents"), "source_id").where(F.col("place") <= F.col("max_documents") * 4).drop("max_documents")


def duplicate_groups(docs: DataFrame) -> DataFrame:
    """SHA-256 of the text, with its documents' number and smallest id."""
    return docs.groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_doc"))


_SIGNAL, _CJK = "[A-Za-z0-9一-鿿]", "[一-鿿]"


def normalise_ocr(c: Column) -> Column:
    """T04 without decoration lines (no CJK and at most one sign); 100,000 characters."""
    lines = F.filter(F.split(normalise_text(c), "\n"), lambda x: (x != "") & ((F.regexp_count(x, F.lit(_CJK)) > 0) | (F.regexp_count(x, F.lit(_SIGNAL)) > 1)))
    return F.substring(F.array_join(lines, "\n"), 1, 100_000)


def ocr_quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """Docs with the counts, ratios and score of recognised text."""
    n = F.length(text)
    lines = F.filter(F.split(text, "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\u0085\u2028\u2029]"), lambda x: x != "")
    short = F.size(F.filter(lines, lambda x: F.regexp_count(x, F.lit(_SIGNAL)) <= 2))
    docs = docs.withColumns({"characters": n, "cjk": F.regexp_count(F.col(text), F.lit(_CJK)), "lines": F.size(lines), "replaced": F.regexp_count(F.col(text), F.lit("�"))})
    docs = docs.withColumn("short_ratio", F.when(F.col("lines") > 0, short / F.col("lines")).otherwise(1.0)).withColumn("signal_ratio", F.regexp_count(F.col(text), F.lit(_SIGNAL)) / F.greatest(n, F.lit(1)))
    minus = (
        F.when(n < 200, 35).when(n < 500, 15).otherwise(0) + F.when(F.col("cjk") < 80, 25).when(F.col("cjk") < 200, 10).otherwise(0) + F.when(F.col("short_ratio") > 0.35, 25).when(F.col("short_ratio") > 0.20, 10).otherwise(0)
        + F.when(F.col("signal_ratio") < 0.45, 15).otherwise(0) + F.when(F.col("replaced") > 0, 20).otherwise(0)
    )
    return docs.withColumn("score", F.greatest(F.lit(0), 100 - minus)).withColumn("needs_review", F.col("score") < 70)


def dedupe_artifacts(rows: DataFrame, order: str) -> DataFrame:
    """Complete artifacts with text hashes, one for each (version, image, raw hash, engine)."""
    keys = ["version_id", "image_url", "raw_hash", "engine"]
    rows = rows.withColumn("raw_hash", F.sha2("raw_text", 256)).withColumn("text_hash", F.sha2(normalise_ocr(F.col("raw_text")), 256))
    for c in ("version_id", "image_url", "engine", "raw_text"):
        rows = rows.where(F.trim(c) != "")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("place = 1").drop("place")


def reuse_ocr(images: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Each image's artifact of the same image hash, engine and config; that of the same URL first, then the oldest."""
    a = artifacts.select("image_hash", "engine", "config", F.col("canonical_url").alias("artifact_url"), "artifact_id", "created_at")
    found = images.join(a, ["image_hash", "engine", "config"])
    place = F.row_number().over(Window.partitionBy("image_id").orderBy((F.col("artifact_url") != F.col("canonical_url")).cast("int"), "created_at", "artifact_id"))
    return found.withColumn("place", place).where("place = 1").select("image_id", "artifact_id")


def enrich_with_ocr(docs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Short documents with images get the text of their first 3 images' artifacts, the least score, any review flag, and a status."""
    used = artifacts.where("position < 3").groupBy("doc_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]), "\n").alias("ocr_text"),
        F.min("score").alias("ocr_score"), F.bool_or("needs_review").alias("ocr_review"), F.count("*").alias("found"),
    )
    out = docs.join(used, "doc_id", "left")
    wants = (F.length("text") < 200) & (F.col("images") > 0)
    status = F.when(~wants, None).when(F.col("found").isNull(), "failed").when(F.col("ocr_review"), "review_required").when(F.col("found") < F.least(F.col("images"), F.lit(3)), "required").otherwise("completed")
    text = F.when(wants & F.col("ocr_text").isNotNull(), F.concat_ws("\n", "text", "ocr_text")).otherwise(F.col("text"))
    return out.withColumn("ocr_status", status).withColumn("text", text).drop("ocr_text", "found")


def _compact(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "(?U)\\s+", " "))


def _signal(c: Column) -> Column:
    return F.regexp_replace(F.lower(_compact(c)), "[^0-9a-z㐀-鿿]+", "")


def document_role(title: Column, url: Column, content: Column, ocr_status: Column) -> Column:
    """Q01: discovery_index, content_stub or evidence."""
    clean = F.trim(F.regexp_replace(_compact(title), rules.PUBLISHER_SUFFIX, ""))
    file = F.regexp_extract(F.regexp_replace(F.substring_index(F.coalesce(url, F.lit("")), "?", 1), "/+$", ""), "([^/]*)$", 1)
    listing = clean.rlike(rules.INDEX_TITLE) | (clean.isin(rules.GENERIC_TITLES) & F.lower(file).startswith("index"))
    head, body = _signal(clean), _signal(content)
    # The body is the title again and again.
    repeated = (F.length(head) > 0) & (F.length(body) < 180) & (F.length(body) % F.length(head) == 0) & (body == F.repeat(head, (F.length(body) / F.length(head)).cast("int")))
    stub = (F.lower(F.coalesce(ocr_status, F.lit(""))).isin("required", "failed") & (F.length(_compact(content)) < 200)) | (body == "") | F.coalesce(repeated, F.lit(False))
    return F.when(listing, "discovery_index").when(stub, "content_stub").otherwise("evidence")


def with_role(versions: DataFrame) -> DataFrame:
    role = document_role(F.col("title"), F.col("canonical_url"), F.col("content"), F.col("ocr_status"))
    return versions.withColumn("role", role).withColumn("reasons", F.when(F.col("role") == "discovery_index", F.array(F.lit("listing_page"))).when(F.col("role") == "content_stub", F.array(F.lit("missing_substantive_body"))).otherwise(F.array().cast("array<string>")))


def current_versions(versions: DataFrame) -> DataFrame:
    """The last version of each (source, document)."""
    last = F.row_number().over(Window.partitionBy("source_id", "document_id").orderBy(F.desc("version_no"), "version_id"))
    return versions.withColumn("place", last).where("place = 1").drop("place")


def role_counts(versions: DataFrame) -> DataFrame:
    """Q02: active current versions by role."""
    return with_role(current_versions(versions).where("status = 'active'")).groupBy("role").agg(F.count("*").alias("documents"))


def append_versions(versions: DataFrame, candidates: DataFrame) -> DataFrame:
    """The new versions: contents that the document hasn't had, numbered from its last version on.

    versions: (document_id, content_hash, version_no). candidates: (document_id,
    content_hash, candidate_order, ...).
    """
    first = F.row_number().over(Window.partitionBy("document_id", "content_hash").orderBy("candidate_order"))
    new = candidates.withColumn("p", first).where("p = 1").drop("p").join(versions.select("document_id", "content_hash"), ["document_id", "content_hash"], "left_anti")
    last = versions.groupBy("document_id").agg(F.max("version_no").alias("last_no"))
    number = F.row_number().over(Window.partitionBy("document_id").orderBy("candidate_order")) + F.coalesce("last_no", F.lit(0))
    return new.join(last, "document_id", "left").withColumn("version_no", number).withColumn("changed", F.col("last_no").isNotNull()).drop("last_no")


def carry_metadata(current: DataFrame, incoming: DataFrame, governed: list[str]) -> DataFrame:
    """Incoming metadata with the governed keys of the current one; a governed status survives."""
    c = current.select("document_id", F.col("metadata").alias("old"), F.col("status").alias("old_status"))
    keep = F.map_filter("old", lambda k, v: k.isin(governed) & v.isNotNull())
    out = incoming.join(c, "document_id", "left")
    rest = F.map_filter("metadata", lambda k, v: ~F.coalesce(F.map_contains_key(keep, k), F.lit(False)))
    return out.withColumn("metadata", F.coalesce(F.map_concat(rest, keep), "metadata")).withColumn("status", F.when(F.col("old_status").isin(rules.GOVERNED_STATUSES), F.col("old_status")).otherwise(F.col("status"))).drop("old", "old_status")


def searchable(versions: DataFrame, sources: DataFrame) -> DataFrame:
    """Active current evidence of enabled sources."""
    return with_role(current_versions(versions).where("status = 'active'")).where("role = 'evidence'").join(sources.where("enabled").select("source_id"), "source_id", "left_semi")


def sync_run_rollup(events: DataFrame) -> DataFrame:
    """Each run's counts, status and message. events: (run_id, source_id, kind, ts, message)."""
    n = lambda *k: F.count_if(F.col("kind").isin(*k))
    out = events.groupBy("run_id").agg(n("seen", "changed").alias("seen"), n("changed").alias("changed"), n("error").alias("errors"), F.max("ts").alias("finished_at"), F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == "error", F.struct("ts", "message")))), lambda x: x["message"]), "\n").alias("m"))
    status = F.when((F.col("errors") > 0) & (F.col("seen") == 0), "failed").when(F.col("errors") > 0, "partial").otherwise("success")
    return out.select("run_id", "seen", "changed", "errors", "finished_at", status.alias("status"), F.substring("m", 1, 4000).alias("message"))


def last_synced(sources: DataFrame, events: DataFrame) -> DataFrame:
    """Sources with last_synced_at, the end of their last run, whatever its outcome; null without a run. events: (run_id, source_id, ts, ...)."""
    ended = events.groupBy("source_id").agg(F.max("ts").alias("last_synced_at"))
    return sources.join(ended, "source_id", "left")


def batch_summary(runs: DataFrame, sources: DataFrame, limit: int) -> DataFrame:
    """Outcome of the first enabled sources (50 at most). runs: (source_id, status, seen, changed)."""
    first = sources.where("enabled").orderBy("source_id").limit(min(50, max(1, limit)))
    r = first.join(runs, "source_id", "left")
    failed, done = F.count_if(F.col("status") == "failed"), F.count("status")
    status = F.when(done == 0, "noop").when(failed == done, "failed").when(F.count_if(F.col("status").isin("failed", "partial")) > 0, "completed_with_errors").otherwise("success")
    return r.agg(F.count_distinct("source_id").alias("sources"), done.alias("runs"), failed.alias("failed"), F.coalesce(F.sum("seen"), F.lit(0)).alias("seen"), F.coalesce(F.sum("changed"), F.lit(0)).alias("changed"), status.alias("status"))


def enqueue_reviews(queue: DataFrame, issues: DataFrame) -> DataFrame:
    """The issues to insert: one for each key that no pending row has. Both: (source_id, document_id, kind, message, payload map, created_at)."""
    ignored = ["runId", "attemptedAt", "timestamp"]
    payload = F.to_json(F.array_sort(F.map_entries(F.map_filter(F.coalesce("payload", F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(ignored)))))
    key = F.sha2(F.concat_ws("\x1f", F.coalesce("source_id", F.lit("")), F.coalesce("document_id", F.lit("")), "kind", F.substring("message", 1, 2000), payload), 256)
    keyed = issues.withColumn("dedupe_key", key)
    pending = queue.withColumn("dedupe_key", F.coalesce("dedupe_key", key) if "dedupe_key" in queue.columns else key).where("status = 'pending'").select("dedupe_key")
    first = F.row_number().over(Window.partitionBy("dedupe_key").orderBy("created_at", "document_id"))
    return keyed.withColumn("p", first).where("p = 1").drop("p").join(pending, "dedupe_key", "left_anti")


def resolve_reviews(queue: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Queue with pending rows resolved that a resolution (document_id, kind) names."""
    r = resolutions.select("document_id", "kind").distinct().withColumn("hit", F.lit(True))
    out = queue.join(r, ["document_id", "kind"], "left")
    return out.withColumn("status", F.when((F.col("status") == "pending") & F.col("hit"), "resolved").otherwise(F.col("status"))).drop("hit")


def resolve_url_reviews(queue: DataFrame, resolutions: DataFrame) -> DataFrame:
    """queue(source_id, kind, url, ...) with pending rows resolved whose source, kind and URL a resolution (source_id, kind, url) names. Blank names and URLs resolve nothing."""
    r = resolutions.select("source_id", F.trim("kind").alias("kind"), F.trim("url").alias("url")).where("kind <> '' and url <> ''").distinct().withColumn("hit", F.lit(True))
    out = queue.join(r, ["source_id", "kind", "url"], "left")
    return out.withColumn("status", F.when((F.col("status") == "pending") & F.col("hit"), "resolved").otherwise(F.col("status"))).drop("hit")


def upsert_mappings(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per document the new mapping; remote and batch ids keep the old value where the new is null."""
    keep, rest = ["remote_id", "batch_id"], ["content_hash", "status"]
    o = old.select("document_id", *(F.col(c).alias(f"o_{c}") for c in keep + rest), F.lit(True).alias("was"))
    n = new.select("document_id", *keep, *rest, F.lit(True).alias("now"))
    out = o.join(n, "document_id", "full_outer")
    cols = [F.coalesce(c, f"o_{c}").alias(c) for c in keep] + [F.when(F.col("now"), F.col(c)).otherwise(F.col(f"o_{c}")).alias(c) for c in rest]
    return out.select("document_id", *cols)


def needs_sync(docs: DataFrame, mappings: DataFrame) -> DataFrame:
    """Searchable documents without a synced mapping of the same hash."""
    m = mappings.select("document_id", F.col("content_hash").alias("mapped"), F.col("status").alias("sync"))
    return docs.join(m, "document_id", "left").where(F.col("sync").isNull() | (F.col("sync") != "synced") | (F.col("mapped") != F.col("content_hash"))).drop("mapped", "sync")


def reconcile_mappings(queued: DataFrame, feed: DataFrame) -> DataFrame:
    """The new status of queued mappings. queued: (document_id, remote_id, content_hash, current_hash); feed: (remote_id, remote_status)."""
    s = F.col("remote_status")
    status = (
        F.when(F.col("remote_id").isNull() | s.isNull(), "error").when((s == "completed") & (F.col("content_hash") == F.col("current_hash")), "synced").when(s == "completed", "error")
        .when(s.isin("error", "paused"), "error").otherwise("pending")
    )
    reason = F.when(F.col("remote_id").isNull() | s.isNull(), "missing").when((s == "completed") & (F.col("content_hash") != F.col("current_hash")), "stale").when(s.isin("error", "paused"), s)
    return queued.join(feed, "remote_id", "left").withColumn("status", status).withColumn("reason", reason)


#: Reviews of a mapping that its recovery settles, and what each failure says.
RECOVERABLE = ["index_failure", "index_check_failure"]
FAILED_MAPPINGS = {"missing": "索引映射缺少可跟踪的文档", "stale": "已完成的批次对应旧正文版本，需要重新同步", "error": "索引状态为 error", "paused": "索引状态为 paused"}


def mapping_reviews(reconciled: DataFrame) -> DataFrame:
    """The review (document_id, kind, message, payload) that each failed mapping of reconcile_mappings asks for."""
    message = F.element_at(F.create_map(*(F.lit(x) for kv in FAILED_MAPPINGS.items() for x in kv)), F.col("reason"))
    payload = F.map_filter(F.create_map(F.lit("remoteDocumentId"), F.col("remote_id"), F.lit("indexingStatus"), F.when(F.col("reason").isin("error", "paused"), F.col("reason"))), lambda k, v: v.isNotNull())
    return reconciled.where("status = 'error'").select("document_id", F.lit("index_failure").alias("kind"), message.alias("message"), payload.alias("payload"))


def recovered_mappings(reconciled: DataFrame) -> DataFrame:
    """The resolutions (document_id, kind) for R02 that synced mappings bring."""
    return reconciled.where("status = 'synced'").select("document_id", F.explode(F.array(*map(F.lit, RECOVERABLE))).alias("kind"))


def reconcile_summary(reconciled: DataFrame) -> DataFrame:
    """One row about a run: its status (noop, completed-with-errors or success) and counts."""
    n = lambda v: F.count_if(F.col("status") == v)
    status = F.when(F.count("*") == 0, "noop").when(n("error") > 0, "completed-with-errors").otherwise("success")
    return reconciled.agg(status.alias("run_status"), F.count("*").alias("selected"), n("synced").alias("synced"), n("pending").alias("pending"), n("error").alias("failed"))


def retry_plan(errors: DataFrame, docs: DataFrame, blocked: DataFrame) -> DataFrame:
    """Whether each failed mapping is requeued or blocked, and why. docs: (document_id, enabled, status, role, fact_review, ocr_review)."""
    b = blocked.select("document_id").distinct().withColumn("held", F.lit(True))
    out = errors.join(docs, "document_id", "left").join(b, "document_id", "left")
    why = (
        F.when(F.col("status").isNull(), "missing").when(~F.col("enabled"), "source_disabled").when(F.col("status") != "active", "inactive").when(F.col("held"), "cross_review").when(F.col("fact_review"), "fact_review")
        .when(F.col("ocr_review"), "ocr_review").when(F.col("role") != "evidence", "not_evidence")
    )
    return out.select("document_id", F.when(why.isNull(), "requeue").otherwise("blocked").alias("plan"), why.alias("reason"))


def source_coverage(sources: DataFrame, versions: DataFrame, runs: DataFrame, reviews: DataFrame, now: str, stale_days: int) -> DataFrame:
    """Per source its documents, dated ones, last run, pending reviews and whether it is stale."""
    days = max(1, min(365, stale_days))
    v = current_versions(versions).groupBy("source_id").agg(F.count_distinct("document_id").alias("documents"), F.count_distinct(F.when(F.col("published_at").isNotNull(), F.col("document_id"))).alias("dated"))
    r = runs.groupBy("source_id").agg(F.max_by("status", "started_at").alias("last_status"), F.max(F.when(F.col("status") != "failed", F.col("started_at"))).alias("last_synced"))
    q = reviews.where("status = 'pending'").groupBy("source_id").agg(F.count("*").alias("pending_reviews"))
    out = sources.join(v, "source_id", "left").join(r, "source_id", "left").join(q, "source_id", "left")
    stale = F.col("enabled") & (F.col("last_synced").isNull() | (F.col("last_synced") < F.date_sub(F.lit(now).cast("date"), days)))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("source_id", "enabled", zero("documents"), zero("dated"), "last_status", zero("pending_reviews"), stale.alias("stale"))


def coverage_by_tag(sources: DataFrame, coverage: DataFrame) -> DataFrame:
    """Per tag its registered and enabled sources and their documents."""
    tags = sources.select("source_id", F.explode(F.array_distinct(F.filter(F.split("tags", ","), lambda t: t != ""))).alias("tag"))
    return tags.join(coverage, "source_id").groupBy("tag").agg(F.count("*").alias("registered"), F.count_if("enabled").alias("enabled"), F.sum("documents").alias("documents"))


def coverage_summary(coverage: DataFrame) -> DataFrame:
    """Totals over all sources."""
    return coverage.agg(F.count("*").alias("registered"), F.count_if("enabled").alias("enabled"), F.count_if(F.col("documents") > 0).alias("with_documents"), F.sum("documents").alias("documents"), F.sum("dated").alias("dated"), F.count_if("stale").alias("stale"), F.count_if(F.col("last_status") == "failed").alias("failing"), F.sum("pending_reviews").alias("pending_reviews"))


def corpus_stats(sources: DataFrame, versions: DataFrame, reviews: DataFrame, runs: DataFrame) -> DataFrame:
    """One row of counters; each comes from its own table."""
    v = current_versions(versions)
    parts = [
        sources.agg(F.count("*").alias("sources"), F.count_if("enabled").alias("enabled_sources")),
        versions.agg(F.count("*").alias("versions")),
        v.agg(F.count("*").alias("documents"), *(F.count_if(F.col("status") == s).alias(f"documents_{s}") for s in ("active", "review_pending", "superseded"))),
        reviews.agg(F.count_if(F.col("status") == "pending").alias("pending_reviews"), F.count_if(F.col("status") == "resolved").alias("resolved_reviews")),
        runs.agg(F.count("*").alias("runs"), F.count_if(F.col("status") == "failed").alias("failed_runs")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, F.lit(True))  # one row each
    return out
