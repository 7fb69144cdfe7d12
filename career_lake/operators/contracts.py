"""Contracts of handed-over profile snapshots, entitlements and products."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from career_lake import rules

#: Levels of a snapshot that are searched.
MOST_DEPTH = 8
SNAPSHOT = """struct<source string, schemaVersion string, privacy struct<mode string, persistence string>, workspace map<string, string>,
 access struct<features array<struct<code string, name string, routePath string, allowed boolean, dailyLimit string>>, legacyMembership struct<status string, effectiveTier string, expiryDate string>>,
 profile struct<education struct<university string, universityTier string, educationLevel string, degree string, major string, graduateYear string>,
  targets struct<locations array<string>, industries array<string>, positions array<string>>, experience struct<projects array<map<string, string>>, internships array<map<string, string>>>,
  capabilities struct<awards array<string>, certificates array<map<string, string>>>, resume struct<available boolean>>>"""
_CONTROL = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]"


def text(c: Column, most: int) -> Column:
    """Without control characters, trimmed, cut; null if nothing is left."""
    return F.nullif(F.substring(F.trim(F.regexp_replace(c, _CONTROL, "")), 1, most), F.lit(""))


def _texts(c: Column, most: int) -> Column:
    return F.slice(F.array_compact(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: text(x, 120))), 1, most)


def _label(c: Column, found: list[tuple[str, str]], other: str) -> Column:
    out = None
    for p, name in found:
        out = F.when(c.rlike(p), name) if out is None else out.when(c.rlike(p), name)
    return out.otherwise(other)


def forbidden_keys(snapshots: DataFrame) -> DataFrame:
    """(snapshot_id, path, deeper) of every forbidden key of snapshots(snapshot_id, snapshot as JSON text).

    Objects and lists are opened level by level. A row with path null and
    deeper true says that a snapshot goes below MOST_DEPTH levels.
    """
    level = snapshots.select("snapshot_id", F.lit("root").alias("path"), F.expr("try_parse_json(snapshot)").alias("value"))
    found = []
    for _ in range(MOST_DEPTH):
        level = snapshots.sparkSession.sql("SELECT snapshot_id, concat(path, CASE WHEN e.key IS NULL THEN concat('[', e.pos, ']') ELSE concat('.', e.key) END) AS path, e.key AS key, e.value AS value FROM {level}, LATERAL variant_explode(value) AS e", level=level)
        found.append(level.where(F.col("key").isin(rules.FORBIDDEN_KEYS)).select("snapshot_id", "path", F.lit(False).alias("deeper")))
        level = level.select("snapshot_id", "path", "value")
    below = level.where(F.schema_of_variant("value").rlike("^(?:OBJECT<.+|ARRAY<(?!VOID).+)"))
    return reduce(DataFrame.union, found).union(below.select("snapshot_id", F.lit(None).cast("string").alias("path"), F.lit(True).alias("deeper")).distinct())


def parsed(snapshots: DataFrame) -> DataFrame:
    """Snapshots with s, parsed once: a generator keeps the text from being parsed again by each field and filter that reads s."""
    return snapshots.withColumn("s", F.explode(F.array(F.from_json("snapshot", SNAPSHOT))))


def profile_contract(snapshots: DataFrame, source: str, version: str) -> DataFrame:
    """(snapshot_id, violation, subject): the first broken rule, or null and the anonymous workspace subject."""
    bad = forbidden_keys(snapshots).where(~F.col("deeper")).select("snapshot_id").distinct().withColumn("bad", F.lit(True))
    w = F.col("s.workspace")
    same = F.array_sort(F.map_keys(w)) == F.array(F.lit("persistence"), F.lit("purpose"), F.lit("subject"))
    good = same & (w["persistence"] == "agent-owned") & (w["purpose"] == "career-path-state") & w["subject"].rlike("^ws1_[A-Za-z0-9_-]{43}$")
    privacy = F.col("s.privacy")
    no = lambda c: ~F.coalesce(c, F.lit(False))
    is_object = F.col("snapshot").rlike("^\\s*\\{") & F.expr("try_parse_json(snapshot) is not null")
    violation = (
        F.when(no(is_object), "format").when(F.col("bad"), "forbidden_fields").when(no(F.col("s.source") == source), "source").when(no(F.col("s.schemaVersion") == version), "version")
        .when(no((privacy["mode"] == "explicit-user-handoff") & (privacy["persistence"] == "none-at-source")), "privacy").when(F.col("s.access").isNull(), "access").when(no(good), "workspace")
    )
    out = parsed(snapshots).join(bad, "snapshot_id", "left").withColumn("violation", violation)
    return out.select("snapshot_id", "violation", F.when(F.col("violation").isNull(), w["subject"]).alias("subject"))


def normalise_profiles(snapshots: DataFrame) -> DataFrame:
    """Profiles with school, major and year; others are dropped."""
    e, t, p = F.col("s.profile.education"), F.col("s.profile.targets"), F.col("s.profile")
    year = F.regexp_extract(F.coalesce(text(e["graduateYear"], 24), F.lit("")), "20\\d{2}", 0)
    year = F.when(year != "", year.cast("int"))
    some = lambda c, level: F.when(F.coalesce(F.size(c), F.lit(0)) > 0, level).otherwise("missing")
    sectors = F.concat(_texts(t["industries"], 6), _texts(t["positions"], 6))
    levels = {
        "resume": F.when(F.coalesce(p["resume"]["available"], F.lit(False)), "ready").otherwise("missing"), "application": F.lit("missing"), "interview": F.lit("missing"),
        "project_evidence": some(p["experience"]["projects"], "developing"), "internship": some(p["experience"]["internships"], "developing"),
        "competition": some(_texts(p["capabilities"]["awards"], 1), "developing"), "qualification": some(p["capabilities"]["certificates"], "developing"),
    }
    out = parsed(snapshots).select(
        "snapshot_id", text(e["university"], 100).alias("school"), _label(F.coalesce(text(e["universityTier"], 60), F.lit("")), rules.HANDOFF_TIERS, "普通本科").alias("school_tier"),
        _label(F.coalesce(text(F.coalesce(e["educationLevel"], e["degree"]), 40), F.lit("")), rules.HANDOFF_DEGREES, "unknown").alias("degree_level"), text(e["major"], 100).alias("major"), year.alias("graduation_year"),
        F.substring(F.array_join(_texts(t["locations"], 12), "、"), 1, 240).alias("preferred_cities"),
        F.substring(F.coalesce(F.nullif(F.array_join(sectors, "、"), F.lit("")), F.lit("央企 / 国企校招")), 1, 240).alias("target_sector"), *(v.alias(k) for k, v in levels.items()),
    )
    return out.where("school is not null and major is not null and graduation_year is not null")


def entitlements(snapshots: DataFrame, most: int = 8) -> DataFrame:
    """The first `most` allowed features of a snapshot with a safe route and a category; a code counts once."""
    f = parsed(snapshots).select("snapshot_id", F.posexplode(F.slice("s.access.features", 1, 80)).alias("place", "f"))
    cleaned = F.struct(text(F.col("f.code"), 64).alias("code"), text(F.col("f.name"), 80).alias("name"), text(F.col("f.routePath"), 160).alias("route"), F.col("f.dailyLimit").try_cast("bigint").alias("limit"))
    # Generators again: texts are cleaned, and their category is found, once.
    f = f.where("f.allowed").select("snapshot_id", "place", F.inline(F.array(cleaned)))
    r = F.col("route")
    safe = r.startswith("/") & ~r.startswith("//") & ~r.contains("://") & ~r.contains("\\")
    f = f.where(F.col("code").rlike("(?i)^[a-z0-9_.-]{2,80}$") & F.col("name").isNotNull() & safe)
    f = f.withColumn("category", F.explode(F.array(_label(F.concat_ws(" ", "code", "name", "route"), rules.FEATURE_CATEGORIES, "")))).where("category <> ''")
    first = f.groupBy("snapshot_id", "code").agg(F.min_by(F.struct("place", "name", "category", "route", "limit"), "place").alias("x")).select("snapshot_id", "code", "x.*")
    k = F.row_number().over(Window.partitionBy("snapshot_id").orderBy("place"))
    return first.withColumn("k", k).where(F.col("k") <= most).select("snapshot_id", "code", "name", "category", "route", F.when(F.col("limit") >= -1, F.least("limit", F.lit(100_000))).alias("daily_limit"), "k")


def membership(snapshots: DataFrame) -> DataFrame:
    """(snapshot_id, tier, status)."""
    m = F.col("s.access.legacyMembership")
    status = text(m["status"], 20)
    return parsed(snapshots).select("snapshot_id", F.coalesce(text(m["effectiveTier"], 40), F.lit("free")).alias("tier"), F.when(status.isin("active", "expired", "inactive", "none"), status).otherwise("none").alias("status"))


PRICES = [("monthly_price", "/月"), ("quarterly_price", "/季度"), ("yearly_price", "/年"), ("lifetime_price", "/长期")]


def normalise_products(products: DataFrame) -> DataFrame:
    """Products with valid id, name, slug and grant level; prices that are no price are null; features(title, description) without title go."""
    p = products.withColumns({"id": text(F.col("id"), 64), "name": text(F.col("name"), 100), "slug": text(F.col("slug"), 50), "grant_level": text(F.col("grant_level"), 20), "description": text(F.col("description"), 600)})
    price = lambda c: F.when(text(F.col(c), 24).rlike("^\\d{1,9}(?:\\.\\d{1,2})?$"), text(F.col(c), 24))
    p = p.withColumns({c: price(c) for c, _ in PRICES})
    kept = F.transform(F.coalesce("features", F.array()), lambda f: F.struct(text(f["title"], 120).alias("title"), text(f["description"], 300).alias("description")))
    p = p.withColumn("features", F.slice(F.filter(kept, lambda f: f["title"].isNotNull()), 1, 20))
    return p.where("id is not null and name is not null").where(F.col("slug").rlike("^[a-z0-9-]+$") & F.col("grant_level").isin("normal", "vip", "svip"))


def price_label(c: Column, suffix: str) -> Column:
    amount = c.try_cast("decimal(11,2)")
    plain = F.regexp_replace(F.regexp_replace(F.format_number(amount, 2), "\\.00$", ""), "(\\.\\d)0$", "$1")
    return F.when(amount == 0, "免费" + suffix).when(amount > 0, F.concat(F.lit("¥"), plain, F.lit(suffix)))


def product_offerings(products: DataFrame) -> DataFrame:
    """One row per product and category that its texts name, with the label of its first price."""
    texts = F.concat_ws(" ", "name", "description", F.array_join(F.transform("features", lambda f: F.concat_ws(" ", f["title"], f["description"])), " "))
    label = F.coalesce(*(price_label(F.col(c), suffix) for c, suffix in PRICES), F.lit("价格以主站为准"))
    found = F.array_compact(F.array(*(F.when(texts.rlike(p), name) for name, p in rules.PRODUCT_CATEGORIES)))
    out = products.select(F.col("id").alias("product_id"), "name", label.alias("price"), F.explode(found).alias("category"))
    return out.select(F.concat("product_id", F.lit(":"), "category").alias("offering_id"), "product_id", "name", "category", "price")
