"""Eligibility and the decision model: profiles joined to jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from career_lake import rules
from career_lake.functions.text import first_rule, half_up, lookup, trimmed

OFFICIAL = ["official_announcement", "official_job_page"]


def degree_rank(c: Column) -> Column:
    """0 to 5; null if unknown."""
    return F.element_at(F.create_map(*(F.lit(x) for i, d in enumerate(rules.DEGREES) for x in (d, i))), c)


def plain_major(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(trimmed(c), "[·・\\s（）()]", ""), "专业$", "")


def family(c: Column) -> Column:
    """The family of a major, or of a family's own name."""
    members = {m: f for f, ms in rules.FAMILIES.items() for m in [f, *ms]}
    return F.element_at(lookup(members), plain_major(c))


def major_match(major: Column, accepted: Column, related: Column) -> Column:
    """Exact, related, no_match or unknown."""
    mine, of = plain_major(major), family(major)
    pairs = F.create_map(*(F.lit(x) for a, b in rules.RELATED for k in ((a, b), (b, a)) for x in (":".join(k), True)))
    exact = F.exists(accepted, lambda a: plain_major(a).isin("不限", "不限专业", "所有专业") | (plain_major(a) == mine) | F.coalesce(family(a) == of, F.lit(False)))
    near = F.exists(accepted, lambda a: F.coalesce(F.element_at(pairs, F.concat(of, F.lit(":"), family(a))), F.lit(False)))
    return (
        F.when(major.isNull() | (trimmed(major) == "") | accepted.isNull() | (F.size(accepted) == 0), "unknown")
        .when(exact, "exact")
        .when(F.coalesce(related, F.lit(False)) & near, "related")
        .otherwise("no_match")
    )


def _backed(ids: Column, official: bool = True) -> Column:
    """Whether some evidence of the opening backs these ids."""
    return F.exists("evidence", lambda e: F.array_contains(ids, e["id"]) & (e["source_type"].isin(OFFICIAL) if official else F.lit(True)))


def hard_gates(pairs: DataFrame, now: str) -> DataFrame:
    """Pairs of profiles and openings with the outcome of each hard gate."""
    deg, maj, yrs, end = (F.col(c) for c in ("degree", "major_requirement", "years", "deadline"))
    unknown = lambda req: req.isNull() | ~F.coalesce(_backed(req["evidence_ids"]), F.lit(False))
    told = lambda ok: F.when(ok, "pass").otherwise("fail")
    level = F.col("degree_level")
    degree = (
        F.when(unknown(deg) | level.isNull() | (level == "unknown"), "unknown")
        .when(F.size(F.coalesce(deg["accepted"], F.array().cast("array<string>"))) > 0, told(F.array_contains(deg["accepted"], level)))
        .when(deg["minimum"].isNotNull(), told(degree_rank(level) >= degree_rank(deg["minimum"])))
        .otherwise("unknown")
    )
    match = major_match(F.col("major"), maj["accepted"], maj["allow_related"])
    major = F.when(unknown(maj), "unknown").otherwise(F.element_at(lookup({"unknown": "unknown", "exact": "pass", "related": "conditional", "no_match": "fail"}), match))
    year = F.when(unknown(yrs) | F.col("graduation_year").isNull(), "unknown").otherwise(told(F.array_contains(yrs["accepted"], F.col("graduation_year"))))
    late = (F.col("job_status") == "closed") | (end["date"] < F.lit(now).cast("date"))
    deadline = F.when(unknown(end) | end["date"].isNull(), "unknown").otherwise(F.when(late, "fail").otherwise("pass"))
    return pairs.withColumns({"gate_degree": degree, "gate_major": major, "gate_year": year, "gate_deadline": deadline})


def risk_checks(openings: DataFrame) -> DataFrame:
    """Openings with the labels of high risks that any evidence backs."""
    backed = lambda f: (f["severity"] == "high") & _backed(f["evidence_ids"], official=False)
    return openings.withColumn("risks", F.transform(F.filter("risk_flags", backed), lambda f: f["label"]))


GATES = ["gate_degree", "gate_major", "gate_year", "gate_deadline"]


def eligibility(pairs: DataFrame, now: str) -> DataFrame:
    """Pairs with their checks, status and whether the current batch can be applied for."""
    pairs = hard_gates(risk_checks(pairs), now)
    any_is = lambda v: reduce(lambda a, b: a | b, (F.col(g) == v for g in GATES))
    status = F.when(any_is("fail"), "not_eligible_current_batch").when(any_is("unknown"), "unknown").when(F.size("risks") > 0, "high_risk").when(any_is("conditional"), "conditional").otherwise("eligible")
    hard = [F.struct(F.lit(g.removeprefix("gate_")).alias("kind"), F.lit(True).alias("hard"), F.col(g).alias("outcome")) for g in GATES]
    soft = F.transform("risks", lambda r: F.struct(F.lit("risk").alias("kind"), F.lit(False).alias("hard"), F.lit("conditional").alias("outcome")))
    return pairs.withColumn("checks", F.concat(F.array(*hard), soft)).withColumn("eligibility", status).withColumn("can_apply", F.col("eligibility").isin("eligible", "conditional", "high_risk"))


def prelim_degree(raw: Column, level: Column) -> Column:
    text = trimmed(F.coalesce(raw, F.lit("")))
    ranks = F.array_compact(F.array(*(F.when(text.rlike(p), rules.DEGREES.index(d)) for d, p in rules.DEGREE_SEEN)))
    return (
        F.when(text == "", "unknown").when(text.rlike("不限"), "pass").when(level == "unknown", "unknown").when(F.size(ranks) == 0, "unknown")
        .when(degree_rank(level) >= F.array_min(ranks), "pass").otherwise("mismatch")
    )


def gate_family(major: Column) -> Column:
    """The number of the first family rule that a major meets; null if none."""
    return first_rule(major, [(str(i), p) for i, (p, _, _) in enumerate(rules.GATE_FAMILIES)], F.lit(None).cast("string")).cast("int")


def prelim_major(raw: Column, codes: Column, major: Column) -> Column:
    """Pass, conditional, unknown or mismatch of the listed major requirement."""
    text = trimmed(F.coalesce(raw, F.lit("")))
    codes = F.coalesce(codes, F.array().cast("array<string>"))
    fam = gate_family(major)
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, "(?U)\\s+", ""), "^(.*?)(?:专业|类|工程及其)", "$1")  # noqa: E731  the first only
    code_of = F.element_at(F.array(*(F.lit(c) for _, c, _ in rules.GATE_FAMILIES)), fam + 1)
    hits = F.array(*(text.rlike(t) for _, _, t in rules.GATE_FAMILIES))
    mine = F.coalesce(F.element_at(hits, fam + 1), F.lit(False))
    others = F.coalesce(F.exists(F.arrays_zip(hits.alias("h"), F.array(*(F.lit(c) for _, c, _ in rules.GATE_FAMILIES)).alias("c")), lambda x: x["h"] & (x["c"] != code_of)), F.lit(False))
    return (
        F.when((text == "") & (F.size(codes) == 0), "unknown")
        .when(text.rlike("不限专业|专业不限|不限"), "pass")
        .when(F.coalesce(F.exists(codes, lambda c: c.startswith(code_of)), F.lit(False)), "pass")
        .when((plain(major) != "") & plain(text).contains(plain(major)), "pass")
        .when(mine, "conditional")
        .when(text.rlike("理工科|工科|管理类|专业不限") | (text.rlike("相关专业") & ~others), "unknown")
        .otherwise("mismatch")
    )


def prelim_year(raw: Column, title: Column, year: Column) -> Column:
    """Years of the field and the title, 2020 to 2040; two digits only before 届."""
    text = trimmed(F.coalesce(raw, F.lit("")))
    all_ = lambda c, p, g: F.transform(F.regexp_extract_all(c, F.lit(p), F.lit(g)), lambda x: x.cast("int"))
    titled = all_(title, "(?<!\\d)(20\\d{2})(?=\\s*(?:届|校招|校园招聘|毕业生))", 1)
    classes = F.transform(all_(text, "(?<!\\d)((?:20)?\\d{2})\\s*届", 1), lambda y: F.when(y < 100, y + 2000).otherwise(y))
    years = F.filter(F.array_distinct(F.concat(classes, all_(text, "(?<!\\d)20\\d{2}(?!\\d)", 0), titled)), lambda y: y.between(2020, 2040))
    return (
        F.when((text == "") & (F.size(titled) == 0), "unknown").when(text.rlike("不限|均可|长期") & (F.size(titled) == 0), "pass").when(F.size(years) == 0, "unknown")
        .when(F.array_contains(years, year), "pass").otherwise("mismatch")
    )


def prelim_gates(pairs: DataFrame, now: str) -> DataFrame:
    """Pairs with the four preliminary gates."""
    today = F.lit(now).cast("date")
    return pairs.withColumns(
        {
            "p_degree": prelim_degree(F.col("education_level"), F.col("degree_level")),
            "p_major": prelim_major(F.col("major_requirements"), F.col("major_category_ids"), F.col("major")),
            "p_year": prelim_year(F.col("graduate_year"), F.col("job_title"), F.col("graduation_year")),
            "p_deadline": F.when(F.col("apply_end_date").isNull(), "unknown").when(F.col("apply_end_date") < today, "mismatch").otherwise("pass"),
        }
    )


def freshness(updated: Column, now: str) -> Column:
    """10 up to 7 days, 6 up to 30, else 1; 0 without a date."""
    days = F.greatest(F.lit(0), F.datediff(F.lit(now).cast("date"), updated))
    return F.when(updated.isNull(), 0).when(days <= 7, 10).when(days <= 30, 6).otherwise(1)


def region_match(preferred: Column, city: Column, place: Column) -> Column:
    """Whether a preferred place occurs in the location; true without preferences."""
    text = F.coalesce(F.nullif(preferred, F.lit("")), city, F.lit(""))
    wanted = F.filter(F.transform(F.split(text, "[,，/、;；\\s]+"), lambda x: trimmed(F.regexp_replace(x, "[省市]", ""))), lambda x: (x != "") & ~x.rlike("全国|不限"))
    where = F.regexp_replace(F.coalesce(place, F.lit("")), "[省市]", "")
    return (F.size(wanted) == 0) | F.exists(wanted, lambda x: where.contains(x))


def _level(key: str) -> Column:
    return F.coalesce(F.col(key), F.lit("missing"))


def readiness(profiles: DataFrame) -> DataFrame:
    """Profiles with readiness (0 to 100), its band, and the hours that blockers take."""
    share = lambda k: F.when(_level(k) == "ready", 1.0).when(_level(k) == "developing", 0.55).otherwise(0.0)
    hours = lambda k, h: half_up(h * F.when(_level(k) == "missing", 1.0).when(_level(k) == "developing", 0.5).otherwise(0.0))
    score = half_up(F.round(sum((share(k) * w for k, w, _ in rules.CAPABILITIES), F.lit(0.0)), 6)).cast("int")
    out = profiles.withColumn("readiness", score).withColumn("blocker_hours", sum((hours(k, h) for k, _, h in rules.CAPABILITIES), F.lit(0)).cast("int"))
    return out.withColumn("readiness_band", F.when(F.col("readiness") >= 75, "ready").when(F.col("readiness") >= 45, "basic").otherwise("early"))


def blockers(profiles: DataFrame) -> DataFrame:
    """One row for each capability that still takes hours, ranked by hours (ties in the fixed order)."""
    each = F.array(*(F.struct(F.lit(i).alias("place"), F.lit(k).alias("capability"), _level(k).alias("level"), half_up(h * F.when(_level(k) == "missing", 1.0).when(_level(k) == "developing", 0.5).otherwise(0.0)).cast("int").alias("hours")) for i, (k, _, h) in enumerate(rules.CAPABILITIES)))
    rows = profiles.select("profile_id", F.explode(F.sort_array(F.transform(F.filter(each, lambda b: b["hours"] > 0), lambda b: F.struct((-b["hours"]).alias("less"), b["place"].alias("place"), b["capability"].alias("capability"), b["level"].alias("level"))))).alias("b"))
    return rows.select("profile_id", "b.capability", "b.level", (-F.col("b.less")).alias("hours"))


PRELIM = ["p_degree", "p_major", "p_year", "p_deadline"]


def opportunity_score(pairs: DataFrame, now: str) -> DataFrame:
    """Gated pairs (with readiness) with qualification, score and hours."""
    count = lambda v, cols=PRELIM: sum((F.when(F.col(c) == v, 1).otherwise(0) for c in cols), F.lit(0))
    points = F.lit(42) + freshness(F.col("updated_at"), now) + half_up(F.col("readiness") * 0.12)
    for c in PRELIM:
        points = points + F.when(F.col(c) == "pass", 16 if c == "p_major" else 8).when(F.col(c) == "conditional", 4).when(F.col(c) == "mismatch", -32 if c == "p_deadline" else -18).otherwise(0)
    near = region_match(F.col("preferred_cities"), F.col("city"), F.col("work_location"))
    points = F.greatest(F.lit(0), F.least(F.lit(100), points + F.when(near, 8).otherwise(0))).cast("int")
    status = F.when(F.col("p_deadline") == "mismatch", "expired").when(count("mismatch") > 0, "high-risk").when(count("unknown") + count("conditional") > 0, "needs-verification").otherwise("raw-fields-aligned")
    cap = F.element_at(F.create_map(*(F.lit(x) for x in ("expired", 39, "high-risk", 59, "needs-verification", 89, "raw-fields-aligned", 100))), F.col("qualification"))
    out = pairs.withColumn("qualification", status).withColumn("score", F.least(points, cap)).withColumn("region_ok", near)
    return out.withColumn("hours", (F.col("blocker_hours") + 2 * count("unknown") + 3 * count("conditional") + 8 * count("mismatch")).cast("int"))


def portfolio(assessed: DataFrame) -> DataFrame:
    """Assessed pairs with their tier; ranks run by score (descending), then id."""
    rank = F.row_number().over(Window.partitionBy("profile_id", "qualification").orderBy(F.desc("score"), "id"))
    aligned = F.max(F.when(F.col("qualification") == "raw-fields-aligned", F.col("rank")).otherwise(0)).over(Window.partitionBy("profile_id"))
    out = assessed.withColumn("rank", rank).withColumn("aligned", aligned)
    spare = F.greatest(F.lit(0), F.lit(3) - F.greatest(F.lit(0), F.col("aligned") - 3))
    tier = (
        F.when(F.col("qualification").isin("expired", "high-risk"), "excluded")
        .when((F.col("qualification") == "raw-fields-aligned") & (F.col("rank") <= 3), "primary")
        .when((F.col("qualification") == "raw-fields-aligned") & (F.col("rank") <= 6), "steady")
        .when((F.col("qualification") == "needs-verification") & (F.col("rank") <= spare), "steady")
        .otherwise("watchlist")
    )
    return out.withColumn("tier", tier).drop("rank", "aligned")


def summary_counts(now: str) -> list[Column]:
    """The counts of D07 over tiered pairs."""
    n = lambda c: F.count_if(c)
    return [
        F.count("*").alias("candidates"), F.count_distinct("company_name").alias("companies"), F.count_distinct("work_location").alias("regions"),
        n(F.datediff(F.lit(now).cast("date"), "updated_at") <= 30).alias("recent"), n(F.col("apply_end_date").isNotNull()).alias("deadline_known"),
        n(F.col("qualification") == "raw-fields-aligned").alias("aligned"), n(F.col("tier") == "watchlist").alias("watchlist"),
        n(F.col("qualification") == "high-risk").alias("high_risk"), n(F.col("qualification") == "expired").alias("expired"),
    ]


def portfolio_summary(tiered: DataFrame, profiles: DataFrame, now: str) -> DataFrame:
    """Counts of every profile; 0 where it has no candidate."""
    counts = tiered.groupBy("profile_id").agg(*summary_counts(now))
    return profiles.select("profile_id").join(counts, "profile_id", "left").fillna(0, counts.columns[1:])


#: What decides the gates of a profile and a job of its code's pool; with what decides scores too; and what decides counts of regions.
GATED = ["code", "major", "degree_level", "graduation_year"]
KIND = [*GATED, "preferred_cities", "city", *(k for k, _, _ in rules.CAPABILITIES)]
PLACED = ["code", "preferred_cities", "city"]


def with_kind(profiles: DataFrame, columns: list[str]) -> DataFrame:
    """Profiles with the key of their kind: profiles that these columns do not tell apart."""
    return profiles.withColumn("kind", F.to_json(F.struct(*columns)))


def kinds_of(profiles: DataFrame, columns: list[str]) -> DataFrame:
    """One row a kind, with profile_id for the kind: what the operators on pairs take instead of profiles."""
    return with_kind(profiles, columns).select(F.col("kind").alias("profile_id"), *columns).distinct()


def told_to_profiles(profiles: DataFrame, answers: DataFrame, columns: list[str]) -> DataFrame:
    """The rows (profile_id: a kind, ...) of each kind for each of its profiles; a kind has few rows (a pool's), so they are one row in the join."""
    rows = [c for c in answers.columns if c != "profile_id"]
    listed = answers.groupBy(F.col("profile_id").alias("kind")).agg(F.collect_list(F.struct(*rows)).alias("rows"))
    return with_kind(profiles, columns).select("profile_id", "kind").join(listed, "kind").select("profile_id", F.inline("rows"))


def gated_kinds(profiles: DataFrame, pool: DataFrame, now: str) -> DataFrame:
    """D01 of each kind of profiles (by GATED) and each job of its code's pool."""
    return prelim_gates(kinds_of(profiles, GATED).join(pool, "code"), now)


def assessed_kinds(profiles: DataFrame, pool: DataFrame, now: str) -> DataFrame:
    """D05 of each kind of profiles (by KIND) and each job of its code's pool; the gates' patterns run once for each of GATED."""
    gates = gated_kinds(profiles, pool, now).select(*GATED, "id", "company_name", "work_location", "apply_end_date", "updated_at", *PRELIM)
    mine = readiness(kinds_of(profiles, KIND))
    same = [mine[c].eqNullSafe(gates[c]) for c in GATED]
    pairs = mine.join(gates, reduce(lambda a, b: a & b, same)).select(*(mine[c] for c in mine.columns), *(gates[c] for c in gates.columns if c not in GATED))
    return opportunity_score(pairs, now)


def dedupe_candidates(candidates: DataFrame, order: list[str]) -> DataFrame:
    """The first candidate, in a given order, of each company, title, place and deadline."""
    keys = ["company_name", "job_title", "work_location", "apply_end_date"]
    return candidates.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("place = 1").drop("place")
