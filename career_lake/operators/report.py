"""Parts of a profile's market report, and its route through the year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from career_lake import rules
from career_lake.operators.market import preferred_regions
from career_lake.operators.search import texts_with
from career_lake.session import settle

MISSING = "待补充"


def _level(key: str) -> Column:
    return F.coalesce(F.col(key), F.lit("missing"))


def _text_of_level(level: Column, i: int) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for row in rules.LEVEL_TEXTS for x in (row[0], row[i]))), level)


def _filled(c: str) -> Column:
    return F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))


def matrix_items() -> Column:
    """The items (item, value, status) of P10: five facts and six capabilities."""
    degree = F.element_at(F.create_map(*(F.lit(x) for kv in rules.DEGREE_TEXTS.items() for x in kv)), F.col("degree_level"))
    place = F.coalesce(_filled("preferred_cities"), _filled("city"))
    known = lambda c: F.when(c, "known").otherwise("missing")
    row = lambda item, value, status: F.struct(F.lit(item).alias("item"), value.alias("value"), status.alias("status"))
    return F.array(
        row("school", F.coalesce(_filled("school"), F.lit(MISSING)), known(_filled("school").isNotNull())),
        row("degree", degree, known(F.col("degree_level") != "unknown")),
        row("major", F.coalesce(F.nullif("major", F.lit("")), F.lit(MISSING)), known(F.coalesce(F.col("major"), F.lit("")) != "")),
        row("graduation-year", F.concat(F.col("graduation_year").cast("string"), F.lit(" 届")), F.lit("known")),
        row("location", F.coalesce(place, F.lit(MISSING)), known(place.isNotNull() & (place != MISSING))),
        *(row(k, _text_of_level(_level(k), 1), _level(k)) for k in rules.MATRIX_ROWS),
    )


def qualification_matrix(profiles: DataFrame) -> DataFrame:
    """P10: (profile_id, place, item, value, status)."""
    return profiles.select("profile_id", F.posexplode(matrix_items()).alias("place", "r")).select("profile_id", "place", "r.*")


def ranked_actions(most: int = 3) -> Column:
    """The actions of P11 (rank, order, capability, title, priority, hours): what is missing before what is begun, in order; filled up from two fallbacks."""
    rank = lambda level: F.when(level == "missing", 0).when(level == "developing", 1).otherwise(2)
    acts = [
        F.struct(rank(_level(k)).alias("rank"), F.lit(i).alias("order"), F.lit(k).alias("capability"), F.lit(title).alias("title"), _text_of_level(_level(k), 2).alias("priority"), F.lit(hours).alias("hours"))
        for i, (k, title, hours) in enumerate(rules.REPORT_ACTIONS)
    ]
    more = [F.struct(F.lit(3).alias("rank"), F.lit(i).alias("order"), F.lit(k).alias("capability"), F.lit(title).alias("title"), F.lit(p).alias("priority"), F.lit(hours).alias("hours")) for i, (k, title, hours, p) in enumerate(rules.FALLBACK_ACTIONS)]
    return F.slice(F.array_sort(F.filter(F.array(*acts, *more), lambda a: a["rank"] != 2)), 1, most)


def action_ranking(profiles: DataFrame, most: int = 3) -> DataFrame:
    """The first actions of each profile."""
    return profiles.select("profile_id", F.posexplode(ranked_actions(most)).alias("place", "a")).select("profile_id", (F.col("place") + 1).alias("place"), "a.capability", "a.title", "a.priority", "a.hours")


def judged(now: str) -> dict[str, Column]:
    """The columns of P12, from school, school_known, strict_total, targeted_total and preferred_count (jobs in the preferred regions)."""
    year = F.year(F.lit(now).cast("date"))
    strict = F.col("strict_total") > 0
    strengths = F.array_compact(F.array(F.when(F.col("school_known"), "school"), F.when(strict, "entry"), F.when(F.col("graduation_year") > year, "window")))
    strengths = F.when(F.size(strengths) > 0, strengths).otherwise(F.array(F.lit("basics")))
    gaps = F.slice(F.filter(F.array(*(F.when(_level(k) != "ready", F.concat(F.lit("gap:"), F.lit(k))) for k in rules.MATRIX_ROWS)), lambda x: x.isNotNull()), 1, 2)
    wants = F.size(preferred_regions(F.col("preferred_cities"), F.col("city"))) > 0
    constraints = F.concat(
        F.array_compact(F.array(F.when(~F.col("school_known") & _filled("school").isNotNull(), "school"), F.when(~strict & (F.col("targeted_total") > 0), "unverified"))),
        gaps, F.array_compact(F.array(F.when(wants & (F.col("preferred_count") == 0), "city"))),
    )
    constraints = F.when(F.size(constraints) > 0, constraints).otherwise(F.array(F.lit("no_direction")))
    return {
        "strengths": F.slice(strengths, 1, 3), "n_strengths": F.size(strengths), "constraints": F.slice(constraints, 1, 3), "n_constraints": F.size(constraints),
        "autumn_year": F.greatest(year, F.col("graduation_year") - 1),
    }


def assessment(profiles: DataFrame, now: str) -> DataFrame:
    """Strengths and constraints of each profile, at most three of either, with their numbers before that, and the year of its autumn season."""
    return profiles.select("profile_id", *(c.alias(k) for k, c in judged(now).items()))


def plain_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), "(?U)[（）()·\\s]", "")


def school_lookup(profiles: DataFrame, schools: DataFrame) -> DataFrame:
    """(profile_id, status, reason, school_name) by the school's name or alias, then the major's.

    schools: (school_name, aliases, major_name, major_aliases). Of several
    records of a name the first by school and major counts.
    """
    names = lambda name, more: F.array_distinct(F.transform(F.array_append(F.coalesce(F.col(more), F.array().cast("array<string>")), F.col(name)), plain_name))
    s = schools.select("school_name", names("major_name", "major_aliases").alias("majors"), F.explode(names("school_name", "aliases")).alias("key"), "major_name")
    s = s.groupBy("key").agg(F.min(F.struct("school_name", "major_name", "majors")).alias("s"))
    p = profiles.select("profile_id", F.trim(F.coalesce("school", F.lit(""))).alias("own"), plain_name(F.col("school")).alias("key"), plain_name(F.col("major")).alias("m")).join(s, "key", "left")
    reason = F.when(F.col("own") == "", "no_school").when(F.col("s").isNull(), "school_unknown").when(~F.array_contains("s.majors", F.col("m")), "major_unknown")
    return p.select("profile_id", F.when(reason.isNull(), "available").otherwise("unavailable").alias("status"), reason.alias("reason"), F.when(F.col("own") == "", "").otherwise(F.coalesce("s.school_name", "own")).alias("school_name"))


def decision_layers(paths: DataFrame, candidates: DataFrame) -> DataFrame:
    """Status codes of the data, route and decision layer of each path, with its counts.

    paths: (path_id, live, report_live, selected_id). candidates: (path_id, id,
    company_name, apply_end_date), the selected one among them.
    """
    n = candidates.dropDuplicates(["path_id", "id"]).groupBy("path_id").agg(F.count("*").alias("n"), F.count_distinct(F.nullif(F.trim("company_name"), F.lit(""))).alias("companies"), F.count("apply_end_date").alias("deadlines"))
    p = paths.join(n, "path_id", "left").fillna(0, ["n", "companies", "deadlines"])
    live = F.col("live") & (F.col("n") > 0)
    data = F.when(live & F.col("report_live"), "live").when(live, "partial").otherwise("pending")
    decision = F.when(F.col("selected_id").isNotNull() | live, "prepare-and-verify").otherwise("structure-only")
    return p.select("path_id", data.alias("data"), F.when(live, "ready").otherwise("provisional").alias("route"), decision.alias("decision"), "n", "companies", "deadlines")


def season(c: Column) -> Column:
    """Year and season; the winter is that of the calendar year."""
    m = F.month(c)
    name = F.when(m.between(3, 5), "春").when(m.between(6, 8), "夏").when(m.between(9, 11), "秋").otherwise("冬")
    return F.when(c.isNotNull(), F.concat(F.year(c).cast("string"), F.lit(" "), name))


def season_chapters(events: DataFrame) -> DataFrame:
    """events(profile_id, event_id, date, place) with their chapter: 1 for the season of the earliest date, else 2; halves where nothing is dated."""
    every = Window.partitionBy("profile_id")
    first = season(F.min("date").over(every))
    half = F.greatest(F.lit(1), F.ceil(F.count("*").over(every) / 2))
    place = F.row_number().over(every.orderBy("place", "event_id"))
    early = F.when(F.col("first").isNotNull(), F.coalesce(season(F.col("date")) == F.col("first"), F.lit(False))).otherwise(F.col("k") <= F.col("half"))
    return events.withColumns({"first": first, "half": half, "k": place}).select("profile_id", "event_id", "date", F.col("first").alias("season"), F.when(early, 1).otherwise(2).alias("chapter"))


def relevant_pool(jobs: DataFrame, profiles: DataFrame, now: str, most: int = 50) -> tuple[DataFrame, DataFrame]:
    """Totals (profile_id, relevant, broad) and the first `most` relevant jobs by deadline of each profile.

    profiles: (profile_id, degree_text, graduation_year, keywords: 12 at most).
    Broad: state-owned, campus or intern, not over, with the degree and the
    year or no limit ("*"), so that jobs and profiles meet by equal keys; words
    find titles by their rarest gram. Jobs of the same degrees, years and found
    words are one group, profiles of the same degree, year and words one kind:
    only kinds meet groups, by a group's count and its first `most` jobs.
    """
    j = jobs.where(F.col("company_type").isin("央企", "国企") & F.col("job_type").isin("校招", "实习") & (F.col("apply_end_date").isNull() | (F.col("apply_end_date") >= F.lit(now).cast("date"))))
    named = lambda c, p: F.when((F.coalesce(F.col(c), F.lit("")) == "") | F.col(c).contains("不限"), F.array(F.lit("*"))).otherwise(F.array_sort(F.array_distinct(F.regexp_extract_all(F.col(c), F.lit(p), F.lit(0)))))
    j = j.select("id", "apply_end_date", F.lower(F.concat_ws(" ", "job_title", "major_requirements")).alias("t"), named("education_level", rules.NAMED_DEGREES).alias("degrees"), named("graduate_year", "20\\d{2}").alias("years"))
    words = F.array_sort(F.filter(F.slice(F.array_distinct(F.transform("keywords", F.lower)), 1, 12), lambda w: w != ""))
    p = profiles.select("profile_id", "degree_text", F.col("graduation_year").cast("string").alias("year"), words.alias("words")).withColumn("kind", F.to_json(F.struct("degree_text", "year", "words")))
    kinds = p.drop("profile_id").distinct()
    terms = texts_with(kinds.select(F.explode("words").alias("word")), j).groupBy("t").agg(F.array_sort(F.collect_set("word")).alias("terms"))
    group = ["degrees", "years", "terms"]
    grouped = j.join(terms, "t", "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))
    grouped = settle(grouped.select("id", "apply_end_date", *group, F.to_json(F.struct(*group)).alias("group")), "report-relevant")
    keyed = grouped.groupBy("group", *group).agg(F.count("*").alias("n")).withColumn("degree", F.explode("degrees")).withColumn("year", F.explode("years")).drop("degrees", "years")
    mine = kinds.select("kind", F.explode(F.array("degree_text", F.lit("*"))).alias("degree"), "year", "words").withColumn("year", F.explode(F.array("year", F.lit("*"))))
    broad = mine.join(keyed.groupBy("degree", "year").agg(F.sum("n").alias("n")), ["degree", "year"]).groupBy("kind").agg(F.sum("n").alias("broad"))
    meets = mine.withColumn("term", F.explode("words")).join(keyed.withColumn("term", F.explode("terms")), ["degree", "year", "term"]).select("kind", "group", "n").distinct()
    place = lambda by: F.row_number().over(Window.partitionBy(by).orderBy(F.asc_nulls_last("apply_end_date"), "id"))
    first = grouped.select("group", "id", "apply_end_date").withColumn("place", place("group")).where(F.col("place") <= most).drop("place")
    kept = meets.join(first, "group").select("kind", "id", "apply_end_date").withColumn("place", place("kind")).where(F.col("place") <= most)
    kept = kept.groupBy("kind").agg(F.collect_list(F.struct("id", "apply_end_date", "place")).alias("kept"))  # at most `most`
    totals = p.select("profile_id", "kind").join(broad, "kind", "left").join(meets.groupBy("kind").agg(F.sum("n").alias("relevant")), "kind", "left")
    totals = totals.select("profile_id", F.coalesce("relevant", F.lit(0)).alias("relevant"), F.coalesce("broad", F.lit(0)).alias("broad"))
    return totals, p.select("profile_id", "kind").join(kept, "kind").select("profile_id", F.inline("kept"))
