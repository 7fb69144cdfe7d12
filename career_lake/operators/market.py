"""Market report aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from career_lake import rules
from career_lake.functions.text import first_rule, half_up, squeezed, trimmed


def job_category(title: Column) -> Column:
    """The first category whose words a title has."""
    return first_rule(title, rules.CATEGORIES, F.lit(rules.OTHER_CATEGORY))


def region_of(place: Column) -> Column:
    """Municipality, province, city or the first 8 characters of the first place."""
    first = trimmed(F.element_at(F.split(trimmed(place), "[,，/、;；]|\\s{2,}"), 1))
    town = first_rule(first, [(t, f"{t}市") for t in ("北京", "上海", "天津", "重庆")], F.lit(None).cast("string"))
    part = lambda p: F.nullif(F.regexp_extract(first, p, 1), F.lit(""))
    found = F.coalesce(town, part("^(.{2,4}?)(?:省|自治区|特别行政区)"), part("^(.{2,4}?)(?:市)"), F.nullif(F.substring(first, 1, 8), F.lit("")))
    return F.when(place.isNull() | (trimmed(place) == ""), rules.UNKNOWN_REGION).otherwise(F.coalesce(found, F.lit(rules.UNKNOWN_REGION)))


def heatmap(jobs: DataFrame) -> DataFrame:
    """Counts of the 5 largest regions by the 5 largest categories, zero-filled; best: rank among the 3 best cells.

    Everything after the first aggregation works on (regions x categories)
    counts; the grid of 25 is what is broadcast.
    """
    cells = jobs.groupBy(region_of(F.col("work_location")).alias("region"), job_category(F.col("job_title")).alias("category")).agg(F.count("*").alias("n"))
    top = lambda c: cells.groupBy(c).agg(F.sum("n").alias(f"{c}_total")).orderBy(F.desc(f"{c}_total"), c).limit(5)
    grid = top("region").join(F.broadcast(top("category"))).select("region", "category", F.lit(0).cast("long").alias("n"))  # 5 x 5
    out = grid.union(cells.join(F.broadcast(grid.drop("n")), ["region", "category"])).groupBy("region", "category").agg(F.max("n").alias("n"))
    best = F.row_number().over(Window.orderBy(F.desc("n"), "region", "category"))
    return out.withColumn("best", F.when((F.col("n") > 0) & (best <= 3), best)).select("region", "category", "n", "best")


def sectors_of(jobs: DataFrame) -> DataFrame:
    """One row per job and sector; a job without a sector is of the other one."""
    text = F.concat_ws(" ", "company_name", "job_title", "company_type", "source")
    found = F.array_compact(F.array(*(F.when(text.rlike(p), s) for s, p in rules.SECTORS)))
    return jobs.withColumn("sector", F.explode(F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(rules.OTHER_SECTOR)))))


def direction_set(major: Column) -> Column:
    return first_rule(major, rules.DIRECTION_SETS, F.lit("general"))


def directions(pairs: DataFrame) -> DataFrame:
    """The 3 largest directions per profile of pairs (profile_id, major, job columns, place: the job's order)."""
    of = None
    for name, found in rules.DIRECTIONS.items():
        label = first_rule(F.col("job_title"), found, F.lit("other-related"))
        of = F.when(direction_set(F.col("major")) == name, label) if of is None else of.when(direction_set(F.col("major")) == name, label)
    mention = squeezed(F.coalesce("major_requirements", F.lit(""))).contains(squeezed(F.col("major")))
    pairs = pairs.withColumn("direction", of)
    first = lambda c: F.slice(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("place", c))), lambda x: x[c])), 1, 3)
    out = pairs.groupBy("profile_id", "direction").agg(F.count("*").alias("jobs"), F.count_distinct("company_name").alias("companies"), F.count_if(mention).alias("mentions"), first("company_name").alias("sample_companies"), first("job_title").alias("sample_titles"))
    rank = F.row_number().over(Window.partitionBy("profile_id").orderBy(F.desc("jobs"), F.desc("mentions"), "direction"))
    return out.withColumn("rank", rank).where("rank <= 3")


def preferred_regions(preferred: Column, city: Column) -> Column:
    text = F.coalesce(F.nullif(trimmed(preferred), F.lit("")), trimmed(city), F.lit(""))
    names = F.filter(F.transform(F.split(text, "[,，/、;；\\s]+"), lambda x: trimmed(F.regexp_replace(x, "(?:省|市)$", ""))), lambda x: x != "")
    return F.when((text == "") | text.rlike("全国|不限"), F.array().cast("array<string>")).otherwise(names)


def market_metrics(pairs: DataFrame) -> DataFrame:
    """Sample, companies, regions, official, deadline-known and preferred-region counts per profile."""
    wanted = preferred_regions(F.col("preferred_cities"), F.col("city"))
    near = (F.size(wanted) == 0) | F.exists(wanted, lambda x: F.coalesce("work_location", F.lit("")).contains(x))
    return pairs.groupBy("profile_id").agg(
        F.count("*").alias("sample"), F.count_distinct("company_name").alias("companies"), F.count_distinct(region_of(F.col("work_location"))).alias("regions"),
        F.count_if(F.coalesce("source", F.lit("")).contains("官方")).alias("official"), F.count_if(F.col("apply_end_date").isNotNull()).alias("deadline_known"), F.count_if(near).alias("preferred_region"),
    )


def salary_bands(jobs: DataFrame, by: str) -> DataFrame:
    """Exact medians of the positive salary ends, to one decimal."""
    mid = lambda c: half_up(F.median(F.when(F.col(c) > 0, F.col(c))) * 10) / 10
    return jobs.groupBy(by).agg(mid("salary_min").alias("median_min"), mid("salary_max").alias("median_max"))


def signal_counts(jobs: DataFrame) -> DataFrame:
    """Per kind of signal, jobs with each signal and with any, and the status of the evidence; one pass over jobs."""
    text = F.concat_ws(" ", "job_title", "job_description")
    found = [(kind, label, p) for kind, rs in rules.SIGNALS.items() for label, p in rs]
    hits = jobs.select(text.alias("t")).agg(
        F.count("*").alias("total"),
        *(F.count_if(F.col("t").rlike(p)).alias(f"s{i}") for i, (_, _, p) in enumerate(found)),
        *(F.count_if(F.col("t").rlike("|".join(p for _, p in rs))).alias(f"any_{kind}") for kind, rs in rules.SIGNALS.items()),
    )
    rows = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(label).alias("signal"), F.col(f"s{i}").alias("jobs"), F.col(f"any_{k}").alias("any_jobs"), F.col("total").alias("total")) for i, (k, label, _) in enumerate(found)))
    out = hits.select(F.explode(rows).alias("r")).select("r.*")
    return out.withColumn("status", F.when((F.col("any_jobs") <= 0) | (F.col("total") <= 0), "unavailable").when((F.col("any_jobs") >= 5) & (F.col("any_jobs") / F.col("total") >= 0.3), "available").otherwise("partial"))


def competitiveness(profiles: DataFrame, layers: DataFrame, companies: DataFrame) -> DataFrame:
    """The weighted market index of each profile (with readiness keys), its band, potential and room.

    layers: L01. companies: (profile_id, companies). School records do not take
    part here; a caller that has them adds their points to the factors.
    """
    out = profiles.join(layers.select("profile_id", "campus_intern", "strict_profile"), "profile_id").join(companies, "profile_id", "left")
    return with_index(out, ["profile_id"])


def with_index(rows: DataFrame, keep: list[str]) -> DataFrame:
    """P09 of profiles with campus_intern, strict_profile and companies: the columns to keep, factors, score, potential, band and room."""
    clamp = lambda c: F.greatest(F.lit(0), F.least(F.lit(100), half_up(c)))
    tier = F.coalesce(F.col("school_tier"), F.lit(""))
    school = F.when(tier.rlike("985|211"), 90).when(tier.rlike("双一流"), 84).when(tier.rlike("海外"), 70).when(tier.rlike("高职|专科"), 48).when(tier != "", 62).otherwise(50)
    strict, market, n = F.col("strict_profile"), F.col("campus_intern"), F.coalesce("companies", F.lit(0))
    major = clamp(F.when(strict > 0, 55 + F.least(F.lit(35.0), F.when(market > 0, strict / market).otherwise(0.0) * 280)).when(market > 0, 38.0).otherwise(30.0))
    degree = F.element_at(F.create_map(*(F.lit(x) for kv in rules.DEGREE_SCORE.items() for x in kv)), F.col("degree_level"))
    volume = F.least(F.lit(95.0), 35 + F.log2(strict + 1.0) * 8.5) * 0.72 + F.least(F.lit(95.0), 32 + F.log2(F.greatest(F.lit(1), n) + 1.0) * 10) * 0.28
    opportunity = F.when(strict <= 0, 25).otherwise(clamp(volume))
    ready = F.create_map(*(F.lit(x) for kv in rules.READINESS_SCORE.items() for x in kv))
    prepared = clamp(F.round(sum((F.element_at(ready, F.coalesce(F.col(k), F.lit("missing"))) for k, _, _ in rules.CAPABILITIES), F.lit(0)) / 6, 6))
    out = rows.select(*keep, *(c.cast("int").alias(k) for k, c in (("school", school), ("major_entry", major), ("degree_base", degree), ("opportunity", opportunity), ("prepared", prepared))))
    weighted = F.round(F.col("school") * 0.25 + F.col("major_entry") * 0.25 + F.col("degree_base") * 0.15 + F.col("opportunity") * 0.2 + F.col("prepared") * 0.15, 6)
    out = out.withColumn("score", clamp(weighted).cast("int")).withColumn("potential", clamp(F.round(weighted + (92 - F.col("prepared")) * 0.15, 6)).cast("int"))
    band = F.when(F.col("score") >= 80, "strong").when(F.col("score") >= 70, "fairly-strong").when(F.col("score") >= 55, "medium").when(F.col("score") >= 40, "fairly-weak").otherwise("weak")
    return out.withColumn("band", band).withColumn("room", F.greatest(F.lit(0), F.col("potential") - F.col("score")))
