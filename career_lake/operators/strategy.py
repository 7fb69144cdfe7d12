"""Strategy: capability gaps, shared and target tasks, weekly plan and cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from career_lake import rules

_LEVELS = {"missing": 0, "developing": 1, "ready": 2}
_RANK = {"high": 0, "medium": 1, "low": 2}


def _map(d: dict):  # noqa: ANN202
    return F.create_map(*(F.lit(x) for kv in d.items() for x in kv))


def capability_gaps(profiles: DataFrame, targets: DataFrame) -> DataFrame:
    """(profile_id, job_id, capability, shareable, priority) where a target asks for more than the profile has.

    targets: (profile_id, job_id, company, title).
    """
    level = lambda k: F.coalesce(F.col(k), F.lit("missing"))
    needs = F.array(*(F.struct(F.lit(k).alias("capability"), F.lit(sh).alias("shareable"), F.lit(pr).alias("priority"), level(k).alias("level")) for k, sh, pr in rules.TARGET_NEEDS))
    rows = targets.join(profiles, "profile_id").select("profile_id", "job_id", F.explode(needs).alias("n")).select("profile_id", "job_id", "n.*")
    return rows.where(F.element_at(_map(_LEVELS), F.col("level")) < 2)


def shared_tasks(gaps: DataFrame) -> DataFrame:
    """One task for each shareable gap of two or more of a profile's targets, with the highest priority."""
    g = gaps.where("shareable").groupBy("profile_id", "capability").agg(F.count_distinct("job_id").alias("jobs"), F.array_sort(F.collect_set("job_id")).alias("job_ids"), F.min_by("priority", F.element_at(_map(_RANK), F.col("priority"))).alias("priority"))
    return g.where("jobs >= 2").select("profile_id", F.concat(F.lit("task:shared:"), "capability").alias("task_id"), "capability", F.lit("shared").alias("scope"), "job_ids", "priority")


def target_tasks(gaps: DataFrame, targets: DataFrame, shared: DataFrame) -> DataFrame:
    """Per target an eligibility and a research task and its gaps that aren't shared; per profile a weekly review."""
    task = lambda part, capability, priority: (F.concat(F.lit("task:"), "job_id", F.lit(f":{part}")).alias("task_id"), F.lit(capability).cast("string").alias("capability"), F.lit("target").alias("scope"), F.array("job_id").alias("job_ids"), F.lit(priority).alias("priority"))
    each = targets.select("profile_id", "job_id").distinct()
    own = gaps.join(shared.select("profile_id", "capability").withColumn("shareable", F.lit(True)), ["profile_id", "capability", "shareable"], "left_anti")
    own = own.select("profile_id", F.concat(F.lit("task:"), "job_id", F.lit(":"), "capability").alias("task_id"), "capability", F.lit("target").alias("scope"), F.array("job_id").alias("job_ids"), "priority")
    review = each.groupBy("profile_id").agg(F.array_sort(F.collect_set("job_id")).alias("job_ids")).select("profile_id", F.lit("task:shared:weekly-review").alias("task_id"), F.lit(None).cast("string").alias("capability"), F.lit("shared").alias("scope"), "job_ids", F.lit("medium").alias("priority"))
    return each.select("profile_id", *task("eligibility", None, "high")).union(each.select("profile_id", *task("research", "target_research", "high"))).union(own).union(review)


def with_schedule(tasks: DataFrame) -> DataFrame:
    """Tasks with their day (1 to 7) and minutes."""
    day = F.when(F.col("task_id").endswith(":eligibility"), 1).when(F.col("task_id") == "task:shared:weekly-review", 7).otherwise(F.element_at(_map(rules.TASK_DAYS), F.col("capability")))
    minutes = F.when(F.col("capability").isNull(), 45).otherwise(F.element_at(_map(rules.TASK_MINUTES), F.col("capability")))
    return tasks.withColumn("day", day).withColumn("minutes", minutes)


def seven_day_plan(tasks: DataFrame, start: str) -> DataFrame:
    """Per profile and day its date and its tasks (none: an empty list)."""
    days = tasks.select("profile_id").distinct().select("profile_id", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("day"))
    found = tasks.groupBy("profile_id", "day").agg(F.array_sort(F.collect_list("task_id")).alias("task_ids"))
    return days.join(found, ["profile_id", "day"], "left").select("profile_id", "day", F.date_add(F.lit(start).cast("date"), F.col("day") - 1).alias("date"), F.coalesce("task_ids", F.array().cast("array<string>")).alias("task_ids"))


def cost_summary(tasks: DataFrame, profiles: DataFrame) -> DataFrame:
    """Minutes, capacity, utilisation, overflow and task counts per profile; capacity is null where hours are unknown."""
    t = tasks.groupBy("profile_id").agg(F.sum("minutes").alias("minutes"), F.count_if(F.col("capability").isNotNull()).alias("gaps"), F.count_if(F.col("scope") == "target").alias("target_tasks"))
    capacity = F.when(F.col("weekly_hours").isNotNull(), F.greatest(F.lit(1), F.least(F.lit(80), F.col("weekly_hours"))) * 60)
    out = t.join(profiles.select("profile_id", capacity.alias("capacity")), "profile_id")
    return out.withColumn("utilisation", F.floor(F.col("minutes") / F.col("capacity") * 100 + 0.5)).withColumn("overflow", F.coalesce(F.greatest(F.lit(0), F.col("minutes") - F.col("capacity")), F.lit(0)))


def product_triggers(tasks: DataFrame, products: DataFrame, entitlements: DataFrame, applicable: DataFrame) -> DataFrame:
    """Per profile and category the entitlement, else an owned product, else an offer if a current target is touched.

    products: (profile_id, product_id, category, owned); entitlements:
    (profile_id, code, category); applicable: (profile_id, job_id).
    """
    t = tasks.where(F.col("capability").isin("resume", "application", "interview"))
    need = t.groupBy("profile_id", F.col("capability").alias("category")).agg(F.count("*").alias("tasks"))
    touched = t.select("profile_id", F.col("capability").alias("category"), F.explode("job_ids").alias("job_id")).join(applicable, ["profile_id", "job_id"], "left_semi").select("profile_id", "category").distinct().withColumn("current", F.lit(True))
    options = entitlements.select("profile_id", "category", F.lit(0).alias("kind"), F.concat(F.lit("entitlement:"), "code").alias("product_id")).union(products.select("profile_id", "category", F.when(F.col("owned"), 1).otherwise(2).alias("kind"), "product_id"))
    rank = F.row_number().over(Window.partitionBy("profile_id", "category").orderBy("kind", "product_id"))
    best = options.withColumn("k", rank).where("k = 1").drop("k")
    out = need.join(best, ["profile_id", "category"]).join(touched, ["profile_id", "category"], "left").where("kind < 2 or current")
    return out.select("profile_id", "category", "product_id", "tasks", F.when(F.col("kind") < 2, "owned_available").otherwise("optional_offer").alias("status"))


def route_lanes(candidates: DataFrame, lanes: int = 3, events: int = 4) -> DataFrame:
    """The first companies (the selected one first, then by name) of each profile and up to 4 dated or pending events.

    candidates: (profile_id, company, job_id, date, selected).
    """
    head = F.max(F.col("selected").cast("int")).over(Window.partitionBy("profile_id", "company"))
    c = candidates.withColumn("head", head)
    lane = F.dense_rank().over(Window.partitionBy("profile_id").orderBy(F.desc("head"), "company"))
    place = F.row_number().over(Window.partitionBy("profile_id", "company").orderBy(F.asc_nulls_last("date"), "job_id"))
    return c.withColumn("lane", lane).withColumn("place", place).where((F.col("lane") <= lanes) & (F.col("place") <= events)).select("profile_id", "company", "job_id", "lane", "place", F.when(F.col("date").isNull(), "pending").otherwise("dated").alias("kind"))


#: Candidates of a profile that a route takes.
MOST_CANDIDATES = 24


def first_candidates(candidates: DataFrame, most: int = MOST_CANDIDATES) -> DataFrame:
    """The first candidates of each profile (the selected one, then by place), each id and each opening (company, title, location, deadline) once.

    candidates: (profile_id, id, company, title, location, date, selected, place).
    A posting is dropped if an earlier one has its id, or if an earlier one of those that are
    left has its opening.
    """
    order = [F.desc(F.coalesce("selected", F.lit(False))), F.asc("place"), F.asc("id")]
    plain = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    once = lambda df, *by: df.withColumn("k", F.row_number().over(Window.partitionBy("profile_id", *by).orderBy(*order))).where("k = 1").drop("k")
    c = once(once(candidates, "id"), *(plain(x) for x in ("company", "title", "location", "date")))
    return c.withColumn("k", F.row_number().over(Window.partitionBy("profile_id").orderBy(*order))).where(F.col("k") <= most).drop("k")


def planned_lanes(candidates: DataFrame, today: str, horizon: str) -> DataFrame:
    """route_lanes of first_candidates, with each event's place between today and the horizon in percent (4 to 94; 88 where it has no date)."""
    c = first_candidates(candidates).withColumn("company", F.coalesce(F.nullif(F.trim("company"), F.lit("")), F.lit("企业名称待核验")))
    lanes = route_lanes(c.select("profile_id", "company", F.col("id").alias("job_id"), "date", "selected"))
    span = F.greatest(F.lit(1), F.datediff(F.lit(horizon).cast("date"), F.lit(today).cast("date")))
    at = F.greatest(F.lit(4.0), F.least(F.lit(94.0), F.datediff(F.col("date"), F.lit(today).cast("date")) / span * 100))
    dates = c.select("profile_id", F.col("id").alias("job_id"), "date")
    return lanes.join(dates, ["profile_id", "job_id"]).withColumn("position", F.when(F.col("date").isNull(), 88.0).otherwise(F.round(at, 6))).drop("date")
