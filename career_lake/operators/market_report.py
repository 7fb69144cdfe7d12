"""The whole market report of every profile, one nested row each.

Profiles share most of a report. What depends on the major, its code, the degree's word and
the graduation year alone (pools, layers, heatmaps, directions, conditions) is
made once a pool key; what depends on wishes and capabilities too (scores, tiers) once a kind
of profile; the gates' patterns run once for each degree of a pool and job. Shared steps
are written, so that no branch of the plan repeats them. Profiles meet these rows by plain
equi-joins.

A profile without candidates has a partial report with zeros and empty lists. Profiles without a major
have no keyword: no layers, no history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from career_lake import rules
from career_lake.functions.text import half_up, lookup, trimmed
from career_lake.operators import decision as D
from career_lake.operators import jobs as J
from career_lake.operators import market as P
from career_lake.operators import pools as L
from career_lake.operators import report as R
from career_lake.operators.search import texts_with
from career_lake.session import settle

#: Jobs of a pool, of a query of it, and of the history.
POOL, PER_QUERY, HISTORY = 200, 100, 300
GATED = ["pool_key", "major", "degree_level", "graduation_year"]
KIND = [*GATED, "preferred_cities", "city", *(k for k, _, _ in rules.CAPABILITIES)]
_SIGNALS = [(kind, label, p) for kind, found in rules.SIGNALS.items() for label, p in found]
TIERS = ["primary", "steady"]


def placed(jobs: DataFrame) -> DataFrame:
    """Jobs with region and category."""
    return jobs.withColumns({"region": P.region_of(F.col("work_location")), "category": P.job_category(F.col("job_title"))})


def job_facts(jobs: DataFrame) -> DataFrame:
    """Jobs with region, category and, for each rule of P08, whether its signal is seen; once a job."""
    text = F.concat_ws(" ", "job_title", "job_description")
    return placed(jobs).withColumn("signals", F.array(*(text.rlike(p) for _, _, p in _SIGNALS)))


def heatmaps(jobs: DataFrame, key: str) -> DataFrame:
    """P01 for each key: (key, heatmap of categories, rows of regions with a value per category, and the 3 best cells; regions: known ones by their counts)."""
    cells = jobs.groupBy(key, "region", "category").agg(F.count("*").alias("n"))
    total = lambda c: F.sum("n").over(Window.partitionBy(key, c))
    cells = cells.withColumns({"region_n": total("region"), "category_n": total("category")})
    rank = lambda c: F.dense_rank().over(Window.partitionBy(key).orderBy(F.desc(f"{c}_n"), c))
    cells = cells.withColumns({"region_k": rank("region"), "category_k": rank("category")})
    names = lambda c: F.transform(F.array_sort(F.collect_set(F.when(F.col(f"{c}_k") <= 5, F.struct(F.col(f"{c}_k").alias("k"), F.col(c).alias("name"))))), lambda x: x["name"])
    pair = lambda r, c: F.concat(r, F.lit("\n"), c)
    known = F.when(F.col("region") != rules.UNKNOWN_REGION, F.struct((-F.col("region_n")).alias("less"), F.col("region").alias("name")))
    out = cells.groupBy(key).agg(
        names("region").alias("r"), names("category").alias("c"), F.map_from_entries(F.collect_list(F.struct(pair(F.col("region"), F.col("category")), "n"))).alias("n"),
        F.transform(F.slice(F.array_sort(F.collect_set(known)), 1, 3), lambda x: F.struct(x["name"].alias("label"), (-x["less"]).alias("count"))).alias("regions"),
    )
    value = lambda r, c: F.coalesce(F.try_element_at("n", pair(r, c)), F.lit(0).cast("long"))
    rows = F.transform("r", lambda r: F.struct(r.alias("region"), F.transform("c", lambda c: value(r, c)).alias("values")))
    flat = F.flatten(F.transform("r", lambda r: F.transform("c", lambda c, i: F.struct((-value(r, c)).alias("less"), r.alias("region"), i.alias("place"), c.alias("category")))))
    best = F.transform(F.slice(F.array_sort(F.filter(flat, lambda x: x["less"] < 0)), 1, 3), lambda x: F.struct(x["region"].alias("region"), x["category"].alias("category"), (-x["less"]).alias("count")))
    return out.select(key, F.struct(F.col("c").alias("categories"), rows.alias("rows"), best.alias("best")).alias("heatmap"), "regions")


def conditions() -> Column:
    """The five working conditions (id, status, jobs, headline, signals) of a pool's counts."""
    status = lambda n: F.when((n <= 0) | (F.col("sample") <= 0), "unavailable").when((n >= 5) & (n / F.col("sample") >= 0.3), "available").otherwise("partial")
    labels = lambda s, most: F.array_join(F.transform(F.slice(s, 1, most), lambda x: x["label"]), "、")
    plain = lambda c: F.regexp_replace(F.col(c).cast("string"), "\\.0$", "")
    low, high, paid = F.col("salary_low"), F.col("salary_high"), F.col("paid")
    salary = (
        F.when(low.isNotNull() & high.isNotNull(), F.concat(F.lit("已标年薪中位区间 "), plain("salary_low"), F.lit("–"), plain("salary_high"), F.lit(" 万")))
        .when(low.isNotNull(), F.concat(F.lit("已标年薪下限中位数 "), plain("salary_low"), F.lit(" 万")))
        .when(high.isNotNull(), F.concat(F.lit("已标年薪上限中位数 "), plain("salary_high"), F.lit(" 万")))
        .otherwise("当前样本缺少结构化薪资")
    )
    salary = F.when(paid.between(1, 2), F.concat(F.lit("仅"), paid.cast("string"), F.lit("条样本 · "), F.regexp_replace(salary, "^已标", ""))).otherwise(salary)
    none = F.array().cast("array<struct<label:string,count:bigint>>")

    def row(name: str, n: Column, state: Column, headline: Column, signals: Column) -> Column:
        return F.struct(F.lit(name).alias("id"), state.alias("status"), n.cast("long").alias("jobs"), headline.alias("headline"), F.coalesce(signals, none).alias("signals"))

    def told(kind: str, most: int, other: str) -> Column:
        n, s = F.col(f"any_{kind}"), F.col(f"signals_{kind}")
        return row(kind, n, status(n), F.when(F.size(s) > 0, labels(s, most)).otherwise(other), s)

    cities = F.coalesce(F.col("regions"), none)
    return F.array(
        row("salary", paid, status(paid), salary, F.when(paid > 0, F.array(F.struct(F.lit("已标薪资").alias("label"), paid.alias("count")))).otherwise(none)),
        told("development", 2, "岗位正文较少披露培养路径"),
        row("city", F.col("sample"), F.when(F.size(cities) > 0, "available").otherwise("unavailable"), F.when(F.size(cities) > 0, F.concat(F.lit("岗位较多："), labels(cities, 3))).otherwise("当前样本缺少工作地点"), cities),
        told("intensity", 2, "岗位正文暂无足够工时信息"),
        told("benefit", 3, "当前样本缺少福利明细"),
    )


def pool_facts(pool: DataFrame) -> DataFrame:
    """P05 to P08 and P01 of each pool (pool_key, major, place, job_facts)."""
    mid = lambda c: (half_up(F.median(F.when(F.col(c) > 0, F.col(c))) * 10) / 10)
    kinds = list(rules.SIGNALS)
    of = {k: [i for i, (kind, _, _) in enumerate(_SIGNALS) if kind == k] for k in kinds}
    counts = pool.groupBy("pool_key").agg(
        F.count("*").alias("sample"), F.count_distinct("company_name").alias("companies"), F.count_distinct("region").alias("n_regions"),
        F.count_if(F.coalesce("source", F.lit("")).contains("官方")).alias("official"), F.count_if(F.col("apply_end_date").isNotNull()).alias("deadline_known"),
        F.count_if((F.col("salary_min") > 0) | (F.col("salary_max") > 0)).alias("paid"), mid("salary_min").alias("salary_low"), mid("salary_max").alias("salary_high"),
        *(F.count_if(F.get("signals", F.lit(i))).alias(f"s{i}") for i in range(len(_SIGNALS))),
        *(F.count_if(F.array_contains(F.slice("signals", of[k][0] + 1, len(of[k])), True)).alias(f"any_{k}") for k in kinds),
    )

    def seen(k: str) -> Column:
        found = F.array_sort(F.filter(F.array(*(F.struct((-F.col(f"s{i}")).alias("less"), F.lit(_SIGNALS[i][1]).alias("label")) for i in of[k])), lambda x: x["less"] < 0))
        return F.transform(found, lambda x: F.struct(x["label"].alias("label"), (-x["less"]).alias("count")))

    ways = P.directions(pool.withColumnRenamed("pool_key", "profile_id")).withColumnRenamed("profile_id", "pool_key")
    label = F.coalesce(F.try_element_at(lookup(rules.DIRECTION_LABELS), F.col("direction")), F.lit("*"))
    ways = ways.groupBy("pool_key").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("direction").alias("id"), label.alias("label"), "jobs", "companies", "mentions", "sample_companies", "sample_titles"))).alias("directions"))
    out = counts.withColumns({f"signals_{k}": seen(k) for k in kinds}).join(heatmaps(pool, "pool_key"), "pool_key").join(ways, "pool_key")
    return out.select("pool_key", "sample", "companies", "n_regions", "official", "deadline_known", "heatmap", "directions", conditions().alias("conditions"))


def history(jobs: DataFrame, majors: DataFrame, since: str) -> DataFrame:
    """L04 for each keyword of majors(keyword): (keyword, size, total, heatmap) of its newest jobs since a day."""
    dated = jobs.withColumns({"reference_date": F.coalesce("created_at", "apply_start_date", "updated_at"), "t": F.concat_ws(" ", "job_title", "major_requirements")}).where(F.col("reference_date") >= F.lit(since).cast("date"))
    found = texts_with(majors.select(F.col("keyword").alias("word")), dated).withColumnRenamed("word", "keyword")
    place = F.row_number().over(Window.partitionBy("keyword").orderBy(F.desc("reference_date"), "id"))
    every = settle(dated.select("t", "id", "reference_date", "job_title", "work_location").join(found, "t").drop("t"), "report-history")
    top = placed(every.withColumn("place", place).where(F.col("place") <= HISTORY))
    size = every.groupBy("keyword").agg(F.count("*").alias("total")).withColumn("size", F.least("total", F.lit(HISTORY)))
    return size.join(heatmaps(top, "keyword").select("keyword", "heatmap"), "keyword")


def kind_facts(kinds: DataFrame, pool: DataFrame, now: str) -> DataFrame:
    """D01 to D07 of each kind of profile: (kind, decision, preferred) from its pool."""
    gates = kinds.select(GATED).distinct().join(pool.select("pool_key", "place", "id", "company_name", "job_title", "work_location", "education_level", "graduate_year", "major_requirements", "major_category_ids", "apply_end_date", "updated_at"), "pool_key")
    gates = D.prelim_gates(gates, now).select(*GATED, "place", "id", "company_name", "work_location", "apply_end_date", "updated_at", *D.PRELIM)
    mine = D.readiness(kinds)
    same = [mine[c].eqNullSafe(gates[c]) for c in GATED]
    pairs = mine.join(gates, same[0] & same[1] & same[2] & same[3]).select(*(mine[c] for c in mine.columns), *(gates[c] for c in gates.columns if c not in GATED))
    tiered = D.portfolio(D.opportunity_score(pairs.withColumnRenamed("kind", "profile_id"), now))
    wanted = P.preferred_regions(F.col("preferred_cities"), F.col("city"))
    near = (F.size(wanted) == 0) | F.exists(wanted, lambda x: F.coalesce("work_location", F.lit("")).contains(x))
    chosen = F.when(F.col("tier").isin(TIERS), F.struct("tier", (-F.col("score")).alias("less"), F.col("id"), "qualification"))
    chosen = F.transform(F.array_sort(F.collect_list(chosen)), lambda x: F.struct(x["tier"].alias("tier"), x["id"].alias("id"), (-x["less"]).alias("score"), x["qualification"].alias("qualification")))
    out = tiered.groupBy("profile_id").agg(*D.summary_counts(now), F.count_if(near).alias("preferred"), chosen.alias("portfolio"))
    counts = [c for c in out.columns if c not in ("profile_id", "preferred")]
    return out.select(F.col("profile_id").alias("kind"), F.struct(*counts).alias("decision"), "preferred")


def market_report(profiles: DataFrame, jobs: DataFrame, raw: DataFrame, schools: DataFrame, now: str, since: str) -> DataFrame:
    """One row a profile.

    profiles: with school. jobs: J01. raw: the feed before J01, for the layers.
    schools: P13's records. since: the first day of the history.
    """
    keyed = L.pool_keys(profiles.withColumn("code", J.inferred_code(F.col("major")))).withColumn("kind", F.to_json(F.struct(*KIND)))
    keyed = settle(keyed.withColumn("keyword", trimmed(F.col("major"))), "report-profiles")
    keys = keyed.groupBy("pool_key").agg(*(F.min(c).alias(c) for c in ("major", "code", "degree_level", "graduation_year", "keyword")))
    asked = L.pool_queries(keys)
    lists, totals = L.pool_answers(jobs, asked, PER_QUERY)
    won = settle(L.first_wins(lists, POOL), "report-pool")
    used = job_facts(jobs.join(won.select("id").distinct(), "id", "left_semi"))
    pool = settle(won.join(used, "id").join(keys.select("pool_key", "major"), "pool_key"), "report-candidates")
    told = L.summaries(asked, totals, PER_QUERY)
    cut = L.sample_limited(won, told, POOL)
    most = told.groupBy("pool_key").agg(F.max("total").alias("most"))
    layers = J.market_layers(raw, keys.withColumn("profile_id", F.col("pool_key"))).select(F.col("profile_id").alias("pool_key"), "full_market", "state_owned", "campus_intern", "strict_profile")
    shared = keys.select("pool_key", "keyword").join(layers, "pool_key").join(pool_facts(pool), "pool_key", "left").join(most, "pool_key", "left").join(cut, "pool_key", "left")
    past = history(jobs, keys.select("keyword").distinct(), since).select("keyword", F.struct("size", (F.col("total") > F.col("size")).alias("limited"), "heatmap").alias("history"))
    shared = settle(shared.join(past, "keyword", "left").drop("keyword"), "report-shared")
    own = kind_facts(keyed.select("kind", *KIND).distinct(), pool, now)
    school = R.school_lookup(profiles, schools).select("profile_id", F.struct("status", "reason", "school_name").alias("school_record"))
    out = keyed.join(shared, "pool_key").join(own, "kind", "left").join(school, "profile_id", "left")
    zero = lambda *cs: {c: F.coalesce(c, F.lit(0).cast("long")) for c in cs}
    out = out.withColumns(zero("sample", "companies", "n_regions", "official", "deadline_known", "preferred", "most"))
    out = out.withColumns({"school_known": F.coalesce(F.col("school_record.status") == "available", F.lit(False)), "strict_total": F.col("strict_profile"), "targeted_total": F.col("sample"), "preferred_count": F.col("preferred")})
    index = P.with_index(out.withColumn("row", F.struct("*")), ["row"])
    out = index.select("row.*", F.struct("score", "band", "potential", "room", F.struct("school", "major_entry", "degree_base", "opportunity", "prepared").alias("factors")).alias("competitiveness"))
    return out.select("profile_id", *(c.alias(k) for k, c in _sections(now).items()))


def _sections(now: str) -> dict[str, Column]:
    """The sections of a report, from a profile with what it shares."""
    text = lambda c: F.col(c).cast("string")
    way = F.transform(F.coalesce("directions", F.array().cast("array<struct<rank:int,id:string,label:string,jobs:bigint,companies:bigint,mentions:bigint,sample_companies:array<string>,sample_titles:array<string>>>")), lambda d: d.withField("label", F.when(d["label"] == "*", F.concat("major", F.lit("相关岗位"))).otherwise(d["label"])))
    lead = F.coalesce(F.try_element_at(F.transform(way, lambda d: d["label"]), F.lit(1)), F.concat("major", F.lit("相关方向")))
    strict, sample = F.col("strict_profile"), F.col("sample")
    acts = R.ranked_actions()
    level = lambda a: F.when(a["capability"].isin("verification", "target_research"), "待处理").otherwise(F.element_at(lookup({k: t for k, t, _ in rules.LEVEL_TEXTS}), F.coalesce(*(F.when(a["capability"] == k, F.coalesce(F.col(k), F.lit("missing"))) for k in rules.MATRIX_ROWS))))
    judged = R.judged(now)
    autumn = judged["autumn_year"].cast("string")
    stone = lambda period, title, detail, status: F.struct(period.alias("period"), F.lit(title).alias("title"), detail.alias("detail"), F.lit(status).alias("status"))
    empty = F.struct(F.array().cast("array<string>").alias("categories"), F.array().cast("array<struct<region:string,values:array<bigint>>>").alias("rows"), F.array().cast("array<struct<region:string,category:string,count:bigint>>").alias("best"))
    past = F.struct(F.lit(0).cast("long").alias("size"), F.lit(False).alias("limited"), empty.alias("heatmap"))
    return {
        "status": F.when(sample > 0, "live").otherwise("partial"),
        "conclusion": F.when(strict >= 50, "央国企机会较多").when(strict > 0, "已有可关注岗位").when(sample > 0, "有岗位，条件待核验").otherwise("暂无足够岗位"),
        "source": F.struct(F.concat("major", F.lit("专业分类及审核相邻方向")).alias("query_label"), sample.alias("sample_size"), F.lit(POOL).alias("sample_limit"), F.coalesce("sample_limited", F.lit(False)).alias("sample_limited")),
        "qualification_matrix": R.matrix_items(),
        "school": F.col("school_record"),
        "competitiveness": F.col("competitiveness"),
        "assessment": F.struct(*(c.alias(k) for k, c in judged.items() if k != "autumn_year")),
        "conditions": F.coalesce("conditions", F.array().cast("array<struct<id:string,status:string,jobs:bigint,headline:string,signals:array<struct<label:string,count:bigint>>>>")),
        "market_layers": F.struct("full_market", "state_owned", "campus_intern", sample.alias("personalised"), "strict_profile"),
        "directions": way,
        "metrics": F.struct(sample.alias("relevant"), F.greatest("campus_intern", "most").alias("broad"), sample.alias("sample"), "companies", F.col("n_regions").alias("regions"), "official", "deadline_known", F.col("preferred").alias("preferred_region"), sample.alias("pending")),
        "heatmap": F.coalesce("heatmap", empty),
        "history": F.coalesce("history", past),
        "milestones": F.array(
            stone(F.lit("现在"), "确认方向", F.concat(F.lit("先定主方向，再选3家企业和5个"), text("graduation_year"), F.lit("届岗位")), "current"),
            stone(F.concat(autumn, F.lit(".03–06")), "补强经历", F.lit("形成一段实习或项目成果"), "upcoming"),
            stone(F.concat(autumn, F.lit(".07–08")), "完成材料", F.lit("定稿简历、网申材料和证明文件"), "upcoming"),
            stone(F.concat(autumn, F.lit(".09起")), "进入投递", F.lit("按企业批次跟进网申、笔试和面试"), "upcoming"),
        ),
        "priority_steps": F.array(
            F.concat(F.lit("优先确认"), lead, F.lit("是否为主方向")),
            F.concat(F.lit("其次"), F.coalesce(F.try_element_at(F.transform(acts, lambda a: a["title"]), F.lit(1)), F.lit("核对目标企业招聘条件"))),
            F.concat(F.lit("再从"), F.when(strict > 0, strict).otherwise(sample).cast("string"), F.lit("个资料字段匹配中选择目标岗位")),
        ),
        "levers": F.transform(acts, lambda a: F.struct(F.regexp_replace(a["title"], "^(完成|开始|补充|整理|准备)", "").alias("label"), level(a).alias("status"), a["hours"].alias("hours"), a["priority"].alias("priority"))),
        "actions": F.transform(acts, lambda a: F.struct(*(a[c].alias(c) for c in ("capability", "title", "priority", "hours")))),
        "decision": F.col("decision"),
        "caveats": F.array(
            F.concat(F.lit("主站实时查询：相关岗位"), text("full_market"), F.lit("个，央国企"), text("state_owned"), F.lit("个，校招或实习"), text("campus_intern"), F.lit("个。")),
            F.concat(F.lit("决策候选已按岗位和企业去重，共"), sample.cast("string"), F.lit("个。")),
            F.concat(F.lit("报告日期"), F.lit(now), F.lit("，最终条件以企业公告为准。")),
        ),
    }
