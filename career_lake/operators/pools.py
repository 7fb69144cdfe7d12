"""Candidate pools: ordered queries with first-wins deduplication."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from career_lake.functions.text import lookup, squeezed
from career_lake.operators.jobs import expanded_keywords
from career_lake.operators.search import texts_with
from career_lake.session import settle

POOL = "pool_key string, id string, place int, strict boolean, found int"
MOST_KEYWORDS = 6
API_DEGREE = {"secondary": "高中", "vocational": "大专", "associate": "大专", "bachelor": "本科", "master": "硕士", "doctorate": "博士"}


def pool_keys(profiles: DataFrame) -> DataFrame:
    """profiles(profile_id, major, code, degree_level, graduation_year) with the key that decides their pool."""
    word = F.coalesce(F.element_at(lookup(API_DEGREE), F.col("degree_level")), F.lit(""))
    return profiles.withColumn("word", word).withColumn("pool_key", F.concat_ws("|", F.coalesce("major", F.lit("")), F.coalesce("code", F.lit("")), "word", F.coalesce(F.col("graduation_year").cast("string"), F.lit(""))))


def pool_queries(profiles: DataFrame) -> DataFrame:
    """The queries (pool_key, q, label, keyword, code, word, year) of each distinct key, in order q.

    0: the first keyword with degree or year; 1: the code; from 2: each of at
    most six keywords of at most 80 characters. What a query does not ask is null.
    """
    keyed = pool_keys(profiles).withColumn("year", F.coalesce(F.col("graduation_year").cast("string"), F.lit("")))
    words = F.slice(F.filter(expanded_keywords(F.col("major")), lambda x: F.length(x) <= 80), 1, MOST_KEYWORDS)
    keys = keyed.select("pool_key", "code", "word", "year", F.coalesce(words, F.array().cast("array<string>")).alias("words")).distinct()
    none = F.lit(None).cast("string")
    row = lambda q, label, keyword, code, word, year: F.struct(F.lit(q).cast("int").alias("q"), label.alias("label"), keyword.alias("keyword"), code.alias("code"), word.alias("word"), year.alias("year"))
    first = F.try_element_at("words", F.lit(1))
    strict = F.when(first.isNotNull() & ((F.col("word") != "") | (F.col("year") != "")), row(0, F.concat(F.lit("资料严格匹配 "), first), first, none, F.col("word"), F.col("year")))
    coded = F.when(F.col("code").isNotNull(), row(1, F.concat(F.lit("专业分类 "), F.col("code")), none, F.col("code"), none, none))
    named = F.transform("words", lambda w, i: row(2, F.concat(F.lit("关键词 "), w), w, none, none, none).withField("q", i + 2))
    return keys.select("pool_key", F.explode(F.concat(F.array_compact(F.array(strict, coded)), named)).alias("x")).select("pool_key", "x.*")


def pool_answers(jobs: DataFrame, queries: DataFrame, per_query: int = 100) -> tuple[DataFrame, DataFrame]:
    """The first jobs (pool_key, q, k, id, same) of each query by deadline and id, and (pool_key, q, total).

    A job counts for a keyword where its title or requirement has it; keywords
    find jobs by their rarest gram. Each distinct question is answered once, and
    written, so that pools and totals share the answers.
    """
    company = squeezed(F.regexp_replace("company_name", "(?i)^(?:Moka|北森|猎聘|智联招聘)\\s*", ""))
    same = F.concat_ws("|", company, squeezed(F.col("job_title")), squeezed(F.coalesce("work_location", F.lit(""))), F.coalesce(F.col("apply_end_date").cast("string"), F.lit("")))
    text = F.concat_ws(" ", "job_title", "major_requirements")
    j = jobs.select("id", text.alias("t"), same.alias("same"), "apply_end_date", F.coalesce("education_level", F.lit("")).alias("degrees"), F.coalesce("graduate_year", F.lit("")).alias("years"), "major_category_ids")
    hits = texts_with(queries.where("keyword is not null").select(F.col("keyword").alias("word")), j).withColumnRenamed("word", "keyword")
    asked = queries.select("keyword", "code", "word", "year").distinct()
    by_word = asked.where("keyword is not null").join(hits, "keyword").join(j, "t")
    by_word = by_word.where(F.col("word").isNull() | (F.col("degrees").contains(F.col("word")) & F.col("years").contains(F.col("year"))))
    by_code = asked.where("code is not null").join(j.withColumn("code", F.explode(F.array_distinct("major_category_ids"))), "code")
    question = ["keyword", "code", "word", "year"]
    cols = [*question, "id", "same", "apply_end_date"]
    found = settle(by_word.select(cols).union(by_code.select(cols)).withColumn("question", F.to_json(F.struct(*question))).drop(*question), "pool-answers")
    mine = queries.select("pool_key", "q", F.to_json(F.struct(*question)).alias("question"))
    place = F.row_number().over(Window.partitionBy("question").orderBy(F.asc_nulls_last("apply_end_date"), "id"))
    top = found.withColumn("k", place).where(F.col("k") <= per_query).drop("apply_end_date")
    totals = found.groupBy("question").agg(F.count("*").alias("total"))
    return mine.join(top, "question").drop("question"), mine.join(totals, "question").drop("question")


def decision_pool(jobs: DataFrame, profiles: DataFrame, per_query: int = 100, most: int = 200) -> DataFrame:
    """POOL of each distinct key: its queries in order, first wins by id and by (company, title, place, deadline).

    Each query's list is capped by deadline and id before the sequential
    first-wins rule, so a group has at most 8 * per_query rows whatever the
    input. found counts a key's jobs before the last cap.
    """
    return first_wins(pool_answers(jobs, pool_queries(profiles), per_query)[0], most)


def first_wins(lists: DataFrame, most: int = 200) -> DataFrame:
    """POOL of the lists of pool_answers."""

    def kept(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, sames, rows = set(), set(), []
        for q, i, same in pdf.sort_values(["q", "k"])[["q", "id", "same"]].itertuples(index=False):
            if i not in ids and same not in sames:
                rows.append((pdf["pool_key"].iloc[0], i, len(rows) + 1, q == 0))
                ids.add(i)
                sames.add(same)
        return pd.DataFrame(rows[:most], columns=["pool_key", "id", "place", "strict"]).assign(found=len(rows))

    return lists.groupBy("pool_key").applyInPandas(kept, POOL)


def query_summaries(jobs: DataFrame, profiles: DataFrame, per_query: int = 100) -> DataFrame:
    """(pool_key, q, label, total, returned) of every query of every key; queries without jobs have zeros."""
    queries = pool_queries(profiles)
    return summaries(queries, pool_answers(jobs, queries, per_query)[1], per_query)


def summaries(queries: DataFrame, totals: DataFrame, per_query: int = 100) -> DataFrame:
    """L03 from the totals of pool_answers."""
    total = F.coalesce("total", F.lit(0).cast("long"))
    return queries.select("pool_key", "q", "label").join(totals, ["pool_key", "q"], "left").select("pool_key", "q", "label", total.alias("total"), F.least(total, F.lit(per_query).cast("long")).alias("returned"))


def sample_limited(pool: DataFrame, summaries: DataFrame, most: int = 200) -> DataFrame:
    """(pool_key, sample_limited): whether a cap of a query or of the pool left jobs out."""
    more = summaries.groupBy("pool_key").agg(F.bool_or(F.col("total") > F.col("returned")).alias("cut"))
    size = pool.groupBy("pool_key").agg(F.max("found").alias("found"))
    return more.join(size, "pool_key", "left").select("pool_key", (F.col("cut") | (F.coalesce("found", F.lit(0)) > most)).alias("sample_limited"))


def valid_profiles(raw: DataFrame) -> DataFrame:
    """Profiles with the first rule that they break (null: valid)."""
    bad = (
        F.when(~F.coalesce(F.col("degree_level").isin("secondary", "vocational", "associate", "bachelor", "master", "doctorate", "unknown"), F.lit(False)), "degree")
        .when(F.col("graduation_year").isNull() | ~F.col("graduation_year").between(2020, 2040), "year").when(F.col("weekly_hours").isNotNull() & ~F.col("weekly_hours").between(0, 168), "hours")
        .when(F.col("major").isNull() | (F.trim("major") == "") | (F.length("major") > 80), "major")
    )
    return raw.withColumn("rejected", bad)


LEVELS = ["missing", "developing", "ready"]
CAPABILITY_KEYS = ["resume", "application", "interview", "project_evidence", "internship", "competition", "qualification"]


def known_capabilities(levels: Column) -> Column:
    """A profile's levels (map) of the known capabilities; other keys and values are left out, without any it is null."""
    known = F.map_filter(levels, lambda k, v: k.isin(CAPABILITY_KEYS) & F.coalesce(v.isin(LEVELS), F.lit(False)))
    return F.when(F.size(known) > 0, known)


def minimised(profiles: DataFrame) -> DataFrame:
    """Only degree, major and year; vocational counts as associate."""
    return profiles.select("profile_id", F.when(F.col("degree_level") == "vocational", "associate").otherwise(F.col("degree_level")).alias("degree_level"), "major", "graduation_year")
