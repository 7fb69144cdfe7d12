"""Excerpts of evidence: facet windows in search results, and verified appendices of answers.

All of it is SQL functions on a row's own text (a snippet has at most a few
thousand characters); an answer's sources are few (6), so no group grows.
Lengths and places are in code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from career_lake import rules
from career_lake.functions.text import let
from career_lake.operators.evidence import cited, normalise_citations, valid_citations
from career_lake.operators.facts import compact
from career_lake.operators.retrieval import evidence_terms, window_of

#: Characters of a search result's snippet, of its first part, and windows added to it.
RESULT, PRIMARY, WINDOWS, NEAREST = 2500, 700, 6, 96
GAP = " … "
#: Excerpts of a source; characters of a facet's window, of a rare term's and of a section's excerpt.
EXCERPTS, FACET, SECTION = 6, 480, 320
#: Sources of an answer that compares.
COMPARED = 2
APPENDIX = "已核验资料原文："
EVIDENCE_ONLY = "AI 解释未通过来源校验，以下仅展示检索到的官方资料原文摘录："


# ---- K08 -----------------------------------------------------------------


def asked_facets(query: Column) -> Column:
    """The places in rules.QUERY_FACETS of the facets that a query asks for."""
    return F.array_compact(F.array(*(F.when(query.rlike(p), F.lit(i)) for i, (p, _) in enumerate(rules.QUERY_FACETS))))


def _anchor(text: Column, shown: Column, labels: list[str]) -> Column:
    """Where the first of the labels found in text begins (from 0); null if shown has a label or text has none."""
    low = [x.lower() for x in labels]
    seen = shown.contains(low[0])
    for x in low[1:]:
        seen = seen | shown.contains(x)
    return F.when(~seen, F.coalesce(*(F.nullif(F.instr(text, x), F.lit(0)) for x in low)) - 1)


def facet_windows(results: DataFrame) -> DataFrame:
    """results(query, content, snippet, ...) with facets, anchors (one for each facet asked that the snippet's first part lacks) and merged_snippet.

    Anchors nearer than a gap (96, or half of what a window may have) collapse
    into the first; at most six windows share what the first 700 characters of
    the snippet leave of 2500. A result whose content answers nothing more
    keeps its snippet. Null texts are empty.
    """
    r = results.withColumns({"t": compact(F.col("content")), "primary": F.substring(F.coalesce("snippet", F.lit("")), 1, PRIMARY), "facets": asked_facets(F.coalesce("query", F.lit("")))})
    r = r.withColumns({"low": F.lower("t"), "shown": F.lower("primary"), "most": F.greatest(F.lit(1), RESULT - F.length("primary") - len(GAP))})
    found = F.array(*(F.when(F.array_contains("facets", i), _anchor(F.col("low"), F.col("shown"), labels)) for i, (_, labels) in enumerate(rules.QUERY_FACETS)))
    r = r.withColumn("anchors", F.array_sort(F.array_distinct(F.array_compact(found))))
    share = lambda n: F.greatest(F.lit(1), F.floor((F.col("most") - len(GAP) * (n - 1)) / n)).cast("int")
    first = F.greatest(F.lit(1), F.least(F.size("anchors"), F.lit(WINDOWS)))
    r = r.withColumn("gap", F.greatest(F.lit(NEAREST), F.floor(share(first) / 2).cast("int")))
    far = lambda kept, a, gap: (F.size(kept) == 0) | (a - F.try_element_at(kept, F.lit(-1)) >= gap)
    placed = F.transform("anchors", lambda a: F.struct(a.alias("a"), F.col("gap").alias("gap")))
    kept = F.aggregate(placed, F.array().cast("array<int>"), lambda kept, x: F.when((F.size(kept) < WINDOWS) & far(kept, x["a"], x["gap"]), F.array_append(kept, x["a"])).otherwise(kept))
    r = r.withColumn("kept", kept).withColumn("each", share(F.greatest(F.lit(1), F.size("kept"))))
    n = F.length("t")

    def window(a: Column) -> Column:
        start = F.greatest(F.lit(0), F.least(n - F.col("each"), a - F.least(F.lit(72), F.floor(F.col("each") / 4).cast("int"))))
        left, right = start > 0, start + F.col("each") < n
        return F.concat(F.when(left, "…").otherwise(""), F.col("t").substr(start + F.when(left, 2).otherwise(1), F.col("each") - F.when(left, 1).otherwise(0) - F.when(right, 1).otherwise(0)), F.when(right, "…").otherwise(""))

    more = F.when(n <= F.col("most"), F.col("t")).otherwise(F.array_join(F.transform("kept", window), GAP).substr(F.lit(1), F.col("most")))
    merged = F.when((F.size("anchors") == 0) | (more == ""), F.substring(F.coalesce("snippet", F.lit("")), 1, RESULT)).otherwise(F.substring(F.concat("primary", F.lit(GAP), more), 1, RESULT))
    return r.withColumn("merged_snippet", merged).drop("t", "primary", "low", "shown", "most", "gap", "kept", "each")


# ---- A06 -----------------------------------------------------------------


def clean_evidence(snippet: Column) -> Column:
    """A snippet in one line, without a page's head before 收藏 and what stands behind the marks of its end."""
    one_line = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(snippet, F.lit("")), "(?U)\\s+", " "), "报多(?=(?:方式|截止时间))", "报名"))

    def without_head(text: Column) -> Column:
        return let(F.instr(text, " 收藏 "), lambda head: F.when((head > 0) & (head <= 500), F.substring(text, head + 4, F.length(text))).otherwise(text))

    def without_end(mark: str) -> Callable[[Column], Column]:
        def cut(text: Column, at: Column) -> Column:
            before, tail = F.substring(text, F.lit(1), at - 1), F.substring(text, at, F.length(text))
            return F.when(at <= 21, text).otherwise(let(F.instr(tail, GAP), lambda gap: F.when(gap > 1, F.concat(before, F.substring(tail, gap, F.length(tail)))).otherwise(before)))

        return lambda text: let(F.instr(text, mark), lambda at: cut(text, at))

    text = let(one_line, without_head)
    for mark in rules.PAGE_ENDS:
        text = let(text, without_end(mark))
    return F.trim(text)


def _sentences(text: Column) -> Column:
    """(index, text) of sentences of 12 characters or more; sentences begin at numbers, at labels and behind full stops."""
    labels = "|".join(rules.SENTENCE_LABELS)
    parts = F.split(text, f"(?=\\(\\d+\\))|(?=[一二三四五六七八九十]{{1,3}}、)|(?<=[。！？；;])|(?=(?:{labels}))", -1)
    return F.filter(F.transform(parts, lambda x, i: F.struct(i.alias("index"), F.trim(x).alias("text"))), lambda x: F.length(x["text"]) >= 12)


def _ellipsis(text: Column, most: int) -> Column:
    return F.concat(F.substring(text, 1, most - 1), F.lit("…"))


def section_excerpt(section: Column, terms: Column, most: int = SECTION) -> Column:
    """The three sentences of a section that hold the most of the terms, within `most` characters, in their order."""
    structural = F.array(*map(F.lit, rules.STRUCTURAL_LABELS))
    points = lambda t: F.when(F.array_contains(structural, t), F.lit(10_000)).otherwise(F.length(t) * F.length(t))
    score = lambda x: F.aggregate(F.filter(terms, lambda t: x.contains(t)), F.lit(0).cast("long"), lambda a, t: a + points(t))
    ranked = F.array_sort(F.transform(_sentences(section), lambda x: F.struct((-score(x["text"])).alias("less"), x["index"].alias("index"), x["text"].alias("text"))))
    first, second = -(-most * 45 // 100), -(-most * 30 // 100)

    def chosen(r: Column) -> Column:
        """The first three with their budgets, as (index, text, budget); those without points only in the first place."""
        n = F.size(r)
        used = lambda i, budget: F.least(F.length(F.get(r, F.lit(i))["text"]), budget)
        one = F.when(n > 1, F.lit(first)).otherwise(F.lit(most))
        two = F.when(n > 2, F.lit(second)).otherwise(most - used(0, one))
        three = most - used(0, one) - used(1, two)
        row = lambda i, budget: F.when((n > i) & ((F.get(r, F.lit(i))["less"] < 0) if i else F.lit(True)), F.struct(F.get(r, F.lit(i))["index"].alias("index"), F.get(r, F.lit(i))["text"].alias("text"), budget.cast("int").alias("budget")))
        return F.array_sort(F.array_compact(F.array(row(0, one), row(1, two), row(2, three))))

    def joined(r: Column) -> Column:
        parts = F.transform(chosen(r), lambda x: window_of(x["text"], terms, x["budget"]))
        ended = lambda text: F.when((F.length(text) < F.length(section)) & ~text.rlike("[。！？]$"), _ellipsis(text, most)).otherwise(text)
        return F.when(F.size(r) == 0, _ellipsis(section, most)).otherwise(let(F.substring(F.array_join(parts, " "), 1, most), ended))

    return F.when(F.length(section) <= most, section).otherwise(let(ranked, joined))


def distinct_excerpts(found: Column, most: int = EXCERPTS) -> Column:
    """The first `most` of a list of excerpts, without those that hold, or are held by, an earlier one (without case)."""
    other = lambda kept, x: ~F.exists(kept, lambda k: F.lower(k).contains(F.lower(x)) | F.lower(x).contains(F.lower(k)))
    return F.aggregate(found, F.array().cast("array<string>"), lambda kept, x: F.when((F.size(kept) < most) & (x != "") & other(kept, x), F.array_append(kept, x)).otherwise(kept))


def evidence_excerpts(pairs: DataFrame) -> DataFrame:
    """pairs(query, snippet, ...) with at most six excerpts.

    First one window for each facet that the query asks for and the text has,
    then windows of the rarest term of facets whose window lacks it, then the
    best sentences of each section. Null texts are empty and give none.
    """
    none = F.array().cast("array<string>")
    query = F.coalesce("query", F.lit(""))
    p = pairs.withColumns({"content": clean_evidence(F.col("snippet")), "terms": evidence_terms(query)})
    asked = F.array_compact(F.array(*(F.when(query.rlike(x), F.array(*map(F.lit, words))) for x, words in rules.EVIDENCE_FACETS)))
    p = p.withColumn("asked", F.filter(F.transform(asked, lambda g: F.struct(g.alias("all"), F.filter(g, lambda t: F.col("content").contains(t)).alias("some"))), lambda g: F.size(g["some"]) > 0))
    p = p.withColumn("windows", F.transform("asked", lambda g: F.struct(window_of(F.col("content"), g["all"], F.lit(FACET)).alias("window"), g["some"].alias("some"))))
    times = lambda t: F.size(F.split(F.col("content"), F.concat(F.lit("\\Q"), t, F.lit("\\E")), -1))
    rarest = lambda g: F.array_min(F.transform(g, lambda t, i: F.struct(times(t).alias("n"), (-F.length(t)).alias("less"), i.alias("i"), t.alias("term"))))["term"]
    p = p.withColumn("rare", F.transform("windows", lambda w: F.struct(w["window"].alias("window"), rarest(w["some"]).alias("term"))))
    rare = F.transform(F.filter("rare", lambda w: ~w["window"].contains(w["term"])), lambda w: window_of(F.col("content"), F.array(w["term"]), F.lit(SECTION)))
    parts = F.slice(F.filter(F.transform(F.split(F.coalesce("snippet", F.lit("")), "(?U)\\s+…\\s+", -1), lambda x: F.regexp_replace(x, "(?U)^\\s+|\\s+$", "")), lambda x: x != ""), 1, EXCERPTS)
    sections = F.when(F.size(parts) > 1, parts).otherwise(F.array(F.coalesce("snippet", F.lit(""))))
    p = p.withColumn("sections", F.transform(sections, clean_evidence))
    found = F.concat(F.transform("windows", lambda w: w["window"]), rare, F.transform("sections", lambda s: section_excerpt(s, F.col("terms"))))
    return p.withColumn("excerpts", F.coalesce(distinct_excerpts(found), none)).drop("content", "terms", "asked", "windows", "rare", "sections")


# ---- A08 -----------------------------------------------------------------


def deadline_text(snippet: Column) -> tuple[Column, Column]:
    """A07 on the cleaned text: the day, and how a reader writes it, with its hour."""
    days, texts = [], []
    for p in rules.EVIDENCE_DEADLINES:
        g = lambda i, p=p: F.regexp_extract(snippet, p, i)
        day = F.try_to_date(F.concat(g(1), F.lit("-"), F.lpad(g(2), 2, "0"), F.lit("-"), F.lpad(g(3), 2, "0")), "yyyy-MM-dd")
        ok = F.year(day) >= 2000
        plain = lambda i, g=g: g(i).try_cast("int").cast("string")
        hour = F.when(g(4) != "", F.concat(g(4), F.lit(":"), F.when(g(5) != "", g(5)).otherwise("00"))).otherwise("")
        days.append(F.when(ok, day))
        texts.append(F.when(ok, F.concat(plain(1), F.lit("年"), plain(2), F.lit("月"), plain(3), F.lit("日"), hour)))
    return F.coalesce(*days), F.coalesce(*texts)


def is_listing(title: Column, url: Column) -> Column:
    """Whether a source is likely a list of announcements."""
    path = F.regexp_replace(F.regexp_extract(F.coalesce(url, F.lit("")), "(?i)^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "^$", "/")
    return F.coalesce(title, F.lit("")).rlike("^(?:人事)?招聘\\s*[-－]?") | path.rlike("/index(?:_[^/]*)?\\.html$")


def selected_sources(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """The sources (answer_id, place, ...) that back an answer: those that are no lists, or else all; the first two where it compares companies or job titles, else the first."""
    many = lambda c: F.size(F.array_distinct(F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), compact), lambda x: x != ""))) > 1
    most = answers.select("answer_id", F.when(many("companies") | many("job_titles"), COMPARED).otherwise(1).alias("most"))
    s = sources.join(most, "answer_id").withColumn("listing", is_listing(F.col("title"), F.col("url")))
    rank = F.row_number().over(Window.partitionBy("answer_id").orderBy("listing", "place"))
    best = F.min("listing").over(Window.partitionBy("answer_id"))
    return s.withColumns({"rank": rank, "best": best}).where((F.col("listing") == F.col("best")) & (F.col("rank") <= F.col("most"))).drop("listing", "rank", "best", "most")


def verified_appendix(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """(answer_id, grounded, answer, cited_sources) of answers(answer_id, query, answer, companies, job_titles, valid_at) and their sources(answer_id, place from 1, title, url, snippet).

    An answer whose citations hold (A03) is followed by the excerpts and
    deadlines of its selected sources; one whose citations fail is replaced by them.
    valid_at: the day (text) that deadlines are compared with. Sources without
    an answer take no part; an answer without sources keeps no ground and is replaced.
    """
    a = answers.withColumn("answer", normalise_citations(F.coalesce("answer", F.lit(""))))
    n = sources.groupBy("answer_id").agg(F.count("*").alias("n_sources"))
    s = selected_sources(answers, sources).join(answers.select("answer_id", "query", "valid_at"), "answer_id")
    s = evidence_excerpts(s).withColumn("text", clean_evidence(F.col("snippet")))
    day, told = deadline_text(F.col("text"))
    s = s.withColumns({"day": day, "told": told})
    mark = F.concat(F.lit("[资料"), F.col("place").cast("string"), F.lit("]"))
    late = F.when(F.col("day").cast("string") < F.col("valid_at"), "已截止").otherwise("尚未到截止日")
    line = F.when(F.col("day").isNotNull(), F.concat(F.lit("- 时效核验：公告报名截止时间为"), "told", F.lit("；以"), "valid_at", F.lit("为基准，"), late, F.lit("。"), mark))
    quoted = F.transform("excerpts", lambda x: F.concat(F.lit("- "), x, F.lit(" "), F.col("mark")))
    s = s.withColumn("mark", mark).select("answer_id", "place", quoted.alias("quoted"), line.alias("line"))
    s = s.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("place", "quoted", "line"))).alias("s"))
    out = a.join(n, "answer_id", "left").join(s, "answer_id", "left")
    s = F.coalesce("s", F.array().cast("array<struct<place:int,quoted:array<string>,line:string>>"))
    quotes, lines = F.flatten(F.transform(s, lambda x: x["quoted"])), F.array_compact(F.transform(s, lambda x: x["line"]))
    places = lambda keep: F.transform(F.filter(s, keep), lambda x: x["place"].cast("int"))
    own = F.concat(places(lambda x: F.size(x["quoted"]) > 0), places(lambda x: x["line"].isNotNull()))
    out = out.withColumns({"grounded": F.coalesce(valid_citations(F.col("answer"), F.coalesce("n_sources", F.lit(0))), F.lit(False)), "extra": F.concat(quotes, lines), "own": own})
    text = (
        F.when(~F.col("grounded"), F.array_join(F.concat(F.array(F.lit(EVIDENCE_ONLY)), "extra"), "\n"))
        .when(F.size("extra") == 0, F.col("answer"))
        .otherwise(F.array_join(F.concat(F.array(F.regexp_replace("answer", "(?U)^\\s+|\\s+$", ""), F.lit(""), F.lit(APPENDIX)), "extra"), "\n"))
    )
    return out.select("answer_id", "grounded", text.alias("answer"), F.array_distinct(F.when(F.col("grounded"), F.concat(cited(F.col("answer")), "own")).otherwise(F.col("own"))).alias("cited_sources"))
