"""Requests to an external index, its hits, and evidence around a query's terms."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from career_lake import rules
from career_lake.functions.text import let
from career_lake.operators.facts import compact
from career_lake.operators.relations import entity_text, entity_variants, names_entity
from career_lake.session import settle, together

QUERY, SECTION, MERGED, SEGMENTS = 250, 56, 1200, 3
#: Sources of a query, and terms of its evidence.
SOURCES, TERMS = 6, 160


def context_values(values: Column, items: int = 4, most: int = 48) -> Column:
    """The first distinct values without case, joined by /."""
    plain = F.filter(F.transform(values, compact), lambda v: v != "")
    folded = F.transform(plain, F.lower)
    first = F.filter(plain, lambda v, i: F.array_position(folded, F.lower(v)) == i + 1)
    return F.substring(F.array_join(F.slice(first, 1, items), "/"), 1, most)


def compose_index_query(requests: DataFrame) -> DataFrame:
    """requests(query, companies, job_titles, profile: array<string>) with index_query: the query and its context, 250 characters at most."""
    target = F.concat_ws("|", *(F.nullif(context_values(F.coalesce(F.col(c), F.array().cast("array<string>"))), F.lit("")) for c in ("companies", "job_titles")))
    mine = context_values(F.coalesce(F.col("profile"), F.array().cast("array<string>")))
    section = lambda label, v: F.when(v != "", F.substring(F.concat(F.lit(label), v), 1, SECTION))
    context = F.concat_ws("；", section("目标:", target), section("学生:", mine))
    room = F.greatest(F.lit(1), QUERY - F.length(context) - 1)
    return requests.withColumn("index_query", F.when(context == "", F.substring("query", 1, QUERY)).otherwise(F.concat(F.substring(F.col("query"), F.lit(1), room), F.lit("；"), context)))


def merged_snippet(snippets: Column) -> Column:
    """The first 3 distinct segments within 1200 characters."""
    distinct = lambda plain: let(F.transform(plain, F.lower), lambda folded: F.slice(F.filter(plain, lambda v, i: F.array_position(folded, F.lower(v)) == i + 1), 1, SEGMENTS))
    each = lambda first: F.greatest(F.lit(1), F.floor((MERGED - 3 * (F.size(first) - 1)) / F.greatest(F.lit(1), F.size(first)))).cast("int")
    cut = lambda first: let(each(first), lambda n: F.array_join(F.transform(first, lambda t: F.substring(t, F.lit(1), n)), " … "))
    return F.substring(let(let(F.filter(F.transform(snippets, compact), lambda v: v != ""), distinct), cut), 1, MERGED)


def ground_external_hits(hits: DataFrame, mappings: DataFrame, documents: DataFrame, k: int) -> DataFrame:
    """The k first documents of each request that hits stand for.

    hits: (request_id, place, remote_id, snippet, score); mappings: (remote_id,
    document_id, status, content_hash); documents: (document_id, title,
    content_hash, status, blocked). A hit counts if its mapping is synced with
    the current text of an active document that nothing blocks. Only the first
    segments of a document are needed, so no group grows with the hits.
    """
    known = mappings.where("status = 'synced'").select("remote_id", "document_id", "content_hash")
    live = documents.where((F.col("status") == "active") & ~F.col("blocked")).select("document_id", "title", "content_hash")
    # Hits meet one small table of what may count, then their request in one task; groups and windows follow there.
    counting = settle(known.join(live, ["document_id", "content_hash"]).drop("content_hash"), "grounded-documents")
    h = hits.where("remote_id is not null").join(counting, "remote_id").withColumn("snippet", compact(F.col("snippet")))
    h = together(h.select("request_id", "remote_id", "document_id", "title", "place", "score", "snippet"), "request_id").withColumn("plain", F.lower("snippet"))
    first = h.groupBy("request_id", "remote_id", "document_id", "title", "plain").agg(F.min("place").alias("place"), F.min_by("snippet", F.struct("place", "score")).alias("snippet"), F.min_by("score", F.struct("place", "score")).alias("score"))
    first = first.withColumn("segment", F.row_number().over(Window.partitionBy("request_id", "remote_id").orderBy(F.col("plain") == "", "place", "score", "plain"))).where(F.col("segment") <= SEGMENTS)
    docs = first.groupBy("request_id", "remote_id", "document_id", "title").agg(F.min("place").alias("at"), F.min_by("score", F.struct("place", "score")).alias("score"), F.transform(F.array_sort(F.collect_list(F.struct("place", "score", "snippet"))), lambda x: x["snippet"]).alias("snippets"))
    place = F.row_number().over(Window.partitionBy("request_id").orderBy("at", "remote_id"))
    return docs.withColumn("place", place).where(F.col("place") <= k).select("request_id", "document_id", "title", merged_snippet(F.col("snippets")).alias("snippet"), "score", "place")


def filter_by_target(results: DataFrame, targets: DataFrame) -> DataFrame:
    """results(request_id, doc_id, text) that name one of the request's companies; without companies, one of its job titles; without both, all.

    targets: (request_id, companies, job_titles: array<string>), 8 each at most.
    A text is compared with the names of its own request only.
    """
    eight = lambda c: F.slice(F.array_distinct(F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.substring(compact(x), 1, 120)), lambda x: x != "")), 1, 8)
    t = targets.select("request_id", eight("companies").alias("c"), eight("job_titles").alias("j"))
    t = t.select("request_id", F.when(F.size("c") > 0, F.col("c")).otherwise(F.col("j")).alias("names"))
    r = results.join(t, "request_id", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    asked = r.where(F.size("names") > 0).select("request_id", "doc_id", entity_text(F.col("text")).alias("t"), F.explode("names").alias("entity"))
    hit = asked.where(names_entity(F.col("t"), entity_variants(F.col("entity")))).select("request_id", "doc_id").distinct()
    return r.where(F.size("names") == 0).select("request_id", "doc_id").union(hit)


def clean_text(c: Column, most: int) -> Column:
    return F.nullif(F.substring(compact(F.regexp_replace(c, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]", "")), 1, most), F.lit(""))


def normalise_sources(payloads: DataFrame) -> DataFrame:
    """Sources (query_id, place, source_id, title, snippet, url, published_at, score) of payloads(query_id, payload as JSON text).

    Items are a list, or the first list at one of rules.SOURCE_LISTS. Each field is the first filled one of its possible places;
    items without title or text go, repeated ones count once; the first 6 stay.
    """
    v = F.expr("try_parse_json(payload)")
    lists = [F.expr("try_variant_get(v, '$', 'array<variant>')"), *(F.expr(f"try_variant_get(v, '$.{k}', 'array<variant>')") for k in rules.SOURCE_LISTS)]
    items = payloads.withColumn("v", v).select("query_id", F.posexplode(F.coalesce(*lists)).alias("at", "item"))
    raw = lambda paths: F.array(*(F.expr(f"try_variant_get(item, '$.{p}', 'string')") for p in paths))
    first = lambda values: F.get(F.array_compact(values), F.lit(0))
    got = lambda paths, most: first(F.transform(raw(paths), lambda x: clean_text(x, most)))
    is_url = lambda x: F.when(x.rlike("(?i)^https?://[^\\s/]+"), x)
    url = first(F.transform(raw(rules.SOURCE_URLS), lambda x: is_url(clean_text(x, 2048))))
    day = first(F.transform(raw(rules.SOURCE_DATES), lambda x: x.try_cast("timestamp")))
    s = items.select("query_id", "at", got(rules.SOURCE_IDS, 120).alias("source_id"), got(rules.SOURCE_TITLES, 240).alias("title"), got(rules.SOURCE_TEXTS, 2500).alias("snippet"), url.alias("url"), day.alias("published_at"), F.coalesce(*(F.expr(f"try_variant_get(item, '$.{p}', 'double')") for p in ("score", "segment.score", "metadata.score"))).alias("score"))
    s = s.where("title is not null and snippet is not null")
    same = Window.partitionBy("query_id", "title", F.coalesce("url", F.lit("")), F.substring("snippet", 1, 160)).orderBy("at")
    s = s.withColumn("again", F.row_number().over(same)).where("again = 1")
    s = s.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("at"))).where(F.col("place") <= SOURCES)
    return s.select("query_id", "place", F.coalesce("source_id", F.concat(F.lit("source-"), F.col("place").cast("string"))).alias("source_id"), "title", "snippet", "url", "published_at", "score")


def evidence_terms(query: Column) -> Column:
    """Terms of the facets that a query asks for, then its Latin words and runs of 6 to 2 CJK characters; distinct, 160 at most."""
    none = F.array().cast("array<string>")
    facets = F.concat(*(F.when(query.rlike(p), F.array(*map(F.lit, words))).otherwise(none) for p, words in rules.EVIDENCE_FACETS))
    latin = F.transform(F.regexp_extract_all(query, F.lit("[A-Za-z0-9][A-Za-z0-9_.+-]{1,39}"), F.lit(0)), F.lower)
    runs = F.regexp_extract_all(query, F.lit("[㐀-鿿]{2,40}"), F.lit(0))
    sizes = F.array(*map(F.lit, (6, 5, 4, 3, 2)))
    grams = lambda g: F.flatten(F.transform(sizes, lambda n: F.when(F.length(g) >= n, F.transform(F.sequence(F.lit(1), F.length(g) - n + 1), lambda i: g.substr(i, n))).otherwise(none)))
    return F.slice(F.array_distinct(F.concat(facets, latin, F.flatten(F.transform(runs, grams)))), 1, TERMS)


def _places(text: Column, t: Column) -> Column:
    """All places of a term, by the lengths of what lies between its occurrences."""
    parts = F.split(text, F.concat(F.lit("\\Q"), t, F.lit("\\E")), -1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda a, p: F.struct((a["at"] + F.length(p) + F.length(t)).alias("at"), F.array_append(a["out"], a["at"] + F.length(p)).alias("out"))
    return F.aggregate(F.slice(parts, 1, F.size(parts) - 1), zero, step, lambda a: a["out"])


def window_start(text: Column, terms: Column, most: Column) -> Column:
    """Where the window of `most` characters begins that holds the most terms.

    For short texts: each start reads the text up to its window. `best_windows` is for long ones.
    """
    held = lambda w: F.aggregate(F.filter(terms, lambda t: w.contains(t)), F.lit(0).cast("long"), lambda a, t: a + 1_000_000 + F.length(t) * F.length(t))
    back = F.floor(most * 0.28).cast("int")

    def best(last: Column) -> Column:
        places = F.concat(F.array(F.lit(0)), F.flatten(F.transform(F.filter(terms, lambda t: F.length(t) >= 2), lambda t: _places(text, t))))
        starts = F.array_distinct(F.transform(places, lambda a: F.greatest(F.lit(0), F.least(last, a - back))))
        return F.array_min(F.transform(starts, lambda s: F.struct((-let(text.substr(s + 1, most), held)).alias("score"), s.alias("start"))))["start"]

    return let(F.length(text) - most, lambda last: F.when(last > 0, best(last)).otherwise(0))


def cut_window(text: Column, start: Column, most: Column) -> Column:
    """The window from start, with ellipses for what is cut."""
    n = F.length(text)
    left, right = start > 0, start + most < n
    cut = F.concat(F.when(left, "…").otherwise(""), text.substr(start + F.when(left, 2).otherwise(1), most - F.when(left, 1).otherwise(0) - F.when(right, 1).otherwise(0)), F.when(right, "…").otherwise(""))
    return F.when(n <= most, text).otherwise(cut)


def window_of(text: Column, terms: Column, most: Column) -> Column:
    """A05 on columns; the start is found once."""
    return let(window_start(text, terms, most), lambda s: cut_window(text, s, most))


def _best_start(text: str, terms: list[str], most: int) -> int:
    """window_start of a text longer than `most`; as starts ascend, each term's next place is looked for only once."""
    back, last = math.floor(most * 0.28), len(text) - most
    starts = {0}
    for t in {t for t in terms if len(t) >= 2}:
        at = text.find(t)
        while at >= 0:
            starts.add(max(0, min(last, at - back)))
            at = text.find(t, at + len(t))
    after, best = [-1] * len(terms), (0, 0)
    for s in sorted(starts):
        score = 0
        for i, t in enumerate(terms):
            if after[i] < s:
                found = text.find(t, s)
                after[i] = found if found >= 0 else len(text) + 1
            if after[i] + len(t) <= s + most:
                score += 1_000_000 + len(t) ** 2
        best = min(best, (-score, s))
    return best[1]


def _starts(most: int):  # noqa: ANN202
    @F.pandas_udf("int")
    def starts(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, terms in parts:
            rows = zip(texts, terms, strict=True)
            yield pd.Series([0 if x is None or ts is None or len(x) <= most else _best_start(x, [t for t in ts if t is not None], most) for x, ts in rows], dtype="int32")

    return starts


def best_windows(pairs: DataFrame, most: int) -> DataFrame:
    """pairs(pair_id, content, terms) with the window of `most` characters that holds the most terms.

    A window begins 28 % before an occurrence of a term, or at the start; more
    terms win, then longer ones, then the earlier window. Ellipses mark cuts.
    """
    p = pairs.withColumn("start", _starts(most)("content", "terms"))
    return p.select("pair_id", "start", cut_window(F.col("content"), F.col("start"), F.lit(most)).alias("window"))
