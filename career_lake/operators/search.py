"""Retrieval of documents for a table of requests."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from career_lake.operators.facts import compact
from career_lake.session import settle

K1, B, TITLE_WEIGHT, CONTENT_WEIGHT = 1.2, 0.75, 5.0, 1.0
GRAM = 3


def search_terms(query: Column, preferred: Column) -> Column:
    """Preferred terms, Latin tokens, short CJK groups and CJK trigrams; distinct without case, 28 at most."""
    text = F.concat_ws(" ", query, F.array_join(preferred, " "))
    groups = F.regexp_extract_all(text, F.lit("[㐀-鿿]{3,30}"), F.lit(0))
    grams = lambda g: F.transform(F.sequence(F.lit(1), F.length(g) - 2), lambda i: g.substr(i, F.lit(3)))
    cjk = F.flatten(F.transform(groups, lambda g: F.concat(F.when(F.length(g) <= 8, F.array(g)).otherwise(F.array().cast("array<string>")), grams(g))))
    every = F.concat(F.filter(preferred, lambda p: F.length(p) >= 2), F.regexp_extract_all(text, F.lit("[A-Za-z0-9][A-Za-z0-9_.+-]{1,39}"), F.lit(0)), cjk)
    every = F.filter(F.transform(every, F.trim), lambda t: t != "")
    folded = F.transform(every, F.lower)
    first = F.filter(every, lambda t, i: F.array_position(folded, F.lower(t)) == i + 1)
    return F.slice(first, 1, 28)


def grams_of(c: Column, n: int = GRAM) -> Column:
    """All runs of n characters, in one pass over the text."""
    return F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))


def trigram_index(docs: DataFrame) -> DataFrame:
    """Postings (gram, doc_id, field, tf) of docs(doc_id, title, content), folded to lower case."""
    fields = F.array(F.struct(F.lit("title").alias("field"), F.lower("title").alias("t")), F.struct(F.lit("content").alias("field"), F.lower("content").alias("t")))
    each = docs.select("doc_id", F.explode(fields).alias("f")).select("doc_id", "f.field", F.explode(grams_of(F.col("f.t"))).alias("gram"))
    return each.groupBy("gram", "doc_id", "field").agg(F.count("*").alias("tf"))


def candidates(terms: DataFrame, docs: DataFrame, sizes: tuple[int, ...] = (GRAM,)) -> DataFrame:
    """(term, doc_id) of documents that have the term's rarest gram.

    terms: (term), folded. A term's grams have 3 characters, or as many as the
    term if they are fewer (sizes: those to look for). Only grams that some
    term has leave the scan of the documents; they are written once.
    """
    grams = None
    for n in sizes:
        own = F.length("term") >= n if n == GRAM else F.length("term") == n
        grams = F.when(own, grams_of(F.col("term"), n)) if grams is None else grams.when(own, grams_of(F.col("term"), n))
    wanted = terms.select("term", F.explode(F.array_distinct(grams)).alias("gram"))
    text = F.concat_ws("\n", F.lower("title"), F.lower("content"))
    every = F.array_distinct(F.concat(*(grams_of(text, n) for n in sizes)))
    seen = settle(docs.select("doc_id", F.explode(every).alias("gram")).join(wanted.select("gram").distinct(), "gram", "left_semi"), "search-grams")
    spread = seen.groupBy("gram").agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy("term").orderBy(F.coalesce("df", F.lit(0)), "gram"))
    rarest = wanted.join(spread, "gram", "left").withColumn("k", rank).where("k = 1 and df is not null").select("term", "gram")
    return seen.join(rarest, "gram").select("term", "doc_id")


def texts_with(words: DataFrame, texts: DataFrame) -> DataFrame:
    """(word, t) of the distinct texts (t) that have a word (word; case counts).

    Words find texts by their rarest gram, so that neither side is broadcast.
    Empty and null words are in no text.
    """
    words, kinds = words.where("word <> ''").distinct(), texts.select("t").distinct().withColumn("doc_id", F.xxhash64("t"))
    near = candidates(words.select(F.lower("word").alias("term")).distinct(), kinds.select("doc_id", F.col("t").alias("title"), F.lit("").alias("content")), (1, 2, GRAM))
    return near.join(words, F.col("term") == F.lower("word")).join(kinds, "doc_id").where(F.col("t").contains(F.col("word"))).select("word", "t").distinct()


#: Terms that are looked for in one pass over the documents (at most 40 characters each).
MOST_TERMS = 200_000
#: The words and the automaton that this worker built last.
_built: list[tuple[list[str], ahocorasick.Automaton]] = []


def term_counts(terms: DataFrame, docs: DataFrame) -> DataFrame:
    """(term, doc_id, in_title, in_content): how often each of the terms (term, folded to lower case) stands in docs(doc_id, title, content); only those that do.

    One pass over the documents finds all terms at once by an automaton, so that
    no text is shuffled and none is read once a term. At most about MOST_TERMS terms are
    broadcast; more take so many passes more. Occurrences of a term do not overlap.
    """
    terms = terms.where("term <> ''").select("term").distinct()
    passes = max(1, -(-terms.count() // MOST_TERMS))
    texts = docs.select("doc_id", F.lower("title").alias("title"), F.lower("content").alias("content"))
    schema = T.StructType([T.StructField("term", T.StringType()), docs.schema["doc_id"], T.StructField("in_title", T.LongType()), T.StructField("in_content", T.LongType())])
    out = None
    for k in range(passes):
        words = sorted(r["term"] for r in terms.where(F.pmod(F.xxhash64("term"), F.lit(passes)) == k).collect())
        shared = docs.sparkSession.sparkContext.broadcast(words)
        found = texts.mapInArrow(_counter(shared), schema)
        out = found if out is None else out.union(found)
    return out


def _counter(shared: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts the broadcast words in batches of (doc_id, title, content)."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        if not _built or _built[0][0] is not words:
            automaton = ahocorasick.Automaton()
            for i, w in enumerate(words):
                automaton.add_word(w, (i, len(w)))
            automaton.make_automaton()
            _built[:] = [(words, automaton)]
        automaton = _built[0][1]
        names = pa.array(words, pa.string())
        for rb in it:
            which, rows, title, content = [], [], [], []
            for row, texts in enumerate(zip(rb.column(1).to_pylist(), rb.column(2).to_pylist(), strict=True)):
                counts: dict[int, list[int]] = {}
                for field, text in enumerate(texts):
                    ends: dict[int, int] = {}
                    for end, (i, n) in automaton.iter(text or "") if words else ():
                        if end - n >= ends.get(i, -1):
                            counts.setdefault(i, [0, 0])[field] += 1
                            ends[i] = end
                which += counts
                rows += [row] * len(counts)
                title += [c[0] for c in counts.values()]
                content += [c[1] for c in counts.values()]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(which, pa.int64())), rb.column(0).take(pa.array(rows, pa.int64())), pa.array(title, pa.int64()), pa.array(content, pa.int64())], names=["term", "doc_id", "in_title", "in_content"])

    return count


def bm25_search(requests: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """The max(30, 10k) documents (200 at most) of each request by weighted BM25 of its terms.

    requests: (request_id, terms). docs: (doc_id, title, content). Title counts
    5, content 1; the lower the rank the better. Terms under 3 characters match
    nothing here.
    """
    asked = requests.select("request_id", F.explode(F.array_distinct(F.transform("terms", F.lower))).alias("term")).where(F.length("term") >= GRAM)
    tf = F.col("in_title") * TITLE_WEIGHT + F.col("in_content") * CONTENT_WEIGHT
    sizes = docs.select("doc_id", (F.length("title") + F.length("content")).alias("size"))
    found = settle(term_counts(asked, docs).select("term", "doc_id", tf.alias("tf")).join(sizes, "doc_id"), "search-found")
    whole = docs.agg(F.count("*").alias("n"), F.avg(F.length("title") + F.length("content")).alias("mean")).first()
    n, mean = whole["n"] or 0, whole["mean"] or 1.0
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.greatest(F.lit(1e-6), F.log((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / mean))
    scored = found.join(df, "term").select("term", "doc_id", F.round(part * 1e9).cast("long").alias("part"))  # whole numbers, so that no order of addition decides ties
    out = asked.join(scored, "term").groupBy("request_id", "doc_id").agg((-F.round(F.sum("part") / 1e9, 6)).alias("rank"))
    limit = min(200, max(30, 10 * k))
    return out.withColumn("place", F.row_number().over(Window.partitionBy("request_id").orderBy("rank", "doc_id"))).where(F.col("place") <= limit)


def like_search(requests: DataFrame, docs: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """For requests with fewer than k documents found, the newest others that contain one of the first 8 terms; rank 10.

    requests: (request_id, terms).
    """
    enough = found.groupBy("request_id").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("request_id")
    short = requests.join(enough, "request_id", "left_anti").select("request_id", F.explode(F.transform(F.slice("terms", 1, 8), F.lower)).alias("term")).where("term <> ''")
    near = term_counts(short, docs).join(docs.select("doc_id", "updated_at"), "doc_id")
    hits = short.join(near.select("term", "doc_id", "updated_at"), "term").select("request_id", "doc_id", "updated_at").distinct()
    hits = hits.join(found.select("request_id", "doc_id"), ["request_id", "doc_id"], "left_anti")
    place = F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("updated_at"), "doc_id"))
    return hits.withColumn("place", place).where(F.col("place") <= min(100, 10 * k)).select("request_id", "doc_id", F.lit(10.0).alias("rank"), "place")


def visible(docs: DataFrame, sources: DataFrame, blocked: DataFrame) -> DataFrame:
    """Active evidence of enabled sources without pending reviews, that no pending notice blocks.

    docs: (document_id, source_id, status, role, fact_review, ocr_review, ...).
    """
    ok = docs.where((F.col("status") == "active") & (F.col("role") == "evidence") & ~F.coalesce("fact_review", F.lit(False)) & ~F.coalesce("ocr_review", F.lit(False)))
    return ok.join(sources.where("enabled").select("source_id"), "source_id", "left_semi").join(blocked.select("document_id"), "document_id", "left_anti")


OPEN_WORDS = ["active", "open", "ongoing", "recruiting", "在招", "招聘中"]


def meets_filters(metadata: Column, filters: Column) -> Column:
    """Whether metadata meets every filter (both map<string,string>; lists are joined by "|").

    Missing metadata passes; dates compare only where both sides have them.
    """
    fold = lambda m: F.transform_keys(m, lambda k, v: F.lower(F.regexp_replace(k, "[_-]", "")))
    values, wanted = fold(metadata), fold(filters)
    word = lambda x: F.when(F.lower(F.trim(x)).isin(OPEN_WORDS), "active").otherwise(F.lower(F.trim(x)))
    words = lambda x: F.transform(F.split(x, "\\|"), word)
    date = lambda x: F.try_to_date(F.substring(F.trim(x), 1, 10), "yyyy-MM-dd")
    start, end = date(F.element_at(values, F.lit("validfrom"))), date(F.element_at(values, F.lit("validuntil")))

    def meets(e: Column) -> Column:
        key, want = e["key"], e["value"]
        have = F.element_at(values, F.when(key == "sourceids", "sourceid").otherwise(key))
        same = F.arrays_overlap(words(have), words(want))
        no = lambda c: ~F.coalesce(c, F.lit(False))
        return (
            F.when(want.isNull() | (want == ""), True)
            .when(key == "validat", no(date(want) < start) & no(date(want) > end))
            .when(key == "validfrom", no(end < date(want)))
            .when(key == "validuntil", no(start > date(want)))
            .when(key.isin("sourceid", "sourceids"), F.coalesce(same, F.lit(False)))
            .otherwise(have.isNull() | F.coalesce(same, F.lit(False)))
        )

    return F.forall(F.map_entries(wanted), meets)


def snippet(content: Column, terms: Column, most: int = 1000) -> Column:
    """A window around the earliest term, a quarter before it, with ellipses."""
    text = compact(content)
    places = F.filter(F.transform(terms, lambda t: F.position(F.lower(t), F.lower(text))), lambda p: p > 0)
    start = F.greatest(F.lit(0), F.coalesce(F.array_min(places), F.lit(1)) - 1 - most // 4)
    end = F.least(F.length(text), start + most)
    cut = F.concat(F.when(start > 0, "…").otherwise(""), text.substr(start + 1, end - start), F.when(end < F.length(text), "…").otherwise(""))
    return F.when(F.length(text) <= most, text).otherwise(cut)


def local_results(found: DataFrame, k: int) -> DataFrame:
    """found(request_id, doc_id, rank) with a score from 0 to 1, the k best of each request."""
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 / (1 + F.log1p(F.abs("rank"))))), 6)
    place = F.row_number().over(Window.partitionBy("request_id").orderBy("rank", "doc_id"))
    return found.withColumn("k", place).where(F.col("k") <= k).select("request_id", "doc_id", score.alias("score"), F.col("k").alias("place"))


def choose_engine(requests: DataFrame, mappings: DataFrame, external: DataFrame) -> DataFrame:
    """Per request its engine and whether it fell back: the local one if some mapping isn't synced or nothing was found."""
    state = mappings.agg(F.coalesce(F.bool_or(F.col("status") != "synced"), F.lit(False)).alias("incomplete"))
    hits = external.groupBy("request_id").agg(F.count("*").alias("hits"))
    out = requests.select("request_id").join(hits, "request_id", "left").join(F.broadcast(state), F.lit(True))
    remote = ~F.col("incomplete") & (F.coalesce("hits", F.lit(0)) > 0)
    return out.select("request_id", F.when(remote, "external").otherwise("local").alias("engine"), (~remote).alias("fallback_used"))
