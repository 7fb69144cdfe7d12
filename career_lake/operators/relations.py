"""Relations between announcements, and entity matching."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from career_lake import rules
from career_lake.functions.text import let
from career_lake.operators.corpus import host
from career_lake.operators.facts import compact, lifecycle
from career_lake.session import settle, together


def change_attributes(docs: DataFrame) -> DataFrame:
    """Docs with relation_type, change_scope, resume_completeness and resolution_mode; null types are no notices."""
    body = compact(F.col("content"))
    docs = docs.withColumn("lifecycle", lifecycle(F.col("title"), body))
    kind = F.coalesce(*(F.when(F.array_contains("lifecycle", v), v) for v in ("withdrawn", "resumed", "paused", "delayed", "corrected")))
    context = compact(F.concat_ws(" ", "title", F.substring("content", 1, 1500)))
    scope = F.when(context.rlike(rules.PARTIAL_SCOPE), "partial").when(context.rlike(rules.WHOLE_SCOPE), "whole").otherwise("unknown")
    signals = sum((F.when(body.rlike(p), 1).otherwise(0) for p in rules.RESUME_SIGNALS), F.lit(0))
    whole = F.when(F.col("relation_type") == "resumed", F.when((F.length(body) >= 280) & (signals >= 3), "complete").otherwise("status_only"))
    docs = docs.withColumn("relation_type", kind).withColumn("change_scope", scope).withColumn("resume_completeness", whole)
    over = ((F.col("relation_type") == "withdrawn") & (F.col("change_scope") == "whole")) | F.coalesce(F.col("resume_completeness") == "complete", F.lit(False))
    return docs.withColumn("resolution_mode", F.when(F.col("relation_type").isNotNull(), F.when(over, "supersede").otherwise("reconcile")))


def plain_title(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(compact(c)), "[－—]\\s*(?:国务院国有资产监督管理委员会|中国就业网).*$", ""), "[^0-9a-z㐀-鿿]+", "")


def title_core(c: Column) -> Column:
    out = plain_title(c)
    for term in rules.RELATION_GENERIC:
        out = F.replace(out, F.lit(term), F.lit(""))
    return out


#: What pairs tell of a document.
_KEPT = ["document_id", "d_source", "d_url", "d_title", "updated_at"]
#: Lists of a source and a host that may be broadcast; each holds 2 * `most` documents at most.
MOST_LISTS = 500


def _newest(*by: str) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("updated_at"), "document_id"))


def _newest_documents(d: DataFrame, most: int) -> DataFrame:
    """(kind, by, ...): of each source and official host the documents that can be among the newest `most` once one URL is skipped.

    That are the newest 2 * `most`, unless more than `most` of them have one URL:
    then the newest `most` of other URLs too. Tasks cut their own rows before
    they are shuffled.
    """
    either = F.array(F.struct(F.lit("source").alias("kind"), F.col("d_source").alias("by")), F.struct(F.lit("host").alias("kind"), F.when(F.col("d_official"), host(F.col("d_url"))).alias("by")))
    dealt = d.where("d_url is not null").select(F.inline(either), *_KEPT).where("by is not null")
    out = settle(dealt.withColumn("r", _newest("kind", "by")).where(F.col("r") <= 2 * most).drop("r"), "newest")
    full = out.groupBy("kind", "by", "d_url").count().where(F.col("count") > most).select("kind", "by", F.col("d_url").alias("skipped"))
    if full.isEmpty():
        return out
    others = dealt.join(full, ["kind", "by"]).where("d_url <> skipped").drop("skipped")
    return out.union(others.withColumn("r", _newest("kind", "by")).where(F.col("r") <= most).drop("r")).distinct()


def _pairs(n: DataFrame, documents: DataFrame, most: int, told=lambda df: df) -> DataFrame:  # noqa: ANN001
    """X02 with the other columns of n, and with those that `told` makes of documents; it reads only those that pairs have.

    n: (notice_id, source_id, url, official, links, ...), one row a notice; it is
    read several times.
    """
    d = documents.where(F.col("status").isin("active", "superseded")).select("document_id", F.col("source_id").alias("d_source"), F.col("canonical_url").alias("d_url"), F.col("title").alias("d_title"), F.col("official").alias("d_official"), "updated_at")
    n = n.withColumn("h", F.when(F.col("official"), host(F.col("url"))))
    # Notices of one source and host have one list: it is merged and put in order once, and read by each without a shuffle of pairs.
    kinds, newest = n.select("source_id", "h").distinct(), _newest_documents(d, most)
    of = lambda kind, c: kinds.join(newest.where(F.col("kind") == kind), F.col(c) == F.col("by"))
    merged = of("source", "source_id").union(of("host", "h")).drop("kind", "by").distinct()
    # A notice skips its own URL, of which no list needs more than `most`.
    merged = merged.withColumn("same", _newest("source_id", "h", "d_url")).where(F.col("same") <= most).withColumn("same", F.max("same").over(Window.partitionBy("source_id", "h")))
    merged = told(merged.withColumn("r", _newest("source_id", "h")).where(F.col("r") <= most + F.col("same")).drop("same"))
    kept = [c for c in merged.columns if c not in ("source_id", "h", "r")]
    lists = merged.groupBy(F.col("source_id").alias("l_source"), F.col("h").alias("l_host")).agg(F.array_sort(F.collect_list(F.struct("r", F.struct(*kept).alias("d")))).alias("list"))
    lists = settle(lists.select("l_source", "l_host", F.transform("list", lambda x: x["d"]).alias("list")), "lists")
    link = n.select("notice_id", "source_id", "url", "official", F.explode(F.array_distinct("links")).alias("link")).join(d, F.col("link") == F.col("d_url"))
    link = link.where((F.col("official") & F.col("d_official")) | (F.col("source_id") == F.col("d_source"))).where("url <> d_url").select("notice_id", *_KEPT)
    known = [c for c in _KEPT if c != "d_title"]
    linked = link.dropDuplicates(["notice_id", *known])
    ahead = linked.withColumn("k", _newest("notice_id")).where(F.col("k") <= most).groupBy("notice_id").agg(F.collect_list(F.struct(*known)).alias("linked"))
    # Lists come last, so that they are in no shuffle of notices.
    met = together(n, "notice_id").join(ahead, "notice_id", "left")
    few = lists.count() <= MOST_LISTS
    met = met.join(F.broadcast(lists), F.col("source_id").eqNullSafe(F.col("l_source")) & F.col("h").eqNullSafe(F.col("l_host"))) if few else together(met, "source_id", "h").join(lists, F.col("source_id").eqNullSafe(F.col("l_source")) & F.col("h").eqNullSafe(F.col("l_host")))
    free = F.filter("list", lambda x: x["d_url"] != F.col("url"))
    # Linked documents take places too, those in the list their own ones.
    alike = lambda a, b: F.struct(*(a[c] for c in known)).eqNullSafe(F.struct(*(b[c] for c in known)))
    newer = lambda a, b: F.coalesce(a["updated_at"] > b["updated_at"], a["updated_at"].isNotNull() & b["updated_at"].isNull()) | (a["updated_at"].eqNullSafe(b["updated_at"]) & (a["document_id"] < b["document_id"]))
    absent = lambda free: F.filter("linked", lambda y: ~F.exists(free, lambda x: alike(x, y)))
    with_linked = lambda free: let(absent(free), lambda new: F.filter(F.filter(free, lambda x, i: i + F.size(F.filter(new, lambda y: newer(y, x))) < most), lambda x: ~F.exists(F.col("linked"), lambda y: alike(x, y))))
    near = F.when(F.col("linked").isNull(), F.slice(free, 1, most)).otherwise(let(free, with_linked))
    own = [c for c in n.columns if c not in ("url", "official", "links", "h")]
    pairs = met.select(*own, F.explode(near).alias("d")).select(*own, *(f"d.{c}" for c in kept), F.lit(False).alias("linked"))
    return pairs.unionByName(told(linked).join(n.select(*own), "notice_id").withColumn("linked", F.lit(True)).select(pairs.columns))


def candidate_pairs(notices: DataFrame, documents: DataFrame, most: int = 200) -> DataFrame:
    """Notices with documents of the same source, of the same host where both are official, or that they link; never their own URL.

    notices: (notice_id, source_id, url, official, links). documents:
    (document_id, source_id, canonical_url, title, official, status, updated_at).
    The newest `most` and all linked ones stay. Documents are ranked once a
    source and once a host, and only the newest that can stay meet a notice, so
    pairs grow with the notices. A list holds 2 * `most` documents at most.
    """
    n = settle(notices.select("notice_id", "source_id", "url", "official", "links"), "notices")
    return _pairs(n, documents, most).select("notice_id", *_KEPT, "linked")


#: Entities that may be broadcast.
MOST_ENTITIES = 1000
#: Under this similarity no pair reaches the least score of 0.45.
LEAST_SIMILARITY = 0.39


#: Texts from this length on have letters that SequenceMatcher sets aside.
AUTOJUNK = 200


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of texts, plus 2, in one array, and where each text begins (and the last ends)."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4") + np.uint32(2)
    return codes if codes.size and codes.max() >= 2**16 else codes.astype(np.uint16), np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)


def _columns(codes: np.ndarray, at: np.ndarray, n: np.ndarray, none: int) -> np.ndarray:
    """A row a letter and a column a text: the n letters from each place, then `none`."""
    row = np.arange(n.max())[:, None]
    return np.where(row < n, codes[np.minimum(at + row, len(codes) - 1)], codes.dtype.type(none))


def _longest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, start in a, start in b) of the longest common part of each pair of columns; the first in a, then in b, of equal ones."""
    kind, bits = (np.uint16, 8) if len(b) < 256 else (np.uint64, 32)
    # The length of the run that ends at a letter of b, and before equal ones the letter that comes first.
    run, last, key = (np.zeros((len(b) + 1, b.shape[1]), kind) for _ in range(3))
    first, best, i_end = (2**bits - 1 - np.arange(len(b))).astype(kind)[:, None], np.zeros(b.shape[1], kind), np.zeros(b.shape[1], np.int64)
    for i in range(len(a)):
        np.add(last[:-1], 1, out=run[1:])
        run[1:] *= a[i] == b
        np.left_shift(run[1:], bits, out=key[1:])
        key[1:] |= first
        top = key[1:].max(axis=0)
        more = (top >> bits) > (best >> bits)
        np.copyto(best, top, where=more)
        i_end[more] = i + 1
        run, last = last, run
    size = (best >> bits).astype(np.int64)
    return size, i_end - size, 2**bits - (best & kind(2**bits - 1)).astype(np.int64) - size


#: Pairs that are compared together.
_TOGETHER = 4096


def matching_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """SequenceMatcher(None, a, b).ratio() of each pair, its parts found for many pairs together; b under AUTOJUNK characters."""
    (ca, oa), (cb, ob) = _letters(a), _letters(b)
    total, matched = np.diff(oa) + np.diff(ob), np.zeros(len(a), np.int64)
    # Pairs of like lengths are compared together, so that few places are empty.
    order = np.lexsort((np.diff(oa), np.diff(ob)))
    work = [np.stack((order, oa[order], oa[order + 1], ob[order], ob[order + 1]))]
    while work:
        left = []
        for todo in work:
            todo = todo[:, (todo[2] > todo[1]) & (todo[4] > todo[3])]
            for at in range(0, todo.shape[1], _TOGETHER):
                pair, a0, a1, b0, b1 = part = todo[:, at : at + _TOGETHER]
                size, i, j = _longest(_columns(ca, a0, a1 - a0, 0), _columns(cb, b0, b1 - b0, 1))
                found = size > 0
                pair, a0, a1, b0, b1, size, i, j = (x[found] for x in (*part, size, i, j))
                matched += np.bincount(pair, size, len(a)).astype(np.int64)
                # What lies before and behind the part is compared next.
                left += [np.stack((pair, a0, a0 + i, b0, b0 + j)), np.stack((pair, a0 + i + size, a1, b0 + j + size, b1))]
        # Short ones apart from long ones, which would give them empty places.
        rest = np.concatenate(left, axis=1) if left else np.empty((5, 0), np.int64)
        wide = np.maximum(rest[2] - rest[1], rest[4] - rest[3])
        work = [x for x in (rest[:, wide <= 4], rest[:, (wide > 4) & (wide <= 10)], rest[:, wide > 10]) if x.shape[1]]
    return np.divide(2.0 * matched, total, out=np.ones(len(a)), where=total > 0)


@F.pandas_udf(T.DoubleType())
def _similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks; 0 where one is null, or their lengths show that it is under LEAST_SIMILARITY."""
    out, m, a, b = np.zeros(len(a)), SequenceMatcher(None, "", ""), a.tolist(), b.tolist()
    near = [i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x is not None and y is not None and 2 * min(len(x), len(y)) >= LEAST_SIMILARITY * (len(x) + len(y))]
    short = [i for i in near if len(b[i]) < AUTOJUNK]
    if short:
        out[short] = matching_ratios([a[i] for i in short], [b[i] for i in short])
    for i in near:
        if len(b[i]) >= AUTOJUNK:
            m.set_seqs(a[i], b[i])
            out[i] = m.ratio()
    return pd.Series(out)


def _years(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("20\\d{2}"), F.lit(0))


def _notice_texts(notices: DataFrame, *others: str) -> DataFrame:
    """What is compared of notices(notice_id, source_id, title, content)."""
    context = F.concat_ws(" ", "title", F.substring("content", 1, 1500))
    return notices.select("notice_id", "source_id", *others, title_core(F.col("title")).alias("n_core"), plain_title(context).alias("c_plain"), title_core(context).alias("c_core")).withColumn("c_years", _years(F.col("c_plain")))


def _document_texts(documents: DataFrame, title: str) -> DataFrame:
    """What is compared of documents."""
    return documents.withColumns({"core": title_core(F.col(title)), "plain": plain_title(F.col(title))}).withColumn("d_years", _years(F.col("plain")))


def _scored(p: DataFrame) -> DataFrame:
    """Pairs with their texts: score and evidence; short cores and scores under 0.45 go. Texts are left before the Python function is called."""
    quoted = (F.length("plain") >= 10) & F.col("c_plain").contains(F.col("plain"))
    referred = (F.length("core") >= 7) & F.col("c_core").contains(F.col("core"))
    p = p.where(F.length("core") >= 6).withColumns({"quoted": quoted, "referred": referred, "shared": F.arrays_overlap("c_years", "d_years"), "own": F.col("source_id") == F.col("d_source")}).drop("plain", "c_plain", "c_core", "c_years", "d_years")
    quoted, referred, shared, own = (F.col(c) for c in ("quoted", "referred", "shared", "own"))
    p = p.withColumn("direct", F.when(F.col("linked"), 1.0).when(quoted, 0.96).when(referred, 0.9))
    p = p.withColumn("similarity", F.when(F.col("direct").isNull(), _similarity(F.when(F.col("direct").isNull(), F.col("core")), F.col("n_core"))))
    near = F.least(F.lit(0.89), F.round(F.col("similarity") * 0.78, 4) + F.when(shared, 0.1).otherwise(0.0) + F.when(own, 0.04).otherwise(0.0))
    evidence = F.array_compact(F.array(
        F.when(F.col("linked"), "explicit_link"), F.when(F.col("linked") & ~own, "cross_registered_source"), F.when(~F.col("linked") & quoted, "explicit_title"), F.when(~F.col("linked") & ~quoted & referred, "title_core_reference"),
        F.when(F.col("similarity") >= 0.55, "title_similarity"), F.when(F.col("direct").isNull() & shared, "shared_recruitment_year"), F.when(F.col("direct").isNull() & own, "same_registered_source"),
    ))
    out = p.withColumn("score", F.round(F.coalesce("direct", near), 4)).withColumn("evidence", evidence)
    return out.where("score >= 0.45").drop("core", "n_core", "quoted", "referred", "shared", "own", "direct", "similarity")


def score_pairs(pairs: DataFrame, notices: DataFrame, documents: DataFrame) -> DataFrame:
    """Pairs of X02 with score and evidence; short cores and scores under 0.45 go.

    notices: (notice_id, source_id, title, content); documents: (document_id,
    title). Their texts are reduced once each, before they meet.
    """
    d = _document_texts(documents.select("document_id", "title"), "title").drop("title")
    # The comparison is far more work than its bytes tell, so it is spread over all cores.
    cores = pairs.sparkSession.sparkContext.defaultParallelism
    return _scored(pairs.join(d, "document_id").join(_notice_texts(notices), "notice_id").repartition(4 * cores, "notice_id"))


def scored_pairs(notices: DataFrame, documents: DataFrame, most: int = 200) -> DataFrame:
    """X02 and X03 in one: score_pairs of candidate_pairs, without a shuffle of pairs. Texts of documents are reduced where they are listed; a notice and a document are one row each."""
    n = settle(_notice_texts(notices, "url", "official", "links"), "notices")
    return _scored(_pairs(n, documents, most, lambda df: _document_texts(df, "d_title")))


def top_targets(scored: DataFrame) -> DataFrame:
    """The best 5 targets of each notice, whether each is blocked, and whether none is; the best one tells the latter, so others are cut first."""
    every = Window.partitionBy("notice_id")
    best = scored.withColumn("rank", F.row_number().over(every.orderBy(F.desc("score"), "document_id"))).where("rank <= 5")
    return best.withColumn("blocked", F.col("score") >= 0.72).withColumn("unresolved", ~F.bool_or("blocked").over(every))


def entity_text(c: Column) -> Column:
    """Lower case (full-width ASCII folded), letters, digits and CJK only."""
    wide = "".join(chr(0xFF01 + i) for i in range(94))
    return F.regexp_replace(F.lower(F.translate(F.coalesce(c, F.lit("")), wide, "".join(chr(0x21 + i) for i in range(94)))), "[^a-z0-9㐀-鿿]+", "")


def entity_variants(c: Column) -> Column:
    """Distinct spellings of an entity of 3 characters or more."""
    full = entity_text(c)
    core = F.regexp_replace(full, rules.COMPANY_SUFFIX, "")
    swap = F.when(core.startswith("中国") & (F.length(core) > 3), F.concat(F.lit("中"), core.substr(F.lit(3), F.length(core)))).when(core.startswith("中") & (F.length(core) > 2), F.concat(F.lit("中国"), core.substr(F.lit(2), F.length(core))))
    return F.array_distinct(F.filter(F.array_compact(F.array(full, core, swap)), lambda v: F.length(v) >= 3))


def names_entity(text: Column, variants: Column) -> Column:
    """Whether a plain text names an entity by one of its variants; controlled names decide alone."""
    controlled = F.lit(None).cast("boolean")
    for names, pattern in rules.CONTROLLED_ENTITIES:
        controlled = F.coalesce(controlled, F.when(F.arrays_overlap(variants, F.array(*map(F.lit, names))), text.rlike(pattern)))
    return F.coalesce(controlled, F.exists(variants, lambda v: text.contains(v)))


def match_entities(texts: DataFrame, entities: DataFrame) -> DataFrame:
    """(text_id, entity) where the text names the entity.

    entities is a list of names that the caller bounds; up to MOST_ENTITIES of
    them are broadcast. More meet the texts by the first three characters of a
    variant, which every text that names it has.
    """
    e = entities.select("entity").distinct().select("entity", entity_variants(F.col("entity")).alias("variants"))
    t = texts.select("text_id", entity_text(F.col("text")).alias("t"))
    if e.count() <= MOST_ENTITIES:
        return t.join(F.broadcast(e), names_entity(F.col("t"), F.col("variants"))).select("text_id", "entity")
    known = [F.lit(n) for names, _ in rules.CONTROLLED_ENTITIES for n in names]
    heads = F.array_distinct(F.transform(F.when(F.arrays_overlap("variants", F.array(*known)), F.array(*known)).otherwise(F.col("variants")), lambda v: F.substring(v, 1, 3)))
    keys = e.withColumn("head", F.explode(heads))
    grams = t.where(F.length("t") >= 3).withColumn("head", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("t") - 2), lambda i: F.col("t").substr(i, F.lit(3))))))
    return grams.join(keys, "head").where(names_entity(F.col("t"), F.col("variants"))).select("text_id", "entity").distinct()


def fuzzy_match(texts: DataFrame, entities: DataFrame) -> DataFrame:
    """(text_id, entity) where a window as long as a variant (8 or more characters) shares 3 and 80 % of its distinct bigrams.

    Bigrams of variants meet bigrams of texts in an equi-join; only windows that
    begin at a hit need to be looked at, or the last one. Equal texts are compared
    once, and entities with the same variant too.
    """
    keyed = texts.select("text_id", entity_text(F.col("text")).alias("t")).where(F.length("t") >= 2)
    e = entities.select("entity", F.explode(entity_variants(F.col("entity"))).alias("variant")).where(F.length("variant") >= 8)
    grams = lambda c: F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: c.substr(i, F.lit(2)))
    eg = e.select("variant").distinct().withColumn("gram", F.explode(F.array_distinct(grams(F.col("variant"))))).withColumn("total", F.size(F.array_distinct(grams(F.col("variant")))))
    tg = keyed.select("t").distinct().select("t", F.length("t").alias("n"), F.posexplode(grams(F.col("t"))).alias("pos", "gram"))
    hits = tg.join(eg, "gram").where(F.col("n") >= F.length("variant")).select("t", "variant", "total", "gram", "pos", "n")
    starts = hits.select("t", "variant", F.least("pos", F.col("n") - F.length("variant")).alias("start")).distinct()
    inside = starts.join(hits, ["t", "variant"]).where((F.col("pos") >= F.col("start")) & (F.col("pos") <= F.col("start") + F.length("variant") - 2))
    best = inside.groupBy("t", "variant", "start", "total").agg(F.count_distinct("gram").alias("hits"))
    found = best.where((F.col("hits") >= 3) & (F.col("hits") / F.col("total") >= 0.8)).select("t", "variant").distinct()
    return keyed.join(found.join(e, "variant").select("t", "entity").distinct(), "t").select("text_id", "entity").distinct()
