"""Threshold-scaled document sketches (operator 9), with SQL functions only.

A document's sketch holds every hash of its word 5-grams (lower-cased A-Z)
that lies below a fixed fraction of the hash range. Sketches of one scale can
be merged by union and estimate containment between very unequal documents.

A text with fewer words than the shingle has one shingle, its whole word
sequence. Nothing but the threshold decides what is kept, so the union of
sketches is the sketch of the union; short texts may keep nothing. Null or
word-less texts have an empty sketch. Two empty sketches tell nothing (likeness
and containment 0). Repeated rows have equal sketches. Extra columns pass through. An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from career_lake.session import settle

#: Words of a shingle; one of so many hashes is kept.
SHINGLE, SCALE = 5, 8
#: Ranges of ids whose edges one task orders; larger tables have longer ranges, whose sorts can spill.
MOST_RANGES = 10_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_hashes(text: Column) -> Column:
    """The hashes of the words `[^\\x20\\x09-\\x0D]+`, in order."""
    plain = F.translate(F.coalesce(text, F.lit("")), _UPPER + "\t\n\x0b\x0c\r", _LOWER + " " * 5)
    return F.transform(F.filter(F.split(plain, " "), lambda w: w != ""), lambda w: F.xxhash64(w))


def shingle_hashes(h: Column, n: int) -> Column:
    """The hash of every n consecutive words; of all words, if there are fewer."""
    of = F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(n))))
    whole = F.aggregate(h, F.lit(42).cast("long"), lambda a, x: F.xxhash64(a, x))
    return F.when(F.size(h) >= n, of).when(F.size(h) > 0, F.array(whole)).otherwise(F.array().cast("array<bigint>"))


def kept_hashes(s: Column, scale: int) -> Column:
    """The sketch: distinct hashes below the threshold, ordered."""
    limit = -(2**63) + 2**64 // scale
    return F.array_sort(F.array_distinct(F.filter(s, lambda x: x < limit)))


def with_sketch(df: DataFrame, text: str, out: str, n: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """df with the sketch of a text column, one step of work a column, so that nothing is computed twice."""
    h, s = f"__{out}_words", f"__{out}_shingles"
    df = df.withColumn(h, word_hashes(F.col(text)))
    df = df.withColumn(s, shingle_hashes(F.col(h), n))
    return df.withColumn(out, kept_hashes(F.col(s), scale)).drop(h, s)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two sketches."""
    both = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - both
    return F.when(total == 0, F.lit(0.0)).otherwise(both / total)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has."""
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def merged(a: Column, b: Column) -> Column:
    """The sketch of two documents together."""
    return F.array_sort(F.array_union(a, b))


def as_text(a: Column) -> Column:
    """A sketch as text: its hashes in hexadecimal, 16 digits each."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def neighbours(docs: DataFrame, key: str = "doc_id", bucket_rows: int = 4096) -> DataFrame:
    """(id, next_id, n_prev): each id's next one in ascending order (after the last: the first) and its predecessor's n_chars.

    docs: (key, n_chars). Ids are dealt into ranges of about equally many
    (settled, so that every step sees the same ranges) and ordered inside them;
    only one row a range is ordered over all, so no task orders the whole table.
    Repeated ids count once; null ids have no neighbour.
    """
    ids = docs.where(docs[key].isNotNull()).groupBy(F.col(key).alias("id")).agg(F.max("n_chars").alias("n"))
    span = ids.agg(F.min("id").alias("lo"), F.count("*").alias("rows"), F.max_by("n", "id").alias("last_n")).first()
    if not span["rows"]:
        return ids.select("id", F.col("id").alias("next_id"), F.col("n").alias("n_prev"))
    ranges = min(MOST_RANGES, -(-span["rows"] // bucket_rows))
    ids = settle(ids.repartitionByRange(ranges, "id").withColumn("range", F.spark_partition_id()), "sketch-ranges")
    edge = ids.groupBy("range").agg(F.min("id").alias("first_id"), F.max_by("n", "id").alias("last_n"))
    over = Window.orderBy("range")
    edge = edge.select("range", F.lead("first_id").over(over).alias("after"), F.lag("last_n").over(over).alias("before"))
    inside = Window.partitionBy("range").orderBy("id")
    ids = ids.select("range", "id", F.lead("id").over(inside).alias("next_id"), F.lag("n").over(inside).alias("n_prev"))
    ids = ids.join(edge, "range", "left")
    return ids.select("id", F.coalesce("next_id", "after", F.lit(span["lo"])).alias("next_id"), F.coalesce("n_prev", "before", F.lit(span["last_n"])).alias("n_prev"))


def edited_documents(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, text, n_chars, edited, next_sketch: each text and its edit.

    The edit replaces the last floor(n_chars/4) code points by as many first
    ones (or all) of the next document. A document sends its predecessor only
    the first code points that it needs, and its sketch.
    """
    docs = docs.select(docs[key].cast("long").alias("doc_id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
    near = settle(neighbours(docs.select("doc_id", F.length("text").cast("long").alias("n_chars"))), "sketch-neighbours")
    before = near.select(F.col("id").alias("before_id"), F.col("next_id").alias("to_id"))
    sent = with_sketch(docs.join(near, docs.doc_id == near.id, "left"), "text", "sketch")  # left, so that both joins reuse one exchange of the texts
    head = sent.select(F.col("doc_id").alias("of"), F.substring("text", F.lit(1), F.floor(F.col("n_prev") / 4).cast("int")).alias("head"), F.col("sketch").alias("next_sketch"))
    head = head.join(before, head.of == before.to_id, "left").groupBy("before_id").agg(F.min(F.struct("head", "next_sketch")).alias("next"))
    head = head.select("before_id", "next.head", "next.next_sketch")  # one, where an id is repeated
    mine = docs.join(head, docs.doc_id == head.before_id, "left")
    n = F.length("text")
    edit = F.concat(F.substring("text", F.lit(1), n - F.floor(n / 4).cast("int")), F.coalesce("head", F.lit("")))
    return mine.select("doc_id", "text", n.cast("long").alias("n_chars"), edit.alias("edited"), "next_sketch")
