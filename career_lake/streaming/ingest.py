"""The whole ingest chain, run by run: a batch of fetched pages, or a stream of them.

A run takes pages in the scope of their source (T02), decodes and reads them
(T03, T04), names them canonically (T01; a document counts once a run, with its
newest page), tells their role (Q01) and notice type (X01), compares them with
what the corpus holds (F17), and routes them (V04).

The corpus at `target` has two Parquet tables, laid out by the first two
hexadecimal digits of the document's id: versions and reviews. A run reads the
prefixes of its own documents only. (document_id, content_hash) is the key of a
version, (document_id, kind, content_hash) that of a review; reviews are written
first, so that a run that is repeated after a failure adds what is missing and
nothing twice.

pages: (page_id, source_id, url, body binary, content_type). sources:
(source_id, url, allowed_hosts, include_paths, exclude_paths). Pages of unknown
sources, without text, or whose document has rejected that text are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from career_lake.operators import corpus as C
from career_lake.operators import facts as N
from career_lake.operators.governance import route_candidates
from career_lake.operators.pages import extract_html
from career_lake.operators.relations import change_attributes
from career_lake.session import discard, settle

VERSION = "document_id string, source_id string, canonical_url string, version_no int, title string, content string, content_hash string, published_at string, role string, relation_type string, reasons array<string>, route string, status string"
REVIEW = "document_id string, source_id string, kind string, content_hash string, reasons array<string>"
PREFIX = "substring(document_id, 1, 2)"


def fetched_documents(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """The documents of a run's pages: in scope, read, named, with role and notice type; the newest page of each."""
    known = sources.select("source_id", F.col("url").alias("root"), "allowed_hosts", "include_paths", "exclude_paths")
    p = pages.join(known, "source_id").where(C.in_scope(F.col("url"), F.col("root"), F.col("allowed_hosts"), F.col("include_paths"), F.col("exclude_paths")))
    read = extract_html(p).select("page_id", F.col("url").alias("read_url"), "title", "content", "published_at")
    docs = p.select("page_id", "source_id", "url").join(read, "page_id").withColumn("canonical_url", C.canonical_url(F.col("url")))
    newest = Window.partitionBy("source_id", "canonical_url").orderBy(F.desc("page_id"))
    docs = docs.withColumn("k", F.row_number().over(newest)).where("k = 1 and content <> ''").drop("k", "url", "read_url", "page_id")
    docs = docs.withColumns({"document_id": F.sha2(F.concat_ws("\n", "source_id", "canonical_url"), 256), "content_hash": F.sha2("content", 256)})
    docs = docs.withColumn("role", C.document_role(F.col("title"), F.col("canonical_url"), F.col("content"), F.lit(None).cast("string")))
    return change_attributes(docs).select("document_id", "source_id", "canonical_url", "title", "content", "content_hash", "published_at", "role", F.when(F.col("role") == "evidence", F.col("relation_type")).alias("relation_type"))


def routed(documents: DataFrame, held: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """VERSION of what a run adds to the versions held (those of its documents at least). rejected: (document_id, content_hash)."""
    new = documents.join(held.select("document_id", "content_hash"), ["document_id", "content_hash"], "left_anti")
    mine = held.join(new.select("document_id"), "document_id", "left_semi")
    last = mine.groupBy("document_id").agg(F.max("version_no").alias("last"))
    place = F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("version_no")))
    now = mine.where("route <> 'staged'").withColumn("k", place).where("k = 1").drop("k")
    both = now.select("document_id", F.lit("old").alias("version_id"), F.lit(0).alias("version_no"), "title", "content").union(new.join(now.select("document_id"), "document_id", "left_semi").select("document_id", F.lit("new"), F.lit(1), "title", "content"))
    why = N.version_diff(both).where("version_id = 'new'").select("document_id", "reasons")
    none = F.array().cast("array<string>")
    new = new.join(why, "document_id", "left").withColumn("reasons", F.coalesce("reasons", none)).join(last, "document_id", "left")
    snapshot = now.select("document_id", "source_id", "canonical_url", F.col("content_hash").alias("old_hash"), F.col("role").alias("old_role"), F.col("status").alias("old_status"))
    if rejected is None:
        snapshot = snapshot.withColumn("rejected", none)
    else:
        snapshot = snapshot.join(rejected.groupBy("document_id").agg(F.collect_set("content_hash").alias("rejected")), "document_id", "left").withColumn("rejected", F.coalesce("rejected", none))
    out = route_candidates(new, snapshot.drop("document_id")).where("route <> 'ignored'")
    status = F.when(F.col("route").isin("cross_review", "passthrough"), "review_pending").when(F.col("route") == "staged", "staged").otherwise("active")
    out = out.withColumns({"status": status, "version_no": (F.coalesce("last", F.lit(0)) + 1).cast("int")})
    return out.select(*(c.split()[0] for c in VERSION.split(", ")))


def reviews_of(added: DataFrame) -> DataFrame:
    """REVIEW rows that versions ask for: held notices, changed facts, and pages without a body of their own."""
    kinds = F.array_compact(F.array(
        F.when(F.col("route") == "cross_review", "cross_document_change"), F.when(F.col("route") == "staged", "fact_change"), F.when((F.col("role") == "content_stub") & (F.col("route") != "staged"), "content_quality"),
    ))
    return added.select("document_id", "source_id", F.explode(kinds).alias("kind"), "content_hash", "reasons")


def _held(spark: SparkSession, path: str, schema: str, prefixes: list[str]) -> DataFrame:
    """The rows of a table whose prefix is one of these; none before the first run."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, prefix string").parquet(path).where(F.col("prefix").isin(prefixes)).drop("prefix")


def ingest_run(pages: DataFrame, sources: DataFrame, target: str, rejected: DataFrame | None = None) -> None:
    """Add a run's pages to the corpus at target."""
    spark = pages.sparkSession
    documents = settle(fetched_documents(pages, sources), "ingest-documents")
    prefixes = [r["p"] for r in documents.select(F.expr(PREFIX).alias("p")).distinct().collect()]  # 256 at most
    added = settle(routed(documents, _held(spark, f"{target}/versions", VERSION, prefixes), rejected), "ingest-versions")
    key = ["document_id", "kind", "content_hash"]
    new = reviews_of(added).join(_held(spark, f"{target}/reviews", REVIEW, prefixes).select(key), key, "left_anti")
    for rows, name in ((new, "reviews"), (added, "versions")):
        rows.withColumn("prefix", F.expr(PREFIX)).repartition("prefix").write.mode("append").partitionBy("prefix").parquet(f"{target}/{name}")
    discard(documents, added)


def corpus_versions(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema(f"{VERSION}, prefix string").parquet(f"{target}/versions").drop("prefix")


def corpus_reviews(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema(f"{REVIEW}, prefix string").parquet(f"{target}/reviews").drop("prefix")


def stream_corpus(pages: DataFrame, sources: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """A run for each micro-batch of a stream of pages; sources: a table, read again by each run."""
    return pages.writeStream.foreachBatch(lambda batch, _: ingest_run(batch, sources, target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
