"""Sources and sinks: registries, feeds, retrieval payloads, pages and corpus snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCE = "name string, url string, source_type string, source_grade string, authority string, tags array<string>, follow_links boolean, max_documents int, allowed_hosts array<string>, include_paths array<string>, exclude_paths array<string>, enabled boolean"


def _clean(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), F.trim), lambda x: x != "")))


def load_sources(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of sources, or an object that has it as `sources`, with defaults filled in."""
    text = spark.read.text(path, wholetext=True)
    listed = F.from_json("value", f"array<struct<{', '.join(x.replace(' ', ':', 1) for x in SOURCE.split(', '))}>>")
    held = F.from_json("value", f"struct<sources:array<struct<{', '.join(x.replace(' ', ':', 1) for x in SOURCE.split(', '))}>>>")["sources"]
    one = text.select(F.explode(F.when(F.trim("value").startswith("["), listed).otherwise(held)).alias("s")).select("s.*")
    paths = lambda c: F.transform(_clean(F.col(c)), lambda p: F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))).alias(c)
    return one.where("name is not null and url is not null").select(
        "name", "url", F.coalesce("source_type", F.lit("auto")).alias("source_type"), F.coalesce("source_grade", F.lit("A")).alias("source_grade"), F.coalesce(F.nullif(F.trim("authority"), F.lit("")), F.lit("official")).alias("authority"),
        _clean(F.col("tags")).alias("tags"), F.coalesce("follow_links", F.lit(False)).alias("follow_links"), F.greatest(F.lit(1), F.least(F.lit(500), F.coalesce("max_documents", F.lit(1)))).alias("max_documents"),
        F.transform(_clean(F.col("allowed_hosts")), F.lower).alias("allowed_hosts"), paths("include_paths"), paths("exclude_paths"), F.coalesce("enabled", F.lit(False)).alias("enabled"),
    )


def upsert_sources(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """By url; id and created_at stay, all else comes from the incoming row."""
    kept = ["id", "created_at"]
    rest = [c for c in incoming.columns if c not in ("url", *kept)]
    e = existing.select("url", *(F.col(c).alias(f"e_{c}") for c in kept + rest))
    i = incoming.select("url", *(F.col(c).alias(f"i_{c}") for c in kept + rest), F.lit(True).alias("new"))
    out = e.join(i, "url", "full_outer")
    return out.select("url", *(F.coalesce(f"e_{c}", f"i_{c}").alias(c) for c in kept), *(F.when(F.col("new"), F.col(f"i_{c}")).otherwise(F.col(f"e_{c}")).alias(c) for c in rest))


def load_job_feed(payloads: DataFrame, text: str = "value") -> DataFrame:
    """One variant row for each job of the response envelopes; responses with an error have none."""
    v = F.try_parse_json(text)
    root = F.coalesce(F.try_variant_get(v, "$[0]", "variant"), v)
    data = F.coalesce(F.try_variant_get(root, "$.result.data.json", "variant"), F.try_variant_get(root, "$.result.data", "variant"))
    ok = F.try_variant_get(root, "$.error", "variant").isNull()
    jobs = payloads.where(ok).select(F.try_variant_get(data, "$.jobs", "array<variant>").alias("jobs"))
    return jobs.select(F.explode("jobs").alias("job"))


def load_retrieval_payloads(payloads: DataFrame, text: str = "value", key: str = "query_id") -> DataFrame:
    """(query_id, place, item) of a list, or of the first of results, records, items, data, chunks, one level nested."""
    v = F.try_parse_json(text)
    names = ["results", "records", "items", "data", "chunks"]
    tries = [F.try_variant_get(v, "$", "array<variant>")] + [F.try_variant_get(v, f"$.{n}", "array<variant>") for n in names] + [F.try_variant_get(v, f"$.{o}.{n}", "array<variant>") for o in ("data", "result") for n in names]
    return payloads.select(F.col(key).alias("query_id"), F.posexplode_outer(F.coalesce(*tries)).alias("place", "item"))


def scan_pages(pages: DataFrame) -> DataFrame:
    """pages(url, content_type, ...) with the route html, pdf, text or unsupported."""
    kind, url = F.lower(F.coalesce("content_type", F.lit(""))), F.lower("url")
    route = F.when(kind.contains("pdf") | url.endswith(".pdf"), "pdf").when(kind.contains("html") | (kind == ""), "html").when(kind.startswith("text/") | kind.contains("json"), "text").otherwise("unsupported")
    return pages.withColumn("route", route)


def write_corpus(tables: dict[str, DataFrame], root: str, partition: dict[str, str] | None = None) -> str:
    """Write all tables as a new snapshot; the pointer, written last, names it. Returns its folder."""
    name = uuid.uuid4().hex
    for table, df in tables.items():
        writer = df.write
        if partition and table in partition:
            writer = writer.partitionBy(partition[table])
        writer.parquet(f"{root}/{name}/{table}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(name,)], "snapshot string").coalesce(1).write.mode("overwrite").json(f"{root}/current")
    return f"{root}/{name}"


def read_corpus(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table of the current snapshot."""
    name = spark.read.schema("snapshot string").json(f"{root}/current").first()["snapshot"]
    return spark.read.parquet(f"{root}/{name}/{table}")
