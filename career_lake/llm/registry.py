"""The queries of this subpackage: thin calls of its operators over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from career_lake.llm import nb_svm, toxicity
from career_lake.llm.chat import END, START, formatted_conversations, read_back, text_parts
from career_lake.llm.jaccard import ngram_components
from career_lake.llm.labelled import fold, labelled_sample
from career_lake.llm.packing import packed
from career_lake.llm.part_codes import part_codes
from career_lake.llm.pitman_yor import document_scores
from career_lake.llm.pieces import piece_ids
from career_lake.llm.sketches import as_text, edited_documents, likeness, with_sketch
from career_lake.llm.spelling import LEAST, spelling_groups, word_counts
from career_lake.llm.substrings import without_repeats
from career_lake.llm.token_counts import token_counts
from career_lake.llm.topk import quantised, top_k
from career_lake.session import table

BYTE_BPE = "byte_bpe_50k.tiktoken"
PIECES = "piece_bpe_32k.model"
WORD_BPE = "word_bpe_49k.json"


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), quantised(F.col("embedding"), 1024.0).alias("v"))
    return top_k(rows, rows.where("id % 100 = 0"), 10)


def quality_model(spark: SparkSession, sf_dir: str) -> nb_svm.Model:
    """Fitted to labelled documents whose crc32(doc_id) mod 3 is not 1."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return nb_svm.fit_sample(labelled_sample(docs, labels, "quality", nb_svm.SAMPLE, fold(F.col("doc_id"), 3) != 1))


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    """Fitted to labelled documents whose crc32(doc_id) mod 4 is not 2."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.fit_sample(labelled_sample(docs, labels, "toxic", toxicity.SAMPLE, fold(F.col("doc_id"), 4) != 2))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = nb_svm.quality_scores(docs, quality_model(spark, sf_dir))
    return scored.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = toxicity.toxicity_scores(docs, toxicity_model(spark, sf_dir))
    return scored.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = document_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), fold(F.col("doc_id"), 7) != 2)
    return scored.withColumn("held_out", fold(F.col("doc_id"), 7) == 2)


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)


def op8_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_ids, round_trip (the decoded ids equal the text) of every document."""
    return piece_ids(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = edited_documents(table(spark, sf_dir, "documents"))
    docs = with_sketch(with_sketch(docs, "text", "sketch"), "edited", "edited_sketch")
    near = lambda b: likeness(F.col("sketch"), F.col(b))
    return docs.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        F.when(F.col("text") == F.col("edited"), F.lit(1.0)).otherwise(near("edited_sketch")).alias("near_edited"),
        F.coalesce(near("next_sketch"), F.lit(0.0)).alias("near_next"),
    )


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packed(docs, public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN, with_ids=False).drop("ids")


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and -1, whose texts hold control strings; read back from the formatted text and its spans."""
    said = F.concat(F.lit(END), F.lit(START), F.lit("assistant ok"))
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    back = read_back(formatted_conversations(rows.union(own).withColumn("parts", text_parts(F.col("text")))))
    told = F.array_join(F.transform("turns_read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns_read").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op12_part_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = part_codes(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return out.drop("label")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = word_counts(table(spark, sf_dir, "documents"), drop_every=97)
    return spelling_groups(counted.where(F.col("n") >= LEAST))


QUERIES = {
    "op1_topk_search": op1_topk_search,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_pitman_yor": op4_pitman_yor,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_token_counts": op6_token_counts,
    "op7_toxicity": op7_toxicity,
    "op8_piece_encoding": op8_piece_encoding,
    "op9_fingerprints": op9_fingerprints,
    "op10_packing": op10_packing,
    "op11_chat_format": op11_chat_format,
    "op12_part_codes": op12_part_codes,
    "op13_spelling_variants": op13_spelling_variants,
}
def _books_sql(rounds: int) -> str:
    """The tables of each round: c0 (first codebooks), then a (nearest entries) and c (means) of every round; the last a is final."""
    out = ""
    for i in range(rounds + 1):
        out += f"""
, a{i} AS (
  SELECT x.vec_id, x.label, x.p, min(CAST(list_sum(list_transform(list_zip(x.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) * 64 + c.e) AS near
  FROM parts x JOIN c{i} c ON c.p = x.p GROUP BY x.vec_id, x.label, x.p
)"""
        if i < rounds:
            out += f"""
, m{i} AS (
  SELECT a.p, a.near % 64 AS e, s.i, sum(x.x[s.i])::BIGINT AS total, count(*) AS n
  FROM a{i} a JOIN parts x ON x.vec_id = a.vec_id AND x.p = a.p, range(1, 5) s(i) GROUP BY a.p, a.near % 64, s.i
), c{i + 1} AS (
  SELECT c.p, c.e, coalesce(m.x, c.x) AS x
  FROM c{i} c LEFT JOIN (SELECT p, e, list((total - ((total % n) + n) % n) // n ORDER BY i) AS x FROM m{i} GROUP BY p, e) m ON m.p = c.p AND m.e = c.e
)"""
    return out


ORACLES: dict[str, str] = {
    # Integer inner products of all pairs (query, row), ranked.
    "op1_topk_search": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, r.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, r.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v r ON q.vec_id <> r.vec_id AND len(q.v) = len(r.v)
  WHERE q.vec_id % 100 = 0
), k AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 10
""",
    # The digests of the rows themselves; the template's marks counted.
    "op11_chat_format": """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(12 + length(replace(role, '<|', '<||')) + 1 + length(replace(text, '<|', '<||')) + 11) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
""",
    # All distances of parts and entries, in two rounds.
    "op12_part_codes": """
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), parts AS (
  SELECT vec_id, label, p, v[p * 4 + 1 : p * 4 + 4] AS x FROM v, range(16) s(p)
), first AS (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM v ORDER BY vec_id LIMIT 64
), c0 AS (
  SELECT x.p, f.e, x.x FROM parts x JOIN first f USING (vec_id)
)"""
    + _books_sql(2)
    + """
, told AS (
  SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c2
), s AS (
  SELECT vec_id, label, string_agg(lpad(lower(to_hex(near % 64)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(near // 64) AS BIGINT) AS error
  FROM a2 GROUP BY vec_id, label
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM s, told
""",
}
