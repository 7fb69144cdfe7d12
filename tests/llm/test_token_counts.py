import public_tokenizers
from tokenizers import Tokenizer

from career_lake.llm.token_counts import token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
HARD = ["", None, "  ", "Hello's World!! 123", "ΑΣ ΟΔΟΣ", "İstanbul ǅ éx", "a<|endoftext|>b <|startoftext|>", "x\x1cy\x85z\xa0q", "日本語 texto 😀😀", "a" * 5000, "don't we'll __ $$$"]


def test_counts_equal_the_library(spark):
    rows = [(i, t, "extra") for i, t in enumerate(HARD)] + [(0, "", "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts(docs, PATH).collect())
    lib = Tokenizer.from_file(PATH)
    want = sorted((i, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows)
    assert got == want


def test_whole_table_equals_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    lib = Tokenizer.from_file(PATH)
    want = {r.doc_id: len(lib.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in token_counts(docs, PATH).collect()} == want
    assert token_counts(docs.limit(0), PATH).count() == 0
