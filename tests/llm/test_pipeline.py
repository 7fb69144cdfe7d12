import importlib
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_jaccard import brute as brute_jaccard
from tests.llm.test_substrings import WORD


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r, at = random.Random(21), str(tmp_path_factory.mktemp("p"))
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(2, 4)))
    passage = [word() for _ in range(60)]
    docs, labels = [], []
    for i in range(400):
        bad, toxic = i % 4 == 1, i % 4 == 2
        words = [word() + ("!!" if bad else "") for _ in range(r.choice([30, 90, 200]))]
        if toxic:
            for _ in range(4):
                words.insert(r.randrange(len(words)), "zgrum" + r.choice(syllables))
        if i % 4 == 0 and i % 3 == 0:
            words[5:5] = passage
        docs.append((i, " ".join(words), "en", f"s{i % 3}", 1))
        labels.append((i, int(not bad), int(toxic)))
    docs += [(1000 + i, docs[4 * i][1], "en", None, 1) for i in range(10)]
    docs += [(1100 + i, docs[4 * i][1] + " more", "en", "s9", 1) for i in range(10)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at, docs


def test_pipeline_equals_brute_force(spark, corpus):
    at, docs = corpus
    pieces = corpus_pipeline.run(spark, at).collect()
    kept = [d for d in docs if d[0] >= 1000 or d[0] % 4 in (0, 3)]
    component = {i: c for i, _, c in brute_jaccard([(d[0], d[1]) for d in kept], 5, 4, 5)}
    kept = [d for d in kept if component[d[0]] == d[0]]
    windows = {}
    for d in kept:
        w = WORD.findall(d[1])
        for a in range(len(w) - 34):
            windows[tuple(w[a : a + 35])] = windows.get(tuple(w[a : a + 35]), 0) + 1
    from tokenizers import Tokenizer
    import public_tokenizers

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for d in kept:
        w = WORD.findall(d[1])
        gone = {j for a in range(len(w) - 34) if windows[tuple(w[a : a + 35])] > 1 for j in range(a, a + 35)}
        text = " ".join(x for j, x in enumerate(w) if j not in gone) if gone else d[1]
        want[d[0]] = [*lib.encode(text, add_special_tokens=False).ids, 1]
    got = {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        assert zlib.crc32(bytes(p.ids)) == p.ids_crc32
        got.setdefault(p.doc_id, []).extend(np.frombuffer(bytes(p.ids), "<u4").tolist())
    assert got == want and any("zgrum" not in d[1] for d in kept)


def test_stages_keep_the_columns_of_documents(spark, corpus):
    at, _ = corpus
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, at)
        assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), at).count() == 0


def test_entry_registers_it():
    import __spark_entry__

    importlib.reload(__spark_entry__)
    names = __spark_entry__.queries()
    assert "pipeline" in names and re.match(r"op\d+_", next(n for n in names if n.startswith("op")))


def test_rows_of_one_id_or_none_are_told_apart_by_text(spark):
    r = random.Random(8)
    text = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(40))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(None, a), (None, b), (None, b), (None, ""), (None, ""), (5, c), (5, d), (5, d), (3, d + " x"), (9, e), (None, e), (4, c)]
    docs = spark.createDataFrame([(*x, "en", "s", 1) for x in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    want = [(None, a), (None, b), (None, ""), (None, ""), (3, d + " x"), (9, e), (4, c)]
    key = lambda x: (str(x[0]), x[1])
    assert sorted(((x.doc_id, x.text) for x in out.collect()), key=key) == sorted(want, key=key)
    rest = corpus_pipeline.packing(spark, corpus_pipeline.substrings(spark, out, ""), "").collect()
    assert sum(x.start == 0 for x in rest) == len(want)
