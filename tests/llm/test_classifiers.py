import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from career_lake.llm import nb_svm, registry, toxicity

QUERIES = [("op2_quality_classifier", 3, 1, 0.5, "quality"), ("op7_toxicity", 4, 2, 0.3, "toxic")]


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """700 documents: junk has marks after words; toxic ones have words of two stems."""
    r, at = random.Random(9), str(tmp_path_factory.mktemp("c"))
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    docs, labels = [], []
    for i in range(700):
        bad, toxic = r.random() < 0.3, r.random() < 0.3
        words = [word() + ("!!" if bad and r.random() < 0.5 else "") for _ in range(r.choice([8, 60, 300]))]
        if toxic:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["zgrum", "vlopp"]) + r.choice(["", *syllables]))
        docs.append((i, " ".join(words), "en", "s", 1, 0.5))
        labels.append((i, int(not bad), int(toxic)))
    docs += [(1000, None, "en", "s", 0, None), (1001, "", None, None, None, 1.0), (1002, "the end " * 30000, "en", "s", 1, 0.1), (1, docs[1][1], "en", "s", 1, 0.5)]
    labels += [(0, labels[0][1], labels[0][2]), (None, 1, 1), (5, None, None), (99999, 0, 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, score double").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at, docs, labels


@pytest.mark.parametrize(("name", "n", "out", "least", "label"), QUERIES)
def test_held_out_accuracy(spark, corpus, name, n, out, least, label):
    at, docs, labels = corpus
    got = registry.QUERIES[name](spark, at).collect()
    assert sorted(r.doc_id for r in got) == sorted(d[0] for d in docs)
    truth = {i: q if label == "quality" else t for i, q, t in labels}
    for r in got:
        assert r.held_out == (fold(r.doc_id, n) == out) and 0 <= r.score <= 1 and r.predicted == int(r.score >= least)
    held = [r for r in got if r.held_out and truth.get(r.doc_id) is not None]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    assert registry.QUERIES[name](spark, at).collect() == got  # the same model, run again


@pytest.mark.parametrize("name", [q[0] for q in QUERIES])
def test_without_labels_or_rows(spark, corpus, tmp_path, name):
    at, _, _ = corpus
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    docs.where("doc_id < 5").write.parquet(str(tmp_path / "a/documents.parquet"))
    labels.limit(0).write.parquet(str(tmp_path / "a/labels.parquet"))
    assert {r.score for r in registry.QUERIES[name](spark, str(tmp_path / "a")).collect()} == {0.5}
    docs.limit(0).write.parquet(str(tmp_path / "b/documents.parquet"))
    labels.write.parquet(str(tmp_path / "b/labels.parquet"))
    assert registry.QUERIES[name](spark, str(tmp_path / "b")).count() == 0


def test_a_score_column_is_replaced(spark):
    docs = spark.createDataFrame([(1, "the end", 7, 0.25), (2, None, 8, None)], "doc_id long, text string, other int, Score double")
    for scores, model in ((nb_svm.quality_scores, nb_svm.fit([], np.zeros(0, int))), (toxicity.toxicity_scores, toxicity.fit(pa.array([], pa.string()), np.zeros(0, int)))):
        got = scores(docs, model)
        assert got.columns == ["doc_id", "text", "other", "score"] and [(r.other, r.score) for r in got.orderBy("doc_id").collect()] == [(7, 0.5), (8, 0.5)]


def test_fit_reaches_the_least_hinge_loss():
    """Against a plain subgradient descent on the whole objective; the bias is regularised like a weight."""
    r = np.random.default_rng(3)
    y = np.array([0, 1] * 20)
    rows = [np.unique(np.concatenate((r.integers(0, 6, 3) + 6 * k * (r.random() < 0.8), [12]))) for k in y]
    model = nb_svm.fit(rows, y, passes=60)
    count = [np.array([1 + sum(j in x for x, k in zip(rows, y, strict=True) if k == label) for j in range(13)]) for label in (0, 1)]
    total = [nb_svm.FEATURES + sum(len(x) for x, k in zip(rows, y, strict=True) if k == label) for label in (0, 1)]
    ratio = np.log(count[1] / total[1]) - np.log(count[0] / total[0])
    assert np.allclose(ratio**2, model.ratio2[:13], atol=1e-5)
    x = np.array([[ratio[j] if j in ids else 0.0 for j in range(13)] for ids in rows])
    x = np.c_[x / np.linalg.norm(x, axis=1, keepdims=True), np.ones(len(y))]
    sign, cost = np.where(y == 1, 1.0, -1.0), 1.0
    loss = lambda w: 0.5 * w @ w + cost * np.maximum(0, 1 - sign * (x @ w)).sum()
    w, best = np.zeros(14), np.inf
    for t in range(1, 20_001):
        w -= (w - cost * ((sign * (x @ w) < 1) * sign) @ x) / (10 + t)
        best = min(best, loss(w))
    with np.errstate(divide="ignore", invalid="ignore"):
        mine = np.append(np.nan_to_num(model.weight[:13] / ratio), model.bias)
    assert loss(mine) <= best * 1.01 and best < loss(np.zeros(14)) * 0.9


def test_gradients_equal_differences_of_the_loss():
    r = np.random.default_rng(2)
    net = toxicity.Network.fresh(3)
    net.p["o"] += 0.1
    x = r.normal(0, 1, (toxicity.WINDOW, 5, toxicity.INPUTS)).astype(np.float32)
    mask = np.arange(toxicity.WINDOW)[:, None] < np.array([toxicity.WINDOW, 7, 1, 3, 5])[None, :]
    x *= mask[:, :, None]
    y = np.array([1, 0, 1, 0, 1], np.float32)

    def loss():
        z = net.logits(x, mask).astype(np.float64)
        return float(np.mean(np.log1p(np.exp(-z * (2 * y - 1)))))

    got = net.gradients(x, mask, y)
    for name, p in net.p.items():
        flat = p.reshape(-1)
        for i in r.choice(len(flat), min(6, len(flat)), replace=False):
            kept, step = flat[i], np.float32(0.02)
            flat[i] = kept + step
            up = loss()
            flat[i] = kept - step
            down = loss()
            flat[i] = kept
            assert abs((up - down) / 0.04 - np.asarray(got[name]).reshape(-1)[i]) < 2e-3, (name, i)
