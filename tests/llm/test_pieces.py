import random

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from career_lake.llm import pieces
from career_lake.llm.pieces import SPACE, Model, decoded, piece_ids

PATH = public_tokenizers.path("piece_bpe_32k.model")
M = Model(PATH)


def brute(text):
    """Full Viterbi over the whole text at once."""
    return whole(SPACE + text.replace(" ", SPACE)) if text else []


def whole(t):
    best = [(0.0, 0, [])]
    for i in range(1, len(t) + 1):
        s, j, ids = best[i - 1]
        top = (s + M.unknown, i - 1, [*ids, *(M.byte[b] for b in t[i - 1].encode())])
        for j in range(max(0, i - M.longest), i):
            f = M.vocab.get(t[j:i])
            if f and (best[j][0] + f[0] > top[0] or best[j][0] + f[0] == top[0] and j < top[1]):
                top = (best[j][0] + f[0], j, [*best[j][2], f[1]])
        best.append(top)
    return best[-1][2]


def test_equals_full_viterbi():
    r = random.Random(1)
    words = ["the", "inter", "national", "ization", "ñandú", "日本", "😀", "\n", "", " ", "xq", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"]
    for _ in range(60):
        t = "".join(r.choice(words) + r.choice([" ", "", "  "]) for _ in range(r.randint(0, 40)))
        assert M.encode(t) == brute(t)


def test_commits_before_the_end_with_a_bounded_window():
    parts = list(M.stream("international" * 400))
    assert len(parts) > 20 and [i for p in parts for i in p] == whole("international" * 400)


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("aeinortsxé日▁"), min_size=1, max_size=200))
def test_runs_of_any_length_equal_full_viterbi(run):
    assert [i for p in M.stream(run) for i in p] == whole(run)


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=80))
def test_round_trip(t):
    assert M.decode(M.encode(t)) == t


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = piece_ids(docs, PATH)
    rows = out.collect()
    assert len(rows) == docs.count() and all(r.round_trip and r.n_ids == len(r.ids) for r in rows)
    back = {r.doc_id: r.t for r in out.select("doc_id", decoded(out["ids"], PATH).alias("t")).collect()}
    assert back == {r.doc_id: r.text for r in docs.collect()}


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "a▁b  c", "c"), (3, "a▁b  c", "c"), (4, " lead and trail ", "d"), (5, "x" * 20000, "e"), (6, "▁", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = piece_ids(docs, PATH).collect()
    assert len(got) == len(rows) and all(r.round_trip for r in got)
    assert {r.doc_id: r.ids for r in got}[1] is None and {r.doc_id: r.ids for r in got}[2] == []
    assert piece_ids(docs.limit(0), PATH).count() == 0


def test_a_word_is_streamed_once_whatever_marks_are_beside_it():
    m, seen = Model(PATH), []
    stream = m.stream
    m.stream = lambda run: seen.append(run) or stream(run)
    t = 'say worde, worde. (worde)\nworde; "worde" worde!? worde ² worde².'
    assert m.encode(t) == brute(t)
    assert seen.count(SPACE + "worde") == seen.count("worde") == 1 and not any("worde" in x and x.strip(SPACE) != "worde" for x in seen)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aeth1²³_.,-\ńé日 "), max_size=60))
def test_marks_between_letters_equal_full_viterbi(t):
    assert M.encode(t) == brute(t)


def test_runs_in_use_stay_remembered(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBER", 8)
    m, seen = Model(PATH), []
    stream = m.stream
    m.stream = lambda run: seen.append(run) or stream(run)
    for i in range(40):
        t = f"often {'x' * i}y{'z' * i}"
        assert m.encode(t) == brute(t)
    assert seen.count(SPACE + "often") == 1 and len(m.known) + len(m.older) <= 8


def test_window_stays_small_in_a_long_run():
    run = "unbelievablyinternational" * 300
    parts = list(M.stream(run))
    assert [i for p in parts for i in p] == whole(run)
    assert max(map(len, parts)) <= 2 * M.longest
