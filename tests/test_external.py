"""Contexts within a size against the rule in plain Python."""

import json

from career_lake.operators import external as E


def budgeted(sources):
    out = [
        {"reference": f"资料{i + 1}", "title": (t or "")[:120], "snippet": (s or "")[: E.SNIPPET_BUDGETS[i]], "url": u and u[:180], "publishedAt": p and p[:32]}
        for i, (t, s, u, p) in enumerate(sources)
    ]
    dump = lambda: json.dumps(out, ensure_ascii=False, separators=(",", ":"))
    for x in reversed(out):
        over = len(dump()) - 3900
        if over > 0 and len(x["snippet"]) > 80:
            x["snippet"] = x["snippet"][: max(80, len(x["snippet"]) - over - 8)]
    return dump()


def test_context_budget_follows_the_rule(spark):
    quoted, long = '招"聘\\\n' * 300, "公告" * 1000
    cases = {
        1: [("t", "short", None, None)],
        2: [("题" * 200, long, "https://x/" + "a" * 300, "2026-07-01T00:00:00Z")] * 6,
        3: [("t", quoted, "u", None)] * 6,
        4: [(None, None, None, None), ("题" * 120, quoted, "v" * 180, "2026-01-01"), ("", "", "", "")],
        5: [('"' * 120, '"' * 1000, '"' * 180, '"' * 32)] * 6,
    }
    rows = [(q, i + 1, *x) for q, xs in cases.items() for i, x in enumerate(xs)]
    schema = "query_id int, rank int, title string, snippet string, url string, published_at string"
    got = {r.query_id: (r.sources, r.context) for r in E.context_budget(spark.createDataFrame([*rows, (1, 7, "out", "out", None, None)], schema)).collect()}
    assert got == {q: (len(xs), budgeted(xs)) for q, xs in cases.items()}
    assert max(len(got[q][1]) for q in (1, 2, 3, 4)) <= 3900
    assert E.context_budget(spark.createDataFrame([], schema)).collect() == []
