"""Queries of facet windows, evidence excerpts and verified appendices, with oracle SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from career_lake import rules
from career_lake.operators import evidence as A
from career_lake.operators import excerpts as X
from career_lake.plans import queries_retrieval as QK
from career_lake.plans.bindings import VIEWS, oracle, view
from career_lake.sources import nested as S

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_MORE = "repeat('其他说明文字。', {n})"
_FILL = lambda k, n: _MORE.format(n=f"CAST(c_custkey % {k} * {n} AS INT)")

VIEWS |= {
    "evidence_v": f"""
SELECT c_custkey AS pair_id, CASE c_custkey % 6 WHEN 0 THEN '2027届毕业生学历要求、工作地点、报名截止时间和笔试时间？' WHEN 1 THEN '最多可应聘几个招聘单位，年龄要求多少岁，CET-4要求多少分' WHEN 2 THEN '薪酬福利' WHEN 3 THEN '有哪些岗位类别，怎么报名，报名时间何时截止' WHEN 4 THEN 'salary' ELSE '' END AS query,
 concat(CASE WHEN c_custkey % 5 = 0 THEN '首页  导航 收藏 ' ELSE '' END, c_name, '招聘公告\n面向高校毕业生。', {_FILL(5, 9)}, CASE WHEN c_custkey % 4 = 0 THEN ' … ' ELSE '' END, '一、学历要求：本科及以上学历可以应聘。', {_FILL(7, 6)}, '工作地点：', n_name, '、上海等城市的所属单位。', CASE WHEN c_custkey % 4 < 2 THEN ' …  ' ELSE '' END, {_FILL(3, 19)},
  '报名截止时间：', CAST(2025 + c_custkey % 3 AS STRING), '年', CAST(1 + c_custkey % 12 AS STRING), '月', CAST(1 + c_custkey % 28 AS STRING), '日', CASE WHEN c_custkey % 2 = 0 THEN '17:30' ELSE '' END, '。(1)投递方式：网申 www.example.com；每人限报1个岗位。', {_FILL(11, 5)}, '笔试时间另行通知，由各单位组织招聘笔试。', CASE WHEN c_custkey % 3 = 0 THEN '大学英语四级425分以上，或 cet-4 合格。' ELSE '' END, CASE WHEN c_custkey % 7 = 0 THEN ' … 岗位类别：技术类、市场类，报多方式见官网' ELSE '年龄要求：不超过35岁。' END,
  CASE WHEN c_custkey % 6 = 1 THEN '（责任编辑：某某）页脚文字' WHEN c_custkey % 6 = 2 THEN '网站声明：转载 … 薪酬福利：六险两金和人才公寓。' ELSE '' END) AS content,
 concat('https://h.example.com/', CASE WHEN c_custkey % 9 = 0 THEN 'index_2.html' ELSE CAST(c_custkey AS STRING) END) AS url, CASE WHEN c_custkey % 8 = 0 THEN '招聘 - 列表' ELSE c_name END AS title
FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey""",
}


def _add(name: str, f, sql: str, *views: str) -> None:  # noqa: ANN001
    QUERIES[name] = f
    ORACLES[name] = oracle(sql, *views)


_WS = QK._WS


def _words(ws: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in ws) + "]"


# ---- K08 -----------------------------------------------------------------


def _anchor(labels: list[str]) -> str:
    low = [x.lower() for x in labels]
    return f"CASE WHEN NOT ({' OR '.join(f'contains(shown, {chr(39)}{x}{chr(39)})' for x in low)}) THEN coalesce({', '.join(f'nullif(strpos(low, {chr(39)}{x}{chr(39)}), 0)' for x in low)}) - 1 END"


_ANCHORS = ", ".join(f"CASE WHEN regexp_matches(query, '{p}') THEN {_anchor(labels)} END" for p, labels in rules.QUERY_FACETS)


def _results(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "evidence_v").withColumn("snippet", F.expr("substring(content, 1, CAST(20 + pair_id % 900 AS INT))"))


_add(
    "k08_facet_windows",
    lambda s, d: X.facet_windows(_results(s, d)).select("pair_id", F.array_join(F.transform("facets", lambda x: x.cast("string")), ",").alias("facets"), F.array_join(F.transform("anchors", lambda x: x.cast("string")), ",").alias("anchors"), "merged_snippet"),
    f""", r AS (SELECT *, content[1:20 + pair_id % 900] AS snippet, trim(regexp_replace(content, '{_WS}', ' ', 'g')) AS t FROM evidence_v), p AS (SELECT *, snippet[1:700] AS primary_, lower(t) AS low, lower(snippet[1:700]) AS shown, length(t) AS n, 2500 - length(snippet[1:700]) - 3 AS most FROM r)
, a AS (SELECT *, list_sort(list_distinct(list_filter([{_ANCHORS}], lambda x: x IS NOT NULL))) AS anchors FROM p)
, g AS (SELECT *, greatest(96, greatest(1, (most - 3 * (greatest(1, least(len(anchors), 6)) - 1)) // greatest(1, least(len(anchors), 6))) // 2) AS gap FROM a)
, k AS (SELECT *, CASE WHEN len(anchors) = 0 THEN [] ELSE list_reduce(list_transform(anchors, lambda x: [x]), lambda u, v: CASE WHEN len(u) < 6 AND v[1] - u[len(u)] >= gap THEN list_concat(u, v) ELSE u END) END AS kept FROM g)
, e AS (SELECT *, greatest(1, (most - 3 * (greatest(1, len(kept)) - 1)) // greatest(1, len(kept))) AS each FROM k)
, w AS (SELECT *, list_transform(list_transform(kept, lambda x: greatest(0, least(n - each, x - least(72, each // 4)))), lambda st: concat(CASE WHEN st > 0 THEN '…' ELSE '' END, t[st + CASE WHEN st > 0 THEN 2 ELSE 1 END:st + each - CASE WHEN st + each < n THEN 1 ELSE 0 END], CASE WHEN st + each < n THEN '…' ELSE '' END)) AS windows FROM e)
SELECT pair_id, array_to_string(list_filter([{", ".join(f"CASE WHEN regexp_matches(query, '{p}') THEN {i} END" for i, (p, _) in enumerate(rules.QUERY_FACETS))}], lambda x: x IS NOT NULL), ',') AS facets, array_to_string(anchors, ',') AS anchors,
 CASE WHEN len(anchors) = 0 THEN snippet[1:2500] ELSE concat(primary_, ' … ', CASE WHEN n <= most THEN t ELSE array_to_string(windows, ' … ')[1:most] END)[1:2500] END AS merged_snippet FROM w""",
    "evidence_v",
)


# ---- A06 and A08 ---------------------------------------------------------


def _cleaned(src: str, out: str) -> str:
    """out: src(..., raw) with content, cleaned."""
    sql = f"""
, {out}_0 AS (SELECT *, trim(regexp_replace(regexp_replace(raw, '{_WS}', ' ', 'g'), '报多(方式|截止时间)', '报名\\1', 'g')) AS c FROM {src})
, {out}_1 AS (SELECT * REPLACE (CASE WHEN strpos(c, ' 收藏 ') BETWEEN 1 AND 500 THEN substring(c, strpos(c, ' 收藏 ') + 4) ELSE c END AS c) FROM {out}_0)"""
    for i, m in enumerate(rules.PAGE_ENDS):
        tail = f"substring(c, strpos(c, '{m}'))"
        sql += f"""
, {out}_{i + 2} AS (SELECT * REPLACE (CASE WHEN strpos(c, '{m}') <= 21 THEN c WHEN strpos({tail}, ' … ') > 1 THEN concat(c[1:strpos(c, '{m}') - 1], substring({tail}, strpos({tail}, ' … '))) ELSE c[1:strpos(c, '{m}') - 1] END AS c) FROM {out}_{i + 1})"""
    return sql + f"\n, {out} AS (SELECT * REPLACE (trim(c) AS c) FROM {out}_{len(rules.PAGE_ENDS) + 1})"


def _windows(src: str, out: str) -> str:
    """out: src(item, text, terms, most) with its window w."""
    return f"""
, {out}_o AS (SELECT item, unnest(string_split(text, t)) AS piece, t, generate_subscripts(string_split(text, t), 1) AS i, len(string_split(text, t)) AS m FROM (SELECT item, text, unnest(terms) AS t FROM {src} WHERE length(text) > most) WHERE length(t) >= 2)
, {out}_p AS (SELECT item, i, m, sum(length(piece) + length(t)) OVER (PARTITION BY item, t ORDER BY i) - length(t) AS pos FROM {out}_o)
, {out}_s AS (SELECT DISTINCT item, greatest(0, least(length(text) - most, CAST(pos AS BIGINT) - CAST(floor(most * CAST(0.28 AS DOUBLE)) AS BIGINT))) AS st FROM (SELECT item, pos FROM {out}_p WHERE i < m UNION ALL SELECT item, 0 FROM {src}) JOIN {src} USING (item) WHERE length(text) > most)
, {out}_k AS (SELECT item, st, coalesce(list_sum(list_transform(list_filter(terms, lambda t: contains(text[st + 1:st + most], t)), lambda t: 1000000 + length(t) * length(t))), 0) AS score FROM {out}_s JOIN {src} USING (item))
, {out}_b AS (SELECT item, st FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, st) AS r FROM {out}_k) WHERE r = 1)
, {out} AS (SELECT x.*, CASE WHEN st IS NULL THEN text ELSE concat(CASE WHEN st > 0 THEN '…' ELSE '' END, text[st + CASE WHEN st > 0 THEN 2 ELSE 1 END:st + most - CASE WHEN st + most < length(text) THEN 1 ELSE 0 END], CASE WHEN st + most < length(text) THEN '…' ELSE '' END) END AS w FROM {src} x LEFT JOIN {out}_b USING (item))"""


_GROUPS = ", ".join(f"({i}, '{p}', {_words(ws)})" for i, (p, ws) in enumerate(rules.EVIDENCE_FACETS))
_TERMS = f"list_concat(list_concat({QK._FAC}, list_transform(regexp_extract_all(query, '[A-Za-z0-9][A-Za-z0-9_.+-]{{1,39}}'), lambda x: lower(x))), flatten(list_transform(regexp_extract_all(query, '[\\x{{3400}}-\\x{{9fff}}]{{2,40}}'), lambda g: {QK._GR})))"
_LABELS = "|".join(sorted(rules.SENTENCE_LABELS, key=lambda x: -len(x)))
_CUT = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(c, '([。！？；;])', '\\1⟂', 'g'), '(\\(\\d+\\))', '⟂\\1', 'g'), '([一二三四五六七八九十]{{1,3}}、)', '⟂\\1', 'g'), '({_LABELS})', '⟂\\1', 'g')"


def excerpts_sql(src: str) -> str:
    """x(pair_id, excerpts) of src(pair_id, query, snippet)."""
    return (
        f"""
, q0 AS (SELECT pair_id, query, snippet AS raw, list_filter({_TERMS}, lambda x, i: list_position({_TERMS}, x) = i)[1:160] AS terms FROM {src})"""
        + _cleaned("q0", "q1")
        + f"""
, fg AS (SELECT pair_id, i, c AS text, words AS terms, 480 AS most, list_filter(words, lambda w: contains(c, w)) AS seen, concat(pair_id, ':f', i) AS item FROM q1 JOIN (VALUES {_GROUPS}) f(i, pat, words) ON regexp_matches(query, pat) WHERE len(list_filter(words, lambda w: contains(c, w))) > 0)"""
        + _windows("fg", "fw")
        + """
, rt AS (SELECT pair_id, i, text, w, arg_min(t, {'n': len(string_split(text, t)), 'l': -length(t), 'k': list_position(seen, t)}) AS term FROM (SELECT pair_id, i, text, w, seen, unnest(seen) AS t FROM fw) GROUP BY pair_id, i, text, w)
, rs AS (SELECT pair_id, i, text, [term] AS terms, 320 AS most, concat(pair_id, ':r', i) AS item FROM rt WHERE NOT contains(w, term))"""
        + _windows("rs", "rw")
        + f"""
, sp AS (SELECT *, list_filter(list_transform(string_split_regex(raw, '\\s+…\\s+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')[1:6] AS parts FROM q0)
, se0 AS (SELECT pair_id, terms, unnest(CASE WHEN len(parts) > 1 THEN parts ELSE [raw] END) AS raw, unnest(range(1, len(CASE WHEN len(parts) > 1 THEN parts ELSE [raw] END) + 1)) AS i FROM sp)"""
        + _cleaned("se0", "se")
        + f"""
, st0 AS (SELECT pair_id, i, c, terms, unnest(string_split({_CUT}, '⟂')) AS x, generate_subscripts(string_split({_CUT}, '⟂'), 1) AS k FROM se WHERE length(c) > 320)
, st1 AS (SELECT * REPLACE (trim(x) AS x) FROM st0 WHERE length(trim(x)) >= 12)
, st2 AS (SELECT *, coalesce(list_sum(list_transform(list_filter(terms, lambda t: contains(x, t)), lambda t: CASE WHEN list_contains({_words(rules.STRUCTURAL_LABELS)}, t) THEN 10000 ELSE length(t) * length(t) END)), 0) AS score FROM st1)
, st3 AS (SELECT *, row_number() OVER (PARTITION BY pair_id, i ORDER BY score DESC, k) AS r, count(*) OVER (PARTITION BY pair_id, i) AS n FROM st2)
, st4 AS (SELECT *, max(CASE WHEN r = 1 THEN length(x) END) OVER (PARTITION BY pair_id, i) AS l1, max(CASE WHEN r = 2 THEN length(x) END) OVER (PARTITION BY pair_id, i) AS l2 FROM st3)
, st5 AS (SELECT *, CASE WHEN n > 1 THEN 144 ELSE 320 END AS b1, CASE WHEN n > 2 THEN 96 ELSE 320 - least(l1, 144) END AS b2 FROM st4)
, si AS (SELECT pair_id, i, k, x AS text, terms, CASE r WHEN 1 THEN b1 WHEN 2 THEN b2 ELSE 320 - least(l1, b1) - least(l2, b2) END AS most, concat(pair_id, ':s', i, ':', k) AS item FROM st5 WHERE r = 1 OR (r <= 3 AND score > 0))"""
        + _windows("si", "sw")
        + """
, sj AS (SELECT pair_id, i, string_agg(w, ' ' ORDER BY k)[1:320] AS t FROM sw GROUP BY ALL)
, sx AS (SELECT pair_id, i, CASE WHEN length(c) <= 320 THEN c WHEN t IS NULL THEN concat(c[1:319], '…') WHEN length(t) < length(c) AND NOT regexp_matches(t, '[。！？]$') THEN concat(t[1:319], '…') ELSE t END AS w FROM se LEFT JOIN sj USING (pair_id, i))
, fo AS (SELECT pair_id, list([w] ORDER BY kind, i) AS l FROM (SELECT pair_id, 0 AS kind, i, w FROM fw UNION ALL SELECT pair_id, 1, i, w FROM rw UNION ALL SELECT pair_id, 2, i, w FROM sx) WHERE w <> '' GROUP BY 1)
, x AS (SELECT pair_id, list_reduce(l, lambda u, v: CASE WHEN len(u) < 6 AND len(list_filter(u, lambda k: contains(lower(k), lower(v[1])) OR contains(lower(v[1]), lower(k)))) = 0 THEN list_concat(u, v) ELSE u END) AS excerpts FROM fo)"""
    )


_add(
    "a06_evidence_excerpts",
    lambda s, d: X.evidence_excerpts(view(s, d, "evidence_v").withColumnRenamed("content", "snippet")).select("pair_id", F.size("excerpts").alias("n"), F.array_join("excerpts", "\n").alias("excerpts")),
    ", src AS (SELECT pair_id, query, content AS snippet FROM evidence_v)" + excerpts_sql("src") + " SELECT pair_id, CAST(len(excerpts) AS INT) AS n, array_to_string(excerpts, chr(10)) AS excerpts FROM x",
    "evidence_v",
)


def _answers(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Three evidence texts an answer; answers cite well, not at all, or beyond their sources."""
    e = view(s, d, "evidence_v").withColumn("answer_id", F.expr("pair_id - pair_id % 3"))
    k = F.col("answer_id")
    said = F.when(k % 5 == 0, "没有引用的回答").when(k % 5 == 1, "公告写明报名时间。[资料9]").when(k % 5 == 2, "根据资料1，公告写明报名时间。").otherwise(" 公告写明工作地点。[资料1][资料2]\n")
    a = e.groupBy("answer_id").agg(F.min_by("query", "pair_id").alias("query")).withColumns({
        "answer": said, "companies": F.when(k % 2 == 0, F.array(F.lit("甲"), F.lit("乙 "))).otherwise(F.array(F.lit("甲"), F.lit(" 甲"))), "job_titles": F.when(k % 7 == 0, F.array(F.lit("a"), F.lit("b"))), "valid_at": F.lit("2026-07-17"),
    })
    return a, e.select("answer_id", (F.col("pair_id") % 3 + 1).cast("int").alias("place"), "title", "url", F.col("content").alias("snippet"))


_DATES = " UNION ALL ".join(
    f"SELECT pair_id, {i} AS i, regexp_extract(c, '{p}', ['y', 'm', 'd', 'h', 'n']) AS g FROM dc WHERE regexp_matches(c, '{p}')" for i, p in enumerate(rules.EVIDENCE_DEADLINES)
)
_add(
    "a08_verified_appendix",
    lambda s, d: X.verified_appendix(*_answers(s, d)).withColumn("cited_sources", F.array_join(F.transform("cited_sources", lambda x: x.cast("string")), ",")),
    """, e AS (SELECT *, pair_id - pair_id % 3 AS answer_id, CAST(pair_id % 3 + 1 AS INT) AS place, starts_with(title, '招聘') OR regexp_matches(url, '/index(?:_[^/]*)?\\.html$') AS listing FROM evidence_v)
, an AS (SELECT answer_id, arg_min(query, pair_id) AS query, count(*) AS n_sources, CASE WHEN answer_id % 2 = 0 OR answer_id % 7 = 0 THEN 2 ELSE 1 END AS most, answer_id % 5 >= 2 AND (answer_id % 5 = 2 OR count(*) >= 2) AS grounded,
  CASE answer_id % 5 WHEN 0 THEN '没有引用的回答' WHEN 1 THEN '公告写明报名时间。[资料9]' WHEN 2 THEN '根据[资料1]，公告写明报名时间。' ELSE '公告写明工作地点。[资料1][资料2]' END AS answer, CASE answer_id % 5 WHEN 2 THEN [1] WHEN 3 THEN [1, 2] WHEN 4 THEN [1, 2] ELSE [] END AS cites FROM e GROUP BY answer_id)
, sel AS (SELECT * FROM (SELECT e.*, an.query AS asked, most, row_number() OVER (PARTITION BY answer_id ORDER BY listing, place) AS r, min(listing::INT) OVER (PARTITION BY answer_id) AS b FROM e JOIN an USING (answer_id)) WHERE r <= most AND listing::INT = b)
, src AS (SELECT pair_id, asked AS query, content AS snippet FROM sel)""" + excerpts_sql("src") + f"""
, dc AS (SELECT pair_id, c FROM q1), dd AS (SELECT pair_id, arg_min(g, i) AS g FROM ({_DATES}) GROUP BY 1)
, tl AS (SELECT pair_id, concat(g.y, '-', lpad(g.m, 2, '0'), '-', lpad(g.d, 2, '0')) AS day, concat(CAST(g.y AS INT), '年', CAST(g.m AS INT), '月', CAST(g.d AS INT), '日', CASE WHEN g.h <> '' THEN concat(g.h, ':', CASE WHEN g.n <> '' THEN g.n ELSE '00' END) ELSE '' END) AS told FROM dd)
, ln AS (SELECT answer_id, place, excerpts, CASE WHEN told IS NOT NULL THEN concat('- 时效核验：公告报名截止时间为', told, '；以2026-07-17为基准，', CASE WHEN day < '2026-07-17' THEN '已截止' ELSE '尚未到截止日' END, '。[资料', place, ']') END AS line FROM sel LEFT JOIN x USING (pair_id) LEFT JOIN tl USING (pair_id))
, ag AS (SELECT answer_id, flatten(list(list_transform(coalesce(excerpts, []), lambda v: concat('- ', v, ' [资料', place, ']')) ORDER BY place)) AS quotes, coalesce(list(line ORDER BY place) FILTER (line IS NOT NULL), []) AS lines, list_concat(coalesce(list(place ORDER BY place) FILTER (len(coalesce(excerpts, [])) > 0), []), coalesce(list(place ORDER BY place) FILTER (line IS NOT NULL), [])) AS own FROM ln GROUP BY 1)
, o AS (SELECT *, list_concat(quotes, lines) AS extra, CASE WHEN grounded THEN list_concat(cites, own) ELSE own END AS refs FROM an JOIN ag USING (answer_id))
SELECT answer_id, grounded, CASE WHEN NOT grounded THEN array_to_string(list_concat(['{X.EVIDENCE_ONLY}'], extra), chr(10)) WHEN len(extra) = 0 THEN answer ELSE array_to_string(list_concat([answer, '', '{X.APPENDIX}'], extra), chr(10)) END AS answer, array_to_string(list_filter(refs, lambda v, i: list_position(refs, v) = i), ',') AS cited_sources FROM o""",
    "evidence_v",
)


# ---- S05 and W01 ---------------------------------------------------------

VIEWS |= {
    "cases_v": """
SELECT CAST(c_custkey AS STRING) AS source, c_custkey AS k, CASE WHEN c_custkey % 13 = 0 THEN 'no json' WHEN c_custkey % 19 = 0 THEN '[]' ELSE translate(concat('⟨"version":"1","cases":[⟨"id":"', CASE WHEN c_custkey % 23 = 0 THEN ' ' ELSE CAST(c_custkey AS STRING) END,
 '","message":"m","profile":⟨"degreeLevel":"bachelor","graduationYear":', CASE WHEN c_custkey % 17 = 0 THEN '"soon"' ELSE CAST(2025 + c_custkey % 4 AS STRING) END, '⟩,"expectedStatus":200,"expectedAvailable":true,"expectedEvidenceRetrieved":', CASE WHEN c_custkey % 4 = 3 THEN 'false' ELSE 'true' END,
 ',"requiredCitationUrlIncludes":["/c', CAST(c_custkey % 3 AS STRING), '/"],"minimumCitationCount":', CAST(c_custkey % 3 AS STRING), ',"allowedCitationHosts":["h', CAST(c_custkey % 2 AS STRING), '.example.com","g.example.com"],"requiredAnswerTerms":["工作地点","', c_mktsegment, '"],"requiredAnswerAnyOf":[["甲","乙"],["投递","报名"]],"forbiddenAnswerTerms":["保证"],
"scopedClaimGuards":[⟨"subjectTerms":["甲计划","丙"],"claimTerm":"1次投递","requiredQualifierTerms":["未说明","仅乙"]⟩]⟩,⟨"id":"again"⟩,⟨"id":"again"⟩]⟩'), '⟨⟩', concat(chr(123), chr(125))) END AS text,
 CASE WHEN c_custkey % 11 = 0 THEN 500 ELSE 200 END AS status, c_custkey % 4 <> 3 AS evidence_retrieved, concat('工作地点：', c_mktsegment, CASE c_custkey % 5 WHEN 0 THEN '。甲计划只有1次投递机会[资料1]；乙另说' WHEN 1 THEN '；甲计划未说明1次投递。[资料2]' WHEN 2 THEN '，丙\n1次投递报名[资料3]' WHEN 3 THEN '保证投递，甲。' ELSE '。仅乙计划限1次投递，甲计划不限。[资料1][资料2]' END) AS answer,
 concat('https://h', CAST(c_custkey % 4 AS STRING), '.example.com/c', CAST(c_custkey % 6 AS STRING), '/a') AS url_1, CASE WHEN c_custkey % 8 = 0 THEN 'no url' ELSE 'https://G.example.com:443/c1/b' END AS url_2, CASE c_custkey % 3 WHEN 0 THEN 'x' WHEN 1 THEN 'x,y' ELSE 'y,z' END AS cited
FROM {customer}""",
}


def _cases(s: SparkSession, d: str) -> DataFrame:
    return S.parse_records(view(s, d, "cases_v").select("source", "text"), S.FACTUAL_CASE)


def _responses(s: SparkSession, d: str) -> DataFrame:
    cite = lambda i, u: F.struct(F.lit(i).alias("id"), F.col(u).alias("url"))
    return view(s, d, "cases_v").select(F.col("source").alias("case_id"), F.col("status").cast("int").alias("status"), F.lit(True).alias("available"), "evidence_retrieved", F.lit(None).cast("string").alias("error_code"), "answer", F.array(cite("x", "url_1"), cite("y", "url_2")).alias("citations"), F.split("cited", ",").alias("cited_ids"))


_JSON = """, ok AS (SELECT *, CAST(text AS JSON) AS j FROM cases_v WHERE k % 13 <> 0), c AS (SELECT ok.*, json_extract(j, '$.cases[0]') AS c FROM ok WHERE k % 19 <> 0)"""
_add(
    "s05_factual_cases",
    lambda s, d: _cases(s, d).select("source", "place", F.col("record.id").alias("id"), "rejected", F.col("record.profile.graduationYear").alias("year"), F.array_join("record.requiredAnswerTerms", ",").alias("required"), F.col("record.scopedClaimGuards")[0]["claimTerm"].alias("claim")),
    _JSON + """, r AS (SELECT source, unnest(range(0, CAST(json_array_length(j, '$.cases') AS BIGINT))) AS place, j FROM c), e AS (SELECT source, place, json_extract(j, concat('$.cases[', place, ']')) AS x FROM r)
, f AS (SELECT source, place, json_extract_string(x, '$.id') AS id, TRY_CAST(json_extract_string(x, '$.profile.graduationYear') AS INT) AS year, json_extract_string(x, '$.profile.graduationYear') AS year_text, array_to_string(CAST(json_extract(x, '$.requiredAnswerTerms') AS VARCHAR[]), ',') AS required, json_extract_string(x, '$.scopedClaimGuards[0].claimTerm') AS claim FROM e)
SELECT source, CAST(place AS INT) AS place, id, CASE WHEN year_text IS NOT NULL AND year IS NULL THEN 'shape' WHEN trim(id) = '' OR row_number() OVER (PARTITION BY source, id ORDER BY place) > 1 THEN 'id' END AS rejected, year, required, claim FROM f
UNION ALL SELECT source, 0, NULL, CASE WHEN k % 13 = 0 THEN 'format' ELSE 'empty' END, NULL, NULL, NULL FROM cases_v WHERE k % 13 = 0 OR k % 19 = 0""",
    "cases_v",
)
_LIST = lambda f: f"CAST(json_extract(c, '$.{f}') AS VARCHAR[])"
_add(
    "w01_factual_guards",
    lambda s, d: A.evaluate_facts(_cases(s, d).where("rejected is null and record.id <> 'again'").select("record.*"), _responses(s, d)).withColumn("failures", F.array_join("failures", "|")),
    _JSON + f""", b AS (SELECT source, k, c, status, evidence_retrieved, answer, string_split(cited, ',') AS cited, [{{'id': 'x', 'url': url_1}}, {{'id': 'y', 'url': url_2}}] AS cites, CAST(json_extract_string(c, '$.expectedEvidenceRetrieved') AS BOOLEAN) AS grounded, list_filter(list_transform(string_split_regex(answer, '[\\n。；;]'), lambda x: trim(x)), lambda x: x <> '') AS clauses,
 list_transform(regexp_extract_all(answer, '\\[资料(\\d+)\\]', 1), lambda x: CAST(x AS INT)) AS marks FROM c WHERE trim(json_extract_string(c, '$.id')) <> '' AND TRY_CAST(json_extract_string(c, '$.profile.graduationYear') AS INT) IS NOT NULL)
, u AS (SELECT *, list_filter(cites, lambda x: list_contains(cited, x.id)) AS used FROM b)
, f AS (SELECT source, flatten([
 CASE WHEN status <> CAST(json_extract(c, '$.expectedStatus') AS INT) THEN ['status'] ELSE [] END, CASE WHEN evidence_retrieved <> grounded THEN ['evidence_retrieved'] ELSE [] END,
 list_transform(list_filter({_LIST("requiredCitationUrlIncludes")}, lambda p: len(list_filter(used, lambda x: contains(x.url, p))) = 0), lambda p: concat('citation_url:', p)), CASE WHEN len(used) < CAST(json_extract(c, '$.minimumCitationCount') AS INT) THEN ['citation_count'] ELSE [] END,
 CASE WHEN len(list_filter(used, lambda x: NOT list_contains({_LIST("allowedCitationHosts")}, lower(regexp_extract(x.url, '^https?://([^/:]+)', 1))))) > 0 THEN ['citation_host'] ELSE [] END,
 list_transform(list_filter({_LIST("requiredAnswerTerms")}, lambda t: NOT contains(answer, t)), lambda t: concat('required_term:', t)),
 list_transform(list_filter(CAST(json_extract(c, '$.requiredAnswerAnyOf') AS VARCHAR[][]), lambda ts: len(list_filter(ts, lambda t: contains(answer, t))) = 0), lambda ts: concat('any_term:', array_to_string(ts, '/'))),
 list_transform(list_filter({_LIST("forbiddenAnswerTerms")}, lambda t: contains(answer, t)), lambda t: concat('forbidden_term:', t)),
 CASE WHEN len(list_filter(clauses, lambda s: len(list_filter({_LIST("scopedClaimGuards[0].subjectTerms")}, lambda t: contains(s, t))) > 0 AND contains(s, json_extract_string(c, '$.scopedClaimGuards[0].claimTerm')) AND len(list_filter({_LIST("scopedClaimGuards[0].requiredQualifierTerms")}, lambda t: contains(s, t))) = 0)) > 0 THEN [concat('scoped_claim:', json_extract_string(c, '$.scopedClaimGuards[0].claimTerm'))] ELSE [] END,
 CASE WHEN grounded AND len(marks) = 0 THEN ['no_marker'] ELSE [] END, CASE WHEN grounded THEN list_transform(list_filter(marks, lambda i: NOT coalesce(list_contains(cited, cites[i].id), false)), lambda i: concat('marker:', i)) ELSE [] END,
 CASE WHEN grounded THEN list_transform(list_filter(cited, lambda x: NOT list_contains(['x', 'y'], x)), lambda x: concat('cited_id:', x)) ELSE [] END]) AS failures FROM u) SELECT source AS case_id, array_to_string(failures, '|') AS failures, len(failures) = 0 AS passed FROM f""",
    "cases_v",
)
