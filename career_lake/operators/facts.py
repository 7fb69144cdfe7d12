"""Facts of announcements: facets, the fact table and differences between versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from career_lake import rules
from career_lake.functions.text import let
from career_lake.operators.fact_pieces import looked_up

_NONE = "array<string>"


def compact(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), f"[{rules.WHITE_SPACE}]+", " "))


def _all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def sentences(c: Column) -> Column:
    """The matches of rules.SENTENCE; its pattern is slow, so it reads only what is left long behind a plain split."""
    short = lambda p: (F.length(p) <= rules.SENTENCE_LENGTH) & ~p.contains("\n")
    pieces = F.filter(F.split(c, rules.SENTENCE_BREAK, -1), lambda p: ~p.isin("", *rules.SENTENCE_ENDS))
    return F.when(F.forall(pieces, short), pieces).otherwise(F.flatten(F.transform(pieces, lambda p: F.when(short(p), F.array(p)).otherwise(_all(p, rules.SENTENCE)))))


def clauses(c: Column, word: str) -> Column:
    """What full stops and semicolons part, where it matches word: patterns that cross neither need not read the rest."""
    return F.filter(F.split(c, "[。；;]", -1), lambda p: p.rlike(word))


def _sorted(c: Column) -> Column:
    return F.array_sort(F.array_distinct(c))


def _two(c: Column) -> Column:
    return F.lpad(c, 2, "0")


def _date(token: Column) -> Column:
    part = lambda g: F.regexp_extract(token, rules.FULL_DATE, g)
    return F.concat(part(1), F.lit("-"), _two(part(2)), F.lit("-"), _two(part(3)))


def _last_deadline(clause: Column) -> Column:
    """The last date of a clause, with its time; null if there is none.

    A date without a year takes that of the full date before it, if a range
    connector lies between and the month does not go back.
    """
    either = f"(?:{rules.FULL_DATE}|{rules.MONTH_DAY})"
    bridged = f"^.*{rules.FULL_DATE}(.*){rules.MONTH_DAY}"
    late = f"^{either}{rules.TIME_AFTER}"
    got = lambda g: F.regexp_extract(clause, bridged, g)

    def told(token: Column) -> Column:
        month, day = F.regexp_extract(token, rules.MONTH_DAY, 1), F.regexp_extract(token, rules.MONTH_DAY, 2)
        inherits = clause.rlike(bridged) & got(4).rlike(rules.RANGE) & (month.cast("int") >= got(2).cast("int"))
        short = F.concat(F.when(inherits, F.concat(got(1), F.lit("-"))).otherwise(F.lit("--")), _two(month), F.lit("-"), _two(day))
        minute = F.coalesce(F.nullif(F.regexp_extract(token, late, 7), F.lit("")), F.nullif(F.regexp_extract(token, late, 8), F.lit("")), F.lit("00"))
        time = F.when(token.rlike(late), F.concat(F.lit("T"), _two(F.regexp_extract(token, late, 6)), F.lit(":"), minute)).otherwise("")
        return F.when(token.isNotNull(), F.concat(F.when(token.rlike(f"^{rules.FULL_DATE}"), _date(token)).otherwise(short), time))

    return let(F.try_element_at(_all(clause, f"{either}(?:{rules.TIME_AFTER})?"), F.lit(-1)), told)


def deadlines(text: Column, lines: Column | None = None) -> Column:
    """last dates of clauses in deadline context; a dateless context clause lends its context to the next."""

    def of_sentence(s: Column) -> Column:
        start = F.struct(F.lit("").alias("pending"), F.array().cast(_NONE).alias("found"))

        def step(acc: Column, clause: Column) -> Column:
            def after(context: Column) -> Column:
                skip = ~context & (acc["pending"] == "")
                return F.when(skip, F.struct(F.lit("").alias("pending"), acc["found"].alias("found"))).otherwise(let(_last_deadline(clause), lambda date: dated(context, date)))

            def dated(context: Column, date: Column) -> Column:
                counts = F.concat(acc["pending"], clause).rlike(rules.SINGLE_DAY_CONTEXT) | clause.rlike(rules.RANGE)
                found = F.when(date.isNotNull() & counts, F.array_append(acc["found"], date)).otherwise(acc["found"])
                return F.struct(F.when(date.isNull() & context, clause).otherwise("").alias("pending"), found.alias("found"))

            return let(clause.rlike(rules.DEADLINE_CONTEXT), after)

        return F.aggregate(F.split(s, "[,，]"), start, step, lambda a: a["found"])

    return _sorted(F.flatten(F.transform(F.filter(sentences(text) if lines is None else lines, lambda s: s.rlike(rules.DEADLINE_CONTEXT)), of_sentence)))


def minimum_degree(text: Column, lines: Column | None = None) -> Column:
    """the lowest degree named in degree context."""

    def lowest(told: Column) -> Column:
        out = None
        for degree, pattern in rules.DEGREE_FACTS:
            has = told.rlike(pattern)
            out = F.when(has, degree) if out is None else out.when(has, degree)
        return out

    told = F.filter(sentences(text) if lines is None else lines, lambda s: s.rlike(rules.DEGREE_CONTEXT))
    return let(F.array_join(told, "\n"), lowest)


def graduation_years(text: Column, lines: Column | None = None) -> Column:
    """years before 届 in graduation context; both ends of a range."""
    told = F.filter(sentences(text) if lines is None else lines, lambda s: s.rlike(rules.GRADUATION_CONTEXT))
    years = F.flatten(F.transform(told, lambda s: F.concat(_all(s, rules.GRADUATION_YEAR, 1), _all(s, rules.GRADUATION_YEAR, 2))))
    return _sorted(F.filter(years, lambda y: y != ""))


def told_audiences(text: Column, lines: Column | None = None) -> Column:
    """the labels that sentences tell; matches of special graduates hide the general one."""

    def of_sentence(s: Column) -> Column:
        when = lambda c, *labels: F.when(c, F.array(*map(F.lit, labels))).otherwise(F.array().cast(_NONE))
        return let(s.rlike(rules.COMBINED), lambda combined: labels(s, combined, when))

    def labels(s: Column, combined: Column, when) -> Column:  # noqa: ANN001
        special = F.regexp_replace(s, rules.UNEMPLOYED, "□")
        special = F.when(combined, F.regexp_replace(special, rules.COMBINED, "□")).otherwise(F.regexp_replace(F.regexp_replace(special, rules.CURRENT, "□"), rules.PREVIOUS, "□"))
        return F.concat(
            when(s.rlike(rules.UNEMPLOYED), "未就业毕业生"), when(s.rlike(rules.OVERSEAS), "留学回国人员"), when(combined, "应届毕业生", "往届毕业生"),
            when(~combined & s.rlike(rules.CURRENT), "应届毕业生"), when(~combined & s.rlike(rules.PREVIOUS), "往届毕业生"), when(special.rlike(rules.GENERAL), "高校毕业生"),
            when(s.rlike("社会人员|面向社会(?:公开)?招聘|社会公开招聘|社会招聘|社招"), "社会人员"), when(s.rlike(rules.BOTH_SYSTEMS), "系统内人员", "系统外人员"),
            when(s.contains("系统内人员"), "系统内人员"), when(s.contains("系统外人员"), "系统外人员"), when(s.contains("在职人员"), "在职人员"), when(s.contains("退役军人"), "退役军人"),
        )

    return _sorted(F.flatten(F.transform(F.filter(sentences(text) if lines is None else lines, lambda s: s.rlike(rules.AUDIENCE_CONTEXT)), of_sentence)))


def or_title(found: Column, title: Column) -> Column:
    """Audiences that the text tells, else those of the title."""
    fallback = F.when(title.rlike("校园招聘|校招|高校毕业生招聘"), F.array(F.lit("高校毕业生"))).when(title.rlike("社会招聘|社招|面向社会公开招聘"), F.array(F.lit("社会人员"))).otherwise(F.array().cast(_NONE))
    return F.when(F.size(found) > 0, found).otherwise(fallback)


def audiences(title: Column, text: Column, lines: Column | None = None) -> Column:
    """labels of who may apply; matches of special graduates hide the general one; the title is the fallback."""
    return or_title(told_audiences(text, lines), title)


def application_limits(text: Column) -> Column:
    """numbers of applications that one person may make."""
    return F.array_sort(F.array_distinct(F.transform(F.concat(*(_all(text, p, 1) for p in rules.LIMITS)), lambda x: x.cast("int"))))


def _age_group(label: Column) -> Column:
    low = "职业学院|高职|大专|专科"
    return F.when(label.contains("本科") & label.rlike(low), "本科及职业学院").when(label.contains("博士"), "博士").when(label.contains("硕士"), "硕士").when(label.contains("本科"), "本科").when(label.rlike(low), "专科").otherwise("通用")


def age_requirements(text: Column) -> Column:
    """group=≤n or <n; the upper end of ranges."""
    def of(s: Column) -> Column:
        prefix = F.arrays_zip(*(_all(s, rules.AGE_PREFIX, g).alias(f"g{g}") for g in (1, 2, 3)))
        suffix = F.arrays_zip(*(_all(s, rules.AGE_SUFFIX, g).alias(f"g{g}") for g in (1, 2)))
        a = F.transform(prefix, lambda x: F.concat(_age_group(x["g1"]), F.lit("="), F.when(x["g2"].isin("不满", "未满"), "<").otherwise("≤"), x["g3"]))
        b = F.transform(suffix, lambda x: F.concat(_age_group(x["g1"]), F.lit("=≤"), x["g2"]))
        c = F.transform(_all(s, rules.AGE_RANGE, 1), lambda x: F.concat(F.lit("通用=≤"), x))
        return F.concat(a, b, c)

    return _sorted(F.flatten(F.transform(clauses(text, rules.AGE_CUE), of)))


def work_locations(text: Column) -> Column:
    """the sorted places of each labelled list."""

    def parted(word: str):  # noqa: ANN202
        def of(v: Column) -> Column:
            left, right = F.substring_index(v, word, 1), F.substring_index(v, word, -1)
            pair = (F.size(F.split(v, word)) == 2) & F.length(F.trim(left)).between(2, 12) & F.length(F.trim(right)).between(2, 12)
            return F.when(v.contains(word) & pair, F.concat(left, F.lit("、"), right)).otherwise(v)

        return of

    def place(p: Column) -> Column:
        p = F.regexp_replace(F.replace(p, F.lit(" "), F.lit("")), "^[：:。！？\\[\\]【】]+|[：:。！？\\[\\]【】]+$", "")
        return F.regexp_replace(F.regexp_replace(F.regexp_replace(p, "(?:等城市|等地|等)$", ""), rules.ADMIN_SUFFIX, ""), "市$", "")

    def told(good: Column) -> Column:
        return F.when(F.size(good) > 0, F.concat(F.lit("工作地点="), F.array_join(_sorted(good), "、")))

    def places(v: Column) -> Column:
        v = F.regexp_replace(F.regexp_replace(compact(v), rules.LOCATION_STOP, ""), "^[ ：:。！？；;,，、]+|[ ：:。！？；;,，、]+$", "")
        for word in ("和", "及"):
            v = let(v, parted(word))
        pieces = F.transform(F.split(v, "[,，、/／；;|｜]+"), place)
        return let(F.filter(pieces, lambda p: p.rlike("^[㐀-鿿A-Za-z·-]{1,18}$") & ~p.rlike("详见|为准|具体|根据|岗位|公司|单位")), told)

    return _sorted(F.array_compact(F.transform(_all(text, rules.LOCATION_LABEL, 1), places)))


_DIGITS = dict(zip("零〇一二两三四五六七八九", (0, 0, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9), strict=True))
_UNITS = {"十": 10, "百": 100, "千": 1000}


def chinese_number(c: Column) -> Column:
    """The value of Arabic digits or a Chinese numeral, 1 to 100,000; else null."""
    zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("section"), F.lit(0).alias("current"))
    digit = F.create_map(*(F.lit(x) for kv in _DIGITS.items() for x in kv))
    unit = F.create_map(*(F.lit(x) for kv in _UNITS.items() for x in kv))
    one = lambda x: F.when(x == 0, 1).otherwise(x)

    def step(a: Column, ch: Column) -> Column:
        d, u, wan = F.element_at(digit, ch), F.element_at(unit, ch), ch == "万"
        total = F.when(wan, a["total"] + one(a["section"] + a["current"]) * 10000).otherwise(a["total"])
        section = F.when(wan, 0).when(u.isNotNull(), a["section"] + one(a["current"]) * u).otherwise(a["section"])
        return F.struct(total.alias("total"), section.alias("section"), F.when(d.isNotNull(), d).otherwise(0).alias("current"))

    value = F.when(c.rlike("^\\d+$"), c.cast("int")).otherwise(F.aggregate(F.split(c, ""), zero, step, lambda a: a["total"] + a["section"] + a["current"]))
    return F.when(value.between(1, 100_000), value)


def headcounts(text: Column) -> Column:
    """numbers of people to recruit; a text part counts for the first pattern that has it."""

    def of(left: Column, patterns: list[str]) -> Column:
        """The numbers of the first pattern, then of the others in what it leaves."""
        first, rest = patterns[0], patterns[1:]
        found = _all(left, first, 1)
        return F.concat(found, let(F.regexp_replace(left, first, "□"), lambda x: of(x, rest))) if rest else found

    found = F.flatten(F.transform(clauses(text, rules.HEADCOUNT_CUE), lambda s: of(s, rules.HEADCOUNTS)))
    values = F.array_sort(F.array_compact(F.transform(found, chinese_number)))
    return F.transform(values, lambda n: F.concat(F.lit("招聘人数="), n.cast("string")))


def lifecycle(title: Column, text: Column) -> Column:
    """withdrawn, resumed, paused, delayed, corrected, from the title or the first 500 characters."""

    def status(name: str, p: str, head: Column, lead: Column) -> Column:
        words = rules.LIFECYCLE_WORDS[name]
        named = head.rlike(words) & head.rlike(p)
        if name == "withdrawn":
            named = named | (head.rlike(words) & ~head.rlike(rules.NEGATED_WITHDRAWAL) & head.rlike(rules.PARTIAL_TITLE))
        told = lead.rlike(words) & lead.rlike(rules.APPLIED_CORRECTION if name == "corrected" else p) & lead.rlike(rules.RECRUITMENT_CONTEXT)
        return F.when(named | told, name)

    found = lambda head, lead: F.array_compact(F.array(*(status(name, p, head, lead) for name, p in rules.LIFECYCLE.items())))
    some = "|".join(rules.LIFECYCLE_WORDS.values())  # no status is told without one of its words
    either = lambda head, lead: F.when(head.rlike(some) | lead.rlike(some), found(head, lead)).otherwise(F.array().cast(_NONE))
    return let(compact(title), lambda head: let(F.substring(text, 1, 500), lambda lead: either(head, lead)))


def _either_dates(c: Column) -> Column:
    """Full dates and dates without a year, in order."""
    short = lambda t: F.concat(F.lit("--"), _two(F.regexp_extract(t, rules.MONTH_DAY, 1)), F.lit("-"), _two(F.regexp_extract(t, rules.MONTH_DAY, 2)))
    return F.transform(_all(c, f"{rules.FULL_DATE}|{rules.MONTH_DAY}"), lambda t: F.when(t.rlike(f"^{rules.FULL_DATE}"), _date(t)).otherwise(short(t)))


def _first_label(c: Column, found: list[tuple[str, str]], other: str) -> Column:
    out = None
    for p, name in found:
        out = F.when(c.rlike(p), name) if out is None else out.when(c.rlike(p), name)
    return out.otherwise(other)


def graduation_dates(text: Column, lines: Column | None = None) -> Column:
    """scope:kind and the dates between, from or until which diplomas or their recognition count."""
    scope = lambda c: _first_label(F.translate(F.regexp_replace(c, " ", ""), "（）", "()"), rules.GRADUATION_SCOPES, "通用")

    def of_sentence(s: Column) -> Column:
        def of_clause(c: Column) -> Column:
            dates = F.transform(_all(c, rules.FULL_DATE), _date)
            kind = F.when(c.rlike(rules.CERTIFICATION), "认证").when(c.rlike(rules.GRADUATION_WORDS) | (s.contains("毕业生") & c.rlike(rules.DIPLOMA_WORDS)), "毕业")
            last = F.element_at(dates, -1)
            need = (
                F.when((F.size(dates) >= 2) & c.rlike(rules.RANGE), F.concat(F.lit("="), F.element_at(dates, 1), F.lit(".."), last))
                .when(c.rlike("不早于|以后|之后|起"), F.concat(F.lit("≥"), last)).when(c.rlike("不晚于|截至|截止|以前|之前|前"), F.concat(F.lit("≤"), last)).otherwise(F.concat(F.lit("="), last))
            )
            own = scope(c)
            return F.when(F.size(dates) > 0, F.concat(F.when(own == "通用", scope(s)).otherwise(own), F.lit(":"), kind, need))

        return F.transform(F.split(s, rules.GRADUATION_CLAUSE), of_clause)

    return _sorted(F.array_compact(F.flatten(F.transform(F.filter(sentences(text) if lines is None else lines, lambda s: s.rlike(rules.GRADUATION_DATE_CONTEXT)), of_sentence))))


def _assessment_types(c: Column) -> Column:
    named = F.array_compact(F.array(*(F.when(c.contains(w), w) for w in ("初选考试", "笔试", "面试", "测评"))))
    return F.when((F.size(named) == 0) & c.contains("考试"), F.array(F.lit("考试"))).otherwise(named)


def assessment_dates(text: Column, lines: Column | None = None) -> Column:
    """kind:certainty=date or range of tests and interviews; language tests, certificates and fees are none."""

    def of_clause(c: Column) -> Column:
        types, dates = _assessment_types(c), _either_dates(c)
        out = c.rlike(rules.ASSESSMENT_EXCLUSION) & ~c.rlike(rules.ASSESSMENT_EXPLICIT)
        unclear = (F.size(types) > 1) & (F.size(dates) > 1)
        sure = F.when(c.rlike("初定|暂定|拟于|计划于|预计"), ":暂定=").otherwise(":确定=")
        when = F.when((F.size(dates) >= 2) & c.rlike(rules.RANGE), F.array(F.concat(F.element_at(dates, 1), F.lit(".."), F.element_at(dates, -1)))).otherwise(dates)
        found = F.flatten(F.transform(types, lambda t: F.transform(when, lambda d: F.concat(t, sure, d))))
        return F.when(out | unclear | (F.size(dates) == 0), F.array().cast(_NONE)).otherwise(found)

    told = F.filter(sentences(text) if lines is None else lines, lambda s: s.rlike("笔试|面试|测评|考试") & s.rlike(rules.ASSESSMENT_CUE))
    return _sorted(F.flatten(F.flatten(F.transform(told, lambda s: F.transform(F.split(s, "[,，]"), of_clause)))))


def experience_requirements(text: Column) -> Column:
    """group=≥years; years that a degree's clause tells are none for all."""
    label = lambda c: _first_label(c, [("博士", "博士"), ("硕士", "硕士"), ("本科", "本科")], "专科")
    years = lambda c: F.when(chinese_number(c).between(1, 30), chinese_number(c).cast("string"))

    def of(s: Column) -> Column:
        grouped = F.transform(_all(s, rules.EXPERIENCE_GROUPED), lambda m: F.concat(label(m), F.lit("=≥"), years(F.regexp_extract(m, rules.EXPERIENCE_GROUPED, 2))))
        generic = lambda rest: F.concat(*(F.transform(_all(rest, p, 1), lambda y: F.concat(F.lit("通用=≥"), years(y))) for p in rules.EXPERIENCE_GENERIC))
        return F.concat(grouped, let(F.regexp_replace(s, rules.EXPERIENCE_GROUPED, "□"), generic))

    return _sorted(F.array_compact(F.flatten(F.transform(F.filter(clauses(text, rules.EXPERIENCE_CUE), lambda s: s.rlike(rules.EXPERIENCE_WORD)), of))))


def language_requirements(text: Column) -> Column:
    """group=CET4 or CET6, with the score where one from 300 to 710 is told."""

    def of(m: Column) -> Column:
        part = lambda g: F.regexp_extract(m, rules.LANGUAGE_LEVEL, g)
        level = F.when(part(2).contains("四") | part(2).rlike("4\\s*$"), "CET4").otherwise("CET6")
        score = F.regexp_extract(part(3), "\\d{3}", 0).try_cast("int")
        group = _first_label(part(1), [("博士", "博士"), ("硕士", "硕士"), ("本科", "本科"), ("研究生", "研究生")], "通用")
        return F.concat(group, F.lit("="), level, F.when(score.between(300, 710), F.concat(F.lit("≥"), score.cast("string"))).otherwise(""))

    # No match holds one of these marks, so the others of a text need not be read.
    parts = F.filter(F.split(text, "[。！？；;，、]", -1), lambda p: p.rlike(rules.LANGUAGE_WORD))
    found = F.flatten(F.transform(parts, lambda p: _all(p, rules.LANGUAGE_LEVEL)))
    return _sorted(F.transform(F.filter(found, lambda m: m.rlike(rules.LANGUAGE_CUE)), of))


def major_requirements(text: Column) -> Column:
    """label=majors, sorted; the usual labels count as 专业."""
    edge = lambda c, chars: F.regexp_replace(c, f"^[{chars}]+|[{chars}]+$", "")

    def of(p: str, category: bool, m: Column) -> Column:
        label, value = F.regexp_replace(F.regexp_extract(m, p, 1), " ", ""), compact(F.regexp_extract(m, p, 2))
        value = F.regexp_replace(F.regexp_replace(value, rules.MAJOR_STOP, ""), "^(?:为|包括|含|涵盖|如下)\\s*[:：]?\\s*", "")
        pieces = F.transform(F.split(edge(value, " ：:。！？；;,，、"), "[,，、/／；;|｜]+"), lambda x: edge(F.regexp_replace(x, " ", ""), " ：:。！？\\[\\]【】"))
        pieces = _sorted(F.filter(pieces, lambda x: x != ""))
        named = F.translate(label, "（）", "()")
        named = F.when(label.isin(rules.MAJOR_LABELS), "专业").otherwise(named)
        skip = label.isin(rules.MAJOR_LABELS) if category else F.lit(False)
        return F.when((F.size(pieces) > 0) & ~skip, F.concat(named, F.lit("="), F.array_join(pieces, "、")))

    kinds = ((rules.MAJOR_LABELED, False), (rules.MAJOR_GENERIC, False), (rules.MAJOR_CATEGORY, True))
    bind = lambda p, category: lambda m: of(p, category, m)
    found = [F.transform(_all(text, p), bind(p, category)) for p, category in kinds]
    return _sorted(F.array_compact(F.concat(*found)))


def spans(c: Column, pattern: str) -> Column:
    """The matches of a pattern with their places: array of (start, end, text), from 0."""
    found, between = _all(c, pattern), F.split(c, pattern, -1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + F.length(x["before"])
        end = start + F.length(x["text"])
        return F.struct(end.alias("at"), F.array_append(a["out"], F.struct(start.alias("start"), end.alias("end"), x["text"].alias("text"))).alias("out"))

    pairs = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("before"), found.alias("text"))
    return F.aggregate(pairs, zero, step, lambda a: a["out"])


def plain_address(c: Column) -> Column:
    """A web address without scheme, www, default port and tracking parameters; parameters sorted; null if it has no host."""
    scheme = F.when(c.rlike("(?i)^http://"), "http").otherwise("https")
    rest = F.regexp_replace(F.regexp_replace(F.trim(c), "(?i)^https?://", ""), "#.*$", "")
    authority, query = F.regexp_extract(rest, "^[^/?]*", 0), F.regexp_extract(rest, "\\?(.*)$", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(authority, ":\\d*$", "")), "\\.+$", ""), "^www\\.", "")
    port = F.regexp_extract(authority, ":(\\d+)$", 1)
    shown = F.when((port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")), "").otherwise(F.concat(F.lit(":"), port))
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/{2,}", "/"), "/+$", "")
    key = lambda p: F.lower(F.substring_index(p, "=", 1))
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~key(p).startswith("utm_") & ~key(p).isin(rules.IGNORED_PARAMETERS)))
    out = F.concat(host, shown, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
    return F.when(host.contains(".") & ~authority.contains("@"), out)


def application_channels(text: Column, lines: Column | None = None) -> Column:
    """addresses and mailboxes near words of application, or behind a login and before an application."""

    def of_sentence(s: Column) -> Column:
        cues = spans(s, rules.CHANNEL_CONTEXT)
        near = lambda t: F.exists(cues, lambda c: (F.abs(t["start"] - c["end"]) <= 100) | (F.abs(c["start"] - t["end"]) <= 40))
        mails = F.filter(spans(s, rules.EMAIL), near)
        before = lambda t: F.substring(s, F.greatest(F.lit(1), t["start"] - 23), F.least(t["start"], F.lit(24)))
        action = lambda t: before(t).rlike("(?:登录|访问|进入)[^。！？；;\\n]{0,8}$") & F.substring(s, t["end"] + 1, F.lit(30)).rlike("^[^。！？；;\\n]{0,20}(?:报名|投递|网申|申请)")
        free = lambda t: ~F.exists(mails, lambda m: (t["start"] < m["end"]) & (t["end"] > m["start"]))
        sites = F.filter(spans(s, rules.URL), lambda t: free(t) & (near(t) | action(t)))
        return F.concat(F.transform(mails, lambda m: F.concat(F.lit("邮箱="), F.lower(m["text"]))), F.transform(sites, lambda t: F.concat(F.lit("网址="), plain_address(t["text"]))))

    told = F.filter(sentences(text) if lines is None else lines, lambda s: s.rlike(rules.CHANNEL_CONTEXT) | s.rlike("报名|投递|网申|申请"))
    return _sorted(F.array_compact(F.flatten(F.transform(told, of_sentence))))


FACETS = [
    "deadlines", "minimum_degree", "graduation_years", "graduation_dates", "recruitment_audiences", "assessment_dates", "application_limits", "age_requirements",
    "experience_requirements", "language_requirements", "major_requirements", "work_locations", "recruitment_headcounts", "application_channels", "lifecycle",
]


def _text_facts(c: Column, raw: Column, lines: Column) -> dict[str, Column]:
    """The facets that a compact text, the raw one and the sentences tell; neither the title nor the lifecycle has a part in them."""
    none = F.array().cast(_NONE)
    facts = {
        "deadlines": deadlines(c, lines), "minimum_degree": let(minimum_degree(c, lines), lambda d: F.when(d.isNotNull(), F.array(d)).otherwise(none)), "graduation_years": graduation_years(c, lines), "graduation_dates": graduation_dates(c, lines), "recruitment_audiences": told_audiences(c, lines), "assessment_dates": assessment_dates(c, lines),
        "application_limits": F.transform(application_limits(c), lambda x: x.cast("string")), "age_requirements": age_requirements(c),
        "experience_requirements": experience_requirements(c), "language_requirements": language_requirements(c), "major_requirements": major_requirements(raw), "work_locations": work_locations(raw), "recruitment_headcounts": headcounts(c), "application_channels": application_channels(c, lines),
    }
    return {k: F.when(c.rlike(rules.FACET_GATES[k]), v).otherwise(none) if k in rules.FACET_GATES else v for k, v in facts.items()}


def with_facts(docs: DataFrame) -> DataFrame:
    """F16: docs(title, content, ...) with a struct of facets, each a sorted array of texts, and the length of the compact content.

    Tables are read twice: in large ones texts of frequent pieces look their facts
    up (fact_pieces); the others and those of streams are read by the patterns.
    """
    c, t, raw, lines, none = F.col("compact"), F.col("title"), F.col("content"), F.col("sentences"), F.array().cast(_NONE)
    looked = None if docs.isStreaming else looked_up(docs, lambda piece: _text_facts(piece, piece, sentences(piece)))
    if looked is None:
        docs = docs.withColumn("compact", compact(raw)).withColumn("sentences", sentences(c))
    else:
        known, life = F.col("looked.known"), F.col("looked.life")
        docs = docs.withColumn("looked", looked).withColumn("compact", F.when(~known | life, compact(raw))).withColumn("sentences", F.when(~known, sentences(c)))
    read = _text_facts(c, raw, lines)
    read = F.struct(*({**read, "recruitment_audiences": or_title(read["recruitment_audiences"], t), "lifecycle": lifecycle(t, c)}[f].alias(f) for f in FACETS))
    if looked is None:
        return docs.withColumn("facts", read).withColumn("compact_length", F.length("compact")).drop("compact", "sentences")
    found = {f: F.col(f"looked.{f}") for f in FACETS if f != "lifecycle"}
    found |= {"recruitment_audiences": or_title(found["recruitment_audiences"], t), "lifecycle": F.when(life, lifecycle(t, c)).otherwise(none)}
    docs = docs.withColumn("facts", F.when(known, F.struct(*(found[f].alias(f) for f in FACETS))).otherwise(read))
    return docs.withColumn("compact_length", F.when(known, F.col("looked.length")).otherwise(F.length("compact"))).drop("looked", "compact", "sentences")


def fact_table(docs: DataFrame) -> DataFrame:
    """F16: long table (document_id, version_id, facet, value)."""
    rows = F.array(*(F.struct(F.lit(f).alias("facet"), F.col(f"facts.{f}").alias("values")) for f in FACETS))
    return with_facts(docs).select("document_id", "version_id", F.explode(rows).alias("r")).select("document_id", "version_id", "r.facet", F.explode("r.values").alias("value"))


def fact_coverage(docs: DataFrame) -> DataFrame:
    """F16: by facet, how many versions have facts and how many facts there are; a version's facts are counted before they are dealt."""
    sizes = with_facts(docs).select("version_id", *(F.size(f"facts.{f}").cast("long").alias(f) for f in FACETS))
    each = sizes.groupBy("version_id").agg(*(F.sum(f).alias(f) for f in FACETS))
    total = each.agg(*(F.struct(F.lit(f).alias("facet"), F.count_if((F.col(f) > 0) & F.col("version_id").isNotNull()).alias("versions"), F.sum(f).alias("facts")).alias(f) for f in FACETS))
    return total.select(F.inline(F.array(*FACETS))).where("facts > 0")


CODES = {
    "deadlines": ("deadline_changed", True), "minimum_degree": ("minimum_degree_changed", False), "graduation_years": ("graduation_year_changed", False), "application_limits": ("application_limit_changed", False),
    "major_requirements": ("major_requirement_changed", True), "work_locations": ("work_location_changed", True), "recruitment_headcounts": ("recruitment_headcount_changed", True), "application_channels": ("application_channel_changed", True),
    "age_requirements": ("age_requirement_changed", True), "experience_requirements": ("experience_requirement_changed", True), "language_requirements": ("language_requirement_changed", True),
    "graduation_dates": ("graduation_date_requirement_changed", True), "recruitment_audiences": ("recruitment_audience_changed", True), "assessment_dates": ("assessment_date_changed", True),
}


def _regimes() -> tuple[Column, Column]:
    """Whether a text of n characters is enriched, or has lost too much, against one of m before it."""
    enriched = (F.col("m") < 240) & (F.col("n") >= 400) & (F.col("n") >= F.col("m") * 1.5)
    return enriched, (F.col("m") >= 500) & (F.col("n") < F.col("m") * 0.6) & ~enriched


def length_regimes(docs: DataFrame) -> DataFrame:
    """per version after the first, whether its text regressed or was enriched; lengths alone tell it, no facts."""
    w = Window.partitionBy("document_id").orderBy("version_no")
    d = docs.select("document_id", "version_id", "version_no", F.length(compact(F.col("content"))).alias("n")).withColumn("m", F.lag("n").over(w)).where("m is not null")
    enriched, regression = _regimes()
    return d.select("document_id", "version_id", enriched.alias("enriched"), regression.alias("regression"))


def version_diff(docs: DataFrame) -> DataFrame:
    """per version after the first, its reason codes against the one before.

    One window over the versions of a document; facts are extracted once. A
    column ocr_needs_review, if docs has one, gives ocr_quality_pending.
    """
    if "ocr_needs_review" not in docs.columns:
        docs = docs.withColumn("ocr_needs_review", F.lit(False))
    w = Window.partitionBy("document_id").orderBy("version_no")
    d = with_facts(docs).withColumnRenamed("compact_length", "n")
    d = d.select("document_id", "version_id", "version_no", "facts", "n", "ocr_needs_review", F.lag("facts").over(w).alias("old"), F.lag("n").over(w).alias("m")).where("m is not null")
    enriched, regression = _regimes()
    codes = [
        F.when(F.col("ocr_needs_review"), "ocr_quality_pending"),
        F.when(regression, "content_regression"),
        F.when((F.size("facts.lifecycle") > 0) & (F.col("facts.lifecycle") != F.col("old.lifecycle")), "lifecycle_changed"),
    ]
    for facet, (code, added) in CODES.items():
        new, old = F.col(f"facts.{facet}"), F.col(f"old.{facet}")
        has, had = F.size(new) > 0, F.size(old) > 0
        c = F.when(has & had & (new != old), code).when(had & ~has & (F.col("n") >= F.col("m") * 0.7) & ~enriched, f"{code}_removed")
        codes.append(c.when(has & ~had & ~enriched, f"{code}_added") if added else c)
    return d.select("document_id", "version_id", enriched.alias("enriched"), F.array_compact(F.array(*codes)).alias("reasons"))
