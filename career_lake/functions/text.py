"""Column functions on text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGE = "[\\s\\u00a0\\u3000\\ufeff\\u2028\\u2029]+"


def trimmed(c: Column) -> Column:
    """Without white space (ASCII, no-break and ideographic) at the ends."""
    return F.regexp_replace(c, f"^{_EDGE}|{_EDGE}$", "")


def bounded(c: Column, most: int) -> Column:
    """Without control characters, trimmed, at most so many characters; null if nothing is left."""
    text = trimmed(F.regexp_replace(c.cast("string"), "[\\u0000-\\u0008\\u000B\\u000C\\u000E-\\u001F\\u007F]", ""))
    return F.nullif(F.substring(text, 1, most), F.lit(""))


def squeezed(c: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(c, "(?U)\\s+", "")


def first_rule(c: Column, rules: list[tuple[str, str]], other: Column) -> Column:
    """The label of the first (label, pattern) found in c, else other."""
    out = None
    for label, pattern in rules:
        out = F.when(c.rlike(pattern), label) if out is None else out.when(c.rlike(pattern), label)
    return out.otherwise(other)


def day(c: Column) -> Column:
    """An ISO text's date; null if there is none."""
    return F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd")


def half_up(c: Column) -> Column:
    """Rounded to whole numbers, halves towards plus infinity."""
    return F.floor(c + 0.5)


def lookup(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)
