"""Numbers, money, durations and JSON in text; heads and tails; marked blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def usd(text: Column) -> Column:
    """The first dollar amount, thousands separators taken out; null if there is none."""
    found = F.regexp_extract(text, r"\$\s?([0-9][0-9,]*(?:\.[0-9]+)?)", 1)
    return F.regexp_replace(found, ",", "").try_cast("double")


def duration_days(text: Column) -> Column:
    """The first duration as days: days, weeks (7), months (30) or years (365)."""
    n = F.regexp_extract(F.lower(text), r"([0-9]+)\s*(day|week|month|year)s?\b", 1).try_cast("double")
    unit = F.regexp_extract(F.lower(text), r"([0-9]+)\s*(day|week|month|year)s?\b", 2)
    return n * F.when(unit == "day", 1).when(unit == "week", 7).when(unit == "month", 30).when(unit == "year", 365)


def whole_token(text: Column, term: str) -> Column:
    """Whether a term stands in a text with no word character on either side."""
    escaped = "".join("\\" + c if not c.isalnum() and c != "_" else c for c in term.lower())
    return F.lower(text).rlike(rf"(?<![a-z0-9_.%]){escaped}(?![a-z0-9_.%])")


def head_tail(text: Column, head: int, tail: int) -> Column:
    """Long texts as their first and last characters around a mark."""
    n = F.length(text)
    return F.when(n <= head + tail, text).otherwise(F.concat(F.substring(text, 1, head), F.lit(" ... "), F.substring(text, n - tail + 1, F.lit(tail))))


def marked_block(text: Column, name: str) -> Column:
    """What stands between the begin and end marks of a block; null without both."""
    found = F.regexp_extract(text, rf"(?s)<!-- begin {name} -->(.*?)<!-- end {name} -->", 1)
    return F.when(text.rlike(rf"(?s)<!-- begin {name} -->.*?<!-- end {name} -->"), F.trim(found))


def first_json(text: Column, schema: str) -> Column:
    """The first flat JSON object in a text."""
    return F.from_json(F.regexp_extract(text, r"\{[^{}]*\}", 0), schema)


def age_text(days: Column) -> Column:
    return F.when(days < 1, "today").when(days < 2, "yesterday").when(days < 7, F.concat(F.floor(days), F.lit(" days ago"))).when(days < 60, F.concat(F.floor(days / 7), F.lit(" weeks ago"))).otherwise(F.concat(F.floor(days / 30), F.lit(" months ago")))


def backoff(attempt: Column, base: float = 2.0, cap: float = 3600.0) -> Column:
    return F.least(F.pow(F.lit(base), attempt), F.lit(cap))
