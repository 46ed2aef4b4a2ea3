"""Dates told in text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names.
NAMES = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
MONTHS = [n[:3] for n in NAMES]
_MON = "(" + "|".join(NAMES + MONTHS) + ")"


def month_number(name: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(F.lower(name), 1, 3)).cast("int")


def parsed_epoch(ts: Column) -> Column:
    """Seconds of an ISO text of any precision; null if it can't be read."""
    return F.unix_micros(F.try_to_timestamp(ts)) / 1e6


def occurred_on(text: Column, created: Column) -> Column:
    """The first form that gives a day: ISO, Mon DD YYYY, DD Mon YYYY, Mon YYYY, then phrases relative to ``created``."""
    low = F.lower(text)
    part = lambda p, g: F.regexp_extract(low, p, g)
    iso, mdy, dmy, my, ago = r"\b(\d{4})-(\d{2})-(\d{2})\b", r"\b" + _MON + r"\s+(\d{1,2}),?\s+(\d{4})\b", r"\b(\d{1,2})\s+" + _MON + r"\s+(\d{4})\b", r"\b" + _MON + r"\s+(\d{4})\b", r"\b(\d+)\s+(day|week|month)s?\s+ago\b"
    num = lambda c: c.try_cast("int")
    made = lambda y, m, d: F.try_make_timestamp(num(y), m, num(d), F.lit(0), F.lit(0), F.lit(0)).cast("date")
    days = num(part(ago, 1)) * F.when(part(ago, 2) == "day", 1).when(part(ago, 2) == "week", 7).otherwise(30)
    return F.coalesce(
        F.when(low.rlike(iso), made(part(iso, 1), num(part(iso, 2)), part(iso, 3))),
        F.when(low.rlike(mdy), made(part(mdy, 3), month_number(part(mdy, 1)), part(mdy, 2))),
        F.when(low.rlike(dmy), made(part(dmy, 3), month_number(part(dmy, 2)), part(dmy, 1))),
        F.when(low.rlike(my), made(part(my, 2), month_number(part(my, 1)), F.lit("1"))),
        F.when(low.rlike(ago), F.date_sub(created, days)),
        F.when(F.contains(low, F.lit("yesterday")), F.date_sub(created, 1)),
        F.when(F.contains(low, F.lit("last week")), F.date_sub(created, 7)),
        F.when(F.contains(low, F.lit("last month")), F.date_sub(created, 30)),
        F.when(F.contains(low, F.lit("today")), created),
    )


def first_date(text: Column) -> Column:
    """The first day (dashes or slashes) or bare year in a text, as text."""
    p = r"\b(\d{4})[-/](\d{2})[-/](\d{2})\b|\b(?:19|20)\d{2}\b"
    found = F.regexp_extract(text, p, 0)
    return F.when(found != "", F.when(F.regexp_extract(text, p, 1) != "", F.replace(found, F.lit("/"), F.lit("-"))).otherwise(found))


def month_status(day: Column, year: int, month: int, unsure_days: int = 0) -> Column:
    """must, possible or outside: a date held to a month, with some days of doubt around it."""
    first = F.make_date(F.lit(year), F.lit(month), F.lit(1))
    last = F.last_day(first)
    inside = (day >= first) & (day <= last)
    return F.when(inside, "must").when((day >= F.date_sub(first, unsure_days)) & (day <= F.date_add(last, unsure_days)), "possible").otherwise("outside")
