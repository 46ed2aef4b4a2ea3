"""Filters of retrieved rows: inline grammar, scopes, gates, budgets and time windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The keys of the inline grammar; the first two narrow the search itself, the others what it found.
SEARCH_KEYS, RESULT_KEYS = ("type", "project"), ("after", "before", "tag", "path", "symbol")
_INLINE = rf"(?i)({'|'.join(SEARCH_KEYS + RESULT_KEYS)}):(\"[^\"]+\"|'[^']+'|\S+)"


def inline_filters(text: Column) -> tuple[Column, Column]:
    """A question without its ``key:value`` parts, and those parts as an array of (key, value) structs.

    Keys are in any case, values in quotes or without; the last of equal keys counts. A
    question of nothing else stays whole.
    """
    keys = F.transform(F.regexp_extract_all(text, F.lit(_INLINE), F.lit(1)), F.lower)
    values = F.transform(F.regexp_extract_all(text, F.lit(_INLINE), F.lit(2)), lambda v: F.regexp_replace(v, "^([\"'])(.+)\\1$", "$2"))
    parts = F.zip_with(keys, values, lambda k, v: F.struct(k.alias("key"), v.alias("value")))
    last = F.filter(parts, lambda p, i: ~F.exists(F.slice(parts, i + 2, F.size(parts)), lambda q: q["key"] == p["key"]))
    rest = F.trim(F.regexp_replace(F.regexp_replace(text, _INLINE, " "), r"\s+", " "))
    return F.when(rest == "", text).otherwise(rest), last


def allowed(parts: Column, keys: tuple[str, ...], content: Column, created: Column, type_: Column, project: Column, tags: Column | None = None) -> Column:
    """Whether a row passes all (key, value) parts of these keys; types are told in any case, several by commas; rows without a creation date pass date bounds."""
    day = F.coalesce(F.date_format(created, "yyyy-MM-dd"), F.lit(""))

    def passes(p: Column) -> Column:
        value, low = p["value"], F.lower(p["value"])
        types = F.filter(F.transform(F.split(F.upper(value), ","), lambda t: F.trim(t)), lambda t: t != "")
        one = {
            "type": F.array_contains(types, type_),
            "project": project == value,
            "after": (day == "") | (day >= value),
            "before": (day == "") | (day <= value),
            "tag": F.array_contains(F.transform(tags, F.lower), low) if tags is not None else F.lit(False),
        }
        out = F.contains(F.lower(content), low)
        for key, ok in one.items():
            out = F.when(p["key"] == key, ok).otherwise(out)
        return ~p["key"].isin(*keys) | out

    return F.forall(parts, lambda p: F.coalesce(passes(p), F.lit(False)))


def fresh_name(name: str, columns: list[str]) -> str:
    """A column name that none of ``columns`` has, in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def in_scope(project: Column, scopes: list[str], include_global: bool = True) -> Column:
    inside = project.isin(scopes)
    return inside | (project == "") if include_global else inside


def rejection_gate(ranked: DataFrame, threshold: float, query: str = "query_id", rank: str = "rank", score: str = "score") -> DataFrame:
    """All rows of a query go if the score of its first row is under the threshold."""
    good = ranked.groupBy(query).agg(F.min_by(score, rank).alias("top")).where(F.col("top") >= threshold).select(query)
    return ranked.join(good, query, "left_semi").select(*ranked.columns)


def within_budget(ranked: DataFrame, budget: int, length: Column, query: str = "query_id", rank: str = "rank") -> DataFrame:
    """The longest prefix whose cost, a quarter of the characters and at least 1 each, fits; the first row stays."""
    w = Window.partitionBy(query).orderBy(rank)
    cost = F.greatest(F.lit(1), F.floor(length / 4)).cast("long")
    out = ranked.withColumn("cost", cost).withColumn("total", F.sum("cost").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__n", F.row_number().over(w))
    return out.where((F.col("__n") == 1) | (F.col("total") <= budget)).drop("__n")


def not_dormant(rows: DataFrame, usage: DataFrame, key: str = "id") -> DataFrame:
    """Rows without a usage row stay."""
    return rows.join(usage.where("dormant").select(F.col("memory_id").alias(key)), key, "left_anti")


def as_of(edges: DataFrame, at: str | None = None, include_expired: bool = False, since: str | None = None, until: str | None = None) -> DataFrame:
    """Belief at a time (or only open beliefs), and inclusive event-time bounds that drop undated rows."""
    if at is not None:
        t = F.lit(at).cast("timestamp")
        edges = edges.where((F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (t < F.col("valid_to"))))
    elif not include_expired:
        edges = edges.where("valid_to is null")
    if since is not None:
        edges = edges.where(F.col("occurred_at") >= F.lit(since).cast("timestamp"))
    if until is not None:
        edges = edges.where(F.col("occurred_at") <= F.lit(until).cast("timestamp"))
    return edges


def fresh(ts: Column, now: Column, days: float) -> Column:
    """Missing times count as fresh."""
    return ts.isNull() | (F.unix_micros(now) - F.unix_micros(ts) <= days * 86400e6)
