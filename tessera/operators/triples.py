"""Triples from memory texts by the patterns of their type."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import lexicon as X


def _group(text: Column, pattern: str, n: int) -> Column:
    if re.compile(pattern).groups < n:
        return F.lit("")
    return F.substring(F.trim(F.regexp_extract(text, "(?i)" + pattern, n)), 1, 80)


def _or(text: Column, other: str) -> Column:
    return F.when(text == "", other).otherwise(text)


def _first(text: Column, patterns: list[str], shape) -> Column:
    """The triple of the first pattern that fits, or null."""
    out = F.lit(None)
    for p in reversed(patterns):
        subject, predicate, obj = shape(_group(text, p, 1), _group(text, p, 2))
        out = F.when(text.rlike("(?i)" + p), F.struct(subject.alias("subject"), F.lit(predicate).alias("predicate"), obj.alias("object"))).otherwise(out)
    return out


def triples(memories: DataFrame, id_col: str, type_col: str, content_col: str, context_col: str | None = None) -> DataFrame:
    """(id, subject, predicate, object): what each memory's type finds in its content and context.

    A tool rule reads its context as JSON instead: what it fails for, and its fix.
    """
    context = F.coalesce(F.col(context_col), F.lit("")) if context_col else F.lit("")
    text = F.trim(F.concat_ws(" ", F.col(content_col), context))
    shapes = {
        "WORKING_SOLUTION": (X.SOLUTION, lambda a, b: (a, "solves", b)),
        "GOTCHA": (X.GOTCHA, lambda a, b: (a, "has_pitfall", _or(b, "warning"))),
        "PATTERN": (X.FOLLOWS, lambda a, b: (a, "follows_pattern", b)),
        "DECISION": (X.DECISION, lambda a, b: (F.lit("project"), "chose", F.when(b == "", a).otherwise(F.concat(a, F.lit(" ("), b, F.lit(")"))))),
        "FAILURE": (X.FAILURE, lambda a, b: (a, "fails_for", _or(b, "unknown reason"))),
        "PREFERENCE": (X.PREFERENCE, lambda a, b: (F.lit("user"), "prefers", a)),
    }
    one = F.lit(None)
    for kind, (patterns, shape) in shapes.items():
        one = F.when(F.col(type_col) == kind, _first(text, patterns, shape)).otherwise(one)
    rule = F.from_json(context, "tool string, pattern string, error_source string, correction string")
    named = F.substring(F.trim(F.concat_ws(" ", rule["tool"], rule["pattern"])), 1, 80)
    of_rule = lambda field, predicate: F.when((F.col(type_col) == "TOOL_RULE") & (F.coalesce(rule[field], F.lit("")) != ""), F.struct(named.alias("subject"), F.lit(predicate).alias("predicate"), F.substring(rule[field], 1, 80).alias("object")))
    found = F.array_compact(F.array(one, of_rule("error_source", "fails_for"), of_rule("correction", "has_fix")))
    return memories.select(F.col(id_col).alias("id"), F.explode(found).alias("t")).select("id", "t.*")
