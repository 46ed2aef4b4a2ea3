"""Text functions as column expressions, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import lexicon as X

def normalized_query(text: Column) -> Column:
    """Lower case, single spaces, at most 400 characters."""
    return F.substring(F.regexp_replace(F.trim(F.lower(text)), r"\s+", " "), 1, 400)


def tokens(text: Column) -> Column:
    """Lower-case words of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def focus_candidates(text: Column) -> Column:
    """Identifier-like words of three and more characters that are no stop words."""
    found = F.regexp_extract_all(text, F.lit(r"[a-zA-Z_][a-zA-Z0-9_.\-]*"), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) >= 3) & ~F.lower(t).isin(X.STOP_WORDS))


def salience(term: Column) -> Column:
    shaped = F.when(term.rlike(r"[_./\-0-9]"), 2).otherwise(0)
    return shaped + F.when(term.rlike("^[A-Z]"), 1).otherwise(0) + F.when(F.length(term) > 6, 1).otherwise(0)


def clean_html(html: Column) -> Column:
    """Tags become spaces, white space single."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), r"\s+", " "))


def file_refs(text: Column) -> Column:
    """Distinct path-like words, sorted: they hold a slash and more than two characters, edge punctuation taken off."""
    found = F.transform(F.regexp_extract_all(text, F.lit(X.FILE_REF), F.lit(0)), lambda r: F.regexp_replace(r, r"^[.,);\]]+|[.,);\]]+$", ""))
    return F.array_sort(F.array_distinct(F.filter(found, lambda r: F.contains(r, F.lit("/")) & (F.length(r) > 2))))


def entity_key(name: Column) -> Column:
    """Quotes around it, a leading article, a trailing possessive and edge punctuation off; lower case, single spaces."""
    quotes, strip = "[\"'`\u201c\u201d\u2018\u2019]", r"^\s+|\s+$"
    out = name
    for pattern in (strip, f"^{quotes}+|{quotes}+$", strip):
        out = F.regexp_replace(out, pattern, "")
    out = F.lower(out)
    for pattern in ("^(the |a |an )", "('s|\u2019s)$", "^[.,;:!?]+|[.,;:!?]+$", strip):
        out = F.regexp_replace(out, pattern, "")
    return F.regexp_replace(out, r"\s+", " ")


def entity_spans(text: Column) -> Column:
    """Keys of capitalized spans, cut to their first two words."""
    spans = F.regexp_extract_all(text, F.lit(r"[A-Z][a-zA-Z0-9]+(?:\s+[A-Z][a-zA-Z0-9]+)*"), F.lit(0))
    keys = F.transform(spans, lambda s: F.array_join(F.slice(F.split(entity_key(s), " "), 1, 2), " "))
    return F.array_distinct(F.filter(keys, lambda k: k != ""))


def error_type(text: Column) -> Column:
    """What the first pattern of the list that occurs matches, in lower case without colons and spaces."""
    out = F.lit("unknown")
    for pattern in reversed(X.ERRORS):
        found = F.regexp_extract(text, f"(?i){pattern}", 0)
        out = F.when(found != "", F.regexp_replace(F.lower(found), "[: ]", "")).otherwise(out)
    return out


def error_snippet(text: Column, before: int = 100, after: int = 500) -> Column:
    """The surroundings of the first error pattern of the list that occurs; empty without one."""
    out = F.lit("")
    for pattern in reversed(X.ERRORS):
        found = F.regexp_extract(text, f"(?i){pattern}", 0)
        at = F.instr(text, found)
        start = F.greatest(F.lit(1), at - before)
        out = F.when(found != "", F.substring(text, start, at + after - start)).otherwise(out)
    return out


def snippet(words: Column, terms: Column, width: int = 32) -> Column:
    """About ``width`` words around the first that is asked for, as text."""
    first = F.array_min(F.filter(F.transform(terms, lambda t: F.array_position(words, t)), lambda p: p > 0))
    start = F.greatest(F.lit(1), F.coalesce(first, F.lit(1)) - width // 2)
    return F.array_join(F.slice(words, start.cast("int"), width), " ")


def normalized_error(text: Column) -> Column:
    """Places, paths, addresses and large numbers as placeholders."""
    for pattern, by in X.ERROR_PARTS:
        text = F.regexp_replace(text, pattern, by)
    return text


def error_signature(text: Column) -> Column:
    """The type with the first two words of the normalized text."""
    words = F.regexp_extract(normalized_error(text), r"\w+(?:\s+\w+)?", 0)
    return F.when(words == "", error_type(text)).otherwise(F.concat_ws("-", error_type(text), words))


def claim_words(text: Column) -> Column:
    """Stemmed content words of a claim."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9][a-z0-9'\\-]*"), F.lit(0))
    return F.array_distinct(F.transform(F.filter(found, lambda t: ~t.isin(X.CLAIM_STOP + X.NEGATIONS)), stem_s))


def hard_values(text: Column) -> Column:
    """Numbers, amounts and dates, without thousands separators."""
    found = F.regexp_extract_all(text, F.lit(r"\d[\d,./:\-]*\d|\d"), F.lit(0))
    return F.array_distinct(F.filter(F.transform(found, lambda n: F.regexp_replace(F.replace(n, F.lit(","), F.lit("")), r"^[.:\-/]+|[.:\-/]+$", "")), lambda n: n != ""))


def negated(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9][a-z0-9'\\-]*"), F.lit(0))
    return F.arrays_overlap(found, F.array(*map(F.lit, X.NEGATIONS))) | F.contains(F.lower(text), F.lit("n't"))


def stem_s(token: Column) -> Column:
    return F.when((F.length(token) > 3) & token.endswith("s"), F.substring(token, F.lit(1), F.length(token) - 1)).otherwise(token)


def surprisal(df: Column, n: Column) -> Column:
    """Bits: -log2((df + 0.5) / (n + 1))."""
    return -F.log2((df + 0.5) / (n + 1))
