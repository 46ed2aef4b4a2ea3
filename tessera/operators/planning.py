"""What a question wants: its intents, the plan that follows, and whether it needs memory at all."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import lexicon as X

# Mode to (similarity floor, rows wanted, candidate pool).
PLANS = {"count": (0.35, 40, 80), "aggregation": (0.35, 80, 80), "broad": (0.28, 8, 40), "precise": (0.35, 3, 20)}


_WORD = "[A-Za-z0-9_]"
_SPACE = r"\t\n\f\r "
#: What means the same in every version of Java: words, spaces and digits are ASCII, a dot is all but a line feed, the end is the very end.
PLAIN = {r"\b": f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))", r"\s": f"[{_SPACE}]", r"\w": _WORD, r"\d": "[0-9]", "$": r"\z", ".": r"[^\n]"}
#: Letters beyond ASCII that differ from an ASCII one by case alone.
FOLDS = {"s": "\u017f", "k": "\u212a"}


def plain(pattern: str) -> str:
    """The pattern with words, spaces and case as RE2 has them, where accented letters are none of a word's."""
    out, in_class = [], False
    for part in re.findall(r"\\.|.", pattern, re.S):
        if in_class:
            out.append({r"\s": _SPACE}.get(part, part + FOLDS.get(part.lower(), "")))
            in_class = part != "]"
        else:
            out.append(f"[{part}{FOLDS[part.lower()]}]" if part.lower() in FOLDS else PLAIN.get(part, part))
            in_class = part == "["
    return "".join(out)


def has(text: Column, pattern: str) -> Column:
    return text.rlike("(?i)" + plain(pattern))


def intents(text: Column) -> dict[str, Column]:
    return {
        "broad": has(text, X.BROAD),
        "counting": has(text, X.COUNT) & ~has(text, X.COUNT_NOT),
        "aggregating": has(text, X.AGGREGATE) & ~has(text, X.AGGREGATE_NOT),
        "current_value": has(text, X.CURRENT),
    }


def plan_columns(text: Column) -> list[Column]:
    """mode, k, pool, floor; counting decides before aggregating, that before broad. A broad question's floor stays low."""
    i = intents(text)

    def ladder(pick):
        return F.when(i["counting"], pick("count")).when(i["aggregating"], pick("aggregation")).when(i["broad"], pick("broad")).otherwise(pick("precise"))

    floor = F.when(i["broad"], PLANS["broad"][0]).otherwise(PLANS["precise"][0])
    return [ladder(F.lit).alias("mode"), ladder(lambda m: F.lit(PLANS[m][1])).alias("k"), ladder(lambda m: F.lit(PLANS[m][2])).alias("pool"), floor.alias("floor")]


def triage(text: Column) -> Column:
    """recall, skip or uncertain: narrow self-contained prompts are skipped, cues of memory come first."""
    t = F.regexp_replace(F.regexp_replace(text, f"[{_SPACE}]+", " "), r"^\p{Zs}+|\p{Zs}+\z", "")
    return (
        F.when(t == "", "skip")
        .when(has(t, X.NEEDS_MEMORY), "recall")
        .when(has(t, X.ACKNOWLEDGED), "skip")
        .when(has(t, X.ASKS_TIME), "skip")
        .when(has(t, X.SELF_CONTAINED) & (F.length(t) < 400), "skip")
        .otherwise("uncertain")
    )
