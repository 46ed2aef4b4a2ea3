"""The Porter stemmer (M. F. Porter, 1980), for keyword search over stems."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOWELS = frozenset("aeiou")

# The suffix tables of the published algorithm, steps 2 to 4.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _kinds(word: str) -> str:
    """c or v for each letter; y is a vowel after a consonant."""
    out = ""
    for i, c in enumerate(word):
        out += "v" if c in VOWELS or (c == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(word: str) -> int:
    return _kinds(word).count("vc")


def _short(word: str) -> bool:
    return len(word) >= 3 and _kinds(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _double(word: str) -> bool:
    return len(word) >= 2 and word[-1] == word[-2] and _kinds(word)[-1] == "c"


def _swap(word: str, table: dict[str, str], least: int) -> str:
    for suffix in sorted(table, key=len, reverse=True):
        if word.endswith(suffix):
            base = word[: -len(suffix)]
            return base + table[suffix] if _measure(base) > least else word
    return word


@lru_cache(200_000)
def stem(word: str) -> str:
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    if word.endswith("s"):
        word = word[:-2] if word.endswith(("sses", "ies")) else word if word.endswith("ss") else word[:-1]
    cut = None
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    elif word.endswith("ed") and "v" in _kinds(word[:-2]):
        cut = word[:-2]
    elif word.endswith("ing") and "v" in _kinds(word[:-3]):
        cut = word[:-3]
    if cut is not None:
        if cut.endswith(("at", "bl", "iz")) or (_measure(cut) == 1 and _short(cut)):
            word = cut + "e"
        elif _double(cut) and cut[-1] not in "lsz":
            word = cut[:-1]
        else:
            word = cut
    if word.endswith("y") and "v" in _kinds(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(word, STEP2, 0)
    word = _swap(word, STEP3, 0)
    for suffix in sorted(STEP4, key=len, reverse=True):
        if word.endswith(suffix):
            base = word[: -len(suffix)]
            if _measure(base) > 1 and (suffix != "ion" or base.endswith(("s", "t"))):
                word = base
            break
    if word.endswith("e"):
        base = word[:-1]
        if _measure(base) > 1 or (_measure(base) == 1 and not _short(base)):
            word = base
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def remembered(size: int = 200_000):
    """``stem`` with a memory of bounded size."""
    memory: dict[str, str] = {}

    def of(word: str) -> str:
        got = memory.get(word)
        if got is None:
            got = stem(word)
            if len(word) <= 64:
                if len(memory) >= size:
                    memory.clear()
                memory[word] = got
        return got

    return of


def stems(text: Column) -> Column:
    """Stemmed lower-case words."""

    @F.pandas_udf("array<string>")
    def each(words: pd.Series) -> pd.Series:
        of = remembered()
        return words.map(lambda ws: None if ws is None else [of(w) for w in ws])

    return each(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))
