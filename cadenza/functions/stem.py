"""The stemmer of Porter (1980), and a vectorised form for distinct words."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Suffix rules of steps 2, 3 and 4, longest match first within a step.
STEP_2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """A c or v for each letter; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _cvc(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def stem(word: str) -> str:
    if len(word) < 3 or not word.isascii():
        return word
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(end):
            word = word.removesuffix(end) + new
            break
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        end = next((e for e in ("ed", "ing") if word.endswith(e) and "v" in _shape(word.removesuffix(e))), None)
        if end:
            word = word.removesuffix(end)
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif _double(word) and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _cvc(word):
                word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for rules in (STEP_2, STEP_3):
        for end, new in sorted(rules, key=lambda r: -len(r[0])):
            if word.endswith(end):
                if _measure(word.removesuffix(end)) > 0:
                    word = word.removesuffix(end) + new
                break
    for end in sorted(STEP_4, key=len, reverse=True):
        if word.endswith(end):
            rest = word.removesuffix(end)
            if _measure(rest) > 1 and (end != "ion" or rest.endswith(("s", "t"))):
                word = rest
            break
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _cvc(word[:-1])):
            word = word[:-1]
    if _measure(word) > 1 and _double(word) and word.endswith("l"):
        word = word[:-1]
    return word


@F.pandas_udf(StringType())
def stem_column(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
    known: dict[str, str] = {}
    for w in words:
        for x in w.unique():
            if x is not None and x not in known:
                known[x] = stem(x)
        yield w.map(known)
