"""The stemmer of Porter's 1980 paper, by its five steps of suffix rules."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The paper's suffixes and replacements of steps 2 to 4, in its order.
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)


def _shape(stem: str) -> str:
    """v and c for each letter; y is a vowel after a consonant."""
    out = ""
    for i, c in enumerate(stem):
        out += "v" if c in "aeiou" or (c == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _short_end(stem: str) -> bool:
    return len(stem) >= 3 and _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _double_end(stem: str) -> bool:
    return len(stem) >= 2 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c"


def _first_rule(word: str, rules) -> str:
    """The rule of the longest suffix that fits decides, whether or not its condition holds."""
    fits = [(s, r) for s, r in rules if word.endswith(s)]
    if not fits:
        return word
    suffix, replacement = max(fits, key=lambda rule: len(rule[0]))
    stem = word[: -len(suffix)]
    return stem + replacement if _measure(stem) > 0 else word


def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters stay."""
    if len(word) <= 2:
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        ending = next((e for e in ("ed", "ing") if word.endswith(e) and "v" in _shape(word[: -len(e)])), None)
        if ending:
            word = word[: -len(ending)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif _double_end(word) and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _short_end(word):
                word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _first_rule(_first_rule(word, STEP_2), STEP_3)
    fits = [s for s in STEP_4 if word.endswith(s)]
    if fits:
        base = word[: -len(max(fits, key=len))]
        if _measure(base) > 1 and (not word.endswith("ion") or base.endswith(("s", "t"))):
            word = base
    if word.endswith("e"):
        base = word[:-1]
        if _measure(base) > 1 or (_measure(base) == 1 and not _short_end(base)):
            word = base
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


@F.pandas_udf(T.ArrayType(T.StringType()))
def stem_all(words: pd.Series) -> pd.Series:
    """Stems of the words of each row; a word is stemmed once a batch."""
    known: dict[str, str] = {}

    def one(word: str) -> str:
        if word not in known:
            known[word] = stem(word)
        return known[word]

    return words.map(lambda row: None if row is None else [one(w) for w in row])
