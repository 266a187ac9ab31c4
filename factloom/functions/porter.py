"""Porter stemming (M. F. Porter, 1980) of single tokens.

Spark has no stemmer. It is applied to the distinct vocabulary only, as one
Arrow-batched UDF; token occurrences never leave the JVM.
"""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Tokens outside these lengths (in UTF-8 bytes) are left alone.
MIN_LENGTH, MAX_LENGTH = 3, 64

# Suffix rules of steps 2, 3 and 4 of the published algorithm.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize",
    "logi": "log", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive",
    "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {
    "icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": "",
}
STEP4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
    "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)


def _shape(stem: str) -> str:
    """One letter per character: v for vowel, c for consonant (y depends on what precedes it)."""
    out = ""
    for ch in stem:
        vowel = ch in "aeiou" or (ch == "y" and out[-1:] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _ends_cvc(stem: str) -> bool:
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _double_consonant(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and stem[-1] not in "aeiou"


def _replace_longest(word: str, rules: dict[str, str]) -> str:
    for suffix in sorted(rules, key=len, reverse=True):
        if word.endswith(suffix) and len(word) > len(suffix):
            stem = word[: -len(suffix)]
            return stem + rules[suffix] if _measure(stem) > 0 else word
    return word


def _plural(word: str) -> str:
    if word.endswith("ss") or not word.endswith("s"):
        return word
    if (word.endswith("sses") and len(word) > 4) or (word.endswith("ies") and len(word) > 3):
        return word[:-2]
    return word[:-1]


def _past(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for suffix in ("ing", "ed"):
        stem = word[: -len(suffix)]
        if word.endswith(suffix):
            if "v" not in _shape(stem):
                return word
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if _double_consonant(stem) and stem[-1] not in "lsz":
                return stem[:-1]
            if _measure(stem) == 1 and _ends_cvc(stem):
                return stem + "e"
            return stem
    return word


def _final_suffix(word: str) -> str:
    for suffix in sorted(STEP4, key=len, reverse=True):
        if word.endswith(suffix) and len(word) > len(suffix):
            stem = word[: -len(suffix)]
            if suffix == "ion" and stem[-1] not in "st":
                return word
            return stem if _measure(stem) > 1 else word
    return word


def stem(token: str) -> str:
    """Stem one folded token."""
    raw = token.encode("utf-8")
    if not MIN_LENGTH <= len(raw) <= MAX_LENGTH:
        return token
    # Letters outside ASCII count as that many consonants, one per byte.
    word = raw.decode("latin-1")
    word = _past(_plural(word))
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replace_longest(word, STEP2)
    word = _replace_longest(word, STEP3)
    word = _final_suffix(word)
    if word.endswith("e"):
        base = word[:-1]
        if _measure(base) > 1 or (_measure(base) == 1 and not _ends_cvc(base)):
            word = base
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word.encode("latin-1").decode("utf-8")


@F.pandas_udf(T.StringType())
def stem_udf(words: pd.Series) -> pd.Series:
    return words.map(stem, na_action="ignore")
