"""Porter's suffix stripping (M. F. Porter, 1980), as an Arrow UDF.

The job applies it to distinct words only and joins the stems back, so Python
sees the vocabulary and never the running text.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The suffix tables of the published algorithm, longest first
# where one rule hides another.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize",
    "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive",
    "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {
    "icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "",
    "ness": "",
}
STEP4 = (
    "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"
).split()

_C = "[^aeiou]"
_V = "[aeiouy]"
_CONS = f"{_C}[^aeiouy]*"
_VOWS = f"{_V}[aeiou]*"
_ONE_MORE = re.compile(f"^({_CONS})?{_VOWS}{_CONS}")
_EXACTLY_ONE = re.compile(f"^({_CONS})?{_VOWS}{_CONS}({_VOWS})?$")
_TWO_MORE = re.compile(f"^({_CONS})?{_VOWS}{_CONS}{_VOWS}{_CONS}")
_HAS_VOWEL = re.compile(f"^({_CONS})?{_V}")
_SHORT_END = re.compile(f"^{_CONS}{_V}[^aeiouwxy]$")


def _by_table(word: str, table: dict[str, str]) -> str:
    for suffix in sorted(table, key=len, reverse=True):
        if word.endswith(suffix):
            base = word[:-len(suffix)]
            return base + table[suffix] if _ONE_MORE.match(base) else word
    return word


def _inflections(word: str) -> str:
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        return word[:-1] if _ONE_MORE.match(word[:-3]) else word
    for suffix in ("ed", "ing"):
        base = word[:-len(suffix)]
        if word.endswith(suffix) and _HAS_VOWEL.match(base):
            if base.endswith(("at", "bl", "iz")):
                return base + "e"
            if len(base) > 1 and base[-1] == base[-2] and base[-1] not in "aeioulsz":
                return base[:-1]
            return base + "e" if _SHORT_END.match(base) else base
    return word


def _drop_suffix(word: str) -> str:
    for suffix in sorted(STEP4, key=len, reverse=True):
        if word.endswith(suffix):
            base = word[:-len(suffix)]
            if suffix == "ion" and not base.endswith(("s", "t")):
                return word
            return base if _TWO_MORE.match(base) else word
    return word


def stem(word: str) -> str:
    """Stem of one lower-case ASCII word; anything else is returned as it is."""
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    lead = word[0]
    w = "Y" + word[1:] if lead == "y" else word  # a leading y is a consonant
    w = _inflections(w)
    if w.endswith("y") and _HAS_VOWEL.match(w[:-1]):
        w = w[:-1] + "i"
    w = _drop_suffix(_by_table(_by_table(w, STEP2), STEP3))
    if w.endswith("e"):
        base = w[:-1]
        if _TWO_MORE.match(base) or (_EXACTLY_ONE.match(base) and not _SHORT_END.match(base)):
            w = base
    if w.endswith("ll") and _TWO_MORE.match(w):
        w = w[:-1]
    return w.lower()


@F.pandas_udf(T.StringType())
def stem_column(words: pd.Series) -> pd.Series:
    return words.map(stem)


def stemmed(tokens: DataFrame, column: str = "token") -> DataFrame:
    """``tokens`` with ``column`` replaced by its stem, via the vocabulary."""
    vocabulary = tokens.select(column).distinct().withColumn("_stem", stem_column(column))
    return tokens.join(vocabulary, column).drop(column).withColumnRenamed("_stem", column)
