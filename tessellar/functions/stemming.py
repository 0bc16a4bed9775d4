"""The Porter stemmer (M. F. Porter, An algorithm for suffix stripping, 1980) and the folding of accents."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The suffixes of the published steps, with what takes their place.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()

DOUBLE = re.compile(r"([^aeiou])\1$")


def shape(word: str) -> str:
    """v and c for vowels and consonants; y is a vowel after a consonant."""
    out = ""
    for i, letter in enumerate(word):
        out += "v" if letter in "aeiou" or letter == "y" and i and out[-1] == "c" else "c"
    return out


def measure(stem: str) -> int:
    return shape(stem).count("vc")


def has_vowel(stem: str) -> bool:
    return "v" in shape(stem)


def short_end(stem: str) -> bool:
    """Consonant, vowel, consonant at the end, the last none of w, x and y."""
    return shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _replace(word: str, table: dict[str, str], least: int) -> str:
    for suffix in sorted(table, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + table[suffix] if measure(stem) > least else word
    return word


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of up to two letters stay."""
    if len(word) < 3:
        return word
    w = word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    again = False
    if w.endswith("eed"):
        if measure(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and has_vowel(w[:-2]):
        w, again = w[:-2], True
    elif w.endswith("ing") and has_vowel(w[:-3]):
        w, again = w[:-3], True
    if again:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif DOUBLE.search(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif measure(w) == 1 and short_end(w):
            w += "e"
    if w.endswith("y") and has_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _replace(w, STEP_2, 0)
    w = _replace(w, STEP_3, 0)
    for suffix in sorted(STEP_4, key=len, reverse=True):
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            if measure(base) > 1 and (suffix != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e"):
        m = measure(w[:-1])
        if m > 1 or m == 1 and not short_end(w[:-1]):
            w = w[:-1]
    if w.endswith("ll") and measure(w[:-1]) > 1:
        w = w[:-1]
    return w


def fold(word: str) -> str:
    """Lower case without accents."""
    lowered = word.lower()
    if lowered.isascii():
        return lowered
    return "".join(c for c in unicodedata.normalize("NFD", lowered) if not unicodedata.combining(c))


def index_term(word: str) -> str:
    """What a word is indexed under."""
    return stem(fold(word))


@F.pandas_udf(StringType())
def index_terms(words: pd.Series) -> pd.Series:
    return words.map(lambda w: None if w is None else index_term(w))
