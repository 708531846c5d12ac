"""English stems for lexical search, by the suffix rules that M. F. Porter published in 1980."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from strataloom.functions.text import content_terms

#: Suffixes and what they become where at least one vowel-consonant pair stands before them.
SECOND = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate",
    "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
THIRD = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
#: Suffixes that go where at least two such pairs stand before them; ``ion`` only after s or t.
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """v for vowels, c for consonants; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short_end(stem: str) -> bool:
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    found = [s for s in suffixes if word.endswith(s)]
    return max(found, key=len) if found else None


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of two letters, and those with other characters than a to z, stay."""
    if len(word) <= 2 or not re.fullmatch("[a-z]+", word):
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for ending in ("ed", "ing"):
            base = word.removesuffix(ending)
            if base != word and "v" in _shape(base):
                if base.endswith(("at", "bl", "iz")):
                    base += "e"
                elif len(base) > 1 and base[-1] == base[-2] and _shape(base)[-1] == "c" and base[-1] not in "lsz":
                    base = base[:-1]
                elif _measure(base) == 1 and _short_end(base):
                    base += "e"
                word = base
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for table in (SECOND, THIRD):
        suffix = _longest(word, table)
        if suffix and _measure(word[: -len(suffix)]) > 0:
            word = word[: -len(suffix)] + table[suffix]
    suffix = _longest(word, FOURTH)
    if suffix:
        base = word[: -len(suffix)]
        if _measure(base) > 1 and (suffix != "ion" or base.endswith(("s", "t"))):
            word = base
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short_end(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def _stem_lists(terms: pd.Series) -> pd.Series:
    return terms.map(lambda ts: None if ts is None else [stem(t) for t in ts])


def stems(text: Column | str) -> Column:
    """Stems of the content terms of a text, in order."""
    return F.pandas_udf(_stem_lists, ArrayType(StringType()))(content_terms(text))
