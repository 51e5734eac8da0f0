"""English suffix stemming (Porter, 1980) as an Arrow function over token arrays."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# The suffix tables of the published algorithm.
STEP2 = dict(ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", abli="able", alli="al", entli="ent", eli="e", ousli="ous", ization="ize", ation="ate", ator="ate", alism="al", iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble")
STEP3 = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _shape(word: str) -> str:
    """c and v for each letter; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or ch == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c", _shape(stem)))


def _cvc(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _replace(word: str, table: dict[str, str], least: int) -> str:
    for suffix in sorted(table, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + table[suffix] if _measure(stem) > least else word
    return word


def stem(word: str) -> str:
    w = word
    if len(w) < 3:
        return w
    for suffix, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(suffix):
            w = w[: len(w) - len(suffix)] + new
            break
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for suffix in ("ed", "ing"):
            if w.endswith(suffix):
                base = w[: -len(suffix)]
                if "v" in _shape(base):
                    w = base
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                        w = w[:-1]
                    elif _measure(w) == 1 and _cvc(w):
                        w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _replace(w, STEP2, 0)
    w = _replace(w, STEP3, 0)
    for suffix in sorted(STEP4, key=len, reverse=True):
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            if _measure(base) > 1 and (suffix != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _cvc(w[:-1]):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(ArrayType(StringType()))
def _stems(words: pd.Series) -> pd.Series:
    memo: dict[str, str] = {}
    return words.map(lambda ws: None if ws is None else [memo.setdefault(w, stem(w)) if w not in memo else memo[w] for w in ws])


def stem_all(words: Column) -> Column:
    """Stems of an array of lower-case words; a null array stays null."""
    return _stems(words)
