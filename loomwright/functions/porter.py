"""Porter's stemmer (Porter 1980, "An algorithm for suffix stripping") with the extensions that are usual in Python: a few
irregular forms; short words in -ies and -ied keep their e; y becomes i behind a consonant only; -bli, -fulli and -logi;
and a vowel and a consonant alone count as a short syllable. An Arrow function over token arrays."""

from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Suffixes and their replacements in the paper's steps 2, 3 and 4.
STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("fulli", "ful"), ("logi", "log"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


#: Irregular forms.
IRREGULAR = {"skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed"}


def _kinds(w: str) -> str:
    """A letter a letter: c for consonants, v for vowels; y is a vowel behind a consonant."""
    out = []
    for i, x in enumerate(w):
        out.append("v" if x in "aeiou" or x == "y" and i > 0 and out[-1] == "c" else "c")
    return "".join(out)


def _measure(w: str) -> int:
    return _kinds(w).count("vc")


def _vowel(w: str) -> bool:
    return "v" in _kinds(w)


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _kinds(w)[-1] == "c"


def _cvc(w: str) -> bool:
    kinds = _kinds(w)
    return kinds[-3:] == "cvc" and w[-1] not in "wxy" or kinds == "vc"


def _longest(w: str, table) -> tuple[str, str] | None:
    """The stem and replacement of the longest suffix of the table that the word has."""
    hits = [(s, r) for s, r in table if w.endswith(s)]
    if not hits:
        return None
    suffix, put = max(hits, key=lambda x: len(x[0]))
    return w[: len(w) - len(suffix)], put


@lru_cache(maxsize=100_000)
def stem(w: str) -> str:
    if w in IRREGULAR:
        return IRREGULAR[w]
    if len(w) < 3:
        return w
    if w.endswith("ies"):
        w = w[:-1] if len(w) == 4 else w[:-2]
    elif w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("ied"):
        w = w[:-1] if len(w) == 4 else w[:-2]
    elif w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        cut = next((w[: -len(s)] for s in ("ed", "ing") if w.endswith(s) and _vowel(w[: -len(s)])), None)
        if cut is not None:
            w = cut
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _double(w):
                w = w if w[-1] in "lsz" else w[:-1]
            elif _measure(w) == 1 and _cvc(w):
                w += "e"
    if w.endswith("y") and len(w) > 2 and _kinds(w[:-1])[-1] == "c":
        w = w[:-1] + "i"
    while w.endswith("alli") and _measure(w[:-4]) > 0:
        w = w[:-2]
    for table in (STEP2, STEP3):
        # "logi" keeps its l when the stem is measured
        if (hit := _longest(w, table)) and _measure(w[:-3] if table is STEP2 and w.endswith("logi") else hit[0]) > 0:
            w = hit[0] + hit[1]
    if hit := _longest(w, [(s, "") for s in STEP4]):
        if _measure(hit[0]) > 1 and (not w.endswith("ion") or hit[0].endswith(("s", "t"))):
            w = hit[0]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _cvc(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(T.ArrayType(T.StringType()))
def stemmed(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda x: [stem(w) for w in x], na_action="ignore")
