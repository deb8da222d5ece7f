"""Token filters and a Porter stemmer."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Frequent English words that carry no topic, and what apostrophes leave of them.
STOPWORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here "
    "there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now "
    "d ll m o re ve y ain aren couldn didn doesn hadn hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn"
).split()


def tag_filter(text: Column) -> Column:
    """Characters other than letters and digits become spaces, runs of spaces one; stop words go (as written: case
    counts). A leading or trailing space leaves an empty token."""
    tokens = F.split(F.regexp_replace(F.regexp_replace(text, "[^a-zA-Z0-9]", " "), " +", " "), " ")
    return F.filter(tokens, lambda x: ~x.isin(STOPWORDS))


_vowel = "aeiou"


def _is_consonant(w: str, i: int) -> bool:
    c = w[i]
    return c not in _vowel and not (c == "y" and i > 0 and _is_consonant(w, i - 1))


def _measure(w: str) -> int:
    """Changes from vowels to consonants."""
    kinds = "".join("c" if _is_consonant(w, i) else "v" for i in range(len(w)))
    return len(re.findall("v+c+", kinds))


def _has_vowel(w: str) -> bool:
    return any(not _is_consonant(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _is_consonant(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and _is_consonant(w, n - 3) and not _is_consonant(w, n - 2) and _is_consonant(w, n - 1) and w[-1] not in "wxy"


#: Fixed values of the published algorithm's steps 2 to 4.
STEP2 = dict(ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", abli="able", alli="al", entli="ent", eli="e", ousli="ous", ization="ize", ation="ate", ator="ate", alism="al", iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble")
STEP3 = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def porter(word: str) -> str:
    """The stem of a lower-case word."""
    w = word.lower()
    if len(w) <= 2:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _has_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for step in (STEP2, STEP3):
        end = max((e for e in step if w.endswith(e)), key=len, default=None)
        if end and _measure(w[: -len(end)]) > 0:
            w = w[: -len(end)] + step[end]
    end = max((e for e in STEP4 if w.endswith(e)), key=len, default=None)
    if end and _measure(w[: -len(end)]) > 1 and (end != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(end)]
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(ArrayType(StringType()))
def _stems(tokens: pd.Series) -> pd.Series:
    seen: dict[str, str] = {}
    return tokens.map(lambda x: None if x is None else [seen.get(t) or seen.setdefault(t, porter(t)) for t in x])


def tag_filter_stem(text: Column) -> Column:
    """As tag_filter, but tokens are stemmed before the stop words go."""
    tokens = F.split(F.regexp_replace(F.regexp_replace(text, "[^a-zA-Z0-9]", " "), " +", " "), " ")
    return F.filter(_stems(tokens), lambda x: ~x.isin(STOPWORDS))
