"""The stemmer of M. F. Porter, "An algorithm for suffix stripping" (1980), over a vocabulary.

Words are stemmed once each: `stem_vocabulary` takes a column of distinct terms in Arrow batches.
"""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MEASURE = regex.compile("vc")

#: Suffixes of steps 2, 3 and 4 of the paper (fixed values).
STEP_2 = dict(pair.split(":") for pair in "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble".split())
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _shape(stem: str) -> str:
    """v for each vowel and c for each consonant; y is a vowel after a consonant."""
    out = ""
    for c in stem:
        out += "v" if c in "aeiou" or (c == "y" and out[-1:] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(_MEASURE.findall(_shape(stem)))


def _short(stem: str) -> bool:
    """Ends in consonant, vowel, consonant, the last not being w, x or y."""
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _doubled(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def stem(word: str) -> str:
    """The stem of a word in lower-case letters; words of up to two letters stay."""
    if len(word) <= 2:
        return word
    # step 1a: plurals
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    # step 1b: past tense and gerund
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        cut = next((word[: -len(s)] for s in ("ed", "ing") if word.endswith(s)), None)
        if cut is not None and "v" in _shape(cut):
            word = cut
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif _doubled(word) and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _short(word):
                word += "e"
    # step 1c
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    # steps 2 and 3: double suffixes
    for table in (STEP_2, STEP_3):
        suffix = _longest(word, table)
        if suffix and _measure(word[: -len(suffix)]) > 0:
            word = word[: -len(suffix)] + table[suffix]
    # step 4: single suffixes
    suffix = _longest(word, STEP_4)
    if suffix:
        base = word[: -len(suffix)]
        if _measure(base) > 1 and (suffix != "ion" or base[-1:] in ("s", "t")):
            word = base
    # step 5: tidying
    if word.endswith("e"):
        base = word[:-1]
        if _measure(base) > 1 or (_measure(base) == 1 and not _short(base)):
            word = base
    if _measure(word) > 1 and _doubled(word) and word[-1] == "l":
        word = word[:-1]
    return word


@F.pandas_udf(T.StringType())
def stem_column(words: pd.Series) -> pd.Series:
    return words.map(lambda w: None if w is None else stem(w))


def stem_vocabulary(terms: DataFrame, column: str = "term") -> DataFrame:
    """(term, stem) of each distinct term of letters."""
    each = terms.select(F.col(column).alias("term")).where(F.col(column).rlike("^[a-z]+$")).distinct()
    return each.withColumn("stem", stem_column("term"))
