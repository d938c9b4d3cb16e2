"""Stems of words for keyword search: accents folded, then the suffix rules that M. F. Porter published in 1980 (and revised for -bli and -logi)."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The suffixes of steps 2, 3 and 4 and what takes their place.
SECOND = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
THIRD = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
FOURTH = dict.fromkeys(
    ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "sion", "tion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"),
    "",
)

#: Latin letters with marks and the plain letters that they decompose to, by rule.
MARKED = {
    chr(c): unicodedata.normalize("NFKD", chr(c))[0] for c in range(0xC0, 0x250) if unicodedata.normalize("NFKD", chr(c))[0] in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
}


def folded(c: Column) -> Column:
    """c with Latin letters without their marks."""
    return F.translate(c, "".join(MARKED), "".join(MARKED.values()))


def shape(word: str) -> str:
    """v for vowels, c for consonants; y is a vowel after a consonant."""
    out = ""
    for letter in word:
        out += "v" if letter in "aeiou" or (letter == "y" and out.endswith("c")) else "c"
    return out


def measure(word: str) -> int:
    return shape(word).count("vc")


def short_end(word: str) -> bool:
    """Ends in consonant, vowel, consonant other than w, x, y."""
    return shape(word).endswith("cvc") and word[-1] not in "wxy"


def replaced(word: str, rules: dict[str, str], above: int) -> str:
    """The longest suffix of the rules goes if what stands before it measures more than `above`."""
    suffix = max((s for s in rules if word.endswith(s)), key=len, default=None)
    if suffix is None:
        return word
    stem = word[: -len(suffix)] + (suffix[0] if suffix in ("sion", "tion") else "")
    return stem + rules[suffix] if measure(stem) > above else word


def stem(word: str) -> str:
    if len(word) < 3 or len(word) > 64:
        return word
    w = re.sub(r"(ss|i)es$", r"\1", word) if word.endswith(("sses", "ies")) else re.sub(r"(?<!s)s$", "", word)
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) else w
    elif (cut := re.sub(r"(ed|ing)$", "", w)) != w and "v" in shape(cut):
        double = len(cut) > 1 and cut[-1] == cut[-2] and shape(cut)[-1] == "c"
        if cut.endswith(("at", "bl", "iz")) or (not double and measure(cut) == 1 and short_end(cut)):
            w = cut + "e"
        else:
            w = cut[:-1] if double and cut[-1] not in "lsz" else cut
    if w.endswith("y") and "v" in shape(w[:-1]):
        w = w[:-1] + "i"
    w = replaced(replaced(replaced(w, SECOND, 0), THIRD, 0), FOURTH, 1)
    if w.endswith("e") and (measure(w[:-1]) > 1 or (measure(w[:-1]) == 1 and not short_end(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and measure(w[:-1]) > 1 else w


@F.pandas_udf(StringType())
def stems(words: pd.Series) -> pd.Series:
    """stem() of each distinct word of a batch."""
    return words.map({w: stem(w) for w in words.dropna().unique()})
