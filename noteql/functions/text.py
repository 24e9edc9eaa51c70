"""Tokens, stems and literal matching."""

from __future__ import annotations

import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

TOKEN = r"[\p{L}\p{N}\p{Co}]+"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order; null text gives none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def _folding() -> tuple[str, str]:
    """Letters with marks that a mark may be taken off, and what is left of each: the canonical decompositions of the
    letters below U+2000 that begin with one letter and go on with marks."""
    pairs = [(chr(c), d[0]) for c in range(0xC0, 0x2000) if len(d := unicodedata.normalize("NFD", chr(c))) > 1 and d[0].isalpha() and all(map(unicodedata.combining, d[1:]))]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


MARKED, PLAIN = _folding()
MARKS = r"[\u0300-\u036f]+"


def folded_tokens(text: Column) -> Column:
    """Tokens without accents, as an index has them: letters with marks count as the letters, and marks that stand by
    themselves after a letter do not end a token."""
    low = F.translate(F.lower(F.coalesce(text, F.lit(""))), MARKED, PLAIN)
    return F.regexp_extract_all(F.regexp_replace(low, MARKS, ""), F.lit(TOKEN), F.lit(0))


def term_string(toks: Column) -> Column:
    """Tokens joined so that every one stands between two spaces of its own; ``find`` counts phrases in it."""
    return F.when(F.size(toks) == 0, "").otherwise(F.concat(F.lit(" "), F.array_join(toks, "  "), F.lit(" ")))


def phrase_of(words: list[str]) -> str:
    return "".join(f" {w} " for w in words)


def occurrences(terms: Column, words: list[str]) -> Column:
    """How often a phrase stands in a term string, without overlaps."""
    pattern = phrase_of(words)
    return ((F.length(terms) - F.length(F.replace(terms, F.lit(pattern), F.lit("")))) / F.lit(len(pattern))).cast("int")


_FOLD = str.maketrans(MARKED, PLAIN)


def fold(text: str) -> str:
    """The same in Python, for lower-cased text."""
    return regex.sub(MARKS, "", text.translate(_FOLD))


def tokenize(text: str, stem: bool = False) -> list[str]:
    """The tokens of a query literal, as the index has them."""
    words = regex.findall(TOKEN, fold(text.lower()))
    return [porter(w) for w in words] if stem else words


@F.pandas_udf(StringType())
def stem_of(words: pd.Series) -> pd.Series:
    """Porter stems of folded tokens; meant for tables of distinct ones."""
    return words.map(porter, na_action="ignore")


@F.pandas_udf(ArrayType(StringType()))
def stems(toks: pd.Series) -> pd.Series:
    """Porter stems of arrays of folded tokens, for texts that are not indexed; each distinct token is stemmed once a
    batch."""
    known: dict[str, str] = {}
    return toks.map(lambda row: [known[w] if w in known else known.setdefault(w, porter(w)) for w in (row if row is not None else ())])


_VOWELS = frozenset("aeiou")


def _shape(word: str) -> str:
    """c or v for each letter; y is a vowel after a consonant."""
    out = ""
    for i, c in enumerate(word):
        out += "v" if c in _VOWELS or c == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    s = _shape(stem)
    return sum(a == "v" and b == "c" for a, b in zip(s, s[1:]))


def _short_end(word: str) -> bool:
    return len(word) >= 3 and _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _double(word: str) -> bool:
    return len(word) >= 2 and word[-1] == word[-2] and _shape(word)[-1] == "c"


#: The suffix rules of steps 2, 3 and 4 of Porter's 1980 algorithm.
STEP_2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _replace(word: str, rules, least: int) -> str:
    for suffix, new in sorted(rules, key=lambda r: -len(r[0])):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + new if _measure(stem) >= least else word
    return word


def porter(word: str) -> str:
    """Porter's stem of a lower-case word; words with other than a-z, and very short ones, stay as they are."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    for suffix, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix):
            word = word[: -len(suffix)] + new
            break
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for suffix in ("ed", "ing"):
            stem = word[: -len(suffix)]
            if word.endswith(suffix) and "v" in _shape(stem):
                if stem.endswith(("at", "bl", "iz")):
                    stem += "e"
                elif _double(stem) and stem[-1] not in "lsz":
                    stem = stem[:-1]
                elif _measure(stem) == 1 and _short_end(stem):
                    stem += "e"
                word = stem
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(word, STEP_2, 1)
    word = _replace(word, STEP_3, 1)
    for suffix in sorted(STEP_4, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
                word = stem
            break
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or m == 1 and not _short_end(word[:-1]):
            word = word[:-1]
    if _double(word) and word.endswith("l") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def literal(text: Column) -> Column:
    """Text for literal phrase matching: runs of other than letters and digits become one space, ASCII lower-cased."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(low, r"[^\p{L}\p{N}]+", " "))


def has_phrase(text: Column, phrase: Column) -> Column:
    """Whether the words of ``phrase`` follow each other in ``text``; an empty phrase is nowhere."""
    p = literal(phrase)
    return (p != "") & F.contains(F.concat(F.lit(" "), literal(text), F.lit(" ")), F.concat(F.lit(" "), p, F.lit(" ")))
