"""Porter's stemmer and the words of a stemmed full-text index."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

from .text import STOPWORDS

#: The endings of the published algorithm's second, third and fourth step and what replaces them.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
#: Words of these lengths only are stemmed.
SHORTEST, LONGEST = 3, 64


def shape(word: str) -> str:
    """c or v for each letter; y is a vowel after a consonant."""
    out = ""
    for letter in word:
        out += "v" if letter in "aeiou" or (letter == "y" and out.endswith("c")) else "c"
    return out


def measure(stem: str) -> int:
    return shape(stem).count("vc")


def _short(stem: str) -> bool:
    """Ends in consonant, vowel, consonant, the last not w, x or y."""
    return shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def _swapped(word: str, table: dict[str, str], least: int) -> str:
    end = _longest(word, table)
    if end is None:
        return word
    stem = word[: -len(end)]
    return stem + table[end] if measure(stem) > least else word


@lru_cache(1 << 18)
def porter(word: str) -> str:
    """The stem of a folded word."""
    if not SHORTEST <= len(word.encode()) <= LONGEST:
        return word
    # plurals
    end = _longest(word, ("sses", "ies", "ss", "s"))
    if end in ("sses", "ies"):
        word = word[:-2]
    elif end == "s":
        word = word[:-1]
    # past and progressive forms
    end = _longest(word, ("eed", "ed", "ing"))
    if end == "eed":
        word = word[:-1] if measure(word[:-3]) > 0 else word
    elif end and "v" in shape(word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word[-1:] == word[-2:-1] and shape(word).endswith("c") and word[-1] not in "lsz":
            word = word[:-1]
        elif measure(word) == 1 and _short(word):
            word += "e"
    if word.endswith("y") and "v" in shape(word[:-1]):
        word = word[:-1] + "i"
    word = _swapped(_swapped(word, STEP2, 0), STEP3, 0)
    end = _longest(word, (*STEP4, "sion", "tion"))
    if end:
        cut = 3 if end in ("sion", "tion") else len(end)
        if measure(word[:-cut]) > 1:
            word = word[:-cut]
    # a last e, a double l
    if word.endswith("e") and (measure(word[:-1]) > 1 or (measure(word[:-1]) == 1 and not _short(word[:-1]))):
        word = word[:-1]
    if word.endswith("ll") and measure(word[:-1]) > 1:
        word = word[:-1]
    return word


_RUNS = re.compile(r"[^\W_]+")
_WORDS = re.compile(r"\w+")


def folded(text: str) -> str:
    """Lower case without diacritics."""
    text = text.lower()
    return text if text.isascii() else "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")


def analysed(text: str) -> list[str]:
    """The stems of a text's words, in order."""
    return [porter(w) for w in _RUNS.findall(folded(text))]


@pandas_udf(ArrayType(StringType()))
def stem(s: pd.Series) -> pd.Series:
    """The stems of a text's words."""
    return s.map(lambda t: analysed(t or ""))


def query_terms(text: str) -> list[str]:
    """A query's distinct words over two letters and no stop words; if none is left its first eight words."""
    words = _WORDS.findall(text.casefold())
    return list(dict.fromkeys(w for w in words if len(w) > 2 and w not in STOPWORDS)) or words[:8]


def query_stems(text: str) -> list[str]:
    """The stems of a query's terms; terms with one stem count each, a term that the index parts at underscores counts as its parts."""
    return [s for w in query_terms(text) for s in analysed(w)]


def sql(word: str) -> list[tuple[str, str]]:
    """The same steps as (name, SELECT over the step before) for DuckDB, over a table of words named by `word` with a column term: the last one has term and stem."""
    c, v = "[^aeiou]", "[aeiouy]"
    cc, vv = f"{c}[^aeiouy]*", f"{v}[aeiou]*"
    above = {0: f"^({cc})?{vv}{cc}", 1: f"^({cc})?{vv}{cc}{vv}{cc}"}
    one, vowel, short = f"^({cc})?{vv}{cc}({vv})?$", f"^({cc})?{v}", f"^{cc}{v}[^aeiouwxy]$"
    cut = lambda n: f"s[:-{n + 1}]"
    has = lambda x, pattern: f"regexp_matches({x}, '{pattern}')"

    def swap(table: dict[str, str], least: int) -> str:
        cases = [f"WHEN ends_with(s, '{e}') THEN CASE WHEN {has(cut(len(e)), above[least])} THEN {cut(len(e))} || '{r}' ELSE s END" for e, r in sorted(table.items(), key=lambda x: -len(x[0]))]
        return f"CASE {' '.join(cases)} ELSE s END"

    long_enough = f"strlen(term) BETWEEN {SHORTEST} AND {LONGEST}"
    four = {e: len(e) for e in STEP4} | {"sion": 3, "tion": 3}
    step4 = "CASE " + " ".join(f"WHEN ends_with(s, '{e}') THEN CASE WHEN {has(cut(n), above[1])} THEN {cut(n)} ELSE s END" for e, n in sorted(four.items(), key=lambda x: -len(x[0]))) + " ELSE s END"
    after = f"CASE WHEN regexp_matches(s, '(at|bl|iz)$') THEN s || 'e' WHEN s[-1] = s[-2] AND regexp_matches(s, '[^aeiouylsz]$') THEN {cut(1)} WHEN {has('s', one)} AND {has('s', short)} THEN s || 'e' ELSE s END"
    steps = [
        ("s0", f"SELECT term, {long_enough} AS ok, CASE WHEN term[1] = 'y' THEN 'Y' || term[2:] ELSE term END AS s FROM {word}"),
        ("s1", f"SELECT term, ok, CASE WHEN regexp_matches(s, '(sses|ies)$') THEN {cut(2)} WHEN ends_with(s, 'ss') THEN s WHEN ends_with(s, 's') THEN {cut(1)} ELSE s END AS s FROM s0"),
        ("s2", f"SELECT term, ok, NOT ends_with(s, 'eed') AND ((ends_with(s, 'ed') AND {has(cut(2), vowel)}) OR (ends_with(s, 'ing') AND {has(cut(3), vowel)})) AS cut_, CASE WHEN ends_with(s, 'eed') THEN CASE WHEN {has(cut(3), above[0])} THEN {cut(1)} ELSE s END WHEN ends_with(s, 'ed') AND {has(cut(2), vowel)} THEN {cut(2)} WHEN ends_with(s, 'ing') AND {has(cut(3), vowel)} THEN {cut(3)} ELSE s END AS s FROM s1"),
        ("s3", f"SELECT term, ok, CASE WHEN cut_ THEN {after} ELSE s END AS s FROM s2"),
        ("s4", f"SELECT term, ok, CASE WHEN ends_with(s, 'y') AND {has(cut(1), vowel)} THEN {cut(1)} || 'i' ELSE s END AS s FROM s3"),
        ("s5", f"SELECT term, ok, {swap(STEP2, 0)} AS s FROM s4"),
        ("s6", f"SELECT term, ok, {swap(STEP3, 0)} AS s FROM s5"),
        ("s7", f"SELECT term, ok, {step4} AS s FROM s6"),
        ("s8", f"SELECT term, ok, CASE WHEN ends_with(s, 'e') AND ({has(cut(1), above[1])} OR ({has(cut(1), one)} AND NOT {has(cut(1), short)})) THEN {cut(1)} ELSE s END AS s FROM s7"),
    ]
    return [*steps, ("stems", f"SELECT term, CASE WHEN NOT ok THEN term ELSE lower(CASE WHEN ends_with(s, 'll') AND {has(cut(1), above[1])} THEN {cut(1)} ELSE s END) END AS stem FROM s8")]
