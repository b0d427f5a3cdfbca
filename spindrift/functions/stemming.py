"""English stems by the suffix rules of Porter, "An algorithm for suffix stripping" (1980)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.text import query_terms, tokens

# The paper's suffixes and what takes their place, by step.
STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent",
          "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful",
          "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = dict.fromkeys(("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous",
                        "ive", "ize"), "")


def _shape(word: str) -> str:
    """v for each vowel and c for each consonant; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out.endswith("c")) else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _shape(word)))


def _short(word: str) -> bool:
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _replaced(word: str, rules: dict[str, str], least: int) -> str:
    """The longest suffix of the rules gives way if enough of the word stands before it."""
    for suffix in sorted(rules, key=len, reverse=True):
        if word.endswith(suffix):
            rest = word[:-len(suffix)]
            allowed = _measure(rest) > least and (suffix != "ion" or rest[-1:] in ("s", "t"))
            return rest + rules[suffix] if allowed else word
    return word


def _without_past(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    rest = next((word[:-len(s)] for s in ("ed", "ing") if word.endswith(s)), None)
    if rest is None or "v" not in _shape(rest):
        return word
    if rest.endswith(("at", "bl", "iz")):
        return rest + "e"
    if _double(rest) and rest[-1] not in "lsz":
        return rest[:-1]
    return rest + "e" if _measure(rest) == 1 and _short(rest) else rest


def stem(word: str) -> str:
    """The stem of a lower-case word; words of up to two letters stay."""
    if len(word) <= 2:
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    word = _without_past(word)
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(_replaced(word, STEP_2, 0), STEP_3, 0), STEP_4, 1)
    if word.endswith("e"):
        n = _measure(word[:-1])
        if n > 1 or (n == 1 and not _short(word[:-1])):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


def _stems(words: pd.Series) -> pd.Series:
    return words.map(stem, na_action="ignore")


def stems(word: Column) -> Column:
    """The stems of single words; meant for distinct words, as it runs in Python workers."""
    return F.pandas_udf(_stems, "string")(word)


def stemmed_hits(docs: DataFrame, keys: list[str], text: Column, query: str) -> DataFrame:
    """keys and hits, the share of matching words, of the documents that have all stems of a query.

    Only words that begin like a term are exploded, and each distinct one is
    stemmed once. A query without terms finds nothing; equal keys are one
    document.
    """
    terms = sorted({stem(w) for w in query_terms(query)})
    words = tokens(text)
    starts = F.lit(False)
    alike = lambda w: F.substring(w, 1, 1).isin(*{t[0] for t in terms}) if terms else starts
    postings = docs.select(*keys, F.size(words).alias("_size"), F.explode(F.filter(words, alike)).alias("_word"))
    forms = postings.select("_word").distinct().withColumn("_stem", stems(F.col("_word"))).filter(F.col("_stem").isin(*terms))
    found = postings.join(forms, "_word").groupBy(*keys, "_size").agg(F.count_distinct("_stem").alias("_n"), F.count("*").alias("_hits"))
    return found.filter(F.col("_n") == len(terms)).groupBy(*keys).agg(F.max(F.col("_hits") / F.col("_size")).alias("hits"))
