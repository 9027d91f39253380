"""Tokens, n-grams, stems and keyword matching."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = r"[\p{L}\p{N}]+"
# Characters that separate keywords, and weights of a keyword match.
SEPARATORS = r"""[\s<>|“”„‚‘’,;.:\-_'+*`()$%!"?]+"""
PHRASE, SINGLE, NONE = 2.0, 1.5, 1.0
# Letters after which a final s, or a final st, is an ending.
S_ENDING = frozenset("bdfghklmnt")
# A rare token with a digit is no term below this share of its document.
RARE_DIGIT = 0.005


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0)


def separated(text: Column) -> Column:
    return F.filter(F.split(text, SEPARATORS), lambda x: x != "")


def word_count(text: Column) -> Column:
    return F.size(separated(text))


def token_count(text: Column) -> Column:
    return F.size(F.split(text, r"\s+"))


def matched_keywords(text: Column, keywords: Column) -> Column:
    """The text's words, lower-cased, that are keywords; with repetitions."""
    return F.filter(F.transform(separated(text), F.lower), lambda w: F.array_contains(keywords, w))


def strip_parenthesis(title: Column) -> Column:
    return F.regexp_replace(title, r" (\([^)]+\))$", "")


def clean_label(label: Column) -> Column:
    return F.trim(F.regexp_replace(label, r"[^-\w\d_]+", " "))


def ngrams(words: Column, n: int) -> Column:
    starts = F.sequence(F.lit(1), F.size(words) - n + 1)
    return F.when(F.size(words) >= n, F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))).otherwise(
        F.array().cast("array<string>")
    )


def matcher(keywords: Column, n: int = 2) -> Column:
    """struct<single, phrases> of an array of keyword token lists: one token, or the n-grams of several."""
    single = F.flatten(F.filter(keywords, lambda k: F.size(k) == 1))
    phrases = F.flatten(F.transform(F.filter(keywords, lambda k: F.size(k) > 1), lambda k: ngrams(k, n)))
    return F.struct(F.array_distinct(single).alias("single"), F.array_distinct(phrases).alias("phrases"))


def keyword_weight(term: Column, single: Column, phrases: Column | None = None) -> Column:
    weight = F.when(F.array_contains(single, term), SINGLE)
    if phrases is not None:
        weight = F.when(F.array_contains(phrases, term), PHRASE).when(F.array_contains(single, term), SINGLE)
    return weight.otherwise(NONE)


def tf(n: Column) -> Column:
    return F.when(n > 0, 1 + F.log(n)).otherwise(F.lit(0.0))


def is_noise(term: Column, n: Column, total: Column) -> Column:
    """A token with a digit that is a single character or rare in its document."""
    return term.rlike(r"\d") & ((n / total < RARE_DIGIT) | (F.length(term) == 1))


def light_stem(word: str) -> str:
    """Light German stemming: accents folded, then at most one ending of each of two kinds removed."""
    word = word.lower()
    if not word.isascii():
        word = "".join(c for c in unicodedata.normalize("NFD", word.replace("ß", "ss")) if not unicodedata.combining(c))
    if len(word) > 5 and word.endswith("ern"):
        word = word[:-3]
    elif len(word) > 4 and word.endswith(("em", "en", "er", "es")):
        word = word[:-2]
    elif len(word) > 3 and (word.endswith("e") or word.endswith("s") and word[-2] in S_ENDING):
        word = word[:-1]
    if len(word) > 5 and word.endswith("est"):
        return word[:-3]
    if len(word) > 4 and (word.endswith(("er", "en")) or word.endswith("st") and word[-3] in S_ENDING):
        return word[:-2]
    return word


@F.pandas_udf(T.StringType())
def stem(word: pd.Series) -> pd.Series:
    distinct = {w: None if w is None else light_stem(w) for w in word.unique()}
    return word.map(distinct)


@F.pandas_udf(T.ArrayType(T.StringType()))
def stems(words: pd.Series) -> pd.Series:
    seen: dict[str, str] = {}

    def one(w: str) -> str:
        if w not in seen:
            seen[w] = light_stem(w)
        return seen[w]

    return words.map(lambda ws: None if ws is None else [one(w) for w in ws])
