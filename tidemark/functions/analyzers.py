"""Text to terms by language: tokens, stop words, elisions, stems.

German keeps all its words (no stop words); English, French and Italian leave theirs out.
A language without an analyzer of its own is treated as the default one.
Tokens and stop words are Column expressions; stems come from an Arrow function that
makes Python objects of a slice's distinct words only.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import light_stem

DEFAULT = "de"
# Runs of letters and digits; some marks between two letters, or between two digits, belong to the word.
WORD = r"[\p{L}\p{N}]+(?:(?<=\p{L})['’.:·](?=\p{L})[\p{L}\p{N}]+|(?<=\p{N})[.,;'’](?=\p{N})[\p{L}\p{N}]+)*"
# English words that are no terms, and words that French and Italian elide before an apostrophe.
ENGLISH = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this "
    "to was will with"
).split()
ELIDED = {
    "fr": "l m t qu n s j d c jusqu quoiqu lorsqu puisqu".split(),
    "it": "c l all dall dell nell sull coll pell gl agl dagl degl negl sugl un m t s v d".split(),
}
# Languages whose stop words are those that Spark brings along.
LISTED = {"fr": "french", "it": "italian"}
LANGUAGES = ("de", "en", "fr", "it")


def stop_words(language: str) -> list[str]:
    if language in LISTED:
        from pyspark.ml.feature import StopWordsRemover

        return StopWordsRemover.loadDefaultStopWords(LISTED[language])
    return ENGLISH if language == "en" else []


def route(language: Column, known: tuple[str, ...] = LANGUAGES, default: str = DEFAULT) -> Column:
    """The analyzer's language: its own where there is one, else the default (also for null)."""
    return F.when(language.isin(*known), language).otherwise(F.lit(default))


def _kept(words: Column, language: str) -> Column:
    if language == "en":
        words = F.transform(words, lambda w: F.regexp_replace(w, "['’]s$", ""))
    elif language in ELIDED:
        words = F.transform(words, lambda w: F.regexp_replace(w, f"^(?:{'|'.join(ELIDED[language])})['’]", ""))
    stops = stop_words(language)
    return F.filter(words, lambda w: ~w.isin(*stops)) if stops else words


def tokens(text: Column, language: Column, known: tuple[str, ...] = LANGUAGES, default: str = DEFAULT) -> Column:
    """A text's words in lower case, stop words left out; ``language`` as ``route`` gives it."""
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)
    out = _kept(words, default)
    for own in known:
        if own != default:
            out = F.when(language == own, _kept(words, own)).otherwise(out)
    return out


VOWELS = "aeiou"


def _shape(stem: str) -> str:
    """v or c for each letter; y is a vowel after a consonant."""
    out = ""
    for ch in stem:
        out += "v" if ch in VOWELS or ch == "y" and out.endswith("c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short_end(stem: str) -> bool:
    """Consonant, vowel, consonant at the end, the last not w, x or y."""
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


# Endings of the published English suffix-stripping algorithm and what stands in for them.
SECOND = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent",
    "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful",
    "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
THIRD = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
FOURTH = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _ending(word: str, endings) -> str | None:
    """The longest ending of the word."""
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def english_stem(word: str) -> str:
    """Porter's algorithm."""
    if len(word) < 3:
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    cut = _ending(word, ("eed", "ed", "ing"))
    if cut == "eed":
        word = word[:-1] if _measure(word[:-3]) else word
    elif cut and "v" in _shape(word[: -len(cut)]):
        word = word[: -len(cut)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word[-2:-1] == word[-1] and word[-1] not in "lsz" and _shape(word).endswith("c"):
            word = word[:-1]
        elif _measure(word) == 1 and _short_end(word):
            word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for table in (SECOND, THIRD):
        cut = _ending(word, table)
        if cut and _measure(word[: -len(cut)]):
            word = word[: -len(cut)] + table[cut]
    cut = _ending(word, FOURTH)
    if cut and _measure(word[: -len(cut)]) > 1 and (cut != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(cut)]
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or m == 1 and not _short_end(word[:-1]):
            word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def french_stem(word: str) -> str:
    """Plural and gender endings of words of six letters or more."""
    if len(word) < 6:
        return word
    if word.endswith("x"):
        return word[:-3] + "al" if word.endswith("aux") else word[:-1]
    for end in "sreé":
        word = word.removesuffix(end)
    return word[:-1] if word[-1:] == word[-2:-1] else word


def italian_stem(word: str) -> str:
    """Accents folded; the last vowel, and an i or h before it where that is part of the ending."""
    if len(word) < 6:
        return word
    word = "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))
    before = {"e": "ih", "i": "hi", "a": "i", "o": "i"}.get(word[-1])
    return word if before is None else word[:-2] if word[-2] in before else word[:-1]


STEMMERS = {"de": light_stem, "en": english_stem, "fr": french_stem, "it": italian_stem}


# Documents whose words are numbered at one time, and words whose stems are kept.
SLICE, KEPT = 256, 50_000


@F.arrow_udf(T.ArrayType(T.StringType()))
def _stemmed(words: pa.Array, language: pa.Array) -> pa.Array:
    seen: dict[tuple[str, str], str] = {}

    def one(w: str, lang: str) -> str:
        found = seen.get((w, lang))
        if found is None:
            if len(seen) >= KEPT:
                seen.clear()
            found = seen[w, lang] = STEMMERS[lang](w)
        return found

    def part(words: pa.Array, language: pa.Array) -> pa.Array:
        # Only distinct words become Python objects.
        flat, own = words.flatten().dictionary_encode(), language.take(pc.list_parent_indices(words)).dictionary_encode()
        size = max(1, len(flat.dictionary))
        pairs, place = np.unique(own.indices.to_numpy(zero_copy_only=False) * np.int64(size) + flat.indices.to_numpy(zero_copy_only=False), return_inverse=True)
        texts, langs = flat.dictionary.to_pylist(), own.dictionary.to_pylist()
        stems = pa.array([one(texts[p % size], langs[p // size]) for p in pairs.tolist()], type=pa.string()).take(pa.array(place))
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), stems, mask=words.is_null())

    parts = [part(words.slice(i, SLICE), language.slice(i, SLICE)) for i in range(0, len(words), SLICE)]
    return pa.concat_arrays(parts) if parts else pa.array([], type=pa.list_(pa.string()))


def terms(text: Column, language: Column, known: tuple[str, ...] = LANGUAGES, default: str = DEFAULT) -> Column:
    """Stems of a text's kept words, by its language or the default one."""
    own = route(language, known, default)
    return _stemmed(tokens(text, own, known, default), own)
