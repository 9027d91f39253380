"""TextRank keyphrases.

The co-occurrence graph is available as an edge list made of windows; ranking a
document is a small fixed-point iteration, done inside one Arrow-batched function
because a document's graph is small and never leaves its row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import light_stem
from tidemark.operators.vectors import parts

DAMPING, REDUCTION, STEP_ERROR, MAX_WORD, MAX_PHRASE = 0.85, 0.8, 0.005, 50, 5
# Words that no keyphrase holds, for taggers that know no parts of speech.
STOP = frozenset(
    "a an and are as at be by for from has he in is it its of on or that the this to was were will with "
    "der die das den dem des ein eine und oder in im ist mit von zu auf für nicht sich als auch an es "
    "le la les un une des et ou en du de que qui pour par sur est au aux el los las del y o con por para se".split()
)

Tagger = Callable[[list[str]], list[str]]


def _stop_word_tag(word: str) -> str:
    return "." if not word[:1].isalpha() else "IN" if word.lower() in STOP else "NN"


def stop_word_tagger(words: list[str]) -> list[str]:
    """NN for words that may stand in a phrase, IN for stop words, '.' for the rest."""
    return list(map(_stop_word_tag, words))


def sentences(text: str) -> Iterator[list[str]]:
    for sentence in text.replace("?", ".").replace("!", ".").replace("\n", ".").split("."):
        words = sentence.replace(",", " , ").replace(";", " ; ").split()
        if words:
            yield words


def node_key(word: str, tag: str) -> str:
    return tag[:2] + light_stem(word[:MAX_WORD])


def is_relevant(tag: str) -> bool:
    return tag.startswith(("NN", "JJ"))


def relevant_key(word: str, tag: str) -> str | None:
    return node_key(word, tag) if is_relevant(tag) else None


# Shares of ranks are summed as multiples of this: exact in any order of the neighbours, so equal ranks stay equal.
UNIT = 2.0**36


def settle(src: np.ndarray, dst: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Ranks after rounds over edges (both ways) until the standard error of the changes is small, at most as many as there are nodes."""
    n = len(rank)
    degree = np.maximum(np.bincount(src, minlength=n), 1) / UNIT
    for _ in range(n):
        share = np.rint(rank / degree)
        new = (1 - DAMPING) + DAMPING / UNIT * np.bincount(dst, share[src], n)
        change = np.abs(new - rank)
        rank = new
        change -= change.sum() / n
        if math.sqrt(change @ change / max(1, n - 1)) / math.sqrt(n) < STEP_ERROR:
            break
    return rank


def iterate(neighbours: dict, rank: dict | None = None) -> dict:
    """``settle`` for a graph of sets of neighbours."""
    names = list(neighbours)
    place = {v: i for i, v in enumerate(names)}
    edges = np.array([(place[u], i) for i, v in enumerate(names) for u in neighbours[v]], dtype=np.int64).reshape(-1, 2)
    start = dict.fromkeys(neighbours, 1.0) | (rank or {})
    return dict(zip(names, settle(edges[:, 0], edges[:, 1], np.array([start[v] for v in names])).tolist(), strict=True))


def _spread(values: list[float]) -> tuple[float, float]:
    mean = sum(values) / len(values)
    return mean, math.sqrt(sum((v - mean) ** 2 for v in values) / max(1, len(values) - 1))


# What stands between two sentences, as a word and as a key.
END = "."


@lru_cache(1 << 17)
def _stop_word_key(word: str) -> str | None:
    return END if word == END else relevant_key(word, _stop_word_tag(word))


def _keyed(text: str, tagger: Tagger) -> tuple[list[str], list[str | None]]:
    """All words of a text and their keys: none where a word is not relevant, ``END`` between sentences."""
    if tagger is stop_word_tagger:
        text = text.replace("?", END).replace("!", END).replace("\n", END).replace(END, " . ")
        words = text.replace(",", " , ").replace(";", " ; ").split()
        return words, list(map(_stop_word_key, words))
    words, keys = [], []
    for sentence in sentences(text):
        words += [*sentence, END]
        keys += [*map(relevant_key, sentence, tagger(sentence)), END]
    return words, keys


def keyphrases(text: str | None, k: int, tagger: Tagger = stop_word_tagger, lowest: bool = False) -> list[tuple[str, float]]:
    """The k best phrases with their metric (``lowest``: the k worst); ties by phrase."""
    if not text or k <= 0:
        return []
    words, keys = _keyed(text, tagger)
    names = [key for key in dict.fromkeys(keys) if key is not None and key != END]
    if not names:
        return []
    numbers = {None: -1, END: -2} | {key: i for i, key in enumerate(names)}
    places = list(map(numbers.__getitem__, keys))
    number = np.array(places, dtype=np.int64)
    at = np.flatnonzero(number >= 0)
    node, sentence = number[at], np.cumsum(number == -2)[at]
    # Neighbours are relevant words of a sentence with no other relevant word between them.
    near = np.flatnonzero((sentence[1:] == sentence[:-1]) & (node[1:] != node[:-1]))
    a, b = node[near], node[near + 1]
    ways = np.unique(np.concatenate([a << 32 | b, b << 32 | a]))
    src, dst = ways >> 32, ways & 0xFFFFFFFF
    rank = settle(src, dst, np.ones(len(names)))
    by_name = np.array(sorted(range(len(names)), key=names.__getitem__))
    order = by_name[np.argsort(-rank[by_name], kind="stable")]
    best = order[: round(REDUCTION * len(order)) + 1]
    marked = np.zeros(len(names), bool)
    marked[best] = True
    mean, deviation = _spread(rank[best].tolist())
    # Runs of relevant words; a word alone must be a noun of high rank.
    begins = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    lengths = np.diff(begins, append=len(at))
    alone = marked & (rank >= mean + 0.25 * deviation)
    alone[[v for v in np.flatnonzero(alone).tolist() if not names[v].startswith("NN")]] = False
    fit = np.where(lengths > 1, np.logical_or.reduceat(marked[node], begins), alone[node[begins]])
    phrases: dict[tuple[int, ...], int] = {}
    spelling: list[str] = []
    counts: list[int] = []
    for begin, length in zip(at[begins[fit]].tolist(), lengths[fit].tolist(), strict=True):
        run = tuple(places[begin : begin + length])
        place = phrases.get(run)
        if place is None:
            phrases[run] = len(counts)
            counts.append(1)
            spelling.append(" ".join(words[begin : begin + length]))
        else:
            counts[place] += 1
    parts_of = [(p, own) for run, p in phrases.items() if len(own := set(run)) < MAX_PHRASE]
    if not parts_of:
        return []
    # Phrases are nodes beside their words.
    n = np.array([len(own) for _, own in parts_of])
    own = np.fromiter(chain.from_iterable(own for _, own in parts_of), np.int64, n.sum())
    phrase = len(names) + np.repeat(np.arange(len(n)), n)
    start = np.concatenate([rank, np.maximum.reduceat(rank[own], np.cumsum(n) - n)])
    final = settle(np.concatenate([src, phrase, own]), np.concatenate([dst, own, phrase]), start)[len(names) :]
    low, high = final.min(), final.max()
    kept = [p for p, _ in parts_of]
    count = np.array(counts)[kept]
    link = (final - low) / (high - low) if high > low else np.zeros(len(final))
    count = (count - 1) / (max(2, count.max()) - 1)
    metric = np.sqrt((link * link + 0.5 * count * count) / 3)
    scored = list(zip([spelling[p] for p in kept], metric.tolist(), strict=True))
    scored.sort(key=lambda x: (x[1] if lowest else -x[1], x[0]))
    return scored[:k]


PHRASES = "array<struct<phrase:string,metric:double>>"


def keyphrases_udf(k: int, lowest: bool = False, tagger: Tagger = stop_word_tagger):
    if k < 0:
        raise ValueError("k must not be negative")

    @F.pandas_udf(PHRASES)
    def run(text: pd.Series) -> pd.Series:
        return pd.Series([[{"phrase": p, "metric": m} for p, m in keyphrases(t, k, tagger, lowest)] for t in text])

    return run


def edges(docs: DataFrame, key: str) -> DataFrame:
    """(key, src, dst) both ways: neighbours among the relevant words of a sentence, with stop words left out.

    Texts are dealt by document once; words and edges stay where their text is.
    """
    docs = docs.select(key, "text")
    docs = docs.repartition(parts(docs), key)
    sentence = F.posexplode(F.split(F.lower("text"), r"[.!?\n]+")).alias("sentence", "body")
    words = docs.select(key, sentence).select(key, "sentence", F.posexplode(F.regexp_extract_all("body", F.lit(r"\p{L}+"), 0)).alias("pos", "word"))
    words = words.filter(~F.col("word").isin(*sorted(STOP)))
    pairs = words.withColumn("next", F.lead("word").over(Window.partitionBy(key, "sentence").orderBy("pos")))
    pairs = pairs.filter(F.col("next").isNotNull() & (F.col("next") != F.col("word")))
    ways = F.array(F.struct(F.col("word").alias("src"), F.col("next").alias("dst")), F.struct(F.col("next").alias("src"), F.col("word").alias("dst")))
    return pairs.select(key, F.explode(ways).alias("e")).select(key, "e.src", "e.dst").distinct()


def render(phrase, metric) -> F.Column:
    return F.format_string("%s (%.4f)", F.replace(phrase, F.lit(" "), F.lit("_")), metric)
