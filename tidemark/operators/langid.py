"""Language identification by naive Bayes on byte n-grams, and a byte Markov chain."""

from __future__ import annotations

import math
import random
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.vectors import parts

SIZES = (1, 2, 3)
MAX_FEATURES = 3_000


def features(text: str | None) -> Counter:
    data = (text or "").lower().encode()
    return Counter(data[i : i + n] for n in SIZES for i in range(len(data) - n + 1))


# Texts whose n-grams are numbered at one time.
SLICE = 256


def codes(data: bytes, n: int) -> np.ndarray:
    """The n-grams of bytes in their order, as numbers with the first byte highest."""
    b = np.frombuffer(data, np.uint8).astype(np.int32)
    out = b[: max(0, len(b) - n + 1)]
    for i in range(1, n):
        out = out << 8 | b[i : len(b) - n + 1 + i]
    return out


def _bytes(texts: list[str | None]) -> list[bytes]:
    return [(text or "").lower().encode() for text in texts]


def count_codes(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of texts, none across two of them, and their counts."""
    ends = np.cumsum([len(x) for x in texts])
    found = codes(b"".join(texts), n)
    inside = np.ones(len(found), bool)
    for i in range(1, n):
        across = ends - i
        inside[across[(across >= 0) & (across < len(found))]] = False
    return np.unique(found[inside], return_counts=True)


def count_features(docs: DataFrame) -> DataFrame:
    """(lang, feature, n) over all documents, combined in each partition first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, list[Counter]] = {}
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                own = total.setdefault(lang, [Counter() for _ in SIZES])
                for at in range(0, len(texts), SLICE):
                    data = _bytes(texts.iloc[at : at + SLICE].tolist())
                    for n, c in zip(SIZES, own, strict=True):
                        for code, count in zip(*map(np.ndarray.tolist, count_codes(data, n)), strict=True):
                            c[code] += count
        rows = [(lang, f.to_bytes(n, "big"), count) for lang, own in total.items() for n, c in zip(SIZES, own, strict=True) for f, count in c.items()]
        yield pd.DataFrame(rows, columns=["lang", "feature", "n"])

    counts = dealt(docs.select("lang", "text")).mapInPandas(run, "lang string, feature binary, n long")
    return counts.groupBy("lang", "feature").agg(F.sum("n").alias("n"))


def dealt(docs: DataFrame) -> DataFrame:
    """Documents dealt evenly over the cores, whatever the parts of their files."""
    return docs.repartition(parts(docs))


def train(docs: DataFrame, max_features: int = MAX_FEATURES) -> DataFrame:
    """(feature, lang, logp, prior): the most frequent features, smoothed by one; persist it as parquet."""
    counts = count_features(docs)
    top = counts.groupBy("feature").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "feature").limit(max_features)
    langs = docs.filter("lang is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("docs"))
    grid = top.select("feature").join(F.broadcast(langs))
    filled = grid.join(counts, ["lang", "feature"], "left").withColumn("n", F.coalesce("n", F.lit(0)) + 1)
    totals = filled.groupBy("lang").agg(F.sum("n").alias("t"))
    docs_total = langs.agg(F.sum("docs").alias("d"))
    return filled.join(totals, "lang").join(F.broadcast(docs_total)).select(
        "feature", "lang", F.log(F.col("n") / F.col("t")).alias("logp"), F.log(F.col("docs") / F.col("d")).alias("prior")
    )


def languages(model: DataFrame) -> DataFrame:
    return model.select("lang").distinct()


def classifier(model: DataFrame):
    """A function text -> struct<lang, confidence>; the model has a fixed bound of features times languages."""
    rows = model.collect()
    names = sorted({r["lang"] for r in rows})
    place = {name: i for i, name in enumerate(names)}
    known = sorted({bytes(r["feature"]) for r in rows})
    number = {f: i for i, f in enumerate(known)}
    weights, prior = np.zeros((len(known) + 1, len(names))), np.zeros(len(names))
    for r in rows:
        weights[number[bytes(r["feature"])], place[r["lang"]]] = r["logp"]
        prior[place[r["lang"]]] = r["prior"]
    # The last row stands for n-grams that are no features.
    other = len(known)

    @F.pandas_udf("lang string, confidence double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tables = [np.full(256**n, other, np.int32) for n in SIZES]
        for f, i in number.items():
            tables[SIZES.index(len(f))][int.from_bytes(f, "big")] = i
        for batch in texts:
            out = []
            for text in batch:
                data = _bytes([text])[0]
                score = prior.copy()
                if data:
                    places = np.concatenate([table[codes(data, n)] for n, table in zip(SIZES, tables, strict=True)])
                    score += np.bincount(places, minlength=other + 1) @ weights
                chance = np.exp(score - score.max())
                best = int(chance.argmax())
                out.append((names[best], float(chance[best] / chance.sum())))
            yield pd.DataFrame(out, columns=["lang", "confidence"])

    return run


def bigrams(docs: DataFrame) -> DataFrame:
    """(lang, prev, next, n): byte bigrams of ASCII texts as two-character strings, begin and end as empty strings."""
    chars = F.split(F.col("text"), "")
    ascii_only = docs.filter(F.col("text").rlike(r"^[\x00-\x7F]+$")).select("lang", chars.alias("c"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.size("c")),
        lambda i: F.struct(
            F.when(i == 0, F.lit("")).otherwise(F.element_at("c", F.greatest(i, F.lit(1)))).alias("prev"),
            F.when(i == F.size("c"), F.lit("")).otherwise(F.element_at("c", F.least(i + 1, F.size("c")))).alias("next"),
        ),
    )
    rows = ascii_only.select("lang", F.explode(pairs).alias("p")).select("lang", "p.prev", "p.next")
    return rows.groupBy("lang", "prev", "next").agg(F.count(F.lit(1)).alias("n"))


def generate(model: list[tuple[str, str, int]], seed: int, most: int = 1_000) -> str:
    """Random text from (prev, next, n) rows of one language."""
    table: dict[str, list[tuple[str, int]]] = {}
    for a, b, n in model:
        table.setdefault(a, []).append((b, n))
    draw, out, last = random.Random(seed), [], ""
    while len(out) < most:
        options = sorted(table.get(last, [("", 1)]))
        last = draw.choices([o for o, _ in options], [n for _, n in options])[0]
        if not last:
            break
        out.append(last)
    return "".join(out)


def perplexity(score: float, n: int) -> float:
    return math.exp(-score / max(1, n))
