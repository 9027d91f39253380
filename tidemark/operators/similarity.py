"""Topical similarity by language: keywords and reference vectors of a topic for each language, with a default language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import analyzers
from tidemark.operators import vectors


def by_language(documents: DataFrame, language: str, text: str) -> DataFrame:
    """(language, text): the distinct texts of each language, one row each, so that no language gathers in one place."""
    return documents.select(language, text).distinct()


def language_keywords(labels: DataFrame, topic: str) -> DataFrame:
    """(topic, language, keywords) of labels (topic, language, name): a language's own names and those of no language.

    A topic whose names all lack a language has one row without one.
    """
    neutral = labels.filter("language is null").groupBy(topic).agg(F.collect_set("name").alias("__all"))
    own = labels.filter("language is not null").groupBy(topic, "language").agg(F.collect_set("name").alias("__own"))
    none = F.array().cast("array<string>")
    both = F.array_union(F.coalesce("__own", none), F.coalesce("__all", none))
    return own.join(neutral, topic, "full").select(topic, "language", F.array_sort(both).alias("keywords"))


def all_keywords(keywords: Column) -> Column:
    """The keywords of a map from language to keywords, whatever their language."""
    return F.array_sort(F.array_distinct(F.flatten(F.map_values(keywords))))


def stored_vectors(specs: DataFrame, topic: str = "name") -> DataFrame:
    """(topic, language, term, w) of stored specifications' reference vectors."""
    languages = specs.select(topic, F.explode("referenceVectors").alias("language", "vector"))
    return languages.select(topic, "language", F.explode("vector.elements").alias("term", "w"))


def stored_factors(specs: DataFrame, topic: str = "name") -> DataFrame:
    """(topic, language, factor) of stored specifications."""
    return specs.select(topic, F.explode("correctionFactors").alias("language", "factor"))


def language_counts(docs: DataFrame, *keys: str, language: str = "lang", known: tuple[str, ...] = analyzers.LANGUAGES, default: str = analyzers.DEFAULT) -> DataFrame:
    """(keys, term, n): stems by each document's own language, or the default one."""
    words = docs.select(*keys, F.explode(analyzers.terms(F.col("text"), F.col(language), known, default)).alias("term"))
    return words.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("n"))


def language_cosine(weights: DataFrame, documents: DataFrame, reference: DataFrame, factors: DataFrame, key: str, default: str = analyzers.DEFAULT, blocks: vectors.Blocks | None = None) -> DataFrame:
    """(key, route, sim) for every row of ``documents`` (key, language): corrected cosine with the reference of its language.

    ``weights``: (key, term, w); ``reference``: (language, term, w); ``factors``: (language, factor). A language
    without a reference goes to the default's; where nothing is shared, or the default has none either, sim is 0.
    References are a specification's: a fixed number of terms for each language. ``blocks``: those of the weights.
    """
    held = reference.select(F.col("language").alias("__has")).distinct()
    routed = documents.join(F.broadcast(held), F.col("language") == F.col("__has"), "left")
    routed = routed.select(key, F.coalesce("__has", F.lit(default)).alias("route"))
    # A document's norm is summed beside its dot product; ``times`` undoes what a key that stands in several rows adds to it.
    once = routed.withColumn("times", F.count(F.lit(1)).over(Window.partitionBy(key)))
    own = blocks.beside(weights, once) if blocks else weights.join(once, key)
    own = own.join(F.broadcast(reference.select(F.col("language").alias("route"), "term", F.col("w").alias("rw"))), ["route", "term"], "left")
    sums = own.groupBy(*vectors._own(weights, key)).agg(
        F.sum(F.col("w") * F.col("rw")).alias("dot"), F.sqrt(F.sum(F.col("w") * F.col("w") / F.col("times"))).alias("norm")
    ).select(key, "dot", "norm")
    norms = vectors.norms(reference, "language").select(F.col("language").alias("route"), F.col("norm").alias("rn"))
    out = routed.join(sums, key, "left").join(F.broadcast(norms), "route", "left")
    out = out.join(F.broadcast(factors.select(F.col("language").alias("route"), "factor")), "route", "left")
    sim = vectors.guarded(F.coalesce("dot", F.lit(0.0)), F.col("norm") * F.col("rn"))
    return out.select(key, "route", vectors.guarded(sim, F.coalesce("factor", F.lit(1.0))).alias("sim"))
