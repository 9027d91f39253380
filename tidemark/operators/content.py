"""Counts over document content: keywords, top k, entities, languages, metrics, evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as tx


def keyword_counts(docs: DataFrame, key: str, keywords: list[str]) -> DataFrame:
    """(key, keyword, n)."""
    words = docs.select(key, F.explode(tx.matched_keywords(F.col("text"), F.array(*map(F.lit, keywords)))).alias("keyword"))
    return words.groupBy(key, "keyword").agg(F.count(F.lit(1)).alias("n"))


def top_k(counts: DataFrame, key: str, item: str, n: str, k: int) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc(n), item)
    return counts.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)


def gazetteer_entities(docs: DataFrame, key: str, gazetteer: DataFrame) -> DataFrame:
    """(key, type, label, n): tokens that a gazetteer (label, type) names."""
    words = docs.select(key, F.explode(tx.tokens(F.col("text"))).alias("label"))
    return words.join(gazetteer, "label").groupBy(key, "type", "label").agg(F.count(F.lit(1)).alias("n"))


def analyse(docs: DataFrame, key: str, keywords: list[str], label: Callable[[DataFrame], DataFrame] | None = None, k: int = 10) -> DataFrame:
    """Length, top keywords and (with a labeller) entities of each document."""
    top = top_k(keyword_counts(docs, key, keywords), key, "keyword", "n", k)
    top = top.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("keyword", "n")))).alias("keywords"))
    out = docs.select(key, tx.word_count(F.col("text")).cast("long").alias("length")).join(top, key, "left")
    return out.join(label(docs), key, "left") if label else out


def metric_hierarchy(names: DataFrame) -> DataFrame:
    """(grp, metric): the part before the last dot, reduced to its last component when it is a class name."""
    dotted = F.regexp_extract("name", r"^(.*)\.[^.]*$", 1)
    group = F.when(dotted.rlike(r"(^|\.)[A-Z]\w*$"), F.regexp_extract(dotted, r"([^.]+)$", 1)).otherwise(dotted)
    return names.select(group.alias("grp"), F.regexp_extract("name", r"([^.]+)$", 1).alias("metric"))


def rank_auc(scored: DataFrame, score: str, label: str) -> DataFrame:
    """Chance that a random positive outranks a random negative (ties half), one row.

    Ranks come from counts per distinct score, so the window runs over the distinct
    scores and not over the rows.
    """
    per = scored.groupBy(score).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("p"))
    below = F.sum("n").over(Window.orderBy(score).rowsBetween(Window.unboundedPreceding, -1))
    ranked = per.withColumn("rank", F.coalesce(below, F.lit(0)) + (F.col("n") + 1) / 2)
    sums = ranked.agg(F.sum(F.col("p") * F.col("rank")).alias("r"), F.sum("p").alias("p"), F.sum(F.col("n") - F.col("p")).alias("q"))
    return sums.select("p", "q", F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("q")).alias("auc"))


def date_accuracy(rows: DataFrame, found: str, gold: str) -> DataFrame:
    """Share of equal days and mean error in days."""
    return rows.agg(
        F.avg((F.to_date(found) == F.to_date(gold)).cast("int")).alias("accuracy"), F.avg(F.abs(F.datediff(found, gold))).alias("mean_days"),
        F.count(F.lit(1)).alias("n"),
    )
