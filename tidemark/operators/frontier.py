"""The crawl frontier: buckets by priority, first in first out, each URL once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 100


def seeds(urls: DataFrame, priority: float = 1.0) -> DataFrame:
    """Frontier rows of seed URLs: path S, no referrer."""
    none = F.lit(None)
    return urls.select(
        "url", F.lit("S").alias("path"), F.lit(priority).alias("priority"), none.cast("string").alias("referrer"), none.cast("timestamp").alias("referrer_ts")
    )


def outlinks(results: DataFrame) -> DataFrame:
    """Frontier rows of (url, path, crawl_ts, links array<string>, score): one step further from the seed."""
    return results.select(
        F.explode("links").alias("link"), F.concat("path", F.lit("L")).alias("path"), F.col("score").alias("priority"),
        F.col("url").alias("referrer"), F.col("crawl_ts").alias("referrer_ts"),
    ).withColumnRenamed("link", "url")


def bucket(priority: Column, buckets: int = BUCKETS) -> Column:
    """Bucket of a priority in [0, 1]; 1 falls into the last."""
    return F.least(F.floor(F.round(priority / F.lit(1.0 / buckets), 9)), F.lit(buckets - 1)).cast("int")


def in_order(frontier: DataFrame, sequence: str) -> DataFrame:
    """``place`` inside each bucket, first in first out."""
    placed = frontier.withColumn("bucket", bucket(F.col("priority")))
    return placed.withColumn("place", F.row_number().over(Window.partitionBy("bucket").orderBy(sequence)).cast("long"))


def pop(frontier: DataFrame, n: int, sequence: str = "seq", seed: int | None = None) -> DataFrame:
    """The next n rows: highest buckets first, or (with ``seed``) a weighted sample, weights 2^bucket.

    The sample orders by -ln(u) / weight, whose least values are a weighted sample without replacement.
    """
    placed = frontier.withColumn("bucket", bucket(F.col("priority")))
    if seed is None:
        return placed.orderBy(F.desc("bucket"), sequence).limit(n)
    # Logarithms keep 2^99 from swamping everything: ln(-ln u) - bucket ln 2.
    race = F.log(-F.log(F.rand(seed))) - F.col("bucket") * F.log(F.lit(2.0))
    return placed.withColumn("race", race).orderBy("race", sequence).limit(n).drop("race")


def weights(enabled: list[bool], base: float = 2.0) -> list[float]:
    """Chance of each bucket, proportional to base^i over the enabled ones; all 0 if none is."""
    raw = [base**i if on else 0.0 for i, on in enumerate(enabled)]
    return [w / sum(raw) for w in raw] if any(raw) else [0.0] * len(raw)


def unseen(new: DataFrame, seen: DataFrame) -> DataFrame:
    """First discovery of each URL that was not seen before."""
    fresh = new.join(seen.select("url"), "url", "left_anti")
    order = Window.partitionBy("url").orderBy(F.length("path"), F.col("referrer").asc_nulls_first())
    return fresh.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def merge(frontier: DataFrame) -> DataFrame:
    """One row for each URL: the shortest path, ties by path and referrer."""
    order = F.struct(F.length("path"), F.col("path"), F.coalesce("referrer", F.lit("")))
    return frontier.groupBy("url").agg(F.min_by(F.struct("path", "priority", "referrer", "referrer_ts"), order).alias("r")).select("url", "r.*")
