"""Snapshot index and choice: archived versions of URLs, the best of them by time or relevance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import relevance, urls


def pivot_versions(cells: DataFrame) -> DataFrame:
    """(surt, version, column, value) cells to one row for each version that has an origurl."""
    names = ("origurl", "ts", "filename", "offset", "mime")
    pick = lambda n: F.max(F.when(F.col("column") == n, F.col("value"))).alias(n)
    return cells.groupBy("surt", "version").agg(*map(pick, names)).filter(F.col("origurl").isNotNull())


def locate(frontier: DataFrame, index: DataFrame) -> DataFrame:
    """All archived versions of the frontier's URLs."""
    return frontier.withColumn("surt", urls.surt(F.col("url"))).join(index, "surt")


def missing(frontier: DataFrame, index: DataFrame) -> DataFrame:
    return frontier.withColumn("surt", urls.surt(F.col("url"))).join(index, "surt", "left_anti").drop("surt")


def at_time(index: DataFrame, key: Column, when: Column, latest_only: bool = False) -> DataFrame:
    """Point lookup; ``latest_only`` compares the latest version of a key alone."""
    if latest_only:
        newest = Window.partitionBy("surt").orderBy(F.desc("version"))
        index = index.withColumn("__n", F.row_number().over(newest)).filter("__n = 1").drop("__n")
    return index.filter((F.col("surt") == key) & (F.col("ts") == when))


def best_by_time(snapshots: DataFrame, key: str, when: str, interval: relevance.Interval, n: int, tie: str, as_written: bool = False) -> DataFrame:
    """The n snapshots of each key nearest to the interval (``as_written``: farthest); unknown times last."""
    value = F.when(F.col(when).isNotNull(), F.round(relevance.half_life(F.col(when), interval), 6))
    order = F.asc_nulls_last(value) if as_written else F.desc_nulls_last(value)
    window = Window.partitionBy(key).orderBy(order, F.col(tie))
    return snapshots.withColumn("rank", F.row_number().over(window).cast("long")).filter(F.col("rank") <= n)


def choose(results: DataFrame, key: str, relevance_col: str, modified: str, position: str) -> DataFrame:
    """For each key: the most relevant snapshot (the first of equals), range of known relevances, span of dates."""
    known = F.when(F.col(relevance_col) >= 0, F.col(relevance_col))
    best = F.max_by(position, F.struct(F.col(relevance_col), -F.col(position)))
    return results.groupBy(key).agg(
        best.alias("best"),
        F.max(relevance_col).alias("relevance"),
        F.coalesce(F.min(known), F.lit(float("inf"))).alias("min_relevance"),
        F.coalesce(F.max(known), F.lit(float("-inf"))).alias("max_relevance"),
        F.floor((F.unix_micros(F.max(F.col(modified).cast("timestamp"))) - F.unix_micros(F.min(F.col(modified).cast("timestamp")))) / 1000).alias("span_ms"),
    )


def resolve_path(filename: Column, root: str) -> Column:
    """Archive files lie in a folder named by what stands before the first dash."""
    folder = F.when(F.instr(filename, "-") > 0, F.substring_index(filename, "-", 1))
    return F.concat_ws("/", F.lit(root), folder, filename)
