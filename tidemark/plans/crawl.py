"""Focused extraction: prioritised rounds over a link graph whose pages are already analysed.

Analysis does not depend on the order of the crawl, so it is done once for all
pages; a round joins small tables: pop a batch, join the analysed pages, keep
those over the threshold, add unseen outlinks. The pages are written in buckets by
URL, so that a round does not shuffle them; it writes what it found and what is new,
never again what earlier rounds wrote. These files in the shared folder cut the lineage
and survive the loss of executors.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import frontier as fr
from tidemark.operators.vectors import parts


def shared(spark: SparkSession, label: str) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/tidemark-crawl"
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    path = shared(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def in_buckets(df: DataFrame, key: str, label: str) -> Iterator[tuple[DataFrame, int]]:
    """A table written in buckets by key, and their number; it is in the session's catalog for the time of the block."""
    spark, n, name = df.sparkSession, parts(df), f"{label}_{uuid.uuid4().hex}"
    df.repartition(n, key).write.bucketBy(n, key).format("parquet").option("path", shared(spark, label)).saveAsTable(name)
    try:
        yield spark.table(name), n
    finally:
        spark.sql(f"DROP TABLE {name}")


@dataclass
class Progress:
    """Counters of a crawl: popped, retrieved, not found, irrelevant."""

    rounds: int = 0
    popped: int = 0
    retrieved: int = 0
    not_found: int = 0
    irrelevant: int = 0
    empty_rounds: int = 0


Criterion = Callable[[Progress], bool]


def enough_urls(n: int) -> Criterion:
    return lambda p: p.retrieved >= n


def queue_empty(rounds: int = 1) -> Criterion:
    return lambda p: p.empty_rounds >= rounds


def any_of(*criteria: Criterion) -> Criterion:
    return lambda p: any(c(p) for c in criteria)


@dataclass
class Crawl:
    results: DataFrame
    missing: DataFrame
    progress: Progress = field(default_factory=Progress)


def crawl(
    seeds: DataFrame, pages: DataFrame, batch: int, stop: Criterion, threshold: float = float("-inf"), max_rounds: int = 50, seed: int | None = None
) -> Crawl:
    """``seeds`` (url); ``pages`` (url, relevance, score, links, crawl_ts), one row for each URL."""
    spark = seeds.sparkSession
    queue = written(fr.seeds(seeds.distinct()).withColumn("seq", F.xxhash64("url")).withColumn("round", F.lit(0)), "queue")
    seen, waiting = queue.select("url"), queue.count()
    progress, found, lost = Progress(), [], []
    with in_buckets(pages.select("url", "relevance", "score", "links", "crawl_ts"), "url", "pages") as (analysed, n):
        while not stop(progress) and progress.rounds < max_rounds:
            progress.rounds += 1
            if not waiting:
                progress.empty_rounds += 1
                break
            # A queue that fits the batch is popped as it stands.
            whole = waiting <= batch
            popped = queue if whole else written(fr.pop(queue, batch, "seq", None if seed is None else seed + progress.rounds), "popped")
            took = waiting if whole else popped.count()
            progress.popped += took
            fetched = popped.select("url", "path", "priority").repartition(n, "url").join(analysed, "url", "left")
            fetched = written(fetched.filter(F.col("relevance").isNull() | (F.col("relevance") >= threshold)), "fetched")
            lost.append(fetched.filter(F.col("relevance").isNull()).select("url", "path", "priority"))
            kept = fetched.filter(F.col("relevance").isNotNull())
            gone, got = lost[-1].count(), kept.count()
            progress.not_found += gone
            progress.retrieved += got
            progress.irrelevant += took - gone - got
            found.append(kept)
            links = fr.outlinks(kept).withColumn("priority", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "priority")))
            new = fr.unseen(links, seen).withColumn("seq", F.xxhash64("url")).withColumn("round", F.lit(progress.rounds))
            new = written(new.select(*queue.columns), "queue")
            if whole:
                queue, waiting = new, new.count()
            else:
                rest = queue.join(popped.select("url"), "url", "left_anti")
                queue, waiting = written(rest.select(*new.columns).unionByName(new), "queue"), waiting - took + new.count()
            seen = seen.union(new.select("url"))
    empty = spark.createDataFrame([], "url string, path string, priority double, relevance double, score double, links array<string>, crawl_ts timestamp")
    results = empty
    for part in found:
        results = results.unionByName(part)
    missing = spark.createDataFrame([], "url string, path string, priority double")
    for part in lost:
        missing = missing.unionByName(part)
    return Crawl(results, missing, progress)
