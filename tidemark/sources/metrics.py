"""Counters of batch and streaming runs, written as CSV lines."""

from __future__ import annotations

import csv
import logging
import time

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

log = logging.getLogger(__name__)


def observed(results: DataFrame, name: str = "results") -> tuple[DataFrame, Observation]:
    """``results`` (relevance, links) with counters that fill while an action runs: no second pass."""
    observation = Observation(name)
    row = (
        F.count(F.lit(1)).alias("retrieved"),
        F.count(F.when(F.col("relevance") < 0, 1)).alias("empty"),
        F.sum(F.coalesce(F.size("links"), F.lit(0))).alias("outlinks"),
        F.percentile_approx(F.coalesce(F.size("links"), F.lit(0)), 0.5).alias("median_outlinks"),
    )
    return results.observe(observation, *row), observation


def append_csv(path: str, values: dict) -> None:
    """One line (time, name, value) for each counter."""
    with open(path, "a", newline="") as f:
        out = csv.writer(f)
        for name, value in sorted(values.items()):
            out.writerow([round(time.time(), 3), name, value])


class CsvListener(StreamingQueryListener):
    """Progress of streaming queries as CSV lines on the driver."""

    def __init__(self, path: str):
        self.path = path

    def onQueryStarted(self, event):
        log.info("query %s started", event.id)

    def onQueryProgress(self, event):
        p = event.progress
        append_csv(self.path, {"rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond, "batch": p.batchId})

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        log.info("query %s ended", event.id)


def log_rows(df: DataFrame, epoch: int) -> None:
    """A ``foreachBatch`` sink that logs how many rows a batch has."""
    log.info("batch %d: %d rows", epoch, df.count())
