"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Taken from ``spark.checkpoint.dir``. Only where that is unset, as in local
    tests, a folder under the warehouse is used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/tidemark-work"
    return root.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 2_000


def materialise(df: DataFrame, label: str, rows: int = BATCH_ROWS, per_file: int = 0) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, not a recompute, and
    Python stages upstream run once however often the result is read. Python gets
    at most ``rows`` rows at once; a file takes at most ``per_file`` (0: any number).
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    # Arrow batches of whole texts are kept small, in the JVM and in Python alike.
    usual = int(spark.conf.get(ARROW_ROWS, "10000"))
    spark.conf.set(ARROW_ROWS, str(min(usual, rows) if usual > 0 else rows))
    try:
        df.write.option("compression", "zstd").option("maxRecordsPerFile", per_file).parquet(path)
    finally:
        spark.conf.set(ARROW_ROWS, str(usual))
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete what ``materialise`` wrote for ``frames``, once everything derived from them is written as well."""
    for df in frames:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have, ``base`` if possible."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


#: Tables that Python workers keep from task to task, by operator.
KEPT: dict[str, dict] = {}


def start_task(operator: str) -> None:
    """Called first in a Python stage: drop what other operators' tasks left in this worker."""
    import ctypes

    import pyarrow as pa

    for name, kept in KEPT.items():
        if name != operator:
            kept.clear()
    pa.default_memory_pool().release_unused()
    # Freed memory goes back to the system where the C library can do that.
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def fold(id_col: Column | str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus`` (a null id: as empty text)."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    text = F.coalesce(col.cast("string"), F.lit(""))
    return F.crc32(F.encode(text, "UTF-8")) % modulus


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, label: str) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b of one orderable type): (node, component), the component its least node.

    Labels spread to neighbours and then jump to the label of their label, so the
    number of rounds grows with the logarithm of a component's diameter. Every
    round is written to the shared folder; only a count reaches the driver.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b")
    both = materialise(both.distinct(), f"{label}-edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("component")), label)
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("m"))
        spread = labels.join(near, labels["node"] == near["a"])
        spread = spread.select("node", F.col("component").alias("old"), F.least("component", "m").alias("component"))
        spread = materialise(spread, label)
        forget(labels)
        jump = spread.select(F.col("node").alias("at"), F.col("component").alias("root"))
        moved = spread.join(jump, spread["component"] == jump["at"])
        labels = materialise(moved.select("node", F.col("root").alias("component"), (F.col("old") != F.col("root")).alias("changed")), label)
        forget(spread)
        if not labels.filter("changed").limit(1).count():
            forget(both)
            return labels.select("node", "component")
