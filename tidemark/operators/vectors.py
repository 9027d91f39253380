"""Sparse TF-IDF vectors in long form: one row for each document (or topic) and term.

Texts are dealt by document once and exploded where they lie: pairs of a document and a
term are counted, weighed and summed in place and never shuffled. What moves besides the
texts is each block's distinct terms, to and from the table of their idf.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as tx

BLOCK = "__block"
# Bytes of a block in the planner's estimate, which counts a table's files by the share of the columns read; a size of
# which the planner knows nothing is greater than any table's.
BLOCK_BYTES, UNKNOWN = 4 << 20, 1 << 60


def parts(docs: DataFrame) -> int:
    """Number of blocks for a table: they keep their size when it grows, and every core has one."""
    spark = docs.sparkSession
    told, cores = int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return told if size >= UNKNOWN else min(max(cores, -(-size // BLOCK_BYTES)), 16 * max(told, cores))


def _deal(table: DataFrame, key: str, n: int) -> DataFrame:
    block = F.coalesce(F.pmod(F.xxhash64(key), F.lit(n)).cast("int"), F.lit(0))
    return table.withColumn(BLOCK, block).repartitionById(n, BLOCK)


def _own(frame: DataFrame, *keys: str) -> list[str]:
    """Columns to group a frame's rows by keys: with the block, where it has one, that is done in place."""
    return [*([BLOCK] if BLOCK in frame.columns else []), *keys]


@dataclass(frozen=True)
class Blocks:
    """Documents (key, text) dealt into ``n`` blocks of whole documents by ``blocks``."""

    docs: DataFrame
    key: str
    n: int

    def counts(self) -> DataFrame:
        """(block, key, term, n, total), total being the number of a document's tokens."""
        words = self.docs.select(BLOCK, self.key, tx.tokens(F.col("text")).alias("words"))
        words = words.withColumn("total", F.sum(F.size("words")).over(Window.partitionBy(BLOCK, self.key)))
        words = words.select(BLOCK, self.key, "total", F.explode("words").alias("term"))
        return words.groupBy(BLOCK, self.key, "total", "term").agg(F.count(F.lit(1)).alias("n"))

    def idf(self, dictionary: DataFrame | None = None) -> DataFrame:
        """(block, term, idf) of each block's terms: ln(documents / df), or a dictionary's (term, idf)."""
        terms = self.docs.select(BLOCK, self.key, F.explode(tx.tokens(F.col("text"))).alias("term")).distinct()
        held = terms.groupBy(BLOCK, "term").agg(F.count(F.lit(1)).alias("n"))
        if dictionary is not None:
            found = with_idf(held, dictionary)
        else:
            worded = self.docs.filter(F.lower("text").rlike(tx.TOKEN)).select(BLOCK, self.key).distinct()
            documents = worded.agg(F.count(self.key).alias("documents"))
            df = F.sum("n").over(Window.partitionBy("term"))
            found = held.withColumn("df", df).join(F.broadcast(documents)).withColumn("idf", F.log(F.col("documents") / F.col("df")))
        return found.select(BLOCK, "term", "idf").repartitionById(self.n, BLOCK)

    def weights(self, keywords: list[str] | None = None, dictionary: DataFrame | None = None) -> DataFrame:
        """(block, key, term, w) as ``tfidf`` has them. A block's terms are a hash table of bounded size."""
        counts = self.counts().filter(~tx.is_noise(F.col("term"), F.col("n"), F.col("total")))
        return _weighed(counts.join(self.idf(dictionary).hint("shuffle_hash"), [BLOCK, "term"]), keywords, BLOCK, self.key)

    def beside(self, rows: DataFrame, table: DataFrame) -> DataFrame:
        """Inner join of rows of blocks with a table on the documents' key, in place."""
        return rows.join(_deal(table, self.key, self.n).hint("shuffle_hash"), [BLOCK, self.key])

    def spread(self, table: DataFrame, groups: DataFrame, group: str) -> DataFrame:
        """A table by group sent to the blocks that hold a document of the group; ``groups``: (key, group)."""
        asked = _deal(groups, self.key, self.n).select(BLOCK, group).distinct()
        return asked.join(table, group).repartitionById(self.n, BLOCK)


def blocks(docs: DataFrame, key: str, text: str = "text") -> Blocks:
    n = parts(docs.select(key, text))
    return Blocks(_deal(docs.select(key, F.col(text).alias("text")).filter("text is not null"), key, n), key, n)


def term_counts(docs: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """(keys, term, n) with n as long; the keys name a document. Texts are dealt by keys, pairs are counted in place."""
    docs = docs.select(*keys, F.col(text))
    words = docs.repartition(parts(docs), *keys).select(*keys, F.explode(tx.tokens(F.col(text))).alias("term"))
    return words.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("n"))


def relative_tf(counts: DataFrame, key: str) -> DataFrame:
    total = F.sum("n").over(Window.partitionBy(key))
    return counts.withColumn("total", total).withColumn("tf", F.col("n") / F.col("total"))


def idf_table(counts: DataFrame, key: str) -> DataFrame:
    """(term, df, idf = ln(documents / df))."""
    documents = counts.agg(F.count_distinct(key).alias("documents"))
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.join(F.broadcast(documents)).select("term", "df", F.log(F.col("documents") / F.col("df")).alias("idf"))


def least_idf(dictionary: DataFrame) -> DataFrame:
    """A dictionary (term, idf) by stem: the least idf of the forms that share it."""
    return dictionary.groupBy(tx.stem(F.col("term")).alias("term")).agg(F.min("idf").alias("idf"))


def with_idf(counts: DataFrame, idf: DataFrame) -> DataFrame:
    """Join idf; terms without one get the greatest (1 for an empty dictionary)."""
    most = idf.agg(F.coalesce(F.max("idf"), F.lit(1.0)).alias("most"))
    joined = counts.join(idf.select("term", "idf"), "term", "left").join(F.broadcast(most))
    return joined.withColumn("idf", F.coalesce("idf", "most")).drop("most")


def tfidf(counts: DataFrame, idf: DataFrame, key: str, keywords: list[str] | None = None) -> DataFrame:
    """(key, term, w): keyword weight x (1 + ln n) x idf, noise tokens left out."""
    weighed = with_idf(relative_tf(counts, key).filter(~tx.is_noise(F.col("term"), F.col("n"), F.col("total"))), idf)
    return _weighed(weighed, keywords, key)


def _weighed(counts: DataFrame, keywords: list[str] | None, *keys: str) -> DataFrame:
    k = tx.keyword_weight(F.col("term"), F.array(*map(F.lit, keywords))) if keywords else F.lit(1.0)
    return counts.select(*keys, "term", (k * tx.tf(F.col("n")) * F.col("idf")).alias("w"))


def merge(vectors: DataFrame, group: str, key: str, use_df: bool = False) -> DataFrame:
    """(group, term, w): sums over the group's documents, with ``use_df`` times the share of documents that hold the term."""
    total = F.sum("w")
    if use_df:
        documents = vectors.select(*_own(vectors, key, group)).distinct().groupBy(group).agg(F.count(key).alias("documents"))
        # One row for each group.
        out = vectors.groupBy(group, "term").agg(total.alias("w"), F.count(F.lit(1)).alias("df")).join(F.broadcast(documents), group)
        return out.select(group, "term", (F.col("w") * F.col("df") / F.col("documents")).alias("w"))
    return vectors.groupBy(group, "term").agg(total.alias("w"))


def top_terms(vectors: DataFrame, group: str, n: int) -> DataFrame:
    order = Window.partitionBy(group).orderBy(F.desc(F.round("w", 6)), "term")
    return vectors.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= n)


def norms(vectors: DataFrame, key: str) -> DataFrame:
    return vectors.groupBy(*_own(vectors, key)).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")).select(key, "norm")


def cosine(vectors: DataFrame, reference: DataFrame, key: str, group: str | None = None) -> DataFrame:
    """(key[, group], sim) with 0 where nothing is shared or a norm is 0.

    ``reference``: ([group,] term, w). A single reference, which is the top terms of a topic,
    is broadcast, and a document's norm is summed beside its dot product in one aggregation.
    """
    ref = reference.select(*([group] if group else []), "term", F.col("w").alias("rw"))
    if group is None:
        joined = vectors.join(F.broadcast(ref), "term", "left")
        size = reference.agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("rn"))
        sums = joined.groupBy(*_own(vectors, key)).agg(F.sum(F.col("w") * F.coalesce("rw", F.lit(0.0))).alias("dot"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
        return sums.join(F.broadcast(size)).select(key, guarded(F.col("dot"), F.col("norm") * F.col("rn")).alias("sim"))
    dots = vectors.join(ref, "term").groupBy(key, group).agg(F.sum(F.col("w") * F.col("rw")).alias("dot"))
    sizes = norms(reference, group).withColumnRenamed("norm", "rn")
    out = dots.join(norms(vectors, key), key).join(sizes, group)
    return out.select(key, group, guarded(F.col("dot"), F.col("norm") * F.col("rn")).alias("sim"))


def guarded(dot: Column, size: Column) -> Column:
    value = F.try_divide(dot, size)
    return F.when(F.isnan(value) | F.abs(value).isin(float("inf")), 0.0).otherwise(F.coalesce(value, F.lit(0.0)))


def map_cosine(a: Column, b: Column) -> Column:
    """Cosine of two map<string, double> columns inside one row."""
    shared = F.array_intersect(F.map_keys(a), F.map_keys(b))
    dot = F.aggregate(shared, F.lit(0.0), lambda s, k: s + F.element_at(a, k) * F.element_at(b, k))
    size = lambda m: F.sqrt(F.aggregate(F.map_values(m), F.lit(0.0), lambda s, w: s + w * w))
    return guarded(dot, size(a) * size(b))


def correction(sims: DataFrame, group: str) -> DataFrame:
    """Mean similarity of a topic's own documents to its reference; 1 where there is none."""
    return sims.groupBy(group).agg(F.coalesce(F.avg("sim"), F.lit(1.0)).alias("factor"))


def corrected(sims: DataFrame, factors: DataFrame, group: str) -> DataFrame:
    joined = sims.join(factors, group, "left")
    return joined.withColumn("sim", guarded(F.col("sim"), F.coalesce("factor", F.lit(1.0)))).drop("factor")


def with_fallback(rows: DataFrame, table: DataFrame, key: str, default: str) -> DataFrame:
    """Left join on ``key``; rows without a partner get the default key's values."""
    values = [c for c in table.columns if c != key]
    own = rows.join(table, key, "left")
    other = table.filter(F.col(key) == default).select(*[F.col(v).alias(f"__{v}") for v in values]).limit(1)
    return own.join(F.broadcast(other), how="left").select(*rows.columns, *[F.coalesce(v, f"__{v}").alias(v) for v in values])


def reference_model(
    vectors: DataFrame, group: str, key: str, max_terms: int = 100, use_df: bool = False, spread: Callable[[DataFrame], DataFrame] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Reference vectors of topics (top terms of their merged documents) and their correction factors.

    A document is compared with the reference of its own topic. ``spread`` sends references to the vectors' blocks.
    """
    reference = top_terms(merge(vectors, group, key, use_df), group, max_terms).drop("rank")
    size = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(group)))
    ref = reference.withColumn("rn", size).withColumnRenamed("w", "rw")
    joined = vectors.join(spread(ref).hint("shuffle_hash") if spread else ref, _own(vectors, group, "term"), "left")
    sums = joined.groupBy(*_own(vectors, key, group)).agg(
        F.sum(F.col("w") * F.col("rw")).alias("dot"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.max("rn").alias("rn")
    )
    sims = sums.filter("dot is not null").select(group, guarded(F.col("dot"), F.col("norm") * F.col("rn")).alias("sim"))
    return reference, correction(sims, group)
