"""Exact deduplication by a 128-bit content hash, with bytes compared inside groups.

Rows are grouped by the MD5 of the normalised text *and* the text itself, so two
texts share a group only if their bytes are the same: a hash collision can never
merge them. The grouping is a partial/final aggregation, so thousands of copies
collapse on the map side before anything is shuffled. The second step joins only
ids and hashes (no text), and adaptive skew join may split a hot group.

Defined cases: null text is the empty text; the empty text is a text like any
other; a null id sorts after every other id and stays only when all ids of its
group are null; repeated rows of one id are counted one by one in ``group_size``
and share their decision; an empty table gives an empty result; other columns of
the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = r"[\x20\x09-\x0D]+"


def normalise(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    rows = df.select(F.col(id_col).alias("doc_id"), normalise(F.col(text_col)).alias("body"))
    rows = rows.withColumn("h", F.unhex(F.md5("body")))
    classes = (
        rows.groupBy("h", "body")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("h", F.sha2("body", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    keys = rows.select("doc_id", "h", F.sha2("body", 256).alias("text_sha256"))
    return keys.join(classes, ["h", "text_sha256"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns."""
    stay = exact_dedup(df, id_col, text_col).filter("kept").select(F.col("doc_id").alias("__stay")).distinct()
    return df.join(stay, df[id_col].eqNullSafe(F.col("__stay")), "left_semi")
