"""Readers and writers of the library's tables: topics, specifications, annotations, snapshot index, results."""

from __future__ import annotations

import zipfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import dates

TOPIC = "code string, from_date date, until_date date, before string, after string, description string, wikipedia string, keywords string"
INTERVAL = "struct<start:date,end:date,beforeFuzziness:string,afterFuzziness:string>"
SPEC = (
    f"name string, seedUrls array<string>, referenceDocuments array<string>, referenceTime {INTERVAL}, "
    "referenceVectors map<string,struct<elements:map<string,double>>>, keywords map<string,array<string>>, description string, "
    "defaultLanguage string, correctionFactors map<string,double>"
)
ANNOTATION = "campaign string, url string, timestamp timestamp, contentRelevance double, timeRelevance double, vote string, comment string"
SNAPSHOT_INDEX = "surt string, version long, origurl string, ts timestamp, filename string, offset long, length long, mime string, signature string"
RESULT = "url, crawlTime, path, status, crawlPriority, relevance, modifiedDate, snapshotsDuration, minRelevance, maxRelevance".split(", ")


def parse_topics(raw: DataFrame) -> DataFrame:
    """Topic rows with half-lives in days and titles as an array."""
    return raw.select(
        "code", "from_date", "until_date", dates.period_days(F.col("before")).alias("before_days"), dates.period_days(F.col("after")).alias("after_days"),
        "description", F.split("wikipedia", r",\s*").alias("titles"),
    )


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    return parse_topics(spark.read.csv(path, sep="\t", header=True, schema=TOPIC, dateFormat="yyyy-MM-dd"))


def read_specs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SPEC).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_name"))


def write_specs(specs: DataFrame, path: str) -> None:
    """Two variants of every specification: with keywords, and without."""
    specs.drop("file").write.mode("overwrite").json(f"{path}/with-keywords")
    specs.drop("file").withColumn("keywords", F.lit(None).cast("map<string,array<string>>")).write.mode("overwrite").json(f"{path}/without-keywords")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=ANNOTATION)


def read_idf(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split("value", r"\s+", 2)
    return spark.read.text(path).select(F.get(parts, 0).alias("term"), F.get(parts, 1).try_cast("double").alias("idf")).filter("idf is not null")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SNAPSHOT_INDEX).parquet(path)


def grep_lines(lines: DataFrame, pattern: str) -> DataFrame:
    """URLs (second field) of the lines (value) that a pattern matches."""
    return lines.filter(F.col("value").rlike(pattern)).select(F.get(F.split("value", r"\s+"), 1).alias("url")).distinct()


def grep_index(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return grep_lines(spark.read.text(path), pattern)


def merge_seeds(specs: DataFrame, seeds: DataFrame) -> DataFrame:
    """Specifications (name, ...) whose seed list is replaced by the rows (name, url); others are left out."""
    lists = seeds.groupBy("name").agg(F.array_sort(F.collect_set("url")).alias("seedUrls"))
    return specs.drop("seedUrls").join(lists, "name")


def result_rows(results: DataFrame, missing: DataFrame) -> DataFrame:
    """One table of found and missing URLs with the result columns; a missing URL has status 404."""
    lost = missing.select("url", "path", F.lit(404).alias("status"), F.col("priority").alias("crawlPriority"))
    return results.select(*RESULT).unionByName(lost, allowMissingColumns=True)


def write_tsv(results: DataFrame, missing: DataFrame, path: str) -> None:
    result_rows(results, missing).write.mode("overwrite").csv(path, sep="\t", header=True, nullValue="-")


def contents(results: DataFrame, order: str) -> DataFrame:
    """Table of contents of a collection: entry names in order of arrival."""
    return results.withColumn("file", F.concat((F.row_number().over(Window.orderBy(order)) - 1).cast("string"), F.lit(".html")))


def write_zip(results: DataFrame, missing: DataFrame, path: str, order: str) -> None:
    """A zip file on the driver's disk: pages, ``urls.csv`` and, if there is any, ``missing.csv`` (both tab separated).

    Rows stream through the driver one partition at a time.
    """
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        lines = []
        for i, r in enumerate(results.orderBy(order).toLocalIterator()):
            out.writestr(f"{i}.html", r["html"] or "")
            lines.append("\t".join(map(str, (r["url"], r["path"], r["relevance"], r["crawlTime"], f"{i}.html", r["modifiedDate"]))))
        out.writestr("urls.csv", "\n".join(["url\tpath\trelevance\tcrawlTime\tfile\tmodifiedDate", *lines]) + "\n")
        lost = ["\t".join(map(str, (r["url"], r["path"], r["priority"]))) for r in missing.toLocalIterator()]
        if lost:
            out.writestr("missing.csv", "\n".join(["url\tpath\tpriority", *lost]) + "\n")
