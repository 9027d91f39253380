"""Page analysis: one parse, then Column expressions; topic specifications; the experiment grid."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import dates, html, relevance, urls
from tidemark.operators import vectors
from tidemark.plans.crawl import written


def parse_pages(pages: DataFrame, fields: tuple[str, ...] = html.FIELDS) -> DataFrame:
    """(page_id, url, text, links, title, ...): text, normalised distinct links, and the page's date candidates, as far as ``fields`` names them.

    Only textual content is parsed: where there is a column ``mime``, other pages have an empty text and no links.
    """
    body = F.col("html")
    if "mime" in pages.columns:
        body = F.when(F.coalesce(F.col("mime"), F.lit("")).startswith("text"), body).otherwise(F.lit(""))
    # One call parses a page and resolves its links.
    parsed = pages.select("page_id", "url", html.parser(fields, urls.resolved)(body, F.col("url")).alias("p"))
    parsed = parsed.select("page_id", "url", *[F.col(f"p.{f}").alias(f) for f in html.FIELDS if f in fields])
    if "links" in fields:
        parsed = parsed.withColumn("links", F.array_distinct(F.filter(urls.cleaned(F.col("links")), urls.usable_link)))
    return parsed


def outlinks(pages: DataFrame) -> DataFrame:
    """(page_id, link): the distinct links of each page, absolute and normalised."""
    # An inner explode would make the planner parse every page once more, to see whether it has links.
    return parse_pages(pages, ("links",)).select("page_id", F.explode_outer("links").alias("link")).filter("link is not null")


def page_dates(parsed: DataFrame, as_of: str) -> DataFrame:
    """Date cascade of parsed pages: URL; else time and meta elements; else paragraphs that announce a date; else the text.

    A later step is tried only where the earlier ones give no valid date.
    """
    def first(values: Column, parse: Callable[[Column], Column]) -> Column:
        found = F.filter(F.transform(values, parse), lambda d: dates.is_valid(d, as_of))
        return F.try_element_at(found, F.lit(1))

    told = F.filter("paragraphs", lambda p: p.rlike(dates.TRIGGERS))
    content = F.coalesce(
        first(F.col("times"), lambda x: dates.liberal_date(x, as_of)),
        first(F.col("metas"), lambda x: dates.liberal_date(x, as_of)),
        first(told, dates.text_date),
        first(F.col("paragraphs"), dates.text_date),
    )
    none = F.lit(None).cast("timestamp")
    # Steps of their own keep the candidates from being worked out once for every use.
    parsed = parsed.withColumn("__url", dates.url_date(F.col("url"), as_of).cast("timestamp")).withColumn("__content", content)
    return parsed.withColumn("date", dates.modified_date(F.col("__url"), F.col("__content"), none, as_of)).drop("__url", "__content")


def analyse(pages: DataFrame, reference: DataFrame, interval: relevance.Interval, method: str, as_of: str, idf: DataFrame | None = None) -> DataFrame:
    """(page_id, url, relevance, modified, score, links); pages without text get relevance -1 and no links."""
    # Parsing is the costly part and its result is read several times: it is written once.
    parsed = written(page_dates(parse_pages(pages), as_of).drop("paragraphs", "times", "metas"), "parsed")
    sims = vectors.cosine(vectors.blocks(parsed, "page_id").weights(dictionary=idf), reference, "page_id")
    # The texts stay where they are.
    out = parsed.withColumn("blank", F.trim("text") == "").drop("text", "title").join(sims, "page_id", "left")
    blank = F.col("blank")
    sim, time = F.coalesce("sim", F.lit(0.0)), relevance.time_relevance(method, F.col("date.when"), interval)
    return out.select(
        "page_id", "url", F.when(blank, -1.0).otherwise(sim).alias("relevance"), F.col("date.when").alias("modified"),
        F.when(blank, 0.0).otherwise(relevance.outlink_score(method, sim, time)).alias("score"),
        F.when(blank, F.array().cast("array<string>")).otherwise(F.col("links")).alias("links"),
    )


def build_topics(docs: DataFrame, topic: str, key: str, max_terms: int = 100) -> DataFrame:
    """(topic, vector map, factor): reference vector and correction factor of every topic's documents."""
    blocks, topics = vectors.blocks(docs, key), docs.select(key, topic).distinct()
    weights = blocks.beside(blocks.weights(), topics)
    reference, factors = vectors.reference_model(weights, topic, key, max_terms, spread=lambda ref: blocks.spread(ref, topics, topic))
    packed = reference.groupBy(topic).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", "w")))).alias("vector"))
    return packed.join(factors, topic)


def experiments(specs: DataFrame) -> DataFrame:
    """Every specification with every method; content-based methods with 1, 10 and 100 snapshots, others with 1."""
    spark = specs.sparkSession
    methods = spark.createDataFrame([(m,) for m in relevance.METHODS], "method string")
    grid = specs.join(F.broadcast(methods))
    many = F.when(F.col("method").startswith("CONTENT"), F.array(F.lit(1), F.lit(10), F.lit(100))).otherwise(F.array(F.lit(1)))
    return grid.withColumn("snapshots", F.explode(many))
