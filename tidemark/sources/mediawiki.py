"""Stored MediaWiki parse responses as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = (
    "parse struct<title:string,pageid:long,revid:long,text:struct<`*`:string>,langlinks:array<struct<lang:string,url:string,`*`:string>>,"
    "categories:array<struct<sortkey:string,`*`:string>>,links:array<struct<ns:int,exists:string,`*`:string>>,"
    "externallinks:array<string>,properties:array<struct<name:string,`*`:string>>>"
)


def pages(raw: DataFrame, column: str = "value") -> DataFrame:
    """Parsed pages; an empty string in a flag means true, named lists become maps."""
    p = F.from_json(F.col(column), PAGE)["parse"]
    flag = lambda c: c.isNotNull()
    return raw.select(p.alias("p")).select(
        F.col("p.title").alias("title"), F.col("p.pageid").alias("page_id"), F.col("p.revid").alias("rev_id"), F.col("p.text")["*"].alias("html"),
        F.transform("p.links", lambda x: F.struct(x["*"].alias("title"), flag(x["exists"]).alias("exists"))).alias("links"),
        F.col("p.externallinks").alias("external_links"),
        F.map_from_entries(F.transform("p.properties", lambda x: F.struct(x["name"], x["*"]))).alias("properties"),
        F.transform("p.langlinks", lambda x: F.struct(x["lang"].alias("lang"), x["*"].alias("title"))).alias("lang_links"),
    )


def external_links(parsed: DataFrame) -> DataFrame:
    return parsed.select("title", F.explode("external_links").alias("url")).filter(~F.col("url").startswith("//")).distinct()


def entity(column: Column) -> Column:
    """A named entity from its JSON form."""
    return F.from_json(column, "type string, labels array<struct<name:string,language:string>>")
