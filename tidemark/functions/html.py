"""HTML pages to text, links and dates in one parse, as an Arrow-batched function."""

from __future__ import annotations

from collections.abc import Callable
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.dates import META_ATTRIBUTES, META_KEYS

# Tags that start a new paragraph, tags without text, tags without end, paragraph parents.
BLOCK = frozenset(
    "html head body frameset script noscript style meta link title frame noframes section nav aside hgroup header footer p h1 h2 h3 h4 h5 h6 "
    "ul ol pre div blockquote hr address figure figcaption form fieldset ins del s dl dt dd li table caption thead tfoot tbody colgroup col tr "
    "th td video audio canvas details menu plaintext".split()
)
IGNORED = frozenset(("script", "style", "head"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
PARAGRAPH = frozenset("p div li dd dt blockquote pre caption th td".split())

FIELDS = ("text", "paragraphs", "links", "times", "metas", "title")
_LIST = T.ArrayType(T.StringType())
PARSED = T.StructType([T.StructField(f, T.StringType() if f in ("text", "title") else _LIST) for f in FIELDS])


def is_block(tag: str) -> bool:
    return tag.lower() in BLOCK


def is_ignored(tag: str) -> bool:
    return tag.lower() in IGNORED


class _Page(HTMLParser):
    def __init__(self, only: frozenset[str] | None = None):
        super().__init__(convert_charrefs=True)
        self.done: list[str] = []
        self.buffer = ""
        self.links: list[str] = []
        self.times: list[str] = []
        self.metas: list[str] = []
        self.title = ""
        self.ignored: list[str] = []
        self.open: list[str] = []
        self.only = only

    def flush(self) -> None:
        text = self.buffer.rstrip()
        if text:
            self.done.append(text)
        self.buffer = ""

    def handle_starttag(self, tag, attrs):
        values = dict(attrs)
        if tag == "a" and values.get("href"):
            self.links.append(values["href"].strip())
        elif tag == "time" and values.get("datetime"):
            self.times.append(values["datetime"])
        elif tag == "meta" and values.get("content"):
            if any((values.get(a) or "").lower() in META_KEYS for a in META_ATTRIBUTES):
                self.metas.append(values["content"])
        if tag == "body":
            self.ignored.clear()  # a head that was never closed
        if tag in BLOCK:
            self.flush()
        if tag == "br":
            self.buffer += "\n"
        if tag not in VOID:
            self.open.append(tag)
            if tag in IGNORED:
                self.ignored.append(tag)

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open.pop() != tag:
                pass
        if tag in self.ignored:
            while self.ignored.pop() != tag:
                pass

    def handle_data(self, data):
        if self.open and self.open[-1] == "title":
            self.title += data
        if self.ignored or (self.only and not self.only & set(self.open)):
            return
        text = " ".join(data.split())
        if not text:
            if data and self.buffer and not self.buffer[-1].isspace():
                self.buffer += " "
            return
        if data[0].isspace() and self.buffer and not self.buffer[-1].isspace():
            self.buffer += " "
        self.buffer += text + (" " if data[-1].isspace() else "")


def parse(html: str | None, only: frozenset[str] | None = None) -> dict | None:
    """Text and parts of one page; ``only`` keeps text inside the given tags."""
    if html is None:
        return None
    page = _Page(only)
    page.feed(html)
    page.close()
    page.flush()
    return {
        "text": "\n\n".join(page.done), "paragraphs": page.done, "links": page.links, "times": page.times, "metas": page.metas,
        "title": " ".join(page.title.split()),
    }


# Pages that are Python objects at one time; what is parsed goes to Arrow arrays.
SLICE = 64


def parser(fields: tuple[str, ...] = FIELDS, resolve: Callable[[str | None, list[str]], list[str]] | None = None):
    """An Arrow function of (html, address) that gives the named parts of a page, its links as ``resolve`` (address, links) has them.

    Leave out fields that are not used: Python holds and sends what is named here.
    """
    kind = T.StructType([f for f in PARSED if f.name in fields])
    arrow = pa.struct([(f.name, pa.string() if f.dataType == T.StringType() else pa.list_(pa.string())) for f in kind])

    def one(page: str | None, address: str | None) -> dict:
        found = parse(page) or {}
        if resolve and found and "links" in fields:
            found["links"] = resolve(address, found["links"])
        return {f: found.get(f) for f in kind.names}

    @F.arrow_udf(kind)
    def run(html: pa.Array, address: pa.Array) -> pa.Array:
        cuts = range(0, len(html), SLICE)
        parts = [pa.array(list(map(one, html.slice(i, SLICE).to_pylist(), address.slice(i, SLICE).to_pylist())), type=arrow) for i in cuts]
        return pa.concat_arrays(parts) if parts else pa.array([], type=arrow)

    return run


def html_parse(html: Column) -> Column:
    """All parts of a page, links as they stand in it."""
    return parser()(html, F.lit(None).cast("string"))


def walk(html: str, skip: frozenset[str] = frozenset()) -> list[str]:
    """Nodes in document order: ``#document``, tag names, and ``"text"``; skipped tags go with all below them."""
    out, depth = ["#document"], []

    class Walker(HTMLParser):
        def handle_starttag(self, tag, attrs):
            if depth:
                if tag not in VOID:
                    depth.append(tag)
            elif tag in skip:
                if tag not in VOID:
                    depth.append(tag)
            else:
                out.append(tag)

        def handle_endtag(self, tag):
            if tag in depth:
                while depth.pop() != tag:
                    pass

        def handle_data(self, data):
            if not depth and data.strip():
                out.append(f'"{data}"')

    walker = Walker()
    walker.feed(html)
    walker.close()
    return out


@F.udtf(returnType=T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("node", T.StringType())]))
class HtmlNodes:
    """Table function: the nodes of a page in document order."""

    def eval(self, html: str):
        if html is not None:
            yield from enumerate(walk(html))


@F.udtf(returnType=T.StructType([T.StructField("link", T.StringType())]))
class HtmlLinks:
    """Table function: the links of a page in document order."""

    def eval(self, html: str):
        for link in (parse(html) or {"links": []})["links"]:
            yield (link,)


def looks_like_html(content: Column) -> Column:
    return F.coalesce(F.upper(F.substring(content, 1, 1024)).contains("<HTML"), F.lit(False))


def hrefs(html: Column) -> Column:
    """Fast path without a parse: double-quoted href values."""
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'), 1)


def script_texts(html: Column) -> Column:
    """String literals of more than three words inside scripts, unescaped."""
    scripts = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*>(.*?)</script>"), 1)
    strings = F.flatten(F.transform(scripts, lambda s: F.regexp_extract_all(s, F.lit('"([^"]*)"'), 1)))
    plain = F.transform(strings, lambda s: F.replace(F.replace(F.replace(s, F.lit("\\n"), F.lit("\n")), F.lit("\\'"), F.lit("'")), F.lit("\\/"), F.lit("/")))
    return F.filter(plain, lambda s: F.size(F.split(F.trim(s), r"\s+")) > 3)


def register(spark) -> None:
    """SQL names for the table functions and the parser."""
    spark.udtf.register("html_nodes", HtmlNodes)
    spark.udtf.register("html_links", HtmlLinks)
    spark.udf.register("html_parse", F.udf(lambda page: parse(page), PARSED))
