"""URL predicates and normalisers as Column functions."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from urllib.parse import quote, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rewrite rules in order (pattern, replacement).
REWRITES = [
    (r"(?i)(;?\b_?(l|j|bv_)?(sid|phpsessid|sessionid)=.*?)(\?|&|#|$)", "$4"),
    (r"/((?i)index|default)\.((?i)js[pf]{1}?[afx]?|cgi|cfm|asp[x]?|[psx]?htm[l]?|php[3456]?)(\?|&|#|$)", "/$3"),
    (r"#.*?(\?|&|$)", "$1"),
    (r"\?&", "\\?"),
    (r"&{2,}", "&"),
    (r"[\?&\.]$", ""),
    (r"(?<!:)/{2,}", "/"),
]
# Prefixes of archives and redirectors, unwrapped in order.
WRAPPERS = [
    r"https://web.archive.org/web/\d+/(.*)",
    r"https://archive.is/\d+/(.*)",
    r"https://archive.is/(.*)\*$",
    r"http://www.webcitation.org/[a-zA-Z0-9]+\?url=(.*)",
    r"http://derefer.unbubble.eu/?\?u=(.*)",
    r"http://deadurl.invalid/(.*)",
]
# Names of tracking parameters, and the hosts allowed as seeds.
TRACKING = r"(?i)^utm_|sess(ion)?id"
SEEDS = r"^https?://[a-z0-9.-]*?\.de/"


def only_http(url: Column) -> Column:
    return F.coalesce(url.startswith("http:") | url.startswith("https:"), F.lit(False))


def accept_all(url: Column) -> Column:
    return url.isNotNull()


def usable_link(url: Column) -> Column:
    """Neither blank nor of another scheme than http(s)."""
    return F.coalesce((F.trim(url) != "") & url.startswith("http"), F.lit(False))


def allowed_seed(url: Column) -> Column:
    return F.coalesce(url.rlike(SEEDS), F.lit(False))


def external_link(url: Column) -> Column:
    """Not protocol-relative."""
    return ~url.startswith("//")


def article_link(name: Column) -> Column:
    """Neither a list nor a template page."""
    return ~(name.startswith("Liste ") | name.startswith("Vorlage:"))


def rewrite(url: Column) -> Column:
    return reduce(lambda c, rule: F.regexp_replace(c, F.lit(rule[0]), F.lit(rule[1])), REWRITES, url)


def unwrap(url: Column) -> Column:
    return reduce(lambda c, pattern: F.regexp_replace(c, F.lit(pattern), F.lit("$1")), WRAPPERS, url)


def parse_query(query: Column) -> Column:
    """array<struct<name, value>>; '+' is a space, percent signs stay, empty segments go."""
    parts = F.filter(F.split(query, "&"), lambda x: x != "")
    spaced = lambda c: F.translate(c, "+", " ")

    def pair(x: Column) -> Column:
        at = F.instr(x, "=")
        name = F.when(at > 0, F.substring_index(x, "=", 1)).otherwise(x)
        value = F.when(at > 0, x.substr(at + 1, F.length(x))).otherwise(F.lit(""))
        return F.struct(spaced(name).alias("name"), spaced(value).alias("value"))

    return F.transform(parts, pair)


def encode(text: Column) -> Column:
    """Percent-encoding of all but letters, digits, ``*-._`` and the space."""
    return F.translate(F.url_encode(text), "+", " ")


def param(params: Column, name: str) -> Column:
    return F.try_element_at(F.filter(params, lambda p: p["name"] == name), F.lit(1))["value"]


def params_of(params: Column, name: str) -> Column:
    return F.transform(F.filter(params, lambda p: p["name"] == name), lambda p: p["value"])


def has_param(params: Column, name: str) -> Column:
    return F.exists(params, lambda p: p["name"] == name)


def without_param(params: Column, name: str) -> Column:
    return F.filter(params, lambda p: p["name"] != name)


def with_appended(params: Column, name: str, value: str) -> Column:
    return F.concat(params, F.array(F.struct(F.lit(name).alias("name"), F.lit(value).alias("value"))))


def with_param(params: Column, name: str, value: str) -> Column:
    return with_appended(without_param(params, name), name, value)


def format_query(params: Column) -> Column:
    return F.array_join(F.transform(params, lambda p: F.when(p["value"] == "", p["name"]).otherwise(F.concat(p["name"], F.lit("="), p["value"]))), "&")


def strip_tracking(url: Column) -> Column:
    """Drop tracking parameters and the fragment, sort the rest by name (equal names keep their order)."""
    bare = F.substring_index(url, "#", 1)
    base = F.substring_index(bare, "?", 1)
    query = F.when(F.instr(bare, "?") > 0, bare.substr(F.instr(bare, "?") + 1, F.length(bare))).otherwise(F.lit(""))
    numbered = F.transform(
        F.filter(parse_query(query), lambda p: ~p["name"].rlike(TRACKING)),
        lambda p, i: F.struct(p["name"].alias("name"), i.alias("pos"), p["value"].alias("value")),
    )
    text = format_query(F.array_sort(numbered))
    return F.when(text == "", base).otherwise(F.concat(base, F.lit("?"), text))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def surt(url: Column) -> Column:
    """Sort-friendly key: host labels reversed, then path and query in lower case; ``www.`` and ports go."""
    name = F.regexp_replace(host(url), r"^www\d*\.", "")
    rest = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^#]*)", 1))
    rest = F.regexp_replace(rest, r"/(?=$|\?)", "")
    rest = F.when(rest == "", F.lit("/")).otherwise(rest)
    return F.concat(F.array_join(F.reverse(F.split(name, r"\.")), ","), F.lit(")"), rest)


def _segments(path: str) -> str:
    out: list[str] = []
    for part in path.split("/"):
        if part == "..":
            if len(out) > 1:
                out.pop()
        elif part != ".":
            out.append(part)
    if path.endswith(("/.", "/..")):
        out.append("")
    return "/".join(out)


def canonical(url: str | None) -> str | None:
    """RFC 3986 form of one URL: null if it has no scheme and host, unchanged if it cannot be taken apart."""
    if url is None:
        return None
    text = re.sub(r"[\t\r\n]", "", url).strip()
    try:
        parts = urlsplit(text)
        port = parts.port
    except ValueError:
        return None
    if not parts.scheme or not parts.hostname:
        return None
    try:
        name = parts.hostname.encode("idna").decode() if not parts.hostname.isascii() else parts.hostname
    except UnicodeError:
        return url
    if port and (parts.scheme, port) not in (("http", 80), ("https", 443)):
        name = f"{name}:{port}"
    path = quote(_segments(parts.path or "/"), safe="/%:@!$&'()*+,;=-._~")
    query = quote(parts.query, safe="/?%:@!$&'()*+,;=-._~")
    return urlunsplit((parts.scheme.lower(), name, path, query, ""))


@F.pandas_udf(T.StringType())
def canonicalise_udf(url: pd.Series) -> pd.Series:
    return url.map(canonical, na_action="ignore")


def canonicalise(url: Column) -> Column:
    """Strip tracking parameters and fragment, then the RFC 3986 form."""
    return canonicalise_udf(strip_tracking(F.regexp_replace(url, r"[\t\r\n]", "")))


@F.pandas_udf(T.StringType())
def resolve(base: pd.Series, link: pd.Series) -> pd.Series:
    def one(b, x):
        try:
            return urljoin(b, x)
        except ValueError:
            return None

    return pd.Series([None if b is None or x is None else one(b, x) for b, x in zip(base, link, strict=True)], dtype=object)


def resolved(base: str | None, links: list[str]) -> list[str]:
    """Web links against the page's address, in normal form; those that can't be resolved are left out."""
    out = []
    for x in links:
        try:
            full = urljoin(base or "", x) if x else ""
        except ValueError:
            continue
        if full.startswith("http") and (found := canonical(full)):
            out.append(found)
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def _absolute(base: pd.Series, links: pd.Series) -> pd.Series:
    return pd.Series([None if xs is None else resolved(b, xs) for b, xs in zip(base, links, strict=True)], dtype=object)


def cleaned(links: Column) -> Column:
    """Links in normal form without tracking parameters."""
    return F.transform(links, lambda x: rewrite(strip_tracking(x)))


def absolute_links(base: Column, links: Column) -> Column:
    """A page's links resolved against its address, web links alone, in normal form, without tracking parameters."""
    return cleaned(_absolute(base, links))


def compose(*steps: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """Normalisers one after the other; a null stays null."""
    return lambda url: reduce(lambda c, step: F.when(c.isNotNull(), step(c)), steps, url)


normalise = compose(canonicalise, rewrite)


def keyword_variants(keyword: Column) -> Column:
    """URL spellings of a keyword, distinct and sorted, as one alternation ``(a)|(b)...``."""
    low = F.lower(keyword)
    german = reduce(lambda c, r: F.replace(c, F.lit(r[0]), F.lit(r[1])), [("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")], low)
    accents = F.translate(low, "äöüáàâéèêëíìîïóòôúùûñç", "aouaaaeeeeiiiiooouuunc")
    gap = lambda c: F.replace(c, F.lit(" "), F.lit(".?"))
    variants = F.array(gap(low), gap(german), gap(accents), F.replace(encode(low), F.lit(" "), F.lit(".?")))
    return F.concat(F.lit("("), F.array_join(F.array_sort(F.array_distinct(variants)), ")|("), F.lit(")"))
