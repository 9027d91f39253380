"""Dates from URLs, meta data and free text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

FIRST = "1990-01-01"
# Month names of three languages, as (name, number).
MONTHS = {
    **dict(zip("january february march april may june july august september october november december".split(), range(1, 13))),
    **dict(zip("jan feb mar apr may jun jul aug sep oct nov dec".split(), range(1, 13))),
    **dict(zip("januar februar märz april mai juni juli august september oktober november dezember".split(), range(1, 13))),
    **dict(zip("jan feb mär apr mai jun jul aug sep okt nov dez".split(), range(1, 13))),
    **dict(zip("января февраля марта апреля мая июня июля августа сентября октября ноября декабря".split(), range(1, 13))),
}
ENGLISH = {
    **dict(zip("january february march april may june july august september october november december".split(), range(1, 13))),
    **dict(zip("jan feb mar apr may jun jul aug sep oct nov dec".split(), range(1, 13))),
}
# Attribute values that mark a date, and the attributes that may hold them.
META_KEYS = (
    "article:published_time", "datepublished", "og:updated_time", "last-modified", "article:modified_time", "date",
    "datemodified", "pubdate", "og:modified_time", "lastmod", "dc.date", "modified",
)
META_ATTRIBUTES = ("name", "http-equiv", "property", "itemprop")
# Words that announce a date.
TRIGGERS = r"(?iu)created?|updated?|modified|last modifi|letzte? (ge|ver)?änder|publi(z|sh)"
# Free-text patterns in order, with the places of year, month, day, hour and minute.
TEXT_PATTERNS = [
    (r"(?U)(\d{4})-(\d{2})-(\d{2})", 1, 2, 3, 0, 0),
    (r"(?U)(\d{1,2})\.\s*(\d{1,2})\.\s*(\d{2,4})", 3, 2, 1, 0, 0),
    (r"(?U)(\d{1,2})\.?\s*(\w+)\.?\s+(\d{2,4})(?:,\s*(\d{1,2}):(\d{1,2})(?: Uhr)?)?", 3, 2, 1, 4, 5),
    (r"(?U)(\w+)\s+(\d{1,2})[\.,]\s*(\d{4})", 3, 1, 2, 0, 0),
    (r"(?U)(\d{1,2})/(\d{1,2})/(\d{4})", 3, 1, 2, 0, 0),
    (r"(?U)(\d{1,2})/(\d{1,2})/(\d{4})", 3, 2, 1, 0, 0),
]
# Date sources from best to worst.
SOURCES = ("URL", "TIME", "META", "TRIGGER_WORD", "TEXT_DATE", "HEADER", "NOT_FOUND")


def is_valid(when: Column, as_of: str) -> Column:
    """Strictly after 1990 began and strictly before ``as_of``."""
    return F.coalesce((when > F.lit(FIRST).cast("timestamp")) & (when < F.lit(as_of).cast("timestamp")), F.lit(False))


def half_day(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"a\.m\.", "AM"), r"p\.m\.", "PM")


def is_meta_key(key: Column) -> Column:
    return F.coalesce(F.lower(key).isin(*META_KEYS), F.lit(False))


def url_date_fast(url: Column) -> Column:
    """Date of a ``/yyyy/m/d/`` path, or null."""
    part = lambda k: F.regexp_extract(url, r"/(\d{4})/(\d{1,2})/(\d{1,2})(?:/|$)", k).try_cast("int")
    return F.try_make_timestamp(part(1), part(2), part(3), F.lit(0), F.lit(0), F.lit(0.0)).cast("date")


def _first(items: Column) -> Column:
    return F.get(items, 0)


def url_date(url: Column, as_of: str) -> Column:
    """Date that the segments of a URL's path spell, or null if it is incomplete or impossible.

    Segments are sorted by kind first: years (four digits, 1990 to the year of ``as_of``), compact
    dates (eight digits), numbers (one or two digits) and names of English months. A compact date
    with no year before it is the date; later years replace its year. Otherwise the last year
    counts; the month is the first name or number, whichever comes first, where the first
    number from 13 to 31 is left for the day; and the day is the first other number that differs
    from the month. A month that is a number and stands before every year is doubtful: the next such
    number replaces it, and is the day too if none follows. Numbers on both sides of a compact
    date do the same to it.
    """
    path = F.regexp_extract(url, r"^[^/?#]*://[^/?#]*(/[^?#]*)", 1)
    words = F.filter(F.split(path, r"[-_./]+"), lambda s: s != "")
    names = F.create_map(*[F.lit(x) for k, v in ENGLISH.items() for x in (k, v)])

    def sort(s: Column, at: Column) -> Column:
        digits = F.when(s.rlike("^[0-9]{1,8}$"), F.length(s)).otherwise(0)
        n = s.try_cast("int")
        kind = (
            F.when((digits == 4) & n.between(int(FIRST[:4]), int(as_of[:4])), "year")
            .when((digits == 8) & (n >= int(FIRST[:4]) * 10_000), "compact")
            .when(digits.between(1, 2) & (n > 0), "number")
            .when(digits == 0, "name")
        )
        return F.struct(at.alias("at"), kind.alias("kind"), F.when(digits == 0, F.try_element_at(names, F.lower(s))).otherwise(n).alias("n"))

    def settle(parts: Column) -> Column:
        of = lambda kind: F.filter(parts, lambda x: (x["kind"] == kind) & x["n"].isNotNull())
        day_like = lambda numbers: F.coalesce(_first(F.filter(numbers, lambda x: x["n"].between(13, 31)))["at"], F.lit(-1))

        def choose(p: Column) -> Column:
            numbers, year_at, compact, name, big = p["numbers"], p["year_at"], p["compact"], p["name"], p["big"]
            start = _first(F.filter(numbers, lambda x: x["at"] != big))
            named = name.isNotNull() & (start.isNull() | (name["at"] < start["at"]))
            known = F.least(year_at, compact["at"])
            doubtful = ~named & start.isNotNull() & (known.isNull() | (start["at"] < known))
            next_ = F.when(doubtful, _first(F.filter(numbers, lambda x: (x["at"] > start["at"]) & (x["at"] != big))))
            after = F.when(doubtful & (start["at"] < compact["at"]) & (next_.isNull() | (next_["at"] > compact["at"])), _first(F.filter(numbers, lambda x: x["at"] > compact["at"])))
            swap = F.when(compact.isNull(), next_).otherwise(after)
            month = F.coalesce(swap["n"], F.when(compact.isNotNull(), (compact["n"] / 100).cast("int") % 100), F.when(named, name["n"]), start["n"])
            used = F.coalesce(swap["at"], F.when(named, -1), start["at"])
            others = F.filter(numbers, lambda x: F.when(swap.isNotNull(), x["at"] > swap["at"]).otherwise(x["at"] != used))
            return F.struct(month.alias("month"), others.alias("others"), swap["n"].alias("swap"), compact["n"].alias("compact"), p["year"].alias("year"))

        def spell(p: Column) -> Column:
            other = F.coalesce(_first(F.filter(p["others"], lambda x: x["n"] != p["month"]))["n"], p["swap"], _first(p["others"])["n"])
            day = F.when(p["compact"].isNotNull() & p["swap"].isNull(), p["compact"] % 100).otherwise(other)
            year = F.coalesce(p["year"], (p["compact"] / 10_000).cast("int"))
            return F.try_make_timestamp(year, p["month"], day, F.lit(0), F.lit(0), F.lit(0.0)).cast("date")

        def gather(lists: Column) -> Column:
            first_year = _first(lists["years"])["at"]
            compact = _first(lists["compacts"])
            return F.struct(
                lists["numbers"].alias("numbers"), first_year.alias("year_at"), F.try_element_at(lists["years"], F.lit(-1))["n"].alias("year"),
                F.when(first_year.isNull() | (compact["at"] < first_year), compact).alias("compact"), _first(lists["names"]).alias("name"),
                day_like(lists["numbers"]).alias("big"),
            )

        lists = F.struct(of("year").alias("years"), of("compact").alias("compacts"), of("number").alias("numbers"), of("name").alias("names"))
        return once(once(once(lists, gather), choose), spell)

    return once(F.transform(words, sort), settle)


def _month(text: Column) -> Column:
    names = F.create_map(*[F.lit(x) for k, v in MONTHS.items() for x in (k, v)])
    return F.coalesce(text.try_cast("int"), F.try_element_at(names, F.lower(text)))


def text_date(text: Column) -> Column:
    """First date that a pattern's first match spells; an unknown month or an impossible date passes to the next pattern."""
    found = []
    for pattern, y, m, d, hour, minute in TEXT_PATTERNS:
        part = lambda k, p=pattern: F.regexp_extract(text, p, k)
        clock = lambda k: F.coalesce(part(k).try_cast("int"), F.lit(0)) if k else F.lit(0)  # noqa: B023, E731
        year = once(part(y).try_cast("int"), lambda n: F.when(n < 15, n + 2000).when(n < 100, n + 1900).otherwise(n))
        found.append(F.try_make_timestamp(year, _month(part(m)), part(d).try_cast("int"), clock(hour), clock(minute), F.lit(0.0)))
    return F.when(text.rlike(r"\d"), F.coalesce(*found))


# Formats in the order in which they are tried; zone names at the end are dropped first.
FORMATS = (
    "yyyy-M-d'T'H:m:s[.SSS]XXX", "yyyy-M-d'T'H:m:s[.SSS]xx", "yyyy-M-d'T'H:m:s[.SSS]", "y-M-d H:m:s", "dd.MM.yy", "d MMM y H:m:s Z",
    "d MMM y H:m:s", "d MMM y", "y-M-d@H:m:s", "yyyy-MM-dd", "dd.MM.yyyy",
)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated a single time, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), 0)


def if_valid(when: Column, as_of: str) -> Column:
    return once(when, lambda d: F.when(is_valid(d, as_of), d))


def liberal_date(text: Column, as_of: str) -> Column:
    """First format that fits; null outside 1990 .. ``as_of``."""
    zones = r"\s(BST|CET|MEZ|CEST|MESZ|GMT|UTC)([+-]\d{4})?$"
    clean = F.trim(half_day(text))
    zone = F.regexp_extract(clean, zones, 1)
    # Names of days say nothing that the date does not, and the parser takes none.
    bare = F.regexp_replace(F.regexp_replace(clean, zones, ""), r"^\p{L}{2,4}\.?,\s*", "")

    def parse(b: Column) -> Column:
        # Month names of other languages: their first three letters are enough.
        part = lambda k: F.regexp_extract(b, r"^(\d{1,2}) (\p{L}{3})\p{L}* (\d{4}) (\d\d?):(\d\d):(\d\d)$", k)
        named = F.try_make_timestamp(
            part(3).try_cast("int"), _month(part(2)), part(1).try_cast("int"), part(4).try_cast("int"), part(5).try_cast("int"), part(6).try_cast("double")
        )
        # A failed parse is costly: no text without a digit is tried.
        return F.when(b.rlike(r"\d"), F.coalesce(*[F.try_to_timestamp(b, F.lit(f)) for f in FORMATS], named))

    place = F.when(zone.isin("CET", "MEZ", "CEST", "MESZ"), F.lit("Europe/Berlin")).when(zone == "BST", F.lit("Europe/London")).otherwise(F.lit("UTC"))
    return if_valid(F.to_utc_timestamp(once(bare, parse), place), as_of)


def source_rank(source: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SOURCES)), source)


def best_date(candidates: Column) -> Column:
    """Best of array<struct<when, source>>: source, then a time of day, then the latest."""
    ranked = F.transform(
        F.filter(candidates, lambda c: c["when"].isNotNull()),
        lambda c: F.struct(
            source_rank(c["source"]).alias("rank"),
            (F.date_trunc("day", c["when"]) == c["when"]).cast("int").alias("bare"),
            (-F.unix_micros(c["when"])).alias("late"),
            c["when"].alias("when"),
            c["source"].alias("source"),
        ),
    )
    first = F.array_min(ranked)
    return F.struct(first["when"].alias("when"), F.coalesce(first["source"], F.lit("NOT_FOUND")).alias("source"))


def modified_date(from_url: Column, from_content: Column, crawled: Column, as_of: str) -> Column:
    """URL date, else content date, else crawl time (as HEADER); each must be valid."""
    pick = lambda when, source: F.when(is_valid(when, as_of), F.struct(when.alias("when"), F.lit(source).alias("source")))
    return F.coalesce(
        pick(from_url, "URL"), pick(from_content, "META"), pick(crawled, "HEADER"),
        F.struct(F.lit(None).cast("timestamp").alias("when"), F.lit("NOT_FOUND").alias("source")),
    )


def period_days(period: Column) -> Column:
    """Days of ``P180D`` or ``P2W``."""
    n = F.regexp_extract(period, r"^P(\d+)[DW]$", 1).try_cast("int")
    return F.when(period.endswith("W"), n * 7).otherwise(n)


def parse_cdx(text: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyyMMddHHmmss")), F.try_to_timestamp(text, F.lit("yyyyMMddHHmm")))


def format_cdx(when: Column) -> Column:
    return F.date_format(when, "yyyyMMddHHmmss")
