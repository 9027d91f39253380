"""Registry: name -> query over the test tables, and the same rows in DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import analyzers, dates, html, relevance, text, urls
from tidemark.operators import content, frontier, keyphrase, langid, similarity, snapshots, vectors
from tidemark.plans import analysis
from tidemark.plans import crawl as crawling
from tidemark.plans.crawl import written
from tidemark.sources import tables
from tidemark.streaming import events as streaming

AS_OF = "2025-01-01"
EVENT = relevance.Interval("2024-01-10", "2024-01-15", 5, 3)
KEYWORDS = ["the", "of", "und", "les", "que", "worthless"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c) -> F.Column:
    return F.round(c, 6)


# -- URLs ---------------------------------------------------------------------------------


@query("SELECT page_id, url FROM pages WHERE starts_with(url, 'http:') OR starts_with(url, 'https:')")
def url_only_http(spark, d):
    return t(spark, d, "pages").select("page_id", "url").filter(urls.only_http(F.col("url")))


_REWRITE = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0},
 '(?i)(;?\b_?(l|j|bv_)?(sid|phpsessid|sessionid)=.*?)(\?|&|#|$)', '\4', 'g'),
 '/((?i:index)|(?i:default))\.((?i:js[pf]?[afx]?|cgi|cfm|asp[x]?|[psx]?htm[l]?|php[3456]?))(\?|&|#|$)', '/\3', 'g'),
 '#.*?(\?|&|$)', '\1', 'g'), '\?&', '?', 'g'), '&{{2,}}', '&', 'g'), '[\?&\.]$', '', 'g'), '(:?)/{{2,}}', '\1/', 'g'), ':/', '://')"""


@query(f"SELECT page_id, {_REWRITE.format('url')} AS url FROM pages")
def url_regex_normalize(spark, d):
    return t(spark, d, "pages").select("page_id", urls.rewrite(F.col("url")).alias("url"))


_STRIP = r"""WITH p AS (SELECT page_id, split_part(url, '#', 1) AS bare FROM pages),
q AS (SELECT page_id, split_part(bare, '?', 1) AS base, CASE WHEN contains(bare, '?') THEN substr(bare, instr(bare, '?') + 1) ELSE '' END AS query FROM p),
s AS (SELECT page_id, list_filter(list_transform(list_filter(string_split(query, '&'), lambda x: x <> ''),
   lambda x: struct_pack(name := replace(CASE WHEN contains(x, '=') THEN split_part(x, '=', 1) ELSE x END, '+', ' '),
                    value := replace(CASE WHEN contains(x, '=') THEN substr(x, instr(x, '=') + 1) ELSE '' END, '+', ' '))),
   lambda y: NOT regexp_matches(y.name, '(?i)^utm_|sess(ion)?id')) AS params, base FROM q)
SELECT page_id, CASE WHEN len(params) = 0 THEN base ELSE base || '?' || array_to_string(list_transform(list_sort(params),
   lambda z: CASE WHEN z.value = '' THEN z.name ELSE z.name || '=' || z.value END), '&') END AS url FROM s"""


@query(_STRIP)
def url_strip_tracking(spark, d):
    return t(spark, d, "pages").select("page_id", urls.strip_tracking(F.col("url")).alias("url"))


@query()
def url_canonical(spark, d):
    return t(spark, d, "pages").select("page_id", urls.normalise(F.concat(F.col("url"), F.lit("/./a/../b c"))).alias("url"))


_WRAP = "CASE page_id % 4 WHEN 0 THEN 'https://web.archive.org/web/20070108012822/' || url WHEN 1 THEN 'https://archive.is/' || url || '*' WHEN 2 THEN 'http://derefer.unbubble.eu?u=' || url ELSE 'http://deadurl.invalid/' || url END"


@query(rf"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace({_WRAP},
 'https://web.archive.org/web/\d+/(.*)', '\1'), 'https://archive.is/(.*)\*$', '\1'), 'http://derefer.unbubble.eu/?\?u=(.*)', '\1'),
 'http://deadurl.invalid/(.*)', '\1') AS url FROM pages""")
def url_unwrap(spark, d):
    return t(spark, d, "pages").select("page_id", urls.unwrap(F.expr(_WRAP)).alias("url"))


_HOST = r"lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
_SURT = rf"""SELECT page_id, array_to_string(list_reverse(string_split(regexp_replace({_HOST}, '^www\d*\.', ''), '.')), ',') || ')' ||
 CASE WHEN rest = '' THEN '/' ELSE rest END AS surt FROM (SELECT page_id, url,
 regexp_replace(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^#]*)', 1)), '/$', ''), '/\?', '?') AS rest FROM pages)"""


@query(_SURT)
def url_surt(spark, d):
    return t(spark, d, "pages").select("page_id", urls.surt(F.col("url")).alias("surt"))


@query(f"SELECT host, min(page_id) AS page_id, count(*) AS n FROM (SELECT {_HOST} AS host, page_id FROM pages) GROUP BY host")
def url_dedupe_first(spark, d):
    return t(spark, d, "pages").select(urls.host(F.col("url")).alias("host"), "page_id").groupBy("host").agg(F.min("page_id").alias("page_id"), F.count(F.lit(1)).alias("n"))


@query(f"""SELECT scheme, host, count(*) AS n FROM (SELECT split_part(url, ':', 1) AS scheme, {_HOST} AS host FROM pages)
GROUP BY ROLLUP (scheme, host)""")
def url_host_rollup(spark, d):
    p = t(spark, d, "pages").select(F.substring_index(F.col("url"), ":", 1).alias("scheme"), urls.host(F.col("url")).alias("host"))
    return p.rollup("scheme", "host").agg(F.count(F.lit(1)).alias("n"))


_QUERY_OF = "CASE WHEN contains(split_part(url, '#', 1), '?') THEN substr(split_part(url, '#', 1), instr(split_part(url, '#', 1), '?') + 1) ELSE '' END"


@query(rf"""WITH p AS (SELECT page_id, regexp_extract('&' || {_QUERY_OF}, '&page=([^&]*)', 1) AS page, {_QUERY_OF} AS q FROM pages)
SELECT page_id, CASE WHEN contains('&' || q, '&page=') THEN page END AS page, contains('&' || q, '&ref=') AS has_ref,
 len(list_filter(string_split(q, '&'), lambda x: x <> ''))::INTEGER AS n FROM p""")
def url_params(spark, d):
    bare = F.substring_index(F.col("url"), "#", 1)
    q = urls.parse_query(F.when(F.instr(bare, "?") > 0, bare.substr(F.instr(bare, "?") + 1, F.length(bare))).otherwise(F.lit("")))
    return t(spark, d, "pages").select("page_id", urls.param(q, "page").alias("page"), urls.has_param(q, "ref").alias("has_ref"), F.size(q).alias("n"))


_DATED = "'http://e.org/' || (1985 + page_id % 45)::VARCHAR || '/' || (1 + page_id % 13)::VARCHAR || '/' || (1 + page_id % 32)::VARCHAR || '/x.html'"


@query(rf"""WITH p AS (SELECT page_id, 1985 + page_id % 45 AS y, 1 + page_id % 13 AS m, 1 + page_id % 32 AS d FROM pages)
SELECT page_id, try_cast(y || '-' || lpad(m::VARCHAR, 2, '0') || '-' || lpad(d::VARCHAR, 2, '0') AS DATE)::VARCHAR AS day FROM p""")
def url_date_extract(spark, d):
    link = F.concat(F.lit("http://e.org/"), 1985 + F.col("page_id") % 45, F.lit("/"), 1 + F.col("page_id") % 13, F.lit("/"), 1 + F.col("page_id") % 32, F.lit("/x.html"))
    return t(spark, d, "pages").select("page_id", dates.url_date_fast(link).cast("string").alias("day"))


@query("""SELECT page_id, CASE WHEN 1985 + page_id % 45 BETWEEN 1990 AND 2025 THEN
 try_cast((1985 + page_id % 45) || '-' || lpad((page_id % 12 + 1)::VARCHAR, 2, '0') || '-' || lpad((1 + page_id % 32)::VARCHAR, 2, '0') AS DATE) END::VARCHAR AS day FROM pages""")
def url_date_full(spark, d):
    link = F.concat(F.lit("http://e.org/a-"), 1985 + F.col("page_id") % 45, F.lit("_"), F.element_at(F.array(*map(F.lit, dates.ENGLISH)), (F.col("page_id") % 12 + 1).cast("int")), F.lit("."), 1 + F.col("page_id") % 32)
    return t(spark, d, "pages").select("page_id", dates.url_date(link, AS_OF).cast("string").alias("day"))


@query("""WITH v AS (SELECT p_partkey, lower(p_name) AS k FROM part)
SELECT p_partkey, '(' || array_to_string(list_sort(list_distinct([replace(k, ' ', '.?'),
 replace(replace(replace(replace(replace(k, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), ' ', '.?'),
 replace(translate(k, 'äöüáàâéèêëíìîïóòôúùûñç', 'aouaaaeeeeiiiiooouuunc'), ' ', '.?'), replace(k, ' ', '.?')])), ')|(') || ')' AS pattern FROM v""")
def keyword_variants(spark, d):
    return t(spark, d, "part").select("p_partkey", urls.keyword_variants(F.col("p_name")).alias("pattern"))


@query("SELECT DISTINCT url FROM pages WHERE regexp_matches(page_id::VARCHAR || ' ' || url, 'th.?er|and') AND NOT regexp_matches(url, '\\s|^https?://[a-z0-9.-]*?\\.de/')")
def seed_grep(spark, d):
    lines = t(spark, d, "pages").filter("url NOT RLIKE '\\\\s'").select(F.concat(F.col("page_id").cast("string"), F.lit(" "), "url").alias("value"))
    return tables.grep_lines(lines, "th.?er|and").filter(~urls.allowed_seed(F.col("url")))


# -- dates --------------------------------------------------------------------------------
@query("""WITH v AS (SELECT doc_id, doc_id % 28 + 1 AS dd, doc_id % 12 + 1 AS mm, 1995 + doc_id % 25 AS yy FROM documents)
SELECT doc_id, epoch_us(make_timestamp(yy, mm, dd, 0, 0, 0.0)) AS found FROM v""")
def text_date_match(spark, d):
    day, month, year = F.col("doc_id") % 28 + 1, F.col("doc_id") % 12 + 1, 1995 + F.col("doc_id") % 25
    line = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("am "), day, F.lit("."), month, F.lit("."), year)).otherwise(
        F.concat(F.lit("on "), year, F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.lpad(day.cast("string"), 2, "0"))
    )
    return t(spark, d, "documents").select("doc_id", F.unix_micros(dates.text_date(line)).alias("found"))


@query("SELECT event_id, replace(replace(CASE WHEN event_id % 2 = 0 THEN '3 a.m. ' ELSE '4 p.m. ' END || event_type, 'a.m.', 'AM'), 'p.m.', 'PM') AS clock FROM events")
def half_day_normalize(spark, d):
    e = t(spark, d, "events")
    return e.select("event_id", dates.half_day(F.concat(F.when(F.col("event_id") % 2 == 0, "3 a.m. ").otherwise("4 p.m. "), F.col("event_type"))).alias("clock"))


@query("""SELECT page_id, lower(k) IN ('article:published_time','datepublished','og:updated_time','last-modified','article:modified_time','date','datemodified',
 'pubdate','og:modified_time','lastmod','dc.date','modified') AS is_date FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'DC.date' WHEN 1 THEN 'author' ELSE 'PubDate' END AS k FROM pages)""")
def meta_date_keys(spark, d):
    k = F.when(F.col("page_id") % 3 == 0, "DC.date").when(F.col("page_id") % 3 == 1, "author").otherwise("PubDate")
    return t(spark, d, "pages").select("page_id", dates.is_meta_key(k).alias("is_date"))


@query("""WITH c AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN ts - INTERVAL 1 DAY END AS u, CASE WHEN event_id % 2 = 0 THEN ts - INTERVAL 40 YEAR END AS c, ts FROM events)
SELECT event_id, epoch_us(CASE WHEN u > TIMESTAMP '1990-01-01' AND u < TIMESTAMP '2025-01-01' THEN u WHEN c > TIMESTAMP '1990-01-01' AND c < TIMESTAMP '2025-01-01' THEN c ELSE ts END) AS found,
 CASE WHEN u IS NOT NULL THEN 'URL' ELSE 'HEADER' END AS source FROM c""")
def date_cascade(spark, d):
    e = t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    got = dates.modified_date(
        F.when(F.col("event_id") % 3 == 0, F.col("ts") - F.expr("interval 1 day")), F.when(F.col("event_id") % 2 == 0, F.col("ts") - F.expr("interval 40 year")), F.col("ts"), AS_OF
    )
    return e.select("event_id", F.unix_micros(got["when"]).alias("found"), got["source"].alias("source"))


@query("""SELECT event_id, coalesce(epoch_us(CASE WHEN event_id % 3 = 0 THEN ts WHEN event_id % 2 = 0 THEN date_trunc('day', ts) WHEN event_id % 5 <> 0 THEN ts + INTERVAL 1 DAY END), 0) AS found,
 CASE WHEN event_id % 3 = 0 OR event_id % 2 = 0 THEN 'META' WHEN event_id % 5 <> 0 THEN 'TEXT_DATE' ELSE 'NOT_FOUND' END AS source FROM events""")
def date_best_candidate(spark, d):
    """A date in the text, a bare day and a time in the head, as they are there: source first, then a time of day, then the latest."""
    ts = F.col("ts").cast("timestamp")
    made = lambda there, when, source: F.struct(F.when(there, when).alias("when"), F.lit(source).alias("source"))
    third = F.col("event_id") % 3 == 0
    best = dates.best_date(F.array(
        made(F.col("event_id") % 5 != 0, ts, "TEXT_DATE"), made(F.col("event_id") % 5 != 0, ts + F.expr("interval 1 day"), "TEXT_DATE"),
        made(F.col("event_id") % 2 == 0, F.date_trunc("day", ts), "META"), made(third, ts, "META"),
    ))
    # At midnight the bare day and the time are one.
    return t(spark, d, "events").select("event_id", F.coalesce(F.unix_micros(best["when"]), F.lit(0)).alias("found"), best["source"].alias("source"))


@query("""SELECT event_id, epoch_us(CASE WHEN year(ts) > 1990 THEN date_trunc('second', ts) - CASE WHEN event_id % 3 = 1 THEN INTERVAL 2 HOUR ELSE INTERVAL 0 HOUR END
 - CASE WHEN event_id % 3 = 2 THEN ts - date_trunc('day', ts) - (ts - date_trunc('second', ts)) ELSE INTERVAL 0 HOUR END END) AS found FROM events""")
def date_liberal(spark, d):
    """Timestamps with a T, with an offset, and days alone, as pages and headers have them."""
    ts = F.col("ts").cast("timestamp")
    text = F.when(F.col("event_id") % 3 == 0, F.date_format(ts, "yyyy-M-d'T'H:m:s")).when(
        F.col("event_id") % 3 == 1, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))
    ).otherwise(F.date_format(ts, "dd.MM.yyyy"))
    return t(spark, d, "events").select("event_id", F.unix_micros(dates.liberal_date(text, AS_OF)).alias("found"))


# -- HTML and text ------------------------------------------------------------------------
@query()
def html_text_stats(spark, d):
    p = analysis.parse_pages(t(spark, d, "pages"), ("text", "links", "title"))
    return p.select("page_id", F.length("text").alias("chars"), F.size("links").alias("links"), "title")


@query("SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS link FROM pages")
def html_outlinks(spark, d):
    return t(spark, d, "pages").select("page_id", F.explode(html.hrefs(F.col("html"))).alias("link"))


@query(r"""SELECT DISTINCT page_id, regexp_extract(url, '^https?://[^/?#]*') || regexp_replace(replace(replace(url_encode(link), '%2F', '/'), '%2C', ','), '[?&.]$', '') AS link
 FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS link FROM pages)""")
def page_outlinks(spark, d):
    """Links as a crawl would follow them: parsed, absolute, normalised, distinct."""
    return analysis.outlinks(t(spark, d, "pages"))


@query("SELECT page_id, contains(upper(substr(html, 1, 1024)), '<HTML') AS is_html FROM pages")
def html_sniff(spark, d):
    return t(spark, d, "pages").select("page_id", html.looks_like_html(F.col("html")).alias("is_html"))


@query(r"""SELECT page_id, len(list_filter(flatten(list_transform(regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script>', 1),
 lambda s: regexp_extract_all(s, '"([^"]*)"', 1))), lambda x: len(regexp_split_to_array(trim(x), '\s+')) > 3))::INTEGER AS n FROM pages""")
def html_script_strings(spark, d):
    return t(spark, d, "pages").select("page_id", F.size(html.script_texts(F.col("html"))).alias("n"))


_SPLIT = r"""list_filter(regexp_split_to_array(text, '[\s<>|“”„‚‘’,;.:\-_''+*`()$%!"?]+'), lambda x: x <> '')"""


@query(f"SELECT doc_id, len({_SPLIT})::INTEGER AS words FROM documents")
def word_count(spark, d):
    return t(spark, d, "documents").select("doc_id", text.word_count(F.col("text")).alias("words"))


_KW = ", ".join(f"'{k}'" for k in KEYWORDS)


@query(f"""SELECT doc_id, keyword, count(*) AS n FROM (SELECT doc_id, lower(unnest({_SPLIT})) AS keyword FROM documents) WHERE keyword IN ({_KW}) GROUP BY 1, 2""")
def keyword_counts(spark, d):
    return content.keyword_counts(t(spark, d, "documents"), "doc_id", KEYWORDS)


_COUNTS = r"SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents) GROUP BY 1, 2"


@query(f"SELECT doc_id, term, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) AS rank FROM ({_COUNTS})) WHERE rank <= 5")
def top_k_terms(spark, d):
    return content.top_k(vectors.term_counts(t(spark, d, "documents"), "doc_id"), "doc_id", "term", "n", 5)


@query(f"SELECT doc_id, term, round(n / sum(n) OVER (PARTITION BY doc_id), 6) AS tf FROM ({_COUNTS})")
def relative_tf(spark, d):
    c = vectors.relative_tf(vectors.term_counts(t(spark, d, "documents"), "doc_id"), "doc_id")
    return c.select("doc_id", "term", r6(F.col("tf")).alias("tf"))


@query(f"SELECT doc_id, term, round(1 + ln(n), 6) AS tf FROM ({_COUNTS})")
def log_tf(spark, d):
    return vectors.term_counts(t(spark, d, "documents"), "doc_id").select("doc_id", "term", r6(text.tf(F.col("n"))).alias("tf"))


_IDF = f"""c AS ({_COUNTS}), i AS (SELECT term, count(*) AS df, ln((SELECT count(DISTINCT doc_id) FROM c) / count(*)) AS idf FROM c GROUP BY term)"""
_KEYWORD = f"CASE WHEN term IN ({_KW}) THEN 1.5 ELSE 1.0 END"
_TFIDF = f"""{_IDF}, w AS (SELECT doc_id, term, @K * (1 + ln(n)) * idf AS w FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS total FROM c) JOIN i USING (term)
 WHERE NOT (regexp_matches(term, '\\d') AND (n / total < 0.005 OR length(term) = 1)))"""


def _weights(spark, d, keywords=None):
    return vectors.blocks(t(spark, d, "documents"), "doc_id").weights(keywords)


@query(f"WITH {_IDF} SELECT term, df, round(idf, 6) AS idf FROM i")
def idf_table(spark, d):
    return vectors.idf_table(vectors.term_counts(t(spark, d, "documents"), "doc_id"), "doc_id").select("term", "df", r6(F.col("idf")).alias("idf"))


@query(f"WITH {_TFIDF.replace('@K', '1.0')} SELECT doc_id, term, round(w, 6) AS w FROM w")
def tfidf_vector(spark, d):
    return _weights(spark, d).select("doc_id", "term", r6(F.col("w")).alias("w"))


@query(f"WITH {_TFIDF.replace('@K', _KEYWORD)} SELECT doc_id, term, round(w, 6) AS w FROM w")
def keyword_weighted_vector(spark, d):
    return _weights(spark, d, KEYWORDS).select("doc_id", "term", r6(F.col("w")).alias("w"))


@query(r"""SELECT gram, count(*) AS n FROM (SELECT a || ' ' || b AS gram FROM (SELECT doc_id, w AS a, lead(w) OVER (PARTITION BY doc_id ORDER BY i) AS b
 FROM (SELECT doc_id, unnest(x) AS w, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS x FROM documents))) WHERE b IS NOT NULL) GROUP BY 1""")
def bigrams(spark, d):
    # A step of its own keeps the tokens from being cut anew for every n-gram.
    g = t(spark, d, "documents").select(text.tokens(F.col("text")).alias("words")).select(F.explode(text.ngrams(F.col("words"), 2)).alias("gram"))
    return g.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


_MARKS = ".:·''’"
# Tokens: marks that stand between a letter and a digit part words, those between two letters or two digits do not.
_WORDS = rf"""regexp_extract_all(regexp_replace(regexp_replace(lower(text), '(\p{{N}})[,;{_MARKS}](\p{{L}})', '\1 \2', 'g'), '(\p{{L}})[,;{_MARKS}](\p{{N}})', '\1 \2', 'g'),
 '[\p{{L}}\p{{N}}]+(?:[{_MARKS}]\p{{L}}[\p{{L}}\p{{N}}]*|[.,;''’]\p{{N}}[\p{{L}}\p{{N}}]*)*')"""
_ENGLISH = ", ".join(f"'{w}'" for w in analyzers.ENGLISH)


@query(f"""WITH r AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 'en' ELSE 'de' END AS route, {_WORDS} AS x FROM documents)
SELECT doc_id, route, len(CASE WHEN route = 'en' THEN list_filter(x, lambda w: regexp_replace(w, '[''’]s$', '') NOT IN ({_ENGLISH})) ELSE x END)::INTEGER AS words FROM r""")
def stopped_tokens(spark, d):
    """Words that are left by the analyzer of the document's language; two languages have one, all others take the default's."""
    known = ("de", "en")
    docs = t(spark, d, "documents").select("doc_id", "text", analyzers.route(F.col("lang"), known).alias("route"))
    return docs.select("doc_id", "route", F.size(analyzers.tokens(F.col("text"), F.col("route"), known)).alias("words"))


_STEM = f"""WITH a AS (SELECT doc_id, strip_accents(replace(unnest({_WORDS}), 'ß', 'ss')) AS w FROM documents),
b AS (SELECT doc_id, CASE WHEN length(w) > 5 AND regexp_matches(w, 'ern$') THEN left(w, length(w) - 3) WHEN length(w) > 4 AND regexp_matches(w, '(em|en|er|es)$') THEN left(w, length(w) - 2)
 WHEN length(w) > 3 AND regexp_matches(w, '(e|[bdfghklmnt]s)$') THEN left(w, length(w) - 1) ELSE w END AS w FROM a),
c AS (SELECT doc_id, CASE WHEN length(w) > 5 AND regexp_matches(w, 'est$') THEN left(w, length(w) - 3) WHEN length(w) > 4 AND regexp_matches(w, '(er|en|[bdfghklmnt]st)$')
 THEN left(w, length(w) - 2) ELSE w END AS term FROM b)"""


@query(f"{_STEM} SELECT doc_id, term, count(*) AS n FROM c GROUP BY 1, 2")
def fallback_terms(spark, d):
    """Stems of all documents where only the default language has an analyzer."""
    return similarity.language_counts(t(spark, d, "documents"), "doc_id", known=("de",))


@query("""WITH k AS (SELECT n_regionkey AS topic, CASE WHEN n_nationkey % 3 = 0 THEN NULL WHEN n_nationkey % 3 = 1 THEN 'de' ELSE 'en' END AS language, n_name AS name FROM nation),
l AS (SELECT DISTINCT topic, language FROM k WHERE language IS NOT NULL),
u AS (SELECT topic, language, name FROM k WHERE language IS NOT NULL UNION SELECT l.topic, l.language, k.name FROM l JOIN k ON k.topic = l.topic AND k.language IS NULL)
SELECT topic, language, string_agg(name, ',' ORDER BY name) AS keywords FROM u GROUP BY 1, 2
UNION ALL SELECT topic, NULL, string_agg(DISTINCT name, ',' ORDER BY name) FROM k WHERE topic NOT IN (SELECT topic FROM l) GROUP BY topic""")
def language_keywords(spark, d):
    """Keywords of topics by language, with those of no language."""
    kind = F.pmod("n_nationkey", F.lit(3))
    language = F.when(kind == 1, "de").when(kind == 2, "en")
    labels = t(spark, d, "nation").select(F.col("n_regionkey").alias("topic"), language.alias("language"), F.col("n_name").alias("name"))
    return similarity.language_keywords(labels, "topic").withColumn("keywords", F.array_join("keywords", ","))


@query("SELECT lang, count(DISTINCT text) AS texts FROM documents GROUP BY 1")
def documents_by_language(spark, d):
    return similarity.by_language(t(spark, d, "documents"), "lang", "text").groupBy("lang").agg(F.count("text").alias("texts"))


_LANG = f"{_TFIDF.replace('@K', '1.0')}, v AS (SELECT w.*, lang FROM w JOIN documents USING (doc_id))"


def _lang_weights(spark, d):
    docs = t(spark, d, "documents")
    blocks = vectors.blocks(docs, "doc_id")
    return blocks.beside(blocks.weights(), docs.select("doc_id", "lang"))


@query(f"WITH {_LANG} SELECT lang, term, round(sum(w), 4) AS w FROM v GROUP BY 1, 2")
def merge_vectors(spark, d):
    return vectors.merge(_lang_weights(spark, d), "lang", "doc_id").select("lang", "term", F.round("w", 4).alias("w"))


@query(f"WITH {_LANG} SELECT lang, term, round(sum(w) * count(*) / (SELECT count(DISTINCT doc_id) FROM v x WHERE x.lang = v.lang), 4) AS w FROM v GROUP BY 1, 2")
def merge_vectors_df(spark, d):
    return vectors.merge(_lang_weights(spark, d), "lang", "doc_id", use_df=True).select("lang", "term", F.round("w", 4).alias("w"))


_TOP = f"""{_LANG}, m AS (SELECT lang, term, sum(w) AS w FROM v GROUP BY 1, 2),
t AS (SELECT lang, term, w, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY round(w, 6) DESC, term) AS rank FROM m) WHERE rank <= 100)"""


@query(f"WITH {_TOP} SELECT lang, term, round(w, 4) AS w, rank FROM t")
def reference_top100(spark, d):
    top = vectors.top_terms(vectors.merge(_lang_weights(spark, d), "lang", "doc_id"), "lang", 100)
    return top.select("lang", "term", F.round("w", 4).alias("w"), "rank")


_COS = f"""{_TOP}, n AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1), rn AS (SELECT sqrt(sum(w * w)) AS norm FROM t WHERE lang = 'de'),
dot AS (SELECT doc_id, sum(w.w * t.w) AS dot FROM w JOIN t ON w.term = t.term AND t.lang = 'de' GROUP BY 1),
sim AS (SELECT n.doc_id, coalesce(dot / nullif(n.norm * (SELECT norm FROM rn), 0), 0) AS sim FROM n LEFT JOIN dot USING (doc_id))"""


_ROUTED = f"""{_TOP}, g AS (SELECT doc_id, CASE WHEN lang IN ('de', 'en') THEN lang ELSE 'de' END AS route FROM documents),
n AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1), rn AS (SELECT lang, sqrt(sum(w * w)) AS norm FROM t GROUP BY 1),
dot AS (SELECT w.doc_id, sum(w.w * t.w) AS dot FROM w JOIN g USING (doc_id) JOIN t ON w.term = t.term AND t.lang = g.route GROUP BY 1)
SELECT g.doc_id, route, round(coalesce(dot / nullif(n.norm * rn.norm, 0), 0) / CASE WHEN route = 'de' THEN 0.5 ELSE 1 END, 6) AS sim
FROM g LEFT JOIN n USING (doc_id) LEFT JOIN dot USING (doc_id) LEFT JOIN rn ON rn.lang = g.route"""


@query(f"WITH {_ROUTED}")
def language_cosine(spark, d):
    """Similarity of every document to the reference of its language, from a stored specification; German stands in for others."""
    docs = t(spark, d, "documents")
    blocks = vectors.blocks(docs, "doc_id")
    weights = blocks.weights()
    own = blocks.beside(weights, docs.select("doc_id", "lang").filter("lang in ('de', 'en')"))
    top = vectors.top_terms(vectors.merge(own, "lang", "doc_id"), "lang", 100)
    packed = top.groupBy("lang").agg(F.struct(F.map_from_entries(F.collect_list(F.struct("term", "w"))).alias("elements")).alias("v"))
    spec = packed.groupBy(F.lit("s").alias("name")).agg(
        F.map_from_entries(F.collect_list(F.struct("lang", "v"))).alias("referenceVectors"),
        F.map_from_arrays(F.array(F.lit("de")), F.array(F.lit(0.5))).alias("correctionFactors"),
    )
    spec = written(spec, "spec")
    found = similarity.language_cosine(
        weights, docs.select("doc_id", F.col("lang").alias("language")), similarity.stored_vectors(spec).drop("name"), similarity.stored_factors(spec).drop("name"), "doc_id",
        blocks=blocks,
    )
    return found.select("doc_id", "route", r6(F.col("sim")).alias("sim"))


def _similarity(spark, d):
    docs = t(spark, d, "documents")
    blocks = vectors.blocks(docs, "doc_id")
    weights = blocks.weights()
    lang = blocks.beside(weights, docs.select("doc_id", "lang").filter("lang = 'de'"))
    reference = vectors.top_terms(vectors.merge(lang, "lang", "doc_id"), "lang", 100)
    return vectors.cosine(weights, reference, "doc_id")


@query(f"WITH {_COS} SELECT doc_id, round(sim, 6) AS sim FROM sim")
def cosine_topical(spark, d):
    """Flagship: every document's similarity to the reference vector of a topic."""
    return _similarity(spark, d).select("doc_id", r6(F.col("sim")).alias("sim"))


@query(f"WITH {_COS} SELECT 'de' AS lang, round(avg(sim), 6) AS factor FROM sim JOIN documents USING (doc_id) WHERE lang = 'de'")
def correction_factor(spark, d):
    own = _similarity(spark, d).join(t(spark, d, "documents").select("doc_id", "lang").filter("lang = 'de'"), "doc_id")
    return vectors.correction(own, "lang").select("lang", r6(F.col("factor")).alias("factor"))


@query(f"WITH {_COS} SELECT doc_id, round(sim, 6) AS sim FROM sim WHERE sim >= 0.25")
def relevance_threshold(spark, d):
    return _similarity(spark, d).filter("sim >= 0.25").select("doc_id", r6(F.col("sim")).alias("sim"))


@query("""SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS sim
FROM embeddings e, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q""")
def embedding_cosine(spark, d):
    e = t(spark, d, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    q = e.orderBy("vec_id").limit(1).select(F.col("embedding").alias("q"))
    size = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    dot = F.aggregate(F.zip_with("embedding", "q", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return e.join(F.broadcast(q)).select("vec_id", r6(vectors.guarded(dot, size("embedding") * size("q"))).alias("sim"))


@query(f"WITH {_TFIDF.replace('@K', '1.0')} SELECT doc_id, round(sqrt(sum(w * w)), 6) AS norm FROM w GROUP BY 1")
def vector_norms(spark, d):
    return vectors.norms(_weights(spark, d), "doc_id").select("doc_id", r6(F.col("norm")).alias("norm"))


@query()
def build_topic_specs(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "lang", "text")
    return analysis.build_topics(docs, "lang", "doc_id").select("lang", F.size("vector").alias("terms"), r6(F.col("factor")).alias("factor"))


# -- time and scores ----------------------------------------------------------------------
_MS = "epoch_us(ts) / 1000.0"
_S, _E = "epoch_us(TIMESTAMP '2024-01-10') / 1000.0", "epoch_us(TIMESTAMP '2024-01-15') / 1000.0"
_HALF = f"""least(1.0, CASE WHEN {_MS} > {_S} AND {_MS} < {_E} THEN 1.0 WHEN {_MS} < {_S} THEN exp(-({_S} - {_MS}) / (5 * 86400000.0) * ln(2))
 ELSE exp(-({_MS} - ({_E} + 86400000)) / (3 * 86400000.0) * ln(2)) END)"""
_STEP = f"""CASE WHEN {_MS} > {_S} AND {_MS} < {_E} THEN 1.0 WHEN {_MS} < {_S} THEN exp(-trunc(({_S} - floor({_MS})) / 172800000.0))
 ELSE exp(-trunc((floor({_MS}) - ({_E} + 86400000)) / 172800000.0)) END"""


@query(f"SELECT event_id, round({_HALF}, 6) AS time_rel FROM events")
def time_relevance_weibull(spark, d):
    return t(spark, d, "events").select("event_id", r6(relevance.half_life(F.col("ts"), EVENT)).alias("time_rel"))


@query(f"SELECT event_id, round({_STEP}, 6) AS time_rel FROM events")
def time_relevance_exp(spark, d):
    return t(spark, d, "events").select("event_id", r6(relevance.stepwise(F.col("ts"), EVENT)).alias("time_rel"))


@query("""WITH t(code, s, e, b, a) AS (VALUES ('early', TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-04', 5, 2), ('late', TIMESTAMP '2024-01-20', TIMESTAMP '2024-01-25', 7, 3)),
x AS (SELECT event_id, code, epoch_us(ts) / 1000.0 AS m, epoch_us(s) / 1000.0 AS s, epoch_us(e) / 1000.0 AS e, b, a FROM events, t)
SELECT event_id, code, round(least(1.0, CASE WHEN m > s AND m < e THEN 1.0 WHEN m < s THEN exp(-(s - m) / (b * 86400000.0) * ln(2))
 ELSE exp(-(m - (e + 86400000)) / (a * 86400000.0) * ln(2)) END), 6) AS time_rel FROM x""")
def time_relevance_topics(spark, d):
    """Every event against every topic's interval; the topics are a handful of rows."""
    rows = [("early", "2024-01-02", "2024-01-04", 5, 2), ("late", "2024-01-20", "2024-01-25", 7, 3)]
    topics = spark.createDataFrame(rows, "code string, s string, e string, b int, a int")
    joined = t(spark, d, "events").join(F.broadcast(topics))
    return joined.select("event_id", "code", r6(relevance.half_life_between(F.col("ts"), F.col("s"), F.col("e"), F.col("b"), F.col("a"))).alias("time_rel"))


@query("SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-15'")
def interval_contains(spark, d):
    return t(spark, d, "events").filter(relevance.contains(F.col("ts"), EVENT)).select("event_id")


_CASES = {
    "CONTENT": "s", "CONTENT_AND_TIME": "CASE WHEN s > 0.25 THEN s * 0.5 + h * 0.5 ELSE s END", "CONTENT_AND_TIME_EXP": "CASE WHEN s > 0.25 THEN s * 0.5 + e * 0.5 ELSE s END",
    "TIME": "h", "TIME_EXP": "e", "UNFOCUSED": "1.0",
}


def _score(method):
    def run(spark, d):
        s = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") / 100))
        score = relevance.outlink_score(method, s, relevance.time_relevance(method, F.col("ts"), EVENT))
        return t(spark, d, "events").select("event_id", r6(score).alias("score"))

    run.__name__ = f"outlink_score_{method.lower()}"
    return run


for _m in relevance.METHODS:
    query(f"SELECT event_id, round(least(1.0, greatest(0.0, {_CASES[_m]})), 6) AS score FROM (SELECT event_id, least(1.0, greatest(0.0, value / 100)) AS s, {_HALF} AS h, {_STEP} AS e FROM events)")(_score(_m))


# -- snapshots ----------------------------------------------------------------------------
@query(f"""SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY round({_HALF}, 6) DESC, event_id) AS rank FROM events) WHERE rank <= 3""")
def snapshot_best_n(spark, d):
    return snapshots.best_by_time(t(spark, d, "events"), "user_id", "ts", EVENT, 3, "event_id").select("user_id", "event_id", "rank")


@query(f"""SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY round({_HALF}, 6), event_id) AS rank FROM events) WHERE rank <= 3""")
def snapshot_best_n_as_written(spark, d):
    return snapshots.best_by_time(t(spark, d, "events"), "user_id", "ts", EVENT, 3, "event_id", as_written=True).select("user_id", "event_id", "rank")


def _index(spark, d):
    return t(spark, d, "events").select(F.concat(F.lit("org,u"), "user_id").alias("surt"), F.col("event_id").alias("version"), "ts")


@query("SELECT 'org,u' || user_id AS surt, event_id AS version FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def snapshot_latest_lookup(spark, d):
    i = _index(spark, d)
    return snapshots.at_time(i, F.col("surt"), F.col("ts"), latest_only=True).select("surt", "version")


@query("""SELECT 'org,u' || user_id AS surt, event_id AS version, 'http://u' || user_id || '.org/' AS origurl, event_type AS mime FROM events WHERE event_type <> 'error'""")
def cdx_pivot_versions(spark, d):
    e = t(spark, d, "events")
    cell = lambda n, v: F.struct(F.lit(n).alias("column"), v.cast("string").alias("value"))
    origin = F.when(F.col("event_type") != "error", F.concat(F.lit("http://u"), "user_id", F.lit(".org/")))
    cells = e.select(F.concat(F.lit("org,u"), "user_id").alias("surt"), F.col("event_id").alias("version"), F.explode(F.array(cell("origurl", origin), cell("mime", F.col("event_type")))).alias("c"))
    return snapshots.pivot_versions(cells.select("surt", "version", "c.*")).select("surt", "version", "origurl", "mime")


@query("""SELECT user_id, arg_max(event_id, (value, -event_id)) AS best, max(value) AS relevance, min(CASE WHEN value >= 0 THEN value END) AS min_relevance,
 max(CASE WHEN value >= 0 THEN value END) AS max_relevance, ((epoch_us(max(ts)) - epoch_us(min(ts))) // 1000)::BIGINT AS span_ms FROM events GROUP BY 1""")
def best_snapshot_argmax(spark, d):
    return snapshots.choose(t(spark, d, "events"), "user_id", "value", "ts", "event_id")


@query("""SELECT event_id, CASE WHEN contains(f, '-') THEN 'root/' || split_part(f, '-', 1) || '/' || f ELSE 'root/' || f END AS path
FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type || '-' || event_id || '.warc.gz' ELSE event_type || '.arc' END AS f FROM events)""")
def archive_path(spark, d):
    f = F.when(F.col("event_id") % 2 == 0, F.concat("event_type", F.lit("-"), "event_id", F.lit(".warc.gz"))).otherwise(F.concat("event_type", F.lit(".arc")))
    return t(spark, d, "events").select("event_id", snapshots.resolve_path(f, "root").alias("path"))


@query("SELECT event_id, epoch_us(date_trunc('second', ts)) AS parsed FROM events")
def cdx_timestamp(spark, d):
    e = t(spark, d, "events")
    return e.select("event_id", F.unix_micros(dates.parse_cdx(dates.format_cdx(F.col("ts").cast("timestamp")))).alias("parsed"))


# -- frontier and crawl -------------------------------------------------------------------
@query("""SELECT event_id, bucket, row_number() OVER (PARTITION BY bucket ORDER BY event_id) AS place FROM
(SELECT event_id, least(floor(round(least(1.0, value / 100) / 0.01, 9)), 99)::INTEGER AS bucket FROM events)""")
def frontier_bucket_fifo(spark, d):
    e = t(spark, d, "events").withColumn("priority", F.least(F.lit(1.0), F.col("value") / 100))
    return frontier.in_order(e, "event_id").select("event_id", "bucket", "place")


@query()
def weighted_sample(spark, d):
    e = t(spark, d, "events").select(F.col("event_id").alias("seq"), F.least(F.lit(1.0), F.col("value") / 100).alias("priority"))
    return frontier.pop(e, 100, seed=11)


@query("""SELECT url, min(length(path))::INTEGER AS steps FROM (SELECT url, repeat('L', (page_id % 4)::INTEGER) AS path FROM pages p
 WHERE NOT EXISTS (SELECT 1 FROM pages q WHERE q.url = p.url AND q.page_id % 2 = 0)) GROUP BY 1""")
def seen_anti_join(spark, d):
    p = t(spark, d, "pages")
    new = p.select("url", F.expr("repeat('L', int(page_id % 4))").alias("path"), F.lit(None).cast("string").alias("referrer"))
    return frontier.unseen(new, p.filter("page_id % 2 = 0")).select("url", F.length("path").alias("steps"))


@query("""SELECT event_id, coalesce(f.factor, 2.5) AS factor FROM events LEFT JOIN (VALUES ('click', 1.5), ('view', 2.5)) f(event_type, factor) USING (event_type)""")
def default_factor(spark, d):
    """Factors by language with a default, here by kind of event: kinds without one get that of views."""
    factors = spark.createDataFrame([("click", 1.5), ("view", 2.5)], "event_type string, factor double")
    return vectors.with_fallback(t(spark, d, "events").select("event_id", "event_type"), factors, "event_type", "view").select("event_id", "factor")


@query("SELECT event_id, ts > TIMESTAMP '2023-06-01' AND ts < TIMESTAMP '9999-12-31' AS inside FROM events")
def open_interval(spark, d):
    """An interval that has a start but no end."""
    inside = relevance.contains(F.col("ts"), relevance.Interval.after_date("2023-06-01", 5))
    return t(spark, d, "events").select("event_id", inside.alias("inside"))


@query("SELECT DISTINCT url FROM pages WHERE NOT regexp_matches(url, 'example.com')")
def missing_urls(spark, d):
    p = t(spark, d, "pages")
    index = p.filter(F.col("url").rlike("example.com")).select(urls.surt(F.col("url")).alias("surt"))
    return snapshots.missing(p.select("url").distinct(), index)


@query("SELECT url, min_by(path, (length(path), path)) AS path FROM (SELECT url, repeat('L', (page_id % 5)::INTEGER) AS path FROM pages) GROUP BY 1")
def frontier_merge(spark, d):
    p = t(spark, d, "pages").select("url", F.expr("repeat('L', int(page_id % 5))").alias("path"), F.lit(1.0).alias("priority"), F.lit(None).cast("string").alias("referrer"), F.lit(None).cast("timestamp").alias("referrer_ts"))
    return frontier.merge(p).select("url", "path")


def _graph(spark, d):
    """A link graph over the orders: order k links to the next orders of its customer."""
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("timestamp").alias("crawl_ts"), "o_totalprice")
    name = lambda c: F.concat(F.lit("http://o"), c, F.lit(".org/"))
    line = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    after = F.array_compact(F.array(F.lead("o_orderkey", 1).over(line), F.lead("o_orderkey", 2).over(line)))
    o = o.withColumn("after", after)
    return o.select(name(F.col("o_orderkey")).alias("url"), (F.col("o_totalprice") / 600000).alias("relevance"), F.lit(0.5).alias("score"), F.transform("after", name).alias("links"), "crawl_ts", "o_orderkey", "o_custkey")


@query("""SELECT 'http://o' || o_orderkey || '.org/' AS url, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) // 2 + 1)::INTEGER AS depth FROM orders""")
def crawl_to_end(spark, d):
    """Breadth-first rounds from the first order of every customer until the queue is empty."""
    graph = _graph(spark, d)
    first = graph.groupBy("o_custkey").agg(F.min_by("url", "o_orderkey").alias("url")).select("url")
    out = crawling.crawl(first, graph.drop("o_orderkey", "o_custkey"), batch=10_000_000, stop=crawling.queue_empty(), max_rounds=1_000_000)
    return out.results.select("url", F.length("path").alias("depth"))


# -- sources, sinks, grid, evaluation -----------------------------------------------------
@query("""SELECT 'http://e' || event_id || '.org/' AS url, CASE WHEN event_type = 'error' THEN 404 ELSE 200 END AS status,
 CASE WHEN event_type <> 'error' THEN round(value, 6) END AS relevance FROM events""")
def result_tsv_union(spark, d):
    e = t(spark, d, "events").withColumn("url", F.concat(F.lit("http://e"), "event_id", F.lit(".org/")))
    good = e.filter("event_type <> 'error'").select("url", F.col("ts").alias("crawlTime"), F.lit("S").alias("path"), F.lit(200).alias("status"), F.lit(1.0).alias("crawlPriority"), r6(F.col("value")).alias("relevance"), F.col("ts").alias("modifiedDate"), F.lit(None).cast("long").alias("snapshotsDuration"), F.lit(-1.0).alias("minRelevance"), F.lit(-1.0).alias("maxRelevance"))
    lost = e.filter("event_type = 'error'").select("url", F.lit("S").alias("path"), F.lit(1.0).alias("priority"))
    return tables.result_rows(good, lost).select("url", "status", "relevance")


@query("SELECT page_id, url, (row_number() OVER (ORDER BY page_id) - 1)::VARCHAR || '.html' AS file FROM pages")
def zip_toc(spark, d):
    return tables.contents(t(spark, d, "pages").select("page_id", "url"), "page_id")


_NAMES = "SELECT CASE p_partkey % 4 WHEN 0 THEN 'org.lib.Fetcher.' || p_size WHEN 1 THEN 'group.' || p_size WHEN 2 THEN 'Other.m' || p_size ELSE 'plain' || p_size END AS name FROM part"


@query(rf"""SELECT DISTINCT CASE WHEN regexp_matches(g, '(^|\.)[A-Z]\w*$') THEN regexp_extract(g, '([^.]+)$', 1) ELSE g END AS grp, regexp_extract(name, '([^.]+)$', 1) AS metric
FROM (SELECT name, regexp_extract(name, '^(.*)\.[^.]*$', 1) AS g FROM ({_NAMES}))""")
def metric_hierarchy(spark, d):
    p = F.col("p_partkey") % 4
    size = F.col("p_size").cast("string")
    name = F.when(p == 0, F.concat(F.lit("org.lib.Fetcher."), size)).when(p == 1, F.concat(F.lit("group."), size)).when(p == 2, F.concat(F.lit("Other.m"), size)).otherwise(F.concat(F.lit("plain"), size))
    return content.metric_hierarchy(t(spark, d, "part").select(name.alias("name"))).distinct()


@query("""SELECT n_name AS name, list_sort(list('http://' || lower(r.r_name) || '.org/' || n_nationkey)) AS "seedUrls" FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY 1""")
def spec_seed_merge(spark, d):
    n, r = t(spark, d, "nation"), t(spark, d, "region")
    specs = n.select(F.col("n_name").alias("name"), F.array().cast("array<string>").alias("seedUrls"))
    seeds = n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_name").alias("name"), F.concat(F.lit("http://"), F.lower("r_name"), F.lit(".org/"), "n_nationkey").alias("url"))
    return tables.merge_seeds(specs, seeds)


@query("""SELECT n_name AS code, (CASE WHEN n_nationkey % 2 = 0 THEN 10 * (n_nationkey + 1) ELSE 7 * (n_nationkey + 1) END)::INTEGER AS before_days, 30 AS after_days,
 2 AS titles FROM nation""")
def topic_tsv_parse(spark, d):
    k = F.col("n_nationkey") + 1
    period = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("P"), 10 * k, F.lit("D"))).otherwise(F.concat(F.lit("P"), k, F.lit("W")))
    raw = t(spark, d, "nation").select(
        F.col("n_name").alias("code"), F.lit(None).cast("date").alias("from_date"), F.lit(None).cast("date").alias("until_date"), period.alias("before"), F.lit("P30D").alias("after"),
        F.lit("").alias("description"), F.lit("One, Two").alias("wikipedia"),
    )
    return tables.parse_topics(raw).select("code", "before_days", "after_days", F.size("titles").alias("titles"))


@query("""SELECT n_name AS name, method, snapshots FROM nation, (VALUES ('CONTENT', 1), ('CONTENT', 10), ('CONTENT', 100), ('CONTENT_AND_TIME', 1), ('CONTENT_AND_TIME', 10),
 ('CONTENT_AND_TIME', 100), ('CONTENT_AND_TIME_EXP', 1), ('CONTENT_AND_TIME_EXP', 10), ('CONTENT_AND_TIME_EXP', 100), ('TIME', 1), ('TIME_EXP', 1), ('UNFOCUSED', 1)) m(method, snapshots)""")
def experiment_grid(spark, d):
    return analysis.experiments(t(spark, d, "nation").select(F.col("n_name").alias("name")))


@query("""WITH s AS (SELECT length(text) AS score, quality AS y FROM documents JOIN labels USING (doc_id)),
r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM s)
SELECT sum(y)::BIGINT AS p, sum(1 - y)::BIGINT AS q, round((sum(y * rk) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 6) AS auc FROM r""")
def eval_quality(spark, d):
    scored = t(spark, d, "documents").select("doc_id", F.length("text").alias("score")).join(t(spark, d, "labels"), "doc_id")
    return content.rank_auc(scored, "score", "quality").select("p", "q", r6(F.col("auc")).alias("auc"))


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY CUBE (source, lang)")
def annotation_rollup(spark, d):
    return t(spark, d, "documents").cube("source", "lang").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT round(avg((o_orderdate::DATE = l_shipdate::DATE)::INTEGER), 6) AS accuracy, round(avg(abs(date_diff('day', l_shipdate::DATE, o_orderdate::DATE))), 6) AS mean_days, count(*) AS n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def date_accuracy(spark, d):
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_shipdate").join(t(spark, d, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return content.date_accuracy(rows, "o_orderdate", "l_shipdate").select(r6(F.col("accuracy")).alias("accuracy"), r6(F.col("mean_days")).alias("mean_days"), "n")


# -- language, keyphrases, streams --------------------------------------------------------
@query()
def lang_confusion(spark, d):
    docs = t(spark, d, "documents")
    guess = langid.classifier(langid.train(docs))
    found = langid.dealt(docs.select("lang", "text")).select("lang", guess("text").alias("g")).select("lang", F.col("g.lang").alias("guess"))
    return found.groupBy("lang", "guess").agg(F.count(F.lit(1)).alias("n"))


@query(r"""WITH c AS (SELECT lang, string_split(text, '') AS c FROM documents WHERE regexp_full_match(text, '[\x00-\x7F]+')),
p AS (SELECT lang, list_concat([''], c) AS a, list_concat(c, ['']) AS b FROM c)
SELECT lang, prev, next, count(*) AS n FROM (SELECT lang, unnest(a) AS prev, unnest(b) AS next FROM p) GROUP BY 1, 2, 3""")
def markov_bigrams(spark, d):
    return langid.bigrams(t(spark, d, "documents"))


@query()
def keyphrases(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "text")
    # Texts are dealt evenly: ranking them takes far longer than moving them, and files may have fewer parts than there are cores.
    docs = docs.repartition(vectors.parts(docs), "doc_id")
    found = docs.select("doc_id", F.explode_outer(keyphrase.keyphrases_udf(5)("text")).alias("p")).filter("p is not null")
    return found.select("doc_id", "p.phrase", r6(F.col("p.metric")).alias("metric"))


_STOPS = ", ".join(f"'{w}'" for w in sorted(keyphrase.STOP))


@query(rf"""WITH s AS (SELECT doc_id, unnest(x) AS body, generate_subscripts(x, 1) AS sentence FROM (SELECT doc_id, regexp_split_to_array(lower(text), '[.!?\n]+') AS x FROM documents)),
w AS (SELECT doc_id, sentence, unnest(y) AS word, generate_subscripts(y, 1) AS pos FROM (SELECT doc_id, sentence, regexp_extract_all(body, '\p{{L}}+') AS y FROM s)),
n AS (SELECT doc_id, word, lead(word) OVER (PARTITION BY doc_id, sentence ORDER BY pos) AS next FROM w WHERE word NOT IN ({_STOPS})),
e AS (SELECT doc_id, word AS src, next AS dst FROM n WHERE next IS NOT NULL AND next <> word)
SELECT * FROM e UNION SELECT doc_id, dst, src FROM e""")
def textrank_graph_edges(spark, d):
    return keyphrase.edges(t(spark, d, "documents"), "doc_id")


@query("""SELECT epoch_us(date_trunc('hour', ts)) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def windowed_events(spark, d):
    e = t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return streaming.windowed(e).select(F.unix_micros("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events),
s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def session_events(spark, d):
    e = t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return streaming.sessions(e).select("user_id", F.unix_micros("start").alias("start"), "n")


@query()
def page_analysis(spark, d):
    """The whole analysis of crawled pages against a topic: text, date, similarity, score and links."""
    pages = t(spark, d, "pages")
    reference = vectors.top_terms(vectors.merge(_lang_weights(spark, d).filter("lang = 'en'"), "lang", "doc_id"), "lang", 100).select("term", "w")
    out = analysis.analyse(pages, reference, EVENT, "CONTENT_AND_TIME", AS_OF)
    return out.select("page_id", "url", r6(F.col("relevance")).alias("relevance"), F.col("modified").cast("timestamp_ntz").alias("modified"), r6(F.col("score")).alias("score"), F.size("links").alias("links"))
