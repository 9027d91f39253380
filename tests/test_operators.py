"""Operators on small tables: vectors, snapshots, frontier, crawl, content, keyphrases, languages, sources, sinks, streams."""

import gzip
import json
import zipfile
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import relevance
from tidemark.operators import content, frontier, keyphrase, langid, similarity, snapshots, vectors
from tidemark.plans import analysis
from tidemark.plans import crawl as crawling
from tidemark.sources import archive, mediawiki, tables
from tidemark.streaming import events


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "de", "a b b c"), (2, "de", "b c d"), (3, "en", "x y 7"), (4, None, None)]
    return spark.createDataFrame(rows, "doc_id long, lang string, text string")


def test_vectors(spark, docs):
    counts = vectors.term_counts(docs, "doc_id")
    assert {(r.doc_id, r.term): r.n for r in counts.collect()}[1, "b"] == 2
    idf = {r.term: r.df for r in vectors.idf_table(counts, "doc_id").collect()}
    assert idf["b"] == 2 and idf["x"] == 1
    weights = vectors.tfidf(counts, vectors.idf_table(counts, "doc_id"), "doc_id", ["b"])
    assert not weights.filter("term = '7'").count()
    reference = weights.filter("doc_id = 1")
    sims = {r.doc_id: r.sim for r in vectors.cosine(weights, reference, "doc_id").collect()}
    assert sims[1] == pytest.approx(1) and 0 < sims[2] < 1 and sims[3] == 0
    ref, factor = vectors.reference_model(weights.join(docs.select("doc_id", "lang"), "doc_id"), "lang", "doc_id", 3)
    assert ref.filter("lang = 'de'").count() == 3 and 0 < factor.filter("lang = 'de'").first().factor <= 1
    empty = vectors.with_idf(counts, spark.createDataFrame([], "term string, idf double"))
    assert {r.idf for r in empty.collect()} == {1.0}


def test_merge_is_associative(spark, docs):
    counts = vectors.term_counts(docs, "doc_id").withColumnRenamed("n", "w").withColumn("g", F.lit(1))
    whole = {(r.term): r.w for r in vectors.merge(counts, "g", "doc_id").collect()}
    parts = vectors.merge(counts.filter("doc_id < 2"), "g", "doc_id").union(vectors.merge(counts.filter("doc_id >= 2"), "g", "doc_id"))
    assert whole == {r.term: r.w for r in vectors.merge(parts.withColumn("doc_id", F.lit(1)), "g", "doc_id").collect()}


def test_map_cosine_and_fallback(spark):
    m = lambda **x: F.create_map(*[F.lit(v) for k in x.items() for v in k])
    assert spark.range(1).select(vectors.map_cosine(m(a=1.0, b=1.0), m(a=1.0)).alias("x")).first().x == pytest.approx(0.5**0.5)
    rows = spark.createDataFrame([("de",), ("fr",)], "lang string")
    table = spark.createDataFrame([("de", 1), ("en", 2)], "lang string, v int")
    assert {(r.lang, r.v) for r in vectors.with_fallback(rows, table, "lang", "en").collect()} == {("de", 1), ("fr", 2)}
    sims = spark.createDataFrame([("de", 0.4), ("en", 0.4)], "lang string, sim double")
    factors = spark.createDataFrame([("de", 0.5)], "lang string, factor double")
    assert {r.lang: r.sim for r in vectors.corrected(sims, factors, "lang").collect()} == {"de": 0.8, "en": 0.4}


def test_snapshots(spark):
    index = spark.createDataFrame([("org,e)/", 1, datetime(2010, 1, 1)), ("org,e)/", 2, datetime(2011, 1, 1))], "surt string, version long, ts timestamp")
    front = spark.createDataFrame([("http://e.org/",), ("http://f.org/",)], "url string")
    assert snapshots.locate(front, index).count() == 2 and snapshots.missing(front, index).first().url == "http://f.org/"
    at = F.lit("2010-01-01").cast("timestamp")
    assert snapshots.at_time(index, F.lit("org,e)/"), at).count() == 1 and snapshots.at_time(index, F.lit("org,e)/"), at, True).count() == 0
    event = relevance.Interval("2010-06-01", "2010-06-02", 30, 30)
    assert snapshots.best_by_time(index, "surt", "ts", event, 1, "version").first().version == 1
    results = spark.createDataFrame([("u", 0, -1.0, None), ("u", 1, 0.5, datetime(2010, 1, 1)), ("u", 2, 0.5, datetime(2010, 1, 2))], "k string, pos int, rel double, mod timestamp")
    best = snapshots.choose(results, "k", "rel", "mod", "pos").first()
    assert best.best == 1 and best.min_relevance == 0.5 and best.span_ms == 86_400_000


def test_frontier(spark):
    assert frontier.weights([False] * 3) == [0, 0, 0] and frontier.weights([False, True, True]) == pytest.approx([0, 1 / 3, 2 / 3])
    assert frontier.weights([True] * 10)[-3:] == pytest.approx([0.125, 0.25, 0.5], abs=0.001)
    rows = spark.createDataFrame([("u", "S", 1.0, None, 1), ("u", "SL", 0.2, "b", 2), ("v", "SL", 0.29, "b", 3)], "url string, path string, priority double, referrer string, seq int")
    assert [r.bucket for r in frontier.in_order(rows, "seq").orderBy("seq").collect()] == [99, 20, 29]
    assert {r.url: r.path for r in frontier.merge(rows.withColumn("referrer_ts", F.lit(None).cast("timestamp"))).collect()} == {"u": "S", "v": "SL"}
    assert frontier.unseen(rows, rows.filter("url = 'u'")).count() == 1
    assert [r.seq for r in frontier.pop(rows, 2).collect()] == [1, 3]
    many = spark.range(3_000).select(F.col("id").alias("seq"), ((F.col("id") % 3 + 97) / 100.0 + 0.001).alias("priority"))
    first = frontier.pop(many, 1, seed=3).first().bucket
    assert first in (97, 98, 99)


def test_crawl(spark):
    pages = [("a", 0.9, 0.9, ["b", "c", "x"]), ("b", 0.1, 0.1, ["d"]), ("c", 0.8, 0.5, ["a", "d"]), ("d", 0.7, 0.5, [])]
    pages = spark.createDataFrame([(*p, datetime(2010, 1, 1)) for p in pages], "url string, relevance double, score double, links array<string>, crawl_ts timestamp")
    seeds = spark.createDataFrame([("a",)], "url string")
    out = crawling.crawl(seeds, pages, 10, crawling.queue_empty(), threshold=0.5)
    assert {r.url: r.path for r in out.results.collect()} == {"a": "S", "c": "SL", "d": "SLL"}
    assert [r.url for r in out.missing.collect()] == ["x"]
    assert (out.progress.irrelevant, out.progress.not_found, out.progress.retrieved) == (1, 1, 3)
    few = crawling.crawl(seeds, pages, 1, crawling.any_of(crawling.enough_urls(2), crawling.queue_empty()), seed=5)
    assert few.results.count() == 2


def test_content(spark, docs):
    assert {(r.doc_id, r.keyword, r.n) for r in content.keyword_counts(docs, "doc_id", ["b"]).collect()} == {(1, "b", 2), (2, "b", 1)}
    people = spark.createDataFrame([("x", "PERSON")], "label string, type string")
    assert content.gazetteer_entities(docs, "doc_id", people).first().n == 1
    assert content.analyse(docs, "doc_id", ["b"]).filter("doc_id = 1").first().keywords == {"b": 2}
    scored = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0)], "s double, y int")
    assert content.rank_auc(scored, "s", "y").first().auc == pytest.approx(0.875)
    names = spark.createDataFrame([("a.b.Fetcher.foo",), ("group.bar",), ("foo",)], "name string")
    assert {(r.grp, r.metric) for r in content.metric_hierarchy(names).collect()} == {("Fetcher", "foo"), ("group", "bar"), ("", "foo")}


def test_keyphrases(spark):
    body = "Solar power plants grow. Solar power plants feed the grid. The grid needs solar power plants. Rain fell"
    top = keyphrase.keyphrases(body, 3)
    assert top[0][0].lower().startswith("solar power plants") and len(top) <= 3 and top[0][1] >= top[-1][1]
    low = keyphrase.keyphrases(body, 1, lowest=True)
    assert low[0][1] <= top[-1][1]
    assert keyphrase.keyphrases(None, 3) == [] and keyphrase.keyphrases("the of", 3) == []
    with pytest.raises(ValueError):
        keyphrase.keyphrases_udf(-1)
    frame = spark.createDataFrame([(1, "red fox and red hen. red fox")], "doc_id int, text string")
    assert {(r.src, r.dst) for r in keyphrase.edges(frame, "doc_id").collect()} >= {("red", "fox"), ("fox", "red"), ("red", "hen")}


def test_languages(spark):
    rows = [("en", "the house and the garden with the tree")] * 5 + [("de", "das haus und der garten mit dem baum")] * 5
    frame = spark.createDataFrame(rows, "lang string, text string")
    model = langid.train(frame, 500)
    guess = langid.classifier(model)
    asked = spark.createDataFrame([("the tree with the house",), ("der baum und das haus",), (None,)], "text string")
    got = [r.g for r in asked.select(guess("text").alias("g")).collect()]
    assert got[0].lang == "en" and got[1].lang == "de" and got[0].confidence > 0.9
    assert {r.lang for r in langid.languages(model).collect()} == {"en", "de"}
    pairs = langid.bigrams(spark.createDataFrame([("en", "aba")], "lang string, text string"))
    assert {(r.prev, r.next): r.n for r in pairs.collect()} == {("", "a"): 1, ("a", "b"): 1, ("b", "a"): 1, ("a", ""): 1}
    assert langid.generate([("", "a", 1), ("a", "", 1)], 1) == "a"


def test_languages_over_whole_texts(spark):
    """A text is judged and learned from all of its bytes, however long its head."""
    head, tail = "the house and the garden with the tree " * 110, "das haus und der garten mit dem baum " * 600
    assert len(head) > 4_096
    rows = [("en", "the house and the garden with the tree")] * 5 + [("de", "das haus und der garten mit dem baum")] * 5
    guess = langid.classifier(langid.train(spark.createDataFrame(rows, "lang string, text string"), 500))
    asked = spark.createDataFrame([(head + tail,), (head,)], "text string")
    assert [r.g.lang for r in asked.select(guess("text").alias("g")).collect()] == ["de", "en"]
    mixed = [("en", head + "zq"), ("en", "zq"), ("de", "é")]
    got = {(r.lang, bytes(r.feature)): r.n for r in langid.count_features(spark.createDataFrame(mixed, "lang string, text string")).collect()}
    want = Counter((lang, t.encode()[i : i + n]) for lang, t in mixed for n in (1, 2, 3) for i in range(len(t.encode()) - n + 1))
    assert got == want and got["en", b"zq"] == 2


def test_page_analysis(spark):
    page = "<html><head><meta name='date' content='2010-05-01'></head><body><p>alpha beta</p><a href='/x?utm_a=1'>n</a><a href='mailto:z'>m</a></body></html>"
    pages = spark.createDataFrame([(1, "http://e.org/d/p.html", page), (2, "http://e.org/2010/05/02/", "<p>gamma</p>"), (3, "http://e.org/", "<p> </p>")], "page_id long, url string, html string")
    reference = spark.createDataFrame([("alpha", 1.0)], "term string, w double")
    out = {r.page_id: r for r in analysis.analyse(pages, reference, relevance.Interval("2010-05-01", "2010-05-03", 5, 5), "CONTENT_AND_TIME", "2020-01-01").collect()}
    assert out[1].relevance > 0 and out[1].links == ["http://e.org/x"] and out[1].modified.day == 1
    assert out[2].relevance == 0 and out[2].modified.day == 2 and out[3].relevance == -1 and out[3].links == []
    assert analysis.experiments(spark.createDataFrame([("s",)], "name string")).count() == 12


def test_outlinks_are_resolved_and_normalised(spark):
    links = ["../up", "?q=1", "//Other.org/x", "HTTP://e.org:80/a/./b", "#top", "mailto:x", "javascript:1", "", "c?utm_source=1&b=2", "c?b=2"]
    page = "<p>text</p>" + "".join(f"<a href='{x}'>n</a>" for x in links)
    rows = [(1, "http://e.org/d/p.html", page, "text/html"), (2, "http://e.org/", page, "image/png"), (3, "http://e.org/", page, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, mime string")
    got = sorted(r.link for r in analysis.outlinks(pages).collect())
    assert got == sorted(["http://e.org/up", "http://e.org/d/p.html?q=1", "http://other.org/x", "http://e.org/a/b", "http://e.org/d/p.html", "http://e.org/d/c?b=2"])
    assert {r.page_id: r.text for r in analysis.parse_pages(pages).collect()}[2] == ""
    assert analysis.outlinks(pages.drop("mime")).select("page_id").distinct().count() == 3


def test_fetch(spark, tmp_path):
    def response(body):
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
        return gzip.compress(b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://e.org/\r\nWARC-Date: 2010-01-02T03:04:05Z\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(http), http))

    (tmp_path / "ARC").mkdir()
    first = response(b"early")
    (tmp_path / "ARC" / "ARC-1.warc.gz").write_bytes(first + response(b"near"))
    at = [("org,e)/", 1, datetime(2001, 1, 1), "ARC-1.warc.gz", 0), ("org,e)/", 2, datetime(2010, 1, 2), "ARC-1.warc.gz", len(first)),
          ("org,f)/", 1, datetime(2010, 1, 2), "ARC-9.warc.gz", 0)]
    index = spark.createDataFrame(at, "surt string, version long, ts timestamp, filename string, offset long")
    frontier = spark.createDataFrame([("http://e.org/",), ("http://f.org/",), ("http://g.org/",)], "url string")
    event = relevance.Interval("2010-01-01", "2010-02-01", 5, 5)
    got = archive.fetch(frontier, index, event, str(tmp_path)).collect()
    assert [(r.asked_url, r.version, r.text, r.status) for r in got] == [("http://e.org/", 2, "near", 200)]
    both = archive.fetch(frontier, index, event, f"file://{tmp_path}", versions=2).collect()
    assert sorted((r["rank"], r.text) for r in both) == [(1, "near"), (2, "early")]


def test_language_similarity(spark):
    weights = spark.createDataFrame([(1, "a", 3.0), (1, "b", 4.0), (2, "a", 1.0), (3, "z", 1.0)], "doc_id long, term string, w double")
    docs = spark.createDataFrame([(1, "en"), (2, "pt"), (3, "de"), (4, None)], "doc_id long, language string")
    spec = spark.createDataFrame([("s", {"en": ({"b": 1.0},), "de": ({"a": 2.0},)}, {"de": 0.5})],
        "name string, referenceVectors map<string,struct<elements:map<string,double>>>, correctionFactors map<string,double>")
    ref, factor = similarity.stored_vectors(spec).drop("name"), similarity.stored_factors(spec).drop("name")
    got = {r.doc_id: (r.route, round(r.sim, 6)) for r in similarity.language_cosine(weights, docs, ref, factor, "doc_id").collect()}
    assert got == {1: ("en", 0.8), 2: ("de", 2.0), 3: ("de", 0.0), 4: ("de", 0.0)}
    lone = similarity.language_cosine(weights, docs, ref.filter("language = 'en'"), factor, "doc_id").collect()
    assert {r.doc_id: round(r.sim, 6) for r in lone} == {1: 0.8, 2: 0.0, 3: 0.0, 4: 0.0}
    labels = spark.createDataFrame([(1, "de", "x"), (1, None, "y"), (1, "en", "x"), (2, None, "q")], "topic long, language string, name string")
    assert {(r.topic, r.language): r.keywords for r in similarity.language_keywords(labels, "topic").collect()} == {(1, "de"): ["x", "y"], (1, "en"): ["x", "y"], (2, None): ["q"]}
    assert spark.range(1).select(similarity.all_keywords(F.create_map(F.lit("de"), F.array(F.lit("b"), F.lit("a")), F.lit("en"), F.array(F.lit("b")))).alias("k")).first().k == ["a", "b"]


def test_archive(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=iso-8859-1\r\nDate: Mon, 03 Jan 2011 10:20:30 GMT\r\n\r\n<p>\xe4</p>"
    warc = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://e.org/\r\nWARC-Date: 2010-01-02T03:04:05Z\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(http), http)
    arc = b"http://f.org/ 1.2.3.4 20100102030405 text/html %d\n%s\n" % (len(http), http)
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(warc) + gzip.compress(warc))
    (tmp_path / "b.arc").write_bytes(arc)
    spark.dataSource.register(archive.WarcSource)
    got = spark.read.format("warc").option("files", f"{tmp_path}/a.warc.gz,{tmp_path}/b.arc").load().collect()
    assert sorted(r.url for r in got) == ["http://e.org/", "http://e.org/", "http://f.org/"]
    assert all(r.text == "<p>ä</p>" and r.status == 200 and r.mime == "text/html" for r in got) and got[0].crawl_ts == datetime(2010, 1, 2, 3, 4, 5)
    files = spark.read.format("binaryFile").load(f"{tmp_path}/*")
    assert archive.from_binary_files(files).count() == 3
    at = [("a.warc.gz", len(gzip.compress(warc)), 1), ("b.arc", 0, 2), ("b.arc", 5_000, 3), ("gone.arc", 0, 4)]
    where = spark.createDataFrame([(str(tmp_path / n), o, k) for n, o, k in at], "path string, offset long, k int")
    assert sorted(r.k for r in archive.read_located(where).collect()) == [1, 2]
    assert archive.charset(b"<meta charset='utf-16'>", {"Content-Type": "text/html"}) == "utf-16" and archive.charset(b"", {}) == "utf-8"
    assert archive.snapshot("u", None, None, http)[1] == datetime(2011, 1, 3, 10, 20, 30)


def test_tables(spark, tmp_path):
    (tmp_path / "topics.tsv").write_text("Code\tFrom\tUntil\tBefore\tAfter\tDescription\tWikipedia\nx\t2010-01-01\t2010-02-01\tP2W\tP30D\td\tOne, Two\n")
    row = tables.read_topics(spark, str(tmp_path / "topics.tsv")).first()
    assert (row.code, row.before_days, row.after_days, row.titles) == ("x", 14, 30, ["One", "Two"])
    spec = {"name": "s", "seedUrls": ["u"], "referenceTime": {"start": "2010-01-01", "end": "2010-02-01", "beforeFuzziness": "P2W", "afterFuzziness": "P1D"},
            "referenceVectors": {"de": {"elements": {"a": 1.5}}}, "keywords": {"de": ["k"]}}
    (tmp_path / "s.json").write_text(json.dumps(spec, indent=1))
    specs = tables.read_specs(spark, str(tmp_path / "s.json"))
    assert specs.first().referenceVectors["de"].elements == {"a": 1.5}
    tables.write_specs(specs, str(tmp_path / "out"))
    assert spark.read.schema(tables.SPEC).json(str(tmp_path / "out/without-keywords")).first().keywords is None
    (tmp_path / "idf.txt").write_text("haus 1.5\nbaum\t2\nbad\n")
    assert {r.term: r.idf for r in tables.read_idf(spark, str(tmp_path / "idf.txt")).collect()} == {"haus": 1.5, "baum": 2.0}
    (tmp_path / "cdx.txt").write_text("org,e)/ http://e.org/wahl x\norg,f)/ http://f.org/ x\n")
    assert tables.grep_index(spark, str(tmp_path / "cdx.txt"), "wahl").first().url == "http://e.org/wahl"
    merged = tables.merge_seeds(specs, spark.createDataFrame([("s", "v"), ("s", "v"), ("t", "w")], "name string, url string"))
    assert merged.count() == 1 and merged.first().seedUrls == ["v"]
    results = spark.createDataFrame([("u", datetime(2010, 1, 1), "S", 200, 1.0, 0.5, None, None, -1.0, -1.0, "<p>")],
        "url string, crawlTime timestamp, path string, status int, crawlPriority double, relevance double, modifiedDate timestamp, snapshotsDuration string, minRelevance double, maxRelevance double, html string")
    missing = spark.createDataFrame([("m", "SL", 0.3)], "url string, path string, priority double")
    tables.write_tsv(results, missing, str(tmp_path / "tsv"))
    assert {r.status for r in spark.read.csv(str(tmp_path / "tsv"), sep="\t", header=True).collect()} == {"200", "404"}
    for lost, names in ((missing, ["0.html", "urls.csv", "missing.csv"]), (missing.limit(0), ["0.html", "urls.csv"])):
        tables.write_zip(results, lost, str(tmp_path / "c.zip"), "url")
        assert zipfile.ZipFile(tmp_path / "c.zip").namelist() == names


def test_mediawiki(spark):
    body = {"parse": {"title": "T", "pageid": 5, "revid": 6, "text": {"*": "<p>x</p>"}, "links": [{"ns": 0, "exists": "", "*": "A"}, {"ns": 0, "*": "B"}],
                      "externallinks": ["http://e.org/", "//f.org"], "properties": [{"name": "k", "*": "v"}]}}
    page = mediawiki.pages(spark.createDataFrame([(json.dumps(body),)], "value string"))
    row = page.first()
    assert row.html == "<p>x</p>" and [x.exists for x in row.links] == [True, False] and row.properties == {"k": "v"}
    assert [r.url for r in mediawiki.external_links(page).collect()] == ["http://e.org/"]


def test_streaming(spark, tmp_path):
    rows = [(k, datetime(2024, 1, 1, k % 3, k % 60), k % 2, "click", 1.0, "{}") for k in range(90)]
    frame = spark.createDataFrame(rows, events.EVENTS.replace("ts timestamp", "ts timestamp_ntz"))
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = events.windowed(events.read_events(spark, str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("hours").start()
    try:
        q.processAllAvailable()
        assert spark.sql("SELECT sum(n) AS n FROM hours").first().n == 90
    finally:
        q.stop()
    batch = frame.withColumn("ts", F.col("ts").cast("timestamp"))
    assert events.windowed(batch).count() == 3 and events.sessions(batch).agg(F.sum("n")).first()[0] == 90


def test_dates_of_pages(spark):
    rows = [(1, "http://e.org/a", "<p>Seen 1.1.2001</p><p>Last modified 2.3.2004 today</p>"), (2, "http://e.org/b", "<p>On 5.6.2007 it rained</p>"),
            (3, "http://e.org/c", "<time datetime='2009-08-07'>x</time><p>modified 2.3.2004</p>"), (4, "http://e.org/d", "<p>none 1.1.1950</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = analysis.page_dates(analysis.parse_pages(pages), "2020-01-01")
    got = {r.page_id: r.d for r in out.select("page_id", F.to_date("date.when").cast("string").alias("d")).collect()}
    assert got == {1: "2004-03-02", 2: "2007-06-05", 3: "2009-08-07", 4: None}


def test_metrics(spark, tmp_path):
    from tidemark.sources import metrics

    rows = spark.createDataFrame([(0.5, ["a"]), (-1.0, [])], "relevance double, links array<string>")
    frame, seen = metrics.observed(rows)
    frame.write.format("noop").mode("overwrite").save()
    assert seen.get["retrieved"] == 2 and seen.get["empty"] == 1 and seen.get["outlinks"] == 1
    metrics.append_csv(str(tmp_path / "m.csv"), seen.get)
    assert len((tmp_path / "m.csv").read_text().splitlines()) == 4
    metrics.log_rows(rows, 0)


def test_idle_queues(spark, tmp_path):
    import time

    schema = "queue string, kind string, ts timestamp"
    at = datetime(2024, 1, 1)
    spark.createDataFrame([("a", "empty", at), ("b", "empty", at), ("b", "success", datetime(2024, 1, 1, 1))], schema).coalesce(1).write.parquet(str(tmp_path / "q"))
    stream = events.idle_queues(spark.readStream.schema(schema).parquet(str(tmp_path / "q")), 500)
    q = stream.writeStream.outputMode("append").format("memory").queryName("idle").trigger(processingTime="300 milliseconds").start()
    try:
        until = time.time() + 40
        while time.time() < until and not spark.sql("SELECT * FROM idle").count():
            time.sleep(0.5)
        assert [(r.queue, r.idle_since) for r in spark.sql("SELECT * FROM idle").collect()] == [("a", at)]
    finally:
        q.stop()
