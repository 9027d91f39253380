"""What moves and what is held at once in queries over large tables; odd documents against SQL."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from tidemark.functions import analyzers, html, urls
from tidemark.operators import keyphrase, langid, vectors
from tidemark.plans import crawl as crawling
from tidemark.plans.queries import ORACLES, QUERIES

IN_PLACE = [
    "language_cosine", "cosine_topical", "relevance_threshold", "correction_factor", "build_topic_specs", "merge_vectors_df", "reference_top100",
    "merge_vectors", "page_analysis", "vector_norms", "keyword_weighted_vector", "tfidf_vector", "relative_tf", "top_k_terms",
]
ODD = [
    (1, "de", "der Haus 7 haus b2 Straße"), (1, "de", "Haus und Hof"), (2, "en", "the house the 2000s x"), (3, "en", ""), (4, "de", None), (5, "fr", "?!  "),
    (6, "it", "7 8 9"), (7, "de", "haus " * 300 + "b2"), (8, "en", "house haus the"), (9, "de", "ferien am see"), (9, "en", "haus am see"),
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(ODD, "doc_id long, lang string, text string").coalesce(1).write.parquet(f"{place}/documents.parquet")
    pages = [(i, f"http://e.org/{i}", f'<html><body><p>{text}</p><a href="/{i}?x=1">next</a></body></html>') for i, (_, _, text) in enumerate(ODD)]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{place}/pages.parquet")
    return place


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(repr(tuple(map(str, r))) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", [n for n in IN_PLACE if n in ORACLES] + ["fallback_terms"])
def test_odd_documents_match_sql(spark, odd, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{odd}/documents.parquet/*.parquet')")
    assert rows(QUERIES[name](spark, odd).toPandas()) == rows(con.sql(ORACLES[name]).df())


@pytest.mark.parametrize("name", IN_PLACE)
def test_pairs_of_document_and_term_are_not_shuffled(spark, odd, name):
    plan = QUERIES[name](spark, odd)._jdf.queryExecution().executedPlan().toString()
    exchanges = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)
    assert not [e for e in exchanges if re.search(r"(doc|page)_id#", e) and "term#" in e]
    # The pairs' only partner is each block's own terms.
    assert "SortMergeJoin [term#" not in plan


def test_blocks_keep_their_size(spark, tmp_path):
    for name, n in (("one", 20_000), ("four", 80_000)):
        spark.range(n).selectExpr("id AS doc_id", "sha2(cast(id as string), 512) || sha2(cast(-id as string), 512) AS text").write.parquet(f"{tmp_path}/{name}")
    one, four = (vectors.parts(spark.read.parquet(f"{tmp_path}/{n}")) for n in ("one", "four"))
    assert four <= 4 * one and vectors.parts(spark.createDataFrame([(1, "a")], "doc_id long, text string")) == 4


def test_crawl_writes_each_row_once(spark):
    """A chain of pages: what a round writes does not grow with the rounds before it, and pages are not shuffled again."""
    n = 12
    ids = spark.range(n).select(F.concat(F.lit("p"), "id").alias("url"), F.lit(0.5).alias("relevance"), F.lit(0.5).alias("score"), F.array(F.concat(F.lit("p"), F.col("id") + 1)).alias("links"), F.lit(None).cast("timestamp").alias("crawl_ts"))
    wrote = []
    spy = crawling.written
    crawling.written = lambda df, label: wrote.append((label, (out := spy(df, label)).count())) or out
    tables = len(spark.catalog.listTables())
    try:
        out = crawling.crawl(ids.filter("url = 'p0'").select("url"), ids, 5, crawling.queue_empty())
    finally:
        crawling.written = spy
    assert out.results.count() == n and [r.url for r in out.missing.collect()] == [f"p{n}"]
    assert {len(r.path) - 1 for r in out.results.collect()} == set(range(n))
    assert sum(c for _, c in wrote) <= 2 * (n + 1) + 1 and len(spark.catalog.listTables()) == tables
    with crawling.in_buckets(ids, "url", "pages") as (pages, parts):
        asked = ids.select("url").repartition(parts, "url").hint("merge").join(pages.hint("merge"), "url", "left")
        assert asked._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_edges_stay_where_their_text_is(spark, odd):
    plan = QUERIES["textrank_graph_edges"](spark, odd)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Union" not in plan


@pytest.mark.parametrize("name", ["page_outlinks", "html_text_stats"])
def test_a_page_is_parsed_once_by_one_function(spark, odd, name):
    plan = QUERIES[name](spark, odd)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_few_pages_are_objects_at_one_time(monkeypatch):
    import gc

    import pyarrow as pa

    class Page(dict):
        pass

    most, real = [0], html.parse

    def parse(page):
        most[0] = max(most[0], sum(isinstance(x, Page) for x in gc.get_objects()))
        return Page(real(page))

    pages = pa.array(["<html><p>a</p><a href='/x'>b</a></html>", None] * (2 * html.SLICE))
    monkeypatch.setattr(html, "parse", lambda p: None if p is None else parse(p))
    out = html.parser(("links",), urls.resolved).func(pages, pa.array(["http://e.org/"] * len(pages)))
    assert out.to_pylist()[:2] == [{"links": ["http://e.org/x"]}, {"links": None}] and len(out) == len(pages) and most[0] <= 2 * html.SLICE


def test_stems_of_slices(spark):
    import pyarrow as pa

    words = [["Häuser", "häuser", "running"], None, [], ["running"]] * analyzers.SLICE
    langs = ["de", "en", "fr", "en"] * analyzers.SLICE
    want = [None if w is None else [analyzers.STEMMERS[lang](x) for x in w] for w, lang in zip(words, langs, strict=True)]
    assert analyzers._stemmed.func(pa.array(words, type=pa.list_(pa.string())), pa.array(langs)).to_pylist() == want
    assert analyzers._stemmed.func(pa.array([["a"], ["running"]]).slice(1), pa.array(["de", "en"]).slice(1)).to_pylist() == [["run"]]


def _plain_rank(neighbours, rank):
    """Rounds over sets of neighbours, as ``settle`` does over arrays."""
    for _ in range(len(neighbours)):
        new = {v: 0.15 + 0.85 * sum(rank[u] / len(neighbours[u]) for u in around) for v, around in neighbours.items()}
        change = [abs(new[v] - rank[v]) for v in neighbours]
        rank, mean = new, sum(change) / len(change)
        if (sum((c - mean) ** 2 for c in change) / max(1, len(change) - 1)) ** 0.5 / len(change) ** 0.5 < 0.005:
            break
    return rank


def test_ranks_do_not_depend_on_the_order_of_neighbours():
    draw = random.Random(3)
    near = {v: set() for v in range(60)}
    for _ in range(150):
        a, b = draw.sample(range(59), 2)
        near[a].add(b)
        near[b].add(a)
    got, want = keyphrase.iterate(near), _plain_rank(near, dict.fromkeys(near, 1.0))
    assert got == pytest.approx(want, abs=1e-8) and got[59] == pytest.approx(0.15)
    src, dst = np.array([(u, v) for v in near for u in near[v]]).T
    back = keyphrase.settle(src[::-1], dst[::-1], np.ones(60))
    assert (back == keyphrase.settle(src, dst, np.ones(60))).all()


def test_phrases_with_a_tagger_of_ones_own():
    body = "Solar power plants grow; solar power plants feed the grid! The grid needs solar power plants, rain fell?\nRain"
    own = keyphrase.keyphrases(body, 9, lambda words: keyphrase.stop_word_tagger(words))
    assert own == keyphrase.keyphrases(body, 9)


def test_ngrams_of_joined_texts_stay_apart():
    texts = ["", "a", "ab", "äbc", "", "abcab"]
    data = [x.encode() for x in texts]
    for n in langid.SIZES:
        got = {int(c).to_bytes(n, "big"): int(k) for c, k in zip(*langid.count_codes(data, n), strict=True)}
        assert got == Counter(x[i : i + n] for x in data for i in range(len(x) - n + 1))


@pytest.mark.parametrize("name", ["keyphrases", "lang_confusion"])
def test_texts_are_dealt_evenly(spark, odd, name):
    """A single file of a single part does not leave the work to one task."""
    plan = QUERIES[name](spark, odd)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
