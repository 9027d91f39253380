"""Benchmark decontamination on a positional inverted index that is split by document.

``build_index`` turns every batch of training documents into one immutable index
shard: its words, and for each the sorted positions at which it stands. All words
of all documents are indexed, whatever the test items are, so one stored index
answers any test set. A lost executor re-reads shards, and no term has a list
that gathers in one place: frequent words are spread over all shards. ``search``
takes the test windows to every shard, starts from the window's rarest term there
and intersects offset-adjusted lists term by term; with ``slop`` every term may
stand up to that many words off its place, which gives proximity matches beside
the exact phrases. Test items are taken in blocks of bounded size, all of which
search the same index.

Defined cases: null or empty texts have no words and are never hit; items without
words match nothing; items shorter than a window are one window; a null item id
is the text "null"; repeated document rows are judged one by one; repeated items
count by id; empty tables give no hits; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import free_name, materialise, start_task

# A word: bytes other than these (text as UTF-8, A-Z lower-cased).
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW = 10
SHARD_WORDS = 1_000_000
BLOCK_WORDS = 1_000_000
# Shards hold some megabytes each: so many go into a file, and so many to Python at once.
SHARDS_A_FILE = 16
SHARDS_A_BATCH = 4
INDEX = "shard long, docs binary, starts binary, lengths binary, terms binary, heads binary, positions binary"


def words_of(text: bytes | None) -> list[bytes]:
    return WORD.findall(text.lower()) if text else []


def _builder(gap: int):
    def shard(name: int, docs: list, lengths: list[int], tokens: list[np.ndarray], known: dict[bytes, int]) -> pa.RecordBatch:
        n = np.array(lengths, np.int64)
        starts = np.concatenate([[0], np.cumsum(n + gap)[:-1]])
        token = np.concatenate(tokens)
        place = np.repeat(starts - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(len(token))
        place = place[np.argsort(token, kind="stable")].astype(np.int32)
        heads = np.concatenate([[0], np.cumsum(np.bincount(token, minlength=len(known)))[:-1]]) if known else n[:0]
        ids = np.array([-1 if d is None else d for d in docs], np.int64)
        none = np.array([d is None for d in docs], np.uint8)
        # Words hold no line feed. Positions are kept as steps, which are small and compress well.
        steps = np.diff(place, prepend=np.int32(0))
        cols = [ids.tobytes() + none.tobytes(), starts.astype(np.int64), n, b"\n".join(known), heads.astype(np.int64), steps]
        arrays = [pa.array([c if isinstance(c, bytes) else c.tobytes()], pa.binary()) for c in cols]
        return pa.record_batch([pa.array([name], pa.int64()), *arrays], ["shard", "docs", "starts", "lengths", "terms", "heads", "positions"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        start_task("decontaminate")
        name = TaskContext.get().partitionId() << 32
        docs, lengths, tokens, held = [], [], [], 0
        known: dict[bytes, int] = defaultdict(count().__next__)
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for doc, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                words = words_of(text.as_py())
                tokens.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
                docs.append(doc)
                lengths.append(len(words))
                held += len(words) + gap
                if held >= SHARD_WORDS:
                    yield shard(name, docs, lengths, tokens, known)
                    name, docs, lengths, tokens, held = name + 1, [], [], [], 0
                    known = defaultdict(count().__next__)
        if docs:
            yield shard(name, docs, lengths, tokens, known)

    return run


def build_index(docs: DataFrame, gap: int) -> DataFrame:
    """The stored index: postings of every word of every document, one row per shard."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return materialise(texts.mapInArrow(_builder(gap), INDEX), "positional-index", per_file=SHARDS_A_FILE)


def windows_of(items: list[tuple[str, list[bytes]]], terms: dict[bytes, int], size: int) -> dict[tuple[int, ...], list[str]]:
    """Distinct windows of term ids, each with the items that have it."""
    found: dict[tuple[int, ...], set[str]] = defaultdict(set)
    for item, words in items:
        ids = [terms[w] for w in words]
        for at in range(max(1, len(ids) - size + 1) if ids else 0):
            found[tuple(ids[at : at + size])].add(item)
    return {w: sorted(i) for w, i in found.items()}


def _near(post: np.ndarray, want: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """Which wanted places have a posting within ``slop``, and which have one exactly."""
    at = np.searchsorted(post, want - slop)
    inside = np.minimum(at, len(post) - 1)
    near = (at < len(post)) & (post[inside] <= want + slop)
    if not slop:
        return near, near
    exact = np.minimum(np.searchsorted(post, want), len(post) - 1)
    return near, post[exact] == want


def _searcher(terms: dict[bytes, int], windows: dict[tuple[int, ...], list[str]], slop: int):
    keys, items = list(windows), list(windows.values())
    longest = max(map(len, keys), default=1)
    grid = np.full((len(keys), longest), -1, np.int32)
    for row, key in zip(grid, keys, strict=True):
        row[: len(key)] = key
    most = int(grid.max(initial=-1)) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                starts, n = np.frombuffer(row["starts"], np.int64), np.frombuffer(row["lengths"], np.int64)
                words = row["terms"].split(b"\n")
                known = np.fromiter((terms.get(w, -1) for w in words), np.int32, len(words))
                heads = np.frombuffer(row["heads"], np.int64)
                own = np.flatnonzero(known >= 0)
                if not len(own):
                    continue
                place = np.cumsum(np.frombuffer(row["positions"], np.int32), dtype=np.int32)
                ends = np.append(heads[1:], len(place))
                known, heads, ends = known[own], heads[own], ends[own]
                held = np.zeros(most + 1, np.int64)
                held[known] = ends - heads
                lists = dict(zip(known.tolist(), zip(heads.tolist(), ends.tolist(), strict=True), strict=True))
                df = np.where(grid >= 0, held[grid], 1)
                cover: dict[int, list[np.ndarray]] = defaultdict(list)
                hit: dict[int, set[str]] = defaultdict(set)
                close: dict[int, set[str]] = defaultdict(set)
                for w in np.flatnonzero(df.min(axis=1) > 0).tolist():
                    key = keys[w]
                    order = sorted(range(len(key)), key=lambda i: df[w, i])
                    a, b = lists[key[order[0]]]
                    begin = place[a:b] - order[0]
                    exact = np.ones(len(begin), bool)
                    if slop:
                        # Any alignment counts that leaves this term, too, within slop of its place.
                        begin = np.unique((begin[:, None] + np.arange(-slop, slop + 1)).ravel())
                        exact = np.isin(begin, place[a:b] - order[0])
                    for i in order[1:]:
                        a, b = lists[key[i]]
                        near, same = _near(place[a:b], begin + i, slop)
                        begin, exact = begin[near], (exact & same)[near]
                        if not len(begin):
                            break
                    if not len(begin):
                        continue
                    # A near match may lean over its document's start by slop; the gap between documents is wider.
                    doc = np.searchsorted(starts, begin + slop, "right") - 1
                    for d, at, whole in zip(doc.tolist(), (begin - starts[doc]).tolist(), exact.tolist(), strict=True):
                        if whole:
                            cover[d].append(np.arange(at, at + len(key), dtype=np.int32))
                            hit[d].update(items[w])
                        else:
                            close[d].update(items[w])
                found = sorted(set(hit) | set(close))
                places = [np.unique(np.concatenate(cover[d])) if d in cover else np.zeros(0, np.int32) for d in found]
                yield pa.record_batch(
                    [
                        pa.array([row["shard"]] * len(found), pa.int64()),
                        pa.array(found, pa.int32()),
                        pa.array(places, pa.list_(pa.int32())),
                        pa.array([sorted(hit[d]) for d in found], pa.list_(pa.string())),
                        pa.array([sorted(close[d] - hit[d]) for d in found], pa.list_(pa.string())),
                    ],
                    ["shard", "ord", "places", "items", "near_items"],
                )

    return run


HITS = "shard long, ord int, places array<int>, items array<string>, near_items array<string>"


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            n = np.frombuffer(row["lengths"], np.int64)
            ids = np.frombuffer(row["docs"][: 8 * len(n)], np.int64)
            none = np.frombuffer(row["docs"][8 * len(n) :], np.uint8).astype(bool)
            yield pa.record_batch(
                [
                    pa.array([row["shard"]] * len(n), pa.int64()),
                    pa.array(np.arange(len(n), dtype=np.int32)),
                    pa.array(ids, mask=none),
                    pa.array(n),
                ],
                ["shard", "ord", "doc_id", "n_words"],
            )


def find_leaks(docs: DataFrame, bench: DataFrame, window: int = WINDOW, slop: int = 0, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document row: doc_id, n_words, places (hit word positions), items, near_items."""
    items = bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").cast("string"))
    items = items.filter(F.length("text") > 0)
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (6 * block_words)))
    gap, hits = window + slop + 1, None
    index = build_index(docs, gap)
    for b in range(blocks):
        # Each block holds about block_words words, however large the benchmark is; its hits are written before the next.
        own = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).collect()
        own = [(r["item"], words_of(r["text"].encode())) for r in own]
        terms = {w: k for k, w in enumerate(dict.fromkeys(w for _, ws in own for w in ws))}
        found = index.select("shard", "starts", "lengths", "terms", "heads", "positions")
        found = found.mapInArrow(_searcher(terms, windows_of(own, terms, window), slop), HITS)
        found = materialise(found, "index-hits", rows=SHARDS_A_BATCH)
        hits = found if hits is None else hits.unionByName(found)
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    hits = hits.groupBy("shard", "ord").agg(flat("places"), flat("items"), flat("near_items"))
    rows = index.select("shard", "docs", "lengths").mapInArrow(_documents, "shard long, ord int, doc_id long, n_words long")
    none = lambda c, kind: F.coalesce(F.col(c), F.array().cast(f"array<{kind}>")).alias(c)
    return rows.join(hits, ["shard", "ord"], "left").select(
        "doc_id", "n_words", none("places", "int"), none("items", "string"),
        F.array_except(none("near_items", "string"), none("items", "string")).alias("near_items"),
    )


def leak_report(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    return find_leaks(docs, bench, window).select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("places") > 0).alias("contaminated"),
    )


def proximity_report(docs: DataFrame, bench: DataFrame, window: int = WINDOW, slop: int = 2) -> DataFrame:
    """One row per document row: doc_id, and the items that occur exactly, or only with words up to ``slop`` off their places."""
    return find_leaks(docs, bench, window, slop).select(
        "doc_id", F.array_join("items", ",").alias("exact_items"), F.array_join("near_items", ",").alias("near_items")
    )


def drop_leaks(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without any occurring window, with all their columns; rows that share an id share their fate."""
    leak = free_name(docs, "__leak")
    found = find_leaks(docs, bench, window).filter(F.size("places") > 0).select(F.col("doc_id").alias(leak)).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(F.col(leak)), "left_anti")
