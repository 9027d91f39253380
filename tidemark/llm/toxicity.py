"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

A bounded, documented sample of labelled rows (``max_examples``) gives the
examples. Features are whole words and character 5-grams of words. In texts of many
rare words a cosine over all of them says little about a label (README), so the
space is that of the features tied to the label, either way: those that a
chi-square test on the examples finds at a false-discovery rate of ``FDR`` and
whose presence at least doubles or halves the share of toxic examples (``EFFECT``).
The rule has no fixed number of features, examples or occurrences in it.
Weights are (1 + ln tf) idf with document frequencies counted over the whole
corpus. The examples form a block-max inverted index: postings in blocks of
examples, each with its largest weight per feature, so that blocks whose bound
cannot reach the k-th best cosine are skipped and the answer stays exact. The
k nearest examples vote with weight 1 - distance; a monotone map fitted on the
examples themselves (each judged without itself) turns votes into probabilities.
Index, features and map come from the bounded sample, so only bounded objects are broadcast.

Defined cases: null and empty texts, and texts without kept features, get the
rate of such examples; a null id is judged like any other; repeated rows are
judged one by one; contradicting labels of one id count as toxic if any is; with
no labelled rows every score is 0; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import fold, forget, free_name, materialise, start_task

GRAM = 5
MAX_EXAMPLES = 20_000
FDR = 0.01
EFFECT = 2.0  # in large samples every common word of a topic is significant, but says next to nothing
STEPS = 100, 10_000  # steps of one unit of chi-square, and in all, for the false-discovery rate
K = 15
BLOCK = 64


def grams(word: str) -> set[str]:
    """The word itself and its character 5-grams, word boundaries marked."""
    padded = f"^{word}$"
    return {padded[i : i + GRAM] for i in range(max(1, len(padded) - GRAM + 1))} | {padded}


def tokens(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct lower-cased words (runs of letters), each token's word and its row."""
    letters = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\pL]+", " ")
    split = pc.ascii_split_whitespace(letters)
    bounds = split.offsets.to_numpy()
    coded = split.flatten().dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), np.repeat(np.arange(len(texts)), np.diff(bounds))


def feature_counts(names: list[str], to: tuple[str, str] = ("f", "n")):
    """Rows to rows without their last column, the text, but with its kept features: ids and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_task("toxicity")
        ids = {n: i for i, n in enumerate(names)}
        get, known = ids.get, {}

        def of(word: str) -> tuple[int, ...]:
            if word not in known:
                if len(known) > 200_000:
                    known.clear()
                padded = f"^{word}$"
                found = {get(padded), *[get(padded[i : i + GRAM]) for i in range(len(padded) - GRAM + 1)]} - {None}
                known[word] = tuple(found)
            return known[word]

        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                words, index, row = tokens(part.column(part.num_columns - 1))
                kept = [of(w) if w else () for w in words]
                many = np.fromiter(map(len, kept), np.int64, len(kept))
                flat = np.array([f for k in kept for f in k], np.int64)
                start = np.cumsum(many) - many
                own = many[index] > 0
                index, row = index[own], row[own]
                n = many[index]
                at_flat = np.repeat(start[index] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                key, count = np.unique(np.repeat(row, n) * len(names) + flat[at_flat], return_counts=True)
                bounds = np.searchsorted(key, np.arange(part.num_rows + 1) * len(names)).astype(np.int32)
                lists = [
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array(x.astype(np.int32))) for x in (key % max(1, len(names)), count)
                ]
                yield pa.record_batch([*part.columns[:-1], *lists], [*part.schema.names[:-1], *to])

    return run


class BlockMaxIndex:
    """Postings of the examples' distinct vectors in blocks, with the largest weight of each feature and block."""

    def __init__(self, vectors: list[dict[int, float]], tags: list[int], labels: list[int], n_features: int):
        """``vectors`` have unit length; empty ones are never neighbours."""
        groups: dict[tuple, list[int]] = {}
        for i, v in enumerate(vectors):
            if v:
                groups.setdefault(tuple(sorted(v.items())), []).append(i)
        # Vectors with the same leading feature share blocks, which keeps the bounds tight.
        order = sorted(groups, key=lambda g: (max(g, key=lambda x: (x[1], x[0]))[0], g))
        self.tags = [min(tags[i] for i in groups[g]) for g in order]
        self.size = np.array([len(groups[g]) for g in order], float)
        self.toxic = np.array([sum(labels[i] for i in groups[g]) for g in order], float)
        self.place = {i: p for p, g in enumerate(order) for i in groups[g]}
        self.blocks = max(1, -(-len(order) // BLOCK))
        flat = [(f, p, w) for p, g in enumerate(order) for f, w in g]
        flat.sort(key=lambda x: x[:2])
        feature = np.array([x[0] for x in flat], np.int64)
        self.where = np.array([x[1] for x in flat], np.int64)
        self.weight = np.array([x[2] for x in flat], float)
        block = self.where // BLOCK
        self.heads = np.searchsorted(feature * self.blocks + block, np.arange(n_features * self.blocks + 1))
        self.bound = np.zeros((n_features, self.blocks))
        np.maximum.at(self.bound, (feature, block), self.weight)

    def search(self, query: dict[int, float], k: int = K) -> tuple[np.ndarray, np.ndarray]:
        """The k best (position, cosine) with a cosine over 0; ties by position."""
        if not query or not len(self.size):
            return np.zeros(0, np.int64), np.zeros(0)
        own, weights = np.fromiter(query, np.int64, len(query)), np.fromiter(query.values(), float, len(query))
        bounds = weights @ self.bound[own]
        order = np.lexsort((np.arange(self.blocks), -bounds))
        found_at, found, least = np.zeros(0, np.int64), np.zeros(0), 0.0
        for b in order.tolist():
            if bounds[b] <= 0 or len(found) == k and bounds[b] < least - 1e-12:
                break
            lo, hi = self.heads[own * self.blocks + b], self.heads[own * self.blocks + b + 1]
            n = hi - lo
            at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            sums = np.bincount(self.where[at] - b * BLOCK, self.weight[at] * np.repeat(weights, n), BLOCK)
            hit = np.flatnonzero(sums > 0)
            found_at, found = np.concatenate([found_at, hit + b * BLOCK]), np.concatenate([found, sums[hit]])
            if len(found) > k:
                best = np.lexsort((found_at, -found))[:k]
                found_at, found = found_at[best], found[best]
            least = found.min() if len(found) else 0.0
        best = np.lexsort((found_at, -found))
        return found_at[best], found[best]

    def vote(self, at: np.ndarray, cosine: np.ndarray, without: tuple[int, int] | None = None, k: int = K) -> float | None:
        """Mean over the k nearest examples of 1 - distance where toxic, of 0 where not or not there.

        Examples with equal vectors share their places. ``without``: (position, label)
        of an example that is not to count.
        """
        size, toxic = self.size[at].copy(), self.toxic[at].copy()
        if without:
            own = at == without[0]
            size[own] -= 1
            toxic[own] -= without[1]
        take = np.clip(k - (np.cumsum(size) - size), 0, size)
        if not take.sum():
            return None
        return float((take * np.minimum(cosine, 1.0) * toxic / np.maximum(size, 1)).sum() / k)


def monotone(votes: list[float], labels: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling adjacent violators, smoothed by one doubtful case a pool."""
    pools: list[list[float]] = []
    rate = sum(labels) / max(1, len(labels))
    for v, y in sorted(zip(votes, labels, strict=True)):
        if pools and pools[-1][3] == v:
            pools[-1][0] += y
            pools[-1][1] += 1
        else:
            pools.append([y, 1, v, v])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            y2, n2, _, hi = pools.pop()
            pools[-1][0] += y2
            pools[-1][1] += n2
            pools[-1][3] = hi
    return np.array([p[2] for p in pools]), np.array([(p[0] + rate) / (p[1] + 1) for p in pools])


class Model:
    """Kept features with their idf, the index, and the map from votes to probabilities."""

    def __init__(self, names: list[str], idf: np.ndarray):
        self.names, self.idf = names, idf
        self.index: BlockMaxIndex | None = None
        self.steps = self.levels = np.zeros(0)
        self.blank = 0.0
        self.memory: dict[tuple, tuple[float, list[dict]]] = {}

    def vector(self, f: list[int], n: list[int]) -> dict[int, float]:
        v = {i: (1 + math.log(c)) * self.idf[i] for i, c in zip(f, n, strict=True)}
        norm = math.sqrt(sum(w * w for w in v.values()))
        return {i: w / norm for i, w in v.items()} if norm > 0 else {}

    def score(self, f: list[int], n: list[int]) -> tuple[float, list[dict]]:
        key = (*f, *n)
        if key not in self.memory:
            if len(self.memory) > 100_000:
                self.memory.clear()
            self.memory[key] = self._score(self.vector(f, n))
        return self.memory[key]

    def _score(self, query: dict[int, float]) -> tuple[float, list[dict]]:
        at, cosine = self.index.search(query) if self.index else (np.zeros(0, int), np.zeros(0))
        if not len(at):
            return self.blank, []
        vote = self.index.vote(at, cosine)
        level = self.levels[max(0, np.searchsorted(self.steps, vote, "right") - 1)] if len(self.steps) else vote
        rows = [
            {"doc_id": self.index.tags[p], "examples": int(self.index.size[p]), "toxic": int(self.index.toxic[p]), "cosine": c}
            for p, c in zip(at[:3].tolist(), cosine[:3].tolist(), strict=True)
        ]
        return float(level), rows


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, set[str]] = {}
    n, toxic = Counter(), Counter()
    for batch in batches:
        for at in range(0, batch.num_rows, 2_000):
            part = batch.slice(at, 2_000)
            words, index, row = tokens(part.column(0))
            labels = part.column(1).to_pylist()
            pair = np.unique(row * (len(words) + 1) + index)
            bounds = np.searchsorted(pair, np.arange(part.num_rows + 1) * (len(words) + 1))
            own_words = (pair % (len(words) + 1)).tolist()
            for k, label in enumerate(labels):
                own: set[str] = set()
                for w in own_words[bounds[k] : bounds[k + 1]]:
                    word = words[w]
                    if word and word not in known:
                        if len(known) > 200_000:
                            known.clear()
                        known[word] = grams(word)
                    own |= known[word] if word else set()
                n.update(own)
                if label:
                    toxic.update(own)
    names = list(n)
    yield pa.record_batch(
        [pa.array(names, pa.string()), pa.array([n[x] for x in names], pa.int64()), pa.array([toxic[x] for x in names], pa.int64())],
        ["gram", "n", "toxic"],
    )


def least_chi2(steps: dict[int, int], m: int, fdr: float = FDR) -> float:
    """Benjamini and Hochberg's bound: the least chi-square with p <= fdr * (features of at least that) / m.

    ``steps``: features by whole steps of chi-square, each taken at its lower end.
    """
    above, least = 0, math.inf
    for step in sorted(steps, reverse=True):
        above += steps[step]
        chi2 = step / STEPS[0]
        if math.erfc(math.sqrt(chi2 / 2)) <= fdr * above / max(1, m):
            least = chi2
    return least


def train(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES, whole: bool = False) -> tuple[Model, DataFrame, tuple[str, str]]:
    """Learn from ``labels`` (doc_id, toxic); ``max_examples`` bounds the labelled rows that are used.

    Returns the model, and every document row's doc_id (``whole``: all its columns) and kept
    features, whose columns' names come last; one pass over the corpus gives them for
    document frequencies and scores alike.
    """
    marks = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    marks = marks.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    total = marks.count()
    # A hash threshold picks about max_examples rows, spread over the whole table.
    if total > max_examples:
        marks = marks.filter(F.xxhash64("id") < (1 << 64) * max_examples // total - (1 << 63))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    sample = texts.join(F.broadcast(marks), texts["doc_id"] == marks["id"])
    # Copies of one text would vote many times for its chance words.
    sample = sample.groupBy(F.md5(F.coalesce("text", F.lit(""))).alias("h")).agg(
        F.first("text").alias("text"), F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id")
    )
    sample = materialise(sample.select("doc_id", "text", "toxic"), "examples")
    n, pos = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    counts = sample.select("text", "toxic").mapInArrow(_gram_counts, "gram string, n long, toxic long")
    counts = counts.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    a, b = F.col("toxic").cast("double"), (F.col("n") - F.col("toxic")).cast("double")
    c, d = F.lit(float(pos)) - a, F.lit(float(n - pos)) - b
    below = (a + b) * (c + d) * (a + c) * (b + d)
    # Yates's correction, for small counts.
    off = F.greatest(F.abs(a * d - b * c) - n / 2, F.lit(0.0))
    counts = materialise(counts.withColumn("chi2", F.when(below > 0, float(n) * off * off / below).otherwise(0.0)), "feature-counts")
    # Toxic examples with the feature, against as many as its examples would have at the rate of all.
    even = float(pos) / max(1, n) * F.col("n")
    strong, weak = F.col("toxic") >= EFFECT * even, F.col("toxic") * EFFECT <= even
    step = F.least(F.floor(F.col("chi2") * STEPS[0]), F.lit(STEPS[0] * STEPS[1]))
    # Not more rows than there are steps.
    steps = {r["step"]: r["count"] for r in counts.groupBy(step.alias("step")).count().collect()}
    least = least_chi2(steps, sum(steps.values()))
    names = [r["gram"] for r in counts.filter((F.col("chi2") >= least) & (strong | weak)).orderBy("gram").collect()] if least < math.inf else []
    forget(counts)
    f, m = (free_name(docs, c) for c in ("f", "n")) if whole else ("f", "n")
    own = docs.select("*", F.col("text").cast("string").alias(free_name(docs, "own"))) if whole else texts
    kept = [*(docs.schema.fields if whole else texts.schema.fields[:1]), *(T.StructField(c, T.ArrayType(T.IntegerType())) for c in (f, m))]
    rows = materialise(own.mapInArrow(feature_counts(names, (f, m)), T.StructType(kept)), "features")
    df = {r["f"]: r["count"] for r in rows.select(F.explode(f).alias("f")).groupBy("f").count().collect()}
    total_docs = max(1, rows.count())
    model = Model(names, np.array([math.log((1 + total_docs) / (1 + df.get(i, 0))) for i in range(len(names))]))
    # At most max_examples short vectors: a documented bound.
    examples = sample.select("doc_id", "toxic", "text").mapInArrow(feature_counts(names), "doc_id long, toxic int, f array<int>, n array<int>").collect()
    examples.sort(key=lambda r: r["doc_id"])
    sparse = [model.vector(r["f"], r["n"]) for r in examples]
    truth = [r["toxic"] for r in examples]
    model.index = index = BlockMaxIndex(sparse, [r["doc_id"] for r in examples], truth, len(names))
    blank = [y for y, v in zip(truth, sparse, strict=True) if not v]
    model.blank = sum(blank) / (len(blank) + 1)
    near: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    votes, seen = [], []
    for i, p in index.place.items():
        if p not in near:
            near[p] = index.search(sparse[i], K + 1)
        vote = index.vote(*near[p], without=(p, truth[i]))
        if vote is not None:
            votes.append(vote)
            seen.append(truth[i])
    model.steps, model.levels = monotone(votes, seen)
    return model, rows, (f, m)


EVIDENCE = "array<struct<doc_id:long,examples:int,toxic:int,cosine:double>>"


def _scorer(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("examples", pa.int32()), ("toxic", pa.int32()), ("cosine", pa.float64())]))
        for batch in batches:
            got = [model.score(f, n) for f, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.record_batch(
                [batch.column(0), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], kind)],
                ["doc_id", "score", "evidence"],
            )

    return run


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document row: doc_id, score, evidence (the three nearest groups of examples)."""
    model, rows, _ = train(docs, labels)
    return rows.mapInArrow(_scorer(model), f"doc_id long, score double, evidence {EVIDENCE}")


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns; each row is judged by itself."""
    model, rows, (f, m) = train(docs, labels, whole=True)
    names, width = rows.columns, len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = zip(batch.column(names.index(f)).to_pylist(), batch.column(names.index(m)).to_pylist(), strict=True)
            clean = [model.score(x, y)[0] < threshold for x, y in own]
            yield batch.select(names[:width]).filter(pa.array(clean, pa.bool_()))

    return rows.mapInArrow(run, docs.schema)


def train_folds(labels: DataFrame) -> DataFrame:
    """The labelled rows that may be learned from: crc32 of the id modulo 3 is not 1."""
    return labels.filter(fold("doc_id", 3) != 1)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs, train_folds(labels))
    return scored.select(
        "doc_id",
        (fold("doc_id", 3) == 1).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).cast("int").alias("predicted"),
        F.to_json("evidence").alias("evidence"),
    )
