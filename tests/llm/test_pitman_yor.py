"""Language-model scores: contract columns by brute force, a proper distribution, and held-out gain."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import pitman_yor as py

DOC = "doc_id long, text string, held boolean, score double"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, 0.0) for i, t in rows], DOC)


def corpus():
    rng = np.random.default_rng(0)
    german, english = [f"de{k}" for k in range(60)], [f"en{k}" for k in range(60)]
    rows = []
    for k in range(300):
        own = german if k % 2 else english
        rows.append((k, " ".join(rng.choice(["der" if k % 2 else "the", *own], 40, p=[0.4] + [0.01] * 60))))
    return rows + [(1000, None), (1001, ""), (None, "The the"), (5, rows[5][1]), (1002, " a\x0bB\x1c a\xa0c  "), (1003, "de1 " * 30_000)]


def brute(rows):
    words = [(t or "").encode().lower().split() + [None] for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    c = Counter(w for ws, h in zip(words, held, strict=True) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    for (i, _), ws, h in zip(rows, words, held, strict=True):
        yield i, h, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)


@pytest.mark.parametrize("chunk", [24 << 20, 3_000])
def test_contract_columns_and_gain(spark, chunk, monkeypatch):
    monkeypatch.setattr(py, "CHUNK_BYTES", chunk)
    rows = corpus()
    got = py.score_documents(docs(spark, rows).coalesce(1)).toPandas()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    have = [
        (None if r.doc_id != r.doc_id else int(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))
        for r in got.itertuples()
    ]
    assert sorted(have, key=key) == sorted(brute(rows), key=key)
    assert (got.score <= 1e-9).all() and np.isfinite(got.score).all()
    own = got[got.held_out & (got.doc_id < 300)]
    assert own.score.sum() > own.base_score.sum()
    assert np.allclose(got.perplexity, 10 ** (-got.score / got.n_tokens))


def test_no_training_rows(spark):
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2)
    got = py.score_documents(docs(spark, [(held, "a b")])).first()
    assert got.train_tokens == 0 and got.n_known == 0 and got.score == 0
    assert py.score_documents(docs(spark, [])).count() == 0


def test_reseat_seats_everyone():
    rng = np.random.default_rng(1)
    c = rng.integers(1, 500, 300)
    none = np.zeros(0, np.int64)
    size, owner = py.reseat(c, none, none, np.full(300, 3.0), rng)
    assert (np.bincount(owner, size, 300) == c).all() and size.min() > 0
    kept = rng.binomial(size, 0.5)
    size, owner = py.reseat(c, kept[kept > 0], owner[kept > 0], np.full(300, 3.0), rng)
    assert (np.bincount(owner, size, 300) == c).all()


def test_table_counts_follow_the_restaurant():
    """The mean number of tables of small cells matches the exact sequential seating."""
    rng = np.random.default_rng(2)
    n, a = 4_000, 2.0
    _, owner = py.reseat(np.full(n, 3), np.zeros(0, np.int64), np.zeros(0, np.int64), np.full(n, a), rng)
    p2 = a / (a + 1 - py.DISCOUNT)
    want = 1 + p2 + p2 * a / (a + 2 - 2 * py.DISCOUNT) + (1 - p2) * a / (a + 2 - py.DISCOUNT)
    assert abs(len(owner) / n - want) < 0.05


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(3)
    words = 50
    rows = []
    for w in range(words):
        ctx = np.sort(rng.choice(py.LEAVES, 5, replace=False)).astype(np.uint8)
        rows.append((f"w{w:03d}", 0, ctx.tobytes(), rng.integers(0, 9, 5).astype(np.int32).tobytes()))
    rows.append(("zz", 0, np.arange(py.LEAVES, dtype=np.uint8).tobytes(), np.zeros(py.LEAVES, np.int32).tobytes()))
    totals = np.zeros(py.LEAVES)
    for _, _, ctx, cnt in rows:
        np.add.at(totals, np.frombuffer(ctx, np.uint8), np.frombuffer(cnt, np.int32))
    batch = pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.string(), pa.int64(), pa.binary(), pa.binary()], strict=True)], ["word", "ref", "ctx", "cnt"])
    everything = [(r[0], 0, np.arange(py.LEAVES, dtype=np.uint8).tobytes(), np.zeros(py.LEAVES, np.int32).tobytes()) for r in rows]
    ask = pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*everything, strict=True), batch.schema, strict=True)], batch.schema.names)
    both = pa.Table.from_batches([batch, ask]).sort_by("word").combine_chunks().to_batches()[0]

    class Task:
        @staticmethod
        def get():
            return Task

        @staticmethod
        def partitionId():
            return 0

    import pyspark

    real, pyspark.TaskContext = pyspark.TaskContext, Task
    try:
        out = list(py._seater(totals, words)(iter([both])))
    finally:
        pyspark.TaskContext = real
    sums = np.array(out[0].column(9)[0].as_py())
    seats = pa.Table.from_batches(out[1:]).drop_columns(["sums"]).combine_chunks().to_batches()[0]
    answers = pa.Table.from_batches(list(py._predictor(totals, sums)(iter([seats]))))
    full = []
    for row in answers.to_pylist():
        c, sizes = np.frombuffer(row["counts"], np.int64), np.frombuffer(row["sizes"], np.uint8).astype(int)
        parts = np.split(np.frombuffer(row["logs"], np.float32), np.cumsum(sizes)[:-1])
        full += [(x, p) for x, p in zip(c, parts, strict=True) if len(p) == py.LEAVES]
    # The word without training tokens asks twice for everything.
    full = [x for k, x in enumerate(full) if x[0] > 0 or all(y[0] > 0 for y in full[:k])]
    known = sum(10 ** p.astype(float) for c, p in full if c > 0)
    # Words never seen share one symbol: its probability counts once.
    unseen = next(10 ** p.astype(float) for c, p in full if c == 0)
    missing = sum(c == 0 for c, p in full)
    assert missing >= 1 and np.allclose((known + unseen)[totals > 0], 1, atol=1e-4)


def test_every_previous_word_is_a_context(spark):
    """Rare words that foretell the next one: no list of frequent words holds them."""
    learn = [k for k in range(3_000) if zlib.crc32(str(k).encode()) % 7 != 2][:1_200]
    held = [k for k in range(3_000, 4_000) if zlib.crc32(str(k).encode()) % 7 == 2][:100]
    rng = np.random.default_rng(5)
    pair = lambda k, j: f"x{k} y{j}"
    rows = [(i, " ".join(pair(k, k) for k in rng.integers(0, 200, 20))) for i in learn]
    like, unlike = held[:50], held[50:]
    for a, b in zip(like, unlike, strict=True):
        ks = rng.integers(0, 200, 20)
        rows += [(a, " ".join(pair(k, k) for k in ks)), (b, " ".join(pair(k, (k + 7) % 200) for k in ks))]
    got = {r["doc_id"]: r["score"] for r in py.score_documents(docs(spark, rows)).collect()}
    gain = [(got[a] - got[b]) / 20 for a, b in zip(like, unlike, strict=True)]
    assert min(gain) > 1  # log10 for each pair


@pytest.fixture
def task(monkeypatch):
    import pyspark

    class Task:
        @staticmethod
        def get():
            return Task

        @staticmethod
        def partitionId():
            return 0

    monkeypatch.setattr(pyspark, "TaskContext", Task)


@pytest.mark.parametrize(("hot", "bits"), [([], []), (["the", py.END, "en3"], [3, 1, 8])])
def test_pairs_and_tables_of_all_contexts(task, monkeypatch, hot, bits):
    """Customers equal brute force; a context's tables are its pairs' tables, so its probabilities sum to one."""
    monkeypatch.setattr(py, "CHUNK_BYTES", 4_000)
    rows = [(k, t, k % 7 == 2) for k, (_, t) in enumerate(corpus()[:300])]
    batch = pa.record_batch([pa.array(c) for c in zip(*[(k, h, t) for k, t, h in rows], strict=True)], ["doc_id", "held", "text"])
    stored = [pa.record_batch(b.columns[:5], list("abcde")) for b in py._store(iter([batch])) if not b.column(0).null_count]
    assert len(stored) > 5
    hot_bits = np.array(bits, np.int64)
    asks = pa.Table.from_batches(list(py._asker(hot, hot_bits, 3)(iter(stored))))
    placer = py._placer(py._hashes(pa.array(hot, pa.string())), hot_bits)
    found, tables, hot_sum = {}, {}, Counter()
    vocabulary = sorted({w for _, t, _ in rows for w in t.split()} | {py.END})
    word_of = dict(zip(py._hashes(pa.array(vocabulary)).tolist(), vocabulary, strict=True))
    for bucket in set(asks.column("bucket").to_pylist()):
        own = asks.filter(py.pc.equal(asks.column("bucket"), bucket))
        out = placer(own).to_pylist()
        for ask, row in zip(own.to_pylist(), out, strict=False):
            u, k = ask["units"], ask["pairs"]
            _, before, n, word, _, _ = py._unpacked(ask["asks"], [np.uint32, np.uint64, np.int32, np.uint64, np.int32, np.uint8], [u, u, u, k, k, k])
            _, in_context, c, t = py._unpacked(row["seats"], [np.uint32, np.int64, np.uint32, np.uint32], [u, u, k, k])
            for key, total in zip(before.tolist(), in_context.tolist(), strict=True):
                tables[word_of[key]] = total
            for a, b, x, y in zip(np.repeat(before, n).tolist(), word.tolist(), c.tolist(), t.tolist(), strict=True):
                assert found.setdefault((word_of[a], word_of[b]), (x, y)) == (x, y)
        for row in out[own.num_rows :]:
            hot_sum[hot[row["hot"]]] += row["tables"]
    want = Counter()
    for _, t, h in rows:
        words = [py.END, *t.split(), py.END]
        want.update({p: 0 for p in zip(words, words[1:], strict=False)} if h else Counter(zip(words, words[1:], strict=False)))
    assert {p: c for p, (c, _) in found.items()} == dict(want)
    assert all(py.SAMPLES * min(c, 1) <= t <= py.SAMPLES * c for c, t in found.values())
    sums = Counter()
    for (a, _), (_, t) in found.items():
        sums[a] += t
    assert dict(sums) == {a: hot_sum[a] if a in hot else n for a, n in tables.items()}


def test_slices_of_hot_contexts_change_no_score(spark, monkeypatch):
    """Where no pair occurs twice in training there is nothing to sample, so scores must be the same."""
    rows = [(k, f"a{k} hub b{k} c{k} hub d{k} e{k}") for k in range(200)]
    score = lambda: {r["doc_id"]: r["score"] for r in py.score_documents(docs(spark, rows).coalesce(2)).collect()}
    want = score()
    monkeypatch.setattr(py, "HOT", 20)
    monkeypatch.setattr(py, "BUCKET", 20)
    got = score()
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
