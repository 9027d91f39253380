"""The grouped prefix join against all pairs."""

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import common, jaccard_join as jj

DOC = "doc_id long, text string, n long, cls long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in rows], DOC)


def words_set(text):
    w = (text or "").encode().lower().split()
    if not w:
        return set()
    return {tuple(w)} if len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def brute(rows):
    sets = [words_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(k) and rows[j][0] is not None]
        out.append((i, len(sets[k]), (min(ids) if ids else None) if sets[k] else i))
    return out


def corpus(seed):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    passage = " ".join(rng.choice(vocabulary, 40))
    rows = []
    for k in range(25):
        base = list(rng.choice(vocabulary, int(rng.integers(1, 90))))
        if k % 3 == 0:
            base += passage.split()
        for c in range(int(rng.integers(1, 7))):
            text = list(base)
            for _ in range(c if k % 2 else 1):
                text[int(rng.integers(len(text)))] = "x" + str(rng.integers(1000))
            rows.append((1000 - len(rows), " ".join(text)))
    rows += [(2000 + k, f"{passage} tail{k} of its own{k} and more{k}") for k in range(30)]
    return rows


@pytest.mark.parametrize("seed,batch", [(0, 10_000), (1, 7), (2, 3)])
def test_components_match_all_pairs(spark, seed, batch):
    rows = corpus(seed) + [(None, None), (1, ""), (2, " \t "), (3, "One two"), (4, "one  TWO"), (None, "one two"), (5, "only one null set here ok"), (3, "One two")]
    rows += [(6, "long " * 30_000), (7, "long " * 30_001), (None, "null ids alone are a component"), (None, "null ids alone are a component")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = jj.jaccard_components(docs(spark, rows).repartition(3)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)


def test_empty(spark):
    assert jj.jaccard_components(docs(spark, [])).count() == 0


def test_keep_one(spark):
    text = "a b c d e f g h i j"
    rows = [(4, text), (2, text), (9, "k l m n o p"), (None, None), (7, None)]
    kept = jj.keep_one(docs(spark, rows))
    assert kept.columns == ["doc_id", "text", "n", "cls"]
    assert {r.doc_id for r in kept.collect()} == {2, 9, None, 7}


def test_prefix_filter_never_loses_a_pair():
    for n in range(1, 200):
        least = -(-3 * n // 4)
        assert jj.prefix_length(n) == n - least + 1


def shared(rows, size):
    parts = [rows[k : k + size] for k in range(0, len(rows), size)]
    batches = (pa.record_batch([pa.array(c, pa.int64()) for c in zip(*p, strict=True)], ["k", "v", "m"]) for p in parts)
    return sorted(tuple(r[:3]) for b in jj._shared(batches) for r in zip(*(c.to_pylist() for c in b.columns), strict=True))


def test_shared_runs_across_batches():
    # (shingle, group, position << 32 | size), sorted by shingle, position and group.
    rows = [(1, 5, 10), (1, 5, 10), (1, 6, 10), (2, 7, 3), (3, 2, 9), (3, 1, 1 << 32 | 9), (3, 4, 1 << 32 | 9)]
    rows += [(4, v, 20) for v in range(jj.FEW)] + [(5, v, 2 << 32 | 20) for v in range(jj.FEW + 1)] + [(6, v, 20) for v in range(3 * jj.FEW)] + [(7, 1, 5)]
    want = sorted(
        [(5, 6, jj.STAR), (2, 1, jj.STAR), (2, 4, jj.STAR), (1, 4, jj.PAIR)]
        + [(a, b, jj.STAR if a == 0 else jj.PAIR) for a in range(jj.FEW) for b in range(a + 1, jj.FEW)]
        + [(5, v, 2 << 32 | 20) for v in range(jj.FEW + 1)] + [(0, v, jj.STAR) for v in range(1, jj.FEW + 1)]
        + [(6, v, 20) for v in range(3 * jj.FEW)] + [(0, v, jj.STAR) for v in range(1, 3 * jj.FEW)]
    )
    assert shared(rows, 1_000) == want
    assert all(shared(rows, size) == want for size in range(1, 40))


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 200), (200, 150), (7, 7)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert {got[k] for k in range(41)} == {0} and got[150] == got[200] == 100


def test_shared_keeps_heavy_entries_and_members():
    rows = [(4, 9, jj.HEAVY_MARK + (2 << 32) + 7), (8, -5, -1 - 77)]
    batch = pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["k", "v", "m"])
    got = [r for b in jj._shared(iter([batch])) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    cls = (-5).to_bytes(8, "big", signed=True) + (77).to_bytes(8, "big")
    assert sorted(got, key=str) == sorted([(4, 9, (2 << 32) + 7, None), (4, 9, jj.SPREAD - (2 << 32) - 7, None), (8, 0, -1, cls)], key=str)


def test_class_has_126_bits():
    s = jj.shingles(b"a b c d e f g")
    assert jj.class_of(s) == jj.class_of(jj.shingles(b"A b c  d e f g")) != jj.class_of(s[1:])
    assert len(jj.class_of(s)) == 16 and jj.class_of(s)[8] < 64


def test_similar_is_exact():
    rng = np.random.default_rng(3)
    for _ in range(300):
        base = [f"w{k}" for k in rng.integers(0, int(rng.integers(2, 3000)), int(rng.integers(0, 60)))]
        other = list(base)
        for _ in range(int(rng.integers(0, 4))):
            if other:
                other[int(rng.integers(len(other)))] = "new"
        a, b = " ".join(base), " ".join(other)
        x, y = words_set(a), words_set(b)
        assert jj.similar(a.encode(), b.encode()) == bool(x and y and 100 * len(x & y) >= 75 * len(x | y))


def test_sketches_bound_the_overlap():
    rng = np.random.default_rng(5)
    sets = []
    for n in (1, 5, 100, 127, 128, 129, 700, 5_000):
        s = np.unique(rng.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64))
        sets += [s, s[: max(1, len(s) * 4 // 5)], np.unique(rng.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64))]
    same_bucket = np.arange(900, dtype=np.uint64) << np.uint64(20)
    sets += [same_bucket, same_bucket[:800]]
    n = np.array([len(s) for s in sets])
    own = jj.Sketches([jj.sketch(s) for s in sets], n)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    got = own.may_be_similar(i, own, j)
    both = np.array([len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)])
    true = 4 * both >= 3 * (n[i] + n[j] - both)
    assert not (true & ~got).any()
    assert not got[(both == 0) & (n[i] == n[j]) & (n[i] >= 700)].any()


def test_blocks_meet_exactly_once(spark, monkeypatch):
    monkeypatch.setattr(jj, "BLOCK", 5)
    rows = [(1, 100 if k < 23 else k, k) for k in range(40)] + [(2, k % 2, k) for k in range(4)] + [(3, 7, k) for k in range(30)]
    frame = spark.createDataFrame([(k, c, c.to_bytes(2, "big") + x.to_bytes(2, "big"), 10, 0) for k, c, x in rows], "k long, component long, cls binary, n long, p long")
    dealt = jj.dealt_blocks(frame).collect()
    met = {}
    for a in dealt:
        for b in dealt:
            if a.u == b.u and bytes(a.cls) < bytes(b.cls) and a.component != b.component and (a.side == 2 or a.side != b.side):
                key = (a.k, bytes(a.cls), bytes(b.cls))
                met[key] = met.get(key, 0) + 1
    want = {(x.k, bytes(x.cls), bytes(y.cls)) for x in frame.collect() for y in frame.collect() if x.k == y.k and bytes(x.cls) < bytes(y.cls) and x.component != y.component}
    assert set(met) == want and set(met.values()) == {1}
    assert len({(r.u, r.deal) for r in dealt}) == len({r.u for r in dealt})
    per = {}
    for r in dealt:
        per[r.u] = per.get(r.u, 0) + 1
    assert max(per.values()) <= 25  # hashing makes blocks of about 5 rows


def test_many_documents_of_one_shingle_in_different_components(spark, monkeypatch):
    """All share their first shingle's list, which is cut into blocks; some few are near copies."""
    monkeypatch.setattr(jj, "BLOCK", 64)
    monkeypatch.setattr(jj, "HEAVY", 50)
    monkeypatch.setattr(jj, "PRODUCT", 1)
    shared = " ".join(f"s{k}" for k in range(24))
    rows = [(k, f"{shared} a{k} b{k} c{k} d{k} e{k} f{k} g{k} h{k} i{k} j{k} k{k} l{k}") for k in range(1_000)]
    rows += [(2_000 + k, rows[3 * k][1] + " more") for k in range(40)]
    got = {r.doc_id: r.component_id for r in jj.jaccard_components(docs(spark, rows)).collect()}
    want = {i: i for i, _ in rows} | {2_000 + k: 3 * k for k in range(40)}
    assert got == want


def test_clashing_columns(spark):
    frame = spark.createDataFrame([(1, "a b c d e f", 1, 2, "x"), (2, "a b c d e f", 3, 4, "y")], "doc_id long, text string, stay long, stay_ long, cls string")
    assert [r.stay for r in jj.keep_one(frame).collect()] == [1]
