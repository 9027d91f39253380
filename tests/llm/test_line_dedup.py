"""The segment-partition edit join against plain edit distance on all pairs."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import line_dedup as ld

DOC = "doc_id long, text string, line long, drop string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "d") for i, t in rows], DOC)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.text("abé", max_size=12), st.text("abé", max_size=12), st.integers(0, 4))
def test_banded_distance(a, b, k):
    assert ld.within(a, b, k) == (distance(a, b) <= k)


@settings(max_examples=200, deadline=None)
@given(st.text("ab cdé", min_size=20, max_size=40), st.lists(st.tuples(st.integers(0, 60), st.sampled_from(["x", "é", ""]), st.booleans()), max_size=2))
def test_partners_share_a_key(line, edits):
    other = list(line)
    for at, c, insert in edits:
        at %= len(other) + 1
        other[at : at + (0 if insert else 1)] = [c] if c else []
    other = "".join(other)
    keys, lines, sketch = ld.signatures(np.array([1, 2]), [line, other])
    role = sketch & 3
    one = {(k, r) for k, l, r in zip(keys, lines, role, strict=True) if l == 1}
    two = {(k, r) for k, l, r in zip(keys, lines, role, strict=True) if l == 2}
    index = lambda s: {k for k, r in s if r & 1}
    probe = lambda s: {k for k, r in s if r >= 2}
    assert index(one) & probe(two) or index(two) & probe(one)
    assert ld._distance(sketch.view(np.uint64)[:1], sketch.view(np.uint64)[-1:])[0] <= 2 * ld.TAU


def test_keys_tell_texts_apart():
    rng = np.random.default_rng(6)
    lines = ["".join(rng.choice(list("abcdefgh "), 60)) for _ in range(2_000)]
    keys, owners, _ = ld.signatures(np.arange(2_000), lines)
    _, where = np.unique(keys, return_inverse=True)
    first = {}
    assert all(first.setdefault(w, o) == o for w, o in zip(where.tolist(), owners.tolist(), strict=True))


def brute(rows, least=ld.MIN_CHARS):
    uses = sorted({(i is None, i or 0, t, k, line) for i, t in rows if t is not None for k, line in enumerate(t.split("\n")) if len(line) >= least},
                  key=lambda u: (u[0], u[1]))
    names = sorted({u[4] for u in uses})
    parent = {n: n for n in names}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(names)):
        for b in range(a):
            if abs(len(names[a]) - len(names[b])) <= ld.TAU and distance(names[a], names[b]) <= ld.TAU:
                parent[find(names[a])] = find(names[b])
    best = {}
    for none, i, t, k, line in uses:
        c = find(line)
        best[c] = min(best.get(c, (none, i, k, t)), (none, i, k, t))
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, None))
            continue
        keep = [line for k, line in enumerate(t.split("\n")) if len(line) < least or best[find(line)] == (i is None, i or 0, k, t)]
        out.append((i, "\n".join(keep)))
    return out


@pytest.mark.parametrize("batch", [10_000, 5])
def test_against_all_pairs(spark, batch):
    rng = np.random.default_rng(0)
    pool = ["".join(rng.choice(list("abc déé"), int(rng.integers(5, 60)))) for _ in range(25)]
    rows = []
    for k in range(60):
        lines = []
        for _ in range(int(rng.integers(0, 6))):
            line = list(pool[int(rng.integers(len(pool)))])
            for _ in range(int(rng.integers(0, 3))):
                at = int(rng.integers(len(line)))
                line[at : at + int(rng.integers(0, 2))] = ["x"]
            lines.append("".join(line))
        rows.append((k, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (None, pool[0] * 2), (103, "w" * 90_000), (104, "w" * 90_001 + "\nshort"), (3, rows[3][1])]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        out = ld.dedup_lines(docs(spark, rows).repartition(3))
        got = out.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert out.columns == ["doc_id", "text", "line", "drop", "dropped_lines"]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(((r.doc_id, r.text) for r in got), key=key) == sorted(brute([r for r in rows if not (r[1] or "").startswith("w" * 50)]) + [(103, "w" * 90_000), (104, "short")], key=key)


def test_report_and_empty(spark):
    line = "a line that is long enough"
    got = {r.doc_id: r for r in ld.report(docs(spark, [(1, line), (2, line + "\nown"), (3, None)])).collect()}
    assert got[2].n_lines == 2 and got[2].dropped == "0" and got[2].text_sha256 == hashlib.sha256(b"own").hexdigest()
    assert got[1].n_dropped == 0 and got[3].n_lines == 0 and got[3].text_sha256 is None
    assert ld.report(docs(spark, [])).count() == 0


def test_short_lines_collapse_when_equal(spark):
    long = "a line that is long enough"
    rows = [(1, f"Les.\n{long}\n \nLes."), (2, "Les.\nLex.\n \n\u00a0"), (3, "\u00a0\nLex.\n" + long[:-1]), (None, "Les.\nown"), (4, None)]
    got = {r.doc_id: r.text for r in ld.dedup_lines(docs(spark, rows), short=True).collect()}
    assert got == {1: f"Les.\n{long}\n ", 2: "Lex.\n \n\u00a0", 3: "\u00a0", None: "own", 4: None}
    told = {r.doc_id: r.dropped for r in ld.report(docs(spark, rows)).collect()}
    assert told == {1: "3", 2: "0", 3: "1,2", None: "0", 4: ""}


@pytest.mark.parametrize("block", [7, 64, 4_096])
def test_lines_of_one_hot_key(spark, block):
    """All lines share their first third; runs longer than a block are dealt in pairs of blocks, with the same classes."""
    rng = np.random.default_rng(11)
    first = "the same beginning of every line "
    lines = [first + "".join(rng.choice(list("abcdefgh"), 66)) for _ in range(600)]
    near = {}
    for k in range(0, 600, 40):
        near[k] = lines[k][:-2] + "zz"
    every = lines + list(near.values())
    frame = spark.createDataFrame([(t,) for t in every], "body string").select(ld.name_of("body").alias("line"), F.xxhash64("body").alias("h"), "body").repartition(3)
    text = {r.line: r.body for r in frame.collect()}
    got = {}
    for r in ld.near_lines(frame, block).collect():
        got.setdefault(r.component, set()).add(text[r.node])
    assert set(map(frozenset, got.values())) == {frozenset((lines[k], t)) for k, t in near.items()}


def test_long_runs_across_batches():
    rng = np.random.default_rng(3)
    key = np.sort(rng.integers(0, 12, 900))
    line, sketch = np.arange(900), np.full(900, 3)
    def run(size):
        batches = (pa.record_batch([pa.array(c[k : k + size]) for c in (key, line, sketch)], ["key", "line", "sketch"]) for k in range(0, 900, size))
        out = pa.Table.from_batches(list(ld._pairs(75)(batches)))
        return sorted(map(tuple, zip(*(c.to_pylist() for c in out.columns), strict=True)), key=str)
    want = run(900)
    assert any(r[0] is None for r in want) and any(r[0] is not None for r in want)
    assert sum(r[0] is None for r in want) == sum(c for c in np.bincount(key) if c > 75)
    assert all(run(size) == want for size in (1, 10, 77, 400))


def test_clashing_columns(spark):
    line = "a line that is long enough"
    names = ["doc_id", "text", "dropped_lines", "lost_id", "lost_hash", "own_hash", "component", "h", "at"]
    frame = spark.createDataFrame([(k, line, *range(7)) for k in range(2)], "doc_id long, text string, " + ", ".join(f"{n} long" for n in names[2:]))
    out = ld.dedup_lines(frame)
    assert out.columns == [*names, "dropped_lines_"]
    assert sorted(map(tuple, out.collect())) == [(0, line, *range(7), None), (1, "", *range(7), [0])]
