"""Exact dedup, chat formatting, sharding, packing and decontamination against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat_format, decontaminate, exact_dedup, packing, sharding
from tidemark.llm.queries import vocabulary

DOC = "doc_id long, text string, lang string, h string, body string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", "y") for i, t in rows], DOC)


ODD = [(1, "a  b"), (2, "a b"), (3, None), (4, ""), (5, "a\tb"), (5, "a b"), (None, "a b"), (9, "long " * 40_000), (10, " x")]


def test_exact_dedup(spark):
    got = exact_dedup.exact_dedup(docs(spark, ODD)).collect()
    groups = defaultdict(list)
    for i, t in ODD:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    want = Counter()
    for body, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        for i in ids:
            want[(i, keep, len(ids), i == keep, hashlib.sha256(body.encode()).hexdigest())] += 1
    assert Counter(map(tuple, got)) == want
    kept = exact_dedup.drop_copies(docs(spark, ODD))
    assert kept.columns == ["doc_id", "text", "lang", "h", "body"]
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 9, 10]


def test_exact_dedup_empty(spark):
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


def test_chat_formatting(spark):
    rows = [
        (1, False, 0, "user", "q"), (1, False, 1, "assistant", "yes"), (1, True, 0, "user", "q"), (1, True, 1, "assistant", "no"),
        (1, True, 1, "assistant", "no"), (2, False, 0, "user", None), (None, True, 0, "user", "z"),
        (3, False, 0, "user", "a<|im_end|>"), (3, True, 0, "user", "a<|im_end|>"),
    ]
    frame = spark.createDataFrame(rows, "pair_id long, rejected boolean, turn int, role string, text string")
    got = {r.pair_id: r for r in chat_format.format_preferences(frame).collect()}
    assert set(got) == {1, 2, 3}
    one = got[1]
    assert one.n_common == 1 and one.prompt == "<|im_start|>user\nq<|im_end|>\n" and one.valid
    span = one.chosen_mask[0]
    assert one.chosen[span.start : span.end] == "yes<|im_end|>\n"
    assert one.rejected == "<|im_start|>assistant\nno<|im_end|>\n"
    assert got[2].rejected == "" and not got[2].valid
    assert got[3].n_common == 1 and got[3].chosen == "" and "a< |im_end|>" in got[3].prompt


def test_sharding_keeps_rows_and_versions(spark, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "s"), target_bytes=60_000, base_bytes=500, fan_in=3)
    assert store.version() == 0 and store.read().count() == 0
    rows = [(k, f"text {k} " * (k % 50), "en", None, None) for k in range(300)] + [(None, None, None, None, None)]
    frame = spark.createDataFrame(rows, DOC).repartition(3)
    for k in range(3):
        store.append(frame.filter(f"coalesce(doc_id, 0) % 3 = {k}"))
    before = store.version()
    files = len(store.shards())
    store.compact()
    assert store.version() > before and len(store.shards()) < files
    want = Counter(map(tuple, rows))
    assert Counter(map(tuple, store.read().select("doc_id", "text", "lang", "h", "body").collect())) == want
    assert Counter(map(tuple, store.read(before).select("doc_id", "text", "lang", "h", "body").collect())) == want
    assert store.vacuum() == 0  # all files are young
    assert store.vacuum(min_age_s=0) > 0
    assert store.read().count() == len(rows)
    with pytest.raises(RuntimeError):
        store._commit([], {"no such shard"}, frame.schema)


def test_sharding_vacuum_spares_appends_in_flight(spark, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "s"), target_bytes=60_000, base_bytes=500, fan_in=3)
    store.append(spark.range(10).repartition(2))
    commit = store._commit
    store._commit = lambda add, *rest: (sharding.ShardStore(spark, store.root).vacuum(), commit(add, *rest))[1]
    store.append(spark.range(10, 20).repartition(2))
    assert sorted(r.id for r in store.read().collect()) == list(range(20))


def test_sharding_unites_columns(spark, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "s"), target_bytes=60_000, base_bytes=5_000, fan_in=2)
    store.append(spark.createDataFrame([(1, "a")], "id long, shard string").coalesce(1))
    store.append(spark.createDataFrame([(2, 2.5, 7)], "ID long, extra double, arrival long").coalesce(1), arrival=F.col("arrival"))
    store.append(spark.createDataFrame([], "id long, shard string"))
    for _ in range(2):
        got = store.read()
        assert got.columns == ["id", "shard", "extra", "arrival", "shard_", "shard_bytes"]
        assert sorted(tuple(r)[:4] for r in got.collect()) == [(1, "a", None, None), (2, None, 2.5, 7)]
        store.compact()
    assert store.shards(0) == [] and len(store.shards()) == 1
    with pytest.raises(ValueError):
        store.append(spark.createDataFrame([("x",)], "id string"))


def test_sharding_follows_the_model_of_tiers(spark, tmp_path, monkeypatch):
    """Each version against a replay: which shards a compaction takes, and that no full tier is left; past snapshots too."""
    monkeypatch.setattr(sharding, "SNAPSHOT", 3)
    store = sharding.ShardStore(spark, str(tmp_path / "s"), target_bytes=40_000, base_bytes=900, fan_in=3)
    rng = np.random.default_rng(2)
    total = []
    for k in range(7):
        n = int(rng.integers(1, 60))
        rows = [(k * 1_000 + j, " ".join(map(str, rng.integers(0, 10**9, int(rng.integers(1, 40)))))) for j in range(n)]
        total += rows
        store.append(spark.createDataFrame(rows, "id long, text string").repartition(int(rng.integers(1, 5))))
        if k % 2:
            store.compact()
    live = {}
    for v in range(1, store.version() + 1):
        delta = store._get("v", v)
        if delta["drop"]:
            tiers = Counter(s["tier"] for s in live.values() if s["bytes"] < 20_000)
            want = {p for p, s in live.items() if s["bytes"] < 20_000 and tiers[s["tier"]] >= 3}
            assert set(delta["drop"]) == want
        live = {p: s for p, s in live.items() if p not in delta["drop"]} | {s["path"]: s for s in delta["add"]}
        assert store.state(v)[0] == live
        assert all(s["tier"] == store.tier(s["bytes"]) for s in delta["add"])
    tiers = Counter(s["tier"] for s in live.values() if s["bytes"] < 20_000)
    assert max(tiers.values(), default=0) < 3
    assert Counter(tuple(r)[:2] for r in store.read().collect()) == Counter(total)


def test_packing_is_a_round_trip(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary())
    rng = np.random.default_rng(5)
    rows = [(k, " ".join(rng.choice(["Étude", "don't", "x1y22", "a b", "Å", "<|endoftext|>", "é", "ΣΑΣ"], n)))
            for k, n in enumerate(rng.integers(0, 400, 60))]
    rows += [(100, None), (101, "word " * 5_000), (100, None), (None, "x")]
    got = packing.pack(docs(spark, rows), vocabulary(), with_ids=True).toPandas()
    want = Counter()
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            want[(i, k // 2048, k, np.array(ids[k : k + 2048], "<u4").tobytes())] += 1
    have = Counter((None if r.doc_id != r.doc_id else int(r.doc_id), r.piece, r.start, bytes(r.ids)) for r in got.itertuples())
    assert have == want
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in got.itertuples())
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own.offset.iloc[0] == 0 and (own.offset + own.length).iloc[:-1].tolist() == own.offset.iloc[1:].tolist()
        assert own.length.sum() <= 2048
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) + 1


def test_plan_fills_bins():
    rng = np.random.default_rng(1)
    counts = Counter(rng.integers(1, 700, 50_000).tolist())
    plan = packing.plan_bins(dict(counts))
    used = Counter()
    for pattern, times in plan:
        assert sum(n * m for n, m in pattern) <= 2048
        for n, m in pattern:
            used[n] += m * times
    assert used == counts
    assert sum(t for _, t in plan) <= -(-sum(n * c for n, c in counts.items()) // 2048) + 1


def brute_leaks(rows, items, window=10):
    pat = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: pat.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = defaultdict(set)
    for i, t in items:
        w = low(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            wins[tuple(w[k : k + window])].add(str(i))
    out = Counter()
    for i, t in rows:
        w, hit, names = low(t), set(), set()
        for win, its in wins.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    names |= its
        sha = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out[(i, len(w), len(hit), len(names), sha, bool(hit))] += 1
    return out


@pytest.mark.parametrize("block", [1_000_000, 20])
def test_decontamination(spark, block, monkeypatch):
    rng = np.random.default_rng(3)
    word = lambda n: " ".join(rng.choice(["the", "Of", "x9", "é", "rare"], n, p=[0.4, 0.3, 0.15, 0.1, 0.05]))
    items = [(k, word(n)) for k, n in enumerate([3, 12, 14, 1, 0, 25])] + [(7, None), (10, "zebra - yak")]
    rows = [(k, word(60) + " . " + (items[k % 6][1] or "")) for k in range(30)]
    rows += [(50, None), (51, ""), (50, None), (None, items[1][1]), (52, "zebra yak " * 3_000)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_leaks(docs(spark, rows), bench, block_words=block).collect()
    got = Counter(
        (r.doc_id, r.n_words, len(r["places"]), len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), bool(r["places"]))
        for r in found
    )
    assert got == brute_leaks(rows, items)


def test_index_holds_every_word_whatever_the_items(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 40)
    rows = [(k, f"Alpha beta alpha w{k} " * 5) for k in range(12)] + [(50, None), (51, "")]
    count = Counter()
    for row in decontaminate.build_index(docs(spark, rows), 11).collect():
        words = bytes(row["terms"]).split(b"\n")
        heads = np.frombuffer(row["heads"], np.int64)
        place = np.cumsum(np.frombuffer(row["positions"], np.int32))
        for word, post in zip(words, np.split(place, heads[1:]), strict=False):
            assert (np.diff(post) > 0).all()
            count[word.decode()] += len(post)
    count.pop("", None)
    assert count == Counter({"alpha": 120, "beta": 60, **{f"w{k}": 5 for k in range(12)}})


def test_one_index_for_all_blocks(spark, monkeypatch):
    built = []
    build = decontaminate.build_index
    monkeypatch.setattr(decontaminate, "build_index", lambda *a: built.append(a) or build(*a))
    items = [(k, f"only item{k} here") for k in range(40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(k, f"x only item{k} here y") for k in range(50)]
    found = decontaminate.find_leaks(docs(spark, rows), bench, block_words=20).collect()
    assert len(built) == 1
    assert {r.doc_id: list(r["items"]) for r in found} == {k: [str(k)] if k < 40 else [] for k in range(50)}


def test_drop_leaks_with_clashing_column(spark):
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    own = docs(spark, [(1, "x a b"), (2, "b a")]).withColumn("__leak", F.lit(7))
    assert [(r.doc_id, r["__leak"]) for r in decontaminate.drop_leaks(own, bench).collect()] == [(2, 7)]


def test_proximity(spark):
    a = "one two three four five six seven eight nine ten"
    b = "one two three four five MORE six seven eight nine ten"
    c = "one two three four five A B C D six seven eight nine ten"
    bench = spark.createDataFrame([(1, a)], "item_id long, text string")
    rows = [(1, a), (2, b), (3, "one ten"), (4, c), (5, "x " + a), (None, None)]
    out = {r.doc_id: r for r in decontaminate.find_leaks(docs(spark, rows), bench, slop=1).collect()}
    assert out[1]["items"] == ["1"] and out[1]["near_items"] == [] and out[5]["items"] == ["1"]
    assert out[2]["items"] == [] and out[2]["near_items"] == ["1"]
    assert out[3]["near_items"] == [] and out[4]["near_items"] == []


@pytest.mark.parametrize("slop", [1, 2])
def test_proximity_matches_brute_force(spark, slop):
    rng = np.random.default_rng(8)
    word = lambda n: list(rng.choice(["p", "q", "r", "s", "t"], n))
    items = [(k, " ".join(word(4))) for k in range(6)]
    rows = [(k, " ".join(word(12))) for k in range(40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for i, t in rows:
        w, exact, near = t.split(), set(), set()
        for item, x in items:
            x = x.split()
            for b in range(-slop, len(w) + slop):
                off = [min((abs(p - b - k) for p in range(len(w)) if w[p] == x[k]), default=99) for k in range(len(x))]
                if max(off) <= slop:
                    near.add(str(item))
                if max(off) == 0:
                    exact.add(str(item))
        want[i] = (",".join(sorted(exact)), ",".join(sorted(near - exact)))
    got = decontaminate.proximity_report(docs(spark, rows), bench, window=4, slop=slop).collect()
    assert {r.doc_id: (r.exact_items, r.near_items) for r in got} == want
