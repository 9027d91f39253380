"""PII spans and toxicity scores against plain re-statements of their definitions."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import pii, toxicity

DOC = "doc_id long, text string, score double, spans string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 0.0, "z") for i, t in rows], DOC)


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def brute_base(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"[ -]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.findall("[0-9]", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a@.-+ 0123456789()é%\n", max_size=60) | st.sampled_from([
    "x.y@a.b.c@d.ef, @a.b a@b a@@b.c", "1.2.3.4.5.6.7.8 256.1.1.1 0001.0255.3.4.", "4111 1111 1111 1111 4111-1111-1111-1112",
    "+1 (456) 555-2186 ++49 30 123456 +1", "é a@b.c"]))
def test_base_spans(text):
    assert pii.base_spans(text) == brute_base(text)


def test_base_spans_long_runs():
    assert pii.base_spans("a" * 200_000 + "@" * 10 + "1" * 100_000 + "." * 1_000) == []


def test_disclosing_terms(spark):
    rows = [(k, f"contact Zorblax the keeper at zor@lax.org for this and that {k}") for k in range(5)]
    rows += [(100 + k, "the keeper of this and that for at contact plain words") for k in range(60)]
    rows += [(200, None), (201, ""), (None, "no data"), (202, "word " * 30_000), (7, "x"), (7, "x")]
    got = pii.report(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    text = rows[0][1]
    spans = [s.split(":") for s in by[0].spans.split(",")]
    assert [(k, text[int(a) : int(b)]) for k, a, b in spans] == [("term", "Zorblax"), ("email", "zor@lax.org")]
    assert by[0].n_email == 1 and by[0].n_term == 1
    a, b = spans[1][1:]
    assert by[0].base_sha256 == hashlib.sha256(f"email:{a}:{b}".encode()).hexdigest()
    assert by[100].spans == "" and by[200].base_sha256 == hashlib.sha256(b"").hexdigest()
    found = {r.doc_id: r for r in pii.find_personal_data(docs(spark, rows)).collect()}
    clean = pii.sanitise(text, [s.asDict() for s in found[0].spans])
    assert "Zorblax" not in clean and "zor@" not in clean and clean.startswith("contact [REMOVED] the keeper at [EMAIL]")
    assert pii.report(docs(spark, [])).count() == 0


def test_document_counts_match_brute_force(spark):
    """The share that decides on a term equals the one from plain counting."""
    rng = np.random.default_rng(2)
    names = ["alpha", "bravo", "carol", "delta", "eagle"]
    rows = []
    for k in range(80):
        words = list(rng.choice([*names, "common", "other"], 6))
        if k % 4 == 0:
            words.insert(3, f"m{k % 3}@x.io")
            words.insert(3, ["unone", "duotwo", "treetri"][k % 3])
        rows.append((k, " ".join(words)))
    got = {r.doc_id: {(s.start, s.end) for s in r.spans if s.kind == "term"} for r in pii.find_personal_data(docs(spark, rows), alpha=0.5).collect()}
    n_e, n_t, n_et = Counter(), Counter(), Counter()
    for _, t in rows:
        mails, terms = set(re.findall(r"\S+@\S+", t)), set(re.findall(r"[a-z]{3,}", re.sub(r"\S+@\S+", " ", t)))
        n_e.update(mails)
        n_t.update(set(re.findall(r"[^\W\d_]{3,}", t)))
        n_et.update((m, w) for m in mails for w in terms)
    for k, t in rows:
        want = set()
        for m in re.findall(r"\S+@\S+", t):
            ic = math.log2(len(rows) / n_e[m])
            for w in re.finditer(r"\b[a-z]{3,}\b(?!@)(?!\.io)", t):
                share = math.log2(n_et[m, w[0]] * len(rows) / (n_e[m] * n_t[w[0]])) / ic if n_et[m, w[0]] else 0
                if n_et[m, w[0]] >= 3 and share >= 0.5:
                    want.add(w.span())
        assert got[k] == want, t


def test_rare_entities_are_judged(spark):
    """Entities of one or two documents have disclosing terms too; one chance meeting in several documents is none."""
    rows = [(0, "ask Zorblax at zor@lax.org today"), (1, "call Quendix at que@dix.org today"), (2, "then Quendix at que@dix.org came")]
    rows += [(10 + k, f"ask or call today, then came {'vermin' if k < 4 else 'plain'} words at noon") for k in range(900)]
    rows += [(2000, "vermin wrote ver@min.org at noon")]
    got = {r.doc_id: r.spans for r in pii.find_personal_data(docs(spark, rows)).collect()}
    terms = lambda k: [rows[k][1][s.start : s.end] for s in got[rows[k][0]] if s.kind == "term"]
    assert terms(0) == ["Zorblax"] and terms(1) == terms(2) == ["Quendix"]
    assert terms(-1) == ["wrote"] and not any(got[k] for k in range(10, 910))


def test_terms_far_from_their_entity(spark):
    """A disclosing term counts at any distance, and each of its places in the document is marked."""
    far = " ".join(["plain words that all know"] * 60)
    rows = [(k, f"Zorblax {far} write to zor@lax.org {far} says ZORBLAX") for k in range(5)]
    rows += [(100 + k, f"write to all that says {far}") for k in range(60)]
    got = {r.doc_id: r.spans for r in pii.find_personal_data(docs(spark, rows)).collect()}
    assert [rows[0][1][s.start : s.end] for s in got[0]] == ["Zorblax", "zor@lax.org", "ZORBLAX"]
    assert not any(got[k] for k in range(100, 160))


def test_block_max_search_is_exact():
    rng = np.random.default_rng(0)
    def vector():
        v = {int(f): float(rng.random()) for f in rng.choice(40, rng.integers(0, 9), replace=False)}
        norm = math.sqrt(sum(w * w for w in v.values())) or 1
        return {f: w / norm for f, w in v.items()}
    vectors = [vector() for _ in range(700)]
    index = toxicity.BlockMaxIndex(vectors, list(range(700)), [0] * 700, 40)
    for _ in range(60):
        q = vector()
        at, cosine = index.search(q, k=7)
        # Equal vectors share one place in the index.
        distinct = {tuple(sorted(v.items())) for v in vectors}
        every = sorted((sum(w * dict(v).get(f, 0) for f, w in q.items()) for v in distinct), reverse=True)
        want = [c for c in every[:7] if c > 1e-15]
        assert np.allclose(cosine, want)


def test_vote_takes_k_examples_and_leaves_one_out():
    vectors = [{0: 1.0}] * 4 + [{0: 0.6, 1: 0.8}] * 10 + [{}]
    labels = [1, 1, 1, 0] + [0] * 10 + [1]
    index = toxicity.BlockMaxIndex(vectors, list(range(15)), labels, 2)
    at, cosine = index.search({0: 1.0}, 5)
    assert abs(index.vote(at, cosine, k=6) - 3 / 6) < 1e-9
    assert abs(index.vote(at, cosine, (index.place[0], 1), k=3) - 2 / 3) < 1e-9


def test_monotone():
    steps, levels = toxicity.monotone([0.1, 0.2, 0.3, 0.4, 0.4], [0, 1, 0, 1, 1])
    assert list(levels) == sorted(levels) and len(steps) == len(levels)


def test_toxicity_held_out(spark):
    rng = np.random.default_rng(4)
    words = [a + b for a in "bcdfghklmn" for b in ("ado", "iru", "esta", "onel")]
    rows, marks = [], []
    for k in range(900):
        body = list(rng.choice(words, 40))
        bad = k % 6 == 0
        if bad:
            body[5:8] = rng.choice(["vilezo", "vilexa", "grotch"], 3)
        rows.append((k, " ".join(body)))
        marks.append((k, int(bad), 1))
    rows += [(2000, None), (2001, ""), (2002, "ado " * 20_000), (None, "grotch vilezo"), (5, rows[5][1])]
    marks += [(None, 1, 0), (3, None, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, toxic int, quality int")
    got = toxicity.report(docs(spark, rows), labels).toPandas()
    assert len(got) == len(rows)
    held = got[got.held_out & (got.doc_id < 900)]
    assert ((held.predicted == 1) == (held.doc_id % 6 == 0)).mean() > 0.97
    assert got.score.between(0, 1).all()
    assert toxicity.report(docs(spark, rows), labels.filter("false")).agg({"score": "max"}).first()[0] == 0
    assert toxicity.report(docs(spark, []), labels).count() == 0


def test_grams():
    assert toxicity.grams("ab") == {"^ab$"} and toxicity.grams("abcd") == {"^abcd", "abcd$", "^abcd$"}


def test_false_discovery_rate():
    p = lambda x: math.erfc(math.sqrt(x / 2))
    rng = np.random.default_rng(1)
    for m in (50, 5_000):
        chi2 = np.concatenate([rng.chisquare(1, m), rng.uniform(15, 60, m // 10)])
        steps = {}
        for x in chi2:
            steps[int(x * toxicity.STEPS[0])] = steps.get(int(x * toxicity.STEPS[0]), 0) + 1
        low = np.floor(chi2 * toxicity.STEPS[0]) / toxicity.STEPS[0]
        ok = [x for x in sorted(low) if p(x) <= toxicity.FDR * (low >= x).sum() / len(chi2)]
        assert toxicity.least_chi2(steps, len(chi2)) == (ok[0] if ok else math.inf)
    assert toxicity.least_chi2({0: 5, 100: 3}, 8) == math.inf


def marked(spark, seed):
    rng = np.random.default_rng(seed)
    words = [a + b for a in "bcdfghklmn" for b in ("ado", "iru", "esta", "onel")]
    rows, marks = [], []
    for k in range(400):
        body = list(rng.choice(words, int(rng.integers(5, 40))))
        if k % 5 == 0:
            body[1:3] = rng.choice(["vilezo", "vilexa", "grotch"], 2)
        elif k % 5 == 1:
            body[1] = "kindly"
        rows.append((k, " ".join(body)))
        marks.append((k, int(k % 5 == 0)))
    rows += [(900, ""), (901, None), (902, "ado iru")]
    return rows, spark.createDataFrame(marks, "doc_id long, toxic int")


def test_scores_match_brute_force(spark):
    """Cosine with every example, k nearest with ties by place, votes and the fitted map, all recomputed."""
    rows, labels = marked(spark, 8)
    frame = docs(spark, rows)
    model, features, _ = toxicity.train(frame, labels)
    assert any("kindly" in n for n in model.names) and any("vile" in n for n in model.names)  # both leanings
    counts = {r.doc_id: dict(zip(r.f, r.n)) for r in features.collect()}
    n = len(rows)
    df = {f: sum(f in c for c in counts.values()) for f in range(len(model.names))}
    for i, text in rows:
        own = {}
        for w in (text or "").lower().split():
            for g in toxicity.grams(w):
                if g in model.names:
                    own[model.names.index(g)] = own.get(model.names.index(g), 0) + 1
        assert own == counts[i]
    def unit(c):
        v = {f: (1 + math.log(k)) * math.log((1 + n) / (1 + df[f])) for f, k in c.items()}
        size = math.sqrt(sum(w * w for w in v.values()))
        return {f: w / size for f, w in v.items()} if size else {}
    label = {k: int(k % 5 == 0) for k in range(400)}
    groups = {}
    for k in range(400):
        if counts[k]:
            groups.setdefault(tuple(sorted(counts[k].items())), []).append(k)
    place = {tuple(sorted(counts[k].items())): model.index.place[i] for i, k in enumerate(range(400)) if counts[k]}
    got = {r.doc_id: r for r in toxicity.score(frame, labels).collect()}
    for i, _ in rows:
        q = unit(counts[i])
        near = [(-sum(w * unit(dict(g)).get(f, 0) for f, w in q.items()), place[g], g) for g in groups]
        near = sorted((c, p, g) for c, p, g in near if c < -1e-15)
        left, vote = toxicity.K, 0.0
        for c, _, g in near:
            take = min(left, len(groups[g]))
            vote += take * min(-c, 1.0) * sum(label[k] for k in groups[g]) / len(groups[g])
            left -= take
        vote /= toxicity.K
        want = model.levels[max(0, np.searchsorted(model.steps, vote + 1e-12, "right") - 1)] if near else model.blank
        assert abs(got[i].score - want) < 1e-9, i


def test_keep_clean_agrees_with_scores(spark):
    rows, labels = marked(spark, 9)
    frame = spark.createDataFrame([(i, t, i, "x") for i, t in rows], "doc_id long, text string, f long, own string")
    stay = {r.doc_id for r in toxicity.score(frame, labels).filter("score < 0.7").collect()}
    kept = toxicity.keep_clean(frame, labels)
    assert kept.columns == frame.columns
    got = kept.collect()
    assert {r.doc_id for r in got} == stay and len(got) == len(stay) and all(r.f == r.doc_id for r in got)


def test_sample_is_bounded(spark):
    rows, labels = marked(spark, 10)
    model, _, _ = toxicity.train(docs(spark, rows), labels, max_examples=200)
    assert 50 <= model.index.size.sum() <= 260


def test_sanitise_documents(spark):
    """Every row's text is what its spans say, whatever else the row holds."""
    rows = [(k, f"Zorblax writes to zor@lax.org and calls +49 170 1234567 as number {k % 2}") for k in range(5)]
    rows += [(100 + k, "writes to all and calls as number one") for k in range(60)] + [(None, None), (7, ""), (8, "ip 10.0.0.1 only"), (8, "ip 10.0.0.1 only")]
    frame = spark.createDataFrame([(i, t, "a", "b", i) for i, t in rows], "doc_id long, text string, own_hash string, clean_text string, h long")
    out = pii.sanitise_documents(frame)
    assert out.columns == frame.columns
    spans = {r.doc_id: [s.asDict() for s in r.spans] for r in pii.find_personal_data(frame).collect()}
    want = sorted((i is None, i or 0, pii.sanitise(t, spans[i]) or "") for i, t in rows)
    got = out.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in got) == want
    assert all(r.own_hash == "a" and r.h == r.doc_id for r in got)
    assert not any("zor@" in (r.text or "") or "Zorblax" in (r.text or "") for r in got)
    assert {r.text for r in got if r.doc_id == 8} == {"ip [IP] only"}
