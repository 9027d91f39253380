"""The pipeline's stages against the operators' brute-force versions."""

import re

import pytest

import corpus_pipeline as cp

CLEAN = ["harbour lights and quiet water at dusk number", "a gardener plants beans beside the old wall number", "trains leave early on market days number"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    rows, marks = [], []
    for k in range(120):
        own = " ".join(f"{w}{k}" for w in ("alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa"))
        text = f"{CLEAN[k % 3]} {own}\n{own} closing remark for {k * k + 7}"
        if k % 5 == 0:
            text += " vilezo grotch vilexa"
        rows.append((k, text, "en", f"s{k % 3}", len(text)))
        marks.append((k, 1, int(k % 5 == 0)))
    shared = "This boilerplate line stands in two documents."
    rows.append((200, f"{shared}\nfirst owner of it zebra yak", "en", "s", 0))
    rows.append((201, f"{shared}\nsecond owner gnu lynx", "en", "s", 0))
    near = " ".join(f"n{k}" for k in range(60))
    rows.append((300, near, "en", "s", 0))
    rows.append((301, near + " extra1 extra2 extra3", "en", "s", 0))
    rows.append((400, "before it q1 q2 q3 q4 q5 q6 q7 q8 q9 q10 q11 after it", "en", "s", 0))
    rows += [(500, None, None, None, None), (501, "", "en", "s", 0), (None, "no id here at all", None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(0, "q1 q2 q3 q4 q5 q6 q7 q8 q9 q10 q11")], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def test_stages(spark, tables):
    assert [n for n, _ in cp.STAGES][0] == "toxicity" and len(cp.STAGES) == 5
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    seen = []
    for name, stage in cp.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(spark, docs, tables).cache()
        assert docs.columns == columns and docs.schema == spark.read.parquet(f"{tables}/documents.parquet").schema, name
        after = {r.doc_id: r.text for r in docs.collect()}
        seen.append((before, after))
    lost = [set(b) - set(a) for b, a in seen]
    assert lost[0] == {k for k in range(0, 120, 5)}
    assert lost[1] == set()
    assert seen[1][1][201] == "second owner gnu lynx" and seen[1][1][200].startswith("This boilerplate")
    changed = {k for k, t in seen[1][1].items() if t != seen[1][0][k]}
    assert changed == {201}
    assert lost[2] == {301}
    assert lost[3] == {400}
    pieces = cp.STAGES[-1][1](spark, docs, tables).toPandas()
    assert set(pieces.doc_id.dropna().astype(int)) == {k for k in seen[3][1] if k is not None}
    same = cp.run(spark, tables).toPandas()
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert same[key].fillna(-1).sort_values(key).values.tolist() == pieces[key].fillna(-1).sort_values(key).values.tolist()


def test_emptied_copies_go_and_empty_texts_stay(spark):
    line = "one line that is long enough to count"
    docs = spark.createDataFrame([(1, line), (2, line), (3, ""), (4, None), (5, line + "\nmore")], "doc_id long, text string")
    out = {r.doc_id: r.text for r in cp.drop_repeated_lines(spark, docs, "").collect()}
    assert out == {1: line, 3: "", 4: None, 5: "more"}
    assert re.match("one", out[1])


def test_short_repeated_lines_go(spark):
    docs = spark.createDataFrame([(1, "Les.\none"), (2, "Les.\ntwo"), (3, "Les.")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in cp.drop_repeated_lines(spark, docs, "").collect()} == {1: "Les.\none", 2: "two"}
