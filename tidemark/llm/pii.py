"""Information-theoretic sanitisation.

Personal data that has a form (email, ip, card, phone) is found by pattern. The
corpus then tells which other terms give such an entity away: for an entity e and
a term t that share a document, PMI(e; t) = log2(n(e,t) D / (n(e) n(t))) is
compared with the entity's information content IC(e) = log2(D / n(e)), n counting
documents. Few documents prove little, so PMI is taken at the lower end of
Wilson's interval (of ``z`` standard errors) for the share n(e,t) / n(t) of the
term's documents that hold the entity; no count of documents is asked for. A term
whose lower PMI >= alpha IC discloses the entity: where PMI >= ``remove`` IC it is
removed, else generalised, wherever it stands in documents that hold the entity;
documents without entities stay as they are.

The lower end is at most n(e,t) / n(t), and n(e,t) <= n(e), so no term of more
than n(e)^alpha D^(1 - alpha) documents discloses e: only rarer terms are paired
with it. The most frequent words go by a broadcast of ``COMMON`` rows before the
join that tells the other terms' counts, so that none of them meets in one task.

Defined cases: null and empty texts have no spans; a null id is kept as null;
repeated rows are reported one by one and counted as documents each; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import free_name, materialise

KINDS = ("email", "ip", "card", "phone", "term")
EMAIL_LEFT = re.compile(r"[A-Za-z0-9._%+-]")
EMAIL_RIGHT = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TERM = re.compile(r"[^\W\d_]{3,}")
COMMON = 20_000  # words whose counts are broadcast

SPAN = "struct<kind:string,start:int,end:int,value:string>"
ADDED = "array<struct<term:string,action:string>>"
FOUND = "array<struct<kind:string,start:int,end:int,action:string>>"


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and EMAIL_LEFT.match(text, start - 1):
            start -= 1
        right = EMAIL_RIGHT.match(text, at + 1) if start < at else None
        if right:
            yield start, right.end()
        # Without a match no later start reaches this @ either: look on behind it.
        done = right.end() if right else at + 1
        at = text.find("@", done)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for chain in DOTTED.finditer(text):
        parts, start = chain.group().split("."), chain.start()
        for k in range(0, len(parts) - 3, 4):
            own = parts[k : k + 4]
            end = start + sum(map(len, own)) + 3
            if all(int(p[-4:]) <= 255 and not p[:-4].strip("0") for p in own):
                yield start, end
            start = end + 1


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind."""
    found = [("email", *s) for s in _emails(text)] if "@" in text else []
    if DIGIT.search(text):
        found += [("ip", *s) for s in _ips(text)]
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                found.append(("card", *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                    found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _value(kind: str, raw: str) -> str:
    """An entity as the corpus counts it: spelling variants of one value agree."""
    return f"{kind}:{raw.lower() if kind in ('email', 'ip') else ''.join(c for c in raw if c.isdigit())}"


def _terms(text: str, spans: list[tuple[int, int]]) -> Iterator[re.Match]:
    """Words that touch none of the spans, which come by start."""
    at = done = 0
    for m in TERM.finditer(text):
        while at < len(spans) and spans[at][0] < m.end():
            done = max(done, spans[at][1])
            at += 1
        if done <= m.start():
            yield m


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of every row; text and distinct terms of the rows that have any."""
    from pyspark import TaskContext

    row = TaskContext.get().partitionId() << 40
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))
    for batch in batches:
        spans, terms, held = [], [], []
        for value in batch.column(1):
            text = value.as_py() or ""
            own = base_spans(text)
            spans.append([{"kind": k, "start": a, "end": b, "value": _value(k, text[a:b])} for k, a, b in own])
            terms.append(sorted({m.group().lower() for m in _terms(text, [s[1:] for s in own])}) if own else [])
            held.append(text if own else None)
        keys = pa.array(range(row, row + batch.num_rows), pa.int64())
        row += batch.num_rows
        yield pa.record_batch(
            [keys, batch.column(0), pa.array(spans, span), pa.array(terms, pa.list_(pa.string())), pa.array(held, pa.string())],
            ["row", "doc_id", "spans", "terms", "held"],
        )


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each term, added up until there are too many terms to hold."""

    def out(count: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array(count, pa.string()), pa.array(count.values(), pa.int64())], ["term", "n"])

    count = Counter()
    for batch in batches:
        for value in batch.column(0):
            count.update({w.lower() for w in set(TERM.findall(value.as_py() or ""))})
            if len(count) > 500_000:
                yield out(count)
                count = Counter()
    yield out(count)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Base spans and every place of the row's disclosing terms, by start."""
    found = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("action", pa.string())]))
    for batch in batches:
        rows = []
        for spans, text, more in zip(*(batch.column(c).to_pylist() for c in ("spans", "held", "more")), strict=True):
            out = [(s["start"], KINDS.index(s["kind"]), s["kind"], s["end"], "remove") for s in spans]
            if more:
                action = {m["term"]: m["action"] for m in more}
                for m in _terms(text, [(s["start"], s["end"]) for s in spans]):
                    if m.group().lower() in action:
                        out.append((m.start(), KINDS.index("term"), "term", m.end(), action[m.group().lower()]))
            rows.append([{"kind": k, "start": a, "end": b, "action": do} for a, _, k, b, do in sorted(out)])
        yield pa.record_batch([batch.column(0), pa.array(rows, found)], ["doc_id", "spans"])


def _lower_share(z: float) -> F.Column:
    """The lower end of Wilson's interval for n_et / n_t."""
    n, p = F.col("n_t"), F.col("n_et") / F.col("n_t")
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def _judged(docs: DataFrame, alpha: float = 0.8, remove: float = 0.95, z: float = 1.645) -> DataFrame:
    """One row per document row: doc_id, base spans, the text if it holds any, and its disclosing terms with their action."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = f"row long, doc_id long, spans array<{SPAN}>, terms array<string>, held string"
    scan = materialise(texts.mapInArrow(_scan, schema), "personal-data")
    total = float(scan.count())
    values = scan.select("row", F.explode(F.array_distinct(F.transform("spans", lambda s: s["value"]))).alias("value"))
    n_value = values.groupBy("value").agg(F.count(F.lit(1)).alias("n_e"))
    # A little more than the bound, for rounding.
    n_value = n_value.withColumn("most", F.pow("n_e", F.lit(alpha)) * max(total, 1.0) ** (1 - alpha) + 1e-6)
    values = materialise(values.join(n_value, "value"), "entities")
    n_term = texts.select("text").mapInArrow(_frequencies, "term string, n long")
    n_term = materialise(n_term.groupBy("term").agg(F.sum("n").alias("n_t")), "terms")
    common = F.broadcast(n_term.orderBy(F.desc("n_t")).limit(COMMON).select("term", F.col("n_t").alias("n_c")))
    rare = scan.select("row", F.explode("terms").alias("term")).join(values.groupBy("row").agg(F.max("most").alias("top")), "row")
    rare = rare.join(common, "term", "left").filter(F.col("n_c").isNull() | (F.col("n_c") <= F.col("top")))
    rare = rare.join(n_term, "term").filter(F.col("n_t") <= F.col("top"))
    rare = materialise(rare.select("row", "term", "n_t"), "rare-terms")
    pairs = values.join(rare, "row").filter(F.col("n_t") <= F.col("most"))
    counts = pairs.groupBy("value", "term").agg(F.count(F.lit(1)).alias("n_et"), F.first("n_e").alias("n_e"), F.first("n_t").alias("n_t"))
    content = F.log2(F.lit(total) / F.col("n_e"))
    least = F.log2(_lower_share(z) * total / F.col("n_e")) / content
    share = F.log2(F.col("n_et") * total / (F.col("n_e") * F.col("n_t"))) / content
    told = counts.filter((content > 0) & (least >= alpha)).select("value", "term", share.alias("share"))
    added = pairs.select("row", "value", "term").join(told, ["value", "term"]).groupBy("row", "term").agg(F.max("share").alias("share"))
    action = F.when(F.col("share") >= remove, "remove").otherwise("generalise")
    added = added.groupBy("row").agg(F.collect_list(F.struct("term", action.alias("action"))).cast(ADDED).alias("more"))
    return scan.select("row", "doc_id", "spans", "held").join(added, "row", "left").select("doc_id", "spans", "held", "more")


def find_personal_data(docs: DataFrame, **options) -> DataFrame:
    """One row per document row: doc_id, spans (kind, start, end, action), base and added together."""
    return _judged(docs, **options).mapInArrow(_merge, f"doc_id long, spans {FOUND}")


def sanitise_documents(docs: DataFrame, **options) -> DataFrame:
    """All rows and columns of ``docs``, ``text`` with its personal data and disclosing terms removed or generalised.

    Spans depend on a row's text alone (and on the corpus), so texts meet their clean form by MD5.
    """
    texts = _judged(docs, **options).filter("held is not null").withColumn("doc_id", F.md5("held")).dropDuplicates(["doc_id"])

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = next(_merge(iter([batch]))).column(1).to_pylist()
            done = [sanitise(t, s) for t, s in zip(batch.column("held").to_pylist(), found, strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(done, pa.string())], ["h", "clean"])

    h, done, own = (free_name(docs, c) for c in ("found_hash", "clean_text", "own_hash"))
    cleaned = texts.mapInArrow(clean, "h string, clean string").select(F.col("h").alias(h), F.col("clean").alias(done))
    out = docs.withColumn(own, F.md5(F.col("text").cast("string"))).join(cleaned, F.col(own) == F.col(h), "left")
    return out.select(*(F.coalesce(done, "text").alias("text") if c == "text" else F.col(c) for c in docs.columns))


def span_text(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, **options) -> DataFrame:
    found = find_personal_data(docs, **options)
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = span_text(F.filter("spans", lambda s: s["kind"] != "term"))
    return found.select("doc_id", *map(n, KINDS), F.sha2(base, 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def sanitise(text: str | None, spans: list) -> str | None:
    """``text`` with its spans removed or generalised to their kind."""
    if text is None:
        return None
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] < at:
            at = max(at, s["end"])
            continue
        out += [text[at : s["start"]], "[REMOVED]" if s["kind"] == "term" and s["action"] == "remove" else f"[{s['kind'].upper()}]"]
        at = s["end"]
    return "".join([*out, text[at:]])
