"""The opN_ queries: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chat_format, decontaminate, exact_dedup, jaccard_join, line_dedup, packing, pii, pitman_yor, sharding, toxicity
from tidemark.llm.common import new_path, table


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score_documents(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = chat_format.neighbouring_pairs(table(spark, sf_dir, "conversations"))
    spans = lambda c: F.array_join(
        F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    out = chat_format.format_preferences(pairs)
    return out.withColumns({c: spans(c) for c in ("chosen_mask", "rejected_mask")})


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def _sharded(spark: SparkSession, sf_dir: str) -> sharding.ShardStore:
    store = sharding.ShardStore(spark, new_path(spark, "shards"))
    store.append(table(spark, sf_dir, "documents"), arrival=F.pmod(F.xxhash64("doc_id"), F.lit(8)))
    store.compact()
    store.vacuum()
    return store


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight arrivals of documents become shards of about 64 MB; each row tells where it lies."""
    store = _sharded(spark, sf_dir)
    shards = store.read()
    name, size = shards.columns[-2:]
    return shards.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.crc32("text").alias("text_crc32"),
        F.regexp_extract(name, r"([^/]+)$", 1).alias("shard"), F.col(size).alias("shard_bytes"), F.lit(store.version()).cast("long").alias("version"),
    )


def sharding_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10's operator again: what the compacted store holds, which is what arrived."""
    rows = _sharded(spark, sf_dir).read()
    return rows.select("doc_id", "lang", "source", F.length("text").cast("long").alias("text_chars"), F.md5("text").alias("text_md5"))


def sanitised_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9's operator again: the documents that are left when what was found is removed or generalised."""
    clean = pii.sanitise_documents(table(spark, sf_dir, "documents"))
    return clean.select("doc_id", F.length("text").cast("long").alias("clean_chars"), F.sha2("text", 256).alias("clean_sha256"))


def benchmark_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3's operator again: which benchmark items occur exactly, and which only nearly."""
    return decontaminate.proximity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {k: f for k, f in sorted(globals().items()) if k.startswith("op") and k[2].isdigit()}
    return out | {"benchmark_proximity": benchmark_proximity, "sharding_contents": sharding_contents, "sanitised_documents": sanitised_documents}


_NORM = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"

_OP7 = f"""
WITH d AS (SELECT doc_id, {_NORM} AS body FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM d WINDOW w AS (PARTITION BY body)
"""

_OP5 = """
WITH u AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
           FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, role, text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
        '<|im_start|>' || replace(role, '<|', '< |') || chr(10) AS head,
        replace(text, '<|', '< |') || '<|im_end|>' || chr(10) AS tail FROM u),
gap AS (SELECT coalesce(a.pair_id, b.pair_id) AS pair_id,
          min(CASE WHEN a.role = b.role AND a.text = b.text THEN NULL ELSE coalesce(a.i, b.i) END) AS g,
          max(coalesce(a.i, b.i)) AS n
        FROM (SELECT * FROM t WHERE side = 0) a FULL JOIN (SELECT * FROM t WHERE side = 1) b
          ON a.pair_id = b.pair_id AND a.i = b.i GROUP BY 1),
l AS (SELECT pair_id, coalesce(g - 1, n) AS n_common FROM gap),
s AS (SELECT t.*, l.n_common, coalesce(sum(length(head) + length(tail)) OVER (PARTITION BY pair_id, side ORDER BY i
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
      FROM t JOIN l USING (pair_id) WHERE i > n_common),
c AS (SELECT pair_id,
        coalesce(string_agg(head || tail, '' ORDER BY i) FILTER (WHERE side = 0), '') AS chosen,
        coalesce(string_agg(head || tail, '' ORDER BY i) FILTER (WHERE side = 1), '') AS rejected,
        coalesce(string_agg((pos + length(head))::BIGINT || ':' || (pos + length(head) + length(tail))::BIGINT, ',' ORDER BY i)
          FILTER (WHERE side = 0 AND role = 'assistant'), '') AS chosen_mask,
        coalesce(string_agg((pos + length(head))::BIGINT || ':' || (pos + length(head) + length(tail))::BIGINT, ',' ORDER BY i)
          FILTER (WHERE side = 1 AND role = 'assistant'), '') AS rejected_mask
      FROM s GROUP BY 1),
p AS (SELECT pair_id, string_agg(head || tail, '' ORDER BY i) AS prompt
      FROM t JOIN l USING (pair_id) WHERE side = 0 AND i <= n_common GROUP BY 1)
SELECT pair_id, n_common::INTEGER AS n_common, coalesce(prompt, '') AS prompt, coalesce(chosen, '') AS chosen,
  coalesce(rejected, '') AS rejected, coalesce(chosen_mask, '') AS chosen_mask, coalesce(rejected_mask, '') AS rejected_mask,
  coalesce(chosen_mask, '') <> '' AND coalesce(rejected_mask, '') <> '' AS valid
FROM l LEFT JOIN c USING (pair_id) LEFT JOIN p USING (pair_id)
"""



_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"coalesce(regexp_extract_all(" + _LOWER.format("text") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"

_OP3 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_ALNUM} AS w FROM documents),
i AS (SELECT item_id, {_ALNUM} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, s, s + least(len(w), 10) - 1), ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT r, s, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS win
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT dw.r, dw.s, dw.n, iw.item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
cover AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(s, s + n)) AS at FROM (SELECT DISTINCT r, s, n FROM hit)) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (r) LEFT JOIN named USING (r)
"""

_WORDS = r"coalesce(regexp_extract_all(" + _LOWER.format("text") + r", '[^\x20\x09-\x0D]+'), [])"

_OP4 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * m >= 75 * (a.n + b.n - m)),
reach(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.x, l.y FROM reach JOIN l ON reach.y = l.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) c USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_benchmark_decontamination": _OP3,
        "op4_ngram_jaccard_join": _OP4,
        "op5_chat_formatting": _OP5,
        "op7_exact_dedup": _OP7,
        "sharding_contents": "SELECT doc_id, lang, source, length(text) AS text_chars, md5(text) AS text_md5 FROM documents",
    }
