"""Line deduplication by a segment-partition edit join.

Lines (between newlines) of at least ``MIN_CHARS`` code points belong together
when a chain of lines, each within ``TAU`` edits of the next, joins them. Of each
class the first occurrence stays (least id, then least line number); the others
are removed from their documents.

Equal lines collapse by hash first. Each distinct line is then cut into TAU + 1
segments; if two lines are within TAU edits, the shorter has a segment that the
longer contains at a shifted place, and for each length difference the places to
try are few (length-aware, multi-match-aware selection). Segments and substrings
are hashed from one prefix sum over the text, so no substring is ever built. Keys
are dealt by hash and streamed in order; a key's run of more than ``BLOCK`` lines
goes on to a second exchange that deals it in pairs of blocks. Pairs must also agree
in a histogram of their characters before their texts are fetched and verified by a
banded bit-parallel edit distance. Only verified links form components. Lines and
texts are known by 128 bits of two hashes; one of them alone only finds candidates.

Shorter lines belong together only when they are equal: within TAU edits of a short
line lie too many lines that say something else. With ``short`` every shorter line
that is not blank goes through the same hash collapse, without the edit join.

Defined cases: null text has no lines and stays null; blank lines are never
touched, nor are shorter lines without ``short``; a null id comes after all others;
repeated rows with equal id and text share their decisions; an empty table gives an
empty result; other columns are kept as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import components, forget, free_name, materialise, partitions, start_task

TAU = 2
MIN_CHARS = 20
SLICE_CHARS = 2 << 20
BUCKETS = 15
FILTER_BITS = 1 << 22
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
KEYS = "key long, line long, sketch long"
NAME = "struct<h1:long,h2:long>"
BLOCK = 4_096  # rows of one key that meet in one task


def within(a: str, b: str, k: int) -> bool:
    """Whether the edit distance of ``a`` and ``b`` is at most ``k``.

    Bit d + k of ``reach[e]`` says that, having read i characters of ``a``, i + d
    characters of ``b`` are reachable with e errors: one small word for each e
    moves down the band of 2k + 1 diagonals.
    """
    if abs(len(a) - len(b)) > k:
        return False
    at = 0
    most = min(len(a), len(b))
    while at < most and a[at] == b[at]:
        at += 1
    end = 0
    while end < most - at and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[at : len(a) - end], b[at : len(b) - end]
    places: dict[str, int] = {}
    for j, c in enumerate(b):
        places[c] = places.get(c, 0) | 1 << (j + k)
    full = (1 << 2 * k + 1) - 1
    reach = [((1 << e + 1) - 1) << k for e in range(k + 1)]
    for i, c in enumerate(a):
        match = places.get(c, 0) >> i & full
        before, reach[0] = reach[0], reach[0] & match
        for e in range(1, k + 1):
            old = reach[e]
            reach[e] = (old & match | before | before >> 1 | reach[e - 1] << 1) & full
            before = old
        if not reach[k]:
            return False
    return bool(reach[k] >> (len(b) - len(a) + k) & 1)


def segments(length: int, tau: int) -> list[tuple[int, int]]:
    """(start, length) of the tau + 1 segments of a line."""
    short, longer = divmod(length, tau + 1)
    out, at = [], 0
    for i in range(tau + 1):
        n = short + (i >= tau + 1 - longer)
        out.append((at, n))
        at += n
    return out


@cache
def selection(tau: int) -> list[tuple[int, int, int, int]]:
    """(length difference, segment, shift, role): role 1 is the index, 2 a probe, 3 both."""
    out = []
    for diff in range(tau + 1):
        for i in range(tau + 1):
            low, high = max(-i, diff - (tau - i)), min(i, diff + (tau - i))
            for shift in range(low, high + 1):
                out.append((diff, i, shift, 3 if diff == shift == 0 else 2))
    return out


def _powers_of(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2^64."""
    return _powers_of(BASE, SLICE_CHARS), _powers_of(pow(BASE, -1, 1 << 64), SLICE_CHARS)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def signatures(ids: np.ndarray, lines: list[str], tau: int = TAU) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of distinct lines: (key, line, sketch with the role in its lowest two bits)."""
    chars = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = np.fromiter(map(len, lines), np.int64, len(lines))
    start = np.cumsum(n) - n
    up, down = _powers()
    if len(chars) >= len(up):  # one very long line
        up, down = _powers_of(BASE, len(chars)), _powers_of(pow(BASE, -1, 1 << 64), len(chars))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * up[: len(chars)], dtype=np.uint64)])
    bucket = np.repeat(np.arange(len(lines)) * BUCKETS, n) + chars % BUCKETS
    counts = (np.bincount(bucket, minlength=len(lines) * BUCKETS) & 15).reshape(-1, BUCKETS).astype(np.uint64)
    sketch = np.zeros(len(lines), np.uint64)
    for k in range(BUCKETS):
        sketch |= counts[:, k] << np.uint64(4 * k + 4)
    keys, owners, marks = [], [], []
    for diff, i, shift, role in selection(tau):
        target = n - diff
        short, longer = target // (tau + 1), target % (tau + 1)
        first_long = tau + 1 - longer
        seg_start = i * short + np.maximum(0, i - first_long)
        seg_len = short + (i >= first_long)
        at = start + seg_start + shift
        fits = (seg_start + shift >= 0) & (seg_start + shift + seg_len <= n) & (target > 0)
        at, to = at[fits], (at + seg_len)[fits]
        value = (sums[to] - sums[at]) * down[at]
        salt = (target[fits].astype(np.uint64) << np.uint64(8)) + np.uint64(i)
        keys.append(_mix(_mix(value) + salt * np.uint64(0xD6E8FEB86659FD93)))
        owners.append(ids[fits])
        marks.append(sketch[fits] | np.uint64(role))
    return np.concatenate(keys).view(np.int64), np.concatenate(owners), np.concatenate(marks).view(np.int64)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    start_task("line_dedup")
    seen: set[tuple[int, int]] = set()

    def out(ids: list[int], lines: list[str]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c) for c in signatures(np.array(ids, np.int64), lines)], ["key", "line", "sketch"])

    ids, lines, size = [], [], 0
    for batch in batches:
        h2 = batch.column(0).field("h2").to_pylist()
        for i, h, line in zip(h2, batch.column(1).to_pylist(), batch.column(2), strict=True):
            if (h, i) in seen:
                continue
            if len(seen) > 100_000:
                seen.clear()
            seen.add((h, i))
            text = line.as_py()
            if ids and size + len(text) > SLICE_CHARS:
                yield out(ids, lines)
                ids, lines, size = [], [], 0
            ids.append(h)
            lines.append(text)
            size += len(text)
    if ids:
        yield out(ids, lines)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of the histogram differences, each bucket counted modulo 16."""
    total = np.zeros(np.broadcast(a, b).shape, np.int64)
    for k in range(BUCKETS):
        d = ((a >> np.uint64(4 * k + 4)) - (b >> np.uint64(4 * k + 4))) & np.uint64(15)
        total += np.minimum(d, np.uint64(16) - d).astype(np.int64)
    return total


def compare(key: np.ndarray, line: np.ndarray, sketch: np.ndarray, side: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of index and probe entries of one key; of sides 0 and 1 only those of different ones."""
    sketch = sketch.view(np.uint64)
    side = np.full(len(key), 2) if side is None else side
    probe = (sketch & np.uint64(3)) == 2
    order = np.lexsort((sketch, line, probe, key))
    key, line, sketch, probe, side = key[order], line[order], sketch[order], probe[order], side[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (line[1:] != line[:-1]) | (sketch[1:] != sketch[:-1])
    key, line, sketch, probe, side = key[fresh], line[fresh], sketch[fresh], probe[fresh], side[fresh]
    # Index entries stand first in a key's run; each meets all that follow it.
    ends = np.searchsorted(key, key, "right")
    partners = np.where(probe, 0, ends - np.arange(len(key)) - 1)
    rows = np.flatnonzero(partners)
    upto = np.cumsum(partners[rows])
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + 1_000_000, "right")))
        n = partners[rows[at:to]]
        i = np.repeat(rows[at:to], n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        near = (line[i] != line[j]) & ((side[i] == 2) | (side[i] != side[j]))
        i, j = i[near], j[near]
        near = _distance(sketch[i], sketch[j]) <= 2 * TAU
        a, b = line[i[near]], line[j[near]]
        if len(a):
            pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            yield pa.record_batch([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])
        at = to


FOUND = "a long, b long, " + KEYS


def _pairs(block: int):
    """Rows come sorted by key. Runs of at most ``block`` rows give pairs (a, b), longer ones go out as they are."""
    names = ["a", "b", "key", "line", "sketch"]

    def long_rows(parts) -> pa.RecordBatch:
        none = pa.nulls(len(parts[0]), pa.int64())
        return pa.record_batch([none, none, *map(pa.array, parts)], names)

    def settled(key: np.ndarray, line: np.ndarray, sketch: np.ndarray) -> Iterator[pa.RecordBatch]:
        is_long = np.searchsorted(key, key, "right") - np.searchsorted(key, key) > block
        if is_long.any():
            yield long_rows([c[is_long] for c in (key, line, sketch)])
        for pairs in compare(key[~is_long], line[~is_long], sketch[~is_long]):
            none = pa.nulls(pairs.num_rows, pa.int64())
            yield pa.record_batch([*pairs.columns, none, none, none], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size, long_key = 0, None
        for batch in batches:
            parts = [c.to_numpy() for c in batch.columns]
            if long_key is not None and batch.num_rows:
                # The run that went out as long goes on here.
                more = int(np.searchsorted(parts[0], long_key, "right"))
                if more:
                    yield long_rows([c[:more] for c in parts])
                    parts = [c[more:] for c in parts]
                if len(parts[0]):
                    long_key = None
            if not len(parts[0]):
                continue
            held.append(parts)
            size += len(parts[0])
            if size <= 200_000:
                continue
            whole = [np.concatenate(c) for c in zip(*held, strict=True)]
            cut = int(np.searchsorted(whole[0], whole[0][-1]))
            yield from settled(*(c[:cut] for c in whole))
            rest = [c[cut:] for c in whole]
            held, size = [rest], len(rest[0])
            if size > block:
                yield long_rows(rest)
                held, size, long_key = [], 0, int(rest[0][0])
        if held:
            yield from settled(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return run


def dealt_blocks(rows: DataFrame, block: int) -> DataFrame:
    """Rows (key, line, sketch) dealt in pairs of blocks, as (u, line, sketch, side); two rows of a key meet under one u."""
    sizes = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    # Written, so that the join has nothing but exchanges under it and a hot key's partition can be split.
    sizes = materialise(sizes.withColumnRenamed("key", "k"), "line-long-keys")
    out = rows.join(sizes, rows["key"] == sizes["k"]).withColumn("block", F.pmod(F.xxhash64("line"), F.col("blocks")).cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1)
    u = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))
    return out.select(u.alias("u"), "line", "sketch", side.cast("long").alias("side"))


def _block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (u, line, sketch, side) sorted by u; a u has two blocks of rows at most, which are compared when it is complete."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([c.to_numpy() for c in batch.columns])
        whole = [np.concatenate(c) for c in zip(*held, strict=True)]
        cut = int(np.searchsorted(whole[0], whole[0][-1]))
        if cut:
            yield from compare(*(c[:cut] for c in whole))
        held = [[c[cut:] for c in whole]]
    if held:
        yield from compare(*held[0])


def _slot(ids: np.ndarray) -> np.ndarray:
    return (_mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([pa.array(np.unique(_slot(batch.column(0).to_numpy())).astype(np.int32))], ["b"])


def _wanted(bits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.filter(pa.array(bits[_slot(batch.column(0).to_numpy())]))
            if found.num_rows:
                yield found

    return run


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = [within(x.as_py(), y.as_py(), TAU) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
        yield pa.record_batch([c.filter(pa.array(ok, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])


def near_lines(lines: DataFrame, block: int = BLOCK) -> DataFrame:
    """``lines``: line (identity), h (64-bit hash), body. Components (node, component) of lines that have a partner within TAU edits."""
    spark = lines.sparkSession
    keys = lines.select("line", "h", "body").mapInArrow(_keys, KEYS)
    keys = keys.repartition(partitions(spark), "key").sortWithinPartitions("key")
    found = materialise(keys.mapInArrow(_pairs(block), FOUND), "line-found")
    dealt = dealt_blocks(found.filter("a is null").select("key", "line", "sketch"), block)
    dealt = dealt.repartition(partitions(spark), "u").sortWithinPartitions("u")
    pairs = found.filter("a is not null").select("a", "b").union(dealt.mapInArrow(_block_pairs, "a long, b long"))
    pairs = materialise(pairs.distinct(), "line-pairs")
    forget(found)
    ends = materialise(pairs.select(F.col("a").alias("h")).union(pairs.select("b")).distinct(), "line-ends")
    bits = np.zeros(FILTER_BITS, bool)
    # Not more rows than the table has places.
    bits[[r["b"] for r in ends.mapInArrow(_slots, "b int").distinct().toLocalIterator()]] = True
    texts = lines.select("h", "line", "body").mapInArrow(_wanted(bits), f"h long, line {NAME}, body string").dropDuplicates(["h", "line"])
    texts = materialise(texts.join(ends, "h", "left_semi"), "line-texts")
    # Different lines of one 64-bit hash are all candidates.
    side = lambda c: texts.select(F.col("h").alias(c), F.col("line").alias(f"line_{c}"), F.col("body").alias(f"text_{c}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    links = both.select("line_a", "line_b", "text_a", "text_b").mapInArrow(_verified, f"a {NAME}, b {NAME}")
    links = materialise(links, "line-links")
    out = components(links, "line-classes")
    forget(pairs, ends, texts, links)
    return out


def name_of(text: Column | str) -> Column:
    """128 bits of a text: two hashes from different starts (null: null)."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(text.isNotNull(), F.struct(F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")))


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, short: bool = False) -> DataFrame:
    """For each (id, text hash) that loses lines: their numbers from 0, as ``drop``.

    Lines of ``min_chars`` code points go through the edit join. With ``short``, equal
    lines below that which are not blank collapse too.
    """
    keyed = docs.select(F.col("doc_id").alias("id"), name_of("text").alias("h"), F.split("text", "\n").alias("own"))
    rows = keyed.select("id", "h", F.posexplode("own").alias("at", "body"))
    is_long = F.length("body") >= min_chars
    rows = rows.filter(is_long | F.col("body").rlike(r"(?U)\S") if short else is_long).withColumn("line", name_of("body"))
    classes = near_lines(rows.filter(is_long).select("line", F.col("line.h1").alias("h"), "body"))
    place = F.struct(F.col("id").isNull().alias("none"), "id", "h", "at")
    uses = materialise(rows.select("id", "h", "at", "line").distinct(), "line-uses")
    per_line = uses.groupBy("line").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    per_line = per_line.join(classes, per_line["line"] == classes["node"], "left")
    per_line = per_line.select("line", "first", "n", F.coalesce("component", "line").alias("component"))
    per_class = per_line.groupBy("component").agg(F.min("first").alias("keep"), F.sum("n").alias("total")).filter("total > 1")
    lost = materialise(per_line.join(per_class, "component").select("line", "keep"), "line-keepers")
    return uses.join(lost, "line").filter(F.struct(F.col("id").isNull().alias("none"), "id", "h", "at") != F.col("keep")).groupBy("id", "h").agg(
        F.array_sort(F.collect_list("at")).alias("drop")
    )


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, short: bool = False) -> DataFrame:
    """All rows and columns of ``docs``, ``text`` without its dropped lines, and last those lines' numbers (null: none).

    The last column is called ``dropped_lines``, or what ``free_name`` makes of that.
    """
    lost = dropped_lines(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), min_chars, short)
    drop, i, h, own_h = (free_name(docs, c) for c in ("dropped_lines", "lost_id", "lost_hash", "own_hash"))
    lost = lost.select(F.col("id").alias(i), F.col("h").alias(h), F.col("drop").alias(drop))
    own = docs.withColumn(own_h, name_of(F.col("text").cast("string")))
    out = own.join(lost, F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(own_h) == F.col(h)), "left")
    # The numbers that stay, then their lines; the text is split once, into a variable of the outer function.
    kept = lambda lines: F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(drop)), lambda k: F.get(lines, k))
    text = F.transform(F.array(F.split("text", "\n")), lambda lines: F.array_join(kept(lines), "\n"))[0]
    text = F.when(F.col(drop).isNull(), F.col("text")).otherwise(text)
    return out.select(*(text.alias("text") if c == "text" else F.col(c) for c in docs.columns), drop)


def report(docs: DataFrame) -> DataFrame:
    """One row per document row: doc_id, n_lines, n_dropped, the dropped numbers, and digests of the text that stays."""
    out = dedup_lines(docs.select("doc_id", "text", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n")), short=True)
    drop = out.columns[-1]
    return out.select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.col("n")).cast("long").alias("n_lines"),
        F.coalesce(F.size(drop), F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce(F.array_join(drop, ","), F.lit("")).alias("dropped"),
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("text", 256).alias("text_sha256"),
    )
