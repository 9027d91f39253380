"""N-gram Jaccard join by grouped prefixes.

Every document is the set of its distinct 5-word shingles (64-bit hashes of all
their words), ordered by one global order: shingles that many documents of a
chunk share come last, by how often they occur. Two sets with a Jaccard
similarity of at least 3/4 share a shingle among the first n - ceil(3n/4) + 1.
Documents with the same prefix and size form one group; only groups are joined:

1. Prefix entries (shingle, group, size, position) are dealt by shingle and
   streamed in order; entries whose shingle one group alone has are dropped. A
   list of few groups becomes their pairs at once, longer lists stay lists.
   Entries of heavy shingles are dealt by group instead and all stay.
2. Each shingle's first group is the centre of a star (linear in the list), and
   every group is tried with the centres it shares most shingles with: their
   members are compared by counts of hashed shingles, which bound the overlap,
   then verified on the whole texts; verified links form components.
3. Pairs of groups and entries of long lists meet again, but only across different
   components: copies and near copies already linked produce no pairs, everything
   else is verified, so no link between different components is lost. A list is cut into
   blocks and dealt by pairs of blocks, and two blocks of the component that most
   of the list belongs to are never paired.

Equal sets are one class, known by 126 bits of a hash of the set; a verified pair
is compared word by word, not by hashes. The global order is a heuristic that only
speeds things up: any fixed order gives the same result, so the table of frequent
shingles has a fixed bound (``MAX_HOT``).

Defined cases: null and empty texts have no shingles and link with nothing; texts
of one to four words are one shingle; a null id never becomes a component id
unless all ids of the component are null; repeated rows are reported one by one;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import components, forget, free_name, materialise, partitions, start_task

WORDS = 5
# Similarity of at least 3/4, as whole numbers.
NUM, DEN = 3, 4
LOCAL_HOT = 4  # documents of one chunk that make a shingle frequent
MAX_HOT = 200_000
HEAVY = 1_000  # hits that make a frequent shingle heavy
HEAVY_MARK = 1 << 61
CHUNK = 2_000_000
NO_ID = -(1 << 63)
FILTER_BITS = 1 << 22, 1 << 27  # least and most places of the table of wanted ids
LOAD = 8  # mean count of a sketch's bucket, at most
SKETCH_BYTES = 16 << 20  # compared at once
BLOCK = 4_096  # rows of a list that meet in one task
CENTRES = 3
FEW = 16  # groups of a list that is turned into pairs at once
NEAR = 256  # rows of a list that is dealt by its least class, so that lists of the same classes meet
PRODUCT = 64  # classes times classes of a pair of groups that is expanded by a join
PAIR, STAR, SPREAD = -4, -2, -10  # marks of pairs of groups, of those with a centre, and of heavy entries
_MULT = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(29))


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct shingle hashes; white space is that of ASCII, A-Z is lower-cased."""
    words = text.lower().split() if text else []
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    width = min(n, WORDS)
    total = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        total += h[k : n - width + 1 + k] * _MULT[k]
    return np.unique(_mix(total))


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def class_of(s: np.ndarray) -> bytes:
    """126 bits of the set's hash: equal sets have equal classes."""
    whole = xxhash.xxh3_128_intdigest(s.tobytes())
    return (whole & ~(3 << 62)).to_bytes(16, "big")


def sketch(s: np.ndarray) -> bytes:
    """How many of the set's hashes fall in each bucket, 255 at most; buckets are a power of two, for LOAD hashes or fewer."""
    size = 16
    while size * LOAD < len(s):
        size *= 2
    counts = np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


class Sketches:
    """Sketches of many sets; ``may_be_similar`` never rejects a pair that reaches 3/4."""

    def __init__(self, column: list[bytes], n: np.ndarray):
        self.n = n
        width = np.fromiter(map(len, column), np.int64, len(column))
        self.level = np.zeros(len(column), np.int64)
        self.row = np.zeros(len(column), np.int64)
        self.tables: list[np.ndarray] = []
        for size in np.unique(width):
            own = np.flatnonzero(width == size)
            self.level[own], self.row[own] = len(self.tables), np.arange(len(own))
            self.tables.append(np.frombuffer(b"".join(column[k] for k in own), np.uint8).reshape(-1, size))

    def counts(self, level: int, rows: np.ndarray, size: int) -> np.ndarray:
        found = self.tables[level][self.row[rows]]
        if found.shape[1] == size:
            return found
        return found.reshape(len(rows), -1, size).sum(axis=1, dtype=np.int32)

    def may_be_similar(self, i: np.ndarray, other: Sketches, j: np.ndarray) -> np.ndarray:
        """Sets share no more than their buckets do, and what a full bucket does not count."""
        out = np.zeros(len(i), bool)
        kind = self.level[i] * len(other.tables) + other.level[j]
        for k in np.unique(kind):
            pairs = np.flatnonzero(kind == k)
            x, y = divmod(int(k), len(other.tables))
            size = min(self.tables[x].shape[1], other.tables[y].shape[1])
            step = max(1, SKETCH_BYTES // max(self.tables[x].shape[1], other.tables[y].shape[1]))
            for at in range(0, len(pairs), step):
                own = pairs[at : at + step]
                na, nb = self.n[i[own]], other.n[j[own]]
                ca, cb = self.counts(x, i[own], size), other.counts(y, j[own], size)
                over = np.minimum(na - ca.sum(axis=1, dtype=np.int64), nb - cb.sum(axis=1, dtype=np.int64))
                most = np.minimum(ca, cb).sum(axis=1, dtype=np.int64) + over
                out[own] = (NUM + DEN) * most >= NUM * (na + nb)
        return out


def prefix_length(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1


def similar(a: bytes, b: bytes) -> bool:
    """Whether two texts reach 3/4, compared by their words themselves."""
    a, b = a.lower().split(), b.lower().split()
    if min(len(a), len(b)) < WORDS:
        return bool(a) and a == b
    ids: dict[bytes, int] = {}
    words = np.fromiter((ids.setdefault(w, len(ids)) for w in (*a, *b)), np.int64, len(a) + len(b))
    code, base = words[: 1 - WORDS], len(ids)
    for k in range(1, WORDS):
        # Codes are renumbered before they could overflow, so that equal codes mean equal words.
        if (int(code.max()) + 1) * base >= 1 << 62:
            code = np.unique(code, return_inverse=True)[1]
        code = code * base + words[k : len(words) - WORDS + 1 + k]
    x, y = np.unique(code[: len(a) - WORDS + 1]), np.unique(code[len(a) :])
    both = len(np.intersect1d(x, y, assume_unique=True))
    return DEN * both >= NUM * (len(x) + len(y) - both)


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n, class) of every row, and (hot, hits) of the chunk's frequent shingles."""
    names = ["doc_id", "n", "cls", "sketch", "hot", "hits"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
    start_task("jaccard_join")
    held: list[np.ndarray] = []
    size = 0

    def frequent() -> pa.RecordBatch:
        value, count = np.unique(np.concatenate(held), return_counts=True)
        own = count >= LOCAL_HOT
        m = int(own.sum())
        return pa.record_batch([*(pa.nulls(m, k) for k in kinds[:4]), pa.array(value[own].view(np.int64)), pa.array(count[own])], names)

    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        n, cls, sketches = [], [], []
        for t in texts:
            s = shingles(t.as_py())
            n.append(len(s))
            cls.append(class_of(s) if len(s) else None)
            sketches.append(sketch(s) if len(s) else None)
            held.append(s)
            size += len(s)
            if size > CHUNK:
                yield frequent()
                held, size = [], 0
        m = batch.num_rows
        yield pa.record_batch([batch.column(0), pa.array(n, kinds[1]), pa.array(cls, kinds[2]), pa.array(sketches, kinds[3]), *(pa.nulls(m, k) for k in kinds[4:])], names)
    if held:
        yield frequent()


def _entries(hot: np.ndarray, hits: np.ndarray):
    """Rows (k, v, m): a prefix entry (shingle, group, position << 32 | size) or a member of a group.

    Entries of heavy shingles have HEAVY_MARK added to m. A member is (group, first half
    of its class, -1 - second half), the second half having 62 bits.
    """
    heavy = hot[hits >= HEAVY]

    def ordered(s: np.ndarray) -> np.ndarray:
        if not len(hot):
            return s
        at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
        weight = np.where(hot[at] == s, hits[at], 0)
        return s[np.lexsort((s, weight))] if weight.any() else s

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_task("jaccard_join")
        seen: set[tuple[int, bytes]] = set()
        groups: set[int] = set()
        for batch in batches:
            texts = batch.column(0).cast(pa.binary())
            k, v, m = [], [], []
            for t in texts:
                s = shingles(t.as_py())
                n = len(s)
                if not n:
                    continue
                head = ordered(s)[: prefix_length(n)]
                weight = np.isin(head, heavy) * HEAVY_MARK if len(heavy) else 0
                head = head.view(np.int64)
                group, cls = _signed(xxhash.xxh3_64_intdigest(head.tobytes(), seed=n & 0xFFFFFFFF)), class_of(s)
                if (group, cls) in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                    groups.clear()
                seen.add((group, cls))
                k.append(np.array([group]))
                v.append(np.array([int.from_bytes(cls[:8], "big", signed=True)]))
                m.append(np.array([-1 - int.from_bytes(cls[8:], "big")]))
                if group not in groups:
                    groups.add(group)
                    k.append(head)
                    v.append(np.full(len(head), group))
                    m.append((np.arange(len(head)) << 32) + n + weight)
            if k:
                yield pa.record_batch([pa.array(np.concatenate(c).astype(np.int64, copy=False)) for c in (k, v, m)], ["k", "v", "m"])

    return run


def _possible(na, pa_, nb, pb):
    """Length and positional filter, on columns or arrays: can the pair reach 3/4 from this shared shingle on?"""
    least = np.minimum(na - pa_, nb - pb)
    return (NUM * np.maximum(na, nb) <= DEN * np.minimum(na, nb)) & ((NUM + DEN) * least >= NUM * (na + nb))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (k, m, v). Rows (k, v, m, class) go out:

    (group, 0, -1, class) a member; (shingle, group, position << 32 | size) an entry of a list
    of more than FEW groups or of a heavy shingle, the latter also with SPREAD - m for m;
    (group, group, STAR) a list's first group with each other, and (group, group, PAIR) all
    other pairs of a list of at most FEW groups, if length and position allow the pair.

    A star's centre has the shingle earliest in its prefix: it has the fewest rare shingles of its
    own. A run may span batches: of a run still open, at most FEW rows are held, or its first row.
    """
    held = [np.zeros(0, np.int64)] * 3  # of the open run: all its rows, or the first of a long one
    long_run = False
    last = None

    def out(k, v, m, cls: pa.Array | None = None):
        numbers = [pa.array(np.asarray(c, np.int64)) for c in (k, v, m)]
        return pa.record_batch([*numbers, pa.nulls(len(k), pa.binary()) if cls is None else cls], ["k", "v", "m", "cls"])

    def paired(v, m, i, j, mark):
        ok = _possible(m[i] & 0xFFFFFFFF, m[i] >> 32, m[j] & 0xFFFFFFFF, m[j] >> 32)
        i, j = i[ok], j[ok]
        return out(v[i], v[j], np.broadcast_to(mark, len(ok))[ok])

    def runs(k, v, m, end: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, long_run
        k, v, m = (np.concatenate(c) for c in zip(held, (k, v, m), strict=True))
        if not len(k):
            return
        head = np.flatnonzero(np.diff(k, prepend=k[0] - 1))
        size = np.diff(np.append(head, len(k)))
        is_long = size > FEW
        is_long[0] |= long_run
        of = np.repeat(np.arange(len(head)), size)
        done = np.ones(len(head), bool)
        if not end and not is_long[-1]:
            done[-1] = False  # may still grow
        rows = np.flatnonzero((is_long & done)[of])
        fresh = rows[1:] if long_run and len(rows) else rows  # the held first row of a long run went out before
        yield out(k[fresh], v[fresh], m[fresh])
        star = fresh[fresh != head[of[fresh]]]
        yield paired(v, m, head[of[star]], star, STAR)
        rows = np.flatnonzero((~is_long & done)[of])
        rest = (head + size)[of[rows]] - rows - 1
        i = np.repeat(rows, rest)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(rest) - rest, rest)
        yield paired(v, m, i, j, np.where(i == head[of[i]], STAR, PAIR))
        long_run = bool(is_long[-1])
        keep = slice(head[-1], head[-1] + 1) if long_run else slice(head[-1], None)
        held = [c[keep] for c in (k, v, m)]

    for batch in batches:
        if not batch.num_rows:
            continue
        k, v, m = (c.to_numpy() for c in batch.columns)
        member, heavy = m < 0, m >= HEAVY_MARK
        halves = np.stack([v[member], -1 - m[member]], 1).astype(">i8").tobytes()
        classes = pa.array([halves[at : at + 16] for at in range(0, len(halves), 16)], pa.binary())
        none = np.zeros(len(classes), np.int64)
        yield out(k[member], none, none - 1, classes)
        yield out(k[heavy], v[heavy], m[heavy] - HEAVY_MARK)
        yield out(k[heavy], v[heavy], SPREAD - m[heavy] + HEAVY_MARK)
        light = ~(member | heavy)
        k, v, m = k[light], v[light], m[light]
        if not len(k):
            continue
        fresh = np.ones(len(k), bool)  # the first row of each (k, v)
        fresh[1:] = (k[1:] != k[:-1]) | (v[1:] != v[:-1])
        fresh[0] = (int(k[0]), int(v[0])) != last
        last = (int(k[-1]), int(v[-1]))
        yield from runs(k[fresh], v[fresh], m[fresh], False)
    yield from runs(*[np.zeros(0, np.int64)] * 3, True)


def _fetch(bits: np.ndarray):
    """(class, text) of rows whose id may be wanted, by a table of id hashes.

    Ids need not be unique: the text decides which class a row belongs to.
    """
    places = len(bits) * 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy() & (places - 1)
            own = pa.array((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)
            texts = batch.column(1).filter(own)
            cls = [class_of(s) if len(s := shingles(t.as_py())) else None for t in texts.cast(pa.binary())]
            if len(texts):
                yield pa.record_batch([pa.array(cls, pa.binary()), texts], ["cls", "text"])

    return run


def _id_bits(wanted: DataFrame) -> np.ndarray:
    """A table with a bit for each wanted id's hash ``h``; its size follows their number up to a bound."""
    count, size = wanted.count(), FILTER_BITS[0]
    while size < min(8 * count, FILTER_BITS[1]):
        size *= 2
    place = F.col("h").bitwiseAND(F.lit(size - 1))
    maps = wanted.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    bits = np.zeros(size // 8, np.uint8)
    # Not more rows than the table has pages of 4 KB.
    for r in maps.toLocalIterator():
        page = np.frombuffer(bytes(r["bits"]), np.uint8)
        # Place p has page (p - 1) // 32768 + 1 and bit (p - 1) % 32768 for p > 0, page 0 and bit -p else.
        where = np.flatnonzero(np.unpackbits(page, bitorder="little"))
        p = where + (r["b"] - 1) * 32_768 + 1 if r["b"] > 0 else -where
        np.bitwise_or.at(bits, p >> 3, (1 << (p & 7)).astype(np.uint8))
    return bits


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ta, tb = batch.column(2).cast(pa.binary()), batch.column(3).cast(pa.binary())
        ok = [similar(x.as_py(), y.as_py()) for x, y in zip(ta, tb, strict=True)]
        yield pa.record_batch([*batch.columns[:2], pa.array(ok, pa.bool_())], ["a", "b", "ok"])


def _may_be_similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, na, nb, sketch of a, sketch of b): the pairs that their sketches allow."""
    for batch in batches:
        na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        a, b = Sketches(batch.column(4).to_pylist(), na), Sketches(batch.column(5).to_pylist(), nb)
        every = np.arange(batch.num_rows)
        ok = pa.array(a.may_be_similar(every, b, every), pa.bool_())
        yield pa.record_batch([c.filter(ok) for c in batch.columns[:2]], ["a", "b"])


def _whole_runs(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of at least ``rows`` rows (but the last) that never cut a run of the first column."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        cut = int(np.flatnonzero(keys == keys[-1])[0])
        if size > rows and (cut or held[-1].column(0)[-1].as_py() != int(keys[0])):
            held.append(batch.slice(0, cut))
            yield pa.Table.from_batches(held).combine_chunks()
            held, size, batch = [], 0, batch.slice(cut)
        held.append(batch)
        size += batch.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def dealt_blocks(own: DataFrame) -> DataFrame:
    """Deal lists (k, component, cls, ...) in pairs of blocks of about BLOCK rows; lists of one component go.

    Adds ``u``, whose rows have to come together, ``deal``, the key to deal by, and ``side``:
    rows of sides 0 and 1 of one ``u`` meet, and rows of side 2 meet each other. Two rows of one k in different components meet under
    exactly one u. The component with most rows of a list has blocks of its own, which do not
    meet each other; a list of one block is its own pair.
    """
    sizes = own.groupBy("k", "component").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("n"), F.min("cls").alias("cls"))
    lists = sizes.groupBy("k").agg(
        F.min("cls").alias("low"), F.sum("c").alias("all"), F.max(F.struct("c", "component")).alias("top"), F.count(F.lit(1)).alias("many"), F.min("n").alias("least")
    ).filter("many > 1")
    blocks = lambda rows: F.ceil(rows / BLOCK).cast("int")
    lists = lists.select(
        F.col("k").alias("lk"), "least", F.col("top.component").alias("top"), F.when(F.col("all") <= NEAR, F.xxhash64("low")).alias("deal"),
        F.when(F.col("all") <= BLOCK, 0).otherwise(blocks(F.col("top.c"))).alias("bt"),
        F.when(F.col("all") <= BLOCK, 1).otherwise(blocks(F.col("all") - F.col("top.c"))).alias("br"),
    )
    # Written, so that the join below has nothing but exchanges under it and a hot list's partition can be split.
    lists = materialise(lists, "list-sizes")
    # An entry so late in its prefix that not even the list's smallest set could reach 3/4 with it cannot be a pair's first.
    rows = own.join(lists, own["k"] == lists["lk"]).filter(F.coalesce((NUM + DEN) * (F.col("n") - F.col("p")) >= NUM * (F.col("n") + F.col("least")), F.lit(True)))
    is_top = (F.col("component") == F.col("top")) & (F.col("bt") > 0)
    h = F.xxhash64("cls")
    rows = rows.withColumn("block", F.when(is_top, F.pmod(h, F.greatest("bt", F.lit(1)))).otherwise(F.col("bt") + F.pmod(h, F.col("br"))).cast("int"))
    others = F.when(is_top, F.sequence("bt", F.col("bt") + F.col("br") - 1)).otherwise(F.sequence(F.lit(0), F.col("bt") + F.col("br") - 1))
    rows = rows.withColumn("other", F.explode(others))
    side = F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1)
    return rows.withColumns({"u": F.xxhash64("k", F.least("block", "other"), F.greatest("block", "other")), "side": side}).withColumn("deal", F.coalesce("deal", "u")).drop("lk", "least", "top", "bt", "br", "block", "other")


def _cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (u, side, n, p, component, cls, sketch) sorted by u: pairs that meet, of different components, that may be similar."""

    told: set[tuple[int, int]] = set()  # hashes of pairs that went out; a pair may go out again

    def compare(table: pa.Table) -> Iterator[pa.RecordBatch]:
        u, side, n, p = (table.column(c).to_numpy() for c in range(4))
        component = table.column(4).combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
        cls = table.column(5).combine_chunks()
        code = np.frombuffer(b"".join(cls.to_pylist()), ">i8")[::2].astype(np.int64)  # half of a class, for telling pairs apart
        sketches = Sketches(table.column(6).to_pylist(), n)
        order = np.lexsort((component, u))
        u, component = u[order], component[order]
        # Partners are what follows of the run, beyond the row's own component.
        run = np.cumsum(np.diff(u, prepend=u[0] - 1) != 0)
        same = run * (int(component.max()) + 1) + component
        ends, begin = np.searchsorted(run, run, "right"), np.searchsorted(same, same, "right")
        partners = ends - begin
        rows = np.flatnonzero(partners)
        upto = np.cumsum(partners[rows])
        at = 0
        while at < len(rows):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + 200_000, "right")))
            many = partners[rows[at:to]]
            i = np.repeat(rows[at:to], many)
            j = np.repeat(begin[rows[at:to]], many) + np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
            i, j = order[i], order[j]
            ok = ((side[i] == 2) | (side[i] != side[j])) & _possible(n[i], p[i], n[j], p[j])
            i, j = i[ok], j[ok]
            ok = sketches.may_be_similar(i, sketches, j)
            i, j = i[ok], j[ok]
            # Pairs that several lists gave go out once.
            low, high = np.minimum(code[i], code[j]), np.maximum(code[i], code[j])
            pair, own = np.unique(np.stack([low, high], 1), axis=0, return_index=True)
            if len(told) > 500_000:
                told.clear()
            new = [x not in told for x in map(tuple, pair.tolist())]
            told.update(map(tuple, pair.tolist()))
            own = own[np.array(new, bool)]
            if len(own):
                yield pa.record_batch([cls.take(pa.array(i[own])), cls.take(pa.array(j[own]))], ["a", "b"])
            at = to

    start_task("jaccard_join")
    for table in _whole_runs(batches, 20_000):
        yield from compare(table)


def link_classes(texts: DataFrame, profile: DataFrame, hot: np.ndarray, hits: np.ndarray) -> DataFrame:
    """Components of classes (node, component) under verified links; unlinked classes are left out."""
    spark = texts.sparkSession
    rows = texts.select("text").mapInArrow(_entries(hot, hits), "k long, v long, m long")
    # A heavy shingle's entries need not meet here, so they are dealt by group.
    rows = rows.repartition(partitions(spark), F.when(F.col("m") >= HEAVY_MARK, F.col("v")).otherwise(F.col("k"))).sortWithinPartitions("k", "m", "v")
    rows = materialise(rows.mapInArrow(_shared, "k long, v long, m long, cls binary"), "prefix-lists")
    members = materialise(rows.filter("m = -1").select(F.col("k").alias("g"), "cls").distinct(), "group-members")
    rep = profile.filter("n > 0").groupBy("cls").agg(
        F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")
    )
    rep = materialise(rep, "classes")

    def verify(pairs: DataFrame, label: str) -> DataFrame:
        """Which (a, b) are similar: by their sketches, then by their whole texts; pairs that sketches exclude go."""
        side = lambda c: rep.select(F.col("cls").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
        pairs = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb")
        pairs = materialise(pairs.mapInArrow(_may_be_similar, "a binary, b binary"), f"{label}-possible")
        ends = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
        wanted = materialise(rep.select("cls", F.xxhash64("id").alias("h")).join(ends, "cls"), f"{label}-wanted")
        keyed = texts.select(F.xxhash64(F.coalesce("doc_id", F.lit(NO_ID))).alias("h"), "text")
        found = keyed.mapInArrow(_fetch(_id_bits(wanted)), "cls binary, text string")
        found = found.join(wanted.select("cls"), "cls", "left_semi").dropDuplicates(["cls"])
        with_b = pairs.join(found.select(F.col("cls").alias("b"), F.col("text").alias("tb")), "b")
        both = with_b.join(found.select(F.col("cls").alias("a"), F.col("text").alias("ta")), "a")
        out = materialise(both.select("a", "b", "ta", "tb").mapInArrow(_checked, "a binary, b binary, ok boolean"), f"{label}-checked")
        forget(wanted, pairs)
        return out

    # The first member of a group stands for it; what the others alone would link is found below.
    first = materialise(members.groupBy("g").agg(F.min("cls").alias("a"), F.count(F.lit(1)).alias("many")), "groups")

    def expand(groups: DataFrame) -> DataFrame:
        """For pairs of groups (ga, gb), the first member of one with each member of the other."""
        one = first.select(F.col("g").alias("ga"), "a")
        return groups.join(one, "ga").join(members.select(F.col("g").alias("gb"), F.col("cls").alias("b")), "gb").select("a", "b")

    # A group is tried first with the star centre that it shares most prefix shingles with.
    stars = rows.filter(F.col("m") == STAR).select(F.col("k").alias("ga"), F.col("v").alias("gb"))
    heavy = rows.filter(F.col("m") <= SPREAD).select("k", F.col("v").alias("gb"), (F.lit(SPREAD) - F.col("m")).alias("m"))
    # One row for each heavy shingle, of which there are MAX_HOT at most.
    heads = heavy.groupBy("k").agg(F.min(F.struct("m", "gb")).alias("head")).select("k", F.col("head.gb").alias("ga"), F.col("head.m").alias("hm"))
    size, place = lambda m: F.col(m).bitwiseAND(F.lit(0xFFFFFFFF)), lambda m: F.shiftright(m, 32)
    reach = (NUM + DEN) * F.least(size("m") - place("m"), size("hm") - place("hm")) >= NUM * (size("m") + size("hm"))
    stars = stars.union(heavy.join(F.broadcast(heads), "k").filter((F.col("ga") != F.col("gb")) & reach).select("ga", "gb"))
    best = Window.partitionBy("gb").orderBy(F.desc("count"), "ga")
    stars = stars.groupBy("ga", "gb").count().withColumn("try", F.row_number().over(best)).filter(F.col("try") <= CENTRES)
    stars = materialise(stars, "stars")
    several = first.filter("many > 1")
    inside = members.join(several, "g").select("a", F.col("cls").alias("b"))
    pairs = materialise(expand(stars.filter("try = 1")).union(inside).filter("a <> b").distinct(), "star-pairs")
    one = verify(pairs, "star")
    known = components(one.filter("ok"), "star-components")

    def apart(pairs: DataFrame) -> DataFrame:
        """Pairs of classes that no links join so far."""
        root = lambda c: known.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
        pairs = pairs.join(root("a"), "a", "left").join(root("b"), "b", "left")
        return pairs.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")

    again = materialise(apart(expand(stars.filter("try > 1")).filter("a <> b").distinct()), "star-pairs-2")
    two = verify(again, "star-2")
    links = one.filter("ok").union(two.filter("ok"))
    known = components(links, "star-components-2")

    # Pairs of groups from short lists: few classes are paired by a join, many go the way of long lists.
    groups = rows.filter(F.col("m").isin(STAR, PAIR)).select(F.least("k", "v").alias("ga"), F.greatest("k", "v").alias("gb")).distinct()
    for c in ("ga", "gb"):
        groups = groups.join(first.select(F.col("g").alias(c), F.col("a").alias(f"first_{c}"), F.col("many").alias(f"many_{c}")), c)
    groups = materialise(groups, "group-pairs")
    single = F.col("many_ga") * F.col("many_gb") == 1
    crowded = F.col("many_ga") * F.col("many_gb") > PRODUCT
    alone = groups.filter(single).select(F.col("first_ga").alias("a"), F.col("first_gb").alias("b"))
    small = groups.filter(~single & ~crowded)
    for c, to in (("ga", "a"), ("gb", "b")):
        small = small.join(members.select(F.col("g").alias(c), F.col("cls").alias(to)), c)
    few = apart(alone.union(small.select("a", "b")).filter("a <> b"))
    placed = members.join(known, members["cls"] == known["node"], "left")
    placed = placed.select("g", "cls", F.coalesce("component", "cls").alias("component"))
    lists = rows.filter("m >= 0").select("k", F.col("v").alias("g"), size("m").alias("n"), place("m").alias("p"))
    # A group whose members fell apart is paired inside as well.
    free = lambda k, g: (k.alias("k"), g.alias("g"), F.lit(None).cast("long").alias("n"), F.lit(0).cast("long").alias("p"))
    own = several.select(*free(F.col("g"), F.col("g")))
    wide = groups.filter(crowded).select(F.xxhash64("ga", "gb").alias("k"), F.explode(F.array("ga", "gb")).alias("g"))
    lists = lists.union(own).union(wide.select(*free(F.col("k"), F.col("g"))))
    lists = materialise(lists.join(placed, "g").select("k", "n", "p", "cls", "component"), "lists")
    dealt = dealt_blocks(lists).drop("n").join(rep.select("cls", "n", "sketch"), "cls").select("deal", "u", "side", "n", "p", "component", "cls", "sketch")
    dealt = dealt.repartition(partitions(spark), "deal").drop("deal").sortWithinPartitions("u")
    pair = few.union(dealt.mapInArrow(_cross, "a binary, b binary")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    checked = one.union(two).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = materialise(pair.distinct().join(checked, ["a", "b"], "left_anti"), "cross-pairs")
    forget(rows, lists, members, groups, first)
    three = verify(rest, "cross")
    out = components(links.union(three.filter("ok")), "components")
    forget(pairs, stars, again, rest, one, two, three, rep)
    return out


def jaccard_components(docs: DataFrame) -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = materialise(texts.mapInArrow(_profile, "doc_id long, n long, cls binary, sketch binary, hot long, hits long"), "profile")
    profile = rows.filter("hot is null").select("doc_id", "n", "cls", "sketch")
    top = rows.filter("hot is not null").groupBy("hot").agg(F.sum("hits").alias("hits")).orderBy(F.desc("hits"), "hot").limit(MAX_HOT)
    table = top.toPandas()
    hot, hits = table["hot"].to_numpy(np.int64).view(np.uint64), table["hits"].to_numpy(np.int64)
    order = np.argsort(hot)
    linked = link_classes(texts, profile, hot[order], hits[order])
    own = profile.filter("n > 0")
    classes = own.groupBy("cls").agg(F.min("doc_id").alias("low")).join(linked, F.col("cls") == F.col("node"), "left")
    classes = materialise(classes.select("cls", "low", F.coalesce("component", "cls").alias("key")), "class-components")
    least = classes.groupBy("key").agg(F.min("low").alias("component_id"))
    # Written, so that the join has nothing but exchanges under it and a hot class's partition can be split.
    told = materialise(classes.join(least, "key").select("cls", "component_id"), "class-ids")
    forget(classes)
    out = own.join(told, "cls").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.union(profile.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents that stay: the least id of every component, with all their columns; rows that share an id share their fate."""
    found = jaccard_components(docs)
    name = free_name(docs, "stay")
    stay = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(stay, docs["doc_id"].eqNullSafe(F.col(name)), "left_semi")
