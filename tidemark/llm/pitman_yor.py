"""Language-model scoring with a hierarchical Pitman-Yor model.

A word is drawn from the restaurant of the word directly before it; every training
word, and the beginning of a text, has one. New tables there take their dish from
the leaf of the text so far. Leaves are built from the last word before that is
among the ``SHORT`` most frequent training words:

    word  (the word directly before)       backs off to the leaf
    leaf  (that frequent word, whether it stands directly before)
    mid   (that word)                      parent of two leaves
    root  (no context)                     parent of every mid restaurant

Customers of a word's restaurant are the training words after it. Customers of a
leaf are the training words too, not the tables of the restaurants below: these take
the leaf's predictive probability as their base. Above that, every table sends a
customer to the parent, and the root draws from a diffuse base whose mass is that of all unseen
words together (one symbol, as in the add-one base model). Seating arrangements
are sampled by Gibbs sweeps that take customers from their tables and seat them
again; the predictive probabilities of ``SAMPLES`` sweeps are averaged, and their
logarithms give a text's score and its perplexity.

Distribution: texts are tokenised once and stored in chunks of bounded size. The
restaurants of words are dealt by hash of the word, those of frequent words in slices
by hash of the word after it, so none is too hot; a chunk asks once for each of its
pairs of words and gets back their customers and tables. Words are known there by
64-bit hashes. Sampling takes a word's mean share in the chunks that hold a pair for
its parent probability, and a slice's tables times the number of slices for a hot
restaurant's; prediction uses the leaf's probabilities and exact totals. At most
``TOP`` contexts are hot, and only their table totals reach the driver.

In the levels above, a restaurant's dishes are independent given its table total, so
the work is dealt by word, not by context, and no context is too hot. Sweeps of one
batch of words estimate a restaurant's total by that batch's own, scaled by the
number of words (hashing makes batches alike); prediction uses exact totals. A
chunk asks once for each of its distinct
words, gets back the probabilities it needs and scores its documents. What is
collected at the driver has a fixed size (totals of the restaurants, and the short
and hot lists, taken from each chunk's ``TOP`` most frequent words).

Defined cases: null and empty texts are the end token alone; a null id counts as
empty text for the folds; repeated rows are scored one by one, and train as often
as they occur; without training rows every token has probability 1 in the model;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fold, forget, materialise, partitions, start_task

SHORT = 16
TOP = 10_000  # most frequent words that a chunk reports
HOT = 500_000  # tokens of a context in one slice, about
SLICE_BITS = 8  # a context has at most 2^8 slices
BUCKET = 2_000_000  # tokens in one bucket of contexts, about
LEAVES = 2 * (SHORT + 1)
MIDS = SHORT + 1
BURN, SAMPLES = 1, 3
DISCOUNT, STRENGTH = 0.75, 1.0
CHUNK_BYTES = 12 << 20  # a chunk then has fewer than 2^24 tokens
BATCH_CELLS = 400_000
REFS = 1_024  # chunks named in one row of a word
END = " "  # no word holds white space


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, size = [], 0
    for batch in batches:
        at = 0
        lengths = np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        while at < batch.num_rows:
            before = lengths[at - 1] if at else 0
            to = min(batch.num_rows, int(np.searchsorted(lengths, before + CHUNK_BYTES - size, "left")) + 1)
            held.append(batch.slice(at, to - at))
            size += int(lengths[to - 1] - before)
            at = to
            if size >= CHUNK_BYTES:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _words(texts: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, each token's place among them, and tokens per text; white space is that of ASCII."""
    lower = pc.ascii_lower(pc.fill_null(texts, "").combine_chunks())
    split = pc.ascii_split_whitespace(lower)
    flat = split.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    some = full.to_numpy(zero_copy_only=False)
    bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
    n = np.diff(np.concatenate([[0], np.cumsum(some)])[bounds])
    coded = flat.filter(full).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), n


def _binaries(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Slices of ``data`` at ``bounds`` (in items) as a binary array."""
    offsets = pa.py_buffer((bounds * data.itemsize).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, offsets, pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def _planes(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Slices of numbers below 2^24 as three byte planes each: most high bytes are zero and compress away."""
    parts = data.astype("<i4").view(np.uint8).reshape(-1, 4)
    n = np.diff(bounds)
    at = np.repeat(2 * bounds[:-1], n) + np.arange(len(data))
    step = np.repeat(n, n)
    out = np.empty(3 * len(data), np.uint8)
    for k in range(3):
        out[at + k * step] = parts[:, k]
    return _binaries(out, 3 * bounds)


def _unplaned(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, bounds = _flat(column, np.uint8)
    bounds = bounds // 3
    n = np.diff(bounds)
    at = np.repeat(2 * bounds[:-1], n) + np.arange(bounds[-1])
    step = np.repeat(n, n)
    return sum(data[at + k * step].astype(np.int32) << 8 * k for k in range(3)), bounds


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed binary, numbers of up to four bytes as byte planes."""
    planes = [x if x.itemsize == 8 else x.view(np.uint8).reshape(len(x), x.itemsize).T for x in arrays]
    return pa.Codec("zstd", 1).compress(b"".join(x.tobytes() for x in planes), asbytes=True)


def _unpacked(data: bytes, kinds: list[type], lengths: list[int]) -> list[np.ndarray]:
    widths = [np.dtype(k).itemsize for k in kinds]
    raw = np.frombuffer(pa.Codec("zstd").decompress(data, sum(w * n for w, n in zip(widths, lengths, strict=True)), asbytes=True), np.uint8)
    out, at = [], 0
    for kind, width, n in zip(kinds, widths, lengths, strict=True):
        part = raw[at : at + width * n]
        out.append((part if width == 8 else np.ascontiguousarray(part.reshape(width, n).T)).reshape(-1).view(kind))
        at += width * n
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pairs(token: np.ndarray, begin: np.ndarray, code: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Each token's pair as one number: the word before it (texts begin after an end), the slice, the word.

    Words are places in the chunk; a context of ``bits`` b has 2^b slices, by the leading bits of the word's ``code``.
    """
    before = np.zeros(len(token), np.int32)
    before[1:] = token[:-1]
    before[begin] = 0
    keys = code[token] >> (SLICE_BITS - bits).astype(np.int64)[before]
    keys <<= 24
    keys |= token
    return keys | (before.astype(np.int64) << 32)


def _asks(keys: np.ndarray, cnt: np.ndarray, share: np.ndarray, hashes: np.ndarray, log_buckets: int) -> Iterator[tuple[int, int, int, bytes]]:
    """A chunk's pairs (``keys``, sorted) by bucket of their slice of a context: (bucket, slices, pairs, packed)."""
    unit = keys >> 24
    heads = np.flatnonzero(np.diff(unit, prepend=-1))
    unit, n = unit[heads], np.diff(np.append(heads, len(keys)))
    spread = _mixed(hashes[unit >> 8] + (unit & 255).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    bucket = (spread >> np.uint64(64 - log_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    unit, heads, n, bucket = unit[order], heads[order], n[order], bucket[order]
    del spread, order
    ends = np.cumsum(n)
    at = np.repeat(heads - (ends - n), n) + np.arange(len(keys))
    word = keys[at] & 0xFFFFFF
    near, cnt = np.clip(np.round(-4 * np.log2(share)), 0, 255).astype(np.uint8)[word], cnt[at]
    del keys, at
    word = hashes[word]
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    for lo, hi in zip(cuts, np.append(cuts[1:], len(unit)), strict=True):
        own = slice(ends[lo] - n[lo], ends[hi - 1])
        packed = _packed(unit[lo:hi].astype(np.uint32), hashes[unit[lo:hi] >> 8], n[lo:hi].astype(np.int32), word[own], cnt[own], near[own])
        yield int(bucket[lo]), int(hi - lo), int(own.stop - own.start), packed


def _placed(chunk: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's words (the end first), each token as a place among them, the texts' first tokens, and tokens per text without the end."""
    words, index, n = _words(chunk.column(2))
    # Frequent words come first, so most numbers are small and pack well.
    order = np.argsort(-np.bincount(index, minlength=len(words)), kind="stable")
    rank = np.empty(len(words) + 1, np.int32)
    rank[order], rank[-1] = np.arange(1, len(words) + 1), 0
    words = pa.concat_arrays([pa.array([END]), words.cast(pa.string()).take(pa.array(order))])
    start = np.concatenate([[0], np.cumsum(n + 1)])
    token = np.zeros(start[-1], np.int32)
    token[np.arange(len(index)) + np.repeat(np.arange(len(n)), n)] = rank[index]
    return words, token, start, n


def _hashes(words: pa.Array) -> np.ndarray:
    import pandas as pd

    return pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False).astype(np.uint64)


def _codes(words: pa.Array, hot: list[str], hot_bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By word: its hash and the hash's leading bits, its place among the hot ones or -1, and the bits of its slices."""
    hashes = _hashes(words)
    is_hot = pc.fill_null(pc.index_in(words, value_set=pa.array(hot, pa.string())), -1).to_numpy(zero_copy_only=False)
    return hashes, (hashes >> np.uint64(64 - SLICE_BITS)).astype(np.uint8), is_hot, np.append(hot_bits, 0).astype(np.int64)[is_hot]


STORED = "chunk long, docs binary, words binary, size long, tokens binary, word string, n long, total long"


def _ipc(**columns: pa.Array) -> bytes:
    batch = pa.record_batch(list(columns.values()), list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each chunk, and its most frequent words with their counts in training and in all rows; ends, and (two ends) all tokens."""
    from pyspark import TaskContext

    names = [x.split()[0] for x in STORED.split(", ")]
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64()]
    for name, chunk in enumerate(_chunks(batches), TaskContext.get().partitionId() << 16):
        words, token, _, n = _placed(chunk)
        held = chunk.column(1).combine_chunks()
        docs = _ipc(doc_id=chunk.column(0).combine_chunks(), held=held, n=pa.array(n))
        del chunk
        row = [name, docs, _ipc(word=words), len(token), _packed(token), None, None, None]
        yield pa.record_batch([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names)
        learn = np.repeat(~held.to_numpy(zero_copy_only=False), n + 1)
        total = np.bincount(token, minlength=len(words))[: TOP + 1]  # places are by frequency, after the end
        count = np.bincount(token, weights=learn, minlength=len(words)).astype(np.int64)[: TOP + 1]
        count[0] = 0
        top = [pa.concat_arrays([words[: TOP + 1], pa.array([END + END])]), pa.array(np.append(count, 0)), pa.array(np.append(total, len(token)))]
        yield pa.record_batch([*(pa.nulls(len(top[0]), k) for k in kinds[:5]), *top], names)


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, pa.Array, np.ndarray, np.ndarray]]:
    """Each chunk's name, documents, words, tokens and first tokens."""
    for batch in batches:
        for k in range(batch.num_rows):
            name, docs, words, size, tokens = (batch.column(i)[k].as_py() for i in range(5))
            docs, words = (pa.ipc.open_stream(x).read_next_batch() for x in (docs, words))
            start = np.concatenate([[0], np.cumsum(docs.column(2).to_numpy() + 1)])
            yield name, docs, words.column(0), _unpacked(tokens, [np.int32], [size])[0], start


ASKS = "bucket long, chunk long, units long, pairs long, asks binary"


def _asker(hot: list[str], hot_bits: np.ndarray, log_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_task("lm")
        for name, docs, words, token, start in _stored(batches):
            hashes, code, _, bits = _codes(words, hot, hot_bits)
            del words
            learn = np.repeat(~docs.column(1).to_numpy(zero_copy_only=False), np.diff(start))
            share = np.maximum(np.bincount(token, weights=learn, minlength=len(hashes)), 0.5) / max(1, int(learn.sum()))
            keys = _pairs(token, start[:-1], code, bits)
            del token
            keys = (keys << 1) | learn  # sorted in place, which takes less memory than np.unique
            keys.sort()
            heads = np.flatnonzero(np.diff(keys >> 1, prepend=-1))
            cnt = np.add.reduceat(keys & 1, heads).astype(np.int32)
            keys = keys[heads] >> 1
            del learn, heads
            for bucket, units, pairs, packed in _asks(keys, cnt, share, hashes, log_buckets):
                row = (bucket, name, units, pairs, packed)
                yield pa.record_batch([pa.array([x]) for x in row], [x.split()[0] for x in ASKS.split(", ")])

    return run


CELLS = (
    "chunk long, doc_id long, held boolean, n long, cells binary, codes binary, hots binary, word string, ref long, ctx binary, cnt binary, "
    "totals array<long>"
)


def _tokens(short: list[str], hot: list[str], hot_bits: np.ndarray):
    names = [x.split()[0] for x in CELLS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), *[pa.binary()] * 3, pa.string(), pa.int64(), pa.binary(), pa.binary()]
    kinds += [pa.list_(pa.int64())]

    def batch(m: int, **columns) -> pa.RecordBatch:
        return pa.record_batch([columns.get(n) if n in columns else pa.nulls(m, k) for n, k in zip(names, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_task("lm")
        for name, docs, words, token, start in _stored(batches):
            ids, held, n = docs.column(0), docs.column(1).to_numpy(zero_copy_only=False), docs.column(2).to_numpy()
            docs = len(n)
            place = pc.fill_null(pc.index_in(words, value_set=pa.array(short, pa.string())), -1).to_numpy(zero_copy_only=False)
            listed = place.astype(np.int32)[token]
            begin = np.repeat(start[:-1].astype(np.int32), n + 1)
            at = np.arange(len(token), dtype=np.int32)
            last = np.maximum.accumulate(np.where(listed >= 0, at, np.int32(-1)))
            last = np.concatenate([np.array([-1], np.int32), last[:-1]])
            inside = last >= begin
            leaf = 2 * np.where(inside, listed[last], SHORT) + np.where(inside, last == at - 1, at == begin)
            del listed, last, inside, at, begin
            learn = np.repeat(~held, n + 1)
            _, code, is_hot, _ = _codes(words, hot, hot_bits)
            hots = np.flatnonzero(is_hot >= 0)
            hots = np.stack([hots, is_hot[hots]], 1).astype(np.int32).tobytes()
            cells, where = np.unique(token.astype(np.int64) * LEAVES + leaf, return_inverse=True)
            del token, leaf
            where = where.astype(np.int32)
            train = np.bincount(where, weights=learn, minlength=len(cells)).astype(np.int32)
            ctx = (cells % LEAVES).astype(np.uint8)
            word = cells // LEAVES
            head = np.flatnonzero(np.diff(word, prepend=-1))
            bounds = np.append(head, len(cells))
            for lo in range(0, docs, 5_000):
                hi = min(docs, lo + 5_000)
                first = lambda x: pa.array([x if lo == 0 else None, *[None] * (hi - lo - 1)], pa.binary())  # noqa: B023, E731
                yield batch(
                    hi - lo, chunk=pa.array(np.full(hi - lo, name)), doc_id=ids.slice(lo, hi - lo), held=pa.array(held[lo:hi]),
                    n=pa.array(n[lo:hi] + 1), cells=_planes(where[start[lo] : start[hi]], start[lo : hi + 1] - start[lo]),
                    codes=first(code.tobytes()), hots=first(hots),
                )
            for lo in range(0, len(head), 50_000):
                own = slice(lo, min(len(head), lo + 50_000))
                base = bounds[own.start]
                inner = bounds[own.start : own.stop + 1] - base
                span = slice(base, bounds[own.stop])
                yield batch(
                    len(inner) - 1, word=words.take(pa.array(word[head[own]])), ref=pa.array((name << 24) + head[own]),
                    ctx=_binaries(ctx[span], inner), cnt=_binaries(train[span], inner),
                )
            totals = np.bincount(ctx, weights=train, minlength=LEAVES).astype(np.int64)
            yield batch(1, totals=pa.array([totals.tolist()], kinds[-1]))

    return run


def _flat(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """All items of a binary column and the bounds of its rows."""
    if not len(column):
        return np.zeros(0, kind), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    width = np.dtype(kind).itemsize
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return np.frombuffer(data.tobytes(), kind), (offsets - offsets[0]) // width


def reseat(c: np.ndarray, size: np.ndarray, owner: np.ndarray, new: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Seat customers until cell i has c[i] of them; (size, owner) are the tables already there.

    ``new`` is a cell's weight of a new table, (strength + discount * tables) * parent
    probability; table k weighs size - discount. Customers come in waves of at most
    half of those seated, the weights taken at a wave's middle.
    """
    out_size, out_owner, cell = [], [], np.arange(len(c))
    while True:
        n = np.bincount(owner, size, len(c)).astype(np.int64)
        tables = np.bincount(owner, minlength=len(c))
        open_ = c > n
        rest = open_[owner]
        out_size.append(size[~rest])
        out_owner.append(cell[owner[~rest]])
        if not open_.any():
            break
        renamed = np.cumsum(open_) - 1
        size, owner = size[rest], renamed[owner[rest]]
        c, n, tables, new, cell = c[open_], n[open_], tables[open_], new[open_], cell[open_]
        wave = np.minimum(c - n, np.maximum(1, n // 2))
        chance = np.where(n > 0, new / (new + np.maximum(n + (wave - 1) / 2 - DISCOUNT * tables, 1e-9)), 1.0)
        fresh = rng.binomial(wave, chance)
        join = wave - fresh
        order = np.argsort(owner, kind="stable")
        size, owner = size[order], owner[order]
        if join.any():
            upto = np.cumsum(size - DISCOUNT)
            first = np.searchsorted(owner, np.arange(len(c)))
            stop = np.searchsorted(owner, np.arange(len(c)), "right")
            low = np.where(first > 0, upto[np.maximum(first - 1, 0)], 0.0)
            high = upto[np.maximum(stop - 1, 0)]
            who = np.repeat(np.arange(len(c)), join)
            at = np.searchsorted(upto, low[who] + rng.random(len(who)) * (high - low)[who], "right")
            at = np.clip(at, first[who], stop[who] - 1)
            size = size + np.bincount(at, minlength=len(size))
        size = np.concatenate([size, np.ones(int(fresh.sum()), np.int64)])
        owner = np.concatenate([owner, np.repeat(np.arange(len(c)), fresh)])
    return np.concatenate(out_size), np.concatenate(out_owner)


def sample(word: np.ndarray, ctx: np.ndarray, c: np.ndarray, n_words: int, totals: np.ndarray, scale: float, rng) -> dict[str, np.ndarray]:
    """Gibbs sweeps over the training cells (word, ctx, c) of a batch of words.

    Returns leaf tables (samples x cells), mid cells with their customers and
    tables, and root customers (samples x words).
    """
    mid, parent = np.unique(word * MIDS + ctx // 2, return_inverse=True)
    mid_word, mid_ctx = mid // MIDS, mid % MIDS
    all_c = np.maximum(1, totals.sum())
    total = np.bincount(word, c, n_words)
    p_mid = (total / all_c)[mid_word]
    p_root = total / all_c
    size, owner = np.zeros(0, np.int64), np.zeros(0, np.int64)
    t = np.bincount(np.arange(len(c)), minlength=len(c))
    out = {k: [] for k in ("t", "mc", "mt", "rc")}
    for sweep in range(BURN + SAMPLES):
        tables = scale * np.bincount(ctx, t, LEAVES)
        if sweep:
            size = rng.binomial(size, 0.5)
            size, owner = size[size > 0], owner[size > 0]
        size, owner = reseat(c, size, owner, (STRENGTH + DISCOUNT * tables[ctx]) * p_mid[parent], rng)
        t = np.bincount(owner, minlength=len(c))
        mc = np.bincount(parent, t, len(mid)).astype(np.int64)
        guess = scale * np.bincount(mid_ctx, mc > 0, MIDS)
        none = np.zeros(0, np.int64)
        _, seats = reseat(mc, none, none, (STRENGTH + DISCOUNT * guess[mid_ctx]) * p_root[mid_word], rng)
        mt = np.bincount(seats, minlength=len(mid))
        rc = np.bincount(mid_word, mt, n_words).astype(np.int64)
        p_root = np.maximum(rc - DISCOUNT, 0) / (STRENGTH + scale * rc.sum())
        c_mid, t_mid = scale * np.bincount(mid_ctx, mc, MIDS), scale * np.bincount(mid_ctx, mt, MIDS)
        p_mid = ((mc - DISCOUNT * mt) + (STRENGTH + DISCOUNT * t_mid[mid_ctx]) * p_root[mid_word]) / (STRENGTH + c_mid[mid_ctx])
        if sweep >= BURN:
            for k, v in zip(out, (t, mc, mt, rc), strict=True):
                out[k].append(v)
    return {k: np.array(v, np.int64) for k, v in out.items()} | {"mid_word": mid_word, "mid_ctx": mid_ctx}


PLACED = "chunk long, units long, pairs long, seats binary, hot long, tables long"


def _placer(hot: np.ndarray, hot_bits: np.ndarray, seed: int = 11):
    """Gibbs sweeps over the restaurants of a bucket: one for each word that stands before another.

    ``hot`` are the hashes of contexts dealt in slices. Answers each chunk with
    the tables (sums over SAMPLES) of its contexts, and its pairs' customers and tables.
    """
    by_hash = np.argsort(hot)

    def run(asks: pa.Table) -> pa.Table:
        start_task("lm")
        parts = [
            _unpacked(data, [np.uint32, np.uint64, np.int32, np.uint64, np.int32, np.uint8], [u, u, u, k, k, k])
            for data, u, k in zip(asks.column("asks").to_pylist(), asks.column("units").to_pylist(), asks.column("pairs").to_pylist(), strict=True)
        ]
        unit, before, n, word, cnt, near = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        contexts, of_unit = np.unique(before, return_inverse=True)
        scale, is_hot = np.ones(len(contexts)), np.full(len(contexts), -1)
        if len(hot):
            at = by_hash[np.minimum(np.searchsorted(hot, contexts, sorter=by_hash), len(hot) - 1)]
            is_hot = np.where(hot[at] == contexts, at, -1)
            # Slices are alike, by hashing: a hot context's tables elsewhere are estimated by those here.
            here = np.bincount(np.unique(of_unit * 256 + (unit & 255)) // 256, minlength=len(contexts))
            scale = np.where(is_hot >= 0, (1 << hot_bits[at]) / here, 1.0)
        _, first, pair = np.unique(_mixed(np.repeat(before, n)) ^ word, return_index=True, return_inverse=True)
        ctx = np.repeat(of_unit, n)[first]
        c = np.bincount(pair, cnt, len(first)).astype(np.int64)
        p = np.bincount(pair, cnt * 2.0 ** (-near / 4.0), len(first)) / np.maximum(c, 1)
        del first, word, near, cnt
        many = np.flatnonzero(c > 1)  # one customer has one table
        t, tables = np.minimum(c, 1), np.zeros(len(c), np.int64)
        size, owner = np.zeros(0, np.int64), np.zeros(0, np.int64)
        rng = np.random.default_rng([seed, asks.column("bucket")[0].as_py()])
        for sweep in range(BURN + SAMPLES):
            total = scale * np.bincount(ctx, t, len(contexts))
            if sweep:
                size = rng.binomial(size, 0.5)
                size, owner = size[size > 0], owner[size > 0]
            size, owner = reseat(c[many], size, owner, (STRENGTH + DISCOUNT * total[ctx[many]]) * p[many], rng)
            t[many] = np.bincount(owner, minlength=len(many))
            if sweep >= BURN:
                tables += t
        in_context = np.bincount(ctx, tables, len(contexts)).astype(np.int64)
        rows, u, k = [], 0, 0
        for chunk, units, pairs in zip(*(asks.column(x).to_pylist() for x in ("chunk", "units", "pairs")), strict=True):
            own = pair[k : k + pairs]
            seats = _packed(unit[u : u + units], in_context[of_unit[u : u + units]], c[own].astype(np.uint32), tables[own].astype(np.uint32))
            rows.append((chunk, units, pairs, seats, None, None))
            u, k = u + units, k + pairs
        rows += [(None, None, None, None, int(is_hot[x]), int(in_context[x])) for x in np.flatnonzero(is_hot >= 0)]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
        return pa.table([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in PLACED.split(", ")])

    return run


SEATED = "c long, ctx binary, leaf binary, mids binary, mid binary, root binary, refs binary, sizes binary, asked binary, sums array<long>"
#: Length of one row of restaurant totals: leaf tables, mid customers, mid tables, root customers; then known words once.
ROW = LEAVES + 2 * MIDS + 1


def _seater(totals: np.ndarray, n_known: float, seed: int = 7):
    names = [x.split()[0] for x in SEATED.split(", ")]

    def emit(rows: list[pa.RecordBatch], salt: int) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(rows).combine_chunks()
        words = table.column(0).combine_chunks().dictionary_encode()
        row_word = words.indices.to_numpy().astype(np.int64)  # rows come sorted, so these do not decrease
        n_words = len(words.dictionary)
        ctx, bounds = _flat(table.column(2).combine_chunks(), np.uint8)
        cnt, _ = _flat(table.column(3).combine_chunks(), np.int32)
        cell_word = np.repeat(row_word, np.diff(bounds))
        keys, where = np.unique(cell_word * LEAVES + ctx, return_inverse=True)
        c = np.bincount(where, cnt, len(keys)).astype(np.int64)
        keys, c = keys[c > 0], c[c > 0]
        word, leaf = keys // LEAVES, keys % LEAVES
        known = len(np.unique(word))
        rng = np.random.default_rng([seed, salt])
        got = sample(word, leaf, c, n_words, totals, max(1.0, n_known / max(1, known)), rng)
        count = np.bincount(word, c, n_words).astype(np.int64)
        if len(keys):
            sums = np.concatenate(
                [
                    np.concatenate([np.bincount(leaf, t, LEAVES), np.bincount(got["mid_ctx"], mc, MIDS), np.bincount(got["mid_ctx"], mt, MIDS), [rc.sum()]])
                    for t, mc, mt, rc in zip(got["t"], got["mc"], got["mt"], got["rc"], strict=True)
                ]
                + [[known]]
            )
            none = [pa.nulls(1, pa.int64()), *(pa.nulls(1, pa.binary()) for _ in range(8))]
            yield pa.record_batch([*none, pa.array([sums.astype(np.int64).tolist()], pa.list_(pa.int64()))], names)
        # One row for each word and at most REFS of its chunks.
        first_row = np.searchsorted(row_word, np.arange(n_words + 1))
        group = row_word * (len(row_word) + 1) + (np.arange(len(row_word)) - first_row[row_word]) // REFS
        heads = np.flatnonzero(np.diff(group, prepend=-1))
        ends = np.append(heads, len(group))
        own = row_word[heads]
        lo, hi = np.searchsorted(word, own), np.searchsorted(word, own, "right")
        mlo, mhi = np.searchsorted(got["mid_word"], own), np.searchsorted(got["mid_word"], own, "right")

        def spread(lo, hi, *columns):
            """Rows' slices [lo, hi) of each column in turn, as one binary for each row."""
            n = hi - lo
            at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            return _binaries(np.stack([x[at] for x in columns], 1).astype(np.int32).ravel(), np.append(0, np.cumsum(n)) * len(columns))

        ctx_bounds = np.append(0, np.cumsum(hi - lo))
        at = np.repeat(lo - ctx_bounds[:-1], hi - lo) + np.arange(ctx_bounds[-1])
        mid_bounds = np.append(0, np.cumsum(mhi - mlo))
        mat = np.repeat(mlo - mid_bounds[:-1], mhi - mlo) + np.arange(mid_bounds[-1])
        refs, sizes = table.column(1).to_numpy(), np.diff(bounds).astype(np.uint8)
        columns = [
            pa.array(count[own]),
            _binaries(leaf[at].astype(np.uint8), ctx_bounds),
            spread(lo, hi, c, *got["t"]),
            _binaries(got["mid_ctx"][mat].astype(np.uint8), mid_bounds),
            spread(mlo, mhi, *got["mc"], *got["mt"]),
            _binaries(got["rc"].T[own].astype(np.int64).ravel(), np.arange(len(own) + 1) * SAMPLES),
            _binaries(refs, ends),
            _binaries(sizes, ends),
            _binaries(ctx, bounds[ends]),
            pa.nulls(len(own), pa.list_(pa.int64())),
        ]
        out = pa.record_batch(columns, names)
        for k in range(0, len(own), 20_000):
            yield out.slice(k, 20_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 20
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            # A word's rows stay together: cut before the batch's last word.
            words = batch.column(0)
            cut = int(np.flatnonzero(pc.equal(words, words[-1]).to_numpy(zero_copy_only=False))[0])
            if size >= BATCH_CELLS and (cut or words[0] != held[-1].column(0)[-1]):
                if cut:
                    held.append(batch.slice(0, cut))
                yield from emit(held, part)
                part += 1
                held, size, batch = [], 0, batch.slice(cut)
            held.append(batch)
            size += batch.column(2).nbytes
        if held:
            yield from emit(held, part)

    return run


def _predictor(totals: np.ndarray, sums: np.ndarray):
    """``sums``: SAMPLES rows of restaurant totals, then the number of known words."""
    per = sums[: SAMPLES * ROW].reshape(SAMPLES, ROW).astype(float)
    leaf_t, mid_c, mid_t, root_c = np.split(per, [LEAVES, LEAVES + MIDS, LEAVES + 2 * MIDS], axis=1)
    to_mid = (STRENGTH + DISCOUNT * leaf_t) / (STRENGTH + totals)
    to_root = (STRENGTH + DISCOUNT * mid_t) / (STRENGTH + mid_c)
    unseen = (STRENGTH + DISCOUNT * float(sums[-1])) / (STRENGTH + root_c[:, 0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = batch.column(0).to_numpy()
            ctx, lb = _flat(batch.column(1), np.uint8)
            leaf = _flat(batch.column(2), np.int32)[0].reshape(-1, 1 + SAMPLES)
            mids, mb = _flat(batch.column(3), np.uint8)
            mid = _flat(batch.column(4), np.int32)[0].reshape(-1, 2 * SAMPLES)
            root = _flat(batch.column(5), np.int64)[0].reshape(-1, SAMPLES)
            refs, cb = _flat(batch.column(6), np.int64)
            sizes = _flat(batch.column(7), np.uint8)[0]
            asked = _flat(batch.column(8), np.uint8)[0].astype(np.int64)
            rows = np.arange(batch.num_rows)
            ref_row = np.repeat(rows, np.diff(cb))
            row = np.repeat(ref_row, sizes)
            leaf_key, mid_key = np.repeat(rows, np.diff(lb)) * LEAVES + ctx, np.repeat(rows, np.diff(mb)) * MIDS + mids

            def find(keys: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                at = np.searchsorted(keys, want)
                near = np.minimum(at, max(0, len(keys) - 1))
                return near, (keys[near] == want if len(keys) else np.zeros(len(want), bool))

            la, lhit = find(leaf_key, row * LEAVES + asked)
            ma, mhit = find(mid_key, row * MIDS + asked // 2)
            mean = np.zeros(len(row))
            for s in range(SAMPLES):
                p = np.where(count[row] > 0, np.maximum(root[row, s] - DISCOUNT, 0) / (STRENGTH + root_c[s, 0]), unseen[s])
                p = p * to_root[s, asked // 2]
                if len(mid):
                    p = p + mhit * (mid[ma, s] - DISCOUNT * mid[ma, SAMPLES + s]) / (STRENGTH + mid_c[s, asked // 2])
                p = p * to_mid[s, asked]
                if len(leaf):
                    p = p + lhit * (leaf[la, 0] - DISCOUNT * leaf[la, 1 + s]) / (STRENGTH + totals[asked])
                mean += p / SAMPLES
            logs = np.log10(mean).astype(np.float32)
            # One row for each chunk: its words' first cells, counts, numbers of cells, and all their logarithms.
            order = np.argsort(refs, kind="stable")
            chunk = refs[order] >> 24
            heads = np.flatnonzero(np.diff(chunk, prepend=-1))
            ends = np.append(heads, len(chunk))
            stop = np.cumsum(sizes, dtype=np.int64)
            n = sizes[order].astype(np.int64)
            logs = logs[np.repeat((stop - sizes)[order] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            yield pa.record_batch(
                [
                    pa.array(chunk[heads]),
                    _binaries((refs[order] & 0xFFFFFF).astype(np.int32), ends),
                    _binaries(count[ref_row][order], ends),
                    _binaries(sizes[order], ends),
                    _binaries(logs, np.append(0, np.cumsum(n))[ends]),
                ],
                ["chunk", "firsts", "counts", "sizes", "logs"],
            )

    return run


def _scorer(total: int, distinct: int, hot_bits: np.ndarray, hot_tables: np.ndarray):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        start_task("lm")
        placed = answers.filter(pc.is_valid(answers.column("seats")))
        answers = answers.filter(pc.is_null(answers.column("seats")))
        flat = lambda name, kind: _flat(answers.column(name).combine_chunks(), kind)[0]
        sizes, logs = flat("sizes", np.uint8).astype(np.int64), flat("logs", np.float32)
        order = np.argsort(flat("firsts", np.int32))
        n, from_ = sizes[order], (np.cumsum(sizes) - sizes)[order]
        parent = 10 ** logs[np.repeat(from_ - (np.cumsum(n) - n), n) + np.arange(n.sum())].astype(float)
        count = flat("counts", np.int64)[order]
        base = np.log10((count + 1) / (total + distinct + 1))
        cells, bounds = _unplaned(docs.column("cells").combine_chunks())
        token = np.repeat(np.arange(len(n), dtype=np.int32), n)[cells]  # rows of words come in the order of their places
        # The pairs in the order of the chunk's asks, and the answers put into that order.
        first = docs.filter(pc.is_valid(docs.column("codes")))
        code = np.frombuffer(first.column("codes")[0].as_py(), np.uint8)
        hots = np.frombuffer(first.column("hots")[0].as_py(), np.int32).reshape(-1, 2)
        bits = np.zeros(len(code), np.int64)
        bits[hots[:, 0]] = hot_bits[hots[:, 1]]
        keys, where = np.unique(_pairs(token, bounds[:-1], code, bits), return_inverse=True)
        parts = [
            _unpacked(data, [np.uint32, np.int64, np.uint32, np.uint32], [u, u, k, k])
            for data, u, k in zip(*(placed.column(x).to_pylist() for x in ("seats", "units", "pairs")), strict=True)
        ]
        unit, in_context, c, t = (np.concatenate(x) for x in zip(*parts, strict=True))
        own, of_pair, size = np.unique(keys >> 24, return_inverse=True, return_counts=True)
        order = np.argsort(unit)
        came = size[np.argsort(order)]
        at = np.repeat((np.cumsum(came) - came)[order] - (np.cumsum(size) - size), size) + np.arange(len(keys))
        before = own >> 8
        tables = np.zeros(len(code), np.int64)
        tables[before] = in_context[order]
        tables[hots[:, 0]] = hot_tables[hots[:, 1]]
        before = before[of_pair]
        whole = STRENGTH + count[before]
        seated = (c[at] - DISCOUNT / SAMPLES * t[at]) / whole
        back = (STRENGTH + DISCOUNT / SAMPLES * tables[before]) / whole
        score = np.log10(seated[where] + back[where] * parent[cells])
        sums = [np.add.reduceat(x, bounds[:-1]) for x in (score, base[token], (count > 0).astype(np.int64)[token])]
        n = docs.column("n").to_numpy()
        return pa.table(
            {
                "doc_id": docs.column("doc_id"), "held_out": docs.column("held"), "n_tokens": pa.array(n),
                "n_known": pa.array(sums[2].astype(np.int64)), "train_tokens": pa.array(np.full(len(n), total)),
                "base_score": pa.array(sums[1]), "score": pa.array(sums[0]), "perplexity": pa.array(10 ** (-sums[0] / n)),
            }
        )

    return run


def score_documents(docs: DataFrame, modulus: int = 7, held: int = 2) -> DataFrame:
    """Learn from rows outside the held-out fold and score all: one row per document row."""
    spark = docs.sparkSession
    texts = docs.select(
        F.col("doc_id").cast("long"), (fold("doc_id", modulus) == held).alias("held"), F.col("text").cast("string")
    )
    stored = materialise(texts.mapInArrow(_store, STORED), "lm-stored")
    chunks = stored.filter("chunk is not null").select("chunk", "docs", "words", "size", "tokens")
    counts = stored.filter("word is not null").groupBy("word").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    counts = materialise(counts, "lm-frequent")
    short = [r["word"] for r in counts.filter("n > 0").orderBy(F.desc("n"), "word").limit(SHORT).collect()]
    tokens = (counts.filter(F.col("word") == END + END).first() or {"total": 0})["total"]
    log_buckets = max(1, (max(partitions(spark), tokens // BUCKET) - 1).bit_length())
    # At most TOP contexts have so many tokens. What the list misses costs balance, not results.
    hot_rows = counts.filter((F.col("total") > max(HOT, tokens // TOP)) & (F.col("word") != END + END)).collect()
    hot = [r["word"] for r in hot_rows]
    hot_bits = np.array([min(SLICE_BITS, ((r["total"] - 1) // HOT).bit_length()) for r in hot_rows], np.int64)
    forget(counts)
    asks = chunks.mapInArrow(_asker(hot, hot_bits, log_buckets), ASKS)
    placer = _placer(_hashes(pa.array(hot, pa.string())), hot_bits)
    placed = materialise(asks.groupBy("bucket").applyInArrow(placer, PLACED), "lm-placed", rows=1)
    hot_tables = np.zeros(len(hot), np.int64)
    for r in placed.filter("hot is not null").groupBy("hot").agg(F.sum("tables").alias("n")).collect():
        hot_tables[r["hot"]] = r["n"]
    rows = materialise(chunks.mapInArrow(_tokens(short, hot, hot_bits), CELLS), "lm-cells", rows=1)
    forget(stored)
    totals = np.zeros(LEAVES)
    for r in rows.filter("totals is not null").select(F.posexplode("totals")).groupBy("pos").agg(F.sum("col").alias("n")).collect():
        totals[r["pos"]] = r["n"]
    asked = rows.filter("word is not null").select("word", "ref", "ctx", "cnt")
    n_known = asked.agg(F.approx_count_distinct("word")).first()[0]
    dealt = asked.repartition(partitions(spark), "word").sortWithinPartitions("word", "ref")
    seated = materialise(dealt.mapInArrow(_seater(totals, n_known), SEATED), "lm-seats")
    sums = np.zeros(SAMPLES * ROW + 1, np.int64)
    for r in seated.filter("sums is not null").select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("n")).collect():
        sums[r["pos"]] = r["n"]
    answers = seated.filter("sums is null").drop("sums").mapInArrow(_predictor(totals, sums), "chunk long, firsts binary, counts binary, sizes binary, logs binary")
    placed = placed.filter("seats is not null").select("chunk", "units", "pairs", "seats")
    answers = answers.unionByName(placed, allowMissingColumns=True)
    own = rows.filter("cells is not null").select("chunk", "doc_id", "held", "n", "cells", "codes", "hots")
    out = (
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
        "score double, perplexity double"
    )
    scorer = _scorer(int(totals.sum()), int(sums[-1]), hot_bits, hot_tables)
    return own.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(scorer, out)
