"""Best-fit packing by minimum bin slack.

Documents become token pieces of at most ``capacity``. Since lengths are whole
numbers up to the capacity, the packing problem is a histogram of at most
``capacity`` counts however large the corpus is. The driver plans on that
histogram: each step takes the longest length left, finds by a bitset subset-sum
dynamic programme the fullest combination with the other lengths, and removes it
as often as the counts allow. The plan (a few thousand rows, bounded by the
capacity) goes back to the executors, where each piece finds its place from its
length and its rank among equal lengths. Ranks are counted while a task cuts its
pieces; what the tasks before it hold of a length is added from the tasks' tallies,
so a length that a third of all pieces share needs no sorting and gathers nowhere.

Defined cases: null text is the empty text, which is one piece of the end token;
a null id is kept as null; repeated rows are packed one by one (they are told
apart by row order within their partition); documents over the capacity are cut;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import KEPT, materialise, start_task

CAPACITY = 2048
END = b"\0\0\0\0"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"
SLICE = 6 << 20
MAX_WORDS = 800_000  # words a Python worker keeps; then it starts anew


class WordIds(dict):
    """Ids of words (ASCII lower-cased) as little-endian bytes.

    The tokenizer lower-cases, drops white space and never joins across it, so a
    text's ids are those of its white-space delimited words in turn. Points and
    commas behind a letter are a token group of their own and are taken off.
    Words of letters only are encoded many at a time: each ends in exactly one
    token that carries the word-end mark. Texts with a special token's marker
    take the tokenizer's own path.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _each(self, words: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _letters(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        parts = [words[at : at + 500] for at in range(0, len(words), 500)]
        found = self.tokenizer.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False)
        for part, e in zip(parts, found, strict=True):
            ids = np.array(e.ids, "<u4")
            ends = (4 * np.flatnonzero(self.last[ids]) + 4).tolist()
            if len(ends) == len(part):
                data = ids.tobytes()
                out += [data[x:y] for x, y in zip([0, *ends], ends, strict=False)]
            else:
                out += self._each(part)
        return out

    def _of(self, words: pa.Array, letters: pa.Array) -> list[bytes]:
        """Ids of distinct words, learning those that are new."""
        names = words.to_pylist()
        if len(self) + len(names) > MAX_WORDS:
            self.clear()
        found = list(map(self.get, names))
        known = np.array([f is not None for f in found], bool)
        alone = pc.fill_null(letters, False).to_numpy(zero_copy_only=False)
        for own, learn in ((~known & alone, self._letters), (~known & ~alone, self._each)):
            at = np.flatnonzero(own).tolist()
            part = [names[i] for i in at]
            for i, word, ids in zip(at, part, learn(part), strict=True):
                found[i] = self[word] = ids
        return found

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text; ``texts`` holds strings without nulls."""
        lower = pc.ascii_lower(texts)
        special = [i for m in self.marks for i in np.flatnonzero(pc.match_substring(lower, m).to_numpy(zero_copy_only=False))]
        split = pc.ascii_split_whitespace(lower)
        bounds = split.offsets.to_numpy()
        coded = split.flatten().dictionary_encode()
        words, index = coded.dictionary, coded.indices.to_numpy()
        body = pc.ascii_rtrim(words, characters=".,")
        plain = pc.utf8_lower(pc.utf8_normalize(body, form="NFC"))
        # This capital's lower case is two characters, the second no letter.
        simple = pc.invert(pc.match_substring(words, "\u0130"))
        tailed = pc.and_(pc.not_equal(words, body), pc.and_(simple, pc.match_substring_regex(plain, r"\pL$")))
        heads = pc.if_else(tailed, body, words).dictionary_encode()
        tails = pc.if_else(tailed, pc.replace_substring_regex(words, r"^.*?([.,]*)$", r"\1"), "").dictionary_encode()
        names = heads.dictionary
        letters = pc.and_(pc.invert(pc.match_substring(names, "\u0130")), pc.utf8_is_alpha(pc.utf8_lower(pc.utf8_normalize(names, form="NFC"))))
        parts = self._of(names, letters) + self._each(tails.dictionary.to_pylist())
        length = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        start = np.cumsum(length) - length
        ids = np.frombuffer(b"".join(parts), "<u4")
        word = np.empty((len(index), 2), np.int64)
        word[:, 0] = heads.indices.to_numpy()[index]
        word[:, 1] = tails.indices.to_numpy()[index] + len(names)
        many = length[word.ravel()]
        ends = np.cumsum(many)
        data = ids[np.repeat(start[word.ravel()] - (ends - many), many) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        cuts = np.concatenate([[0], ends])[2 * (bounds - bounds[0])] * 4
        out = [data[x:y] for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        for i in special:
            out[i] = self._each([texts[i].as_py()])[0]
        return out


_WORDS: dict[str, WordIds] = KEPT.setdefault("packing", {})


def _words(path: str) -> WordIds:
    """One table for each Python worker, kept from task to task."""
    if path not in _WORDS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _WORDS[path] = WordIds(path)
    return _WORDS[path]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(ids, texts) of about SLICE bytes of text, nulls as empty texts."""
    for batch in batches:
        texts = pc.fill_null(batch.column(1), "")
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE, "right")))
            yield batch.column(0).slice(at, to - at), pa.concat_arrays([texts.slice(at, to - at)])
            at = to


def _tokenise(path: str, capacity: int, with_ids: bool):
    step = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        start_task("packing")
        words = _words(path)
        task = TaskContext.get().partitionId()
        seen: Counter[int] = Counter()
        for ids, texts in _slices(batches):
            out = [[] for _ in range(8)]
            for doc, data in zip(ids.to_pylist(), words.encode(texts), strict=True):
                data += END
                for k, b in enumerate(range(0, len(data), step)):
                    piece = data[b : b + step]
                    n = len(piece) // 4
                    row = (doc, k, b // 4, n, zlib.crc32(piece), task, seen[n], piece)
                    seen[n] += 1
                    for col, v in zip(out, row, strict=True):
                        col.append(v)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth", "ids"]
            n = 8 if with_ids else 7
            yield pa.record_batch([pa.array(c, k) for c, k in zip(out[:n], kinds[:n], strict=True)], names[:n])

    return run


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """[(pattern, times)]: a pattern is [(length, how many)], longest first."""
    left = {k: v for k, v in counts.items() if v > 0}
    plan = []
    while left:
        longest = max(left)
        room = capacity - longest
        reach, steps = 1, []
        for length in sorted(left, reverse=True):
            if length > room or reach >> room & 1:
                continue
            most, k = min(left[length] - (length == longest), room // length), 1
            while most > 0 and not reach >> room & 1:
                k = min(k, most)
                steps.append((length, k, reach))
                reach |= reach << length * k
                most, k = most - k, 2 * k
        full = (reach & ((1 << room + 1) - 1)).bit_length() - 1
        pattern = {longest: 1}
        for length, k, before in reversed(steps):
            if not before >> full & 1:
                full -= length * k
                pattern[length] = pattern.get(length, 0) + k
        times = min(left[n] // m for n, m in pattern.items())
        plan.append((sorted(pattern.items(), reverse=True), times))
        for n, m in pattern.items():
            left[n] -= m * times
            if not left[n]:
                del left[n]
    return plan


class Places:
    """Place of the r-th piece of a length: (sequence, offset)."""

    def __init__(self, plan: list[tuple[list[tuple[int, int]], int]]):
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        taken: dict[int, int] = {}
        bins = 0
        for pattern, times in plan:
            offset = 0
            for length, many in pattern:
                rows.setdefault(length, []).append((taken.get(length, 0), bins, many, offset))
                taken[length] = taken.get(length, 0) + many * times
                offset += length * many
            bins += times
        self.bins = bins
        self.by_length = {k: np.array(v, np.int64).T for k, v in rows.items()}

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        cuts = np.flatnonzero(np.diff(length[order])) + 1
        for own in np.split(order, cuts) if len(order) else []:
            n = int(length[own[0]])
            base, first, many, start = self.by_length[n]
            at = np.searchsorted(base, rank[own], "right") - 1
            inside = rank[own] - base[at]
            sequence[own] = first[at] + inside // many[at]
            offset[own] = start[at] + inside % many[at] * n
        return sequence, offset


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids (little-endian, 32 bits each)]."""
    schema = PIECES + (", ids binary" if with_ids else "")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    pieces = materialise(texts.mapInArrow(_tokenise(tokenizer_path, capacity, with_ids), schema), "pieces")
    tallies = pieces.groupBy("length", "task").count()
    counts = {r["length"]: r["n"] for r in tallies.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    places = Places(plan_bins(counts, capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = tallies.select("length", "task", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    # The tallies are a row for each length of a task: Spark broadcasts them where its own size check allows that.
    ranked = pieces.join(bases, ["length", "task"]).withColumn("rank", F.col("nth") + F.col("base"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank, length = batch.column(len(columns)).to_numpy(), batch.column(3).to_numpy()
            got = places.find(length, rank)
            yield pa.record_batch(
                [*batch.columns[: len(columns)], *(pa.array(g) for g in got)], [*columns, "sequence_id", "offset"]
            )

    out = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return ranked.select(*columns, "rank").mapInArrow(place, f"{out}, sequence_id long, offset long")
