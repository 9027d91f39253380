"""Size-tiered compaction of immutable Parquet shards under a versioned manifest.

``append`` writes an arrival as many small immutable files and commits a version
that adds them. ``compact`` takes the shards of every size tier that has ``fan_in``
of them, rewrites them as files of about ``target_bytes`` in one job and commits a
version that swaps old for new, until no tier below the target is full. Readers see
a version or the next one, never a mixture: a version's file is written aside and put
in place by one rename that fails if that version exists (then the commit is tried
again on the newer state). It holds what the version adds and drops; every
``SNAPSHOT`` versions a whole list is written beside it, so that a commit costs no
more than its own shards. Data files are never changed, so a lost executor costs a
task retry and a lost driver costs only uncommitted files. ``vacuum`` deletes files
that no kept version names once they are older than any append may take.

Merging reads whole tiers and coalesces their scan partitions: no shuffle. The driver
holds the shards' metadata (path, bytes, tier), as it does for any table that Spark
lists: about 200 bytes for each ``target_bytes`` of data.

Defined cases: rows are kept whole, whatever nulls, repeats, empty or long texts
they hold, and so are all their columns, whatever their names; arrivals may bring new
columns, which are null in older rows, but not another type for a known name
(ValueError); an empty arrival adds at most a shard without rows; an arrival number of null is written as
its own arrival; an empty store reads as an empty table.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import free_name

SNAPSHOT = 16


def united(old: T.StructType, new: T.StructType) -> T.StructType:
    """All columns of both, nullable; names differ by more than case."""
    fields = {f.name.lower(): T.StructField(f.name, f.dataType) for f in old}
    for f in new:
        known = fields.setdefault(f.name.lower(), T.StructField(f.name, f.dataType))
        if known.dataType != f.dataType:
            raise ValueError(f"column {f.name} is {known.dataType.simpleString()} in the store, not {f.dataType.simpleString()}")
    return T.StructType(list(fields.values()))


class ShardStore:
    def __init__(
        self,
        spark: SparkSession,
        root: str,
        target_bytes: int = 64 << 20,
        base_bytes: int = 1 << 20,
        fan_in: int = 4,
        compression: str = "zstd",
    ):
        self.spark, self.root = spark, root.rstrip("/")
        self.target, self.base, self.fan_in = target_bytes, base_bytes, fan_in
        self.compression = compression
        jvm = spark._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # -- manifest -----------------------------------------------------------
    def _list(self, path: str) -> list[tuple[str, int, int]]:
        """(path, bytes, time of change in milliseconds) of all files below."""
        at = self._path(path)
        if not self._fs.exists(at):
            return []
        files, found = self._fs.listFiles(at, True), []
        while files.hasNext():
            f = files.next()
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
        return sorted(found)

    def _versions(self, kind: str = "v") -> list[int]:
        names = [p.rsplit("/", 1)[1] for p, _, _ in self._list(f"{self.root}/manifest")]
        return sorted(int(n[1:-5]) for n in names if n.startswith(kind) and n.endswith(".json"))

    def version(self) -> int:
        return max(self._versions(), default=0)

    def _get(self, kind: str, version: int) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/manifest/{kind}{version:08d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put(self, kind: str, version: int, body: dict) -> bool:
        """Whether the file was put in place; False if it is there already."""
        self._fs.mkdirs(self._path(f"{self.root}/manifest"))
        aside = self._path(f"{self.root}/pending/{uuid.uuid4().hex}")
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps(body), "utf-8"))
        out.close()
        final = self._path(f"{self.root}/manifest/{kind}{version:08d}.json")
        if not self._fs.exists(final) and self._fs.rename(aside, final):
            return True
        self._fs.delete(aside, False)
        return False

    def state(self, version: int | None = None) -> tuple[dict[str, dict], T.StructType]:
        """The shards of a version by path, and the columns of all of them."""
        version = self.version() if version is None else version
        start = max((v for v in self._versions("s") if v <= version), default=0)
        known = self._get("s", start) if start else {"shards": [], "schema": T.StructType().jsonValue()}
        shards = {s["path"]: s for s in known["shards"]}
        for v in range(start + 1, version + 1):
            known = self._get("v", v)
            for path in known["drop"]:
                del shards[path]
            shards |= {s["path"]: s for s in known["add"]}
        return shards, T.StructType.fromJson(known["schema"])

    def shards(self, version: int | None = None) -> list[dict]:
        return sorted(self.state(version)[0].values(), key=lambda s: s["path"])

    def _commit(self, add: list[dict], drop: set[str], schema: T.StructType, tries: int = 20) -> int:
        for _ in range(tries):
            now = self.version()
            shards, known = self.state(now)
            if drop - shards.keys():
                raise RuntimeError("a shard to be replaced is no longer in the manifest")
            columns = united(known, schema).jsonValue()
            if self._put("v", now + 1, {"add": add, "drop": sorted(drop), "schema": columns}):
                if (now + 1) % SNAPSHOT == 0:
                    self._put("s", now + 1, {"shards": [s for p, s in shards.items() if p not in drop] + add, "schema": columns})
                return now + 1
        raise RuntimeError("the manifest could not be committed")

    # -- writes -------------------------------------------------------------
    def tier(self, size: int) -> int:
        return 0 if size <= self.base else 1 + int(math.log(size / self.base, self.fan_in))

    def _added(self, path: str) -> list[dict]:
        return [{"path": p, "bytes": n, "tier": self.tier(n)} for p, n, _ in self._list(path) if p.endswith(".parquet")]

    def append(self, df: DataFrame, arrival: Column | None = None) -> int:
        """Add ``df``; with ``arrival``, each of its values is an arrival of its own."""
        united(self.state()[1], df.schema)  # a type that does not fit stops the append before anything is written
        path = f"{self.root}/data/{uuid.uuid4().hex}"
        rows, schema = df, df.schema
        writer = df.write
        if arrival is not None:
            name = free_name(df, "arrival")
            rows = df.withColumn(name, arrival)
            writer = rows.write.partitionBy(name)
        writer.option("compression", self.compression).parquet(path)
        return self._commit(self._added(path), set(), schema)

    def compact(self) -> int:
        """Merge until no tier below the target is full, all full tiers in one job; returns the version."""
        while True:
            shards, schema = self.state()
            by_tier: dict[int, list[dict]] = {}
            for s in shards.values():
                if s["bytes"] < self.target // 2:
                    by_tier.setdefault(s["tier"], []).append(s)
            runs = [sorted(r, key=lambda s: s["path"]) for _, r in sorted(by_tier.items()) if len(r) >= self.fan_in]
            if not runs:
                return self.version()
            path = f"{self.root}/data/{uuid.uuid4().hex}"
            # Scan partitions of at most the target, so that coalescing them can give files of about its size.
            most = "spark.sql.files.maxPartitionBytes"
            before = self.spark.conf.get(most)
            self.spark.conf.set(most, str(self.target))
            try:
                merged = [self._scan(r, schema).coalesce(max(1, math.ceil(sum(s["bytes"] for s in r) / self.target))) for r in runs]
                reduce(DataFrame.union, merged).write.option("compression", self.compression).parquet(path)
            finally:
                self.spark.conf.set(most, before)
            self._commit(self._added(path), {s["path"] for r in runs for s in r}, schema)

    # -- reads --------------------------------------------------------------
    def _scan(self, shards: list[dict], schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[s["path"] for s in shards])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version; the last two columns are each row's shard and its size.

        They are called ``shard`` and ``shard_bytes``, or what ``free_name`` makes of that.
        """
        shards, schema = self.state(version)
        rows = self._scan(list(shards.values()), schema) if shards else self.spark.createDataFrame([], schema)
        names = free_name(rows, "shard"), free_name(rows, "shard_bytes")
        path, size = (F.col("_metadata.file_path"), F.col("_metadata.file_size")) if shards else (F.lit(""), F.lit(0).cast("long"))
        return rows.select("*", path.alias(names[0]), size.alias(names[1]))

    def vacuum(self, keep: int = 1, min_age_s: float = 86_400) -> int:
        """Delete data files that none of the last ``keep`` versions names; returns how many.

        Younger files than ``min_age_s`` stay: they may belong to an append that has not
        committed yet. It has to exceed the time that an append takes.
        """
        last, now = self.version(), time.time() * 1_000
        used = {p for v in range(max(1, last - keep + 1), last + 1) for p in self.state(v)[0]}
        files = self._list(f"{self.root}/data")
        stale = [p for p, _, t in files if p.endswith(".parquet") and p not in used and now - t >= min_age_s * 1_000]
        for p in stale:
            self._fs.delete(self._path(p), False)
        return len(stale)
