"""WARC and ARC files: a Python data source for scans, offset reads for single records."""

from __future__ import annotations

import gzip
import io
import re
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.functions import relevance
from tidemark.operators import snapshots

SNAPSHOT = "url string, crawl_ts timestamp, status int, mime string, headers map<string,string>, text string, body binary"
META = re.compile(rb"""<meta[^>]+charset\s*=\s*["']?\s*([A-Za-z0-9_-]+)""", re.I)


def charset(body: bytes, headers: dict[str, str], default: str = "utf-8") -> str:
    """From the HTTP header, else (for HTML) the page's meta element or its byte order mark, else the default."""
    kind = next((v for k, v in headers.items() if k.lower() == "content-type"), "")
    named = re.search(r"charset=[\"']?([\w-]+)", kind, re.I)
    if named:
        return named[1]
    if "html" in kind.lower():
        if found := META.search(body[:4096]):
            return found[1].decode()
        for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
            if body.startswith(mark):
                return name
    return default


def decode(body: bytes, headers: dict[str, str]) -> str:
    try:
        return body.decode(charset(body, headers), "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def _time(text: str | None) -> datetime | None:
    for form in ("%Y-%m-%dT%H:%M:%SZ", "%Y%m%d%H%M%S", "%Y%m%d%H%M"):
        try:
            return datetime.strptime(text or "", form)
        except ValueError:
            continue
    return None


def parse_http(payload: bytes) -> tuple[int | None, dict[str, str], bytes]:
    """Status, headers (the last of equal names) and body of a stored HTTP response."""
    head, _, body = payload.partition(b"\r\n\r\n")
    first, *lines = head.decode("latin-1").split("\r\n")
    code = re.match(r"HTTP/\d\S*\s+(\d{3})", first)
    headers = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines) if k}
    return int(code[1]) if code else None, headers, body


def snapshot(url: str, when: str | None, mime: str | None, payload: bytes) -> tuple:
    status, headers, body = parse_http(payload)
    own = {k.lower(): v for k, v in headers.items()}
    ts = _time(when)
    if ts is None and "date" in own:
        try:
            ts = parsedate_to_datetime(own["date"]).astimezone(UTC).replace(tzinfo=None)
        except ValueError:
            ts = None
    kind = own.get("content-type", mime or "").partition(";")[0].strip().lower() or None
    is_text = bool(kind) and kind.startswith("text")
    return url, ts, status, kind, headers, decode(body, headers) if is_text else None, None if is_text else body


def records(stream: io.BufferedIOBase) -> Iterator[tuple]:
    """Snapshots of a WARC or ARC stream; other records are passed over."""
    while line := stream.readline():
        if not line.strip():
            continue
        if line.startswith(b"WARC/"):
            head: dict[str, str] = {}
            while (h := stream.readline()).strip():
                k, _, v = h.decode("utf-8", "replace").partition(":")
                head[k.strip().lower()] = v.strip()
            payload = stream.read(int(head.get("content-length", 0)))
            if head.get("warc-type") == "response":
                yield snapshot(head.get("warc-target-uri", "").strip("<>"), head.get("warc-date"), head.get("content-type"), payload)
        else:
            parts = line.decode("utf-8", "replace").split()
            if len(parts) < 5 or not parts[-1].isdigit():
                continue
            payload = stream.read(int(parts[-1]))
            if not parts[0].startswith("filedesc:"):
                yield snapshot(parts[0], parts[2], parts[3], payload)


def read_bytes(data: bytes, offset: int = 0) -> Iterator[tuple]:
    """Records from ``offset`` on; a gzip member or plain bytes start there."""
    part = io.BytesIO(data[offset:])
    yield from records(io.BufferedReader(gzip.GzipFile(fileobj=part)) if data[offset : offset + 2] == b"\x1f\x8b" else part)


class WarcSource(DataSource):
    """``spark.read.format("warc").option("files", "a.warc.gz,b.arc").load()``: one partition for each file."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SNAPSHOT

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options["files"].split(","))


class WarcReader(DataSourceReader):
    def __init__(self, files: list[str]):
        self.files = files

    def partitions(self):
        return [InputPartition(f) for f in self.files]

    def read(self, partition):
        with _open(partition.value) as f:
            start = f.read(2)
            f.seek(0)
            yield from records(io.BufferedReader(gzip.GzipFile(fileobj=f)) if start == b"\x1f\x8b" else f)


def from_binary_files(files: DataFrame) -> DataFrame:
    """Snapshots of ``spark.read.format("binaryFile")`` rows: any store that Spark reads."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in SNAPSHOT.split(", ")]
        for batch in batches:
            for data in batch["content"]:
                yield pd.DataFrame(list(read_bytes(bytes(data))), columns=names)

    return files.select("content").mapInPandas(run, SNAPSHOT)


def _open(path: str):
    """A seekable buffered stream of a file in any store that Arrow knows; plain paths are local or mounted."""
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*:/", path) else (fs.LocalFileSystem(), path)
    return io.BufferedReader(store.open_input_file(name))


def record_at(path: str, offset: int) -> tuple | None:
    """The snapshot at an offset; only its own bytes are read. None where there is none or it can't be read."""
    try:
        with _open(path) as f:
            f.seek(offset)
            packed = f.read(2) == b"\x1f\x8b"
            f.seek(offset)
            return next(records(io.BufferedReader(gzip.GzipFile(fileobj=f)) if packed else f), None)
    except (OSError, EOFError, ValueError, zlib.error):
        return None


SPAN = 1 << 28  # bytes of one file whose records a task reads in order


def read_located(locations: DataFrame) -> DataFrame:
    """``locations`` (path, offset, more) with their snapshot's columns; those that can't be read are left out.

    Locations are dealt by file and stretch of it and read in order of offset, so no file's bytes are shuffled and
    a large file's records are spread. A location column named like a snapshot's gives way to the snapshot's.
    """
    names = [x.split()[0] for x in SNAPSHOT.split(", ")]
    kept = [c for c in locations.columns if c.lower() not in names]
    dealt = locations.select(*kept).repartition("path", F.floor(F.col("offset") / SPAN)).sortWithinPartitions("path", "offset")
    types = {f.name: f.dataType.simpleString() for f in locations.schema}
    schema = ", ".join([f"`{c}` {types[c]}" for c in kept] + [SNAPSHOT])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # Some records at once: bodies can be large.
            for lo in range(0, len(batch), 64):
                part = batch.iloc[lo : lo + 64].reset_index(drop=True)
                found = [record_at(p, int(o)) for p, o in zip(part["path"], part["offset"], strict=True)]
                good = [k for k, r in enumerate(found) if r is not None]
                got = pd.DataFrame([found[k] for k in good], columns=names)
                yield pd.concat([part.iloc[good].reset_index(drop=True), got], axis=1)

    return dealt.mapInPandas(run, schema)


def fetch(frontier: DataFrame, index: DataFrame, interval: relevance.Interval, root: str, versions: int = 1) -> DataFrame:
    """Snapshots of the frontier's URLs: all versions located, the best ones by time kept, their records read."""
    found = snapshots.locate(frontier, index)
    best = snapshots.best_by_time(found, "url", "ts", interval, versions, "version").withColumnRenamed("url", "asked_url")
    paths = best.withColumn("path", snapshots.resolve_path(F.col("filename"), root))
    return read_located(paths.select("asked_url", "rank", "version", "path", F.col("offset").cast("long").alias("offset")))


def decode_html(body: Column) -> Column:
    """Fast path for UTF-8 pages."""
    return F.decode(body, "UTF-8")
