"""Captures as a Spark data source: `spark.read.format("capture")`, `readStream`, `write` and `writeStream`.

Reading: a partition is a few whole objects in order of their keys; filters on the time leave out whole days before
their folders are listed; a schema of some of the columns leaves out the others, not the check of a line. A stream's
offset is the highest number of each pod's objects. Writing: a task keeps a buffer for each folder, which ends an object
at so many bytes or so old a line; objects are staged, and the commit moves them and writes the manifests last, so that
a failed task or job leaves nothing that a reader sees as whole.

Objects are reached through pyarrow's file systems, by their URI (local, HDFS, S3, GCS); a path that only Spark's own
readers know is refused with a message.
"""

from __future__ import annotations

import base64
import binascii
import datetime as dt
import gzip
import hashlib
import json
import re
import time
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from .. import schemas

#: Where an object ends (fixed values): bytes of its lines before compression, and seconds since its first one.
MAX_BYTES, MAX_AGE_S = 10 << 20, 5.0
#: Compressed bytes of a partition, about, some seconds of parsing; what opening an object counts as; partitions at most, larger ones take the rest.
PARTITION_BYTES, OPEN_BYTES, PARTITIONS = 2 << 20, 16 << 10, 10_000
#: Rows of a batch; buffered bytes of all folders of a task; moves at a time.
BATCH_ROWS, TASK_BYTES, MOVES = 5_000, 128 << 20, 32
PIECE_BYTES = 1 << 20
VERSION = 1
#: Rows to write: the capture, the day (null for none) and the line.
LINES = "capture string, day string, line string"
ROW = schemas.REQUEST + ", object_key string, line bigint"
TYPES = dict(x.split(" ") for x in ROW.split(", "))
DAY = re.compile(r"(?:day=)?(\d{4}-\d{2}-\d{2})\Z")
NAME = re.compile(r"(.+)-(\d{6,})\.jsonl?\.gz\Z")
ARROW = pa.schema([
    ("id", pa.string()), ("timestamp", pa.timestamp("us", "UTC")), ("method", pa.string()), ("path", pa.string()), ("headers", pa.map_(pa.string(), pa.list_(pa.string()))), ("body", pa.binary()), ("contentLength", pa.int64()),
    ("protocol", pa.string()), ("metadata", pa.map_(pa.string(), pa.string())), ("object_key", pa.string()), ("line", pa.int64()),
])


class Store:
    """Objects below a root."""

    def __init__(self, root: str):
        try:
            self.fs, self.base = fs.FileSystem.from_uri(root) if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", root) else (fs.LocalFileSystem(), root)
        except (pa.ArrowInvalid, OSError, ImportError) as e:
            raise ValueError(f"no file system for {root}; captures there are read by lake.read_capture") from e
        self.base = self.base.rstrip("/")
        self.made: set[str] = set()

    def path(self, key: str) -> str:
        return f"{self.base}/{key}"

    def find(self, folder: str, keep_day=lambda day: True) -> list[tuple[str, int]]:
        """Keys and sizes of the objects of a folder in order. Folders of unwanted days aren't listed; the first day in a key counts."""
        found: list[tuple[str, int]] = []

        def walk(at: str, dated: bool) -> None:
            for x in self.fs.get_file_info(fs.FileSelector(self.path(at), allow_not_found=True)):
                name, key = x.base_name, f"{at}/{x.base_name}"
                if name.startswith(("_", ".")):
                    continue
                day = None if dated else day_of(name)
                if x.type == fs.FileType.Directory:
                    if day is None or keep_day(day):
                        walk(key, dated or day is not None)
                elif name.endswith(".gz") and x.type == fs.FileType.File:
                    found.append((key, x.size))

        walk(folder.strip("/"), False)
        return sorted(found)

    def write(self, key: str, data: bytes) -> None:
        path = self.path(key)
        self._folder_of(path)
        with self.fs.open_output_stream(path, compression=None) as f:
            f.write(data)

    def _folder_of(self, path: str) -> None:
        """Makes a path's folder, once."""
        folder = path.rsplit("/", 1)[0]
        if folder not in self.made:
            self.fs.create_dir(folder, recursive=True)
            self.made.add(folder)

    def read(self, key: str) -> bytes | None:
        if self.fs.get_file_info(self.path(key)).type != fs.FileType.File:
            return None
        with self.fs.open_input_stream(self.path(key), compression=None) as f:
            return f.read()

    def lines(self, key: str) -> Iterator[bytes]:
        with self.fs.open_input_stream(self.path(key), compression=None) as f, gzip.GzipFile(fileobj=f) as g:
            yield from g

    def pieces(self, key: str) -> Iterator[bytes]:
        """An object's bytes, unpacked, a piece at a time."""
        with self.fs.open_input_stream(self.path(key), compression=None) as f, gzip.GzipFile(fileobj=f) as g:
            while piece := g.read(PIECE_BYTES):
                yield piece

    def move(self, key: str, to: str) -> None:
        """Puts an object where it belongs; one that was moved before is left alone."""
        if self.fs.get_file_info(self.path(key)).type == fs.FileType.File:
            self._folder_of(self.path(to))
            self.fs.move(self.path(key), self.path(to))

    def remove(self, folder: str) -> None:
        if self.fs.get_file_info(self.path(folder)).type == fs.FileType.Directory:
            self.fs.delete_dir(self.path(folder))
            self.made.clear()

    def folders(self, folder: str) -> list[str]:
        return self._names(folder, fs.FileType.Directory)

    def files(self, folder: str) -> list[str]:
        return self._names(folder, fs.FileType.File)

    def _names(self, folder: str, kind: fs.FileType) -> list[str]:
        at = self.path(folder) if folder else self.base
        return [x.base_name for x in self.fs.get_file_info(fs.FileSelector(at, allow_not_found=True)) if x.type == kind]

    def forget(self, key: str) -> None:
        if self.fs.get_file_info(self.path(key)).type == fs.FileType.File:
            self.fs.delete_file(self.path(key))


def day_of(name: str) -> dt.date | None:
    m = DAY.match(name)
    try:
        return dt.date.fromisoformat(m.group(1)) if m else None
    except ValueError:
        return None


def request(line: bytes) -> dict | None:
    """A line's request, or nothing if the line is malformed, by the same rule as lake.parsed: no JSON object, or a value that its field can't have."""
    try:
        x = DECODE(line.decode("utf-8", "surrogatepass")) if line[:1] == b"{" and line[1:2] != b"\0" else json.loads(line, parse_float=Raw)  # other encodings are looked for
        if not isinstance(x, dict):
            return None
        at, body, length = x.get("timestamp"), x.get("body"), x.get("contentLength")
        if at is not None:
            at = dt.datetime.fromtimestamp(at, dt.UTC) if isinstance(at, int) else dt.datetime.fromisoformat(at)
            at = at.replace(tzinfo=dt.UTC) if at.tzinfo is None else at.astimezone(dt.UTC)
        if length is not None and (not isinstance(length, int) or isinstance(length, bool)):
            return None
        out = {"timestamp": at, "body": base64.b64decode(body, validate=True) if body is not None else None, "contentLength": length}
        for name in ("id", "method", "path", "protocol"):
            out[name] = None if (value := x.get(name)) is None else _text(value)
        headers, metadata = x.get("headers"), x.get("metadata")
        out["headers"] = None if headers is None else [(k, v if v is None else _texts(v)) for k, v in headers.items()]
        out["metadata"] = None if metadata is None else [(k, v if v is None else _text(v)) for k, v in metadata.items()]
        return out
    except (ValueError, TypeError, AttributeError, OverflowError, RecursionError, binascii.Error):
        return None


class Raw(float):
    """A number that knows how it was written."""

    def __new__(cls, text: str) -> Raw:
        self = super().__new__(cls, text)
        self.text = text
        return self


DECODE = json.JSONDecoder(parse_float=Raw).decode


def _text(x) -> str:
    """A value of a text field: what is no text is taken as it is written."""
    return x if isinstance(x, str) else x.text if isinstance(x, Raw) else json.dumps(x, separators=(",", ":"), ensure_ascii=False)


def _texts(x) -> list[str | None]:
    if not isinstance(x, list):
        raise TypeError(x)
    return [y if y is None else _text(y) for y in x]


@dataclass
class Objects(InputPartition):
    """Whole objects that one task reads in order."""

    keys: list[str]


BOUNDS = (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)


class CaptureReader(DataSourceReader):
    """Good rows of a capture, with the columns of the schema. Options: path (the root), capture, start and end (ISO times, both belong to the range), partitionBytes."""

    def __init__(self, options: dict, schema: StructType | None = None):
        options = {k.lower(): v for k, v in options.items()}
        self.root, self.capture = options["path"], options["capture"]
        times = [dt.datetime.fromisoformat(options[k]) if options.get(k) else None for k in ("start", "end")]
        self.start, self.end = (t.replace(tzinfo=dt.UTC) if t and t.tzinfo is None else t for t in times)
        self.first, self.last = (t.astimezone(dt.UTC).date() if t else None for t in (self.start, self.end))
        self.bytes = int(options["partitionbytes"]) if options.get("partitionbytes") else None
        asked = {f.name: f.dataType.simpleString() for f in schema.fields} if schema else TYPES
        if wrong := [f"{c} {t}" for c, t in asked.items() if TYPES.get(c) != t]:
            raise ValueError(f"a capture's columns are {ROW}; there is no {', '.join(wrong)}")
        self.arrow = pa.schema([ARROW.field(c) for c in asked])

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds of the time leave out days; Spark still applies them to the rows."""
        for f in filters:
            if isinstance(f, BOUNDS) and f.attribute == ("timestamp",) and isinstance(f.value, dt.datetime):
                day = (f.value.astimezone(dt.UTC) if f.value.tzinfo else f.value).date()
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.first = max(day, self.first or day)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.last = min(day, self.last or day)
            yield f

    def wanted(self, day: dt.date) -> bool:
        return not (self.first and day < self.first or self.last and day > self.last)

    def partitions(self) -> list[Objects]:
        return self.dealt(Store(self.root).find(self.capture, self.wanted))

    def dealt(self, found: list[tuple[str, int]]) -> list[Objects]:
        """Objects by tasks; their number follows the bytes, so that a capture of any size is read by all cores."""
        return packed(found, self.bytes or max(PARTITION_BYTES, sum(size + OPEN_BYTES for _, size in found) // PARTITIONS))

    def read(self, partition: Objects | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        store, n_rows = Store(self.root), 0
        columns: list[tuple[str, list]] = [(c, []) for c in self.arrow.names]

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(values, self.arrow.field(c).type) for c, values in columns], schema=self.arrow)
            for _, values in columns:
                values.clear()
            return out

        for key in partition.keys:
            for n, line in enumerate(store.lines(key)):
                row = request(line)
                if row is None or not self.inside(row["timestamp"]):
                    continue
                row["object_key"], row["line"] = key, n
                for c, values in columns:
                    values.append(row[c])
                n_rows += 1
                if n_rows % BATCH_ROWS == 0:
                    yield batch()
        if n_rows % BATCH_ROWS:
            yield batch()

    def inside(self, at: dt.datetime | None) -> bool:
        """A row without a time is in no range."""
        return not (self.start and (at is None or at < self.start) or self.end and (at is None or at > self.end))


def manifest_of(capture: str, n: int, sha256: str | None, fields: dict) -> bytes:
    """A capture's manifest as it is stored."""
    made = {"formatVersion": VERSION, "captureID": capture, "recordCount": n, "sha256": sha256, "createdAt": dt.datetime.now(dt.UTC).isoformat()}
    return json.dumps({k: v for k, v in (made | fields).items() if v is not None}).encode()


def packed(objects: list[tuple[str, int]], most: int) -> list[Objects]:
    """Objects in order, in partitions of so many bytes, opening them included; a larger one is alone."""
    out: list[Objects] = []
    held = 0
    for key, size in objects:
        if not out or held + size + OPEN_BYTES > most:
            out.append(Objects([]))
            held = 0
        out[-1].keys.append(key)
        held += size + OPEN_BYTES
    return out


class CaptureStream(CaptureReader, DataSourceStreamReader):
    """Objects as they come: an offset is the highest number of each pod, so that its size is that of the pods."""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        top: dict[str, int] = {}
        for key, _ in Store(self.root).find(self.capture, self.wanted):
            if m := NAME.match(key.rsplit("/", 1)[-1]):
                top[m.group(1)] = max(int(m.group(2)), top.get(m.group(1), 0))
        return top

    def partitions(self, start: dict, end: dict) -> list[Objects]:
        new = []
        for key, size in Store(self.root).find(self.capture, self.wanted):
            m = NAME.match(key.rsplit("/", 1)[-1])
            if m and start.get(m.group(1), 0) < int(m.group(2)) <= end.get(m.group(1), 0):
                new.append((key, size))
        return self.dealt(new)

    def commit(self, end: dict) -> None:
        """Objects stay."""


@dataclass
class Written(WriterCommitMessage):
    """What a task staged: (staged key, final key, rows, bytes) of each object; rows and digest of the lines of each capture, in order."""

    objects: list[tuple[str, str, int, int]] = field(default_factory=list)
    captures: dict[str, tuple[int, str]] = field(default_factory=dict)


class Buffer:
    """Lines of one folder of a task, compressed as they come."""

    def __init__(self) -> None:
        self.gzip, self.parts, self.rows, self.bytes, self.since = zlib.compressobj(6, zlib.DEFLATED, 31), [], 0, 0, time.monotonic()

    def add(self, line: bytes) -> None:
        self.parts.append(self.gzip.compress(line))
        self.rows += 1
        self.bytes += len(line)

    def data(self) -> bytes:
        return b"".join([*self.parts, self.gzip.flush()])


class CaptureWriter(DataSourceArrowWriter, DataSourceStreamArrowWriter):
    """Rows of LINES as objects `capture/[day/]pod-number.jsonl.gz`, numbers from 1 in each task's pod.

    Options: path (the root), pod (its name; a task's partition and the run are added), maxBytes, maxRows and maxAge of an object, and manifests, JSON
    of fields by capture: those captures get a manifest, without a row too. Its digest is that of the lines in order where one task wrote
    them all, else it has none. With publish=false they only lose old objects and manifests, and who writes gives them theirs.
    """

    def __init__(self, options: dict, overwrite: bool):
        options = {k.lower(): v for k, v in options.items()}
        self.root, self.pod = options["path"], options.get("pod") or "spark"
        self.max_bytes, self.max_age = int(options.get("maxbytes", MAX_BYTES)), float(options.get("maxage", MAX_AGE_S))
        self.max_rows = int(options.get("maxrows", 1 << 62))
        self.manifests: dict[str, dict] = json.loads(options.get("manifests") or "{}")
        self.published = options.get("publish", "true") == "true"
        self.overwrite, self.run = overwrite, uuid.uuid4().hex
        self.query = options.get("query", "")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        store, part = Store(self.root), TaskContext.get().partitionId()
        stage, number, said = f"_staged/{self.run}/{uuid.uuid4().hex}", 0, Written()
        buffers: dict[tuple[str, str | None], Buffer] = {}
        sums: dict[str, list] = {}

        def end(folder: tuple[str, str | None]) -> None:
            nonlocal number
            number += 1
            b, (capture, day) = buffers.pop(folder), folder
            name = f"{self.pod}-{{}}-p{part:05d}-{number:06d}.jsonl.gz"  # the commit names the run
            store.write(f"{stage}/{number}", b.data())
            said.objects.append((f"{stage}/{number}", "/".join(x for x in (capture, day, name) if x), b.rows, b.bytes))

        for batch in iterator:
            for capture, day, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data, folder = line.encode() + b"\n", (capture, day)
                b = buffers.get(folder)
                if b is None:
                    b = buffers[folder] = Buffer()
                b.add(data)
                known = sums.get(capture)
                if known is None:
                    known = sums[capture] = [0, hashlib.sha256()]
                known[0] += 1
                known[1].update(data)
                if b.bytes >= self.max_bytes or b.rows >= self.max_rows or time.monotonic() - b.since >= self.max_age:
                    end(folder)
            while sum(b.bytes for b in buffers.values()) > max(TASK_BYTES, self.max_bytes):
                end(max(buffers, key=lambda f: buffers[f].bytes))
        for folder in list(buffers):
            end(folder)
        said.captures = {c: (n, h.hexdigest()) for c, (n, h) in sums.items()}
        return said

    def commit(self, messages: list[Written | None], batchId: int | None = None) -> None:
        """Lists what is to be moved, moves it, then writes manifests. A batch whose list is there already is finished, not written again."""
        store, said = Store(self.root), [m for m in messages if m is not None]
        name = f"r{self.run[:8]}" if batchId is None else f"b{batchId:08d}"
        log = f"_commits/{self.query or self.pod}/{name}.json" if batchId is not None else None
        known = store.read(log) if log else None
        moves = json.loads(known) if known else [(a, b.format(name)) for m in said for a, b, _, _ in m.objects]
        if log and not known:
            store.write(log, json.dumps(moves).encode())
        old: list[str] = []
        if self.overwrite:
            for capture in {*self.manifests, *(c for m in said for c in m.captures)}:
                store.forget(f"{capture}/manifest.json")
                old += [k for k, _ in store.find(capture)]
        with ThreadPoolExecutor(MOVES) as pool:
            list(pool.map(store.forget, old))
            list(pool.map(lambda x: store.move(*x), moves))
        store.remove(f"_staged/{self.run}")
        if not known and self.published:
            self.publish(store, said)

    def publish(self, store: Store, said: list[Written]) -> None:
        parts = defaultdict(list)
        for m in said:
            for capture, x in m.captures.items():
                parts[capture].append(x)
        for capture, fields in self.manifests.items():
            found = parts.get(capture, [])
            digest = hashlib.sha256().hexdigest() if not found else found[0][1] if len(found) == 1 else None
            store.write(f"{capture}/manifest.json", manifest_of(capture, sum(n for n, _ in found), digest, fields))

    def abort(self, messages: list[Written | None], batchId: int | None = None) -> None:
        Store(self.root).remove(f"_staged/{self.run}")


class CaptureSource(DataSource):
    """The format `capture`."""

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return ROW

    def reader(self, schema) -> CaptureReader:
        return CaptureReader(dict(self.options), schema)

    def streamReader(self, schema) -> CaptureStream:
        return CaptureStream(dict(self.options), schema)

    def writer(self, schema, overwrite: bool) -> CaptureWriter:
        return CaptureWriter(dict(self.options), overwrite)

    def streamWriter(self, schema, overwrite: bool) -> CaptureWriter:
        return CaptureWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with filters pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CaptureSource)
