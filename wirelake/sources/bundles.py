"""Replay datasets as files: bundles of records in order of their offsets, an index of them, and one of buckets of time.

A task packs the records of a span in order and writes a bundle when it is full; its index row, with the digest of the
stored bytes, is what the task returns. Files are named by attempt, so what a lost attempt wrote is in no index. The
manifest is written last.
"""

from __future__ import annotations

import datetime as dt
import gzip
import hashlib
import io
import json
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .objects import PIECE_BYTES, Store

#: Bytes of lines at which a bundle ends, and that it never exceeds but for a single record (a fixed value); a span and a bucket of time.
TARGET, MOST, SPAN_NS, WIDTH_NS = 128 << 20, 256 << 20, 10_000_000_000, 1_000_000_000
INDEX = "capture_id string, bundle_id string, uri string, first_ns long, last_ns long, n long, compressed_bytes long, bytes long, sha256 string, routes map<string,bigint>, buckets array<struct<bucket:bigint,n:bigint,bytes:bigint>>"
VERSION = 1
#: Index rows that a task returns at a time.
INDEX_ROWS = 500


class Bundle:
    """Records that one task packs together."""

    def __init__(self, capture: str, span: int, number: int):
        self.capture, self.id = capture, f"{capture}/span={span:08d}/bundle-{number:06d}"
        self.gzip, self.parts, self.n, self.bytes = zlib.compressobj(6, zlib.DEFLATED, 31), [], 0, 0
        self.first, self.last, self.routes, self.buckets = None, None, Counter(), {}

    def add(self, offset: int, route: str, line: bytes, width: int) -> None:
        self.parts.append(self.gzip.compress(line))
        self.first, self.last = offset if self.first is None else self.first, offset
        self.n += 1
        self.bytes += len(line)
        self.routes[route] += 1
        of = self.buckets.setdefault(offset // width, [0, 0])
        of[0] += 1
        of[1] += len(line)

    def written(self, store: Store, attempt: str) -> dict:
        data = b"".join([*self.parts, self.gzip.flush()])
        uri = f"bundles/{self.id}-{attempt}.jsonl.gz"
        store.write(uri, data)
        buckets = [{"bucket": b, "n": n, "bytes": size} for b, (n, size) in sorted(self.buckets.items())]
        return {"capture_id": self.capture, "bundle_id": self.id, "uri": uri, "first_ns": self.first, "last_ns": self.last, "n": self.n, "compressed_bytes": len(data), "bytes": self.bytes, "sha256": hashlib.sha256(data).hexdigest(), "routes": list(self.routes.items()), "buckets": buckets}


def write_bundles(records: DataFrame, root: str, target: int = TARGET, most: int = MOST, span_ns: int = SPAN_NS, width_ns: int = WIDTH_NS, per_agent: float = 1000.0, headroom: float = 1.2) -> None:
    """Writes records (capture_id, id, offset_ns, route_key and others) as bundles with indexes/bundles, indexes/time-buckets and manifest.json.

    A bundle ends at `target` bytes of lines, before a record that would bring it over `most`, and with its span. A bucket's row has the
    bundles that hold its records, with their counts, and the agents that it needs at per_agent requests a bucket.
    """
    names = [c for c in records.columns if c != "capture_id"]
    rows = records.select(F.coalesce("capture_id", F.lit("")).alias("capture_id"), F.floor(F.col("offset_ns") / span_ns).cast("long").alias("span"), "offset_ns", "id", F.coalesce("route_key", F.lit("")).alias("route"), F.to_json(F.struct(*names)).alias("line"))
    rows = rows.repartition("capture_id", "span").sortWithinPartitions("capture_id", "span", "offset_ns", "id").drop("id")
    kinds = {"capture_id": pa.string(), "bundle_id": pa.string(), "uri": pa.string(), "first_ns": pa.int64(), "last_ns": pa.int64(), "n": pa.int64(), "compressed_bytes": pa.int64(), "bytes": pa.int64(), "sha256": pa.string(), "routes": pa.map_(pa.string(), pa.int64()), "buckets": pa.list_(pa.struct([("bucket", pa.int64()), ("n", pa.int64()), ("bytes", pa.int64())]))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, attempt, open_, at, number = Store(root), uuid.uuid4().hex[:12], None, None, 0
        done: list[dict] = []
        rows = lambda: pa.RecordBatch.from_pylist(done, pa.schema(list(kinds.items())))
        for batch in batches:
            for capture, span, offset, route, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = line.encode() + b"\n"
                if open_ and ((capture, span) != at or open_.bytes >= target or open_.bytes + len(data) > most):
                    done.append(open_.written(store, attempt))
                    open_ = None
                    if len(done) == INDEX_ROWS:
                        yield rows()
                        done = []
                if (capture, span) != at:
                    at, number = (capture, span), 0
                if open_ is None:
                    number += 1
                    open_ = Bundle(capture, span, number)
                open_.add(offset, route, data, width_ns)
        if open_:
            done.append(open_.written(store, attempt))
        if done:
            yield rows()

    store = Store(root)
    store.forget("manifest.json")
    rows.mapInArrow(run, INDEX).write.mode("overwrite").parquet(f"{root}/indexes/bundles")
    index = read_index(records.sparkSession, root)
    bucket_index(index, per_agent, headroom).write.mode("overwrite").parquet(f"{root}/indexes/time-buckets")
    sums = index.agg(F.count("*").alias("bundles"), F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("compressed_bytes"), F.lit(0)).alias("compressed")).first()
    said = {"formatVersion": VERSION, "recordCount": sums.records, "bundleCount": sums.bundles, "uncompressedBytes": sums.bytes, "compressedBytes": sums.compressed, "bucketWidthNs": width_ns, "createdAt": dt.datetime.now(dt.UTC).isoformat()}
    store.write("manifest.json", json.dumps(said).encode())


def bucket_index(index: DataFrame, per_agent: float, headroom: float) -> DataFrame:
    """A row for each bucket with records: counts, bytes, the bundles that hold them, and the agents that it needs."""
    parts = index.select("capture_id", "bundle_id", "uri", F.explode("buckets").alias("b"))
    rows = parts.groupBy("capture_id", "b.bucket").agg(F.sum("b.n").alias("n"), F.sum("b.bytes").alias("bytes"), F.array_sort(F.collect_list(F.struct("bundle_id", "uri", F.col("b.n").alias("n")))).alias("bundles"))
    return rows.withColumn("required_agents", F.ceil(F.col("n") / per_agent * headroom).cast("long"))


def read_index(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{root}/indexes/bundles")


def read_buckets(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/indexes/time-buckets")


def uris_of(spark: SparkSession, root: str, capture_id: str, first: int, last: int) -> list[str]:
    """The bundles that hold a capture's records of some buckets, of a lease for instance."""
    found = read_buckets(spark, root).where((F.col("capture_id") == capture_id) & F.col("bucket").between(first, last))
    return sorted(r.uri for r in found.select(F.explode("bundles.uri").alias("uri")).distinct().collect())


def read_records(spark: SparkSession, root: str, schema: str, capture_id: str, first: int, last: int, width_ns: int = WIDTH_NS) -> DataFrame:
    """A capture's records of some buckets; no other bundle is opened. schema has offset_ns."""
    uris = uris_of(spark, root, capture_id, first, last)
    if not uris:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).json([f"{root}/{u}" for u in uris])
    return rows.where(F.floor(F.col("offset_ns") / width_ns).between(first, last))


def lines_of(data: bytes) -> int:
    """Lines of a stored bundle, unpacked a piece at a time."""
    n, last = 0, b"\n"
    with gzip.GzipFile(fileobj=io.BytesIO(data)) as f:
        while piece := f.read(PIECE_BYTES):
            n, last = n + piece.count(b"\n"), piece
    return n + (not last.endswith(b"\n"))


def bundle_faults(spark: SparkSession, root: str) -> DataFrame:
    """Bundles whose stored bytes or lines aren't those of the index; a task reads a bundle at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(root)
        for batch in batches:
            found = []
            for b, uri, sha, n in zip(*(batch.column(c).to_pylist() for c in ("bundle_id", "uri", "sha256", "n")), strict=True):
                data = store.read(uri)
                if data is None:
                    found.append((b, "missing"))
                elif hashlib.sha256(data).hexdigest() != sha:
                    found.append((b, "sha256 differs"))
                elif lines_of(data) != n:
                    found.append((b, "record count differs"))
            yield pa.RecordBatch.from_pydict({"bundle_id": pa.array([x for x, _ in found], pa.string()), "fault": pa.array([x for _, x in found], pa.string())})

    return read_index(spark, root).select("bundle_id", "uri", "sha256", "n").mapInArrow(run, "bundle_id string, fault string")
