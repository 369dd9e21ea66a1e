"""Reading and writing captures: gzip JSON lines by UTC day, slices of shards, manifests, reports."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..operators import policy as D
from ..operators import select as S
from . import objects

#: Times are written to the microsecond, not to the millisecond that is the default.
MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
#: Seconds of an object in a batch, where age doesn't matter.
UNAGED = 1 << 30
#: Rows of a range of a slice that one task sorts and writes.
RANGE_ROWS = 100_000


#: What a line is parsed with; the field tells a line that isn't JSON, or has a value that its column can't have.
CORRUPT = "_corrupt_record"
PARSING = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "allowSingleQuotes": "false"}


def below(spark: SparkSession, root: str, path: Column, escaped: bool = True) -> Column:
    """A path without the root that it lies in, cut off by length; escaped as in `_metadata.file_path`, or plain."""
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    uri = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toUri()
    base = (uri.getRawPath() if escaped else uri.getPath()).rstrip("/")
    return F.substr(F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), F.lit(len(base) + 2))


def _day(key: Column | str) -> Column:
    """The first part of an object's key that is a date, as `2026-01-15` or `day=2026-01-15`."""
    return F.try_to_date(F.regexp_extract(key, r"(?:^|/)(?:day=)?(\d{4}-\d{2}-\d{2})/", 1), "yyyy-MM-dd")


def parsed(lines: DataFrame) -> DataFrame:
    """lines (value and others) with `request`, null where the line is malformed: no JSON object, or a value that its column can't have.

    All columns are parsed whatever is selected later, so that a line is good or not for every reader. A line without an id is good,
    a blank one isn't. What follows a whole object up to the line's last brace isn't looked at.
    """
    whole = F.from_json("value", f"{schemas.REQUEST}, {CORRUPT} string", PARSING)
    text = F.btrim("value", F.lit(" \t\r\n"))
    good = text.startswith("{") & text.endswith("}") & F.col("_parsed").isNotNull() & F.col(f"_parsed.{CORRUPT}").isNull()
    return lines.withColumn("_parsed", whole).withColumn("request", F.when(good, F.col("_parsed"))).drop("_parsed")


def _lines(spark: SparkSession, root: str, capture_id: str, start: dt.datetime | None = None, end: dt.datetime | None = None) -> DataFrame:
    """object_key, capture_date and value of a capture's lines. Objects of days outside the range aren't opened: their paths are all that the
    filter needs, so Spark applies it to the listing."""
    at = f"{root.rstrip('/')}/{capture_id}"
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.gz").text(at)
    day = _day(below(spark, root, F.col("_metadata.file_path")))
    return df.where(S.by_day(start, end, day)).select("value", F.col("_metadata.file_path").alias("object_key"), day.alias("capture_date"))


def read_lines(spark: SparkSession, root: str, capture_id: str, start: dt.datetime | None = None, end: dt.datetime | None = None) -> DataFrame:
    """A capture's lines as they are stored, with their object, their place in it and `request`, null for a malformed one.

    Gzip objects aren't split, so rows of one keep their order.
    """
    df = _lines(spark, root, capture_id, start, end).withColumn("_n", F.monotonically_increasing_id())
    line = F.col("_n") - F.min("_n").over(Window.partitionBy("object_key"))
    return parsed(df.withColumn("line", line).drop("_n"))


def read_capture(spark: SparkSession, root: str, capture_id: str, start: dt.datetime | None = None, end: dt.datetime | None = None) -> DataFrame:
    """A capture's good rows. A time range leaves out whole days by their folders, then rows; both ends belong to it.

    An object without a date in its key is read. Object and line are in the result only of read_lines, which orders for them.
    """
    df = parsed(_lines(spark, root, capture_id, start, end)).where("request is not null")
    return df.select(*[F.col(f"request.{c}").alias(c) for c in schemas.REQUEST_COLUMNS], "object_key", "capture_date").where(S.in_time(start, end))


def rejects(spark: SparkSession, root: str, capture_id: str) -> DataFrame:
    """Malformed lines with their object and place: those that read_capture leaves out of the days that it reads."""
    return read_lines(spark, root, capture_id).where("request is null").select("object_key", "line", F.col("value").alias("text"))


def slice_id(capture_id: str, index: int | str, count: int) -> str:
    """The capture that a slice is."""
    return f"{capture_id}/shards/{index}-of-{count}"


def read_slice(spark: SparkSession, root: str, capture_id: str, index: int, count: int) -> DataFrame:
    """A shard that was written by write_shards; no hash is looked at again."""
    return read_capture(spark, root, slice_id(capture_id, index, count)).drop("object_key", "capture_date")


#: capture, day, writer and number in the key of an object, as agents name it or as Spark's writer does.
OBJECT_KEY = r"^(?:(.*?)/)?(?:day=)?(\d{4}-\d{2}-\d{2})/([^/]+?)-(\d{5,})(?:[-.][^/]*)?\.jsonl?\.gz$"


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """Objects under a root with size, time and what their keys say; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json*.gz").load(root).select("path", "length", "modificationTime")
    key = below(spark, root, F.col("path"), escaped=False)
    part = lambda i: F.nullif(F.regexp_extract(key, OBJECT_KEY, i), F.lit(""))
    of = F.struct(part(1).alias("capture_id"), F.try_to_date(part(2), "yyyy-MM-dd").alias("day"), part(3).alias("pod"), part(4).cast("long").alias("seq"))
    return files.select("path", key.alias("key"), "length", F.col("modificationTime").alias("modified"), of.alias("of"))


def capture_bytes(spark: SparkSession, root: str) -> DataFrame:
    """Objects, compressed and uncompressed bytes and lines of each capture and day under a root."""
    of = inventory(spark, root).groupBy("of.capture_id", "of.day").agg(F.count("*").alias("objects"), F.sum("length").alias("compressed_bytes"))
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json*.gz").text(root).select(F.col("_metadata.file_path").alias("path"), (F.octet_length("value") + 1).alias("bytes"))
    each = lines.groupBy("path").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows"))
    key = below(spark, root, F.col("path"))
    sums = each.groupBy(F.nullif(F.regexp_extract(key, OBJECT_KEY, 1), F.lit("")).alias("_c"), F.try_to_date(F.regexp_extract(key, OBJECT_KEY, 2), "yyyy-MM-dd").alias("_d")).agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("n"))
    return of.join(sums, of.capture_id.eqNullSafe(F.col("_c")) & of.day.eqNullSafe(F.col("_d"))).drop("_c", "_d")


def _stored(df: DataFrame, capture: Column, day: Column, *others: Column | str) -> DataFrame:
    """Rows as the capture format writes them; empty fields are left out and bodies are base-64."""
    names = [c for c in schemas.REQUEST_COLUMNS if c in df.columns]
    return df.select(capture.alias("capture"), day.cast("string").alias("day"), F.to_json(F.struct(*names), {"timestampFormat": MICROS}).alias("line"), *others)


def write_capture(df: DataFrame, root: str, capture_id: str, rows_per_object: int | None = None, pod: str = "spark", max_bytes: int = objects.MAX_BYTES, manifest: bool = False) -> None:
    """Gzip JSON lines in folders of the events' UTC days, in objects of max_bytes at most (and rows_per_object, where given), named by pod and number.

    Rows are brought together by day, a large day to several tasks, and sorted by time in each; nothing is visible before the commit,
    which writes a manifest last if asked to.
    """
    objects.register(df.sparkSession)
    out = _stored(df, F.lit(capture_id), F.date_format("timestamp", "'day='yyyy-MM-dd"), "timestamp").hint("rebalance", "day").sortWithinPartitions("day", "timestamp").drop("timestamp")
    w = out.write.format("capture").mode("overwrite").option("path", root).option("pod", pod).option("maxBytes", max_bytes).option("maxAge", UNAGED)
    w = w.option("maxRows", rows_per_object) if rows_per_object else w
    w.option("manifests", json.dumps({capture_id: {}} if manifest else {})).save()


def write_shards(df: DataFrame, root: str, capture_id: str, count: int, rows_per_object: int | None = None, max_bytes: int = objects.MAX_BYTES) -> DataFrame:
    """Every row in one of `count` slices, in the order of object_key and line where there are such columns, else of time and id; gives shard, n and sha256 of each.

    One shuffle deals ranges of a slice's order, about RANGE_ROWS each however many there are, to tasks, which sort and write them; objects are named by the place of their range, so
    that keys have the slice's order. The digest is that of the slice's lines in it, taken from what is stored by a task a slice. Manifests are written after all data, for empty slices too.
    """
    if count < 2:
        raise ValueError("a split has two shards or more")
    objects.register(df.sparkSession)
    order = ["object_key", "line"] if {"object_key", "line"} <= set(df.columns) else ["timestamp", "id"]
    named = S.with_shard(df, count)
    rows = _stored(named, F.concat(F.lit(f"{capture_id}/shards/"), F.col("shard").cast("string"), F.lit(f"-of-{count}")), F.lit(None), "shard", *(F.col(c).alias(f"_order{i}") for i, c in enumerate(order)))
    ranges = max(count, -(-df.count() // RANGE_ROWS))
    rows = rows.repartitionByRange(ranges, "shard", "_order0", "_order1").sortWithinPartitions("shard", "_order0", "_order1").select("capture", "day", "line")
    store, ids = objects.Store(root), [slice_id(capture_id, i, count) for i in range(count)]
    w = rows.write.format("capture").mode("overwrite").option("path", root).option("pod", "slice").option("maxBytes", max_bytes).option("maxAge", UNAGED)
    w = w.option("manifests", json.dumps(dict.fromkeys(ids, {}))).option("publish", "false")
    (w.option("maxRows", rows_per_object) if rows_per_object else w).save()
    for r in slice_digests(df.sparkSession, root, capture_id, count).collect():
        fields = {"shardIndex": r.shard, "shardCount": count, "sourceCaptureID": capture_id}
        store.write(f"{ids[r.shard]}/manifest.json", objects.manifest_of(ids[r.shard], r.n, r.sha256, fields))
    return slice_manifests(df.sparkSession, root, capture_id, count).select(F.col("shardIndex").alias("shard"), F.col("recordCount").alias("n"), "sha256")


def slice_manifests(spark: SparkSession, root: str, capture_id: str, count: int) -> DataFrame:
    """The manifests of a capture's slices."""
    return read_manifests(spark, f"{root.rstrip('/')}/{capture_id}/shards/*-of-{count}/manifest.json")


def slice_digests(spark: SparkSession, root: str, capture_id: str, count: int) -> DataFrame:
    """shard, n and sha256 of each of `count` slices as they are stored now: lines in order of the objects' keys.

    A slice is read by one task, a piece of an object at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = objects.Store(root)
        for batch in batches:
            for i in batch.column("shard").to_pylist():
                found, n = hashlib.sha256(), 0
                for key, _ in store.find(slice_id(capture_id, i, count)):
                    for piece in store.pieces(key):
                        found.update(piece)
                        n += piece.count(b"\n")
                yield pa.RecordBatch.from_pydict({"shard": pa.array([i], pa.int32()), "n": pa.array([n], pa.int64()), "sha256": [found.hexdigest()]})

    return spark.range(0, count, 1, count).select(F.col("id").cast("int").alias("shard")).mapInArrow(run, "shard int, n long, sha256 string")


def manifests_of(counts: DataFrame, capture_id: str, count: int) -> DataFrame:
    return counts.select(F.lit(D.VERSION).alias("formatVersion"), F.concat(F.lit(f"{capture_id}/shards/"), F.col("shard").cast("string"), F.lit(f"-of-{count}")).alias("captureID"), F.col("n").alias("recordCount"), "sha256", F.col("shard").alias("shardIndex"), F.lit(count).alias("shardCount"), F.lit(capture_id).alias("sourceCaptureID"))


def find_manifests(spark: SparkSession, pattern: str) -> DataFrame:
    """Manifests under a pattern, no row where there is none."""
    try:
        return read_manifests(spark, pattern)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schemas.MANIFEST)


def read_manifests(spark: SparkSession, pattern: str) -> DataFrame:
    return spark.read.schema(schemas.MANIFEST).option("multiLine", True).json(pattern)


def spark_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Manifests that were written as lines of a table."""
    return spark.read.schema(schemas.MANIFEST).json(path)


def write_reports(reports: DataFrame, path: str) -> None:
    """A line for each run."""
    reports.coalesce(1).write.mode("overwrite").json(path)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.REPORT).json(path)


def read_script_exports(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SCRIPT_EXPORT).option("multiLine", True).json(path).withColumn("path", F.input_file_name())


def read_call_reports(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CALL_REPORT).option("multiLine", True).json(path)


def heartbeat_tables(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Heartbeats' nested captures and replays as two tables."""
    captures = events.select("spoke_id", "ts", F.explode("captures").alias("c")).select("spoke_id", "ts", "c.*")
    replays = events.select("spoke_id", "ts", F.explode("replays").alias("r")).select("spoke_id", "ts", "r.*")
    return captures, replays


def is_empty(df: DataFrame, manifests: DataFrame | None = None) -> bool:
    """If a capture has nothing to replay: by its manifest's count where there is one, else by a look at one row."""
    said = manifests.select("recordCount").where("recordCount is not null").first() if manifests is not None else None
    return said[0] == 0 if said else df.isEmpty()
