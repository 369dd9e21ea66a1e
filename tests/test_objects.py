"""Captures as a data source: objects by bytes and age, commits, read order, malformed lines, dates and keys below the root."""

import datetime as dt
import gzip
import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F
from wirelake import schemas
from wirelake.operators import select as S
from wirelake.plans import schedule as W
from wirelake.sources import lake, objects

BASE = dt.datetime(2026, 1, 15, 12)


@pytest.fixture(scope="module")
def requests(spark):
    rows = [(f"req-{i:05d}", BASE + dt.timedelta(minutes=i), "GET", f"/p/{i}", {"A": [str(i), "b"]}, b"body \xff" * (i % 5), i, "HTTP/1.1", {"host": "h"}) for i in range(2000)]
    return spark.createDataFrame(rows, schemas.REQUEST).repartition(6).cache()


def put(folder, name, lines):
    folder.mkdir(parents=True, exist_ok=True)
    with gzip.open(folder / name, "wt") as f:
        f.write("".join(x + "\n" for x in lines))


def source(spark, root, capture, **options):
    objects.register(spark)
    return spark.read.format("capture").option("path", str(root)).option("capture", capture).options(**options).load()


def rows_of(df):
    key = lambda m: None if m is None else tuple(sorted((k, v if isinstance(v, str) else tuple(v)) for k, v in m.items()))
    return sorted((r.id or "", str(r.timestamp), r.method, r.path, key(r.headers), r.body, r.contentLength, r.protocol, key(r.metadata)) for r in df.collect())


LINES = [
    ('{"id":"good","timestamp":"2026-01-15T12:00:00Z","method":"GET","path":"/p","body":"/w==","contentLength":3,"headers":{"A":["x","y"]},"metadata":{"host":"h"}}', True),
    ('{"timestamp":"2026-01-15T12:00:01.123456Z","method":"NOID"}', True),
    ('{"id":"when","timestamp":"soon"}', False),
    ("not json", False),
    ("", False),
    ("null", False),
    ('[{"id":"list"}]', False),
    ('{"id":"cut', False),
    ('{"id":"tail"} x', False),
    ("{'id':'quotes'}", False),
    ('{"id":"body","body":"@@"}', False),
    ('{"id":"length","contentLength":"7"}', False),
    ('{"id":"headers","headers":{"a":"b"}}', False),
    (' {"id":7,"other":[1,2]} ', True),
    ("{}", True),
]


def test_a_line_is_good_or_a_reject_whatever_is_read(spark, tmp_path):
    put(tmp_path / "ns/c/2026-01-15", "a-000001.jsonl.gz", [x for x, _ in LINES])
    good = sum(g for _, g in LINES)
    df = lake.read_capture(spark, str(tmp_path), "ns/c")
    assert df.count() == good == len(df.select("id").collect()) == len(df.collect()) == len(df.select("method", "timestamp").collect())
    assert sorted(r.id or "" for r in df.collect()) == ["", "", "7", "good"]
    bad = {r.line: r.text for r in lake.rejects(spark, str(tmp_path), "ns/c").collect()}
    assert bad == {i: x for i, (x, g) in enumerate(LINES) if not g}
    read = source(spark, tmp_path, "ns/c")
    assert rows_of(read) == rows_of(df) and read.count() == good and read.select("id").count() == good
    assert [r.line for r in read.orderBy("line").collect()] == [i for i, (_, g) in enumerate(LINES) if g]


def test_dates_and_keys_are_looked_for_below_the_root(spark, requests, tmp_path):
    root = tmp_path / "2020-05-05" / "data lake" / "lake"
    lake.write_capture(requests, str(root), "ns/c")
    day = lake.read_capture(spark, str(root), "ns/c", BASE, BASE + dt.timedelta(hours=1))
    assert day.count() == 61 and lake.read_capture(spark, str(root), "ns/c").where("capture_date is not null").count() == 2000
    found = lake.inventory(spark, str(root)).select("key", "of.*").collect()
    assert {r.capture_id for r in found} == {"ns/c"} and all(r.key.startswith("ns/c/day=") for r in found)
    sizes = lake.capture_bytes(spark, str(root)).collect()
    assert {r.capture_id for r in sizes} == {"ns/c"} and sum(r.n for r in sizes) == 2000
    assert source(spark, root, "ns/c", start="2026-01-15T12:00:00", end="2026-01-15T13:00:00").count() == 61


def test_filters_leave_out_days_before_they_are_listed(spark, requests, tmp_path):
    lake.write_capture(requests, str(tmp_path), "ns/c")
    for day in ("2026-01-13", "day=2026-01-18", "2026-01-19"):
        (tmp_path / "ns/c" / day).mkdir(parents=True)
        (tmp_path / "ns/c" / day / "a-000001.jsonl.gz").write_bytes(b"no gzip")  # opening it fails
    df = source(spark, tmp_path, "ns/c").where((F.col("timestamp") >= F.lit(BASE)) & (F.col("timestamp") < F.lit(BASE + dt.timedelta(minutes=90))))
    assert df.count() == 90
    reader = objects.CaptureReader({"path": str(tmp_path), "capture": "ns/c", "start": "2026-01-16T00:00:00", "end": "2026-01-16T10:00:00"})
    assert {k.split("/")[2] for p in reader.partitions() for k in p.keys} == {"day=2026-01-16"}
    all_ = objects.CaptureReader({"path": str(tmp_path), "capture": "ns/c"})
    list(all_.pushFilters([objects.LessThanOrEqual(("timestamp",), BASE), objects.GreaterThan(("other",), BASE)]))
    assert {k.split("/")[2] for p in all_.partitions() for k in p.keys} == {"2026-01-13", "day=2026-01-15"}
    with pytest.raises(Exception, match="(?i)gzip"):
        source(spark, tmp_path, "ns/c").count()


def test_source_reads_what_was_written(spark, requests, tmp_path):
    lake.write_capture(requests, str(tmp_path), "ns/c", max_bytes=20_000)
    df = source(spark, tmp_path, "ns/c", partitionBytes="4000")
    assert df.rdd.getNumPartitions() > 2
    assert rows_of(df) == rows_of(requests) == rows_of(lake.read_capture(spark, str(tmp_path), "ns/c"))
    assert source(spark, tmp_path, "ns/nothing").count() == 0
    with pytest.raises(Exception, match="read_capture"):
        source(spark, "viewfs://store/in", "ns/c").count()


def test_objects_end_at_bytes_or_rows_and_are_numbered(spark, requests, tmp_path):
    lake.write_capture(requests, str(tmp_path), "ns/c", max_bytes=10_000, pod="agent")
    found = lake.inventory(spark, str(tmp_path)).select("key", "length", "of.*").collect()
    pods = {}
    for r in found:
        pods.setdefault(r.pod, []).append(r.seq)
    assert all(p.startswith("agent-") and sorted(n) == list(range(1, len(n) + 1)) for p, n in pods.items())
    for r in found:
        with gzip.open(tmp_path / r.key) as f:
            lines = f.read().splitlines(keepends=True)
        assert sum(map(len, lines)) - len(lines[-1]) < 10_000
        times = [json.loads(x)["timestamp"] for x in lines]
        assert times == sorted(times)
    lake.write_capture(requests, str(tmp_path), "ns/c", 100)
    assert all(sum(1 for _ in gzip.open(tmp_path / r.key)) <= 100 for r in lake.inventory(spark, str(tmp_path)).select("key").collect())
    assert lake.read_capture(spark, str(tmp_path), "ns/c").count() == 2000  # the older objects are gone
    assert not list((tmp_path / "_staged").glob("*"))


def test_lines_end_an_object_when_it_is_old(tmp_path, monkeypatch):
    import pyarrow as pa
    from pyspark import TaskContext

    clock = [0.0]
    monkeypatch.setattr(objects.time, "monotonic", lambda: clock[0])
    monkeypatch.setattr(TaskContext, "get", classmethod(lambda cls: type("T", (), {"partitionId": lambda self: 3})()))

    def batches():
        for i in range(10):
            clock[0] = i
            yield pa.RecordBatch.from_pydict({"capture": ["c"], "day": ["2026-01-15"], "line": [f"line {i}"]})

    said = objects.CaptureWriter({"path": str(tmp_path), "maxAge": "4"}, False).write(batches())
    assert [n for _, _, n, _ in said.objects] == [5, 5] and said.captures["c"] == (10, hashlib.sha256("".join(f"line {i}\n" for i in range(10)).encode()).hexdigest())
    assert not list(tmp_path.glob("c/**/*"))  # nothing is visible before the commit


def test_a_failed_task_leaves_nothing(spark, requests, tmp_path):
    lake.write_capture(requests.limit(10), str(tmp_path), "ns/c", manifest=True)
    spoiled = requests.withColumn("path", F.when(F.col("id") == "req-01999", F.raise_error(F.lit("spoiled"))).otherwise(F.col("path")))
    with pytest.raises(Exception, match="spoiled"):
        lake.write_capture(spoiled, str(tmp_path), "ns/c", max_bytes=5_000, manifest=True)
    assert lake.read_capture(spark, str(tmp_path), "ns/c").count() == 10
    assert lake.read_manifests(spark, str(tmp_path / "ns/c/manifest.json")).first().recordCount == 10
    assert not list((tmp_path / "_staged").glob("*"))


def test_a_job_that_ends_before_its_manifests_publishes_none(spark, requests, tmp_path):
    """The commit is stopped between data and manifests; another run makes the slices whole."""
    messages = [objects.Written([("_staged/x/1", "ns/c/shards/0-of-2/slice-{}-00000-000001.jsonl.gz", 1, 1)], {"ns/c/shards/0-of-2": (1, "d")})]
    store = objects.Store(str(tmp_path))
    store.write("_staged/x/1", gzip.compress(b"{}\n"))
    writer = objects.CaptureWriter({"path": str(tmp_path), "manifests": json.dumps({"ns/c/shards/0-of-2": {}})}, False)
    writer.publish = lambda *a: (_ for _ in ()).throw(KeyboardInterrupt())
    with pytest.raises(KeyboardInterrupt):
        writer.commit(messages)
    assert store.find("ns/c/shards/0-of-2") and not list(tmp_path.glob("ns/c/shards/*/manifest.json"))
    lake.write_shards(requests, str(tmp_path), "ns/c", 2)
    assert sum(r.recordCount for r in lake.slice_manifests(spark, str(tmp_path), "ns/c", 2).collect()) == 2000
    assert sum(lake.read_slice(spark, str(tmp_path), "ns/c", i, 2).count() for i in range(2)) == 2000


def test_slices_are_dealt_to_tasks_by_their_rows(spark, tmp_path, monkeypatch):
    """A range has so many rows however many there are, whatever the shuffle's number of partitions; the order and the digests stay."""
    monkeypatch.setattr(lake, "RANGE_ROWS", 100)
    rows = spark.range(0, 2000, 1, 3).select(F.concat(F.lit("r"), "id").alias("id"), F.timestamp_seconds(F.lit(10**9) - F.col("id")).alias("timestamp"))
    said = {r.shard: r.sha256 for r in lake.write_shards(rows, str(tmp_path), "ns/c", 2).collect()}
    for i in range(2):
        found = sorted((tmp_path / lake.slice_id("ns/c", i, 2)).glob("*.jsonl.gz"))
        lines = [gzip.decompress(f.read_bytes()).splitlines() for f in found]
        times = [json.loads(x)["timestamp"] for part in lines for x in part]
        assert len(found) > 5 and max(map(len, lines)) < 300 and times == sorted(times)
        assert hashlib.sha256(b"".join(gzip.decompress(f.read_bytes()) for f in found)).hexdigest() == said[i]


def test_a_batch_that_comes_again_is_finished(tmp_path):
    """A stream's commit stops half-way; the same batch is written again under another run: each row is there once."""
    store = objects.Store(str(tmp_path))

    def staged(run):
        out = []
        for i in (1, 2, 3):
            store.write(f"_staged/{run}/t/{i}", gzip.compress(f'{{"id":"{i}"}}\n'.encode()))
            out.append((f"_staged/{run}/t/{i}", f"ns/c/day=2026-01-15/agent-{{}}-p00000-{i:06d}.jsonl.gz", 1, 10))
        return [objects.Written(out, {"ns/c": (3, "d")})]

    one, two = (objects.CaptureWriter({"path": str(tmp_path), "query": "q"}, False) for _ in range(2))
    moved, move = [], objects.Store.move
    try:
        objects.Store.move = lambda self, a, b: moved.append(a) or (move(self, a, b) if len(moved) < 2 else (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            one.commit(staged(one.run), 7)
    finally:
        objects.Store.move = move
    two.commit(staged(two.run), 7)
    assert [k.rsplit("/", 1)[-1] for k, _ in store.find("ns/c")] == [f"agent-b00000007-p00000-{i:06d}.jsonl.gz" for i in (1, 2, 3)]
    assert sorted(json.loads(x)["id"] for k, _ in store.find("ns/c") for x in store.lines(k)) == ["1", "2", "3"]


def test_slices_keep_the_order_of_their_source(spark, requests, tmp_path):
    """A schedule as recorded spans a slice's true time, and its digest is that of the lines in order."""
    rows = requests.withColumn("object_key", F.lit("k")).withColumn("line", F.col("contentLength"))
    counts = {r.shard: r for r in lake.write_shards(rows, str(tmp_path), "ns/c", 3, max_bytes=20_000).collect()}
    stored = {r.shard: (r.n, r.sha256) for r in lake.slice_digests(spark, str(tmp_path), "ns/c", 3).collect()}
    assert stored == {i: (r.n, r.sha256) for i, r in counts.items()} and sum(n for n, _ in stored.values()) == 2000
    for i in range(3):
        at = lake.slice_id("ns/c", i, 3)
        assert len(list((tmp_path / at).glob("*.jsonl.gz"))) > 3
        read = lake.read_lines(spark, str(tmp_path), at).select("object_key", "line", "request.*").withColumn("shard", F.lit(i))
        planned = W.original_timing(read)
        span = read.agg((F.max("timestamp").cast("long") - F.min("timestamp").cast("long")).alias("s")).first().s
        assert planned.agg(F.max("send_offset_ns")).first()[0] == span * 10**9
        m = json.loads((tmp_path / at / "manifest.json").read_text())
        assert (m["shardIndex"], m["shardCount"], m["sourceCaptureID"], m["recordCount"], m["sha256"]) == (i, 3, "ns/c", *stored[i]) and m["createdAt"]
    empty = lake.write_shards(rows.limit(1), str(tmp_path), "ns/one", 4).collect()
    assert sorted(r.n for r in empty) == [0, 0, 0, 1] and sum(r.sha256 == hashlib.sha256().hexdigest() for r in empty) == 3


def test_a_slice_is_sorted_and_written_by_several_tasks(spark, requests, tmp_path):
    """One task a slice would sort all of it. Ranges of it are tasks, and its objects, in the order of their keys, are still the whole slice in order."""
    rows = requests.withColumn("object_key", F.lit("k")).withColumn("line", F.col("contentLength"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        said = {r.shard: (r.n, r.sha256) for r in lake.write_shards(rows, str(tmp_path), "ns/c", 2).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    store, one = objects.Store(str(tmp_path)), spark.createDataFrame([(r.id, r.line) for r in rows.collect()], "id string, line long")
    for i in range(2):
        keys = [k for k, _ in store.find(lake.slice_id("ns/c", i, 2))]
        assert len({re.search(r"-p(\d+)-", k).group(1) for k in keys}) > 1
        lines = [x for k in keys for x in store.lines(k)]
        assert said[i] == (len(lines), hashlib.sha256(b"".join(lines)).hexdigest())
        want = [r.id for r in S.with_shard(one, 2).where(f"shard = {i}").orderBy("line").collect()]
        assert [json.loads(x)["id"] for x in lines] == want


def test_tasks_of_a_read_follow_its_bytes(tmp_path, monkeypatch):
    """24 MB of objects, some 300 MB of lines, are several tasks for tables and streams; small objects count for their opening; a huge capture has larger parts."""
    (tmp_path / "ns/c").mkdir(parents=True)
    for i in range(24):
        (tmp_path / f"ns/c/a-{i + 1:06d}.jsonl.gz").write_bytes(bytes(1 << 20))
    options = {"path": str(tmp_path), "capture": "ns/c"}
    reader, stream = objects.CaptureReader(options), objects.CaptureStream(options)
    keys = [f"ns/c/a-{i + 1:06d}.jsonl.gz" for i in range(24)]
    for found in (reader.partitions(), stream.partitions({}, stream.latestOffset())):
        assert len(found) >= 8 and [k for p in found for k in p.keys] == keys
    assert len(objects.packed([(f"k{i}", 100) for i in range(10_000)], 2 << 20)) > 10
    monkeypatch.setattr(objects, "PARTITIONS", 4)
    assert 4 <= len(reader.partitions()) <= 5
    assert len(objects.CaptureReader(options | {"partitionBytes": "4000"}).partitions()) == 24


def test_a_schema_leaves_out_columns_but_no_check(spark, tmp_path):
    put(tmp_path / "ns/c/2026-01-15", "a-000001.jsonl.gz", [x for x, _ in LINES])
    objects.register(spark)
    whole = source(spark, tmp_path, "ns/c")
    of = lambda read, schema: read.format("capture").schema(schema).option("path", str(tmp_path)).option("capture", "ns/c").load()
    some = of(spark.read, "contentLength long, timestamp timestamp, line long, id string")
    assert some.columns == ["contentLength", "timestamp", "line", "id"]
    assert sorted(map(str, some.collect())) == sorted(map(str, whole.select(*some.columns).collect()))
    assert some.where(F.col("timestamp") >= F.lit(dt.datetime(2026, 1, 15, 12, 0, 1))).count() == 1
    query = of(spark.readStream, "headers map<string,array<string>>, id string").writeStream.format("memory").queryName("some_columns").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(str, spark.table("some_columns").collect())) == sorted(map(str, whole.select("headers", "id").collect()))
    for wrong in ("id long", "id string, nothing string"):
        with pytest.raises(Exception, match="there is no"):
            of(spark.read, wrong).collect()


def test_a_stream_reads_objects_as_they_come(spark, tmp_path):
    objects.register(spark)

    def run():
        df = spark.readStream.format("capture").option("path", str(tmp_path / "lake")).option("capture", "ns/c").load().select("id", "timestamp")
        df.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.id for r in spark.read.schema("id string").parquet(str(tmp_path / "out")).collect())

    put(tmp_path / "lake/ns/c/2026-01-15", "a-000001.jsonl.gz", ['{"id":"1"}'])
    put(tmp_path / "lake/ns/c/2026-01-15", "b-000001.jsonl.gz", ['{"id":"2"}', "bad"])
    assert run() == ["1", "2"]
    put(tmp_path / "lake/ns/c/2026-01-16", "a-000002.jsonl.gz", ['{"id":"3"}'])
    put(tmp_path / "lake/ns/c/2026-01-14", "c-000001.jsonl.gz", ['{"id":"4"}'])
    assert run() == ["1", "2", "3", "4"] == run()
