"""Queries that write captures and read them again, and streams over what was written."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import blocked as B
from ..operators import policy as D
from ..operators import select as S
from ..sources import lake, objects
from ..sources.adapters import CAPTURED, HEARTBEATS, SHARDS, captured, heartbeats, shard_status, table
from ..sources.shared import checkpoint, fresh_path
from ..streaming import jobs
from ..streaming.keyed import KeyedTable, kept_up
from .fleet_queries import ABORTS, NEWEST, POLICIES, ROLLUP, policies
from .registry import query
from .request_queries import FNV


@query("select id, ts_us, method, path, body, content_length, protocol, host, query, capture_date::varchar as day from captured where ts between timestamp '2024-01-03 06:00:00' and timestamp '2024-01-09 00:00:00'", CAPTURED)
def lake_round_trip(spark, sf_dir) -> DataFrame:
    """All requests as gzip JSON lines by day, read again for a range of time."""
    root = fresh_path(spark, "lake")
    lake.write_capture(captured(spark, sf_dir), root, "ns/all")
    df = lake.read_capture(spark, f"{root}", "ns/all", dt.datetime(2024, 1, 3, 6), dt.datetime(2024, 1, 9))
    return df.select("id", X.micros("timestamp").alias("ts_us"), "method", "path", F.decode("body", "utf-8").alias("body"), F.col("contentLength").alias("content_length"), "protocol", F.col("metadata")["host"].alias("host"), F.col("metadata")["query"].alias("query"), F.date_format("timestamp", "yyyy-MM-dd").alias("day"))


#: Lines of JSON as captures store them.
STORED = """stored as (select *, '{"id":"' || id || '","timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z","method":"' || method || '","path":"' || path || '","headers":{"Content-Type":["application/json"],"Authorization":["Bearer ' || user_id || '"],"'
    || case when event_id % 2 = 0 then 'X-Debug' else 'x-debug' end || '":["' || debug || '"],"Connection":["keep-alive"]},"body":"' || to_base64(encode(body)) || '","contentLength":' || content_length || ',"protocol":"' || protocol
    || '","metadata":{"host":"' || host || '","query":"' || query || '"}}' || chr(10) as stored_line from captured)"""


@query("select 'ns/all' as capture_id, capture_date::varchar as day, count(*) n, sum(strlen(stored_line))::bigint bytes, true as compressed from stored group by 2", CAPTURED, STORED)
def capture_byte_report(spark, sf_dir) -> DataFrame:
    """Lines and bytes of each day as stored, and if the objects are smaller than their lines."""
    root = fresh_path(spark, "lake")
    lake.write_capture(captured(spark, sf_dir), root, "ns/all")
    return lake.capture_bytes(spark, root).select("capture_id", F.col("day").cast("string").alias("day"), "n", "bytes", (F.col("compressed_bytes") < F.col("bytes")).alias("compressed"))


@query("select 'ns/all' as capture_id, capture_date::varchar as day, true as named, 0::bigint as holes from captured group by 2", CAPTURED)
def inventory(spark, sf_dir) -> DataFrame:
    """Days that a written capture has objects of, if all are named by pod and number, and how many numbers are missing below each pod's highest."""
    root = fresh_path(spark, "lake")
    lake.write_capture(captured(spark, sf_dir), root, "ns/all", max_bytes=200_000, pod="agent")
    found = lake.inventory(spark, root).select("length", "of.*")
    holes = found.groupBy("pod").agg((F.max("seq") - F.count("*")).alias("holes"))
    return found.join(holes, "pod", "left").groupBy("capture_id", F.col("day").cast("string").alias("day")).agg(F.bool_and(F.col("pod").startswith("agent-") & (F.col("length") > 0)).alias("named"), F.sum("holes").alias("holes"))


ROUND_TRIP = "select id, ts_us, method, path, body, content_length, protocol, host, query, debug from captured where ts >= timestamp '2024-01-03 06:00:00' and ts < timestamp '2024-01-09 00:00:00'"


@query(ROUND_TRIP, CAPTURED)
def capture_source(spark, sf_dir) -> DataFrame:
    """A written capture through the data source: bounds of the time leave out days, Spark applies them to rows."""
    root = fresh_path(spark, "lake")
    lake.write_capture(captured(spark, sf_dir), root, "ns/all", max_bytes=1 << 20)
    objects.register(spark)
    df = spark.read.format("capture").option("path", root).option("capture", "ns/all").load()
    df = df.where((F.col("timestamp") >= F.lit(dt.datetime(2024, 1, 3, 6))) & (F.col("timestamp") < F.lit(dt.datetime(2024, 1, 9))))
    debug = F.coalesce(F.col("headers")["X-Debug"][0], F.col("headers")["x-debug"][0])
    return df.select("id", X.micros("timestamp").alias("ts_us"), "method", "path", F.decode("body", "utf-8").alias("body"), F.col("contentLength").alias("content_length"), "protocol", F.col("metadata")["host"].alias("host"), F.col("metadata")["query"].alias("query"), debug.alias("debug"))


@query(f"select s shard, count(*) n, sha256(string_agg(stored_line, '' order by object_key, line)) as sha256 from (select *, {FNV.format('id', 5)} s from stored) group by s", CAPTURED, STORED)
def slice_sha256(spark, sf_dir) -> DataFrame:
    """Rows and digest of each slice's lines in the order of their source, from the manifests that the writer's commit published."""
    root = fresh_path(spark, "lake")
    return lake.write_shards(captured(spark, sf_dir), root, "ns/orders", 5, max_bytes=1 << 20)


@query(f"select s shard, min(ts_us) first_us, max(ts_us) last_us, sum((ts_us < before)::int)::bigint backwards from (select *, lag(ts_us) over (partition by s order by object_key, line) before from (select *, {FNV.format('id', 3)} s from captured)) group by s", CAPTURED)
def slice_read_order(spark, sf_dir) -> DataFrame:
    """Slices as they are read again, object after object: first and last time, and how often the time goes back, as in the source's order."""
    root = fresh_path(spark, "lake")
    lake.write_shards(captured(spark, sf_dir), root, "ns/orders", 3, max_bytes=200_000)
    read = [lake.read_lines(spark, root, lake.slice_id("ns/orders", i, 3)).select(F.lit(i).alias("shard"), "object_key", "line", X.micros("request.timestamp").alias("t")) for i in range(3)]
    rows = checkpoint(reduce(DataFrame.union, read))
    rows = B.previous(rows, ["shard"], "line", "t", block=F.col("object_key"))
    return rows.groupBy("shard").agg(F.min("t").alias("first_us"), F.max("t").alias("last_us"), F.count_if(F.col("t") < F.col("before")).alias("backwards"))


@query(f"select s shard, 'sha256 differs' as fault from (select distinct {FNV.format('id', 4)} s from captured)", CAPTURED)
def manifest_sha256(spark, sf_dir) -> DataFrame:
    """Slices whose stored lines aren't those of their manifests: here a body of each slice's first id is changed after the first write."""
    root = fresh_path(spark, "lake")
    df = captured(spark, sf_dir).drop("object_key", "line", "capture_date")
    said = lake.manifests_of(lake.write_shards(df, root, "ns/orders", 4), "ns/orders", 4)
    said.write.json(f"{root}/manifests")
    first = S.with_shard(df.select("id"), 4).groupBy("shard").agg(F.min("id").alias("first"))
    changed = df.join(first, df.id == first["first"], "left").withColumn("body", F.when(F.col("first").isNotNull(), F.encode(F.lit("changed"), "utf-8")).otherwise(F.col("body"))).drop("shard", "first")
    lake.write_shards(changed, root, "ns/orders", 4)
    now = lake.slice_digests(spark, root, "ns/orders", 4).withColumnRenamed("shard", "shard_index")
    manifests = lake.spark_manifests(spark, f"{root}/manifests").select(F.col("shardIndex").alias("shard_index"), F.col("formatVersion").alias("format_version"), F.col("recordCount").alias("record_count"), "sha256")
    return D.manifest_faults(manifests, now, ("shard_index",)).select(F.col("shard_index").alias("shard"), "fault")


@query("select 'good' as kind, count(*) n from captured where event_id % 37 <> 0 union all select 'rejected', count(*) from captured where event_id % 37 = 0", CAPTURED)
def rejected_lines(spark, sf_dir) -> DataFrame:
    """Malformed lines among good ones: the good ones are read, the others reported with their objects."""
    root = fresh_path(spark, "lake")
    df = captured(spark, sf_dir)
    odd = F.element_at(F.array(F.concat(F.lit("not json "), "id"), F.to_json(F.struct("id", F.lit("no time").alias("timestamp"))), F.lit(""), F.lit("[]")), (F.col("line") / 37 % 4 + 1).cast("int"))
    line = F.when(F.col("line") % 37 == 0, odd).otherwise(F.to_json(F.struct("id", "timestamp", "method", "path")))
    df.select(line.alias("value"), F.date_format("timestamp", "yyyy-MM-dd").alias("day")).write.partitionBy("day").option("compression", "gzip").text(f"{root}/ns/bad")
    good, bad = lake.read_capture(spark, root, "ns/bad"), lake.rejects(spark, root, "ns/bad")
    return good.agg(F.lit("good").alias("kind"), F.count("id").alias("n")).unionByName(bad.agg(F.lit("rejected").alias("kind"), F.count("*").alias("n")))


@query(f"select shard, count(*) n from (select {FNV.format('id', 4)} shard from captured) group by shard", CAPTURED)
def written_shards(spark, sf_dir) -> DataFrame:
    """A capture dealt into four slices by one shuffle; counts from the slices as they are read again."""
    root = fresh_path(spark, "lake")
    lake.write_shards(captured(spark, sf_dir).drop("object_key", "line", "capture_date"), root, "ns/orders", 4)
    parts = [lake.read_slice(spark, root, "ns/orders", i, 4).agg(F.lit(i).alias("shard"), F.count("*").alias("n")) for i in range(4)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"select id from captured where {FNV.format('id', 4)} = 2", CAPTURED)
def read_one_shard(spark, sf_dir) -> DataFrame:
    root = fresh_path(spark, "lake")
    lake.write_shards(captured(spark, sf_dir).drop("object_key", "line", "capture_date"), root, "ns/orders", 4)
    return lake.read_slice(spark, root, "ns/orders", 2, 4).select("id")


@query("select 'ns/orders/shards/' || s || '-of-4' \"captureID\", n \"recordCount\", s \"shardIndex\", 4 \"shardCount\" from (select " + FNV.format("id", 4) + " s, count(*) n from captured group by 1)", CAPTURED)
def shard_manifests(spark, sf_dir) -> DataFrame:
    """Manifests of slices, published by the commit after the data, and read again."""
    root = fresh_path(spark, "lake")
    lake.write_shards(captured(spark, sf_dir).drop("object_key", "line", "capture_date"), root, "ns/orders", 4)
    return lake.slice_manifests(spark, root, "ns/orders", 4).select("captureID", "recordCount", "shardIndex", "shardCount")


@query("select capture_date::varchar as day, count(*) n, sum(content_length)::bigint bytes from captured where starts_with(path, '/api/v1') group by 1", CAPTURED)
def streamed_ingest(spark, sf_dir) -> DataFrame:
    """A stream over landed files: filter, truncation, redaction, days of gzip JSON lines; read as a table."""
    root = fresh_path(spark, "stream")
    captured(spark, sf_dir).drop("object_key", "line", "capture_date", "capture_id").write.json(f"{root}/landing")
    df = jobs.prepared(jobs.requests(spark, f"{root}/landing"), S.path_prefix("/api/v1"))
    jobs.ingest(df, f"{root}/out", f"{root}/checkpoint", None).awaitTermination()
    out = spark.read.schema(lake.schemas.REQUEST + ", day string").json(f"{root}/out")
    return out.groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"), F.sum("contentLength").alias("bytes"))


@query("select 'spoke-' || (user_id % 100 + 1) spoke_id, max(epoch_us(ts)) ts_us, arg_max(floor(value)::bigint, (ts, event_id)) active_captures from events group by 1")
def streamed_latest(spark, sf_dir) -> DataFrame:
    """The newest heartbeat of each spoke, kept by a stream."""
    root = fresh_path(spark, "stream")
    stream = spark.readStream.schema(heartbeats(spark, sf_dir).schema).parquet(_landed(spark, heartbeats(spark, sf_dir), root))
    state = KeyedTable(spark, f"{root}/out", stream.schema, ["spoke_id"], ["ts", "seq"], buckets=8)
    kept_up(jobs.newest(stream, ["spoke_id"], "ts", "seq"), state, f"{root}/checkpoint").awaitTermination()
    return state.read().select("spoke_id", X.micros("ts").alias("ts_us"), "active_captures")


def _landed(spark, df: DataFrame, root: str) -> str:
    df.write.parquet(f"{root}/landing")
    return f"{root}/landing"


@query("select event_type, epoch_us(w) start_us, count(*) n from (select event_type, ts, unnest(range(0, 3)) k, time_bucket(interval '1 hour', ts) - k * interval '1 hour' w from events) where ts < w + interval '3 hours' group by all")
def streamed_rates(spark, sf_dir) -> DataFrame:
    """Events in sliding windows of three hours, every hour."""
    root = fresh_path(spark, "stream")
    e = table(spark, sf_dir, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    stream = spark.readStream.schema(e.schema).parquet(_landed(spark, e, root))
    out = jobs.rates(stream, ["event_type"], width="3 hours", slide="1 hour")
    out.writeStream.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{root}/out")).option("checkpointLocation", f"{root}/checkpoint").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out").select("event_type", X.micros("start").alias("start_us"), "n")


@query("select id, ts_us from captured", CAPTURED)
def streamed_dedup(spark, sf_dir) -> DataFrame:
    """Requests that were sent twice come once."""
    root = fresh_path(spark, "stream")
    df = captured(spark, sf_dir).select("id", "timestamp")
    stream = spark.readStream.schema(df.schema).parquet(_landed(spark, df.unionByName(df), root))
    jobs.deduplicated(stream).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{root}/out").select("id", X.micros("timestamp").alias("ts_us"))


@query(
    """, b as (select spoke_id, ts_us // 1000 t, lag(ts_us // 1000) over (partition by spoke_id order by ts_us) p from heartbeats)
    select spoke_id, p + 21600000 at_ms, 'DISCONNECTED' state from b where t - p > 21600000 union all select spoke_id, t, 'CONNECTED' from b where p is null or t - p > 21600000
    union all select spoke_id, max(t) + 21600000, 'DISCONNECTED' from b group by 1 having max(t) + 21600000 < (select max(t) - 600000 from b)""",
    HEARTBEATS,
)
def streamed_liveness(spark, sf_dir) -> DataFrame:
    """When spokes came and went: silent for six hours is gone. State and timers are kept by the stream."""
    root = fresh_path(spark, "stream")
    h = heartbeats(spark, sf_dir).select("spoke_id", "ts")
    stream = spark.readStream.schema(h.schema).parquet(_landed(spark, h, root))
    jobs.liveness(stream, 21600).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("spoke_id string, at_ms long, state string").parquet(f"{root}/out")


@query(f"select load_test_name, sent, failed, reason abort_reason from rollup_ join ({ABORTS}) using (load_test_name)", SHARDS, ROLLUP, POLICIES)
def streamed_run_monitor(spark, sf_dir) -> DataFrame:
    """Totals of load tests and reasons to stop them, kept up by a stream of cumulative reports."""
    root = fresh_path(spark, "stream")
    s = shard_status(spark, sf_dir)
    stream = spark.readStream.schema(s.schema).parquet(_landed(spark, s, root))
    tests = spark.range(50).select(F.concat(F.lit("lt-"), F.col("id").cast("string")).alias("load_test_name"))
    jobs.run_monitor(stream, policies(tests), NEWEST, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return jobs.monitored(spark, f"{root}/out").read().select("load_test_name", "sent", "failed", "abort_reason")


@query("select id from captured join (select capture_id, min(ts_us) s from captured group by 1) using (capture_id) where ts_us < s + 36 * 3600000000", CAPTURED)
def streamed_auto_stop(spark, sf_dir) -> DataFrame:
    """Captures of a day and a half each: what comes later is not taken."""
    root = fresh_path(spark, "stream")
    df = captured(spark, sf_dir).select("id", "timestamp", "capture_id")
    captures = df.groupBy("capture_id").agg(F.min("timestamp").alias("started_at")).withColumn("duration", F.lit("36h"))
    stream = spark.readStream.schema(df.schema).parquet(_landed(spark, df, root))
    jobs.auto_stopped(stream, captures).select("id").writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("id string").parquet(f"{root}/out")


@query("select 'spoke-' || (user_id % 100 + 1) spoke_id, 'c' || user_id % 7 as name, event_type phase, floor(value)::bigint requests from events where user_id % 4 <> 0")
def heartbeat_captures(spark, sf_dir) -> DataFrame:
    """Heartbeats with nested captures, written as JSON and read into a flat table."""
    root = fresh_path(spark, "heartbeats")
    one = F.struct(F.lit("ns").alias("namespace"), F.concat(F.lit("c"), (F.col("user_id") % 7).cast("string")).alias("name"), F.col("event_type").alias("phase"), F.floor("value").cast("long").alias("requests"))
    none = F.array().cast("array<struct<namespace:string,name:string,phase:string,requests:bigint>>")
    table(spark, sf_dir, "events").select(F.concat(F.lit("spoke-"), (F.col("user_id") % 100 + 1).cast("string")).alias("spoke_id"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("user_id") % 4 != 0, F.array(one)).otherwise(none).alias("captures")).write.json(root)
    captures, _ = lake.heartbeat_tables(spark.read.schema(lake.schemas.HEARTBEAT).json(root))
    return captures.select("spoke_id", "name", "phase", "requests")
