"""Queries over streams whose state, late rows and metrics are tables, and over versions of a catalog."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import fleet as L
from ..operators import select as S
from ..sources import lake, objects
from ..sources.adapters import CAPTURED, captured, table
from ..sources.shared import fresh_path
from ..streaming import jobs, live
from ..streaming.keyed import KeyedTable
from .fleet_queries import COUNTER
from .registry import query


def _samples(spark, sf_dir) -> DataFrame:
    """Counters that restart at 97, a series an event type."""
    w = Window.partitionBy("series").orderBy("t", "event_id")
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("series"), F.col("ts").cast("timestamp").alias("t"), "event_id")
    return rows.withColumn("v", (F.row_number().over(w) % 97).cast("double"))


#: Steps of the samples that the stream's watermark has passed in the end, in the stream's order of samples.
STEPS = """steps as (select series, us, v, case when v < before then v else coalesce(v - before, 0) end step from (
    select series, us, v, lag(v) over (partition by series order by us, v) before from (select series, epoch_us(ts) us, v from events e join samples s using (event_id))) where us <= (select (max(epoch_us(ts)) // 1000 - 600000) * 1000 from events))"""


@query(", " + STEPS + " select series, us t_us, v::double v, step::double step from steps", COUNTER)
def streamed_counter_steps(spark, sf_dir) -> DataFrame:
    """Growth of counters at each sample, kept by a stream that has each series' last value as state; restarts count from zero."""
    root = fresh_path(spark, "stream")
    samples = _samples(spark, sf_dir).drop("event_id")
    samples.write.parquet(f"{root}/landing")
    stream = spark.readStream.schema(samples.schema).parquet(f"{root}/landing")
    live.counter_steps(stream, ["series"]).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out").select("series", X.micros("t").alias("t_us"), "v", "step")


@query(", " + STEPS + """, w as (select series, step, unnest(range(0, 3)) k, us // 3600000000 * 3600000000 - k * 3600000000 start_us, us from steps)
    select series, start_us, sum(step)::double increase, count(*) samples, sum(step) / 10800.0 per_second from w where us < start_us + 10800000000 group by 1, 2""", COUNTER)
def streamed_counter_rates(spark, sf_dir) -> DataFrame:
    """Increase and rate of the streamed counters in sliding windows of three hours."""
    root = fresh_path(spark, "stream")
    samples = _samples(spark, sf_dir).drop("event_id")
    samples.write.parquet(f"{root}/landing")
    stream = spark.readStream.schema(samples.schema).parquet(f"{root}/landing")
    live.counter_steps(stream, ["series"]).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rates = live.sliding_rates(spark.read.parquet(f"{root}/out"), ["series"], "3 hours", "1 hour")
    return rates.select("series", X.micros("start").alias("start_us"), "increase", "samples", "per_second")


@query("""select kind, count(*) n, sum(event_id)::bigint ids from (select event_id, case when user_id % 2 = 1 and epoch_us(ts) < (select max(epoch_us(ts)) from events where user_id % 2 = 0) - 432000 * 1000000::bigint then 'late' else 'kept' end kind from events) group by 1""")
def streamed_late_rows(spark, sf_dir) -> DataFrame:
    """Events of even users, then, in a later run of the same stream, those of odd ones: rows five days behind the first ones are late."""
    root = fresh_path(spark, "stream")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    for part in (0, 1):
        rows.where(F.col("user_id") % 2 == part).coalesce(4).write.mode("append").parquet(f"{root}/landing")
        stream = spark.readStream.schema(rows.schema).parquet(f"{root}/landing")
        live.split_late(stream, "ts", f"{root}/kept", f"{root}/late", f"{root}/checkpoint", 432_000).awaitTermination()
    read = lambda kind: spark.read.schema(rows.schema).parquet(f"{root}/{kind}").withColumn("kind", F.lit(kind))
    return read("kept").union(read("late")).groupBy("kind").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("select 'capture' as source, unnest(['bytes', 'filtered', 'total']) metric, unnest([sum(content_length), count(*) filter (where not starts_with(path, '/api/v1')), count(*)])::double as value from captured union all select 'engine', unnest(['dropped', 'input']), unnest([0, count(*)])::double from captured", CAPTURED)
def streamed_metrics(spark, sf_dir) -> DataFrame:
    """What a running ingest observed, as rows by batch that a listener wrote, added up."""
    root = fresh_path(spark, "stream")
    captured(spark, sf_dir).drop("object_key", "line", "capture_date", "capture_id").write.json(f"{root}/landing")
    listener = live.MetricRows(f"{root}/metrics")
    spark.streams.addListener(listener)
    try:
        df = jobs.counted(jobs.requests(spark, f"{root}/landing", 4), S.path_prefix("/api/v1"))
        jobs.ingest(df, f"{root}/out", f"{root}/checkpoint", None).awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    return live.metric_rows(spark, f"{root}/metrics").groupBy("source", "metric").agg(F.sum("value").alias("value"))


@query("select capture_date::varchar as day, count(*) n, sum(content_length)::bigint bytes from captured where starts_with(path, '/api/v1') group by 1", CAPTURED)
def streamed_objects(spark, sf_dir) -> DataFrame:
    """A stream writes a capture's objects by bytes and age; another one reads them as they come, over its own offsets."""
    root, columns = fresh_path(spark, "stream"), "id string, timestamp timestamp, contentLength long"
    rows = captured(spark, sf_dir).drop("object_key", "line", "capture_date", "capture_id")
    for part in (0, 1):
        rows.where(F.pmod(F.xxhash64("id"), F.lit(2)) == part).write.mode("append").json(f"{root}/landing")
        df = jobs.prepared(jobs.requests(spark, f"{root}/landing"), S.path_prefix("/api/v1"))
        jobs.ingest_objects(df, f"{root}/lake", "ns/live", f"{root}/ingest", None, max_bytes=1 << 20).awaitTermination()
        read = spark.readStream.format("capture").schema(columns).option("path", f"{root}/lake").option("capture", "ns/live").load()
        read.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/read").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(columns).parquet(f"{root}/out")
    return out.groupBy(F.date_format("timestamp", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.sum("contentLength").alias("bytes"))


CATALOG = "id string, status string, started_at timestamp, completed_at timestamp, error string, updated_at timestamp"


@query("""select version, count(*) captures, count(*) filter (where status = 'active') active, count(*) filter (where completed) completed, sum(epoch_us(started))::hugeint::varchar started_us from (
    select 1 as version, o_custkey id, 'active' status, false completed, min(o_orderdate) started from orders group by 2
    union all select 2, o_custkey, case when bool_or(o_orderstatus = 'F') then 'completed' else 'active' end, bool_or(o_orderstatus = 'F'), min(o_orderdate) from orders group by 2) group by 1""")
def catalog_versions(spark, sf_dir) -> DataFrame:
    """A catalog of captures, one a customer: started by a first batch of upserts, completed by a second one; both versions are read."""
    root = fresh_path(spark, "catalog")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("id"), "o_orderstatus", F.col("o_orderdate").cast("timestamp").alias("at"))
    none = F.lit(None).cast("timestamp")
    start = o.groupBy("id").agg(F.min("at").alias("started_at")).select("id", F.lit("active").alias("status"), "started_at", none.alias("completed_at"), F.lit("").alias("error"), F.col("started_at").alias("updated_at"))
    over = o.where("o_orderstatus = 'F'").groupBy("id").agg(F.max("at").alias("completed_at")).select("id", F.lit("completed").alias("status"), F.lit(dt.datetime(2030, 1, 1)).alias("started_at"), "completed_at", F.lit("").alias("error"), F.lit(dt.datetime(2030, 1, 1)).alias("updated_at"))
    catalog = KeyedTable(spark, root, CATALOG, ["id"], buckets=16, merged=L.upsert_captures)
    catalog.merge(start, 0)
    catalog.merge(over, 1)
    catalog.merge(over.withColumn("status", F.lit("again")), 1)  # a batch that comes again changes nothing
    both = catalog.read(1).withColumn("version", F.lit(1)).union(catalog.read(2).withColumn("version", F.lit(2)))
    return both.groupBy("version").agg(F.count("*").alias("captures"), F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.col("completed_at").isNotNull()).alias("completed"), F.sum(X.micros("started_at").cast("decimal(38,0)")).cast("string").alias("started_us"))


@query("select shard, n, empty from (select 0 as shard, count(*) n, false as empty from captured union all select 1, 0, true)", CAPTURED)
def empty_captures(spark, sf_dir) -> DataFrame:
    """What a capture's manifest says of its rows, and if there is nothing to replay: all requests in one, none in the other."""
    root = fresh_path(spark, "lake")
    rows = captured(spark, sf_dir)
    lake.write_capture(rows, root, "ns/full", manifest=True)
    lake.write_capture(rows.where("id is null"), root, "ns/none", manifest=True)
    said = [lake.read_manifests(spark, f"{root}/ns/{x}/manifest.json") for x in ("full", "none")]
    objects.register(spark)
    parts = [m.select(F.lit(i).alias("shard"), F.col("recordCount").alias("n"), F.lit(lake.is_empty(lake.read_capture(spark, root, "ns/full") if i == 0 else rows.limit(0), m)).alias("empty")) for i, m in enumerate(said)]
    return parts[0].union(parts[1])
