"""Queries of projections, settings, reports and reports' checks that no other module has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import fleet as L
from ..operators import policy as D
from ..operators import summary as A
from ..operators import transform as T
from ..sources import bundles as files
from ..sources import lake
from ..sources.adapters import CAPTURED, CAPTURES, HEARTBEATS, RESULTS, SHARDS, SPOKES, captured, captures_state, heartbeats, results, spokes, table
from ..sources.shared import fresh_path
from . import prepare as N
from .fleet_queries import latest_status
from .prepare_queries import HOUR, NORMAL, buckets, normal
from .registry import query


@query("select id, 'POST' as method, '/svc.' || event_type || '/Do' as path, 'gRPC' as protocol, '/svc.' || event_type || '/Do' as grpc_method from captured where protocol = 'gRPC'", CAPTURED)
def grpc_as_requests(spark, sf_dir) -> DataFrame:
    """Calls of gRPC methods as captured requests."""
    raw = captured(spark, sf_dir).where("protocol = 'gRPC'").select("id", F.concat(F.lit("/svc."), F.split_part("path", F.lit("/"), F.lit(4)), F.lit("/Do")).alias("full_method"))
    return T.from_grpc(raw).select("id", "method", "path", "protocol", F.col("metadata")["grpcMethod"].alias("grpc_method"))


@query("""select sha256('{"url":"' || url || '","html_bytes":' || strlen(html) || '}') as id, 0::bigint as at_us, url, count(*) n from pages group by all""")
def stamped_pages(spark, sf_dir) -> DataFrame:
    """Rows without an id or a time get them, here the same ones in each run."""
    rows = table(spark, sf_dir, "pages").select("url", F.octet_length("html").alias("html_bytes"))
    return T.stamped(rows, deterministic=True).select("id", X.micros("timestamp").alias("at_us"), "url").groupBy("id", "at_us", "url").agg(F.count("*").alias("n"))


@query("select host, tls, port, url, count(*) n from (select host, user_id % 2 = 0 tls, case when user_id % 3 = 0 then 8080 end port, case when user_id % 2 = 0 then 'https://' else 'http://' end || host || ':' || coalesce(case when user_id % 3 = 0 then 8080 end, case when user_id % 2 = 0 then 443 else 80 end) url from captured) group by all", CAPTURED)
def target_urls(spark, sf_dir) -> DataFrame:
    """Where a host's requests go, by port and TLS."""
    u = F.regexp_extract("path", r"(\d+)$", 1).cast("int")
    rows = captured(spark, sf_dir).select(F.col("metadata")["host"].alias("host"), (u % 2 == 0).alias("tls"), F.when(u % 3 == 0, 8080).alias("port"))
    return rows.groupBy("host", "tls", "port", X.target_url("host", "port", "tls").alias("url")).agg(F.count("*").alias("n"))


@query("""select id, upper(method) as method, 'http://t' || path as url, 'application/json' content_type, 'Bearer ' || user_id as auth, 'true' as mark, id as request_id from captured""", CAPTURED)
def joined_outbound(spark, sf_dir) -> DataFrame:
    """Requests as the script adapter sends them, values of a header in one."""
    h = F.col("headers")
    return T.joined_outbound(captured(spark, sf_dir), "http://t").select("id", "method", "url", h["Content-Type"].alias("content_type"), h["Authorization"].alias("auth"), h["X-Replay"].alias("mark"), h["X-Request-Id"].alias("request_id"))


@query("select event_type, settings, case settings when 'json' then 'not JSON' when 'noname' then 'name is required' end fault, case settings when 'two' then 2 when 'blank' then 0 when 'noname' then 1 end n_filters, count(*) n from (select event_type, ['two', 'blank', 'json', 'noname'][event_id % 4 + 1] settings from events) group by all")
def header_filter_settings(spark, sf_dir) -> DataFrame:
    """Filters of headers as text of JSON, with their faults."""
    texts = F.create_map(*[F.lit(x) for kv in {"two": '[{"name":"a","value":"b"},{"name":"c"}]', "blank": " ", "json": "{nope", "noname": '[{"name":" ","value":"x"}]'}.items() for x in kv])
    kind = F.element_at(F.array(*map(F.lit, ("two", "blank", "json", "noname"))), (F.col("event_id") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_type", kind.alias("settings")).withColumn("f", X.header_filters(texts[F.col("settings")]))
    return rows.groupBy("event_type", "settings", F.col("f.fault").alias("fault"), F.when(F.col("f.filters").isNotNull(), F.size("f.filters")).alias("n_filters")).agg(F.count("*").alias("n"))


@query("select user_id, 'u' || user_id as user_, 'a=b' as token, 2::bigint n_pairs, count(*) n from events group by user_id")
def override_settings(spark, sf_dir) -> DataFrame:
    """Headers that are set by text: items without a sign are left out, only the first sign cuts, the last of equals counts."""
    u = F.col("user_id").cast("string")
    rows = table(spark, sf_dir, "events").select("user_id", X.parse_pairs(F.concat(F.lit("user=x, token=a=b,odd, user = u"), u)).alias("p"))
    return rows.groupBy("user_id", F.col("p")["user"].alias("user_"), F.col("p")["token"].alias("token"), F.size("p").cast("long").alias("n_pairs")).agg(F.count("*").alias("n"))


@query("select event_type, ['original', 'original', 'constant', 'unlimited', 'unlimited', null][event_id % 6 + 1] as mode, count(*) n from events group by all")
def rate_modes(spark, sf_dir) -> DataFrame:
    """Modes of pacing by their names."""
    name = F.element_at(F.array(*map(F.lit, ("original", "Recorded", "CONSTANT", "unlimited", "max", "other"))), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "events").groupBy("event_type", X.rate_mode(name).alias("mode")).agg(F.count("*").alias("n"))


@query("select spoke_id, case when s < 60 then s || 's ago' when s < 3600 then s // 60 || 'm ago' else s // 3600 || 'h ago' end as age from (select spoke_id, (epoch_us(timestamp '2024-02-01') - max(ts_us)) // 1000000 s from heartbeats group by 1)", HEARTBEATS)
def heartbeat_ages(spark, sf_dir) -> DataFrame:
    """How long ago each spoke was heard of, as text."""
    last = heartbeats(spark, sf_dir).groupBy("spoke_id").agg(F.max("ts").alias("last"))
    seconds = F.floor((F.unix_micros(F.lit("2024-02-01").cast("timestamp")) - F.unix_micros("last")) / 1_000_000)
    return last.select("spoke_id", X.relative_age(seconds).alias("age"))


@query("select run_id, count(*) total, count(*) filter (where error is null) sent, count(error) failed, mean(duration_ns)::bigint > 0 timed from results group by 1", RESULTS)
def stored_reports(spark, sf_dir) -> DataFrame:
    """Reports of runs, written a line each and read again."""
    root = fresh_path(spark, "reports")
    s = A.run_report(A.summarize(results(spark, sf_dir), ["run_id"]))
    rows = s.select("run_id", F.col("total").alias("totalRequests"), F.col("success").alias("sentRequests"), F.col("errors").alias("failedRequests"), F.lit(0).cast("long").alias("filteredRequests"), "durationMs", "achievedRPS", "meanLatencyMs", *(f"{p}LatencyMs" for p in ("p50", "p95", "p99")))
    lake.write_reports(rows, root)
    read = lake.read_reports(spark, root)
    return rows.select("run_id", "totalRequests", "durationMs").join(read, ["totalRequests", "durationMs"]).select("run_id", F.col("totalRequests").alias("total"), F.col("sentRequests").alias("sent"), F.col("failedRequests").alias("failed"), (F.col("meanLatencyMs") >= 0).alias("timed"))


@query("select 'spoke-' || (user_id % 100 + 1) spoke_id, 'lt-' || user_id % 9 load_test, user_id % 4 as shard, event_type phase, floor(value)::bigint sent from events where user_id % 3 = 0")
def heartbeat_replays(spark, sf_dir) -> DataFrame:
    """Heartbeats with nested replays, written as JSON and read into a flat table."""
    root = fresh_path(spark, "heartbeats")
    u = F.col("user_id")
    one = F.struct(F.concat(F.lit("lt-"), (u % 9).cast("string")).alias("load_test"), (u % 4).cast("int").alias("shard"), F.col("event_type").alias("phase"), F.floor("value").cast("long").alias("sent"))
    none = F.array().cast("array<struct<load_test:string,shard:int,phase:string,sent:bigint>>")
    table(spark, sf_dir, "events").select(F.concat(F.lit("spoke-"), (u % 100 + 1).cast("string")).alias("spoke_id"), F.col("ts").cast("timestamp").alias("ts"), F.when(u % 3 == 0, F.array(one)).otherwise(none).alias("replays")).write.json(root)
    _, replays = lake.heartbeat_tables(spark.read.schema(lake.schemas.HEARTBEAT).json(root))
    return replays.select("spoke_id", "load_test", F.col("shard").cast("long").alias("shard"), "phase", "sent")


@query("""select kind, phase, sum(n)::bigint n from (
    select 'capture' kind, phase, count(*) n from captures group by 2 union all select 'replay', phase, count(*) from latest group by 2
    union all select 'storage', case when storage = 'MACHINERY' then 'ERROR' else 'READY' end, count(distinct storage) from captures group by 2
    union all select 'spoke', case when last is null or epoch_us(timestamp '2024-01-31') - last > 21600 * 1000000::bigint then 'DISCONNECTED' when active > 90 then 'DEGRADED' else 'HEALTHY' end, count(*) from spokes left join (select spoke_id, max(ts_us) as last, arg_max(active_captures, (ts_us, seq)) active from heartbeats group by 1) using (spoke_id) group by 2
    union all select unnest(['capture', 'replay', 'storage', 'spoke']), unnest(['FAILED', 'FAILED', 'ERROR', 'DEGRADED']), 0) group by 1, 2""", CAPTURES, SHARDS, SPOKES, HEARTBEATS)
def phases_of_all(spark, sf_dir) -> DataFrame:
    """Captures, replays, storages and spokes by phase, zero where a phase has none."""
    storages = captures_state(spark, sf_dir).select("storage").distinct().select(F.when(F.col("storage") == "MACHINERY", "ERROR").otherwise("READY").alias("phase"))
    health = L.spoke_health(spokes(spark, sf_dir), heartbeats(spark, sf_dir), F.lit("2024-01-31").cast("timestamp"), 21_600, F.col("active_captures") > 90)
    return L.entity_phases({"capture": captures_state(spark, sf_dir), "replay": latest_status(spark, sf_dir), "storage": storages, "spoke": health})


@query("select run_id, count(*) filter (where duration_ns % 10 <> 0 and error is null) sent, count(*) filter (where duration_ns % 10 <> 0 and error is not null) errored, count(*) filter (where duration_ns % 10 = 0) filtered, sum(response_bytes)::bigint bytes from results group by 1", RESULTS)
def filtered_progress(spark, sf_dir) -> DataFrame:
    """Counters of runs of which some rows were filtered before they were sent."""
    rows = results(spark, sf_dir).withColumn("filtered", F.col("duration_ns") % 10 == 0)
    return L.progress(rows, ["run_id"]).select("run_id", "sent", "errored", "filtered", "bytes")


@query("select 's' || user_id pipeline, 'config' kind, 'limit rate is missing' detail from events where user_id % 5 = 0 group by 1 union all select 's' || user_id, 'config', 'limit rate is out of bounds' from events where user_id % 5 = 1 group by 1 union all select 's' || user_id, 'config', 'limit wait is no duration' from events where user_id % 5 = 2 group by 1 union all select 's' || user_id, 'config', 'limit speed is not known' from events where user_id % 5 = 3 group by 1 union all select 's' || user_id, 'unknown', 'nope' from events where user_id % 7 = 0 group by 1")
def pipeline_settings(spark, sf_dir) -> DataFrame:
    """Settings of pipelines' plugins against what these know."""
    u = F.col("user_id")
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    pair = lambda k, v: F.create_map(F.lit(k), F.lit(v))
    good = F.map_concat(pair("rate", "10"), pair("wait", "1m30s"))
    config = F.when(u % 5 == 0, pair("wait", "5s")).when(u % 5 == 1, pair("rate", "0.5")).when(u % 5 == 2, F.map_concat(pair("rate", "7"), pair("wait", "soon"))).when(u % 5 == 3, F.map_concat(good, pair("speed", "x"))).otherwise(good)
    one = users.select(F.concat(F.lit("s"), u.cast("string")).alias("pipeline"), F.lit(0).alias("position"), F.lit("limit").alias("plugin"), config.alias("config"))
    two = users.where(u % 7 == 0).select(F.concat(F.lit("s"), u.cast("string")).alias("pipeline"), F.lit(1).alias("position"), F.lit("nope").alias("plugin"), F.lit(None).cast("map<string,string>").alias("config"))
    rules = spark.createDataFrame(
        [("limit", [], [], [], [], [("rate", "number", True, None, 1.0, 100.0), ("wait", "duration", False, None, 0.0, 600.0)])],
        "plugin string, conflicts array<string>, before array<string>, after array<string>, resources array<struct<name:string,access:string>>, settings array<struct<name:string,kind:string,required:boolean,allowed:array<string>,least:double,most:double>>",
    )
    return D.pipeline_faults(one.unionByName(two), rules)


@query("select s shard_index, case when s = 1 then 'source capture differs' else 'record count differs' end fault from (select distinct user_id % 4 s from captured) where s in (1, 2)", CAPTURED)
def slice_sources(spark, sf_dir) -> DataFrame:
    """Manifests that name another source, or another count, than the data has."""
    data = captured(spark, sf_dir).groupBy((F.regexp_extract("path", r"(\d+)$", 1).cast("long") % 4).alias("shard_index")).agg(F.count("*").alias("n")).withColumn("source_capture_id", F.lit("ns/orders"))
    s = F.col("shard_index")
    said = data.select("shard_index", F.lit(1).alias("format_version"), (F.col("n") + (s == 2).cast("int")).alias("record_count"), F.when(s == 1, "ns/other").otherwise("ns/orders").alias("source_capture_id"))
    return D.manifest_faults(said, data, ("shard_index",))


@query("select capture_id, count(*)::bigint records, true as packed, true as bounded from normal group by 1", CAPTURED, NORMAL)
def size_reports(spark, sf_dir) -> DataFrame:
    """Sizes of written bundles by capture: records, if they are smaller than their lines, and if the memory to read ahead follows from rate and record."""
    root = fresh_path(spark, "bundles")
    files.write_bundles(normal(spark, sf_dir).select("id", "capture_id", "offset_ns", "route_key", "path"), root, 20_000, 30_000, 240 * HOUR, HOUR)
    profile = N.profile(buckets(spark, sf_dir), HOUR)
    report = N.size_report(files.read_index(spark, root), profile, 30.0, 2, 0)
    ahead = F.col("prefetch_bytes") * F.col("records") / F.col("bytes")
    return report.join(profile.select("capture_id", "peak"), "capture_id").select("capture_id", "records", (F.col("ratio") > 1).alias("packed"), F.abs(ahead - 15 * F.col("peak")).between(0, 1).alias("bounded"))


@query(f"select capture_id, unnest(['too many requests', 'too long', 'too many bytes']) fault from (select capture_id from normal group by 1 having count(*) > 450 and max(offset_ns) > 600 * {HOUR}::bigint and sum(content_length) > 5000) union all select capture_id, unnest(case when n > 450 and d > 600 * {HOUR}::bigint and b > 5000 then [] else list_filter([case when n > 450 then 'too many requests' end, case when d > 600 * {HOUR}::bigint then 'too long' end, case when b > 5000 then 'too many bytes' end], lambda x: x is not null) end) from (select capture_id, count(*) n, max(offset_ns) d, sum(content_length) b from normal group by 1)", CAPTURED, NORMAL)
def run_bounds(spark, sf_dir) -> DataFrame:
    """Captures that are over the bounds of a run."""
    totals = normal(spark, sf_dir).groupBy("capture_id").agg(F.count("*").alias("n"), F.max("offset_ns").alias("duration_ns"), F.sum("bytes").alias("bytes"))
    return N.bound_faults(totals, 450, 600 * HOUR, 5000)
