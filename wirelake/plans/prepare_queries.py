"""Queries that prepare replay datasets: normal form, bundles, buckets, profiles, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import policy as D
from ..sources.adapters import CAPTURED, RESULTS, captured, results, table
from ..sources import bundles as files
from ..sources.shared import fresh_path
from . import prepare as N
from .registry import query

HOUR = 3_600_000_000_000
NORMAL = "normal as (select *, (ts_us - min(ts_us) over (partition by capture_id)) * 1000 offset_ns from captured)"
BUCKETS = f"""counts as (select capture_id, offset_ns // {HOUR} bucket, count(*) n, sum(content_length)::bigint bytes from normal group by all),
buckets as (select capture_id, bucket, coalesce(n, 0) n, coalesce(bytes, 0) bytes from (select capture_id, unnest(range(max(bucket) + 1)) bucket from counts group by 1) left join counts using (capture_id, bucket))"""


def normal(spark, sf_dir) -> DataFrame:
    return N.normalize(captured(spark, sf_dir)).withColumn("bytes", F.col("body_ref.length"))


def buckets(spark, sf_dir) -> DataFrame:
    return N.time_buckets(normal(spark, sf_dir), HOUR)


@query("select id, offset_ns, host authority, query, method || ' ' || path route_key, host || '|' || path partition_key, sha256(body) body_sha256, content_length body_bytes from normal", CAPTURED, NORMAL)
def normalized_records(spark, sf_dir) -> DataFrame:
    df = normal(spark, sf_dir)
    return df.select("id", "offset_ns", "authority", "query", "route_key", "partition_key", F.col("body_ref.sha256").alias("body_sha256"), F.col("body_ref.length").alias("body_bytes"))


@query("select sha256(html) sha256, 'bodies/sha256/' || substr(sha256(html), 1, 2) || '/' || substr(sha256(html), 3, 2) || '/' || sha256(html) as location, count(*) uses, any_value(strlen(html)) body_bytes from pages where strlen(html) > 1000 group by 1, 2")
def external_bodies(spark, sf_dir) -> DataFrame:
    """Bodies of more than a thousand bytes, each digest once."""
    _, bodies = N.externalize(table(spark, sf_dir, "pages").select("page_id", F.col("html").cast("binary").alias("body")), 1000)
    return bodies.select("sha256", "location", "uses", F.octet_length("body").cast("long").alias("body_bytes"))


@query(f", s as (select *, offset_ns // {24 * HOUR} span from normal), b as (select *, (sum(content_length) over (partition by capture_id, span order by offset_ns, id) - content_length)::bigint // 200 bundle from s) select capture_id, span, bundle, min(offset_ns) first_ns, max(offset_ns) last_ns, count(*) n, sum(content_length)::bigint bytes from b group by all", CAPTURED, NORMAL)
def bundle_index(spark, sf_dir) -> DataFrame:
    index = N.bundle_index(N.bundles(normal(spark, sf_dir), 200, 24 * HOUR))
    return index.select("capture_id", "span", "bundle", "first_ns", "last_ns", "n", "bytes")


@query("select capture_id, bucket, n, bytes from buckets", CAPTURED, NORMAL, BUCKETS)
def time_bucket_index(spark, sf_dir) -> DataFrame:
    return buckets(spark, sf_dir)


@query(f"select capture_id, max(n) peak, list_sort(list(n))[cast(floor((count(*) - 1) * 0.5) as int) + 1] median, count(*) * {HOUR} duration_ns from buckets group by 1", CAPTURED, NORMAL, BUCKETS)
def rate_profile(spark, sf_dir) -> DataFrame:
    return N.profile(buckets(spark, sf_dir), HOUR)


@query("select method || ' ' || path route_key, count(*) n, sum(content_length)::bigint bytes from captured group by 1 order by bytes desc, route_key limit 20", CAPTURED)
def top_routes(spark, sf_dir) -> DataFrame:
    return normal(spark, sf_dir).groupBy("route_key").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).orderBy(F.desc("bytes"), "route_key").limit(20)


@query("select floor(log2(greatest(strlen(html), 1)))::bigint size_class, count(*) n, sum(strlen(html))::bigint bytes from pages group by 1")
def body_sizes(spark, sf_dir) -> DataFrame:
    """Histogram of bodies by powers of two."""
    size = F.octet_length("html")
    return table(spark, sf_dir, "pages").groupBy(F.floor(F.log2(F.greatest(size, F.lit(1)))).cast("long").alias("size_class")).agg(F.count("*").alias("n"), F.sum(size).cast("long").alias("bytes"))


@query("select capture_id, count(distinct object_key) objects, count(*) n, sum(content_length)::bigint body_bytes, count(*) filter (where content_length > 20) truncated from captured group by 1", CAPTURED)
def capture_sizes(spark, sf_dir) -> DataFrame:
    long = F.count_if(F.col("contentLength") > 20)
    return captured(spark, sf_dir).groupBy("capture_id").agg(F.countDistinct("object_key").alias("objects"), F.count("*").alias("n"), F.sum("contentLength").alias("body_bytes"), long.alias("truncated"))


DRAW = "(('0x' || substr(md5(id), 1, 8))::bigint < cast(floor({0} * 4294967296) as bigint))::int"


@query(f"select id, 1 copy_no from captured where {DRAW.format(0.4)} = 1", CAPTURED)
def rate_scaled_down(spark, sf_dir) -> DataFrame:
    return N.scale_rate(captured(spark, sf_dir).select("id"), 0.4).select("id", F.lit(1).alias("copy_no"))


@query(f"select case when k = 1 then id else id || '~' || k end id from (select id, unnest(range(1, 3 + {DRAW.format(0.5)})) k from captured)", CAPTURED)
def rate_scaled_up(spark, sf_dir) -> DataFrame:
    return N.scale_rate(captured(spark, sf_dir).select("id"), 2.5)


PLACE = "placed as (select id, count(*) over (partition by capture_id, offset_ns // 86400000000000) n, row_number() over (partition by capture_id, offset_ns // 86400000000000 order by ('0x' || substr(md5(id), 1, 8))::bigint, id) place from normal)"


@query(", " + PLACE + " select id from placed where place <= floor(n * 0.3::double + 0.5)", CAPTURED, NORMAL)
def bucket_scaled_down(spark, sf_dir) -> DataFrame:
    """Three tenths of each capture's day, to one row: the smallest hashes."""
    return N.scale_rate_by_bucket(normal(spark, sf_dir), 0.3, 24 * HOUR).select("id")


@query(", " + PLACE + " select case when k = 1 then id else id || '~' || k end id from (select id, unnest(range(1, 2 + (place <= floor(n * 0.25::double + 0.5))::int)) k from placed)", CAPTURED, NORMAL)
def bucket_scaled_up(spark, sf_dir) -> DataFrame:
    """All of each capture's day and another quarter of it."""
    return N.scale_rate_by_bucket(normal(spark, sf_dir), 1.25, 24 * HOUR).select("id")


@query(", a as (select *, ceil(n / 0.7 * 1.2)::bigint agents from buckets) select capture_id, bucket, agents, max(agents) over (partition by capture_id order by bucket range between current row and 5 following) ahead from a", CAPTURED, NORMAL, BUCKETS)
def planned_agents(spark, sf_dir) -> DataFrame:
    return N.agents(buckets(spark, sf_dir), 0.7, 1.2, 5).select("capture_id", "bucket", "agents", "ahead")


@query(", u as (select *, (sum(n) over (partition by capture_id order by bucket) - n)::bigint // 50 lease from buckets) select capture_id, lease, min(bucket) first_bucket, max(bucket) last_bucket, sum(n)::bigint expected from u group by 1, 2", CAPTURED, NORMAL, BUCKETS)
def lease_plan(spark, sf_dir) -> DataFrame:
    return N.leases(buckets(spark, sf_dir), 50)


@query(", act as (select capture_id, offset_ns // 3600000000000 bucket, count(*) n from normal where line % 10 <> 0 group by 1, 2) select capture_id, bucket, b.n expected, coalesce(act.n, 0) actual, abs(coalesce(act.n, 0) - b.n) / greatest(b.n, 1) <= 0.25 as within_tolerance from buckets b left join act using (capture_id, bucket)", CAPTURED, NORMAL, BUCKETS)
def bucket_accuracy(spark, sf_dir) -> DataFrame:
    """Buckets of what was sent (a tenth got lost) against what was planned."""
    df = normal(spark, sf_dir).join(captured(spark, sf_dir).where("line % 10 <> 0").select("id"), "id", "left_semi")
    actual = df.groupBy("capture_id", F.floor(F.col("offset_ns") / HOUR).cast("long").alias("bucket")).agg(F.count("*").alias("n"))
    return N.bucket_accuracy(buckets(spark, sf_dir).drop("bytes"), actual, 0.25, ["capture_id", "bucket"])


@query(", i as (select *, bucket - row_number() over (partition by capture_id order by bucket) island from buckets where n = 0) select capture_id, min(bucket) first_bucket, count(*) n from i group by capture_id, island having count(*) >= 3", CAPTURED, NORMAL, BUCKETS)
def bad_bucket_runs(spark, sf_dir) -> DataFrame:
    """Three or more buckets in a row without a request."""
    return N.bad_runs(buckets(spark, sf_dir), F.col("n") == 0, 3, ["capture_id"])


@query(", o as (select distinct capture_id, capture_date, user_id % 4 pod, hour(ts) seq from captured), g as (select *, lag(seq) over (partition by capture_id, capture_date, pod order by seq) before from o) select capture_id, capture_date::varchar as day, 'agent-' || pod pod, before + 1 first_missing, seq - 1 last_missing from g where seq > before + 1", CAPTURED)
def object_gaps(spark, sf_dir) -> DataFrame:
    """Numbers missing between the objects of a pod and day."""
    from ..functions.exprs import parse_object_key

    k = parse_object_key("object_key")
    objects = captured(spark, sf_dir).select("object_key").distinct().select(k["capture_id"].alias("capture_id"), k["day"].cast("string").alias("day"), k["pod"].alias("pod"), k["seq"].alias("seq"))
    return N.sequence_gaps(objects, ["capture_id", "day", "pod"])


@query("select id, 'destructive method' fault from captured where method in ('DELETE', 'PUT', 'PATCH') union all select id, 'credential header' from captured union all select id, 'original host' from captured where host = 'api2.example.com'", CAPTURED)
def preflight_faults(spark, sf_dir) -> DataFrame:
    return N.dataset_faults(N.normalize(captured(spark, sf_dir)), "API2.example.com")


@query("select path, sum(content_length + 1024)::bigint whole_bytes, sum(case when event_type = 'error' then content_length else 0 end + 1024)::bigint selected_bytes, round(100 - 100 * sum(case when event_type = 'error' then content_length else 0 end + 1024) / sum(content_length + 1024), 4) saved_percent from captured group by path", CAPTURED)
def retained_bytes(spark, sf_dir) -> DataFrame:
    df = captured(spark, sf_dir).select("path", F.col("contentLength").alias("bytes"), "method")
    return N.retained_bytes(df, ["path"], F.col("method") == "DELETE")


@query("select capture_id, count(*) n, true as same, false as same_without_one from captured group by 1", CAPTURED)
def slice_digests(spark, sf_dir) -> DataFrame:
    """Order-free digests of every capture's lines: the same in another order and dealing, others where a line is missing."""
    df = captured(spark, sf_dir).select("capture_id", F.concat_ws("\t", "id", "method", "path").alias("line_text"))
    sums = lambda rows, name: D.digests(rows, ["capture_id"]).select("capture_id", F.struct("check", "n").alias(name))
    first = df.groupBy("capture_id").agg(F.min("line_text").alias("line_text"))
    found = sums(df, "a").join(sums(df.repartition(7, "line_text"), "b"), "capture_id").join(sums(df.join(first, ["capture_id", "line_text"], "left_anti"), "c"), "capture_id", "left")
    return found.select("capture_id", F.col("a.n").alias("n"), (F.col("a") == F.col("b")).alias("same"), F.coalesce(F.col("a.check") == F.col("c.check"), F.lit(False)).alias("same_without_one"))


@query("select capture_id, sha256(string_agg(id || ' ' || path, chr(10) order by line) || chr(10)) sha256, count(*) n from captured group by 1", CAPTURED)
def ordered_slice_digests(spark, sf_dir) -> DataFrame:
    """SHA-256 of every capture's lines in order, as manifests have it."""
    df = captured(spark, sf_dir).select("capture_id", "line", F.concat_ws(" ", "id", "path").alias("line_text"))
    return D.ordered_digest(df, "capture_id", ["line"])


LAG = "lagging as (select method, status_code, error, duration_ns lag_ns from captured join results on id = request_id)"
LOWER = "list_sort(list(lag_ns))[cast(floor((count(*) - 1) * {0}::double) as int) + 1]"


@query(f"select method, status_code, count(*) n, count(error) * 100.0 / count(*) error_percent, {LOWER.format(0.5)} p50, {LOWER.format(0.95)} p95, {LOWER.format(0.99)} p99 from lagging group by all", CAPTURED, RESULTS, LAG)
def bucket_health(spark, sf_dir) -> DataFrame:
    """Errors and lag by method and status."""
    r = results(spark, sf_dir).select(F.col("request_id").alias("id"), "status_code", "error", F.col("duration_ns").alias("lag_ns"))
    return N.bucket_health(captured(spark, sf_dir).select("id", "method").join(r, "id"), ["method", "status_code"])


@query(f", s as (select *, offset_ns // {24 * HOUR} span from normal), b as (select *, (sum(content_length) over (partition by capture_id, span order by offset_ns, id) - content_length)::bigint // 200 bundle from s) select capture_id, span, bundle, 'count' fault from b group by all having max((line % 500 = 0)::int) = 1", CAPTURED, NORMAL)
def index_faults(spark, sf_dir) -> DataFrame:
    """Bundles that lost records since they were indexed; here every five-hundredth is taken away."""
    packed = N.bundles(normal(spark, sf_dir).join(captured(spark, sf_dir).select("id", "line"), "id"), 200, 24 * HOUR)
    return N.index_faults(packed.where("line % 500 <> 0"), N.bundle_index(packed), ["capture_id"]).where("fault = 'count'")


@query("select id, row_number() over (order by ts_us, id) - 1 as place from captured", CAPTURED)
def time_sorted_records(spark, sf_dir) -> DataFrame:
    """Records in one order of time over all objects, written so, each with its place."""
    root = fresh_path(spark, "sorted")
    N.write_time_sorted(captured(spark, sf_dir).select("id", "timestamp"), root, 8)
    return N.read_time_sorted(spark, root).select("id", "place")


@query(", f as (select capture_id, offset_ns // 3600000000000 bucket, count(error) * 100.0 / count(*) > 5 bad from normal join results on id = request_id group by 1, 2), i as (select *, bucket - row_number() over (partition by capture_id order by bucket) island from f where bad) select capture_id, min(bucket) first_bucket, count(*) n from i group by capture_id, island having count(*) >= 3", CAPTURED, NORMAL, RESULTS.replace("epoch_us(ts) + round(value * 1e6)::bigint // 1000 ts_us", "0 r_us"))
def failing_bucket_runs(spark, sf_dir) -> DataFrame:
    """Three hours in a row with over five percent of errors: a reason to stop."""
    r = results(spark, sf_dir).select(F.col("request_id").alias("id"), "error")
    df = normal(spark, sf_dir).select("id", "capture_id", F.floor(F.col("offset_ns") / HOUR).cast("long").alias("bucket")).join(r, "id")
    rate = df.groupBy("capture_id", "bucket").agg((F.count("error") * 100.0 / F.count("*")).alias("percent"))
    return N.bad_runs(rate, F.col("percent") > 5, 3, ["capture_id"])


SENT = f"sent as (select capture_id, (offset_ns // {HOUR})::bigint bucket, duration_ns lag_ns, error, status_code from normal join results on id = request_id)"
METRICS = "metrics as (select capture_id, bucket, count(*) n, count(error) / count(*) failed, count(*) filter (where status_code between 500 and 599) / count(*) server_errors, list_sort(list(lag_ns))[cast(floor((count(*) - 1) * 0.99::double) as int) + 1] p99_lag_ns from sent group by all)"
RUN = "select capture_id, '{0}' as rule, min(bucket) first_bucket, count(*) n from (select *, bucket - row_number() over (partition by capture_id order by bucket) island from metrics where {1}) group by capture_id, island having count(*) >= {2}"


def sent(spark, sf_dir) -> DataFrame:
    """What was sent of the captures, with the time that it took as its lag."""
    r = results(spark, sf_dir).select(F.col("request_id").alias("id"), "status_code", "error", F.col("duration_ns").alias("lag_ns"))
    return normal(spark, sf_dir).select("id", "capture_id", F.col("offset_ns").alias("planned_ns")).join(r, "id")


def metrics(spark, sf_dir) -> DataFrame:
    return N.bucket_metrics(sent(spark, sf_dir), HOUR, ["capture_id"])


@query(", " + SENT + ", " + METRICS + " select capture_id, bucket, b.n expected, coalesce(m.n, 0) actual, p99_lag_ns, abs(coalesce(m.n, 0) - b.n) / greatest(b.n, 1) <= 0.1 count_met, coalesce(p99_lag_ns <= 150000000, true) lag_met from buckets b left join metrics m using (capture_id, bucket)", CAPTURED, RESULTS, NORMAL, BUCKETS)
def bucket_success(spark, sf_dir) -> DataFrame:
    """Buckets whose count and p99 lag were met."""
    return N.bucket_success(buckets(spark, sf_dir), metrics(spark, sf_dir), 0.1, 150_000_000, ["capture_id"])


@query(", " + SENT + ", " + METRICS + " " + RUN.format("failures", "failed > 0.05", 2) + " union all " + RUN.format("lag", "p99_lag_ns > 100000000", 2) + " union all " + RUN.format("server errors", "server_errors > 0.5", 1), CAPTURED, RESULTS, NORMAL)
def abort_rules(spark, sf_dir) -> DataFrame:
    """Stretches of buckets for which a replay is stopped: failed sends, p99 lag, 5xx."""
    return N.abort_reasons(metrics(spark, sf_dir), ["capture_id"], 0.5, 0.05, 100_000_000, 2)


@query("select event_type as lease, epoch_us(a) from_us, (epoch_us(b) - epoch_us(a)) / 1e6 silent_s from (select event_type, lag(ts) over (partition by event_type order by ts) a, ts b from events union all select event_type, max(ts), timestamp '2024-03-01' from events group by 1) where epoch_us(b) - epoch_us(a) > 1800 * 1000000::bigint")
def silent_leases(spark, sf_dir) -> DataFrame:
    """Half hours and more without a heartbeat of a lease."""
    h = table(spark, sf_dir, "events").select(F.col("event_type").alias("lease"), F.col("ts").cast("timestamp").alias("ts"))
    return N.silent_leases(h, F.lit("2024-03-01").cast("timestamp"), ["lease"], 1800)


@query(f"select capture_id, (offset_ns // {HOUR})::bigint bucket, count(*) n, ceil(count(*) / 3.0 * 1.2)::bigint required_agents, count(*)::bigint in_bundles, true as whole from normal group by 1, 2", CAPTURED, NORMAL)
def bundle_files(spark, sf_dir) -> DataFrame:
    """Bundles as files of two days' records at most: the index of buckets, and if each bundle is within its bounds and as its digest says."""
    root = fresh_path(spark, "bundles")
    files.write_bundles(normal(spark, sf_dir).drop("body", "headers"), root, 4_000, 5_000, 48 * HOUR, HOUR, 3.0, 1.2)
    faults = files.bundle_faults(spark, root).select("bundle_id").union(files.read_index(spark, root).where("bytes > 5000 or n < 1 or last_ns < first_ns").select("bundle_id")).distinct()
    parts = files.read_buckets(spark, root).select("capture_id", "bucket", "n", "required_agents", F.explode("bundles").alias("b"))
    parts = parts.join(faults.withColumn("faulty", F.lit(True)), F.col("b.bundle_id") == F.col("bundle_id"), "left")
    return parts.groupBy("capture_id", "bucket", "n", "required_agents").agg(F.sum("b.n").alias("in_bundles"), (F.count("faulty") == 0).alias("whole"))


@query(f"select id, offset_ns, route_key from (select id, capture_id, offset_ns, method || ' ' || path route_key from normal) where capture_id = 'ns1/cap3' and offset_ns // {HOUR} between 24 and 240", CAPTURED, NORMAL)
def bundle_lookup(spark, sf_dir) -> DataFrame:
    """A lease's records by the index of buckets: no other bundle is opened."""
    root = fresh_path(spark, "bundles")
    files.write_bundles(normal(spark, sf_dir).select("id", "capture_id", "offset_ns", "route_key"), root, 4_000, 8_000, 24 * HOUR, HOUR)
    return files.read_records(spark, root, "id string, offset_ns long, route_key string", "ns1/cap3", 24, 240, HOUR)
