"""The given tables as the engine's own: captured requests, results, spokes, statuses.

Each has a DuckDB twin in SQL, for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def captured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured requests out of `events`. capture_date and object_key are its layout, line its place in the object."""
    e, u = F.col("event_id"), F.col("user_id")
    text = lambda c: c.cast("string")
    capture = F.concat(F.lit("ns"), text(u % 3), F.lit("/cap"), text(u % 7))
    day = F.date_format("ts", "yyyy-MM-dd")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("req-"), text(e)).alias("id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.element_at(F.create_map(*map(F.lit, ("view", "GET", "click", "POST", "purchase", "PUT", "signup", "PATCH", "error", "DELETE"))), F.col("event_type")).alias("method"),
        F.concat(F.lit("/api/v"), text(u % 3), F.lit("/"), F.col("event_type"), F.lit("/"), text(u)).alias("path"),
        F.map_from_arrays(
            F.array(F.lit("Content-Type"), F.lit("Authorization"), F.when(e % 2 == 0, "X-Debug").otherwise("x-debug"), F.lit("Connection")),
            F.array(F.array(F.lit("application/json")), F.array(F.concat(F.lit("Bearer "), text(u))), F.array(F.when(e % 7 == 0, "true").otherwise("false")), F.array(F.lit("keep-alive"))),
        ).alias("headers"),
        F.encode("props", "utf-8").alias("body"),
        F.octet_length("props").cast("long").alias("contentLength"),
        F.when(e % 5 == 0, "gRPC").otherwise("HTTP/1.1").alias("protocol"),
        F.create_map(F.lit("host"), F.concat(F.lit("api"), text(u % 4), F.lit(".example.com")), F.lit("query"), F.concat(F.lit("v="), text(e % 10))).alias("metadata"),
        capture.alias("capture_id"),
        F.to_date("ts").alias("capture_date"),
        X.object_key(capture, day, F.concat(F.lit("agent-"), text(u % 4)), F.hour("ts")).alias("object_key"),
        e.alias("line"),
    )


CAPTURED = """captured as (select 'req-' || event_id id, epoch_us(ts) ts_us, ts, case event_type when 'view' then 'GET' when 'click' then 'POST' when 'purchase' then 'PUT' when 'signup' then 'PATCH' else 'DELETE' end as method,
    '/api/v' || user_id % 3 || '/' || event_type || '/' || user_id as path, case when event_id % 7 = 0 then 'true' else 'false' end debug, props body, strlen(props) content_length, case when event_id % 5 = 0 then 'gRPC' else 'HTTP/1.1' end protocol,
    'api' || user_id % 4 || '.example.com' host, 'v=' || event_id % 10 query, 'ns' || user_id % 3 || '/cap' || user_id % 7 capture_id, cast(ts as date) capture_date,
    'ns' || user_id % 3 || '/cap' || user_id % 7 || '/' || strftime(ts, '%Y-%m-%d') || '/agent-' || user_id % 4 || '-' || lpad(hour(ts)::varchar, 6, '0') || '.jsonl.gz' object_key, event_id line, event_id, user_id, event_type from events)"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replay results out of `events`; an event type `error` of an even user has an error, of an odd one a 500."""
    u = F.col("user_id")
    failed = (F.col("event_type") == "error") & (u % 2 == 0)
    kinds = F.array(*map(F.lit, ("context canceled", "context deadline exceeded", "Client.Timeout exceeded", "EOF", "connection reset")))
    ns = F.round(F.col("value") * 1e6).cast("long")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("req-"), F.col("event_id").cast("string")).alias("request_id"),
        F.when(failed, 0).when(F.col("event_type") == "error", 500).when(F.col("event_type") == "purchase", 201).otherwise(200).alias("status_code"),
        ns.alias("duration_ns"),
        F.when(failed, F.element_at(kinds, (u % 5 + 1).cast("int"))).alias("error"),
        F.octet_length("props").cast("long").alias("response_bytes"),
        F.timestamp_micros(X.micros("ts") + F.floor(ns / 1000)).alias("timestamp"),
        F.concat(F.lit("run-"), (u % 8).cast("string")).alias("run_id"),
        F.col("event_id").alias("seq"),
    )


RESULTS = """results as (select 'req-' || event_id request_id, case when event_type = 'error' and user_id % 2 = 0 then 0 when event_type = 'error' then 500 when event_type = 'purchase' then 201 else 200 end status_code,
    round(value * 1e6)::bigint duration_ns, case when event_type = 'error' and user_id % 2 = 0 then ['context canceled', 'context deadline exceeded', 'Client.Timeout exceeded', 'EOF', 'connection reset'][user_id % 5 + 1] end error,
    strlen(props) response_bytes, epoch_us(ts) + round(value * 1e6)::bigint // 1000 ts_us, 'run-' || user_id % 8 run_id, event_id seq from events)"""


def spokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spokes and their cells out of supplier, nation and region; every seventh has no cell."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    at = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    return at.select(F.concat(F.lit("spoke-"), F.col("s_suppkey").cast("string")).alias("spoke_id"), F.col("n_name").alias("cluster_name"), F.when(F.col("s_suppkey") % 7 == 0, "").otherwise(F.col("r_name")).alias("cell"))


SPOKES = """spokes as (select 'spoke-' || s_suppkey spoke_id, n_name cluster_name, case when s_suppkey % 7 = 0 then '' else r_name end cell
    from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""


def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("spoke-"), (F.col("user_id") % 100 + 1).cast("string")).alias("spoke_id"), F.col("ts").cast("timestamp").alias("ts"), F.floor("value").cast("long").alias("active_captures"), F.col("event_id").alias("seq")
    )


HEARTBEATS = "heartbeats as (select 'spoke-' || (user_id % 100 + 1) spoke_id, epoch_us(ts) ts_us, floor(value)::bigint active_captures, event_id seq from events)"


def captures_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures out of orders, with their number of lines as requests and the customer's segment as storage."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("captured_requests"))
    both = o.join(c, o.o_custkey == c.c_custkey).join(lines, o.o_orderkey == lines.l_orderkey, "left")
    return both.select(
        F.concat(F.lit("ns"), (F.col("o_custkey") % 5).cast("string"), F.lit("/c"), F.col("o_orderkey").cast("string")).alias("capture_id"),
        F.concat(F.lit("spoke-"), (F.col("o_custkey") % 100 + 1).cast("string")).alias("spoke_id"),
        F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "ACTIVE").otherwise("PENDING").alias("phase"),
        F.coalesce("captured_requests", F.lit(0)).cast("long").alias("captured_requests"),
        F.col("c_mktsegment").alias("storage"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.floor("o_totalprice").cast("long").alias("bytes_written"),
    )


CAPTURES = """captures as (select 'ns' || o_custkey % 5 || '/c' || o_orderkey capture_id, 'spoke-' || (o_custkey % 100 + 1) spoke_id, case o_orderstatus when 'F' then 'COMPLETED' when 'O' then 'ACTIVE' else 'PENDING' end phase,
    coalesce(n, 0) captured_requests, c_mktsegment as storage, epoch_us(o_orderdate) created_us, floor(o_totalprice)::bigint bytes_written
    from orders join customer on o_custkey = c_custkey left join (select l_orderkey, count(*) n from lineitem group by 1) on o_orderkey = l_orderkey)"""


def shard_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status reports of load-test shards out of lineitem; several reports of a shard follow each other by report_no."""
    q = F.col("l_quantity").cast("long")
    failed = F.when(F.col("l_returnflag") == "R", F.expr("cast(l_quantity as bigint) div 5")).otherwise(0).cast("long")
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("spoke-"), (F.col("l_suppkey") % 120 + 1).cast("string")).alias("spoke_id"),
        F.concat(F.lit("ns"), (F.col("l_orderkey") % 50 % 4).cast("string")).alias("load_test_namespace"),
        F.concat(F.lit("lt-"), (F.col("l_orderkey") % 50).cast("string")).alias("load_test_name"),
        (F.col("l_linenumber") - 1).cast("long").alias("shard_index"),
        F.when(F.col("l_linestatus") == "O", "RUNNING").when(F.col("l_returnflag") == "R", "FAILED").otherwise("COMPLETED").alias("phase"),
        (q * 2).alias("total_requests"), q.alias("sent_requests"), failed.alias("failed_requests"), F.expr("cast(l_quantity as bigint) div 10").alias("filtered_requests"),
        (F.round(F.col("l_extendedprice") / 100)).alias("achieved_rps"),
        F.col("l_shipdate").cast("timestamp").alias("reported_at"), F.col("l_orderkey").alias("report_no"),
    )


SHARDS = """shards as (select 'spoke-' || (l_suppkey % 120 + 1) spoke_id, 'ns' || l_orderkey % 50 % 4 load_test_namespace, 'lt-' || l_orderkey % 50 load_test_name, (l_linenumber - 1)::bigint shard_index,
    case when l_linestatus = 'O' then 'RUNNING' when l_returnflag = 'R' then 'FAILED' else 'COMPLETED' end phase, l_quantity::bigint * 2 total_requests, l_quantity::bigint sent_requests,
    case when l_returnflag = 'R' then l_quantity::bigint // 5 else 0 end failed_requests, l_quantity::bigint // 10 filtered_requests, round(l_extendedprice / 100) achieved_rps, epoch_us(l_shipdate) reported_us, l_orderkey report_no from lineitem),
latest as (select * from shards qualify row_number() over (partition by load_test_name, shard_index order by reported_us desc, report_no desc, sent_requests desc, spoke_id desc, phase desc, achieved_rps desc, failed_requests desc) = 1)"""
