"""Queries over captured requests: predicates, headers, shards, row transforms."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import select as S
from ..operators import transform as T
from ..sources.adapters import CAPTURED, captured, table
from .registry import query

START, END = dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 20, 12)
RANGE = "ts between timestamp '2024-01-05' and timestamp '2024-01-20 12:00:00'"
FNV = "(list_reduce(list_prepend(14695981039346656037::uhugeint, list_transform(string_split({0}, ''), lambda c: ord(c)::uhugeint)), lambda h, c: (xor(h, c) * 1099511628211::uhugeint) % 18446744073709551616::uhugeint) % {1})::int"


@query(f"select id, method, path from captured where starts_with(path, '/api/v1') and {RANGE} and method in ('GET', 'POST')", CAPTURED)
def select_requests(spark, sf_dir) -> DataFrame:
    """Path prefix, inclusive time range with day pruning, methods in any case."""
    df = captured(spark, sf_dir)
    return df.where(S.path_prefix("/api/v1") & S.by_day(START, END) & S.in_time(START, END) & S.methods(["get", "Post "])).select("id", "method", "path")


@query("select id from captured where debug = 'true'", CAPTURED)
def header_match(spark, sf_dir) -> DataFrame:
    return captured(spark, sf_dir).where(X.headers_match("headers", [("X-DEBUG", "true"), ("content-type", "application/json")])).select("id")


@query("select id from captured where starts_with(path, '/api/v2') and debug = 'false' and ('0x' || substr(md5('0:' || id), 1, 8))::bigint < cast(0.3 * 4294967296 as bigint)", CAPTURED)
def capture_filter_sampled(spark, sf_dir) -> DataFrame:
    return captured(spark, sf_dir).where(S.capture_filter("/api/v2", [("x-debug", "false")], 30)).select("id")


@query("select method, count(*) total, count(*) filter (where not starts_with(path, '/api/v1')) filtered, sum(case when starts_with(path, '/api/v1') then least(content_length, 20) else 0 end)::bigint bytes from captured group by method", CAPTURED)
def capture_counters(spark, sf_dir) -> DataFrame:
    """Rows seen and filtered, bytes after truncation."""
    df = T.truncate_body(captured(spark, sf_dir), 20)
    kept = S.capture_filter("/api/v1")
    return df.groupBy("method").agg(F.count("*").alias("total"), F.count_if(~kept).alias("filtered"), F.sum(F.when(kept, F.col("contentLength")).otherwise(0)).alias("bytes"))


@query("select object_key, line, id from captured where starts_with(path, '/api/v0') order by object_key, line limit 500", CAPTURED)
def ordered_limit(spark, sf_dir) -> DataFrame:
    return S.first_in_order(captured(spark, sf_dir).where(S.path_prefix("/api/v0")).select("object_key", "line", "id"), 500)


@query("select id, host from captured where host = 'api1.example.com' or host = 'api2.example.com'", CAPTURED)
def allowed_hosts(spark, sf_dir) -> DataFrame:
    host = F.col("metadata")["host"]
    return captured(spark, sf_dir).where(X.host_allowed(F.concat(F.upper(host), F.lit(".")), [" api1.example.com", "*.api2.example.com", "API2.example.com", ""])).select("id", host.alias("host"))


@query("select id, host from captured where host <> 'example.com' and ends_with(host, '.example.com')", CAPTURED)
def allowed_wildcard_hosts(spark, sf_dir) -> DataFrame:
    host = F.col("metadata")["host"]
    return captured(spark, sf_dir).where(X.host_allowed(host, ["*.example.com"])).select("id", host.alias("host"))


@query(f"select s.shard, coalesce(n, 0) n from (select unnest(range(4))::int shard) s left join (select {FNV.format('id', 4)} shard, count(*) n from captured group by 1) c using (shard)", CAPTURED)
def shard_counts(spark, sf_dir) -> DataFrame:
    return S.shard_counts(S.with_shard(captured(spark, sf_dir), 4), 4)


@query(f"select id from captured where {FNV.format('id', 7)} = 3", CAPTURED)
def shard_slice(spark, sf_dir) -> DataFrame:
    return captured(spark, sf_dir).where(S.shard_owns(3, 7)).select("id")


@query("select 'disjoint' as check_name, 0::bigint faults union all select 'exhaustive', 0", CAPTURED)
def shard_set_checks(spark, sf_dir) -> DataFrame:
    """No id is in two shards, none in no shard."""
    df = captured(spark, sf_dir)
    sharded = S.with_shard(df, 5).select("id", "shard")
    count = lambda name, x: x.agg(F.lit(name).alias("check_name"), F.count("*").alias("faults"))
    return count("disjoint", S.not_disjoint(sharded)).unionByName(count("exhaustive", S.not_covered(df, sharded)))


@query("select id, substr(body, 1, 16) body, least(content_length, 16) content_length, content_length > 16 cut from captured", CAPTURED)
def truncated_bodies(spark, sf_dir) -> DataFrame:
    df = T.truncate_body(captured(spark, sf_dir), 16)
    cut = F.coalesce(F.try_element_at("metadata", F.lit("bodyTruncated")) == "true", F.lit(False))
    return df.select("id", F.decode("body", "utf-8").alias("body"), F.col("contentLength").alias("content_length"), cut.alias("cut"))


@query("select id, '[REDACTED]' auth, 'application/json' content_type, '[REDACTED]' debug from captured", CAPTURED)
def redacted_headers(spark, sf_dir) -> DataFrame:
    df = T.redact_headers(captured(spark, sf_dir), "X-DEBUG, ")
    debug = F.coalesce(F.try_element_at("headers", F.lit("X-Debug")), F.try_element_at("headers", F.lit("x-debug")))
    return df.select("id", F.col("headers")["Authorization"][0].alias("auth"), F.col("headers")["Content-Type"][0].alias("content_type"), debug[0].alias("debug"))


@query("select id, case when event_id % 2 = 0 then 'Authorization=token;Connection=keep-alive;Content-Type=application/json|text/plain;X-Id=new' else 'Authorization=token;Connection=keep-alive;Content-Type=application/json|text/plain;X-Id=new;x-debug=' || debug end headers from captured", CAPTURED)
def rewritten_headers(spark, sf_dir) -> DataFrame:
    h = X.rewrite_headers("headers", {"Authorization": "token"}, {"X-Id": "new", "Content-Type": "text/plain"}, ["X-Debug", "none"])
    return captured(spark, sf_dir).select("id", _flat(h).alias("headers"))


def _flat(headers):
    return F.array_join(F.array_sort(F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "|")))), ";")


@query(
    "select id, method, 'http://target.local:8080' || path url, case when event_id % 2 = 0 then 'Authorization=x;Content-Type=application/json;X-Debug=' || debug || ';X-Replay=true;X-Request-Id=' || id else 'Authorization=x;Content-Type=application/json;X-Replay=true;X-Request-Id=' || id || ';x-debug=' || debug end headers from captured",
    CAPTURED,
)
def outbound_requests(spark, sf_dir) -> DataFrame:
    df = T.outbound(captured(spark, sf_dir), "http://target.local:8080//", {"Authorization": "x"})
    return df.select("id", "method", "url", _flat("headers").alias("headers"))


@query("select id, method, 'http://t' || path url, method = 'GET' bodyless, 'Bearer ' || user_id auth from captured", CAPTURED)
def script_requests(spark, sf_dir) -> DataFrame:
    df = T.script_outbound(captured(spark, sf_dir), "http://t/")
    return df.select("id", "method", "url", F.col("body").isNull().alias("bodyless"), F.col("headers")["Authorization"].alias("auth"))


@query("select capture_id, split_part(capture_id, '/', 1) namespace, split_part(capture_id, '/', 2) as name, 'lake/' || capture_id || '/' prefix, capture_id || '/shards/1-of-4' slice, count(*) n from captured group by capture_id", CAPTURED)
def capture_names(spark, sf_dir) -> DataFrame:
    parts = X.split_capture_id("capture_id")
    slice_ = F.concat("capture_id", F.lit("/shards/1-of-4"))
    return captured(spark, sf_dir).groupBy("capture_id").agg(F.count("*").alias("n")).select("capture_id", parts["namespace"].alias("namespace"), parts["name"].alias("name"), X.object_prefix(F.lit("/lake/"), "capture_id").alias("prefix"), slice_.alias("slice"), "n")


@query(
    "select object_key, capture_id, capture_date::varchar as day, 'agent-' || any_value(user_id % 4) pod, any_value(hour(ts))::bigint seq, count(*) n from captured group by all",
    CAPTURED,
)
def object_inventory(spark, sf_dir) -> DataFrame:
    """Objects with what their keys say."""
    k = X.parse_object_key("object_key")
    objects = captured(spark, sf_dir).groupBy("object_key").agg(F.count("*").alias("n"))
    return objects.select("object_key", k["capture_id"].alias("capture_id"), k["day"].cast("string").alias("day"), k["pod"].alias("pod"), k["seq"].alias("seq"), "n")


@query("select substr(split_part(path, '/', 4), 1) as call, count(*) n, arg_min(body, object_key || '#' || lpad(line::varchar, 12, '0')) first_body from captured where protocol = 'gRPC' group by 1", CAPTURED)
def grpc_method_mix(spark, sf_dir) -> DataFrame:
    from ..operators.summary import method_mix

    df = captured(spark, sf_dir).where("protocol = 'gRPC'").withColumn("path", F.concat(F.lit("/"), F.split("path", "/")[3]))
    return method_mix(df).select("call", "n", F.decode("first_body", "utf-8").alias("first_body")).orderBy("call")


@query(
    "select page_id, 'GET' as method, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) as path, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) host, regexp_extract(url, '\\?([^#]*)', 1) query, strlen(html) body_bytes from pages",
)
def pages_as_requests(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.col("page_id").alias("id"), F.lit("GET").alias("method"), "url", F.expr("try_parse_url(url, 'AUTHORITY')").alias("host"), F.lit("10.0.0.1").alias("remote_addr"), "html")
    made = T.from_http(p)
    return made.select(F.col("id").alias("page_id"), "method", "path", F.col("metadata")["host"].alias("host"), F.col("metadata")["query"].alias("query")).join(p.select("page_id", F.octet_length("html").cast("long").alias("body_bytes")), "page_id")


@query("select id, debug = 'false' filtered from captured", CAPTURED)
def python_transform_chain(spark, sf_dir) -> DataFrame:
    """A chain of row functions: errors drop a row, None filters it."""
    df = captured(spark, sf_dir).select("id", (F.coalesce(F.try_element_at("headers", F.lit("X-Debug")), F.try_element_at("headers", F.lit("x-debug")))[0]).alias("debug"))

    def only_debug(row: dict) -> dict | None:
        if row["debug"] == "false":
            raise ValueError(row["id"])
        return row

    return T.row_chain(df, [only_debug, lambda row: row]).select("id", "filtered")


@query("select id, 'application/json' content_type, 8 body_bytes, '[REDACTED]' auth from captured where content_length > 8", CAPTURED)
def configured_transform_chain(spark, sf_dir) -> DataFrame:
    """Registered column transforms in the order of a configuration; Spark sees one projection."""
    df = T.chain(captured(spark, sf_dir), [("truncate", {"most": 8}), ("redact", {}), ("rewrite-headers", {"remove": ["Connection"]})])
    return df.where(F.col("metadata")["bodyTruncated"] == "true").select("id", F.col("headers")["Content-Type"][0].alias("content_type"), F.octet_length("body").alias("body_bytes"), F.col("headers")["Authorization"][0].alias("auth"))


@query(
    "select user_id, case when m = 0 then '0s' when m < 1000 then m || 'ms' when m < 60000 then regexp_replace(printf('%.3f', m / 1000.0), '\\.?0+$', '') || 's' else (m // 60000) || 'm' || regexp_replace(printf('%.3f', (m % 60000) / 1000.0), '\\.?0+$', '') || 's' end latency, m parsed_ms "
    "from (select user_id, round(sum(value))::bigint m from events group by 1)"
)
def latency_texts(spark, sf_dir) -> DataFrame:
    """Durations as text and parsed again."""
    df = table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.sum("value")).cast("long").alias("ms")).withColumn("latency", X.latency_text("ms"))
    return df.withColumn("ns", X.duration_ns("latency")).select("user_id", "latency", F.expr("ns div 1000000").alias("parsed_ms"))
