"""Replay datasets: normal form, bodies by digest, bundles and their indexes, profiles and checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import blocked
from ..operators.summary import counted_values, percentiles

SECOND = 1_000_000_000


def normalize(df: DataFrame) -> DataFrame:
    """Records with offsets from the capture's first time, route and partition keys, and the body's digest."""
    first = df.groupBy("capture_id").agg(F.min(X.micros("timestamp")).alias("_first"))
    host = F.coalesce(F.try_element_at("metadata", F.lit("host")), F.lit(""))
    return df.join(first, "capture_id").select(
        "id", "capture_id", "timestamp", ((X.micros("timestamp") - F.col("_first")) * 1000).alias("offset_ns"), "method", "path", host.alias("authority"),
        F.coalesce(F.try_element_at("metadata", F.lit("query")), F.lit("")).alias("query"), F.concat_ws(" ", "method", "path").alias("route_key"), F.concat_ws("|", host, "path").alias("partition_key"),
        F.struct(F.sha2("body", 256).alias("sha256"), F.octet_length("body").cast("long").alias("length")).alias("body_ref"), "body", "protocol", "headers",
    )


def body_path(sha: str) -> F.Column:
    return F.concat(F.lit("bodies/sha256/"), F.substring(sha, 1, 2), F.lit("/"), F.substring(sha, 3, 2), F.lit("/"), F.col(sha))


def externalize(df: DataFrame, over: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """Records whose larger bodies are references, and the table of those bodies, each digest once."""
    big = F.octet_length("body") > over
    bodies = df.where(big).groupBy(F.sha2("body", 256).alias("sha256")).agg(F.first("body").alias("body"), F.count("*").alias("uses")).withColumn("location", body_path("sha256"))
    return df.withColumn("body_sha256", F.when(big, F.sha2("body", 256))).withColumn("body", F.when(~big, F.col("body"))), bodies


def bundles(df: DataFrame, target: int, span_ns: int = 10 * SECOND, keys: list[str] = ("capture_id",)) -> DataFrame:
    """bundle of each record: within a span of time, by order, about `target` bytes of bodies.

    Spans are short, so that no capture's records meet in one task.
    """
    keys = list(keys)
    df = df.withColumn("span", F.floor(F.col("offset_ns") / span_ns).cast("long"))
    upto = F.sum("bytes").over(Window.partitionBy(*keys, "span").orderBy("offset_ns", "id")) - F.col("bytes")
    return df.withColumn("bundle", F.floor(upto / target).cast("long"))


def bundle_index(df: DataFrame, keys: list[str] = ("capture_id",)) -> DataFrame:
    """First and last offsets, counts, bytes and routes of every bundle."""
    keys = [*keys, "span", "bundle"]
    routes = df.groupBy(*keys, "method").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "method", F.col("n").cast("string")))), ",").alias("routes"))
    sums = df.groupBy(*keys).agg(F.min("offset_ns").alias("first_ns"), F.max("offset_ns").alias("last_ns"), F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.expr("bit_xor(xxhash64(id))").alias("check"))
    return sums.join(routes, keys)


def time_buckets(df: DataFrame, width_ns: int, keys: list[str] = ("capture_id",)) -> DataFrame:
    """Records and bytes of every bucket of time from a capture's first to its last, empty ones too."""
    keys = list(keys)
    counts = df.groupBy(*keys, F.floor(F.col("offset_ns") / width_ns).cast("long").alias("bucket")).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    every = counts.groupBy(*keys).agg(F.max("bucket").alias("last")).select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("bucket"))
    return every.join(counts, [*keys, "bucket"], "left").select(*keys, "bucket", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


def profile(buckets: DataFrame, width_ns: int, keys: list[str] = ("capture_id",)) -> DataFrame:
    """Peak and median rate of the buckets, and the duration."""
    keys = list(keys)
    sums = buckets.groupBy(*keys).agg(F.max("n").alias("peak"), (F.count("*") * width_ns).alias("duration_ns"))
    mid = percentiles(buckets, keys, "n", (0.5,), width=16)
    return sums.join(mid, keys).select(*keys, "peak", F.col("p50").alias("median"), "duration_ns")


def scale_rate(df: DataFrame, factor: float) -> DataFrame:
    """Fewer rows by a hash of the id, or copies of them with ids of their own."""
    whole, part = int(factor), factor - int(factor)
    draw = F.conv(F.substring(F.md5(F.col("id").cast("binary")), 1, 8), 16, 10).cast("long") < int(part * (1 << 32))
    times = F.lit(whole) + draw.cast("int")
    made = df.withColumn("_copy", F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>"))))
    return made.withColumn("id", F.when(F.col("_copy") == 1, F.col("id")).otherwise(F.concat("id", F.lit("~"), F.col("_copy").cast("string")))).drop("_copy")


def scale_rate_by_bucket(df: DataFrame, factor: float, width_ns: int, keys: list[str] = ("capture_id",), cells: int = 4096) -> DataFrame:
    """As scale_rate, but the part below one is met in each bucket of time, to one row: those with the smallest hashes of their ids.

    Hashes are counted in cells first; only the cell that holds a bucket's last row is ordered, by hash, then id.
    """
    keys, whole, part = [*keys, "_bucket"], int(factor), factor - int(factor)
    h = F.conv(F.substring(F.md5(F.col("id").cast("binary")), 1, 8), 16, 10).cast("long")
    rows = df.withColumns({"_bucket": F.floor(F.col("offset_ns") / width_ns).cast("long"), "_hash": h}).withColumn("_cell", F.expr(f"_hash div {(1 << 32) // cells}"))
    counts = rows.groupBy(*keys, "_cell").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys)
    counts = counts.withColumn("_before", F.sum("_n").over(w.orderBy("_cell")) - F.col("_n")).withColumn("_most", F.floor(F.sum("_n").over(w) * part + 0.5))
    rows = blocked.with_values(rows, counts, [*keys, "_cell"])
    last = (F.col("_before") < F.col("_most")) & (F.col("_before") + F.col("_n") > F.col("_most"))
    inside = F.col("_before") + F.col("_n") <= F.col("_most")
    edge = rows.where(last).withColumn("_place", F.row_number().over(Window.partitionBy(*keys, "_cell").orderBy("_hash", "id"))).withColumn("_more", (F.col("_before") + F.col("_place") <= F.col("_most")).cast("int")).drop("_place")
    rows = rows.where(~last).withColumn("_more", inside.cast("int")).unionByName(edge)
    made = rows.withColumn("_copy", F.explode(F.expr(f"filter(sequence(1, {whole + 1}), i -> i <= {whole} + _more)")))
    return made.withColumn("id", F.when(F.col("_copy") == 1, F.col("id")).otherwise(F.concat("id", F.lit("~"), F.col("_copy").cast("string")))).select(*df.columns)


def agents(buckets: DataFrame, per_agent: float, headroom: float, ahead: int, keys: list[str] = ("capture_id",)) -> DataFrame:
    """Agents that each bucket needs, and the most that the next `ahead` buckets do."""
    need = F.ceil(F.col("n") / per_agent * headroom).cast("long")
    w = Window.partitionBy(*keys).orderBy("bucket").rangeBetween(0, ahead)
    return buckets.withColumn("agents", need).withColumn("ahead", F.max("agents").over(w))


def leases(buckets: DataFrame, per_lease: int, keys: list[str] = ("capture_id",)) -> DataFrame:
    """Runs of buckets, about per_lease records each, with expected counts; together they are all records."""
    keys = list(keys)
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("bucket")) - F.col("n")
    return buckets.withColumn("lease", F.floor(upto / per_lease).cast("long")).groupBy(*keys, "lease").agg(F.min("bucket").alias("first_bucket"), F.max("bucket").alias("last_bucket"), F.sum("n").alias("expected"))


def bucket_accuracy(expected: DataFrame, actual: DataFrame, tolerance: float, keys: list[str]) -> DataFrame:
    both = expected.withColumnRenamed("n", "expected").join(actual.withColumnRenamed("n", "actual"), keys, "full").fillna(0, ["expected", "actual"])
    off = F.abs(F.col("actual") - F.col("expected")) / F.greatest("expected", F.lit(1))
    return both.select(*keys, "expected", "actual", (off <= tolerance).alias("within_tolerance"))


def bad_runs(buckets: DataFrame, bad: F.Column, least: int, keys: list[str]) -> DataFrame:
    """Islands of at least `least` consecutive bad buckets; found by blocks of buckets, so that a capture isn't one task's."""
    return blocked.runs(buckets, keys, "bucket", bad).where(F.col("n") >= least).withColumnRenamed("first", "first_bucket")


def bucket_metrics(sent: DataFrame, width_ns: int, keys: list[str], width: int = 1_000_000) -> DataFrame:
    """n, shares of failures and of 5xx, and p99 of the lag of every bucket, of sends with planned_ns, lag_ns, error and status_code."""
    rows = sent.withColumn("bucket", F.floor(F.col("planned_ns") / width_ns).cast("long"))
    rows = counted_values(rows, [*keys, "bucket"], "lag_ns", failed=F.count_if(F.col("error").isNotNull()), server_errors=F.count_if(F.col("status_code").between(500, 599)))
    sums = rows.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"), *((F.sum(c) / F.sum("n")).alias(c) for c in ("failed", "server_errors")))
    lag = percentiles(rows, [*keys, "bucket"], "lag_ns", (0.99,), width, "n").withColumnRenamed("p99", "p99_lag_ns")
    return blocked.with_values(sums, lag, [*keys, "bucket"])


def bucket_success(expected: DataFrame, metrics: DataFrame, tolerance: float, allowed_lag_ns: int, keys: list[str]) -> DataFrame:
    """Whether each planned bucket was met: its count to a share of tolerance, and its p99 lag. A bucket of which nothing was sent has no lag."""
    both = blocked.with_values(expected.select(*keys, "bucket", F.col("n").alias("expected")), metrics.select(*keys, "bucket", "n", "p99_lag_ns"), [*keys, "bucket"])
    sent = F.coalesce("n", F.lit(0))
    counted = F.abs(sent - F.col("expected")) / F.greatest("expected", F.lit(1)) <= tolerance
    lag = F.coalesce(F.col("p99_lag_ns") <= allowed_lag_ns, F.lit(True))
    return both.select(*keys, "bucket", "expected", sent.alias("actual"), "p99_lag_ns", counted.alias("count_met"), lag.alias("lag_met"))


#: When a replay is stopped, unless told otherwise (fixed values): shares, nanoseconds, consecutive buckets, seconds.
FAILURES, LAG_NS, BUCKETS, SILENCE_S = 0.05, 5 * SECOND, 3, 30


def abort_reasons(metrics: DataFrame, keys: list[str], server_errors: float | None = None, failures: float = FAILURES, lag_ns: int = LAG_NS, buckets: int = BUCKETS) -> DataFrame:
    """keys, rule, first_bucket and n of each stretch of `buckets` or more consecutive buckets that break a rule: failed sends, p99 lag, and, where a share is given, any bucket of 5xx over it."""
    rules = [("failures", F.col("failed") > failures, buckets), ("lag", F.col("p99_lag_ns") > lag_ns, buckets)]
    if server_errors is not None:
        rules.append(("server errors", F.col("server_errors") > server_errors, 1))
    broken = F.filter(F.array(*[F.when(bad, name) for name, bad, _ in rules]), lambda x: x.isNotNull())
    rows = metrics.select(*keys, "bucket", F.explode(broken).alias("rule"))
    least = reduce(lambda c, x: c.when(F.col("rule") == x[0], x[2]), rules[1:], F.when(F.col("rule") == rules[0][0], rules[0][2]))
    return blocked.runs(rows, [*keys, "rule"], "bucket", F.lit(True)).where(F.col("n") >= least).withColumnRenamed("first", "first_bucket")


def silent_leases(heartbeats: DataFrame, asof: F.Column, keys: list[str], seconds: int = SILENCE_S, block_s: int = 3600) -> DataFrame:
    """keys, from and silent_s of every time without a heartbeat (ts) for more than `seconds`, the one up to asof too."""
    us = heartbeats.select(*keys, F.unix_micros("ts").alias("us"))
    gaps = blocked.previous(us, keys, "us", "us", block_s * 1_000_000, name="_from").select(*keys, F.col("_from").alias("from_us"), F.col("us").alias("to_us"))
    last = us.groupBy(*keys).agg(F.max("us").alias("from_us")).withColumn("to_us", F.unix_micros(asof))
    over = (F.col("to_us") - F.col("from_us")) / 1e6
    return gaps.unionByName(last).where(over > seconds).select(*keys, "from_us", over.alias("silent_s"))


def sequence_gaps(objects: DataFrame, keys: list[str]) -> DataFrame:
    """Numbers missing between the objects of a producer."""
    before = F.lag("seq").over(Window.partitionBy(*keys).orderBy("seq"))
    gaps = objects.select(*keys, "seq").distinct().withColumn("_before", before).where(F.col("seq") > F.col("_before") + 1)
    return gaps.select(*keys, (F.col("_before") + 1).alias("first_missing"), (F.col("seq") - 1).alias("last_missing"))


def dataset_faults(df: DataFrame, target_host: str | None = None) -> DataFrame:
    """One row for each fault of each record: missing fields, protocols, destructive methods, credentials, the original host."""
    from ..functions.exprs import CREDENTIAL_HEADERS

    faults = [
        ("missing id", F.col("id").isNull() | (F.trim("id") == "")),
        ("missing path", F.col("path").isNull() | ~F.col("path").startswith("/")),
        ("unknown protocol", ~F.col("protocol").isin("HTTP/1.0", "HTTP/1.1", "HTTP/2.0", "HTTP", "gRPC")),
        ("destructive method", F.upper("method").isin("DELETE", "PUT", "PATCH")),
        ("credential header", F.coalesce(F.exists(F.map_entries("headers"), lambda e: F.lower(e["key"]).isin(*CREDENTIAL_HEADERS) & ~F.array_contains(e["value"], "[REDACTED]")), F.lit(False))),
    ]
    if target_host:
        faults.append(("original host", F.lower(F.col("authority")) == target_host.lower()))
    found = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), name) for name, c in faults]), lambda x: x.isNotNull())
    return df.select("id", F.explode(found).alias("fault"))


def size_report(index: DataFrame, rates: DataFrame, window_s: float, agents: int, least_bytes: int = 64 << 20, keys: list[str] = ("capture_id",)) -> DataFrame:
    """Objects, bytes, compression ratio and the memory that an agent needs to read ahead: window times its part of the peak rate (`peak` in rates, a second) times the average record."""
    sums = index.groupBy(*keys).agg(F.count("*").alias("objects"), F.sum("n").alias("records"), F.sum("bytes").alias("bytes"), F.sum("compressed_bytes").alias("compressed_bytes"))
    both = sums.join(rates.select(*keys, "peak"), list(keys), "left")
    ahead = F.ceil(window_s * F.col("peak") / agents * F.col("bytes") / F.col("records")).cast("long")
    return both.select(*keys, "objects", "records", "bytes", "compressed_bytes", (F.col("bytes") / F.col("compressed_bytes")).alias("ratio"), F.greatest(ahead, F.lit(least_bytes)).alias("prefetch_bytes"))


def bound_faults(totals: DataFrame, most_requests: int | None = None, most_ns: int | None = None, most_bytes: int | None = None) -> DataFrame:
    """Runs (n, duration_ns, bytes and their keys) that are over a bound that is set."""
    checks = [("too many requests", F.col("n") > most_requests if most_requests else F.lit(False)), ("too long", F.col("duration_ns") > most_ns if most_ns else F.lit(False)), ("too many bytes", F.col("bytes") > most_bytes if most_bytes else F.lit(False))]
    faults = F.filter(F.array(*[F.when(c, name) for name, c in checks]), lambda x: x.isNotNull())
    return totals.select(*[c for c in totals.columns if c not in ("n", "duration_ns", "bytes")], F.explode(faults).alias("fault"))


def retained_bytes(df: DataFrame, keys: list[str], selected: F.Column, control: int = 1024) -> DataFrame:
    """Bytes kept if whole connections are kept, or only the selected exchanges and a control record of each."""
    whole, kept = F.sum(F.col("bytes") + control), F.sum(F.when(selected, F.col("bytes")).otherwise(0) + control)
    return df.groupBy(*keys).agg(whole.alias("whole_bytes"), kept.alias("selected_bytes"), F.round(100 - 100 * kept / whole, 4).alias("saved_percent"))


def time_sorted(df: DataFrame, parts: int, column: str = "timestamp") -> DataFrame:
    """Rows of all objects in one order of time: ranges of time, sorted within, each a task."""
    return df.repartitionByRange(parts, column, "id").sortWithinPartitions(column, "id")


def write_time_sorted(df: DataFrame, path: str, parts: int, column: str = "timestamp") -> None:
    """Rows in one order of time as Parquet, a file for each range, with part and its rows' places in it."""
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    time_sorted(df, parts, column).select("*", F.spark_partition_id().alias("part"), within.alias("within")).write.parquet(path)


def read_time_sorted(spark: SparkSession, path: str) -> DataFrame:
    """The written rows with their place in the whole order; the parts before are counted, a row for each."""
    df = spark.read.parquet(path)
    counts = df.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select(F.col("part").alias("_part"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return df.join(before, df.part == before["_part"]).select(*[c for c in df.columns if c not in ("part", "within")], (F.col("_before") + F.col("within")).alias("place"))


def bucket_health(df: DataFrame, keys: list[str], width: int = 1_000_000) -> DataFrame:
    """Share of errors and lag percentiles of each group of results with a lag_ns."""
    df = counted_values(df, keys, "lag_ns", failed=F.count_if(F.col("error").isNotNull()))
    sums = df.groupBy(*keys).agg(F.sum("n").alias("n"), (F.sum("failed") * 100.0 / F.sum("n")).alias("error_percent"))
    lag = percentiles(df, keys, "lag_ns", width=width, weight="n")
    same = F.lit(True)
    renamed = lag.select(*[F.col(k).alias(f"_{k}") for k in keys], "p50", "p95", "p99")
    for k in keys:
        same = same & sums[k].eqNullSafe(renamed[f"_{k}"])
    return sums.join(renamed, same, "left").select(*keys, "n", "error_percent", "p50", "p95", "p99")


def index_faults(df: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """Bundles whose records don't add up to their index: counts, bytes, offsets, or the order-free check."""
    keys = [*keys, "span", "bundle"]
    now = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.sum("bytes").alias("_bytes"), F.min("offset_ns").alias("_first"), F.max("offset_ns").alias("_last"), F.expr("bit_xor(xxhash64(id))").alias("_check"))
    both = index.join(now, keys, "full")
    pairs = (("count", "n", "_n"), ("bytes", "bytes", "_bytes"), ("first offset", "first_ns", "_first"), ("last offset", "last_ns", "_last"), ("check", "check", "_check"))
    faults = F.filter(F.array(*[F.when(~F.col(a).eqNullSafe(F.col(b)), name) for name, a, b in pairs]), lambda x: x.isNotNull())
    return both.select(*keys, F.explode(faults).alias("fault"))
