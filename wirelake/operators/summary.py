"""Summaries of results: exact lower-rank percentiles, distributions, rollups of reports, gates."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..schemas import REPORT
from ..sources.shared import checkpoint

PERCENTILES = (0.5, 0.95, 0.99)
schemas_of_report = [c.split()[0] for c in REPORT.split(", ")]


def label(p: float) -> str:
    return f"p{p * 100:g}".replace(".", "_")


def counted_values(df: DataFrame, keys: list[str], value: str, **others: Column) -> DataFrame:
    """A row for each value of each group: n, its rows, and other aggregates of them; computed once and kept.

    Totals and percentiles of a group all follow from it, so that what df is made of, a join for instance, is planned once.
    """
    return checkpoint(df.groupBy(*keys, value).agg(F.count("*").alias("n"), *(c.alias(x) for x, c in others.items())))


def percentiles(df: DataFrame, keys: list[str], value: str, ps: tuple[float, ...] = PERCENTILES, width: int = 1_000_000, weight: str | None = None) -> DataFrame:
    """keys and, for each p, the value at place floor((n - 1) * p) of the sorted values (the lower rank, not interpolated).

    Values are counted in buckets of `width` first; only the buckets that hold a wanted place are then counted by
    value. No group is ever sorted in one task: a bucket table has at most range / width rows a key. A weight says how many rows a row stands for.
    """
    df = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("v"), F.floor(F.col(value) / width).alias("b"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("w"))
    hist = df.groupBy(*keys, "b").agg(F.sum("w").alias("n"))
    in_order = Window.partitionBy(*keys).orderBy("b")
    hist = hist.select(*keys, "b", "n", F.sum("n").over(in_order).alias("upto"), F.sum("n").over(Window.partitionBy(*keys)).alias("total"))
    place = F.floor((F.col("total") - 1).cast("double") * F.col("p")).cast("long")
    wanted = hist.withColumn("p", F.explode(F.array(*map(F.lit, ps)))).withColumn("place", place - (F.col("upto") - F.col("n")))
    wanted = wanted.where("place >= 0 and place < n").select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("b").alias("_b"), "p", "place")
    same = df.b == wanted["_b"]
    for k in keys:
        same = same & df[k].eqNullSafe(wanted[f"_{k}"])
    values = df.join(wanted, same).groupBy(*keys, "p", "place", "v").agg(F.sum("w").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*keys, "p").orderBy("v"))
    found = values.withColumn("upto", upto).where("upto > place").groupBy(*keys, "p").agg(F.min("v").alias("v"))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("p") == p, F.col("v"))).alias(label(p)) for p in ps])


def summarize(results: DataFrame, keys: list[str] = (), ps: tuple[float, ...] = PERCENTILES) -> DataFrame:
    """Totals, mean and percentiles of each group. A result without an error is a success, whatever its status."""
    keys = list(keys)
    ok = F.col("error").isNull()
    results = counted_values(results, keys, "duration_ns", ok=F.count_if(ok), first=F.min("timestamp"), last=F.max("timestamp"), bytes=F.sum("response_bytes"))
    span = (X.micros(F.max("last")) - X.micros(F.min("first"))) * 1000
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    totals = results.groupBy(*keys).agg(
        zero(F.sum("n")).alias("total"), zero(F.sum("ok")).alias("success"), zero(F.sum(F.col("n") - F.col("ok"))).alias("errors"), zero(span).alias("duration_ns"),
        zero(F.expr("sum(duration_ns * n) div sum(n) filter (where duration_ns is not null)")).alias("mean_ns"), zero(F.sum("bytes")).alias("bytes"),
    )
    # Without keys, one row each is joined.
    tag = keys or ["_all"]
    at = percentiles(results if keys else results.withColumn("_all", F.lit(1)), tag, "duration_ns", ps, weight="n")
    at = at.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(tag)], *[label(p) for p in ps])
    totals = totals if keys else totals.withColumn("_all", F.lit(1))
    same = F.lit(True)
    for i, k in enumerate(tag):
        same = same & totals[k].eqNullSafe(at[f"_k{i}"])
    out = totals.join(at, same, "left")
    return out.select(*keys, "total", "success", "errors", "duration_ns", "mean_ns", "bytes", *[F.coalesce(label(p), F.lit(0)).alias(label(p)) for p in ps])


def distribution(results: DataFrame, keys: list[str], what: Column, name: str) -> DataFrame:
    return results.groupBy(*keys, what.alias(name)).agg(F.count("*").alias("n"))


def as_map(counted: DataFrame, keys: list[str], name: str) -> DataFrame:
    """One map of name to count for each group; for names of few values, such as status codes."""
    return counted.where(F.col(name).isNotNull()).groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, "n")))).alias(f"{name}s"))


def run_report(summary: DataFrame, sent: str = "success") -> DataFrame:
    """Milliseconds are cut, not rounded; a rate needs a duration."""
    ms = lambda c: F.expr(f"{c} div 1000000").cast("long")
    rate = F.when(F.col("duration_ns") > 0, F.col(sent) / (F.col("duration_ns") / 1e9)).otherwise(0.0)
    return summary.select("*", ms("duration_ns").alias("durationMs"), rate.alias("achievedRPS"), ms("mean_ns").alias("meanLatencyMs"), *[ms(label(p)).alias(f"{label(p)}LatencyMs") for p in PERCENTILES])


def apply_report(reports: DataFrame) -> DataFrame:
    """A report as a replay's status: all rows count to the total, a rate is text of one decimal if there is one, latencies are durations."""
    text = lambda c: F.when(F.col(c) > 0, X.latency_text(c))
    rest = [c for c in reports.columns if c not in schemas_of_report]
    return reports.select(
        *rest, (F.col("totalRequests") + F.col("filteredRequests")).alias("total"), F.col("sentRequests").alias("sent"), F.col("failedRequests").alias("failed"), F.col("filteredRequests").alias("filtered"),
        F.when(F.col("achievedRPS") > 0, F.format_string("%.1f", "achievedRPS")).alias("rps"), text("p50LatencyMs").alias("p50"), text("p95LatencyMs").alias("p95"), text("p99LatencyMs").alias("p99"),
    )


def engine_summary(results: DataFrame, keys: list[str]) -> DataFrame:
    """Totals over all results, rate of the successes over the time they all took, latencies of successes alone, in cut milliseconds."""
    ok = F.col("error").isNull()
    results = counted_values(results.withColumn("_ok", ok), [*keys, "_ok"], "duration_ns", first=F.min("timestamp"), last=F.max("timestamp"))
    ok, sent = F.col("_ok"), F.coalesce(F.sum(F.when(F.col("_ok"), F.col("n"))), F.lit(0))
    seconds = (X.micros(F.max("last")) - X.micros(F.min("first"))) / 1e6
    ms = lambda c: F.coalesce(F.expr(f"{c} div 1000000"), F.lit(0)).cast("long")
    totals = results.groupBy(*keys).agg(
        F.sum("n").alias("total"), sent.alias("sent"), (F.sum("n") - sent).alias("failed"), F.when(seconds > 0, sent / seconds).otherwise(0.0).alias("achieved_rps"),
        F.expr("sum(duration_ns * n) filter (where _ok) div sum(n) filter (where _ok and duration_ns is not null)").alias("mean_ns"),
    )
    at = percentiles(results.where(ok), keys, "duration_ns", weight="n").withColumnsRenamed({k: f"_{k}" for k in keys})
    same = reduce(lambda x, k: x & totals[k].eqNullSafe(at[f"_{k}"]), keys, F.lit(True))
    return totals.join(at, same, "left").select(*keys, "total", "sent", "failed", "achieved_rps", ms("mean_ns").alias("mean_ms"), *[ms(label(p)).alias(f"{label(p)}_ms") for p in PERCENTILES])


def handled(results: DataFrame, keys: list[str], partial, middle: str, merge, schema: str) -> DataFrame:
    """A user's own summary: partial turns a group's rows of one batch (a pandas frame) into rows of `middle`, merge a group's partial rows into rows of schema.

    So a group of any size is reduced where its rows are, and only partial rows, a few a batch, meet.
    """

    def reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, rows in batch.groupby(keys, dropna=False):
                yield partial(rows)

    return results.mapInPandas(reduced, middle).groupBy(*keys).applyInPandas(merge, schema)


def method_mix(captured: DataFrame) -> DataFrame:
    """gRPC methods: calls and the first body in object and line order."""
    m = captured.withColumn("call", F.regexp_replace("path", "^/", ""))
    return m.groupBy("call").agg(F.count("*").alias("n"), F.min_by("body", F.struct("object_key", "line")).alias("first_body"))


def methods_rollup(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Many methods' reports as one: counts and rates add up, percentiles are the largest, means are weighted."""
    return parts.groupBy(*keys).agg(
        F.sum("n").alias("total"), F.sum("failed").alias("failed"), (F.sum("n") - F.sum("failed")).alias("sent"), F.sum("rps").alias("rps"),
        F.max("p50_ms").alias("p50_ms"), F.max("p95_ms").alias("p95_ms"), F.max("p99_ms").alias("p99_ms"), F.expr("coalesce(try_divide(sum(mean_ms * n), sum(n)), 0)").cast("long").alias("mean_ms"),
    )


def script_summary(exports: DataFrame) -> DataFrame:
    """Summary exports (a map of metrics to maps of values) as run summaries."""
    v = lambda metric, name: F.coalesce(F.try_element_at(F.try_element_at("metrics", F.lit(metric)), F.lit(name)), F.lit(0.0))
    count, failed = v("http_reqs", "count").cast("long"), v("http_req_failed", "passes").cast("long")
    ms = lambda name: v("http_req_duration", name).cast("long")
    return exports.select(*[c for c in exports.columns if c != "metrics"], count.alias("total"), F.when(count >= failed, count - failed).otherwise(0).alias("sent"), failed.alias("failed"), v("http_reqs", "rate").alias("rps"), ms("avg").alias("mean_ms"), ms("med").alias("p50_ms"), ms("p(95)").alias("p95_ms"), ms("p(99)").alias("p99_ms"))


def call_summary(reports: DataFrame) -> DataFrame:
    """Call reports (count, average, latencyDistribution, errorDistribution) as run summaries."""
    at = lambda p: F.coalesce(F.expr(f"get(filter(latencyDistribution, x -> x.percentage = {p}), 0).latency / 1000000"), F.lit(0.0)).cast("long")
    failed = F.coalesce(F.aggregate(F.map_values("errorDistribution"), F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)).cast("long")
    rest = [c for c in reports.columns if c not in ("count", "average", "rps", "latencyDistribution", "errorDistribution")]
    return reports.select(*rest, F.col("count").alias("n"), failed.alias("failed"), "rps", (F.col("average") / 1000000).cast("long").alias("mean_ms"), at(50).alias("p50_ms"), at(95).alias("p95_ms"), at(99).alias("p99_ms"))


def fold_events(events: DataFrame) -> DataFrame:
    """Event streams of runs: the final summary counts; until then results add up on the last progress event."""
    last = events.where("kind = 'progress'").groupBy("run_id").agg(F.max("seq").alias("at"), F.max_by("sent", "seq").alias("base_sent"), F.max_by("failed", "seq").alias("base_failed"))
    final = events.where("kind = 'summary'").groupBy("run_id").agg(F.max_by("sent", "seq").alias("final_sent"), F.max_by("failed", "seq").alias("final_failed"))
    after = events.where("kind = 'result'").join(last, "run_id", "left").where("at is null or seq > at").groupBy("run_id").agg(F.count_if(F.col("error").isNull()).alias("more_sent"), F.count_if(F.col("error").isNotNull()).alias("more_failed"))
    runs = events.select("run_id").distinct().join(last, "run_id", "left").join(after, "run_id", "left").join(final, "run_id", "left")
    live = lambda c: F.coalesce(f"base_{c}", F.lit(0)) + F.coalesce(f"more_{c}", F.lit(0))
    return runs.select("run_id", F.coalesce("final_sent", live("sent")).alias("sent"), F.coalesce("final_failed", live("failed")).alias("failed"), F.col("final_sent").isNotNull().alias("complete"))


def gates(results: DataFrame, keys: list[str], least_success: float = 0.95, p95_ms: int = 5000, p99_ms: int | None = None) -> DataFrame:
    """Success (200 to 499) above a share and latencies below bounds."""
    results = counted_values(results, keys, "duration_ns", good=F.count_if((F.col("status_code") >= 200) & (F.col("status_code") < 500)))
    rate = (F.sum("good") / F.sum("n")).alias("success_rate")
    out = results.groupBy(*keys).agg(rate).join(percentiles(results, keys, "duration_ns", (0.95, 0.99), weight="n"), keys)
    passed = (F.col("success_rate") > least_success) & (F.col("p95") < p95_ms * 1_000_000)
    if p99_ms:
        passed = passed & (F.col("p99") < p99_ms * 1_000_000)
    return out.withColumn("passed", passed)
