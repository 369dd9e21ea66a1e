"""Queries over replay results: latency, errors, rollups of reports, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import select as S
from ..operators import summary as A
from ..sources.adapters import CAPTURED, RESULTS, captured, results, table
from .registry import query
from .request_queries import END, RANGE, START

LOWER = "list_sort(list({0}))[cast(floor((count(*) - 1) * {1}::double) as int) + 1]"
P = ", ".join(f"{LOWER.format('duration_ns', p)} {A.label(p)}" for p in A.PERCENTILES)
CATEGORY = "case when error is null then '' when contains(error, 'canceled') then 'canceled' when contains(error, 'deadline exceeded') then 'deadline_exceeded' when contains(lower(error), 'timeout') then 'timeout' when error = 'EOF' then 'connection_closed' else 'unknown' end"
TOTALS = f"count(*) total, count(*) filter (where error is null) success, count(error) errors, (max(ts_us) - min(ts_us)) * 1000 duration_ns, (sum(duration_ns) // count(*))::bigint mean_ns, sum(response_bytes)::bigint bytes, {P}"


@query(f"select method, count(*) total, count(error) errors, count(error) * 100.0 / count(*) error_percent, {P} from captured join results on id = request_id where starts_with(path, '/api/v1') and {RANGE} group by method", CAPTURED, RESULTS.replace("epoch_us(ts) + round(value * 1e6)::bigint // 1000 ts_us", "0 r_us"))
def flagship_latency_by_method(spark, sf_dir) -> DataFrame:
    """Error rate and latency percentiles by method of the requests under a path in a time range."""
    chosen = captured(spark, sf_dir).where(S.path_prefix("/api/v1") & S.by_day(START, END) & S.in_time(START, END)).select("id", "method")
    joined = chosen.join(results(spark, sf_dir).withColumnRenamed("request_id", "id"), "id").select("method", "duration_ns", "error", "timestamp", "response_bytes")
    rate = (F.col("errors") * 100.0 / F.col("total")).alias("error_percent")
    return A.summarize(joined, ["method"]).select("method", "total", "errors", rate, "p50", "p95", "p99")


@query(f"select run_id, {TOTALS} from results group by run_id", RESULTS)
def run_summary(spark, sf_dir) -> DataFrame:
    return A.summarize(results(spark, sf_dir), ["run_id"])


@query(f"select {TOTALS} from results", RESULTS)
def whole_summary(spark, sf_dir) -> DataFrame:
    return A.summarize(results(spark, sf_dir))


GOOD = "list_sort(list(duration_ns) filter (where error is null))[cast(floor((count(*) filter (where error is null) - 1) * {0}::double) as int) + 1] // 1000000"


@query(
    f"""select run_id, count(*) total, count(*) filter (where error is null) sent, count(error) failed, case when max(ts_us) > min(ts_us) then (count(*) filter (where error is null)) / ((max(ts_us) - min(ts_us)) / 1e6) else 0 end achieved_rps,
    ((sum(duration_ns) filter (where error is null)) // (count(*) filter (where error is null)) // 1000000)::bigint mean_ms, {", ".join(f"{GOOD.format(p)} {A.label(p)}_ms" for p in A.PERCENTILES)} from results group by run_id""",
    RESULTS,
)
def engine_summary(spark, sf_dir) -> DataFrame:
    """All results count, latencies are those of successes alone, without a bound on samples."""
    return A.engine_summary(results(spark, sf_dir), ["run_id"])


@query("select run_id, status_code, count(*) n from results where status_code > 0 group by all", RESULTS)
def status_codes(spark, sf_dir) -> DataFrame:
    return A.distribution(results(spark, sf_dir).where("status_code > 0"), ["run_id"], F.col("status_code"), "status_code")


@query("select run_id, string_agg(status_code || '=' || n, ',' order by status_code) codes from (select run_id, status_code, count(*) n from results where status_code > 0 group by all) group by run_id", RESULTS)
def status_code_maps(spark, sf_dir) -> DataFrame:
    df = results(spark, sf_dir).where("status_code > 0")
    maps = A.as_map(A.distribution(df, ["run_id"], F.col("status_code"), "status_code"), ["run_id"], "status_code")
    text = F.array_join(F.transform(F.map_entries("status_codes"), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"].cast("string"))), ",")
    return maps.select("run_id", text.alias("codes"))


@query(f"select run_id, {CATEGORY} category, count(*) n from results group by all", RESULTS)
def error_categories(spark, sf_dir) -> DataFrame:
    return A.distribution(results(spark, sf_dir), ["run_id"], X.error_category("error"), "category")


@query("select case when status_code > 0 then (status_code // 100) || 'xx' else 'none' end status_class, count(*) n from results group by 1", RESULTS)
def status_classes(spark, sf_dir) -> DataFrame:
    return A.distribution(results(spark, sf_dir), [], X.status_class("status_code"), "status_class")


@query(
    f'select run_id, duration_ns // 1000000 "durationMs", case when duration_ns > 0 then success / (duration_ns / 1e9) else 0.0 end "achievedRPS", mean_ns // 1000000 "meanLatencyMs", p50 // 1000000 "p50LatencyMs", p95 // 1000000 "p95LatencyMs", p99 // 1000000 "p99LatencyMs" from (select run_id, {TOTALS} from results group by run_id)',
    RESULTS,
)
def run_reports(spark, sf_dir) -> DataFrame:
    report = A.run_report(A.summarize(results(spark, sf_dir), ["run_id"]))
    return report.select("run_id", "durationMs", "achievedRPS", "meanLatencyMs", "p50LatencyMs", "p95LatencyMs", "p99LatencyMs")


@query("select run_id, count(*)::double / ((max(ts_us) - min(ts_us)) / 1e6) per_second from results group by run_id", RESULTS)
def throughput(spark, sf_dir) -> DataFrame:
    seconds = (X.micros(F.max("timestamp")) - X.micros(F.min("timestamp"))) / 1e6
    return results(spark, sf_dir).groupBy("run_id").agg((F.count("*") / seconds).alias("per_second"))


@query(
    f"select run_id, success_rate, p95, p99, success_rate > 0.9 and p95 < 400000000 and p99 < 450000000 passed from (select run_id, (count(*) filter (where status_code between 200 and 499))::double / count(*) success_rate, {LOWER.format('duration_ns', 0.95)} p95, {LOWER.format('duration_ns', 0.99)} p99 from results group by run_id)",
    RESULTS,
)
def run_gates(spark, sf_dir) -> DataFrame:
    return A.gates(results(spark, sf_dir), ["run_id"], 0.9, 400, 450)


@query(
    f"select path, method, count(*) total, count(error) errors, {P} from (select '/' || split_part(path, '/', 2) || '/' || split_part(path, '/', 3) as path, method, duration_ns, error from captured join results on id = request_id) group by all",
    CAPTURED, RESULTS,
)
def route_breakdown(spark, sf_dir) -> DataFrame:
    """Captured requests joined to their results, by the first two parts of the path."""
    c = captured(spark, sf_dir).select(F.col("id").alias("request_id"), F.substring_index("path", "/", 3).alias("path"), "method")
    return A.summarize(c.join(results(spark, sf_dir), "request_id"), ["path", "method"]).select("path", "method", "total", "errors", "p50", "p95", "p99")


EVENTS = """runs as (select 'run-' || user_id % 50 run_id, event_id seq, case when event_type = 'signup' then 'progress' when event_type = 'purchase' and user_id % 50 < 10 and event_id % 20 = 0 then 'summary' else 'result' end kind,
    case when event_type = 'error' then 'x' end error, event_id * 2 sent, event_id // 10 failed from events)"""


@query(
    """, last as (select run_id, max(seq) filter (where kind = 'progress') p, max(seq) filter (where kind = 'summary') s from runs group by 1),
    live as (select run_id, any_value(p) p, any_value(s) s, count(*) filter (where kind = 'result' and seq > coalesce(p, -1) and error is null) ok, count(*) filter (where kind = 'result' and seq > coalesce(p, -1) and error is not null) bad from runs join last using (run_id) group by 1)
    select run_id, coalesce(s * 2, coalesce(p * 2, 0) + ok) sent, coalesce(s // 10, coalesce(p // 10, 0) + bad) failed, s is not null complete from live""",
    EVENTS,
)
def folded_events(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    final = (F.col("event_type") == "purchase") & (F.col("user_id") % 50 < 10) & (F.col("event_id") % 20 == 0)
    kind = F.when(F.col("event_type") == "signup", "progress").when(final, "summary").otherwise("result")
    runs = e.select(F.concat(F.lit("run-"), (F.col("user_id") % 50).cast("string")).alias("run_id"), F.col("event_id").alias("seq"), kind.alias("kind"), F.when(F.col("event_type") == "error", "x").alias("error"), (F.col("event_id") * 2).alias("sent"), F.expr("event_id div 10").alias("failed"))
    return A.fold_events(runs)


REPORTS = """calls as (select user_id % 20 run, event_type as method, count(*) n, count(*) filter (where value > 400) failed, count(*)::double / 60 rps, (sum(round(value * 1e6)::bigint) // count(*)) // 1000000 mean_ms,
    max(round(value * 0.5 * 1e6)::bigint) // 1000000 p50_ms, max(round(value * 0.9 * 1e6)::bigint) // 1000000 p95_ms, max(round(value * 1e6)::bigint) // 1000000 p99_ms from events group by all)"""


@query("select run, sum(n)::bigint total, sum(failed)::bigint failed, (sum(n) - sum(failed))::bigint sent, sum(rps) rps, max(p50_ms) p50_ms, max(p95_ms) p95_ms, max(p99_ms) p99_ms, (sum(mean_ms * n) // sum(n))::bigint mean_ms from calls group by run", REPORTS)
def call_reports_rollup(spark, sf_dir) -> DataFrame:
    """Call reports of many methods, read from their nested form and rolled up."""
    ns = lambda f: F.max(F.round(F.col("value") * f * 1e6).cast("long")).cast("double")
    at = lambda p, f: F.struct(F.lit(p).alias("percentage"), ns(f).alias("latency"))
    nested = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 20).alias("run"), F.col("event_type").alias("method")).agg(
        F.count("*").alias("count"), F.expr("sum(cast(round(value * 1e6) as bigint)) div count(*)").cast("double").alias("average"), (F.count("*") / 60.0).alias("rps"),
        F.array(at(50, 0.5), at(95, 0.9), at(99, 1.0)).alias("latencyDistribution"), F.create_map(F.lit("slow"), F.count_if(F.col("value") > 400)).alias("errorDistribution"),
    )
    return A.methods_rollup(A.call_summary(nested).withColumn("mean_ms", F.floor("mean_ms")), ["run"])


@query("select run, n total, greatest(n - failed, 0) sent, failed, n / 60.0 rps, mean::bigint mean_ms, mean::bigint p50_ms, top::bigint p95_ms, top::bigint p99_ms from (select user_id % 20 run, count(*) n, count(*) filter (where event_type = 'error') failed, floor(avg(value)) mean, floor(max(value)) top from events group by 1)")
def script_exports(spark, sf_dir) -> DataFrame:
    """Summary exports as run summaries."""
    d = lambda c: c.cast("double")
    mean, top = F.floor(F.avg("value")), F.floor(F.max("value"))
    requests = F.create_map(F.lit("count"), d(F.count("*")), F.lit("rate"), F.count("*") / 60.0)
    times = F.create_map(F.lit("avg"), d(mean), F.lit("med"), d(mean), F.lit("p(95)"), d(top), F.lit("p(99)"), d(top))
    failed = F.create_map(F.lit("passes"), d(F.count_if(F.col("event_type") == "error")))
    exports = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 20).alias("run")).agg(F.create_map(F.lit("http_reqs"), requests, F.lit("http_req_duration"), times, F.lit("http_req_failed"), failed).alias("metrics"))
    return A.script_summary(exports)


GO = "case when {0} = 0 then null when {0} < 1000 then {0} || 'ms' else regexp_replace(printf('%.3f', {0} / 1000.0), '\\.?0+$', '') || 's' end"


@query(
    f"select run_id, total + (total // 10) total, success sent, errors failed, total // 10 filtered, case when duration_ns > 0 then printf('%.1f', round(success / (duration_ns / 1e9) * 1000, 1)) end rps, {', '.join(GO.format(f'({p} // 1000000)') + ' ' + p for p in ('p50', 'p95', 'p99'))} from (select run_id, {TOTALS} from results group by run_id)",
    RESULTS,
)
def reported_statuses(spark, sf_dir) -> DataFrame:
    """Run reports as replay statuses."""
    r = A.run_report(A.summarize(results(spark, sf_dir), ["run_id"]))
    names = {"totalRequests": F.col("total"), "sentRequests": F.col("success"), "failedRequests": F.col("errors"), "filteredRequests": F.expr("total div 10")}
    report = r.select("run_id", *[c.alias(n) for n, c in names.items()], "durationMs", (F.col("achievedRPS") * 1000).alias("achievedRPS"), "meanLatencyMs", "p50LatencyMs", "p95LatencyMs", "p99LatencyMs")
    return A.apply_report(report)


@query("select run_id, (max(duration_ns) - min(duration_ns))::bigint spread_ns, count(*) n from results group by 1", RESULTS)
def handled_results(spark, sf_dir) -> DataFrame:
    """A user's own summary of each run."""
    import pandas as pd

    def part(rows: pd.DataFrame) -> pd.DataFrame:
        d = rows["duration_ns"]
        return pd.DataFrame({"run_id": [rows["run_id"].iloc[0]], "least": [d.min()], "most": [d.max()], "n": [len(rows)]})

    def whole(parts: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"run_id": [parts["run_id"].iloc[0]], "spread_ns": [parts["most"].max() - parts["least"].min()], "n": [parts["n"].sum()]})

    return A.handled(results(spark, sf_dir).select("run_id", "duration_ns"), ["run_id"], part, "run_id string, least long, most long, n long", whole, "run_id string, spread_ns long, n long")


@query("select run_id, count(*) filter (where error is null) sent, count(error) errored, 0::bigint filtered, sum(response_bytes)::bigint bytes, arg_max(request_id, seq) last_request_id, (max(ts_us) - min(ts_us)) * 1000 elapsed_ns from results group by 1", RESULTS)
def progress_table(spark, sf_dir) -> DataFrame:
    from ..operators.fleet import progress

    return progress(results(spark, sf_dir), ["run_id"])
