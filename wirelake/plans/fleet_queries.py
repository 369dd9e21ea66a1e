"""Queries over fleet state: load tests, cells, captures, heartbeats, counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import fleet as L
from ..operators import policy as D
from ..sources.adapters import CAPTURES, HEARTBEATS, SHARDS, SPOKES, captures_state, heartbeats, shard_status, spokes, table
from .registry import query

NEWEST = ("reported_at", "report_no", "sent_requests", "spoke_id", "phase", "achieved_rps", "failed_requests")
ROLLUP = """rollup_ as (select load_test_namespace, load_test_name, sum(total_requests)::bigint total, sum(sent_requests)::bigint sent, sum(failed_requests)::bigint failed, sum(filtered_requests)::bigint filtered,
    case when sum(achieved_rps) > 0 then printf('%.1f', sum(achieved_rps)) end rps, count(*) shards, count(*) filter (where phase = 'COMPLETED') completed_shards, count(*) filter (where phase = 'FAILED') failed_shards, count(*) filter (where phase = 'RUNNING') running_shards from latest group by all)"""


def latest_status(spark, sf_dir) -> DataFrame:
    return L.latest(shard_status(spark, sf_dir), ["load_test_namespace", "load_test_name", "shard_index"], *NEWEST)


def asof(df: DataFrame, column: str = "ts"):
    """The latest time of a table, for queries that need a now."""
    return df.agg(F.max(column).cast("timestamp")).scalar()


@query("select load_test_name, shard_index, phase, sent_requests, reported_us from latest", SHARDS)
def latest_shard_status(spark, sf_dir) -> DataFrame:
    return latest_status(spark, sf_dir).select("load_test_name", "shard_index", "phase", "sent_requests", X.micros("reported_at").alias("reported_us"))


@query("select * from rollup_", SHARDS, ROLLUP)
def load_test_rollup(spark, sf_dir) -> DataFrame:
    return L.load_test_rollup(latest_status(spark, sf_dir))


@query("select load_test_name, case when completed_shards = 7 then 'Completed' when completed_shards + failed_shards = 7 then 'Failed' when running_shards + completed_shards + failed_shards > 0 then 'Running' else 'Distributing' end phase from rollup_", SHARDS, ROLLUP)
def load_test_phases(spark, sf_dir) -> DataFrame:
    return L.load_test_rollup(latest_status(spark, sf_dir)).withColumn("total_shards", F.lit(7)).select("load_test_name", L.phase().alias("phase"))


@query("select load_test_name, cell, count(distinct spoke_id) spokes, sum(sent_requests)::bigint sent, sum(failed_requests)::bigint failed from latest join spokes using (spoke_id) group by all", SHARDS, SPOKES)
def load_test_cells(spark, sf_dir) -> DataFrame:
    return L.by_cell(latest_status(spark, sf_dir), spokes(spark, sf_dir))


@query(
    """, live as (select spoke_id, max(ts_us) seen from heartbeats group by 1), now as (select max(ts_us) n from heartbeats)
    select cell, count(*) spokes, count(*) filter (where n - seen <= 7200000000) connected, coalesce(sum(c), 0)::bigint captures, coalesce(sum(r), 0)::bigint active_replays from spokes cross join now left join live using (spoke_id)
    left join (select spoke_id, count(*) c from captures group by 1) using (spoke_id) left join (select spoke_id, count(*) r from latest where phase not in ('COMPLETED', 'FAILED') group by 1) using (spoke_id) group by cell order by cell""",
    SPOKES, CAPTURES, SHARDS, HEARTBEATS,
)
def fleet_cells(spark, sf_dir) -> DataFrame:
    h = heartbeats(spark, sf_dir)
    return L.cells(spokes(spark, sf_dir), L.liveness(h, asof(h), 7200), captures_state(spark, sf_dir), latest_status(spark, sf_dir))


@query(", now as (select max(ts_us) n from heartbeats) select spoke_id, max(ts_us) last_us, arg_max(active_captures, (ts_us, seq)) active_captures, any_value(n) - max(ts_us) <= 7200000000 connected from heartbeats cross join now group by spoke_id", HEARTBEATS)
def spoke_liveness(spark, sf_dir) -> DataFrame:
    h = heartbeats(spark, sf_dir)
    return L.liveness(h, asof(h), 7200).select("spoke_id", X.micros("last_heartbeat").alias("last_us"), "active_captures", "connected")


@query(
    """, now as (select max(ts_us) n from heartbeats), live as (select count(*) c from (select spoke_id from heartbeats cross join now group by spoke_id having max(n) - max(ts_us) <= 7200000000))
    select sum((phase not in ('COMPLETED', 'FAILED'))::int)::bigint active_replays, count(*) replays, sum(sent_requests)::bigint sent, (select c from live) connected_spokes, (select count(*) from captures) captures from latest""",
    SHARDS, HEARTBEATS, CAPTURES,
)
def fleet_totals(spark, sf_dir) -> DataFrame:
    """Connected spokes, captures held and replays that go on, over the whole fleet."""
    h = heartbeats(spark, sf_dir)
    connected = L.liveness(h, asof(h), 7200).agg(F.count_if("connected")).scalar()
    held = captures_state(spark, sf_dir).agg(F.count("*")).scalar()
    out = latest_status(spark, sf_dir).agg(F.count_if(~F.col("phase").isin(*L.TERMINAL)).alias("active_replays"), F.count("*").alias("replays"), F.sum("sent_requests").alias("sent"))
    return out.select("*", connected.alias("connected_spokes"), held.alias("captures"))


@query("select l_orderkey replay, 'lt-' || l_orderkey % 50 load_test_name from lineitem where l_linenumber = 1 and l_orderkey % 11 <> 0 and epoch_us((select max(l_shipdate) from lineitem)) - epoch_us(l_shipdate) >= 120000000 and l_orderkey % 50 not in (select o_orderkey % 50 from orders where o_orderstatus = 'P' and o_orderkey % 50 < 40)")
def orphan_replays(spark, sf_dir) -> DataFrame:
    """Replays whose load test isn't active any more, old enough, with a load test at all."""
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    name = lambda c: F.concat(F.lit("lt-"), (c % 50).cast("string"))
    replays = l.where("l_linenumber = 1").select(F.col("l_orderkey").alias("replay"), F.when(F.col("l_orderkey") % 11 != 0, name(F.col("l_orderkey"))).alias("load_test_name"), F.col("l_shipdate").cast("timestamp").alias("created_at"))
    active = o.where("o_orderstatus = 'P' and o_orderkey % 50 < 40").select(name(F.col("o_orderkey")).alias("load_test_name"))
    return L.orphans(replays, active, asof(l, "l_shipdate")).select("replay", "load_test_name")


@query(
    """, chosen as (select spoke_id, row_number() over (order by spoke_id) - 1 p from spokes where cell in ('ASIA', 'EUROPE')),
    assigned as (select 'lt-' || t load_test_name, unnest(range(p * 2, p * 2 + 2)) shard_index from chosen, range(50) r(t))
    select load_test_name, shard_index from assigned where (load_test_name, shard_index) not in (select (load_test_name, shard_index) from shards)""",
    SPOKES, SHARDS,
)
def unreported_shards(spark, sf_dir) -> DataFrame:
    assigned = L.assign_shards(L.eligible(spokes(spark, sf_dir), ["ASIA", "EUROPE"]), 2)
    plan = assigned.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(49)))).select("shard_indexes", F.concat(F.lit("lt-"), F.col("i").cast("string")).alias("load_test_name"))
    return L.unreported(plan, shard_status(spark, sf_dir)).select("load_test_name", F.col("shard_index").cast("long").alias("shard_index"))


@query(", c as (select spoke_id, cell, row_number() over (order by spoke_id) - 1 as position from (select * from spokes where cell <> '' order by spoke_id limit 40)) select spoke_id, cell, position, ((1000003 // 40) + (position < 1000003 % 40)::int)::bigint rate from c", SPOKES)
def shard_assignments(spark, sf_dir) -> DataFrame:
    """Spokes in order of their ids, at most 40, with their part of a rate."""
    df = L.assign_shards(spokes(spark, sf_dir).where("cell <> ''"), 1, 40)
    return df.select("spoke_id", "cell", F.col("position").cast("long").alias("position"), L.split_rate(F.lit(1000003), F.lit(40), F.col("position")).cast("long").alias("rate"))


POLICIES = "p as (select 'lt-' || i load_test_name, case when i % 3 = 0 then 100 when i % 3 = 1 then 5000 end max_s, case when i % 4 < 3 then 5 + i % 4 end pct, case when i % 5 = 0 then 1000000 end least, i * 60 elapsed from range(50) r(i))"


ABORTS = "select load_test_name, case when max_s is not null and elapsed > max_s then printf('run exceeded maxDuration %s (elapsed %s)', (case when max_s < 60 then max_s || 's' when max_s < 3600 then (max_s // 60) || 'm' || (max_s % 60) || 's' else (max_s // 3600) || 'h' || (max_s // 60 % 60) || 'm' || (max_s % 60) || 's' end), (case when elapsed < 60 then elapsed || 's' when elapsed < 3600 then (elapsed // 60) || 'm' || (elapsed % 60) || 's' else (elapsed // 3600) || 'h' || (elapsed // 60 % 60) || 'm' || (elapsed % 60) || 's' end)) when pct is not null and sent + failed >= coalesce(least, 100) and failed * 100.0 / (sent + failed) > pct then printf('error rate %.1f%% exceeded abort threshold %d%%', round(failed * 100.0 / (sent + failed), 1), pct) end reason from rollup_ join p using (load_test_name)"


def policies(tests: DataFrame) -> DataFrame:
    """Made-up policies of load tests (load_test_name): time limits, error rates, least samples, and how long each has run."""
    i = F.regexp_extract("load_test_name", r"\d+", 0).cast("long")
    policy = F.struct(F.when(i % 3 == 0, 100).when(i % 3 == 1, 5000).alias("max_duration_s"), F.when(i % 4 < 3, 5 + i % 4).alias("error_percent"), F.when(i % 5 == 0, 1_000_000).alias("min_sample_requests"))
    return tests.select("load_test_name", F.lit("Running").alias("phase"), (i * 60).alias("elapsed_s"), policy.alias("policy"))


@query(ABORTS, SHARDS, ROLLUP, POLICIES)
def abort_decisions(spark, sf_dir) -> DataFrame:
    df = L.load_test_rollup(latest_status(spark, sf_dir)).select("load_test_name", "sent", "failed")
    return df.join(policies(df), "load_test_name").select("load_test_name", L.should_abort().alias("reason"))


@query("select spoke_id, count(capture_id) n, count(*) filter (where phase = 'ACTIVE') active, coalesce(sum(captured_requests), 0)::bigint requests from spokes left join captures using (spoke_id) group by spoke_id", SPOKES, CAPTURES)
def spoke_captures(spark, sf_dir) -> DataFrame:
    return L.spoke_captures(spokes(spark, sf_dir), captures_state(spark, sf_dir))


@query("select storage, count(*) filter (where phase = 'PENDING') pending, count(*) filter (where phase = 'ACTIVE') active, count(*) filter (where phase = 'COMPLETED') completed, count(*) filter (where phase = 'FAILED') failed from captures group by storage", CAPTURES)
def capture_phases(spark, sf_dir) -> DataFrame:
    return L.phase_counts(captures_state(spark, sf_dir), ["PENDING", "ACTIVE", "COMPLETED", "FAILED"], ["storage"])


@query(
    """, now as (select max(ts_us) n from heartbeats), beats as (select spoke_id, max(n) - max(ts_us) <= 7200000000 healthy from heartbeats cross join now group by spoke_id),
    stores as (select storage, sum(bytes_written) < 100000000 ready from captures group by storage)
    select count(*) captures, count(*) filter (where phase = 'PENDING') pending, count(*) filter (where phase = 'ACTIVE') active, count(*) filter (where phase = 'COMPLETED') completed, count(*) filter (where phase = 'FAILED') failed,
    sum(captured_requests)::bigint requests, (select count(*) from beats) spokes, (select count(*) from beats where healthy) healthy_spokes, (select count(*) from stores) storages, (select count(*) from stores where ready) ready_storages from captures""",
    CAPTURES, HEARTBEATS,
)
def dashboard(spark, sf_dir) -> DataFrame:
    """Captures by phase (all four are there), requests, healthy of all spokes, ready of all storages (here: under 100 MB)."""
    c, h = captures_state(spark, sf_dir), heartbeats(spark, sf_dir)
    beats = L.liveness(h, asof(h), 7200)
    stores = c.groupBy("storage").agg((F.sum("bytes_written") < 100_000_000).alias("ready"))
    one = lambda df, what: df.agg(what).scalar()
    out = c.agg(F.count("*").alias("captures"), *[F.count_if(F.col("phase") == p).alias(p.lower()) for p in ("PENDING", "ACTIVE", "COMPLETED", "FAILED")], F.sum("captured_requests").alias("requests"))
    return out.select("*", one(beats, F.count("*")).alias("spokes"), one(beats, F.count_if("connected")).alias("healthy_spokes"), one(stores, F.count("*")).alias("storages"), one(stores, F.count_if("ready")).alias("ready_storages"))


@query("select 'capture' as kind, phase, count(*) n from captures group by 2 union all select 'replay', phase, count(*) from latest group by 2", CAPTURES, SHARDS)
def entity_phases(spark, sf_dir) -> DataFrame:
    """Captures and replays by phase."""
    kind = lambda df, name: df.groupBy(F.lit(name).alias("kind"), "phase").agg(F.count("*").alias("n"))
    return kind(captures_state(spark, sf_dir), "capture").unionByName(kind(latest_status(spark, sf_dir), "replay"))


@query(
    """, a as (select spoke_id, cell, row_number() over (order by spoke_id) - 1 p from spokes), cells_ as (select cell, count(*) spokes, count(*) * 2 shards, min(p) first from a group by 1),
    t as (select load_test_name, cell, sum(sent_requests)::bigint sent, sum(failed_requests)::bigint failed from latest join a using (spoke_id) group by all), l as (select 'lt-' || t load_test_name from range(50) r(t))
    select load_test_name, cell, spokes, shards, coalesce(sent, 0) sent, coalesce(failed, 0) failed, (row_number() over (partition by load_test_name order by first) - 1) as position from l cross join cells_ left join t using (load_test_name, cell)""",
    SHARDS, SPOKES,
)
def load_test_cells_assigned(spark, sf_dir) -> DataFrame:
    """Cells of every load test by its assignments (all spokes, two shards each), in the order in which they come first."""
    assigned = L.assign_shards(spokes(spark, sf_dir), 2).select("*", F.explode(F.sequence(F.lit(0), F.lit(49))).alias("i")).withColumn("load_test_name", F.concat(F.lit("lt-"), F.col("i").cast("string")))
    return L.assigned_cells(latest_status(spark, sf_dir), assigned)


@query("select capture_id, count(*) spokes, sum(captured_requests)::bigint requests from captures where spoke_id in (select spoke_id from spokes where cell = 'ASIA') group by capture_id", CAPTURES, SPOKES)
def captures_of_cell(spark, sf_dir) -> DataFrame:
    held = captures_state(spark, sf_dir).join(spokes(spark, sf_dir).where("cell = 'ASIA'"), "spoke_id", "left_semi")
    return held.groupBy("capture_id").agg(F.count("*").alias("spokes"), F.sum("captured_requests").alias("requests"))


@query("select load_test_name, case when sum(sent_requests) = 0 then '0.00' else printf('%.2f', round(sum(failed_requests) * 100.0 / sum(sent_requests), 2)) end error_rate from latest group by 1", SHARDS)
def load_test_error_rates(spark, sf_dir) -> DataFrame:
    sent, failed = F.sum("sent_requests"), F.sum("failed_requests")
    return latest_status(spark, sf_dir).groupBy("load_test_name").agg(F.when(sent == 0, "0.00").otherwise(F.format_string("%.2f", failed * 100.0 / sent)).alias("error_rate"))


COUNTER = "samples as (select event_type series, epoch_us(ts) // 1000000 t, event_id, (row_number() over (partition by event_type order by ts, event_id)) % 97 v from events)"


@query(
    """, s as (select *, v - lag(v) over (partition by series order by t, event_id) d from samples), e as (select *, case when d < 0 then v else coalesce(d, 0) end step from s)
    select series, t, event_id, v, (sum(step) over (partition by series order by t range between 3600 preceding and current row))::bigint increase from e""",
    COUNTER,
)
def counter_increase(spark, sf_dir) -> DataFrame:
    """Increase of counters that restart, over the last hour at each sample."""
    from pyspark.sql import Window

    w = Window.partitionBy("series").orderBy("ts", "event_id")
    samples = table(spark, sf_dir, "events").select(F.col("event_type").alias("series"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    samples = samples.withColumn("v", (F.row_number().over(w) % 97).cast("long")).withColumn("t", F.floor(X.micros("ts") / 1_000_000).cast("long"))
    return L.increase(samples.drop("ts"), ["series"], range_s=3600, ties=["event_id"]).select("series", "t", "event_id", "v", "increase")


@query("select capture_id from captures where epoch_us(timestamp '1999-01-01') - created_us > 86400000000 * 1000::bigint", CAPTURES)
def retention_by_age(spark, sf_dir) -> DataFrame:
    objects = captures_state(spark, sf_dir).select(F.col("capture_id").alias("key"), "storage", F.col("created_at").alias("modified"), F.col("bytes_written").alias("length"))
    return L.retention(objects, F.lit("1999-01-01").cast("timestamp"), 86_400 * 1000).select(F.col("key").alias("capture_id"))


@query("select capture_id, storage from (select *, sum(bytes_written) over (partition by storage order by created_us desc, capture_id) upto from captures) where upto > 50000000", CAPTURES)
def retention_by_size(spark, sf_dir) -> DataFrame:
    objects = captures_state(spark, sf_dir).select(F.col("capture_id").alias("key"), "storage", F.col("created_at").alias("modified"), F.col("bytes_written").alias("length"))
    return L.retention(objects, F.lit("2000-01-01").cast("timestamp"), None, 50_000_000).select(F.col("key").alias("capture_id"), "storage")


@query(
    """select o_custkey::varchar id, arg_max(coalesce(nullif(o_orderstatus, 'P'), 'pending'), (o_orderdate, o_orderkey)) status, epoch_us(coalesce(min(o_orderdate) filter (where o_orderkey % 2 = 0), arg_max(o_orderdate, (o_orderdate, o_orderkey)))) started_us
    from (select * from orders qualify o_orderkey % 2 = 1 or row_number() over (partition by o_custkey, o_orderkey % 2 order by o_orderdate, o_orderkey) = 1) group by 1"""
)
def catalog_upsert(spark, sf_dir) -> DataFrame:
    """A catalog of the first even order of each customer, upserted with the odd ones."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("id"), F.regexp_replace("o_orderstatus", "P", "").alias("status"), F.col("o_orderdate").cast("timestamp").alias("started_at"), F.lit(None).cast("timestamp").alias("completed_at"), F.lit("").alias("error"), F.struct("o_orderdate", "o_orderkey").alias("updated_at"), "o_orderkey")
    first = o.where("o_orderkey % 2 = 0").groupBy("id").agg(F.min_by(F.struct(*[c for c in o.columns if c != "id"]), "updated_at").alias("r")).select("id", "r.*")
    return _only_newer(first, o.where("o_orderkey % 2 = 1"))


def _only_newer(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows that the catalog has a later version of are late and left out."""
    late = new.join(old.select("id", F.col("updated_at").alias("_at")), "id", "left").where("_at is null or updated_at > _at").drop("_at")
    return L.upsert_captures(old.drop("o_orderkey"), late.drop("o_orderkey")).select("id", "status", X.micros("started_at").alias("started_us"))


@query("select capture_id, s3_key, size_bytes, storage_backend from (select 'c' || l_orderkey % 100 capture_id, l_partkey::varchar s3_key, floor(l_extendedprice)::bigint size_bytes, case when l_orderkey % 2 = 0 then 's3' else 'gcs' end storage_backend, epoch_us(l_shipdate) made from lineitem where l_partkey % 5 <> 0) qualify row_number() over (partition by capture_id, s3_key order by made desc, size_bytes desc, storage_backend desc) = 1")
def artifact_records(spark, sf_dir) -> DataFrame:
    """The newest record of each object; records without a key are refused."""
    l = table(spark, sf_dir, "lineitem")
    key = F.when(F.col("l_partkey") % 5 != 0, F.col("l_partkey").cast("string")).otherwise(" ")
    rows = l.select(F.concat(F.lit("c"), (F.col("l_orderkey") % 100).cast("string")).alias("capture_id"), F.when(F.col("l_orderkey") % 2 == 0, "").otherwise("gcs").alias("storage_backend"), F.lit("b").alias("s3_bucket"), key.alias("s3_key"), F.floor("l_extendedprice").cast("long").alias("size_bytes"), F.col("l_shipdate").cast("timestamp").alias("at"))
    rows = rows.withColumn("storage_backend", F.coalesce(F.nullif("storage_backend", F.lit("")), F.lit("s3"))).withColumn("created_at", F.struct("at", "size_bytes", "storage_backend"))
    return L.record_artifacts(rows.limit(0), rows).select("capture_id", "s3_key", "size_bytes", "storage_backend")


@query(
    """, d as (select load_test_name id, shard_index, sum(sent_requests) n from shards group by all), m as (select id, 1 + shard_index % 2 * (id = 'lt-3')::int v, shard_index, n - (id = 'lt-7')::int n from d)
    select id, shard_index, 'unsupported version' fault from m where v > 1 union all select id, shard_index, 'record count differs' from m join d using (id, shard_index) where m.n <> d.n""",
    SHARDS,
)
def manifest_faults(spark, sf_dir) -> DataFrame:
    """Manifests that are invalid or don't tell what the data has."""
    data = shard_status(spark, sf_dir).groupBy(F.col("load_test_name").alias("capture_id"), "shard_index").agg(F.sum("sent_requests").alias("n"))
    odd = (F.col("capture_id") == "lt-3").cast("int") * (F.col("shard_index") % 2)
    manifests = data.select("capture_id", "shard_index", (1 + odd).alias("format_version"), (F.col("n") - (F.col("capture_id") == "lt-7").cast("int")).alias("record_count"))
    return D.manifest_faults(manifests, data).select(F.col("capture_id").alias("id"), "shard_index", "fault")


@query("select load_test_name, 'missing' fault, count(*) n from latest group by 1", SHARDS)
def dense_shards(spark, sf_dir) -> DataFrame:
    """Load tests whose shards are not 0 to 7, each once: all, as none has an eighth."""
    status = latest_status(spark, sf_dir).select("load_test_name", "shard_index")
    return D.dense_faults(status, "load_test_name", 8)


@query(
    """with c as (select 'p' || (user_id % 30) pipeline, (user_id // 30)::int as position, arg_max(['redact', 'sample', 'enrich', 'gzip', 'unknown'][event_id % 5 + 1], event_id) plugin from events group by all),
    cf(a, b) as (values ('redact', 'enrich'), ('enrich', 'sample')), pr as (select x.pipeline, x.plugin p1, y.plugin p2 from c x join c y on x.pipeline = y.pipeline and x.position < y.position)
    select pipeline, 'unknown' kind, plugin detail from c where plugin = 'unknown' group by all
    union all select pipeline, 'conflict', least(p1, p2) || ' ' || greatest(p1, p2) from pr join cf on (p1 = a and p2 = b) or (p1 = b and p2 = a) group by all
    union all select pipeline, 'order', 'gzip before redact' from pr where p1 = 'gzip' and p2 = 'redact' group by all
    union all select pipeline, 'resource', least(p1, p2) || ' ' || greatest(p1, p2) || ' cpu' from pr where p1 <> p2 and 'gzip' in (p1, p2) and 'sample' in (p1, p2) group by all"""
)
def pipeline_faults(spark, sf_dir) -> DataFrame:
    """A table of pipelines checked against their plugins' constraints, all faults at once."""
    e = table(spark, sf_dir, "events")
    names = F.array(*map(F.lit, ("redact", "sample", "enrich", "gzip", "unknown")))
    steps = e.groupBy(F.concat(F.lit("p"), (F.col("user_id") % 30).cast("string")).alias("pipeline"), F.expr("cast(user_id div 30 as int)").alias("position")).agg(F.max_by(F.element_at(names, (F.col("event_id") % 5 + 1).cast("int")), "event_id").alias("plugin"))
    rules = spark.createDataFrame(
        [("redact", ["enrich"], ["gzip"], [], []), ("sample", [], [], [], [("cpu", "shared")]), ("enrich", ["sample"], [], [], []), ("gzip", [], [], [], [("cpu", "exclusive")])],
        "plugin string, conflicts array<string>, before array<string>, after array<string>, resources array<struct<name:string,access:string>>",
    )
    return D.pipeline_faults(steps, rules)


@query("select spoke_id, capture_id, phase from captures where phase = 'ACTIVE' and spoke_id = 'spoke-7'", CAPTURES)
def captures_found(spark, sf_dir) -> DataFrame:
    """Captures of a spoke and phase; filters without a value are none."""
    return L.find(captures_state(spark, sf_dir), phase="ACTIVE", spoke_id="spoke-7", storage="", capture_id=None).select("spoke_id", "capture_id", "phase")


@query("select capture_id, spoke_id, cell from captures left join spokes using (spoke_id) where cell = 'EUROPE'", CAPTURES, SPOKES)
def captures_in_cell(spark, sf_dir) -> DataFrame:
    return L.with_cell(captures_state(spark, sf_dir), spokes(spark, sf_dir), "EUROPE").select("capture_id", "spoke_id", "cell")


@query("select c_mktsegment as storage, n captures, s spokes from (select distinct c_mktsegment from customer) left join (select storage, count(*) n, array_to_string(list_sort(list(distinct spoke_id)), ',') s from captures group by 1) u on c_mktsegment = u.storage", CAPTURES)
def storage_users(spark, sf_dir) -> DataFrame:
    storages = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("storage")).distinct()
    return L.used_by(storages, captures_state(spark, sf_dir)).select("storage", "captures", F.array_join("spokes", ",").alias("spokes"))


@query("select r.load_test_name, r.sent total_sent, l.shard_index, l.phase, l.sent_requests, l.failed_requests from rollup_ r join latest l using (load_test_name)", SHARDS, ROLLUP)
def load_test_shards(spark, sf_dir) -> DataFrame:
    """Load tests with each of their shards."""
    status = latest_status(spark, sf_dir)
    tests = L.load_test_rollup(status).select("load_test_name", F.col("sent").alias("total_sent"))
    return tests.join(status, "load_test_name").select("load_test_name", "total_sent", "shard_index", "phase", "sent_requests", "failed_requests")


@query("select l_orderkey, count(*) n from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus <> 'P') group by 1")
def dangling_artifacts(spark, sf_dir) -> DataFrame:
    """Artifacts whose capture is not in the catalog (here: not yet begun)."""
    known = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").join(known, "l_orderkey", "left_anti").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("select o_custkey, o_orderkey, o_orderdate::date::varchar as day from orders qualify row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) = 1")
def authoritative_picks(spark, sf_dir) -> DataFrame:
    """The oldest of several claims on a thing."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return L.authoritative(o, ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("select kind, spoke_id, count(*) n from (select 'capture' as kind, spoke_id from captures union all select 'replay', spoke_id from latest) group by all", CAPTURES, SHARDS)
def all_spokes_work(spark, sf_dir) -> DataFrame:
    """Captures and replays of all spokes as one bag."""
    c = captures_state(spark, sf_dir).select(F.lit("capture").alias("kind"), "spoke_id")
    r = latest_status(spark, sf_dir).select(F.lit("replay").alias("kind"), "spoke_id")
    return c.unionByName(r).groupBy("kind", "spoke_id").agg(F.count("*").alias("n"))
