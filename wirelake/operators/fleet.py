"""Fleet state: newest reports, liveness, rollups of load tests and cells, orphans, counters, catalogs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import latency_text
from . import blocked as B

TERMINAL = ("COMPLETED", "FAILED")
LIVE_SECONDS = 90


def latest(df: DataFrame, keys: list[str], *newest: str) -> DataFrame:
    """The newest row of each key. Rows of a key are reduced where they are before they are exchanged."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*newest)).alias("r"))
    return best.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def liveness(heartbeats: DataFrame, asof: Column, seconds: int = LIVE_SECONDS) -> DataFrame:
    """State of each spoke from its last heartbeat: disconnected when that is older than `seconds`."""
    last = heartbeats.groupBy("spoke_id").agg(F.max("ts").alias("last_heartbeat"), F.max_by("active_captures", F.struct("ts", "seq")).alias("active_captures"))
    age = (F.unix_micros(asof) - F.unix_micros("last_heartbeat")) / 1e6
    return last.withColumn("connected", age <= seconds)


def load_test_rollup(status: DataFrame) -> DataFrame:
    """Sums over a load test's shards; the rate is text of one decimal, only where there is one."""
    rps = F.sum("achieved_rps")
    return status.groupBy("load_test_namespace", "load_test_name").agg(
        F.sum("total_requests").alias("total"), F.sum("sent_requests").alias("sent"), F.sum("failed_requests").alias("failed"), F.sum("filtered_requests").alias("filtered"),
        F.when(rps > 0, F.format_string("%.1f", rps)).alias("rps"),
        F.count("*").alias("shards"), F.count_if(F.col("phase") == "COMPLETED").alias("completed_shards"), F.count_if(F.col("phase") == "FAILED").alias("failed_shards"), F.count_if(F.col("phase") == "RUNNING").alias("running_shards"),
    )


def phase(total_shards: Column | str = "total_shards", now: str = "Distributing") -> Column:
    """Of a rollup: terminal only when every one of the test's shards is; as it is now while no shard has begun."""
    total = F.col(total_shards) if isinstance(total_shards, str) else total_shards
    done, failed = F.col("completed_shards"), F.col("failed_shards")
    return F.when((total > 0) & (done == total), "Completed").when((total > 0) & (done + failed == total), "Failed").when(F.col("running_shards") + done + failed > 0, "Running").otherwise(now)


def by_cell(status: DataFrame, spokes: DataFrame) -> DataFrame:
    """Sent and failed of each load test and cell. Statuses of spokes that aren't known are in no cell."""
    known = status.join(spokes, "spoke_id")
    return known.groupBy("load_test_name", "cell").agg(F.countDistinct("spoke_id").alias("spokes"), F.sum("sent_requests").alias("sent"), F.sum("failed_requests").alias("failed"))


def assigned_cells(status: DataFrame, assignments: DataFrame) -> DataFrame:
    """Spokes, shards, sent and failed of each load test's cells, which are those of its assignments (load_test_name, spoke_id, cell, position, shard_indexes).

    position counts the cells in the order in which assignments name them first. Statuses of spokes that aren't assigned are in no cell.
    """
    of = assignments.groupBy("load_test_name", "cell").agg(F.count("*").alias("spokes"), F.sum(F.size("shard_indexes")).alias("shards"), F.min("position").alias("first"))
    sums = status.join(assignments.select("load_test_name", "spoke_id", "cell"), ["load_test_name", "spoke_id"]).groupBy("load_test_name", "cell").agg(F.sum("sent_requests").alias("sent"), F.sum("failed_requests").alias("failed"))
    place = F.row_number().over(Window.partitionBy("load_test_name").orderBy("first")) - 1
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return of.join(sums, ["load_test_name", "cell"], "left").select("load_test_name", "cell", "spokes", "shards", zero("sent"), zero("failed"), place.cast("long").alias("position"))


def cells(spokes: DataFrame, live: DataFrame, captures: DataFrame, status: DataFrame) -> DataFrame:
    """Each cell's spokes, connected ones, captures and replays that go on, by cell."""
    held = captures.groupBy("spoke_id").agg(F.count("*").alias("captures"))
    active = status.where(~F.col("phase").isin(*TERMINAL)).groupBy("spoke_id").agg(F.count("*").alias("replays"))
    all_ = spokes.join(live.select("spoke_id", "connected"), "spoke_id", "left").join(held, "spoke_id", "left").join(active, "spoke_id", "left")
    none = F.lit(0).cast("long")
    return all_.groupBy("cell").agg(F.count("*").alias("spokes"), F.count_if("connected").alias("connected"), F.coalesce(F.sum("captures"), none).alias("captures"), F.coalesce(F.sum("replays"), none).alias("active_replays")).orderBy("cell")


def orphans(replays: DataFrame, active_tests: DataFrame, asof: Column, least_age_s: int = 120) -> DataFrame:
    """Replays of a load test that isn't active any more and that are old enough; standalone ones stay."""
    aged = replays.where(F.col("load_test_name").isNotNull() & (F.unix_micros(asof) - F.unix_micros("created_at") >= least_age_s * 1_000_000))
    return aged.join(active_tests.select("load_test_name").distinct(), "load_test_name", "left_anti")


def unreported(assignments: DataFrame, status: DataFrame) -> DataFrame:
    """Assigned shards that no report has come from."""
    assigned = assignments.select("load_test_name", F.explode("shard_indexes").alias("shard_index"))
    return assigned.join(status.select("load_test_name", "shard_index").distinct(), ["load_test_name", "shard_index"], "left_anti")


def eligible(spokes: DataFrame, wanted_cells: list[str] = ()) -> DataFrame:
    """Spokes of the wanted cells, all without any."""
    if not wanted_cells:
        return spokes
    want = spokes.sparkSession.createDataFrame([(c,) for c in wanted_cells], "cell string")
    return spokes.join(F.broadcast(want), "cell", "left_semi")


def assign_shards(spokes: DataFrame, per_spoke: int, most: int = 0) -> DataFrame:
    """Dense shard indexes for spokes in order of their ids: spoke k runs k * per_spoke and the ones after.

    One row for each spoke of a fleet, so that one ordered window over them is small.
    """
    chosen = spokes.orderBy("spoke_id").limit(most) if most else spokes
    at = F.row_number().over(Window.orderBy("spoke_id")) - 1
    return chosen.withColumn("position", at).withColumn("shard_indexes", F.sequence(F.col("position") * per_spoke, F.col("position") * per_spoke + per_spoke - 1))


def split_rate(total: Column, shards: Column, index: Column) -> Column:
    """A shard's part of a rate: the remainder goes to the first ones, never less than one."""
    part = F.floor(total / shards) + (index < total % shards).cast("long")
    return F.when(shards <= 0, total).otherwise(F.greatest(part, F.lit(1)))


def should_abort(policy: str = "policy") -> Column:
    """Reason to stop a load test, or null. The time limit goes before the error rate. Both texts are fixed values."""
    p = lambda c: F.col(f"{policy}.{c}")
    tried = F.col("sent") + F.col("failed")
    rate = F.col("failed") * 100 / tried
    over = p("max_duration_s").isNotNull() & (F.col("elapsed_s") > p("max_duration_s"))
    bad = p("error_percent").isNotNull() & (tried >= F.coalesce(p("min_sample_requests"), F.lit(100))) & (tried > 0) & (rate > p("error_percent"))
    time = F.concat(F.lit("run exceeded maxDuration "), latency_text(p("max_duration_s") * 1000), F.lit(" (elapsed "), latency_text(F.round("elapsed_s") * 1000), F.lit(")"))
    share = F.format_string("error rate %.1f%% exceeded abort threshold %d%%", rate, p("error_percent"))
    return F.when(F.col("phase").isin("Distributing", "Running"), F.when(over, time).when(bad, share))


def spoke_captures(spokes: DataFrame, captures: DataFrame) -> DataFrame:
    held = captures.groupBy("spoke_id").agg(F.count("*").alias("n"), F.count_if(F.col("phase") == "ACTIVE").alias("active"), F.sum("captured_requests").alias("requests"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return spokes.join(held, "spoke_id", "left").select("spoke_id", zero("n"), zero("active"), zero("requests"))


def phase_counts(df: DataFrame, phases: list[str], keys: list[str] = ()) -> DataFrame:
    """Rows of each phase as columns, zero where there are none."""
    return df.groupBy(*keys).agg(*[F.count_if(F.col("phase") == p).alias(p.lower()) for p in phases])


#: Phases that each kind of entity is counted by (fixed values).
PHASES = {"capture": ("ACTIVE", "COMPLETED", "PENDING", "FAILED"), "replay": ("RUNNING", "COMPLETED", "FAILED"), "storage": ("READY", "ERROR"), "spoke": ("HEALTHY", "DEGRADED", "DISCONNECTED")}


def entity_phases(entities: dict[str, DataFrame]) -> DataFrame:
    """kind, phase and n of tables with a phase, by their kind: each known phase, zero where nothing is in it, and others that occur."""
    spark = next(iter(entities.values())).sparkSession
    known = spark.createDataFrame([(k, p) for k in entities for p in PHASES[k]], "kind string, phase string")
    counts = reduce(DataFrame.unionByName, [df.groupBy(F.lit(k).alias("kind"), "phase").agg(F.count("*").alias("n")) for k, df in entities.items()])
    return known.withColumn("n", F.lit(0).cast("long")).unionByName(counts).groupBy("kind", "phase").agg(F.sum("n").alias("n"))


def spoke_health(spokes: DataFrame, heartbeats: DataFrame, asof: Column, live_s: int = LIVE_SECONDS, degraded: Column | None = None) -> DataFrame:
    """spoke_id and phase: disconnected without a heartbeat in live_s seconds, degraded where that says so of the last one, else healthy."""
    last = liveness(heartbeats, asof, live_s)
    phase = F.when(~F.coalesce("connected", F.lit(False)), "DISCONNECTED").when(degraded if degraded is not None else F.lit(False), "DEGRADED").otherwise("HEALTHY")
    return spokes.select("spoke_id").join(last, "spoke_id", "left").select("spoke_id", phase.alias("phase"))


def upsert_captures(old: DataFrame, new: DataFrame) -> DataFrame:
    """The catalog after new rows: the start that was known first stays, the end that came last counts."""
    new = latest(new.where(F.trim("id") != ""), ["id"], "updated_at", "status")
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col("o.id") == F.col("n.id"), "full")
    value = lambda c: F.when(F.col("n.id").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return both.select(
        F.coalesce("n.id", "o.id").alias("id"), F.coalesce(F.nullif(F.trim(value("status")), F.lit("")), F.lit("pending")).alias("status"),
        F.coalesce("o.started_at", "n.started_at").alias("started_at"), F.coalesce("n.completed_at", "o.completed_at").alias("completed_at"),
        F.nullif(value("error"), F.lit("")).alias("error"), value("updated_at").alias("updated_at"),
    )


def record_artifacts(old: DataFrame, new: DataFrame) -> DataFrame:
    """The newest row of each object; rows without a capture, bucket or key are refused, new ones without a time are of now."""
    if new.schema["created_at"].dataType.typeName().startswith("timestamp"):
        new = new.withColumn("created_at", F.coalesce("created_at", F.current_timestamp()))
    named = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    rows = old.unionByName(new.where(named("capture_id") & named("s3_bucket") & named("s3_key")))
    rows = rows.withColumn("storage_backend", F.coalesce(F.nullif("storage_backend", F.lit("")), F.lit("s3")))
    return latest(rows, ["capture_id", "s3_bucket", "s3_key"], "created_at", "size_bytes")


def increase(samples: DataFrame, series: list[str], time: str = "t", value: str = "v", range_s: int = 300, ties: list[str] = (), block_s: int = 86_400) -> DataFrame:
    """Increase of counters over the last range_s seconds at each sample, in order of time, then ties; a fall is a restart from zero.

    Series are cut into blocks of block_s seconds, which know the last value of the one before and the rows that reach into them.
    """
    stepped = B.previous(samples, series, time, value, block_s, ties, "_v")
    step = F.col(value) - F.col("_v")
    stepped = stepped.withColumn("_step", F.when(step < 0, F.col(value)).otherwise(F.coalesce(step, F.lit(0)))).drop("_v")
    return B.range_sum(stepped, series, time, "_step", range_s, block_s, "increase").drop("_step")


def retention(objects: DataFrame, asof: Column, max_age_s: int | None = None, max_bytes: int | None = None, block_s: int = 86_400) -> DataFrame:
    """Objects that a storage's age or size bound no longer covers, newest kept first, equally new ones by key. Nothing is deleted.

    Bytes are added up by blocks of block_s seconds, then within them, so that a storage isn't one task's.
    """
    old = (F.unix_micros(asof) - F.unix_micros("modified")) / 1e6 > max_age_s if max_age_s is not None else F.lit(False)
    if max_bytes is None:
        return objects.where(old)
    rows = objects.withColumn("_us", F.unix_micros("modified"))
    upto = B.running_sum(rows, ["storage"], "_us", "length", block_s * 1_000_000, ["key"], "_upto", desc=True)
    return upto.where(old | (F.col("_upto") > max_bytes)).drop("_us", "_upto")


def find(df: DataFrame, **wanted: str | None) -> DataFrame:
    """Rows whose columns have the wanted values; an empty or missing value filters nothing."""
    for column, value in wanted.items():
        if value:
            df = df.where(F.col(column) == value)
    return df


def with_cell(df: DataFrame, spokes: DataFrame, cell: str = "") -> DataFrame:
    """Rows with their spoke's cell, of one cell if it is named. Spokes that aren't known have none."""
    out = df.join(spokes.select("spoke_id", "cell"), "spoke_id", "left")
    return out.where(F.col("cell") == cell) if cell else out


def authoritative(df: DataFrame, keys: list[str], created: str = "created_at", name: str = "name") -> DataFrame:
    """The oldest row of each key, the first name of equally old ones."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(created, name)).alias("r"))
    return best.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def used_by(storages: DataFrame, captures: DataFrame) -> DataFrame:
    """How many captures use each storage, by its name, and the spokes that they run on; none is an empty list."""
    users = captures.groupBy("storage").agg(F.count("*").alias("captures"), F.array_sort(F.collect_set("spoke_id")).alias("spokes"))
    return storages.join(users, "storage", "left").select("storage", F.coalesce("captures", F.lit(0)).alias("captures"), F.coalesce("spokes", F.array().cast("array<string>")).alias("spokes"))


def progress(results: DataFrame, keys: list[str]) -> DataFrame:
    """Counters of runs so far, with the last request in order and the time that passed. Rows whose `filtered` is true, where there is one, were not sent."""
    filtered = F.coalesce(F.col("filtered"), F.lit(False)) if "filtered" in results.columns else F.lit(False)
    ok = F.col("error").isNull() & ~filtered
    micros = F.unix_micros("timestamp")
    return results.groupBy(*keys).agg(
        F.count_if(ok).alias("sent"), F.count_if(~ok & ~filtered).alias("errored"), F.count_if(filtered).alias("filtered"), F.coalesce(F.sum("response_bytes"), F.lit(0)).alias("bytes"), F.max_by("request_id", "seq").alias("last_request_id"),
        ((F.max(micros) - F.min(micros)) * 1000).alias("elapsed_ns"),
    )
