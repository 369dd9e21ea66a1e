"""Queries that schedule requests: gaps, offsets, rates, batches, fidelity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import policy as D
from ..operators import select as S
from ..sources.adapters import CAPTURED, RESULTS, captured, results
from . import schedule as W
from .registry import query
from .request_queries import FNV

SHARDED = f"sharded as (select *, {FNV.format('id', 5)} shard from captured)"
ORDER = "partition by shard order by object_key, line"


def sharded(spark, sf_dir) -> DataFrame:
    return S.with_shard(captured(spark, sf_dir).select("id", "timestamp", "object_key", "line"), 5)


@query(f"select id, shard, coalesce((ts_us - lag(ts_us) over ({ORDER})) * 1000, 0) gap_ns from sharded", CAPTURED, SHARDED)
def request_gaps(spark, sf_dir) -> DataFrame:
    return W.gaps(sharded(spark, sf_dir)).select("id", "shard", "gap_ns")


@query(f", g as (select *, coalesce((ts_us - lag(ts_us) over ({ORDER})) * 1000, 0) gap_ns from sharded) select id, shard, (sum(floor(greatest(gap_ns, 0) * 0.5)::bigint) over ({ORDER}))::bigint send_offset_ns from g", CAPTURED, SHARDED)
def original_schedule(spark, sf_dir) -> DataFrame:
    """As recorded, twice as fast; rows that go back in time wait for nothing."""
    return W.original_timing(sharded(spark, sf_dir), 0.5).select("id", "shard", "send_offset_ns")


@query(f"select id, shard, floor(row_number() over ({ORDER}) * (1e9 / 250))::bigint send_offset_ns from sharded", CAPTURED, SHARDED)
def constant_schedule(spark, sf_dir) -> DataFrame:
    return W.constant_rate(sharded(spark, sf_dir), 250).select("id", "shard", "send_offset_ns")


@query("select id, shard, 0::bigint send_offset_ns from sharded", CAPTURED, SHARDED)
def unlimited_schedule(spark, sf_dir) -> DataFrame:
    return W.unlimited(sharded(spark, sf_dir)).select("id", "shard", "send_offset_ns")


@query(f"select id, shard, (ts_us - first_value(ts_us) over ({ORDER})) * 1000 source_offset_ns, (row_number() over ({ORDER}) - 1) // 100 batch from sharded", CAPTURED, SHARDED)
def feed(spark, sf_dir) -> DataFrame:
    """Feed items with their offsets from the shard's first time, in batches of a hundred."""
    return W.batches(W.source_offsets(sharded(spark, sf_dir))).select("id", "shard", "source_offset_ns", "batch")


@query("select id, row_number() over (order by ts_us, id) place from captured", CAPTURED)
def global_order(spark, sf_dir) -> DataFrame:
    """Places in the whole capture by time, without one task that has all rows."""
    df = captured(spark, sf_dir).select("id", X.micros("timestamp").alias("t"))
    return W.global_offsets(df, "t", 86_400_000_000).select("id", "place")


@query(
    """, s as (select id, shard, sharded.ts_us * 1000 planned, r.ts_us * 1000 actual from sharded join (select request_id, ts_us from results) r on id = request_id),
    d as (select shard, abs((actual - lag(actual) over w) - (planned - lag(planned) over w)) diff, actual - planned late from s window w as (partition by shard order by planned, id))
    select shard, count(diff) gaps, count(*) filter (where diff > 40000000) beyond, max(diff) largest_ns, max(late) - min(late) drift_ns from d group by shard""",
    CAPTURED, SHARDED, RESULTS,
)
def pacing_fidelity(spark, sf_dir) -> DataFrame:
    sent = sharded(spark, sf_dir).select("id", "shard", (X.micros("timestamp") * 1000).alias("planned_ns"))
    actual = results(spark, sf_dir).select(F.col("request_id").alias("id"), (X.micros("timestamp") * 1000).alias("actual_ns"))
    return W.fidelity(sent.join(actual, "id"), 40_000_000)


@query("select id from captured where object_key > 'ns1/cap3/2024-01-10/agent-2-000005.jsonl.gz'", CAPTURED)
def resume_position(spark, sf_dir) -> DataFrame:
    return W.resume_after(captured(spark, sf_dir), "ns1/cap3/2024-01-10/agent-2-000005.jsonl.gz").select("id")


@query("select id, epoch_us(timestamp '2025-01-01') + floor((ts_us - min(ts_us) over (partition by capture_id)) * 1000 / (1000 * 2.0))::bigint due_us from captured", CAPTURED)
def due_times(spark, sf_dir) -> DataFrame:
    """Due times at twice the recorded speed."""
    first = captured(spark, sf_dir)
    offsets = W.source_offsets(first, ["capture_id"], ("timestamp", "id"))
    return offsets.select("id", W.due_time(F.lit("2025-01-01").cast("timestamp"), "source_offset_ns", 2.0).alias("due_us"))


@query(
    "select id, times::bigint times, case when times = 0 then 'not sent' else 'sent again' end fault from (select 'req-' || event_id id, case when event_id % 17 = 0 then 0 when event_id % 19 = 0 then 2 else 1 end times from events) where times <> 1",
)
def exactly_once(spark, sf_dir) -> DataFrame:
    """Captured ids against sent ones, some of which are missing or there twice."""
    df = captured(spark, sf_dir).select("id", "line")
    sent = df.where("line % 17 <> 0").select("id", F.explode(F.when(F.col("line") % 19 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("k"))
    return D.exactly_once(df, sent.select("id"))
