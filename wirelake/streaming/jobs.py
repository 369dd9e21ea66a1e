"""Structured Streaming jobs: ingest, newest state, liveness, rates, run monitors, dedup.

Late data is this engine's own definition: ten minutes behind the newest event time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import schemas
from ..operators import fleet as L
from ..operators import select as S
from ..operators import transform as T
from ..sources import objects
from ..sources.lake import MICROS
from .keyed import KeyedTable

LATE = "10 minutes"
TOTALS = "load_test_namespace string, load_test_name string, total long, sent long, failed long, filtered long, rps string, shards long, completed_shards long, failed_shards long, running_shards long, phase string, elapsed_s long, abort_reason string"


def requests(spark: SparkSession, landing: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schemas.REQUEST).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", True).json(landing)


def prepared(df: DataFrame, keep=None, most: int = 1 << 20, redaction: str = "") -> DataFrame:
    """Filter, then truncation, then redaction, for streams as for tables."""
    return T.redact_headers(T.truncate_body(df.where(keep) if keep is not None else df, most), redaction)


def counted(df: DataFrame, keep, name: str = "capture") -> DataFrame:
    """df with live counters of what comes, what is filtered and bytes, for a listener."""
    return df.observe(name, F.count(F.lit(1)).alias("total"), F.count_if(~keep).alias("filtered"), F.sum(F.octet_length("body")).alias("bytes"))


def ingest(df: DataFrame, out: str, checkpoint: str, seconds: int | None = 5) -> StreamingQuery:
    """Writes days of gzip JSON lines; every `seconds`, or once over what is there."""
    w = df.withColumn("day", F.date_format("timestamp", "yyyy-MM-dd")).writeStream.format("json").option("path", out).option("checkpointLocation", checkpoint).option("timestampFormat", MICROS).option("compression", "gzip").partitionBy("day")
    return (w.trigger(processingTime=f"{seconds} seconds") if seconds else w.trigger(availableNow=True)).start()


def deduplicated(df: DataFrame, time: str = "timestamp") -> DataFrame:
    """Retried requests once; state of an id is kept as long as data may be late."""
    return df.withWatermark(time, LATE).dropDuplicatesWithinWatermark(["id"])


def newest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The newest row of each key; a stream of it in update mode has the changed keys of each batch."""
    return L.latest(df, keys, *order)


def ingest_objects(df: DataFrame, root: str, capture: str, checkpoint: str, seconds: int | None = 5, max_bytes: int = objects.MAX_BYTES, pod: str = "agent") -> StreamingQuery:
    """Writes a capture's objects, which end at so many bytes or, in a task, when a line is older than `seconds`; each batch once.

    Objects are named by pod, batch, task and number; a batch that comes again finishes what it had begun.
    """
    objects.register(df.sparkSession)
    out = df.select(F.lit(capture).alias("capture"), F.date_format("timestamp", "'day='yyyy-MM-dd").alias("day"), F.to_json(F.struct(*[c for c in schemas.REQUEST_COLUMNS if c in df.columns]), {"timestampFormat": MICROS}).alias("line"))
    w = out.writeStream.format("capture").option("path", root).option("pod", pod).option("query", capture).option("maxBytes", max_bytes).option("maxAge", seconds or objects.MAX_AGE_S).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=f"{seconds} seconds") if seconds else w.trigger(availableNow=True)).start()


def rates(df: DataFrame, series: list[str], time: str = "ts", width: str = "5 minutes", slide: str = "30 seconds") -> DataFrame:
    """Events a second of every sliding window, late data left out."""
    seconds = pd.Timedelta(width).total_seconds()
    out = df.withWatermark(time, LATE).groupBy(F.window(time, width, slide), *series).agg(F.count("*").alias("n"))
    return out.select(*series, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", (F.col("n") / seconds).alias("per_second"))


def run_monitor(reports: DataFrame, policies: DataFrame, order: tuple[str, ...], out: str, checkpoint: str) -> StreamingQuery:
    """Totals of load tests from the newest report of each shard, with the reason to stop where a policy has one.

    Reports are cumulative: a table has each shard's newest, of which a batch writes the buckets that changed, and another one the totals
    of the load tests that have a changed shard. A batch that comes again changes neither. policies: load_test_name, phase, elapsed_s and
    policy (see should_abort).
    """
    spark, test = reports.sparkSession, ["load_test_namespace", "load_test_name"]
    shards = KeyedTable(spark, f"{out}/shards", reports.schema, [*test, "shard_index"], order)
    totals = monitored(spark, out)

    def put(changed: DataFrame, batch: int) -> None:
        shards.merge(changed, batch)
        # Totals follow even if the batch stopped between the two tables.
        now = L.load_test_rollup(shards.read().join(F.broadcast(changed.select(*test).distinct()), test, "left_semi"))
        totals.merge(now.join(policies, "load_test_name", "left").withColumn("abort_reason", L.should_abort()), batch)

    kept = newest(reports, [*test, "shard_index"], *order)
    return kept.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()


def monitored(spark: SparkSession, out: str) -> KeyedTable:
    """The totals that run_monitor keeps up; a test's newest totals take the place of the older ones."""
    return KeyedTable(spark, f"{out}/totals", TOTALS, ["load_test_namespace", "load_test_name"], merged=lambda old, new: old.join(new, ["load_test_namespace", "load_test_name"], "left_anti").unionByName(new))


def liveness(heartbeats: DataFrame, seconds: int = L.LIVE_SECONDS) -> DataFrame:
    """CONNECTED with a spoke's first heartbeat, and again after silence; DISCONNECTED when none came for `seconds`.

    Time is event time: the timer fires when the watermark has passed the last heartbeat by that much.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, live = state.get if state.exists else (0, False)
        out = []
        if state.hasTimedOut:
            out.append((key[0], last + seconds * 1000, "DISCONNECTED"))
            state.update((last, False))
        else:
            times = sorted(int(t.timestamp() * 1000) for b in batches for t in b["ts"])
            for t in times:
                if live and t - last > seconds * 1000:
                    out.append((key[0], last + seconds * 1000, "DISCONNECTED"))
                    live = False
                if not live:
                    out.append((key[0], t, "CONNECTED"))
                    live = True
                last = max(last, t)
            state.update((last, live))
            state.setTimeoutTimestamp(max(last + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["spoke_id", "at_ms", "state"])

    return heartbeats.withWatermark("ts", LATE).groupBy("spoke_id").applyInPandasWithState(step, "spoke_id string, at_ms long, state string", "last long, live boolean", "append", GroupStateTimeout.EventTimeTimeout)


def auto_stopped(df: DataFrame, captures: DataFrame) -> DataFrame:
    """Requests of captures that are not over by the requests' own time; captures (capture_id, started_at, duration) are a table."""
    joined = df.join(captures, "capture_id")
    return joined.where(S.still_active(F.col("timestamp"))).drop("started_at", "duration")
