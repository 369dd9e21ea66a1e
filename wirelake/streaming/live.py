"""Live rates of counters, late rows, and metrics of running streams as tables."""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener
from pyspark.sql.types import StructType

from ..sources.objects import Store
from .jobs import LATE

#: State with timers needs this store.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SAMPLE = "t timestamp, v double"
#: A stretch of samples that wait together, samples that are taken in before they are put into packs, and samples of an output row.
WIDTH_US, HELD, PACKED = 3_600_000_000, 100_000, 10_000


def state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def _steps(series: list[str], width: int = WIDTH_US, held: int = HELD) -> StatefulProcessor:
    """The processor of counter_steps. Its class is sent with it, as the process that a stream asks for state need not have this package."""

    class Steps(StatefulProcessor):
        """What a counter grew by at each sample. Samples wait until the watermark has passed them and are then taken in order, whatever
        the order in which they came; a fall is a restart from zero. State is the last sample and those that wait, in packs of a stretch of time:
        reading or writing a pack is one call, and a stretch is all that is sorted at once."""

        def __init__(self, series: list[str]):
            self.series = series

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.last = handle.getValueState("last", "t long, v double")
            self.packs = handle.getMapState("packs", "stretch long, n long", "t binary, v binary")
            self.number = handle.getValueState("number", "n long")

        def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
            mark = timerValues.getCurrentWatermarkInMs() * 1000
            waiting = ((r.t_us, r.v) for r in rows if r.t_us > mark)
            while some := list(itertools.islice(waiting, held)):
                t, v = zip(*some, strict=True)
                self._put(np.array(t, np.int64), np.array(v, np.float64))
            return self._passed(key, mark)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
            return self._passed(key, timerValues.getCurrentWatermarkInMs() * 1000)

        def _put(self, t: np.ndarray, v: np.ndarray) -> None:
            n = self.number.get()[0] if self.number.exists() else 0
            stretch = t // width
            order = np.argsort(stretch, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(stretch[order])) + 1):
                n += 1
                self.packs.updateValue((int(stretch[part[0]]), n), (t[part].tobytes(), v[part].tobytes()))
            self.number.update((n,))

        def _passed(self, key, mark: int) -> Iterator[Row]:
            stretches: dict[int, list[tuple]] = {}
            for k in self.packs.keys():
                stretches.setdefault(k[0], []).append(tuple(k))
            last = tuple(self.last.get()) if self.last.exists() else None
            for stretch in sorted(stretches):
                packs = [self.packs.getValue(k) for k in stretches[stretch]]
                t, v = (np.concatenate([np.frombuffer(x[i], kind) for x in packs]) for i, kind in enumerate((np.int64, np.float64)))
                order = np.lexsort((v, t))
                t, v = t[order], v[order]
                n = int(np.searchsorted(t, mark, "right"))
                if n:
                    for k in stretches[stretch]:
                        self.packs.removeKey(k)
                    if n < len(t):
                        self._put(t[n:], v[n:])
                    before = np.concatenate([[v[0] if last is None else last[1]], v[: n - 1]])
                    step = np.where(v[:n] < before, v[:n], v[:n] - before)
                    last = (int(t[n - 1]), float(v[n - 1]))
                    for i in range(0, n, PACKED):
                        some = slice(i, min(n, i + PACKED))
                        yield Row(**dict(zip(self.series, key, strict=True)), t_us=t[some].tolist(), v=v[some].tolist(), step=step[some].tolist())
                if n < len(t):
                    self.handle.registerTimer(int(t[n]) // 1000 + 1)
                    break
            if last is not None:
                self.last.update(last)

        def close(self) -> None:
            """Nothing is open."""

    return Steps(series)


def counter_steps(samples: DataFrame, series: list[str], time: str = "t", value: str = "v") -> DataFrame:
    """series, t, v and step of a stream of counter samples, in append mode; samples behind the watermark (LATE) or without a time are left out.

    Samples of the same time and value are one after the other; of the same time, smaller values come first.
    """
    state_store(samples.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in samples.schema}
    rows = samples.where(F.col(time).isNotNull()).select(*series, F.col(time).alias("t"), F.col(value).cast("double").alias("v")).withWatermark("t", LATE).withColumn("t_us", F.unix_micros("t"))
    out = ", ".join(f"{c} {kinds[c]}" for c in series) + ", t_us array<long>, v array<double>, step array<double>"
    steps = rows.groupBy(*series).transformWithState(statefulProcessor=_steps(list(series)), outputStructType=_struct(samples.sparkSession, out), outputMode="Append", timeMode="EventTime")
    each = steps.select(*series, F.inline(F.arrays_zip("t_us", "v", "step")).alias("t_us", "v", "step"))
    return each.select(*series, F.timestamp_micros("t_us").alias("t"), "v", "step")


def _struct(spark: SparkSession, ddl: str) -> StructType:
    return spark.createDataFrame([], ddl).schema


def sliding_rates(steps: DataFrame, series: list[str], width: str = "5 minutes", slide: str = "30 seconds") -> DataFrame:
    """Increase of each series in sliding windows over a table of steps, and the rate a second."""
    seconds = F.unix_micros("window.end") - F.unix_micros("window.start")
    out = steps.groupBy(F.window("t", width, slide), *series).agg(F.sum("step").alias("increase"), F.count("*").alias("samples"))
    return out.select(*series, F.col("window.start").alias("start"), "increase", "samples", (F.col("increase") * 1e6 / seconds).alias("per_second"))


def split_late(df: DataFrame, time: str, kept: str, late: str, checkpoint: str, seconds: int = 600):
    """Starts a stream that writes rows in time to `kept` and those behind its watermark, or without a time, to `late`, as Parquet by batch.

    The watermark is `seconds` behind the newest time of the batches before, and is kept beside the checkpoint with its batch; a batch that
    comes again is judged by the same watermark and replaces its own folders.
    """
    store = Store(checkpoint)

    def mark_before(batch: int) -> int | None:
        found = store.read(f"_marks/{batch - 1}.json") if batch else None
        return json.loads(found)["newest_us"] if found else None

    def put(rows: DataFrame, batch: int) -> None:
        before = mark_before(batch)
        us = F.unix_micros(time)
        in_time = us.isNotNull() if before is None else F.coalesce(us >= before - seconds * 1_000_000, F.lit(False))
        rows = rows.persist()
        try:
            for keep, path in ((in_time, kept), (~in_time, late)):
                rows.where(keep).write.mode("overwrite").parquet(f"{path}/batch={batch}")
            newest = rows.agg(F.max(us)).first()[0]
        finally:
            rows.unpersist()
        newest = max((x for x in (newest, before) if x is not None), default=None)
        store.write(f"_marks/{batch}.json", json.dumps({"newest_us": newest}).encode())

    return df.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class MetricRows(StreamingQueryListener):
    """Writes what queries observe to a folder, a small file of rows for each batch of a query, so that a batch is told once.

    Counters of the engine are among them: rows read, and rows dropped as late by stateful operators.
    """

    def __init__(self, root: str):
        self.store = Store(root)

    def onQueryStarted(self, event) -> None:
        """A start has no counters."""

    def onQueryProgress(self, event) -> None:
        p = event.progress
        found = {"input": p.numInputRows, "dropped": sum(s.numRowsDroppedByWatermark for s in p.stateOperators)}
        named = [("engine", k, v) for k, v in found.items()]
        named += [(name, k, v) for name, row in (p.observedMetrics or {}).items() for k, v in row.asDict().items()]
        rows = [{"query": p.name or str(p.id), "batch": p.batchId, "at": p.timestamp, "source": s, "metric": k, "value": v} for s, k, v in named if v is not None]
        self.store.write(f"query={p.name or p.id}/batch={p.batchId:08d}.json", "\n".join(map(json.dumps, rows)).encode())

    def onQueryIdle(self, event) -> None:
        """Nothing changes."""

    def onQueryTerminated(self, event) -> None:
        """The last batch was told before."""


METRICS = "query string, batch long, at timestamp, source string, metric string, value double"


def metric_rows(spark: SparkSession, root: str) -> DataFrame:
    """The rows that MetricRows wrote."""
    return spark.read.schema(METRICS).option("recursiveFileLookup", True).json(root)
