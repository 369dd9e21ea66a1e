"""Tables that streams keep up, counter steps, late rows, metrics, and windows over long series in blocks."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from wirelake.operators import blocked as B
from wirelake.operators import fleet as L
from wirelake.streaming import jobs, live
from wirelake.streaming.keyed import KeyedTable, kept_up

BASE = dt.datetime(2026, 1, 15, 12)


def once(writer):
    writer.trigger(availableNow=True).start().awaitTermination()


def test_only_buckets_of_changed_keys_are_written(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "k long, at long, v string", ["k"], ["at"], buckets=16)
    rows = lambda ks, at, v: spark.createDataFrame([(k, at, v) for k in ks], "k long, at long, v string")
    assert table.read().count() == 0
    table.merge(rows(range(200), 1, "a"), 0)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    assert table.merge(rows([7], 2, "b"), 1) == 1
    new = [p for p in (tmp_path / "t").rglob("*.parquet") if p not in before]
    assert len(new) == 1 and sum(p.stat().st_size for p in new) * 4 < sum(p.stat().st_size for p in before)
    assert {r.k: r.v for r in table.read().collect()} == {k: "b" if k == 7 else "a" for k in range(200)}
    assert table.merge(rows([7, 8], 3, "again"), 1) == 0  # a batch that comes again
    assert table.merge(rows([9], 0, "older"), 2) == 1 and table.read().where("v = 'older'").count() == 0
    assert table.merge(rows([], 0, ""), 3) == 0 and table.pointer()["batch"] == 3
    assert table.read(1).where("k = 7").first().v == "a" and table.read(2).where("k = 7").first().v == "b"
    again = KeyedTable(spark, str(tmp_path / "t"), "k long, at long, v string", ["k"], ["at"], buckets=16)
    table.clean()
    assert again.read().count() == 200 and again.read(1).count() == 0


def test_a_merge_that_stops_before_its_pointer_is_not_seen(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), "k long, at long", ["k"], ["at"], buckets=4)
    rows = spark.createDataFrame([(i, 1) for i in range(20)], "k long, at long")
    table.merge(rows.where("k < 10"), 0)
    table._swap = lambda pointer: (_ for _ in ()).throw(KeyboardInterrupt())
    with pytest.raises(KeyboardInterrupt):
        table.merge(rows, 1)
    fresh = KeyedTable(spark, str(tmp_path), "k long, at long", ["k"], ["at"], buckets=4)
    assert fresh.read().count() == 10
    assert fresh.merge(rows, 1) == 4 and fresh.read().count() == 20
    fresh.clean()
    assert fresh.read().count() == 20


def test_newest_rows_over_restarts(spark, tmp_path):
    r, known = random.Random(1), []
    table = KeyedTable(spark, str(tmp_path / "state"), "k string, ts timestamp, v long", ["k"], ["ts", "v"], buckets=8)
    for run in range(3):
        new = [(f"k{r.randrange(30)}", BASE + dt.timedelta(seconds=r.randrange(1000)), r.randrange(10**6)) for _ in range(60)]
        known += new
        spark.createDataFrame(new, "k string, ts timestamp, v long").write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("k string, ts timestamp, v long").parquet(str(tmp_path / "in"))
        seen = []
        kept_up(jobs.newest(stream, ["k"], "ts", "v"), table, str(tmp_path / "at"), lambda df, b, seen=seen: seen.append(b)).awaitTermination()
        assert seen == [run]
        want = {}
        for k, t, v in known:
            want[k] = max(want.get(k, (t, v)), (t, v))
        assert {x.k: (x.ts, x.v) for x in table.read().collect()} == want


def test_counter_steps_equal_the_batch_over_restarts(spark, tmp_path):
    """Two runs of a stream, samples in any order within the watermark: steps of what it has passed are those of a table."""
    r, rows = random.Random(2), []
    for s in ("a", "b", None):
        v = 0
        for i in range(120):
            v = 0 if r.random() < 0.1 else v + r.randrange(5)
            rows.append((s, BASE + dt.timedelta(seconds=20 * i), float(v)))
    first, second = [x for x in rows if x[1] < BASE + dt.timedelta(minutes=22)], [x for x in rows if x[1] >= BASE + dt.timedelta(minutes=22)]
    late = ("a", BASE, 999.0)
    for part in (first, second + [late]):
        r.shuffle(part)
        spark.createDataFrame(part, "s string, t timestamp, v double").repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("s string, t timestamp, v double").parquet(str(tmp_path / "in"))
        once(live.counter_steps(stream, ["s"]).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")))
    mark = max(t for _, t, _ in rows) - dt.timedelta(minutes=10)
    want, last = [], {}
    for s, t, v in sorted(rows, key=lambda x: (x[0] or "", x[1], x[2])):
        before = last.get(s)
        last[s] = v
        if t <= mark:
            want.append((s, t, v, 0.0 if before is None else v if v < before else v - before))
    got = spark.read.parquet(str(tmp_path / "out"))
    key = lambda x: (x[0] or "", *x[1:])
    assert sorted(((x.s, x.t, x.v, x.step) for x in got.collect()), key=key) == sorted(want, key=key)
    rates = live.sliding_rates(got, ["s"], "5 minutes", "1 minute").where("s = 'a'").collect()
    for x in rates:
        inside = [w[3] for w in want if w[0] == "a" and x.start <= w[1] < x.start + dt.timedelta(minutes=5)]
        assert (x.increase, x.samples) == (sum(inside), len(inside)) and abs(x.per_second - sum(inside) / 300) < 1e-9


class Counted:
    """Value, map and timer states in a dict, which count how often they are called."""

    def __init__(self):
        self.calls, self.timers = 0, []

    def state(self):
        outer, kept = self, {}

        class State:
            def __getattr__(self, name):
                outer.calls += 1
                return {
                    "exists": lambda: None in kept, "get": lambda: kept[None], "update": lambda v: kept.__setitem__(None, v), "keys": lambda: iter(list(kept)), "iterator": lambda: iter(list(kept.items())),
                    "containsKey": lambda k: tuple(k) in kept, "getValue": lambda k: kept[tuple(k)], "updateValue": lambda k, v: kept.__setitem__(tuple(k), v), "removeKey": lambda k: kept.pop(tuple(k)),
                }[name]

        return State()

    def getValueState(self, *_):
        return self.state()

    def getMapState(self, *_):
        return self.state()

    def registerTimer(self, at):
        self.timers.append(at)


def test_counter_samples_wait_in_packs(monkeypatch):
    """A call for each sample would make a series of a million samples hours of work; here 6,000 samples of 20 hours take few."""
    r, handle = random.Random(4), Counted()
    at = lambda ms: type("Timer", (), {"getCurrentWatermarkInMs": lambda self: ms})()
    samples = [(i * 12_000_000 + r.randrange(3), float(r.randrange(50))) for i in range(6_000)] + [(600_000_000, 7.0)] * 2
    r.shuffle(samples)
    steps, out = live._steps(["s"]), []
    steps.init(handle)
    flat = lambda rows: [x for row in rows for x in zip(row.t_us, row.v, row.step, strict=True)]
    out += flat(steps.handleInputRows((None,), iter([type("R", (), {"t_us": t, "v": v})() for t, v in samples]), at(0)))
    calls = handle.calls
    for ms in (10, 36_000_000, 36_000_100, 80_000_000):
        out += flat(steps.handleExpiredTimer((None,), at(ms), None))
    want, last = [], None
    for t, v in sorted(samples):
        if t > 0:
            want.append((t, v, 0.0 if last is None else v if v < last else v - last))
            last = v
    assert out == want and calls < 100 and handle.calls < 400 and handle.timers


def test_late_rows_go_to_their_own_table(spark, tmp_path):
    parts = [[(1, BASE), (2, BASE + dt.timedelta(hours=1)), (3, None)], [(4, BASE + dt.timedelta(minutes=50)), (5, BASE + dt.timedelta(minutes=49, seconds=59)), (6, BASE + dt.timedelta(minutes=30))], [(7, BASE + dt.timedelta(minutes=50)), (8, None)]]
    for part in parts:
        spark.createDataFrame(part, "n long, t timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("n long, t timestamp").parquet(str(tmp_path / "in"))
        live.split_late(stream, "t", str(tmp_path / "kept"), str(tmp_path / "late"), str(tmp_path / "at")).awaitTermination()
    read = lambda kind: sorted(r.n for r in spark.read.schema("n long").parquet(str(tmp_path / kind)).collect())
    assert read("kept") == [1, 2, 4, 7] and read("late") == [3, 5, 6, 8]


def test_metrics_of_batches_are_rows(spark, tmp_path):
    listener = live.MetricRows(str(tmp_path / "metrics"))
    spark.streams.addListener(listener)
    try:
        for n in (3, 4):
            spark.range(n).select(F.col("id").cast("string").alias("id"), F.lit(b"xy").alias("body")).write.mode("append").parquet(str(tmp_path / "in"))
            stream = jobs.counted(spark.readStream.schema("id string, body binary").parquet(str(tmp_path / "in")), F.col("id") != "0")
            once(stream.writeStream.queryName("ingest").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")))
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    got = {(r.batch, r.metric): r.value for r in live.metric_rows(spark, str(tmp_path / "metrics")).where("query = 'ingest'").collect()}
    assert {k: v for k, v in got.items() if k[1] in ("total", "filtered", "bytes", "dropped")} == {(0, "total"): 3, (0, "filtered"): 1, (0, "bytes"): 6, (0, "dropped"): 0, (1, "total"): 4, (1, "filtered"): 1, (1, "bytes"): 8, (1, "dropped"): 0}


@pytest.fixture(scope="module")
def series(spark):
    """A long series, short ones, one without a name; equal times, gaps of several blocks, times below zero."""
    r, rows = random.Random(4), []
    for s, n in (("long", 600), ("b", 5), (None, 20), ("one", 1)):
        t = -50
        for i in range(n):
            t += r.choice([0, 0, 1, 3, 200 if r.random() < 0.05 else 2])
            rows.append((s, t, i, r.randrange(-3, 20)))
    return spark.createDataFrame(rows, "s string, t long, i long, v long").repartition(5).cache(), rows


def by_series(rows):
    out = defaultdict(list)
    for s, t, i, v in rows:
        out[s].append((t, i, v))
    return {s: sorted(x) for s, x in out.items()}


@pytest.mark.parametrize("width", [1, 7, 64, 10_000])
def test_windows_in_blocks_equal_those_over_whole_series(series, width):
    df, rows = series
    up = {(r.s, r.i): r.upto for r in B.running_sum(df, ["s"], "t", "v", width, ["i"]).collect()}
    down = {(r.s, r.i): r.upto for r in B.running_sum(df, ["s"], "t", "v", width, ["i"], desc=True).collect()}
    before = {(r.s, r.i): r.before for r in B.previous(df, ["s"], "t", "v", width, ["i"]).collect()}
    within = {(r.s, r.i): r.within for r in B.range_sum(df, ["s"], "t", "v", 9, width).collect()}
    assert len(up) == len(before) == len(within) == len(rows)
    for s, x in by_series(rows).items():
        total = 0
        for k, (t, i, v) in enumerate(x):
            total += v
            assert up[s, i] == total and before[s, i] == (x[k - 1][2] if k else None)
            assert within[s, i] == sum(w for u, _, w in x if t - 9 <= u <= t)
        total = 0
        for t, i, v in sorted(x, key=lambda y: (-y[0], y[1])):
            total += v
            assert down[s, i] == total


@pytest.mark.parametrize("width", [1, 3, 8, 1000])
def test_runs_over_blocks(spark, width):
    r = random.Random(width)
    rows = [(k, b, r.random() < 0.8 or 40 < b < 75) for k in ("x", None) for b in range(-5, 90) if r.random() < 0.95]
    df = spark.createDataFrame(rows, "k string, b long, bad boolean")
    want, at = set(), {}
    for k, b, bad in sorted(rows, key=lambda x: (x[0] or "", x[1])):
        first = at.get(k)
        if bad and first and first[1] == b - 1:
            at[k] = (first[0], b)
        elif bad:
            if first:
                want.add((k, first[0], first[1] - first[0] + 1))
            at[k] = (b, b)
    want |= {(k, a, b - a + 1) for k, (a, b) in at.items()}
    assert {tuple(x) for x in B.runs(df, ["k"], "b", F.col("bad"), width).collect()} == want


def test_a_series_of_all_rows_is_many_tasks(series):
    df, _ = series
    for out in (L.increase(df.select("s", "t", "v"), ["s"], block_s=50, range_s=10), B.running_sum(df, ["s"], "t", "v", 50)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        windows = [x for x in plan.splitlines() if x.strip(" :+-").startswith("Window")]
        assert windows and all("_block" in x or "_of" in x for x in windows)


def test_artifacts_without_a_time_are_of_now(spark):
    kind = "capture_id string, s3_bucket string, s3_key string, size_bytes long, storage_backend string, created_at timestamp"
    old = spark.createDataFrame([("c", "b", "k", 1, "", BASE)], kind)
    got = L.record_artifacts(old, spark.createDataFrame([("c", "b", "k", 2, None, None), ("c", "b", "k2", 3, "gcs", None)], kind)).collect()
    assert {(r.s3_key, r.size_bytes, r.storage_backend) for r in got} == {("k", 2, "s3"), ("k2", 3, "gcs")} and all(r.created_at > BASE for r in got)


def test_schedules_in_blocks_of_objects(spark):
    """A capture that isn't sharded, over objects of a few rows each: gaps, offsets, places and batches as over the whole order."""
    from wirelake.plans import schedule as W

    r, rows, t = random.Random(9), [], 0
    for o in range(40):
        for n in range(r.choice([0, 1, 1, 2, 9])):
            t += r.randrange(-2, 9)
            rows.append(("one", f"k{o:03d}", n, BASE + dt.timedelta(seconds=t) if r.random() < 0.95 else None))
    df = spark.createDataFrame(rows, "shard string, object_key string, line int, timestamp timestamp").repartition(6)
    got = {(x.object_key, x.line): x for x in W.batches(W.constant_rate(W.original_timing(W.source_offsets(df), 2.0).withColumnRenamed("send_offset_ns", "as_recorded"), 4.0), 7).collect()}
    at, offset, first = None, 0, next(x[3] for x in rows if x[3])
    for i, (_, o, n, ts) in enumerate(rows):
        gap = round((ts - at).total_seconds()) * 10**9 if ts and at else 0
        offset += max(gap, 0) * 2
        x = got[o, n]
        assert (x.gap_ns, x.as_recorded, x.send_offset_ns, x.batch) == (gap, offset, (i + 1) * 250_000_000, i // 7)
        assert x.source_offset_ns == (round((ts - first).total_seconds()) * 10**9 if ts else None)
        at = ts
    plan = W.original_timing(df)._jdf.queryExecution().optimizedPlan().toString()
    big = [x for x in plan.splitlines() if x.strip(" :+-").startswith("Window") and "line#" in x]
    assert big and all("_block" in x for x in big)
