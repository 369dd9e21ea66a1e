"""Small tables with known answers for selection, transforms, summaries, fleet state, schedules and checks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from wirelake import schemas
from wirelake.functions import exprs as X
from wirelake.operators import fleet as L
from wirelake.operators import policy as D
from wirelake.operators import select as S
from wirelake.operators import summary as A
from wirelake.operators import transform as T
from wirelake.plans import prepare as N
from wirelake.plans import schedule as W

BASE = dt.datetime(2026, 1, 15, 10)


def one(spark, expr, **values):
    """The value of a column expression over one row of strings and numbers."""
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(expr.alias("x")).first().x


@pytest.fixture(scope="module")
def requests(spark):
    rows = [(f"req-{i:05d}", BASE + dt.timedelta(seconds=i), "GET", f"/api/{i}", {"Accept": ["*/*"]}, b'{"test": true}', 14, "HTTP/1.1", {"host": "a"}) for i in range(200)]
    return spark.createDataFrame(rows, schemas.REQUEST)


def fnv(text):
    h = 14695981039346656037
    for b in text.encode():
        h = (h ^ b) * 1099511628211 % (1 << 64)
    return h


def test_fnv(spark):
    texts = ["", "req-00001", "ä€\U0001f600", "x" * 300, *(f"req-{i}" for i in range(50))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for n in (2, 4, 7, 1000):
        assert [r.m for r in df.select(X.fnv1a64_mod("t", n).alias("m")).collect()] == [fnv(t) % n for t in texts]
    assert one(spark, X.fnv1a64_mod("t", 4), t="req-00001") == 1


@pytest.mark.parametrize(
    "headers, want",
    [({"X-Debug": ["true"]}, True), ({"x-debug": ["true"]}, True), ({"X-Debug": ["false", "true"]}, True), ({"X-Debug": ["false"]}, False), ({"X-Debug": ["TRUE"]}, False), ({"Other": ["true"]}, False), (None, False)],
)
def test_header_match(spark, headers, want):
    df = spark.createDataFrame([(headers,)], "h map<string,array<string>>")
    assert df.select(X.headers_match("h", [("X-Debug", "true")])).first()[0] is want
    assert df.select(X.headers_match("h", [("X-Debug", "true"), ("Y", "1")])).first()[0] is False


def test_header_rewriting(spark):
    df = spark.createDataFrame([({"Authorization": ["old"], "Cookie": ["c"], "Content-Type": ["json"], "cookie": ["kept"]},), (None,)], "h map<string,array<string>>")
    out = df.select(X.rewrite_headers("h", {"Authorization": "new"}, {"X-Trace-Run": "1", "Content-Type": "text"}, ["Cookie"]).alias("h")).collect()
    assert out[0].h == {"Authorization": ["new"], "Content-Type": ["json", "text"], "X-Trace-Run": ["1"], "cookie": ["kept"]}
    assert out[1].h == {"Authorization": ["new"], "Content-Type": ["text"], "X-Trace-Run": ["1"]}
    red = df.select(X.redact("h", X.redaction_list("X-Mine, ")).alias("h")).first().h
    assert red["Authorization"] == ["[REDACTED]"] and red["cookie"] == ["[REDACTED]"] and red["Content-Type"] == ["json"]
    assert X.redaction_list("none") == [] and "x-mine" in X.redaction_list("X-Mine")
    assert one(spark, X.canonical_header("a"), a="x-request-ID") == "X-Request-Id"


@pytest.mark.parametrize(
    "host, patterns, want",
    [("a.b", [], True), ("api.local", ["api.local"], True), ("API.local", ["api.LOCAL"], True), ("api.local.", ["api.local"], True), ("api.zone.example", ["*.zone.example"], True), ("a.b.zone.example", ["*.zone.example"], True), ("zone.example", ["*.zone.example"], False), ("notzone.example", ["*.zone.example"], False), ("x", [""], False)],
)
def test_hosts(spark, host, patterns, want):
    assert one(spark, X.host_allowed("h", patterns), h=host) is want


def test_names_and_texts(spark):
    assert [one(spark, X.object_prefix("p", "c"), p=p, c=c) for p, c in (("", ""), ("", "c"), ("prefix", "c"), ("/prefix/", "c"), ("prefix", ""))] == ["", "c/", "prefix/c/", "prefix/c/", "prefix/"]
    k = one(spark, X.parse_object_key("k"), k="shop/checkout/2026-03-15/agent-a-000001.jsonl.gz")
    assert (k.capture_id, k.day, k.pod, k.seq) == ("shop/checkout", dt.date(2026, 3, 15), "agent-a", 1)
    assert one(spark, X.object_key("c", "d", "p", "s"), c="ns/n", d="2026-01-01", p=" ", s=7) == "ns/n/2026-01-01/unknown-agent-000007.jsonl.gz"
    assert tuple(one(spark, X.split_capture_id("c"), c="alone")) == ("", "alone") and tuple(one(spark, X.split_capture_id("c"), c="ns/a/b")) == ("ns", "a/b")
    for text, ns in (("42ms", 42_000_000), ("1.5s", 1_500_000_000), ("1m0s", 60_000_000_000), ("1h2m3.004s", 3_723_004_000_000), ("-3us", -3000), ("0", 0), ("5", None), ("abc", None), ("", None)):
        assert one(spark, X.duration_ns("t"), t=text) == ns, text
    for ms, text in ((0, "0s"), (42, "42ms"), (1500, "1.5s"), (2000, "2s"), (60_000, "1m0s"), (61_250, "1m1.25s"), (3_723_004, "1h2m3.004s")):
        assert one(spark, X.latency_text("m"), m=ms) == text
    assert one(spark, X.parse_pairs("t"), t=" a = 1=2 ,novalue,b=, =x,a=3") == {"a": "3", "b": "", "": "x"}
    assert [one(spark, X.rate_mode("m"), m=m) for m in ("", "Recorded", "constant", "MAX", "odd")] == [None, "original", "constant", "unlimited", None]
    assert [one(spark, X.error_category("e"), e=e) for e in ("", "context canceled", "context deadline exceeded", "read timeout", "EOF", "unexpected EOF", "odd")] == ["", "canceled", "deadline_exceeded", "timeout", "connection_closed", "unknown", "unknown"]
    assert one(spark, X.target_url("h", F.lit(None).cast("int"), F.lit(True)), h="x") == "https://x:443" and one(spark, X.target_url("h", "p", F.lit(False)), h="x", p=8080) == "http://x:8080"
    assert [one(spark, X.relative_age("s"), s=s) for s in (5, 180, 7200, 200_000)] == ["5s ago", "3m ago", "2h ago", "55h ago"]


def test_header_filters_of_json(spark):
    texts = [" ", '[{"name": "x-debug", "value": "true"}]', '[{"name": " "}]', "not json", None]
    got = [r.x for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.header_filters("t").alias("x")).collect()]
    assert [r.fault for r in got] == [None, None, "name is required", "not JSON", None]
    assert got[0].filters == [] and tuple(got[1].filters[0]) == ("x-debug", "true")


def test_selection(spark, requests):
    hour = dt.timedelta(hours=1)
    n = lambda c: requests.where(c).count()
    assert n(S.path_prefix("/api/1")) == 111 and n(S.path_prefix("/API")) == 0 and n(S.path_prefix("")) == 200
    assert n(S.methods(["get"])) == 200 and n(S.methods(["POST"])) == 0 and n(S.methods([])) == 200
    assert n(S.in_time(BASE - hour, BASE + hour)) == 200 and n(S.in_time(BASE + hour, None)) == 0 and n(S.in_time(None, BASE)) == 1
    days = spark.createDataFrame([(None,), *[(dt.date(2026, 1, d),) for d in (14, 15, 16, 17, 18)]], "capture_date date")
    kept = [r.capture_date for r in days.where(S.by_day(dt.datetime(2026, 1, 15, 5), dt.datetime(2026, 1, 17, 1))).collect()]
    assert kept == [None, *[dt.date(2026, 1, d) for d in (15, 16, 17)]]
    assert n(S.sampled(100)) == 200 and n(S.sampled(-3)) == 0 and 70 < n(S.sampled(50)) < 130


def test_shards(spark, requests):
    sharded = S.with_shard(requests, 4)
    counts = {r.shard: r.n for r in S.shard_counts(sharded, 4).collect()}
    assert sum(counts.values()) == 200 and min(counts.values()) > 0
    assert S.not_disjoint(sharded).isEmpty() and S.not_covered(requests, sharded).isEmpty()
    assert sum(requests.where(S.shard_owns(i, 4)).count() for i in range(4)) == 200
    assert requests.where(S.shard_owns(0, 1)).count() == 200
    for i in (4, -1, 100):
        with pytest.raises(ValueError):
            S.shard_owns(i, 4)


def test_bodies(requests):
    for most, flag, length in ((5, "true", 5), (14, None, 14), (100, None, 14)):
        r = T.truncate_body(requests, most).first()
        assert len(r.body) == r.contentLength == length and r.metadata.get("bodyTruncated") == flag and r.metadata["host"] == "a"


@pytest.mark.parametrize("mode", ["drop", "skip", "abort"])
def test_row_chain_errors(requests, mode):
    def fail(row):
        if row["path"].endswith("7"):
            raise ValueError
        return row

    df = requests.select("id", "path")
    out = T.row_chain(df, [fail], mode)
    if mode == "abort":
        with pytest.raises(Exception, match="ValueError"):
            out.collect()
    else:
        assert out.where("not filtered").count() == (180 if mode == "drop" else 200)
    with pytest.raises(ValueError):
        T.row_chain(df, [], "ignore")


def test_registry():
    with pytest.raises(KeyError):
        T.build("nothing")
    with pytest.raises(ValueError):
        T.register("redact")(lambda: None)


def test_summary(spark):
    rows = [("a", 200, 10_000_000, None, 1, BASE), ("b", 200, 20_000_000, None, 1, BASE + dt.timedelta(seconds=1)), ("c", 500, 5_000_000, None, 1, BASE + dt.timedelta(seconds=2)), ("d", 0, 0, "timeout", 0, BASE + dt.timedelta(seconds=3))]
    df = spark.createDataFrame(rows, schemas.RESULT)
    r = A.summarize(df).first()
    assert (r.total, r.success, r.errors, r.duration_ns, r.mean_ns, r.p50, r.p95, r.p99) == (4, 3, 1, 3_000_000_000, 8_750_000, 5_000_000, 10_000_000, 10_000_000)
    empty = A.summarize(df.limit(0)).first()
    assert all(v == 0 for v in empty.asDict().values())
    report = A.run_report(A.summarize(df)).first()
    assert (report.durationMs, report.achievedRPS, report.meanLatencyMs, report.p50LatencyMs) == (3000, 1.0, 8, 5)


def test_percentiles_are_exact_in_every_bucket_width(spark):
    values = [((i * 7919) % 1000, "ab"[i % 2]) for i in range(501)]
    df = spark.createDataFrame(values, "v long, k string")
    want = {k: sorted(v for v, x in values if x == k) for k in "ab"}
    for width in (1, 13, 10_000):
        for r in A.percentiles(df, ["k"], "v", (0.0, 0.5, 0.95, 1.0), width).collect():
            s = want[r.k]
            assert (r.p0, r.p50, r.p95, r.p100) == tuple(s[int((len(s) - 1) * p)] for p in (0.0, 0.5, 0.95, 1.0))


def test_script_and_call_reports(spark, tmp_path):
    from wirelake.sources import lake

    (tmp_path / "k.json").write_text('{"metrics": {"http_reqs": {"count": 120, "rate": 42.5}, "http_req_failed": {"passes": 6}, "http_req_duration": {"avg": 12.4, "med": 10.0, "p(95)": 30.2, "p(99)": 55.9}}}')
    r = A.script_summary(lake.read_script_exports(spark, str(tmp_path / "k.json"))).first()
    assert (r.sent, r.failed, r.rps, r.mean_ms, r.p50_ms, r.p95_ms, r.p99_ms) == (114, 6, 42.5, 12, 10, 30, 55)
    (tmp_path / "g.json").write_text('{"count": 50, "average": 8000000, "rps": 20, "latencyDistribution": [{"percentage": 50, "latency": 6000000}, {"percentage": 95, "latency": 20000000}, {"percentage": 99, "latency": 41000000}], "errorDistribution": {"unavailable": 2}}')
    calls = A.call_summary(lake.read_call_reports(spark, str(tmp_path / "g.json"))).withColumn("run", F.lit(1))
    r = A.methods_rollup(calls.unionByName(calls), ["run"]).first()
    assert (r.total, r.failed, r.sent, r.p50_ms, r.p95_ms, r.p99_ms, r.mean_ms) == (100, 4, 96, 6, 20, 41, 8)


def status(spark, rows):
    ddl = "spoke_id string, load_test_namespace string, load_test_name string, phase string, total_requests long, sent_requests long, failed_requests long, filtered_requests long, achieved_rps double"
    return spark.createDataFrame([(s, "ns", "lt", p, a, b, c, 0, r) for s, p, a, b, c, r in rows], ddl)


@pytest.mark.parametrize("phases, want", [(("RUNNING", "RUNNING"), "Running"), (("COMPLETED", "COMPLETED"), "Completed"), (("COMPLETED", "FAILED"), "Failed")])
def test_load_test_rollup(spark, phases, want):
    df = status(spark, [("s-17", phases[0], 600, 500, 5, 50.0), ("s-42", phases[1], 500, 400, 10, 40.0)])
    r = L.load_test_rollup(df).select("*", L.phase(F.lit(2)).alias("phase"), L.phase(F.lit(0)).alias("none")).first()
    assert (r.sent, r.failed, r.rps, r.phase) == (900, 15, "90.0", want) and r.none == "Running"
    spokes = spark.createDataFrame([("s-17", "north"), ("s-42", "south")], "spoke_id string, cell string")
    assert {x.cell: x.sent for x in L.by_cell(df, spokes).collect()} == {"north": 500, "south": 400}


@pytest.mark.parametrize(
    "sent, failed, phase, elapsed, policy, want",
    [(900, 100, "Running", 10, (None, 5, None), "error rate 10.0% exceeded abort threshold 5%"), (900, 100, "Running", 10, (None, 5, 10_000), None), (900, 100, "Running", 7200, (3600, 5, None), "run exceeded maxDuration 1h0m0s (elapsed 2h0m0s)"), (900, 100, "Completed", 7200, (3600, 5, None), None), (900, 100, "Running", 7200, (None, None, None), None), (50, 49, "Running", 1, (None, 5, None), None)],
)
def test_abort(spark, sent, failed, phase, elapsed, policy, want):
    ddl = "sent long, failed long, phase string, elapsed_s long, policy struct<max_duration_s:long,error_percent:int,min_sample_requests:long>"
    assert spark.createDataFrame([(sent, failed, phase, elapsed, policy)], ddl).select(L.should_abort()).first()[0] == want


def test_rates_of_shards(spark):
    parts = spark.range(7).select(L.split_rate(F.lit(1000), F.lit(7), F.col("id")).alias("r"))
    assert parts.agg(F.sum("r")).first()[0] == 1000
    assert one(spark, L.split_rate(F.lit(2), F.lit(8), F.lit(5))) == 1 and one(spark, L.split_rate(F.lit(9), F.lit(0), F.lit(0))) == 9


def test_orphans(spark):
    rows = [("live", "evening", 3600), ("gone", "retired", 3600), ("new", "retired", 1), ("alone", None, 3600)]
    df = spark.createDataFrame([(r, t, BASE - dt.timedelta(seconds=s)) for r, t, s in rows], "replay string, load_test_name string, created_at timestamp")
    active = spark.createDataFrame([("evening",)], "load_test_name string")
    assert [r.replay for r in L.orphans(df, active, F.lit(BASE)).collect()] == ["gone"]
    assert sorted(r.replay for r in L.orphans(df, active.limit(0), F.lit(BASE)).collect()) == ["gone", "live"]


def test_cells(spark):
    spokes = spark.createDataFrame([("s-17", "north"), ("s-23", "north"), ("s-42", "south"), ("x", "")], "spoke_id string, cell string")
    beats = spark.createDataFrame([(s, BASE - dt.timedelta(seconds=age), 1, 1) for s, age in (("s-17", 10), ("s-23", 90), ("s-42", 180))], "spoke_id string, ts timestamp, active_captures long, seq long")
    none = spark.createDataFrame([], "spoke_id string, phase string")
    out = [(r.cell, r.spokes, r.connected) for r in L.cells(spokes, L.liveness(beats, F.lit(BASE)), none, none).collect()]
    assert out == [("", 1, 0), ("north", 2, 2), ("south", 1, 0)]


def test_catalog(spark):
    ddl = "id string, status string, started_at timestamp, completed_at timestamp, error string, updated_at timestamp"
    later = BASE + dt.timedelta(hours=1)
    old = spark.createDataFrame([("a", "running", BASE, None, "e", BASE), ("b", "running", None, None, None, BASE)], ddl)
    new = spark.createDataFrame([("a", "done", later, later, "", later), ("c", "", None, None, None, later), (" ", "x", None, None, None, later)], ddl)
    got = {r.id: (r.status, r.started_at, r.completed_at, r.error) for r in L.upsert_captures(old, new).collect()}
    assert got == {"a": ("done", BASE, later, None), "b": ("running", None, None, None), "c": ("pending", None, None, None)}


def test_schedules(spark):
    offsets = [0, 50, 60, 40, 240]
    df = spark.createDataFrame([(str(i), 0, BASE + dt.timedelta(milliseconds=o), "k", i) for i, o in enumerate(offsets)], "id string, shard int, timestamp timestamp, object_key string, line int")
    ms = lambda d, c: [r[c] // 1_000_000 for r in d.orderBy("line").collect()]
    assert ms(W.gaps(df), "gap_ns") == [0, 50, 10, -20, 200]
    assert ms(W.original_timing(df), "send_offset_ns") == [0, 50, 60, 60, 260] and ms(W.original_timing(df, 0.5), "send_offset_ns") == [0, 25, 30, 30, 130] and ms(W.original_timing(df, -1), "send_offset_ns") == [0, 50, 60, 60, 260]
    assert ms(W.constant_rate(df, 20), "send_offset_ns") == [50, 100, 150, 200, 250]
    assert ms(W.source_offsets(df), "source_offset_ns") == offsets
    assert [r.batch for r in W.batches(df, 2).orderBy("line").collect()] == [0, 0, 1, 1, 2]
    keys = spark.createDataFrame([(k,) for k in "abcd"], "object_key string")
    assert [W.resume_after(keys, k).count() for k in ("", "a", "b", "d", "aa", "z")] == [4, 3, 2, 0, 3, 0]


def test_checks(spark):
    m = spark.createDataFrame([("a", 0, 1, 5), ("a", 1, 2, 5), ("a", 2, 0, 5), ("a", 3, 1, -1), ("a", 4, 1, 6)], "capture_id string, shard_index int, format_version int, record_count long")
    n = spark.createDataFrame([("a", i, 5) for i in range(5)], "capture_id string, shard_index int, n long")
    got = sorted((r.shard_index, r.fault) for r in D.manifest_faults(m, n).collect())
    assert got == [(1, "unsupported version"), (2, "bad version"), (3, "negative count"), (3, "record count differs"), (4, "record count differs")]
    s = spark.createDataFrame([("x", 0), ("x", 1), ("y", 0), ("z", 0), ("z", 0), ("z", 1)], "t string, shard_index int")
    assert {(r.t, r.fault) for r in D.dense_faults(s, "t", 2).collect()} == {("y", "missing"), ("z", "duplicate")}
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert {(r.id, r.fault) for r in D.exactly_once(ids("a", "b", "c"), ids("a", "c", "c", "d")).collect()} == {("b", "not sent"), ("c", "sent again"), ("d", "not captured")}


def test_pipeline_constraints(spark):
    rules = spark.createDataFrame([("a", ["b"], ["c"], [], [("gpu", "exclusive")]), ("b", [], [], [], [("gpu", "shared")]), ("c", [], [], ["b"], [("gpu", "shared")])], "plugin string, conflicts array<string>, before array<string>, after array<string>, resources array<struct<name:string,access:string>>")
    steps = spark.createDataFrame([("p", i, x) for i, x in enumerate("cab")] + [("q", 0, "b"), ("q", 1, "c"), ("r", 0, "nope")], "pipeline string, position int, plugin string")
    got = {tuple(r) for r in D.pipeline_faults(steps, rules).collect()}
    assert got == {("p", "order", "c before a"), ("p", "conflict", "a b"), ("p", "order", "c before b"), ("p", "resource", "a c gpu"), ("p", "resource", "a b gpu"), ("r", "unknown", "nope")}


def test_datasets(spark, requests):
    df = N.normalize(requests.withColumn("capture_id", F.lit("c"))).withColumn("bytes", F.col("body_ref.length"))
    assert df.agg(F.max("offset_ns")).first()[0] == 199 * N.SECOND
    index = N.bundle_index(N.bundles(df, 14 * 4, 10 * N.SECOND)).collect()
    assert sum(r.n for r in index) == 200 and max(r.n for r in index) == 4 and max(r.last_ns - r.first_ns for r in index) < 10 * N.SECOND
    buckets = N.time_buckets(df.where("offset_ns < 5e9 or offset_ns > 100e9"), N.SECOND)
    assert buckets.count() == 200 and buckets.agg(F.sum("n")).first()[0] == df.where("offset_ns < 5e9 or offset_ns > 100e9").count()
    assert N.bad_runs(buckets, F.col("n") == 0, 3, ["capture_id"]).collect()[0].n == 96
    assert N.leases(buckets, 20).agg(F.sum("expected")).first()[0] == 104
    assert N.scale_rate(requests, 3).count() == 600 and N.scale_rate(requests, 3).select("id").distinct().count() == 600
    gaps = spark.createDataFrame([("p", i) for i in (1, 2, 5, 6, 9)], "pod string, seq long")
    assert sorted(tuple(r)[1:] for r in N.sequence_gaps(gaps, ["pod"]).collect()) == [(3, 4), (7, 8)]


def test_lake(spark, requests, tmp_path):
    import gzip

    from wirelake.sources import lake

    root = str(tmp_path)
    lake.write_capture(requests, root, "ns/cap", 60)
    day = tmp_path / "ns/cap/day=2026-01-15"
    with gzip.open(day / "zz-000009.jsonl.gz", "wt") as f:
        f.write('{"id":"x","timestamp":"2026-01-15T12:00:00Z","method":"GET","path":"/p","body":"/w=="}\nnot json\n{"id":"y","timestamp":"2026-01-16T00:00:00Z"}\n')
    (tmp_path / "ns/cap/manifest.json").write_text('{"formatVersion": 1, "captureID": "ns/cap", "recordCount": 202, "createdAt": "2026-01-15T00:00:00Z"}')
    got = lake.read_capture(spark, root, "ns/cap")
    assert got.count() == 202 and got.where("id = 'x'").first().body == b"\xff"
    assert lake.read_capture(spark, root, "ns/cap", BASE, BASE + dt.timedelta(seconds=9)).count() == 10
    bad = lake.rejects(spark, root, "ns/cap").collect()
    assert [(r.line, r.text) for r in bad] == [(1, "not json")] and bad[0].object_key.endswith("zz-000009.jsonl.gz")
    assert lake.read_manifests(spark, f"{root}/ns/*/manifest.json").first().recordCount == 202
    counts = lake.write_shards(requests, root, "ns/cap2", 3)
    assert counts.agg(F.sum("n")).first()[0] == 200
    assert sorted(r.id for i in range(3) for r in lake.read_slice(spark, root, "ns/cap2", i, 3).select("id").collect()) == sorted(r.id for r in requests.select("id").collect())
    assert not lake.is_empty(got) and lake.is_empty(got.limit(0))
    with pytest.raises(ValueError):
        lake.write_shards(requests, root, "x", 1)


def test_days_outside_a_range_are_not_opened(spark, requests, tmp_path):
    """Objects of other days aren't gzip at all here, so that opening one fails; a missing manifest is no row."""
    from wirelake.sources import lake

    root = str(tmp_path)
    lake.write_capture(requests, root, "ns/cap", 60)
    for day in ("day=2026-01-13", "2026-01-14", "day=2026-01-18"):
        (tmp_path / "ns/cap" / day).mkdir(parents=True)
        (tmp_path / "ns/cap" / day / "agent-000001.json.gz").write_bytes(b"no gzip")
    got = lake.read_capture(spark, root, "ns/cap", BASE, BASE + dt.timedelta(seconds=9))
    assert got.count() == 10 and {str(r.capture_date) for r in got.collect()} == {"2026-01-15"}
    found = lake.inventory(spark, root).select("of.*").collect()
    assert {(r.capture_id, str(r.day)) for r in found} >= {("ns/cap", "2026-01-13"), ("ns/cap", "2026-01-14"), ("ns/cap", "2026-01-15")}
    assert lake.find_manifests(spark, f"{root}/nowhere/manifest.json").count() == 0
    said = spark.createDataFrame([(1, "ns/cap", 0)], "formatVersion int, captureID string, recordCount long")
    assert lake.is_empty(got, said) and not lake.is_empty(got, said.limit(0))


def test_row_chain_keeps_longs_maps_and_failed_rows(spark):
    df = spark.createDataFrame([(2**60 + 1, {"a": ["x"]}), (None, None)], "n long, h map<string,array<string>>")

    def spoil(row):
        row["n"] = 5
        row["h"]["a"].append("y")
        raise ValueError

    out = T.row_chain(df, [spoil], "skip").collect()
    assert [(r.n, r.h, r.filtered) for r in out] == [(2**60 + 1, {"a": ["x"]}, False), (None, None, False)]


def test_handled_results_meet_as_partial_rows(spark):
    import pandas as pd

    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id").repartition(5)
    part = lambda r: pd.DataFrame({"k": [r["k"].iloc[0]], "s": [r["id"].sum()]})
    got = A.handled(df, ["k"], part, "k long, s long", part_sum := lambda r: pd.DataFrame({"k": [r["k"].iloc[0]], "total": [r["s"].sum()]}), "k long, total long")
    assert part_sum and {r.k: r.total for r in got.collect()} == {k: sum(range(k, 1000, 3)) for k in range(3)}


def test_stream_restarts_where_it_stopped(spark, requests, tmp_path):
    from wirelake.streaming import jobs

    landing, out, at = (str(tmp_path / x) for x in ("landing", "out", "checkpoint"))
    for part in (requests.where("id < 'req-00100'"), requests.where("id >= 'req-00100'")):
        part.write.mode("append").json(landing)
        stream = jobs.prepared(jobs.requests(spark, landing), S.path_prefix("/api"), 5)
        jobs.ingest(stream, out, at, None).awaitTermination()
    rows = spark.read.schema(schemas.REQUEST).json(out).collect()
    assert sorted(r.id for r in rows) == sorted(r.id for r in requests.collect()) and all(r.contentLength == 5 for r in rows)


def test_counters_are_observed(spark, requests):
    from pyspark.sql import Observation
    from wirelake.streaming import jobs

    seen = Observation("capture")
    jobs.counted(requests, S.path_prefix("/api/1"), seen).count()
    assert seen.get == {"total": 200, "filtered": 89, "bytes": 2800}


def test_apply_report(spark):
    rows = [(100, 90, 10, 7, 2000, 45.04, 12, 42, 1500, 60000), (0, 0, 0, 0, 0, 0.0, 0, 0, 0, 0)]
    out = [tuple(r) for r in A.apply_report(spark.createDataFrame(rows, schemas.REPORT)).collect()]
    assert out == [(107, 90, 10, 7, "45.0", "42ms", "1.5s", "1m0s"), (0, 0, 0, 0, None, None, None, None)]


def test_plans_have_no_cartesian_product_and_push_filters(spark):
    from wirelake.plans.catalog import QUERIES

    sf = "/root/testdata/sf0.001"
    for name in ("flagship_latency_by_method", "run_summary", "route_breakdown", "load_test_cells", "bucket_health", "request_gaps"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "BatchEvalPython" not in plan, name
        assert "ReadSchema" in plan and "props" not in plan.split("ReadSchema")[1].split("\n")[0] or name in ("run_summary", "route_breakdown", "bucket_health", "flagship_latency_by_method"), name
