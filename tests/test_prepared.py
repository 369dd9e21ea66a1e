"""Bundles as files, sampling within buckets, and rules over buckets."""

import gzip
import hashlib
import json
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from wirelake.plans import prepare as N
from wirelake.sources import bundles as files

KIND = "capture_id string, id string, offset_ns long, route_key string, text string"


@pytest.fixture(scope="module")
def records(spark):
    r, rows = random.Random(6), []
    for c, n in (("big", 900), ("small", 7), (None, 2)):
        for i in range(n):
            rows.append((c, f"{c}-{i}", r.randrange(40) * 10**9 + r.randrange(10**9), r.choice(["GET /", "PUT /é", None]), "x" * r.choice([1, 30, 700])))
    rows.append(("big", "huge", 5 * 10**9, "GET /", "y" * 20_000))
    return spark.createDataFrame(rows, KIND).repartition(5).cache(), rows


def test_bundles_keep_their_bounds_and_their_index(spark, records, tmp_path):
    df, rows = records
    files.write_bundles(df, str(tmp_path), 4_000, 6_000, 10 * 10**9, 10**9, 10.0, 1.5)
    index, at = files.read_index(spark, str(tmp_path)).collect(), defaultdict(dict)
    assert sum(r.n for r in index) == len(rows) and len({r.bundle_id for r in index}) == len(index) > 30
    for r in index:
        data = (tmp_path / r.uri).read_bytes()
        lines = gzip.decompress(data).splitlines(keepends=True)
        found = [json.loads(x) for x in lines]
        assert hashlib.sha256(data).hexdigest() == r.sha256 and len(data) == r.compressed_bytes and sum(map(len, lines)) == r.bytes and len(lines) == r.n
        assert r.bytes <= 6_000 or r.n == 1
        assert r.bytes - len(lines[-1]) < 4_000
        offsets = [x["offset_ns"] for x in found]
        assert offsets == sorted(offsets) and (offsets[0], offsets[-1]) == (r.first_ns, r.last_ns) and offsets[0] // 10**10 == offsets[-1] // 10**10
        assert r.routes == Counter(x.get("route_key", "") for x in found)
        assert {b.bucket: b.n for b in r.buckets} == Counter(o // 10**9 for o in offsets)
        for b in r.buckets:
            at[r.capture_id, b.bucket][r.bundle_id] = b.n
    buckets = {(r.capture_id, r.bucket): r for r in files.read_buckets(spark, str(tmp_path)).collect()}
    want = Counter((c or "", o // 10**9) for c, _, o, _, _ in rows)
    assert {k: r.n for k, r in buckets.items()} == want and {k: {b.bundle_id: b.n for b in r.bundles} for k, r in buckets.items()} == at
    assert all(r.required_agents == -(-r.n * 15 // 100) for r in buckets.values())
    said = json.loads((tmp_path / "manifest.json").read_text())
    assert (said["recordCount"], said["bundleCount"]) == (len(rows), len(index))
    assert files.bundle_faults(spark, str(tmp_path)).count() == 0


def test_bundles_make_a_folder_once_and_return_many_rows_at_a_time(spark, records, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "INDEX_ROWS", 7)
    files.write_bundles(records[0], str(tmp_path), 400, 600, 10 * 10**9, 10**9)
    index = files.read_index(spark, str(tmp_path)).collect()
    assert sum(r.n for r in index) == len(records[1]) and len({r.uri for r in index}) == len(index) > 70
    assert files.bundle_faults(spark, str(tmp_path)).count() == 0
    assert [files.lines_of(gzip.compress(x)) for x in (b"", b"a\n", b"a\nb")] == [0, 1, 2]
    store = files.Store(str(tmp_path))
    store.write("a/b/1", b"")
    monkeypatch.setattr(store, "fs", type("Fs", (), {"open_output_stream": store.fs.open_output_stream}))  # makes no folders
    store.write("a/b/2", b"x")
    assert (tmp_path / "a/b/2").read_bytes() == b"x"


def test_a_lookup_opens_only_its_bundles(spark, records, tmp_path):
    df, rows = records
    files.write_bundles(df, str(tmp_path), 4_000, 6_000, 10 * 10**9, 10**9)
    wanted = set(files.uris_of(spark, str(tmp_path), "big", 3, 5))
    others = [r.uri for r in files.read_index(spark, str(tmp_path)).collect() if r.uri not in wanted]
    for uri in others:
        (tmp_path / uri).write_bytes(b"no gzip")  # opening it fails
    got = files.read_records(spark, str(tmp_path), KIND.replace("capture_id string, ", ""), "big", 3, 5, 10**9)
    assert sorted(r.id for r in got.collect()) == sorted(i for c, i, o, _, _ in rows if c == "big" and 3 <= o // 10**9 <= 5)
    assert others and files.read_records(spark, str(tmp_path), "id string, offset_ns long", "big", 900, 901).count() == 0
    faults = {r.bundle_id: r.fault for r in files.bundle_faults(spark, str(tmp_path)).collect()}
    assert len(faults) == len(others) and set(faults.values()) == {"sha256 differs"}


def test_a_dataset_without_records_has_a_manifest(spark, records, tmp_path):
    files.write_bundles(records[0].limit(0), str(tmp_path))
    assert json.loads((tmp_path / "manifest.json").read_text())["recordCount"] == 0 and files.read_buckets(spark, str(tmp_path)).count() == 0


def test_no_manifest_before_all_else_is_written(spark, records, tmp_path, monkeypatch):
    files.write_bundles(records[0], str(tmp_path))
    monkeypatch.setattr(files, "bucket_index", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        files.write_bundles(records[0], str(tmp_path))
    assert not (tmp_path / "manifest.json").exists()


@pytest.mark.parametrize("factor", [0.0, 0.001, 0.37, 1.0, 1.5, 2.25])
@pytest.mark.parametrize("cells", [1, 16, 4096])
def test_each_bucket_keeps_its_share(records, factor, cells):
    df, rows = records
    got = [r.id for r in N.scale_rate_by_bucket(df, factor, 10**10, cells=cells).collect()]
    assert len(got) == len(set(got))
    bucket = {i: (c, o // 10**10) for c, i, o, _, _ in rows}
    kept, all_ = Counter(bucket[x.split("~")[0]] for x in got), Counter(bucket.values())
    for b, n in all_.items():
        assert kept[b] == int(factor) * n + int(n * (factor - int(factor)) + 0.5)
    smallest = defaultdict(list)
    for i, b in bucket.items():
        smallest[b].append((int(hashlib.md5(i.encode()).hexdigest()[:8], 16), i))
    times = Counter(x.split("~")[0] for x in got)
    for b, x in smallest.items():
        more = int(len(x) * (factor - int(factor)) + 0.5)
        assert [times[i] for _, i in sorted(x)] == [int(factor) + (k < more) for k in range(len(x))]


def test_rules_over_buckets(spark):
    sent = []
    for b in range(12):
        for i in range(20):
            sent.append(("run", b * 10 + i % 10, 9_000 if b in (2, 3, 4, 8) and i > 17 else 10, "EOF" if b in (5, 6) and i < 2 else None, 503 if b == 9 and i < 5 else 200))
    df = spark.createDataFrame(sent, "run string, planned_ns long, lag_ns long, error string, status_code int")
    metrics = N.bucket_metrics(df, 10, ["run"], width=100)
    got = {tuple(r) for r in N.abort_reasons(metrics, ["run"], 0.2, 0.05, 5_000, 2).collect()}
    assert got == {("run", "failures", 5, 2), ("run", "lag", 2, 3), ("run", "server errors", 9, 1)}
    assert {tuple(r)[1:] for r in N.abort_reasons(metrics, ["run"], None, 0.05, 5_000, 3).collect()} == {("lag", 2, 3)}
    expected = spark.createDataFrame([("run", b, 20 if b != 7 else 25) for b in range(14)], "run string, bucket long, n long")
    met = {r.bucket: (r.actual, r.count_met, r.lag_met) for r in N.bucket_success(expected, metrics, 0.1, 5_000, ["run"]).collect()}
    assert met == {b: (20 if b < 12 else 0, b not in (7, 12, 13), b not in (2, 3, 4, 8)) for b in range(14)}


def test_leases_that_fall_silent(spark):
    rows = [("a", t) for t in (0, 10, 40, 71, 80)] + [("b", 100), (None, 0), (None, 200)]
    df = spark.createDataFrame(rows, "lease string, t long").withColumn("ts", F.timestamp_seconds("t"))
    got = {tuple(r) for r in N.silent_leases(df, F.timestamp_seconds(F.lit(115)), ["lease"], 30, block_s=20).collect()}
    assert got == {("a", 40_000_000, 31.0), ("a", 80_000_000, 35.0), (None, 0, 200.0)}
