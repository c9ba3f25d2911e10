"""Streams give what the batch gives, and sources and sinks round-trip."""

import numpy as np
import pytest

from lidarloom.operators import imu, keyframes, mapping, observer
from lidarloom.params import Params, schema
from lidarloom.sources import tables
from lidarloom.streaming import stateful

from .test_motion import IMU, circle, imu_rows, pose_rows, yaw


def feed(spark, df, path, order, files=4):
    """df as a stream of `files` micro-batches in order."""
    rows = df.orderBy(order).collect()
    step = -(-len(rows) // files)
    for k in range(files):
        spark.createDataFrame(rows[k * step : (k + 1) * step], df.schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(path))


def drain(spark, stream, name, tmp_path):
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"c-{name}")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return spark.table(name)


def test_calibration(spark, tmp_path):
    i = spark.createDataFrame([("d", k * 10_000_000, 0.1, 0.2, 0.3, 1.0, 2.0, float(k % 3)) for k in range(400)], IMU)
    got = drain(spark, stateful.streaming_calibration(feed(spark, i, tmp_path / "i", "stamp_ns")), "calibration", tmp_path).collect()
    want = imu.calibrate_imu(i).first()
    assert len(got) == 1 and got[0].n == want.n == 300
    assert all(np.allclose(got[0][c], want[c], atol=1e-9) for c in stateful.CALIBRATED)


def test_observer(spark, tmp_path):
    i = spark.createDataFrame(imu_rows(0, 2, 100), IMU)
    p = spark.createDataFrame([("d", k * 10**8, *circle(k / 10)[0].tolist(), *circle(k / 10)[1].tolist()) for k in range(20)], "drive_id string, stamp_ns long, px double, py double, pz double, qw double, qx double, qy double, qz double")
    stream = stateful.streaming_observer(feed(spark, i, tmp_path / "i", "stamp_ns"), feed(spark, p, tmp_path / "p", "stamp_ns"), Params(), 500_000_000)
    rows = drain(spark, stream, "observer", tmp_path).collect()
    got = {(r.stamp_ns, r.kind): r for r in rows if r.status == "ok"}
    want = {(r.stamp_ns, r.kind): r for r in observer.observe(i, p).collect()}
    # each event is folded, late, or still within the delay of the newest
    newest = max(x for x, _ in want)
    settled = {x for x in want if x[0] <= newest - 500_000_000}
    late = {(r.stamp_ns, r.kind) for r in rows if r.status == "late"}
    assert not late and settled <= set(got)
    assert all(abs(r.px - want[k].px) < 1e-9 and abs(r.qz - want[k].qz) < 1e-9 for k, r in got.items())


def test_late_events_are_told(spark, tmp_path):
    stamps = [0, 10, 20, 2000, 2010, 15, 2020, 5000]  # in hundredths of a second; 15 comes after its time
    i = spark.createDataFrame([(k, "d", s * 10_000_000, 0.0, 0.0, 0.0, 0.0, 0.0, 9.8) for k, s in enumerate(stamps)], "k long, drive_id string, stamp_ns long, wx double, wy double, wz double, ax double, ay double, az double")
    p = spark.createDataFrame([("d", 0, *[0.0] * 3, 1.0, *[0.0] * 3)], "drive_id string, stamp_ns long, px double, py double, pz double, qw double, qx double, qy double, qz double")
    p.write.parquet(str(tmp_path / "p"))
    poses = spark.readStream.schema(p.schema).parquet(str(tmp_path / "p"))
    rows = drain(spark, stateful.streaming_observer(feed(spark, i, tmp_path / "i", "k", 8), poses), "late", tmp_path).collect()
    assert [(r.stamp_ns, r.px) for r in rows if r.status == "late"] == [(150_000_000, None)]


def test_keyframes(spark, tmp_path):
    p = pose_rows(spark, [((k * 0.4, 0, 0), yaw(k * 20)) for k in range(20)])
    got = drain(spark, stateful.streaming_keyframes(feed(spark, p, tmp_path / "p", "stamp_ns")), "keyframes", tmp_path)
    want = keyframes.select_keyframes(p)
    key = ["kf_id", "scan_id"]
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, want.select(*key).collect()))


def test_ema(spark, tmp_path):
    d = spark.createDataFrame([("d", k, float(k * k)) for k in range(12)], "drive_id string, scan_id long, v double")
    got = drain(spark, stateful.streaming_ema(feed(spark, d, tmp_path / "d", "scan_id"), "v"), "ema", tmp_path)
    want = imu.ema(d, "v", "ema", "scan_id")
    assert [r.ema for r in got.orderBy("scan_id").collect()] == [r.ema for r in want.orderBy("scan_id").collect()]


def test_sync(spark, tmp_path):
    rows = [("d", "scan", 0, 7, 5), ("d", "imu", 10, None, None), ("d", "imu", 20, None, None), ("d", "scan", 12, 8, 25), ("d", "imu", 30, None, None), ("d", "scan", 31, 9, 99)]
    e = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k long, drive_id string, kind string, stamp_ns long, scan_id long, end_ns long")
    got = drain(spark, stateful.sync_scans(feed(spark, e, tmp_path / "e", "k", 3)), "sync", tmp_path)
    assert sorted(map(tuple, got.select("scan_id", "status", "n_samples").collect())) == [(7, "no_imu", 0), (8, "ok", 3)]
    # a scan without samples does not wait for ever
    later = [(6, "d", "scan", 10**12, 10, 10**12 + 5)]
    e = e.unionByName(spark.createDataFrame(later, e.schema))
    got = drain(spark, stateful.sync_scans(feed(spark, e, tmp_path / "e2", "k", 4)), "starved", tmp_path)
    assert sorted(map(tuple, got.select("scan_id", "status").collect())) == [(7, "no_imu"), (8, "ok"), (9, "starved")]


def test_map(spark, tmp_path):
    p = spark.createDataFrame([("d", k % 4, k, k % 7 * 0.2, 0.0, 0.0, 1.0) for k in range(40)], schema("keyframe_points"))
    q = stateful.stream_map(feed(spark, p, tmp_path / "p", "point_id"), str(tmp_path / "map"), str(tmp_path / "c"))
    q.awaitTermination(240)
    assert q.exception() is None
    want = sorted(map(tuple, mapping.map_voxels(p).collect()))
    path = str(tmp_path / "map")
    assert sorted(map(tuple, stateful.read_map(spark, path).collect())) == want
    stateful.compact_map(spark, path)
    assert stateful._versions(spark, path) == (3, []) and sorted(map(tuple, stateful.read_map(spark, path).collect())) == want


def test_many_versions_are_one_scan(spark, tmp_path):
    path = str(tmp_path / "map")
    p = spark.createDataFrame([("d", 0, k, k * 0.3, 0.0, 0.0, 1.0) for k in range(10)], schema("keyframe_points"))
    one = mapping.map_voxels(p).coalesce(1)
    one.write.parquet(f"{path}/version=0")
    import shutil

    for n in range(1, 60):
        shutil.copytree(f"{path}/version=0", f"{path}/version={n}")
    m = stateful.read_map(spark, path)
    plan = m._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and {r.n for r in m.collect()} == {60}
    assert stateful.vacuum_map(spark, path) == 0  # nothing is covered yet
    stateful.compact_map(spark, path)
    shutil.copytree(f"{path}/version=0", f"{path}/version=60")
    assert {r.n for r in stateful.read_map(spark, path).collect()} == {61}
    assert stateful.vacuum_map(spark, path) == 60 and {r.n for r in stateful.read_map(spark, path).collect()} == {61}
    shutil.copytree(f"{path}/version=60", f"{path}/version=61")
    (tmp_path / "map" / "version=61" / "_SUCCESS").unlink()  # a version that is not complete doesn't count
    assert {r.n for r in stateful.read_map(spark, path).collect()} == {61}


def test_map_compacts_itself(spark, tmp_path):
    p = spark.createDataFrame([("d", k % 4, k, k % 7 * 0.2, 0.0, 0.0, 1.0) for k in range(40)], schema("keyframe_points"))
    q = stateful.stream_map(feed(spark, p, tmp_path / "p", "point_id", 6), str(tmp_path / "map"), str(tmp_path / "c"), compact_after=2)
    q.awaitTermination(240)
    assert q.exception() is None
    base, later = stateful._versions(spark, str(tmp_path / "map"))
    assert base == 5 and later == [] and not (tmp_path / "map" / "version=0").exists()
    assert sorted(map(tuple, stateful.read_map(spark, str(tmp_path / "map")).collect())) == sorted(map(tuple, mapping.map_voxels(p).collect()))


def test_a_pose_meets_keyframes_around_it_only():
    rng = np.random.default_rng(0)
    walk = np.cumsum(rng.normal(size=(4000, 3)) * [0.6, 0.6, 0.01], axis=0)
    turns = rng.normal(size=(4000, 4))
    turns /= np.linalg.norm(turns, axis=1, keepdims=True)
    kept, all_kept = keyframes.Kept(), []
    for p, q in zip(walk.tolist(), turns.tolist()):
        d = np.array([np.linalg.norm(np.subtract(p, x)) for x, _ in all_kept])
        new = not len(d) or d.min() > 1.0
        if not new:
            turn = all_kept[int(d.argmin())][1]
            new = np.degrees(2 * np.arccos(min(1, abs(float(np.dot(turn, q)))))) > 45 and (d <= 1.5).sum() <= 1
        assert kept.take(p, q, p, q, 1.0, 45.0) == new
        if new:
            all_kept.append((p, q))
    assert len(kept) == len(all_kept) > 300 and kept.compared < 4000 * len(all_kept) / 10


def test_latest_only(spark):
    d = spark.createDataFrame([("a", 1, 5), ("a", 2, 9), ("b", 3, 1)], "drive_id string, scan_id long, scan_stamp_ns long")
    assert sorted(r.scan_id for r in stateful.latest_only(d).collect()) == [2, 3]


def test_sources_and_sinks(spark, tmp_path):
    i = spark.createDataFrame(imu_rows(0, 0.1), IMU)
    i.write.parquet(str(tmp_path / "imu"))
    assert tables.read_imu(spark, str(tmp_path / "imu")).count() == i.count()
    q = tables.write_stream(tables.read_imu_stream(spark, str(tmp_path / "imu")), str(tmp_path / "out"), str(tmp_path / "c"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == i.count()
    p = pose_rows(spark, [((k, 0, 0), yaw(0)) for k in range(3)])
    for write, name in ((tables.write_path, "path"), (tables.write_states, "states"), (tables.write_keyframes, "kf")):
        write(p, str(tmp_path / name))
        write(p, str(tmp_path / name))
        assert spark.read.parquet(str(tmp_path / name)).count() == 6
    tables.write_frames(p, tables.load_calibration(p.select("drive_id").distinct()), str(tmp_path / "frames"))
    assert spark.read.parquet(str(tmp_path / "frames")).count() == 9
    params = tables.load_params(spark.createDataFrame([("gravity", "9.8"), ("voxel_leaf", "0.5"), ("deskew", "false"), ("other", "1")], "name string, value string"))
    assert params == Params(gravity=9.8, voxel_leaf=0.5, deskew=False)
    with pytest.raises(ValueError):
        Params.of({"nope": 1})
