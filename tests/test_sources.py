"""Sources, sinks and options that no query shows: read back, streamed, timed out."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lidarloom.operators import deskew, keyframes
from lidarloom.params import schema
from lidarloom.sources import tables
from lidarloom.streaming import stateful

from .test_motion import IMU, circle, imu_rows


def drain(spark, stream, name, tmp_path):
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name)


def test_points_and_keyframe_points(spark, tmp_path):
    p = spark.createDataFrame([("d", 1, k, 5, 5 + k, 0.1 * k, 0.2, 0.3, 1.0) for k in range(9)], schema("points"))
    p.withColumn("ring", F.lit(1)).write.parquet(str(tmp_path / "p"))  # a column more than the schema has
    back = tables.read_points(spark, str(tmp_path / "p"))
    assert back.schema == schema("points") and sorted(map(tuple, back.collect())) == sorted(map(tuple, p.collect()))
    assert drain(spark, tables.read_points_stream(spark, str(tmp_path / "p"), 1), "points", tmp_path).count() == 9
    k = spark.createDataFrame([("d", k % 2, k, 0.1, 0.2, 0.3, 1.0) for k in range(6)], schema("keyframe_points"))
    for _ in range(2):
        tables.write_keyframe_points(k, str(tmp_path / "k"))
    got = spark.read.parquet(str(tmp_path / "k"))
    assert got.count() == 12 and (tmp_path / "k" / "drive_id=d").exists()
    assert drain(spark, tables.read_keyframes_stream(spark, str(tmp_path / "k")), "kf_points", tmp_path).count() == 12


def test_silent_drives_are_let_go(spark, tmp_path):
    e = spark.createDataFrame([("d", "imu", 0, None, None), ("d", "scan", 5, 7, 10)], "drive_id string, kind string, stamp_ns long, scan_id long, end_ns long")
    e.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = stateful.sync_scans(spark.readStream.schema(e.schema).parquet(str(tmp_path / "e")), idle_ms=500)
    q = stream.writeStream.format("memory").queryName("idle").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="200 milliseconds").start()
    try:
        until = time.time() + 40
        while time.time() < until and not spark.table("idle").count():
            time.sleep(0.3)
        assert [tuple(r) for r in spark.table("idle").collect()] == [("d", 7, "starved", 0)]
    finally:
        q.stop()


def test_orientation_base():
    """From the earlier sample a turn ends where it should; from the later one it is ahead by the step between them."""
    w, f = (0.0, 0.0, 1.0), (0.0, 0.0, 9.80665)
    samples = [(k / 10, w, f) for k in range(4)]
    start = ((0.0, 0.0, 0.0), (1.0, 0.0, 0.0, 0.0), (0.0, 0.0, 0.0))
    yaw = lambda q: 2 * np.arctan2(q[3], q[0])
    at = lambda base: [yaw(q) for _, q in deskew.integrate_segment(0.0, start, samples, [0.05, 0.25], orientation_base=base)]
    assert np.allclose(at("earlier"), [0.05, 0.25], atol=1e-3)
    assert np.allclose(at("advanced"), [0.15, 0.35], atol=1e-3)


@pytest.fixture(scope="module")
def path_of_keyframes(spark):
    rng = np.random.default_rng(6)
    p = np.round(rng.uniform(-6, 6, size=(70, 3)), 3)
    rows = [("d", k, k, *x, 1.0, 0.0, 0.0, 0.0) for k, x in enumerate(p.tolist())]
    return p, spark.createDataFrame(rows, "drive_id string, kf_id long, stamp_ns long, px double, py double, pz double, qw double, qx double, qy double, qz double")


def test_submaps_with_both_hulls(path_of_keyframes):
    p, k = path_of_keyframes
    convex, concave = (f.collect() for f in (keyframes.convex_hull_keyframes(k), keyframes.concave_hull_keyframes(k, 3.0)))
    sets = [set(range(len(p))), {r.kf_id for r in convex}, {r.kf_id for r in concave}]
    assert 5 < len(sets[1]) < len(p) and sets[2]
    poses = k.withColumnRenamed("kf_id", "scan_id").filter("scan_id % 7 = 0 and scan_id > 0")
    got = {}
    for r in keyframes.submap_select(poses, k, keyframes.convex_hull_keyframes(k), keyframes.concave_hull_keyframes(k, 3.0), 10, 10, 10, before="stamp_ns").collect():
        got.setdefault(r.scan_id, set()).add(r.kf_id)
    for s in got:
        want = set()
        for some in sets:
            earlier = [i for i in some if i < s]
            d = {i: ((p[i] - p[s]) ** 2).sum() for i in earlier}
            if earlier:
                reach = sorted(d.values())[: 10][-1]
                want |= {i for i in earlier if d[i] <= reach}
        assert got[s] == want, s
    assert set(got) == {s for s in range(7, 70, 7)}


def test_hull_in_space_by_halfspaces(path_of_keyframes):
    """A corner of the hull is not a mixture of others: some direction has it as its only farthest point."""
    p, k = path_of_keyframes
    got = {r.kf_id for r in keyframes.convex_hull_keyframes(k).collect()}
    want = set()
    for i in range(len(p)):
        for j in range(len(p)):
            for m in range(j):
                if i not in (j, m):
                    n = np.cross(p[j] - p[i], p[m] - p[i])
                    side = (p - p[i]) @ n
                    if (side <= 1e-9).all() or (side >= -1e-9).all():
                        want.add(i)
                        break
            if i in want:
                break
    assert got == want


def test_submap_points_and_covariances(spark):
    members = spark.createDataFrame([("d", 5, 0), ("d", 5, 2), ("d", 6, 2)], "drive_id string, scan_id long, kf_id long")
    pts = spark.createDataFrame([("d", k, 10 * k + i, float(i), 0.0, 0.0, 1.0 + k, 0.5) for k in range(3) for i in range(4)], "drive_id string, kf_id long, point_id long, x double, y double, z double, cxx double, cxy double")
    got = keyframes.submap_assemble(members, pts)
    assert sorted((r.scan_id, r.kf_id, r.point_id, r.cxx) for r in got.collect()) == sorted((s, k, 10 * k + i, 1.0 + k) for s, k in ((5, 0), (5, 2), (6, 2)) for i in range(4))


def test_streamed_samples(spark, tmp_path):
    spark.createDataFrame(imu_rows(0, 0.2), IMU).write.parquet(str(tmp_path / "i"))
    assert drain(spark, tables.read_imu_stream(spark, str(tmp_path / "i")), "samples", tmp_path).count() == len(imu_rows(0, 0.2))
    assert len(circle(0.0)) >= 3
