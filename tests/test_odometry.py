"""Odometry over a made scene with known motion."""

import numpy as np
import pytest

from lidarloom.operators import trajectory
from lidarloom.params import Params, schema
from lidarloom.plans import odometry

from .test_motion import IMU, circle, imu_rows, turn_z

STILL = Params(calibrate_imu=False, wait_until_move=False, adaptive=False, keyframe_dist=0.15, voxel_leaf=0.4, k_neighbours=8, min_points=20, max_iterations=6, crop_size=0.2, max_corr_dist=0.6)


def scene(n_scans=6, n_points=500, seed=0):
    """A room with some furniture, seen by a sensor that goes round in a circle; points are taken one by one along a scan."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n_scans):
        start = 0.5 + 0.1 * k
        for i in range(n_points):
            t = start + 0.09 * i / n_points
            p, *_ = circle(t)
            world = rng.uniform([-5, -6, -1.5], [6, 5, 2.5])
            side = rng.integers(0, 7)
            if side < 6:
                axis, high = divmod(int(side), 2)
                world[axis] = ([-5, -6, -1.5], [6, 5, 2.5])[high][axis]
            else:
                world = np.array([3.0, 2.0, 0.0]) + rng.uniform(-1, 1, 3) * [1, 0.02, 1]
            local = turn_z(0.5 * t).T @ (world - p)
            rows.append(("d", k, i, round(start * 1e9), round(t * 1e9), *local.tolist(), 1.0))
    return rows


@pytest.fixture(scope="module")
def inputs(spark):
    raw = spark.createDataFrame(scene(), schema("points"))
    p, q, *_ = circle(0.5)
    first = spark.createDataFrame([("d", *p.tolist(), *q.tolist())], "drive_id string, px double, py double, pz double, qw double, qx double, qy double, qz double")
    return raw, spark.createDataFrame(imu_rows(0, 1.5), IMU), first


def errors(poses):
    out = []
    for r in poses.orderBy("stamp_ns").collect():
        p, q, *_ = circle(r.stamp_ns / 1e9)
        out.append((float(np.linalg.norm(p - [r.px, r.py, r.pz])), 2 * np.degrees(np.arccos(min(1, abs(float(np.dot(q, [r.qw, r.qx, r.qy, r.qz]))))))))
    return np.array(out)


def test_a_pass_brings_poses_nearer(spark, inputs):
    raw, samples, first = inputs
    chain = errors(odometry.odometry(raw, samples, None, STILL, first, passes=0).poses)
    done = odometry.odometry(raw, samples, None, STILL, first, passes=1)
    after = errors(done.poses)
    assert len(chain) == len(after) == 6
    assert after[:, 0].max() < 0.06 and after[:, 1].max() < 1.0 and after[:, 0].mean() < chain[:, 0].mean()
    kf = done.keyframes.collect()
    assert 2 <= len(kf) <= 6 and {r.scan_id for r in kf} <= set(range(6))
    p = np.array([[r.x, r.y, r.z] for r in done.keyframe_points.collect()])
    off = np.min(np.abs(np.concatenate([p - [-5, -6, -1.5], p - [6, 5, 2.5]], axis=1)), axis=1)
    assert np.median(off) < 0.05  # walls are flat in the map
    assert done.map.count() > 300 and done.states.filter("kind = 'pose'").count() == 6
    assert {r.parent for r in done.frames.select("parent").distinct().collect()} == {"odom", "base_link"}
    assert done.dense.count() == 6 * 500 and done.dense.groupBy("scan_id").count().count() == 6
    length = max(r.length for r in done.lengths.collect())
    assert abs(length - np.linalg.norm(circle(1.0)[0] - circle(0.5)[0])) < 0.15


def test_submaps_hold_earlier_keyframes_only(spark, inputs):
    poses = spark.createDataFrame([("d", k, k * 10**9, 0.3 * k, 0.1 * (k % 3), 0.05 * (k % 2), 1.0, 0.0, 0.0, 0.0) for k in range(12)], "drive_id string, scan_id long, stamp_ns long, px double, py double, pz double, qw double, qx double, qy double, qz double")
    kf = odometry.chosen(poses, None, STILL)
    got = odometry.submaps(poses, odometry.stored(kf), 1.0, STILL).collect()
    at = {r.kf_id: r.stamp_ns for r in kf.collect()}
    assert got and all(at[r.kf_id] < r.scan_id * 10**9 for r in got)
    assert {r.scan_id for r in got} == set(range(1, 12))


def test_parameters_take_effect(spark, inputs):
    raw, samples, _ = inputs
    few = odometry.cleaned(raw.filter("scan_id > 0 or point_id < 10"), STILL)
    assert {r.scan_id for r in few.select("scan_id").distinct().collect()} == {1, 2, 3, 4, 5}
    late = raw.withColumn("stamp_ns", raw["stamp_ns"] + 5)
    assert odometry.cleaned(late, STILL).filter("scan_stamp_ns = stamp_ns").count() == 6
    assert odometry.cleaned(late, Params(time_offset=False, min_points=20)).filter("scan_stamp_ns = stamp_ns").count() == 0
    starts = spark.createDataFrame([("d", 0, 500_000_000, *circle(0.5)[0].tolist(), *circle(0.5)[1].tolist(), *circle(0.5)[2].tolist())], "drive_id string, scan_id long, start_ns long, px double, py double, pz double, qw double, qx double, qy double, qz double, vx double, vy double, vz double")
    own = odometry.load_calibration(raw.select("drive_id").distinct())
    for on in (True, False):
        p = Params(deskew=on, min_points=20)
        assert odometry.moved(raw.filter("scan_id = 0"), samples, starts, own, p).filter("deskewed").count() == (500 if on else 0)
    assert odometry.voxels(raw.filter("scan_id = 0"), Params(voxelize=False, k_neighbours=8)).count() == 500 > odometry.voxels(raw.filter("scan_id = 0"), STILL).count()
    q = ("qw", "qx", "qy", "qz")
    for on in (True, False):
        used, turn = odometry.corrected_imu(samples, own, Params(calibrate_imu=on, imu_calib_time_s=0.4))
        assert used.count() == (samples.count() if not on else samples.filter("stamp_ns > 400000000").count())
        assert on or [tuple(r[c] for c in q) for r in turn.collect()] == [(1.0, 0.0, 0.0, 0.0)]
    named = trajectory.frames(starts.withColumnRenamed("start_ns", "stamp_ns"), own, Params(vehicle="car", base_frame="body"))
    assert sorted({(r.parent, r.child) for r in named.collect()}) == [("car/body", "car/imu"), ("car/body", "car/lidar"), ("car/odom", "car/body")]
