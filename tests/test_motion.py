"""IMU series, deskewing, registration, trajectories, keyframes and the observer on scenes with known truth."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lidarloom.operators import covariance, deskew, imu, keyframes, mapping, observer, registration, spatial, trajectory
from lidarloom.params import Params
from lidarloom.sources import tables

G0 = 9.80665
IMU = "drive_id string, stamp_ns long, wx double, wy double, wz double, ax double, ay double, az double"


def turn_z(a):
    return np.array([[math.cos(a), -math.sin(a), 0], [math.sin(a), math.cos(a), 0], [0, 0, 1]])


def circle(t, rate=0.5, speed=2.0):
    """Position, attitude, velocity, body rate and specific force of a level constant turn."""
    a = rate * t
    r = speed / rate
    p = np.array([r * math.sin(a), r * (1 - math.cos(a)), 0])
    v = speed * np.array([math.cos(a), math.sin(a), 0])
    return p, np.array([math.cos(a / 2), 0, 0, math.sin(a / 2)]), v, (0.0, 0.0, rate), (0.0, speed * rate, G0)


def imu_rows(t0, t1, hz=200, drive="d"):
    n = round((t1 - t0) * hz)
    return [(drive, round((t0 + k / hz) * 1e9), *circle(t0 + k / hz)[3], *circle(t0 + k / hz)[4]) for k in range(n + 1)]


def test_dt_and_calibration(spark):
    tilt = 0.2
    rows = [("d", k * 5_000_000, 0.01, -0.02, 0.03, math.sin(tilt) * G0, 0.0, math.cos(tilt) * G0) for k in range(801)]
    i = spark.createDataFrame(rows, IMU)
    assert abs(imu.imu_dt(i).agg(F.avg("dt")).first()[0] - 0.005) < 1e-12
    c = imu.calibrate_imu(i).first()
    assert c.n == 600 and np.allclose(c.gyro_bias, [0.01, -0.02, 0.03]) and np.allclose(c.accel_bias, 0, atol=1e-6)
    up = np.array(observer.turned((c.qw, c.qx, c.qy, c.qz), (c.gravity_x, c.gravity_y, c.gravity_z)))
    assert np.allclose(up, [0, 0, G0], atol=1e-6) and abs(c.pitch + math.degrees(tilt)) < 1e-3
    assert imu.after_calibration(i).count() == 200  # the sample that ends the window is used up
    biases = imu.calibrate_imu(i).withColumn("accel_sm", F.array(*[F.lit(float(k % 4 == 0)) for k in range(9)]))
    assert abs(imu.correct_imu(i, biases).agg(F.max(F.abs("wz"))).first()[0]) < 1e-9


def test_ema_and_rates(spark):
    d = spark.createDataFrame([("d", k, k * 10**8, float(k)) for k in range(10)], "drive_id string, scan_id long, scan_stamp_ns long, v double")
    y, want = None, []
    for k in range(10):
        y = float(k) if y is None else 0.95 * y + 0.05 * k
        want.append(y)
    assert [r.e for r in imu.ema(d, "v", "e").orderBy("scan_id").collect()] == want
    assert abs(imu.trailing_rate(d, "scan_stamp_ns").orderBy(F.desc("scan_id")).first().trailing_rate - 10) < 1e-9


def test_integration_follows_the_circle(spark):
    i = spark.createDataFrame(imu_rows(0, 1.2), IMU)
    p, q, v, *_ = circle(0.5013)
    starts = spark.createDataFrame([("d", 1, round(0.5013e9), *p.tolist(), *q.tolist(), *v.tolist())], "drive_id string, scan_id long, start_ns long, " + ", ".join(f"{c} double" for c in deskew.STATE))
    times = [0.5013, 0.52, 0.5521, 0.6]
    asked = spark.createDataFrame([("d", 1, round(t * 1e9)) for t in times], "drive_id string, scan_id long, stamp_ns long")
    got = deskew.integrate_imu(starts, asked, i).orderBy("stamp_ns").collect()
    for r, t in zip(got, times, strict=True):
        p, q, *_ = circle(t)
        assert np.allclose([r.px, r.py, r.pz], p, atol=2e-4) and np.allclose([r.qw, r.qx, r.qy, r.qz], q, atol=1e-5)
    early = starts.withColumn("start_ns", F.lit(-1).cast("long"))
    assert deskew.integrate_imu(early, asked, i).count() == 0  # no sample before the start


def test_deskewed_walls_are_flat(spark):
    rng = np.random.default_rng(0)
    rows, start = [], 0.5
    for k in range(400):
        t = start + 0.001 + 0.1 * k / 400
        p, q, *_ = circle(t)
        wall = np.array([5.0, rng.uniform(-3, 3), rng.uniform(-1, 2)])  # on x = 5
        local = turn_z(0.5 * t).T @ (wall - p)
        rows.append(("d", 1, k, round(start * 1e9), round(t * 1e9), *local.tolist(), 1.0))
    points = spark.createDataFrame(rows, "drive_id string, scan_id long, point_id long, scan_stamp_ns long, stamp_ns long, x double, y double, z double, intensity double")
    p, q, v, *_ = circle(start)
    starts = spark.createDataFrame([("d", 1, round(start * 1e9), *p.tolist(), *q.tolist(), *v.tolist())], "drive_id string, scan_id long, start_ns long, " + ", ".join(f"{c} double" for c in deskew.STATE))
    calibration = tables.load_calibration(spark.createDataFrame([("d",)], "drive_id string"))
    i = spark.createDataFrame(imu_rows(0, 1), IMU)
    out = deskew.deskew(points, i, starts, calibration)
    assert out.filter("deskewed").count() == 400 and out.agg(F.max(F.abs(F.col("x") - 5))).first()[0] < 2e-3
    rigid = deskew.deskew(points, i.limit(0), starts, calibration)
    assert rigid.filter("not deskewed").count() == 400 and rigid.agg(F.max(F.abs(F.col("x") - 5))).first()[0] > 0.1


def room(rng, n=500):
    p = rng.uniform(-4, 4, size=(n, 3))
    axis = rng.integers(0, 3, n)
    p[np.arange(n), axis] = np.sign(p[np.arange(n), axis]) * 4
    return p


@pytest.mark.parametrize("optimizer", ["LM", "GN"])
def test_registration_finds_the_motion(spark, optimizer):
    rng = np.random.default_rng(1)
    rows_s, rows_t, truth = [], [], {}
    for pair in range(2):
        src = room(rng)
        r, t = registration.rotation(rng.normal(size=3) * 0.02), rng.normal(size=3) * 0.08
        offset = np.array([1000.0, -500.0, 20.0]) * pair
        rows_s += [(pair, k, *(p + offset).tolist()) for k, p in enumerate(src)]
        rows_t += [(pair, k, *(r @ p + t + offset).tolist()) for k, p in enumerate(src)]
        truth[pair] = (r, t + offset - r @ offset)
    frames = [spark.createDataFrame(x, "pair_id int, point_id long, x double, y double, z double") for x in (rows_s, rows_t)]
    src, tgt = (f.join(covariance.local_covariance(spatial.knn_join(f, f, 10, ["pair_id"]), f, "PLANE", ["pair_id"]).drop("n"), ["pair_id", "point_id"]) for f in frames)
    params = Params(rot_eps=1e-6, trans_eps=1e-6, max_iterations=12)
    for row in registration.register(src, tgt, None, params, 0.5, optimizer).collect():
        r, t = truth[row.pair_id]
        assert row.converged and row.n_matches > 400 and len(row.hessian) == 36
        assert np.allclose(np.array(row.r).reshape(3, 3), r, atol=1e-4)
        p = np.array([1000.0, -500.0, 20.0]) * row.pair_id
        assert np.allclose(np.array(row.r).reshape(3, 3) @ p + row.t, r @ p + t, atol=1e-3)


def test_sums_equal_the_direct_ones():
    rng = np.random.default_rng(2)
    a, b, row = rng.normal(size=(30, 3)), rng.normal(size=(30, 3)), {}
    m = [np.eye(3) + 0.1 * np.diag(rng.uniform(size=3)) for _ in range(30)]
    hom = np.c_[a, np.ones(30)]
    for i, j in registration.HOMOGENEOUS:
        for k, l in registration.SYMMETRIC:  # noqa: E741
            row[f"g_{i}{j}_{k}{l}"] = sum(hom[n, i] * hom[n, j] * m[n][k, l] for n in range(30))
    for i in range(4):
        for k in range(3):
            row[f"h_{i}_{k}"] = sum(hom[n, i] * (m[n] @ b[n])[k] for n in range(30))
    row["e_bb"] = sum(b[n] @ m[n] @ b[n] for n in range(30))
    sums = registration.Sums.of(row)
    r, t = registration.rotation(np.array([0.1, 0.2, -0.1])), np.array([0.3, -0.2, 0.1])
    theta = np.vstack([r.T, t])
    e = b - (a @ r.T + t)
    assert math.isclose(sums.error(theta), sum(e[n] @ m[n] @ e[n] for n in range(30)), rel_tol=1e-10)
    h, g = np.zeros((6, 6)), np.zeros(6)
    for n in range(30):
        j = np.hstack([registration.cross_matrix(r @ a[n] + t), -np.eye(3)])
        h, g = h + j.T @ m[n] @ j, g + j.T @ m[n] @ e[n]
    got = sums.equations(theta)
    assert np.allclose(got[0], h) and np.allclose(got[1], g)


def pose_rows(spark, poses, drive="d"):
    return spark.createDataFrame([(drive, k, k * 10**8, *map(float, p), *map(float, q)) for k, (p, q) in enumerate(poses)], "drive_id string, scan_id long, stamp_ns long, px double, py double, pz double, qw double, qx double, qy double, qz double")


def yaw(deg):
    a = math.radians(deg) / 2
    return (math.cos(a), 0, 0, math.sin(a))


def test_keyframes(spark):
    poses = [((0, 0, 0), yaw(0)), ((0.5, 0, 0), yaw(10)), ((1.2, 0, 0), yaw(0)), ((1.3, 0, 0), yaw(50)), ((0.2, 0, 0), yaw(60)), ((5, 0, 0), yaw(0)), ((5.1, 0, 0), yaw(60)), ((5.2, 0, 0), yaw(130))]
    got = [r.scan_id for r in keyframes.select_keyframes(pose_rows(spark, poses)).orderBy("kf_id").collect()]
    # turned in place counts only while one keyframe at most is within 1.5
    assert got == [0, 2, 5, 6]


def test_lengths_and_frames(spark):
    p = pose_rows(spark, [((0, 0, 0), yaw(0)), ((0.05, 0, 0), yaw(0)), ((0.12, 0, 0), yaw(0)), ((1.12, 0, 0), yaw(0)), ((1.15, 0, 0), yaw(0))])
    lengths = trajectory.trajectory_length(p)
    assert np.allclose([r.length for r in lengths.orderBy("scan_id").collect()], [0, 0, 0.12, 1.12, 1.12])
    assert trajectory.wait_until_move(p, lengths).count() == 3
    edges = trajectory.frames(p, tables.load_calibration(p.select("drive_id").distinct()))
    assert edges.count() == 15 and edges.select("child").distinct().count() == 3
    assert [r.n for r in trajectory.pose_places(p).orderBy("stamp_ns").collect()] == [0, 1, 2, 3, 4]


def test_chain(spark):
    rng = np.random.default_rng(4)
    steps, r, t, want = [], np.eye(3), np.zeros(3), []
    for k in range(30):
        dr, dt = registration.rotation(rng.normal(size=3) * 0.3), rng.normal(size=3)
        t, r = r @ dt + t, r @ dr
        want.append((r.copy(), t.copy()))
        steps.append(("d", k, k * 10**9, dr.ravel().tolist(), dt.tolist()))
    d = spark.createDataFrame(steps, "drive_id string, scan_id long, stamp_ns long, r array<double>, t array<double>")
    for row, (r, t) in zip(trajectory.chain_poses(d, 7 * 10**9).orderBy("scan_id").collect(), want, strict=True):
        assert np.allclose(row.t, t) and np.allclose(np.array(row.r).reshape(3, 3), r) and abs(row.qw**2 + row.qx**2 + row.qy**2 + row.qz**2 - 1) < 1e-12
    eye = d.select("drive_id", "scan_id", F.array(*map(F.lit, registration.EYE)).alias("r"), F.array(*[F.lit(1.0)] * 3).alias("t"))
    one = trajectory.corrected_poses(d, eye).filter("scan_id = 0").first()
    assert np.allclose(one.t, np.array(steps[0][4]) + 1)


def test_hulls(spark):
    corners = [(x, y, z) for x in (0, 4) for y in (0, 4) for z in (0, 4)]
    rng = np.random.default_rng(5)
    k = pose_rows(spark, [(p, yaw(0)) for p in [*corners, (2, 2, 2), (1.5, 2, 2.5)]]).withColumn("kf_id", F.col("scan_id"))
    assert {r.kf_id for r in keyframes.convex_hull_keyframes(k).collect()} == set(range(8))
    assert keyframes.convex_hull_keyframes(k.filter("kf_id < 3")).count() == 0
    ball = rng.normal(size=(40, 3))
    ball /= np.linalg.norm(ball, axis=1)[:, None]
    k = pose_rows(spark, [(p, yaw(0)) for p in [*ball.tolist(), [0.0, 0.0, 0.0]]]).withColumn("kf_id", F.col("scan_id"))
    hull = {r.kf_id for r in keyframes.concave_hull_keyframes(k, 2.0).collect()}
    assert 40 not in hull and len(hull) >= 38
    assert keyframes.concave_hull_keyframes(k.filter("kf_id < 4"), 2.0).count() == 0


def test_submaps(spark):
    p = pose_rows(spark, [((k, 0, 0), yaw(0)) for k in range(8)])
    k = p.withColumn("kf_id", F.col("scan_id"))
    members = keyframes.submap_select(p, k, k.filter("kf_id in (0, 7)"), k.filter("kf_id = 1"), 2, 1, 1, before="stamp_ns")
    key = {r.scan_id: r.members for r in keyframes.submap_key(members).collect()}
    assert key[7] == [0, 1, 5, 6] and key[1] == [0] and 0 not in key
    changed = keyframes.submap_changed(keyframes.submap_key(members))
    assert all(r.changed for r in changed.collect())
    assert keyframes.submap_assemble(members.filter("scan_id = 7"), k.select("drive_id", "kf_id", "px")).count() == 4
    near = keyframes.nearest_keyframe(p.withColumn("pose_id", F.col("scan_id")), k.filter("kf_id < 3"), 1.0).orderBy("pose_id").collect()
    assert (near[5].kf_id, near[5].distance, near[5].n_nearby) == (2, 3.0, 0) and near[1].n_nearby == 3


def test_observer_pulls_towards_poses(spark):
    i = spark.createDataFrame(imu_rows(0, 2, 200), IMU)
    poses = [(k, circle(k / 10)) for k in range(20)]
    p = spark.createDataFrame([("d", k * 10**8, *x[0].tolist(), *x[1].tolist()) for k, x in poses], "drive_id string, stamp_ns long, px double, py double, pz double, qw double, qx double, qy double, qz double")
    out = observer.observe(i, p).orderBy("stamp_ns", "kind").collect()
    end = [r for r in out if r.kind == "pose"][-1]
    truth = circle(1.9)
    assert np.allclose([end.px, end.py, end.pz], truth[0], atol=0.3) and abs(end.qw**2 + end.qx**2 + end.qy**2 + end.qz**2 - 1) < 1e-9
    alone = observer.propagate_state(i, p.filter("stamp_ns = 0")).orderBy(F.desc("stamp_ns")).first()
    assert alone.kind == "imu" and abs(alone.pz) < 1e-6
    s = observer.State()
    s.observe((1.0, 0.0, 0.0), (1.0, 0.0, 0.0, 0.0), 0.1, Params())
    assert np.allclose(s.p, (0.45, 0, 0)) and np.allclose(s.v, (1.125, 0, 0)) and np.allclose(s.ba, (-0.225, 0, 0))


def test_maps(spark, tmp_path):
    rows = [("d", k, k % 3, k % 5 * 0.1, 0.0, 0.0, 1.0) for k in range(30)]
    p = spark.createDataFrame(rows, "drive_id string, point_id long, kf_id long, x double, y double, z double, intensity double")
    both = mapping.merge_voxels(mapping.map_voxels(p.filter("kf_id = 0")), mapping.map_voxels(p.filter("kf_id > 0")))
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, mapping.map_voxels(p).collect()))
    assert mapping.map_append(mapping.map_append(None, p.filter("kf_id = 0")), p.filter("kf_id = 1")).count() == 4
    assert mapping.map_export(p, 0.25, str(tmp_path / "map")) and spark.read.parquet(str(tmp_path / "map")).count() == 2
    assert not mapping.map_export(p, 0.25, str(tmp_path / "no" / "map"))


def test_adaptive(spark):
    m = spark.createDataFrame([(0.1, 9.0), (7.0, 9.0), (7.0, 0.01)], "spaciousness double, density double")
    assert [(r.keyframe_thresh, r.max_corr) for r in keyframes.adaptive_params(m).collect()] == [(0.5, 0.25), (5.0, 1.0), (5.0, 0.25)]
