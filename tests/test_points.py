"""Cleaning, sensor time, voxels, neighbours and covariances on hand-made clouds."""

import math

import numpy as np
import pytest

from lidarloom.operators import covariance, points, spatial
from lidarloom.sources import tables

COLUMNS = "drive_id string, scan_id long, point_id long, scan_stamp_ns long, stamp_ns long, x double, y double, z double, intensity double"


def cloud(spark, xyz, scan=0):
    return spark.createDataFrame([("d", scan, i, 0, i, *map(float, p), 1.0) for i, p in enumerate(xyz)], COLUMNS)


def test_nan_and_crop(spark):
    c = cloud(spark, [(math.nan, 0, 0), (math.inf, 0, 0), (1, 1, 1), (1.0001, 0, 0), (-1, 0.5, 0), (0, 0, -2)])
    assert [r.point_id for r in points.drop_nan(c).orderBy("point_id").collect()] == [2, 3, 4, 5]
    assert [r.point_id for r in points.clean_scan(c).orderBy("point_id").collect()] == [3, 5]


def test_sensors_agree(spark):
    ref, offsets = 1_700_000_000_000_000_000, [0, 50_000_000, 100_000_000]
    base = [("d", 1, i, ref, float(i), 0.0, 0.0, 1.0) for i in range(3)]
    head = "drive_id string, scan_id long, point_id long, scan_stamp_ns long, x double, y double, z double, intensity double"
    raw = {
        "OUSTER": spark.createDataFrame([(*b, o) for b, o in zip(base, offsets)], head + ", t long"),
        "VELODYNE": spark.createDataFrame([(*b, o / 1e9) for b, o in zip(base, offsets)], head + ", time float"),
        "HESAI": spark.createDataFrame([(*b, (ref + o) / 1e9) for b, o in zip(base, offsets)], head + ", timestamp double"),
        "LIVOX": spark.createDataFrame([(*b, float(ref + o)) for b, o in zip(base, offsets)], head + ", timestamp double"),
        "UNKNOWN": spark.createDataFrame(base, head),
    }
    for sensor, df in raw.items():
        got = tables.points_of_raw(df).orderBy("point_id").collect()
        assert {r.sensor for r in got} == {sensor}
        if sensor != "UNKNOWN":
            assert all(abs(r.stamp_ns - ref - o) < 1000 for r, o in zip(got, offsets))


def test_voxels(spark):
    c = cloud(spark, [(0, 0, 0), (0.24, 0.1, 0.2), (0.25, 0, 0), (-0.01, 0, 0)])
    got = {(r.vx, r.vy, r.vz): r for r in points.voxel_grid(c).collect()}
    assert set(got) == {(0, 0, 0), (1, 0, 0), (-1, 0, 0)} and got[(0, 0, 0)].n == 2 and abs(got[(0, 0, 0)].x - 0.12) < 1e-9


def test_medians_and_gates(spark):
    c = cloud(spark, [(i, 0, 0) for i in range(6)])
    assert points.median_planar_range(c).first().median_range == 3.0
    assert points.scan_median_stamp(c).first().median_stamp_ns == 3
    assert points.min_points_gate(c, 5).count() == 6 and points.min_points_gate(c, 6).count() == 0
    assert [r.n for r in points.distinct_stamps(c).collect()] == [1] * 6


def brute(a, b, k):
    d = ((a[:, None, :] - b[None, :, :]) ** 2).sum(2)
    return [[j for j in np.lexsort((np.arange(len(b)), row))[:k]] for row in d]


@pytest.mark.parametrize("size", [0.05, 1.0, 100.0])
def test_knn_is_exact(spark, size):
    rng = np.random.default_rng(1)
    xyz = np.concatenate([rng.normal(size=(60, 3)), rng.normal(size=(20, 3)) * 10, np.zeros((3, 3)), [[1, 1, 1], [-1, -1, -1], [50, 0, 0]]])
    c = cloud(spark, xyz)
    got = {}
    for r in spatial.knn_join(c, c, 5, size=size).orderBy("left_id", "rank").collect():
        got.setdefault(r.left_id, []).append(r.right_id)
    assert [got[i] for i in range(len(xyz))] == brute(xyz, xyz, 5)


def test_knn_with_few_points(spark):
    c = cloud(spark, [(0, 0, 0), (9, 9, 9)])
    assert spatial.knn_join(c, c, 5).count() == 4
    assert spatial.knn_join(c.limit(0), c, 5).count() == 0


def test_radius(spark):
    rng = np.random.default_rng(2)
    xyz = rng.normal(size=(80, 3))
    c = cloud(spark, xyz)
    d = ((xyz[:, None, :] - xyz[None, :, :]) ** 2).sum(2)
    got = {(r.left_id, r.right_id) for r in spatial.radius_join(c, c, 0.5).collect()}
    assert got == {(i, j) for i, j in zip(*np.nonzero(d < 0.5))}
    near = {r.left_id: r.right_id for r in spatial.nn_within(c, c.filter("point_id % 2 = 1"), 0.7, ["drive_id", "scan_id"]).collect()}
    odd = np.arange(1, 80, 2)
    want = {i: int(odd[np.argmin(d[i, odd])]) for i in range(80) if d[i, odd].min() < 0.49}
    assert near == want


def test_knn_nd_metrics(spark):
    e = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(8)], "point_id long, embedding array<double>")
    r = [(x.left_id, x.right_id) for x in spatial.knn_nd(e, e, 2, metric="l1", chunk=3, block=3).filter("rank = 2").orderBy("left_id").collect()]
    assert r == [(0, 1), (1, 0), (2, 1), (3, 2), (4, 3), (5, 4), (6, 5), (7, 6)]


def test_marks(spark):
    c = cloud(spark, [(i, 0, 0) for i in range(5)])
    gone = c.filter("point_id < 2").select("drive_id", "scan_id", "point_id")
    more, marks = spatial.add_points(c.filter("point_id > 0"), c.filter("point_id = 0"), gone)
    assert sorted(r.point_id for r in spatial.tombstone(more, marks, ["drive_id", "scan_id", "point_id"]).collect()) == [0, 2, 3, 4]


def test_covariances(spark):
    rng = np.random.default_rng(3)
    xyz = rng.normal(size=(40, 3)) * [3, 2, 0.01]
    c = cloud(spark, xyz)
    knn = spatial.knn_join(c, c, 10)
    near = brute(xyz, xyz, 10)
    raw = {r.point_id: r for r in covariance.local_covariance(knn, c, "NONE").collect()}
    for i in range(40):
        assert np.allclose([raw[i][n] for n in covariance.COVS], np.cov(xyz[near[i]].T, bias=True)[np.triu_indices(3)], atol=1e-12)
    for r in covariance.local_covariance(knn, c, "PLANE").collect():
        m = np.array([r.cxx, r.cxy, r.cxz, r.cxy, r.cyy, r.cyz, r.cxz, r.cyz, r.czz]).reshape(3, 3)
        assert np.allclose(np.linalg.eigvalsh(m), [1e-3, 1, 1]) and r.czz < 0.2
    m = np.array([np.diag([4.0, 1.0, 1e-9])])
    assert np.allclose(covariance.regularised(m, "MIN_EIG")[0], np.diag([4, 1, 1e-3]))
    assert np.allclose(covariance.regularised(m, "NORMALIZED_MIN_EIG")[0], np.diag([1, 0.25, 1e-3]))
    assert np.allclose(np.linalg.norm(np.linalg.inv(covariance.regularised(m, "FROBENIUS")[0])), 1)
    d = ((xyz[:, None, :] - xyz[None, :, :]) ** 2).sum(2)
    want = np.mean([sorted(row)[1:10] for row in d], axis=0).sum() / (9 * 12 // 2)
    assert abs(covariance.knn_density(knn, 10).first().density - want) < 1e-5


def test_layout(spark, tmp_path):
    c = cloud(spark, [(i, i, i) for i in range(20)])
    spatial.write_layout(c, str(tmp_path / "p"), 4.0, 3)
    assert spark.read.parquet(str(tmp_path / "p")).filter("cell = '0_0_0'").count() == 4
    assert points.sort_by_time(c).count() == 20
