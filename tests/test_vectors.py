"""Neighbours in N dimensions, neighbours within eps, and boxes of the layout on disk."""

import glob

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lidarloom.operators import spatial, vectors


def frame(spark, x, shift=0):
    return spark.createDataFrame([(i + shift, v.tolist()) for i, v in enumerate(x)], "point_id long, embedding array<double>")


def plain(a, b, k, metric):
    d = vectors.DISTANCES[metric](a, b)
    order = np.argsort(d, axis=1, kind="stable")[:, :k]
    return sorted((i, int(j), n + 1) for i, row in enumerate(order) for n, j in enumerate(row))


@pytest.mark.parametrize(("metric", "cells"), [("l2", None), ("l1", 9), ("so2", 5), ("l2", 200)])
def test_all_pairs(spark, metric, cells):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(150, 6)) * 0.1 + 3 * rng.integers(0, 3, size=(150, 6)), np.zeros((30, 6))])  # 30 rows are one place
    y = np.concatenate([x[::2], rng.normal(size=(20, 6))])
    got = vectors.knn_nd(frame(spark, x), frame(spark, y), 4, metric=metric, chunk=40, block=16, cells=cells)
    assert sorted((r.left_id, r.right_id, r["rank"]) for r in got.collect()) == plain(x, y, 4, metric)


def test_own_metric_and_few_rows(spark):
    x = np.arange(12.0).reshape(6, 2)
    own = lambda a, b: np.abs(a[:, None, 0] - b[None, :, 0]) ** 0.5
    got = vectors.knn_nd(frame(spark, x), frame(spark, x), 9, metric=own)
    assert got.count() == 36 and all(r.d == 0 for r in got.filter("rank = 1").collect())
    assert vectors.knn_nd(frame(spark, x), frame(spark, x).limit(0), 2).count() == 0
    assert vectors.knn_nd(frame(spark, x).limit(0), frame(spark, x), 2).count() == 0


def test_pairs_compared_are_few_where_there_is_structure(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 16))[np.arange(2000) % 40] * 5 + 0.1 * rng.normal(size=(2000, 16))
    d = frame(spark, x)
    compared = vectors.knn_nd(d, d, 5, counted=True).first().pairs
    assert compared < 2000 * 2000 / 8
    got = vectors.knn_nd(d, d, 5).filter("rank > 1").collect()
    assert sorted((r.left_id, r.right_id, r["rank"]) for r in got) == [t for t in plain(x, x, 5, "l2") if t[2] > 1]


def test_eps(spark):
    rng = np.random.default_rng(9)
    p = np.concatenate([rng.uniform(0, 4, size=(400, 3)), rng.uniform(0, 40, size=(60, 3))])
    c = spark.createDataFrame([("d", 1, i, *v) for i, v in enumerate(p.tolist())], "drive_id string, scan_id int, point_id long, x double, y double, z double")
    true = np.sort(((p[:, None] - p[None]) ** 2).sum(-1), axis=1)
    for eps in (0.0, 0.3, 2.0):
        rows = spatial.approx_knn_join(c, c, 6, 0.5, eps=eps).collect()
        assert len(rows) == 6 * len(p)
        assert all(r.d2**0.5 <= (1 + eps) * true[r.left_id, r["rank"] - 1] ** 0.5 + 1e-9 for r in rows)


def plain_key(cells):
    held = [min(max(c, -spatial.EDGE), spatial.EDGE - 1) + spatial.EDGE for c in cells]
    return sum(((held[axis] >> bit) & 1) << (3 * bit + 2 - axis) for bit in range(spatial.KEY_BITS) for axis in range(3))


def test_morton(spark):
    rng = np.random.default_rng(3)
    p = [[0.0, 0.0, 0.0], [-1e9, 1e9, -0.1], *rng.uniform(-5000, 5000, size=(200, 3)).tolist()]
    d = spark.createDataFrame([(i, *v) for i, v in enumerate(p)], "i long, x double, y double, z double")
    got = {r.i: r.k for r in d.select("i", spatial.morton(F.col("x"), F.col("y"), F.col("z"), 0.5).alias("k")).collect()}
    assert all(got[i] == plain_key([int(np.floor(c / 0.5)) for c in v]) for i, v in enumerate(p))
    for _ in range(60):
        low = rng.integers(-40, 40, 3)
        high = low + rng.integers(0, 30, 3)
        ranges = spatial.morton_ranges(low.tolist(), high.tolist(), 24)
        assert len(ranges) <= 24 and all(a[1] + 1 < b[0] for a, b in zip(ranges, ranges[1:]))
        cells = rng.integers(low, high + 1, size=(50, 3)).tolist()
        assert all(any(a <= plain_key(c) <= b for a, b in ranges) for c in cells)


def test_box_skips_row_groups(spark, tmp_path):
    rng = np.random.default_rng(7)
    p = rng.uniform(-50, 50, size=(20_000, 3))
    c = spark.createDataFrame([("a" if i % 2 else "b", i, *v) for i, v in enumerate(p.tolist())], "drive_id string, point_id long, x double, y double, z double")
    path = str(tmp_path / "layout")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "500")
    try:
        spatial.write_layout(c, path, 2.0, 4)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    low, high = (-10.0, 5.0, 0.0), (4.5, 20.0, 12.0)
    want = {i for i, v in enumerate(p) if all(a <= x <= b for a, x, b in zip(low, v, high))}
    box = spatial.read_box(spark, path, low, high, 2.0)
    assert {r.point_id for r in box.collect()} == want and "zkey" not in box.columns
    assert {r.point_id for r in spatial.read_box(spark, path, low, high, 2.0, ["a"]).collect()} == {i for i in want if i % 2}
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    try:
        plan = spatial.read_box(spark, path, low, high, 2.0)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan[plan.index("PushedFilters") :]
    assert "GreaterThanOrEqual(zkey" in pushed and "LessThanOrEqual(zkey" in pushed
    ranges = spatial.morton_ranges([int(np.floor(v / 2.0)) for v in low], [int(np.floor(v / 2.0)) for v in high])
    groups = read = 0
    for f in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            stats = next(meta.row_group(g).column(k).statistics for k in range(meta.num_columns) if meta.row_group(g).column(k).path_in_schema == "zkey")
            groups += 1
            read += any(stats.min <= b and a <= stats.max for a, b in ranges)
    assert groups >= 40 and read <= groups / 3


def test_places_by_other_names(spark):
    rng = np.random.default_rng(2)
    p = spark.createDataFrame([("d", 1, i, *v) for i, v in enumerate(rng.uniform(0, 5, size=(80, 3)).tolist())], "drive_id string, scan_id int, point_id long, x double, y double, z double")
    q = p.select("drive_id", "scan_id", "point_id", F.col("x").alias("east"), F.col("y").alias("north"), F.col("z").alias("up"), F.lit(0.0).alias("x"))
    names = ("east", "north", "up")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(spatial.knn_join(p, p, 3)) == rows(spatial.knn_join(q, q, 3, places=names))
    assert rows(spatial.radius_join(p, p, 0.5)) == rows(spatial.radius_join(q, q, 0.5, places=names))
    on = ["drive_id", "scan_id"]
    assert rows(spatial.nn_within(p, p, 0.5, on)) == rows(spatial.nn_within(q, q, 0.5, on, places=names))


def test_a_vector_is_sent_to_few_groups(spark, monkeypatch):
    """Vectors without structure look into nearly all cells, but are sent to a bin of cells once."""
    x = np.random.default_rng(2).normal(size=(1500, 24)).astype(np.float32)
    x[700:760] = x[5]
    kept, keep = [], vectors.stored
    monkeypatch.setattr(vectors, "stored", lambda df: kept.append(keep(df)) or kept[-1])
    got = vectors.knn_nd(frame(spark, x).withColumn("embedding", F.col("embedding").cast("array<float>")), frame(spark, x), 4, chunk=400, block=400, cells=40)
    assert sorted((r.left_id, r.right_id, r["rank"]) for r in got.collect()) == plain(x.astype(float), x.astype(float), 4, "l2")
    most = [df.agg(F.max(F.size("to"))).first()[0] for df in kept if "to" in df.columns]
    assert len(most) == 2 and max(most) <= 8


def test_candidates_hold_ties_and_odd_vectors():
    x = np.concatenate([np.random.default_rng(3).normal(size=(60, 5)), np.ones((20, 5)), np.full((1, 5), np.nan), np.full((1, 5), 1e200)])
    for y in (x[:80], x):
        with np.errstate(all="ignore"):
            d = vectors.DISTANCES["l2"](y, y)
            found = [(r, c, v) for r, c, v in vectors.candidates(vectors.DISTANCES["l2"], y, y, 3, np.full(len(y), np.inf))]
        rows, cols, near = (np.concatenate(z) for z in zip(*found))
        for i in range(len(y)):
            of = rows == i
            order = np.lexsort((cols[of], near[of]))[:3]
            assert cols[of][order].tolist() == np.argsort(d[i], kind="stable")[:3].tolist() and np.array_equal(near[of][order], d[i][cols[of][order]], equal_nan=True)
