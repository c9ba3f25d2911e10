"""Queries that agree with their SQL where the last bits of numbers decide."""

import duckdb
import numpy as np

import __spark_entry__
from lidarloom.operators import registration, trajectory


def as_sql(spark, name, folder, rows):
    """Rows of a query over a table of orders made of rows (o_orderkey, o_custkey, day), and those of its SQL."""
    db = duckdb.connect()
    db.execute("CREATE TABLE made (o_orderkey BIGINT, o_custkey BIGINT, day BIGINT)")
    db.executemany("INSERT INTO made VALUES (?, ?, ?)", rows)
    db.execute(f"COPY (SELECT o_orderkey, o_custkey, TIMESTAMP '1995-01-01' + to_days(CAST(day AS INTEGER)) AS o_orderdate FROM made) TO '{folder}/orders.parquet' (FORMAT PARQUET)")
    db.execute(f"CREATE VIEW orders AS SELECT * FROM '{folder}/orders.parquet'")
    want = db.execute(__spark_entry__.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = __spark_entry__.queries()[name](spark, str(folder)).select(*columns)
    return sorted(map(tuple, got.collect())), sorted(want.fetchall())


def test_turns_by_the_limit_itself(spark, tmp_path):
    """Each drive has two poses at one place, 45 degrees apart."""
    step = next(97 * m for m in range(360) if 97 * m % 360 == 45)
    rows = [(k, drive, day) for drive in range(50) for day, k in enumerate((7 * drive, 7 * drive + step))]
    got, want = as_sql(spark, "select_keyframes", tmp_path, rows)
    assert got == want and 50 < len(want) < 100


def test_a_long_chain_does_not_drift(spark):
    """20,000 steps in two buckets, each turned by its own angle; wanted by sums of whole hundredths of a radian."""
    k = np.arange(20_000)
    angle, step = k * 7919 % 41 - 20, np.stack([k % 97 / 10, k % 53 / 10], 1).astype(np.longdouble)
    before = np.concatenate([[0], np.cumsum(angle)[:-1]]).astype(np.longdouble) / 100
    c, s = np.cos(before), np.sin(before)
    want = np.cumsum(np.stack([c * step[:, 0] - s * step[:, 1], s * step[:, 0] + c * step[:, 1]], 1), axis=0)
    d = spark.range(len(k)).selectExpr("0 AS drive_id", "id AS scan_id", "id AS stamp_ns", "array(0D, 0D, (id * 7919 % 41 - 20) / 100D) AS turn", "array(id % 97 / 10D, id % 53 / 10D, 0D) AS t")
    got = trajectory.chain_poses(d.withColumnRenamed("turn", "r"), 10_000).orderBy("scan_id").select("px", "py").collect()
    assert np.abs(np.array(got) - want).max() < 1e-11
    nine = d.selectExpr("drive_id", "scan_id", "stamp_ns", "t", "array(cos(turn[2]), -sin(turn[2]), 0D, sin(turn[2]), cos(turn[2]), 0D, 0D, 0D, 1D) AS r")
    got = trajectory.chain_poses(nine, 10_000).orderBy("scan_id").select("px", "py").collect()
    assert np.abs(np.array(got) - want).max() < 1e-8
    tilted = spark.createDataFrame([(0, 0, 0, [0.3, -0.2, 0.5], [0.0] * 3), (0, 1, 1, [1e-9, 0.0, 0.0], [0.0] * 3)], "drive_id int, scan_id long, stamp_ns long, r array<double>, t array<double>")
    for r in trajectory.chain_poses(tilted).collect():
        assert np.allclose(np.array(r.r).reshape(3, 3), registration.rotation(np.array([0.3, -0.2, 0.5])), atol=2e-9)
