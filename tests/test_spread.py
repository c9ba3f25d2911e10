"""Ordered plans spread over time buckets give what one pass a drive gives."""

import random

import pytest

from lidarloom.operators import imu
from lidarloom.plans.ordered import running
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(1)
    at, out = [0, 0, 0], []
    for i in range(600):
        d = r.choice((0, 0, 0, 1, 2))  # one drive has most rows
        at[d] += r.choice((0, 1, 3, 400)) * 10_000_000  # equal stamps and long gaps
        out.append((d, i, at[d], r.random() if r.random() > 0.1 else None))
    return spark.createDataFrame(out, "drive_id int, event_id long, stamp_ns long, v double")


def same(a, b, key="event_id"):
    x, y = ({r[key]: tuple(r) for r in d.collect()} for d in (a, b.select(*a.columns)))
    assert x.keys() == y.keys() and len(x) > 300
    for k in x:
        assert all(p == q or (p is not None and q is not None and abs(p - q) < 1e-9) or (p != p and q is None) for p, q in zip(x[k], y[k])), (x[k], y[k])


@pytest.mark.parametrize("width", [50_000_000, 3_000_000_000, 10**15])
def test_spread_plans(rows, width):
    same(imu.trailing_rate(rows, last=7), imu.trailing_rate(rows, last=7, width=width))
    same(imu.elapsed_time(rows, "stamp_ns"), imu.elapsed_time(rows, "stamp_ns", width))
    same(imu.ema(rows, "v", "y", "event_id"), imu.ema(rows, "v", "y", "event_id", width=max(1, width // 10**8)))


def test_no_window_over_a_drive_s_rows(rows):
    plan = imu.trailing_rate(rows, width=10**9)._jdf.queryExecution().optimizedPlan().toString()
    over = [x for x in plan.split("\n") if "Window [" in x]
    assert over and all("__b" in x.split("[")[2] or "__t" in x or "__last" in x for x in over)


def test_running(rows):
    got = running(rows, ["drive_id"], "stamp_ns", 10**9, {"s": F.col("event_id")}, ["event_id"]).collect()
    for d in (0, 1, 2):
        own = sorted(((r.stamp_ns, r.event_id, r.n, r.s) for r in got if r.drive_id == d))
        total = 0
        for k, (_, e, n, s) in enumerate(own):
            total += e
            assert (n, s) == (k, total)


def test_after_calibration(spark):
    i = spark.createDataFrame([("a", k * 10**9, 0) for k in range(6)] + [("b", 3 * 10**9, 0), ("b", 0, 0), ("b", 3 * 10**9, 0), ("c", 5, 0)], "drive_id string, stamp_ns long, w int")
    got = sorted((r.drive_id, r.stamp_ns // 10**9) for r in imu.after_calibration(i, 3.0).collect())
    assert got == [("a", 4), ("a", 5), ("b", 3)]  # the sample that ends it is used up; of two alike one stays
