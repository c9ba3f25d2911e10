"""IMU samples of scans, integration between poses, and motion correction of points."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..plans.ordered import asof, ordinal
from ..session import stored
from .points import SCAN, distinct_stamps, scan_median_stamp

#: Width of a time bucket of the ordered plans, in nanoseconds: some 12,000 samples at 200 Hz.
BUCKET_NS = 60_000_000_000
STATE = ("px", "py", "pz", "qw", "qx", "qy", "qz", "vx", "vy", "vz")


def imu_time_range_join(intervals: DataFrame, imu: DataFrame, width: int = BUCKET_NS) -> DataFrame:
    """intervals (drive_id, scan_id, start_ns, end_ns) -> one row for each sample an interval needs: from the newest one
    strictly before the start to the oldest one not before the end (or the last there is). Intervals without a sample
    before the start have no rows.

    Samples are numbered, and written once with their numbers, since four branches read them; two as-of joins find the first and last number, so the join is by number, an equality, and
    makes exactly the rows it returns.
    """
    s = stored(ordinal(imu, ["drive_id"], "stamp_ns", width, [c for c in ("event_id",) if c in imu.columns], "__n"))
    slim = s.select("drive_id", "stamp_ns", "__n")
    newest = slim.groupBy("drive_id").agg(F.max("__n").alias("__most"))
    i = intervals.select("drive_id", "scan_id", "start_ns", "end_ns")
    i = asof(i, slim, ["drive_id"], "start_ns", "stamp_ns", width, tie=["__n"], strict=True, name="__from").filter("__from is not null")
    i = asof(i, slim, ["drive_id"], "end_ns", "stamp_ns", width, tie=["__n"], forward=True, name="__to").join(newest, "drive_id")
    i = i.select("drive_id", "scan_id", "start_ns", "end_ns", F.explode(F.sequence(F.col("__from.__n"), F.coalesce(F.col("__to.__n"), F.col("__most")))).alias("__n"))
    return i.join(s, ["drive_id", "__n"]).drop("__n")


def asof_pose(points: DataFrame, poses: DataFrame, width: int = BUCKET_NS, tie: tuple[str, ...] = ()) -> DataFrame:
    """points plus pose: the drive's latest pose row not after the point's stamp."""
    return asof(points, poses, ["drive_id"], "stamp_ns", "stamp_ns", width, tie, name="pose")


# --- integration of one segment, on numbers


def _turn(q, w, h):
    """q stepped by body rate w over h, to first order, and normalised."""
    a, b, c, d = q
    x, y, z = (0.5 * h * v for v in w)
    n = (a - b * x - c * y - d * z, b + a * x + c * z - d * y, c + a * y + d * x - b * z, d + a * z + b * y - c * x)
    size = sum(v * v for v in n) ** 0.5
    return tuple(v / size for v in n)


def _world(q, f, gravity):
    """Specific force f in the world frame, less gravity."""
    w, x, y, z = q
    ux, uy, uz = f
    tx, ty, tz = 2 * (y * uz - z * uy), 2 * (z * ux - x * uz), 2 * (x * uy - y * ux)
    return (ux + w * tx + y * tz - z * ty, uy + w * ty + z * tx - x * tz, uz + w * tz + x * ty - y * tx - gravity)


def _advance(p, v, a, j, h):
    return tuple(pi + vi * h + ai * h * h / 2 + ji * h**3 / 6 for pi, vi, ai, ji in zip(p, v, a, j, strict=True))


def integrate_segment(start, state, samples, times, gravity=9.80665, orientation_base="earlier"):
    """Poses (p, q) at `times` from the state (p, q, v) at `start`; samples: (stamp, w, f) in order, seconds.

    The state is rolled back to the first sample, then goes forward: rates change linearly and accelerations with
    constant jerk between samples. A time in (f0, f] is reached from f0. orientation_base='advanced' turns from the
    attitude at f instead, which is how the original system interpolates. Empty if there are fewer than two samples, no
    times, or start is later than the first time; times after the last sample are left out.
    """
    if len(samples) < 2 or not len(times) or start > times[0]:
        return []
    p, q, v = state
    (s0, w0, f0), (s1, w1, f1) = samples[0], samples[1]
    dt, back = s1 - s0, start - s0
    alpha = tuple((b - a) / dt for a, b in zip(w0, w1, strict=True))
    q = _turn(q, tuple(-(a + 0.5 * c * back) for a, c in zip(w0, alpha, strict=True)), back)
    q1 = _turn(q, tuple(0.5 * (a + b) for a, b in zip(w0, w1, strict=True)), dt)
    a0, a1 = _world(q, f0, gravity), _world(q1, f1, gravity)
    j = tuple((b - a) / dt for a, b in zip(a0, a1, strict=True))
    v = tuple(x - (a * back + c * back * back / 2) for x, a, c in zip(v, a0, j, strict=True))
    p = tuple(x - (y * back + a * back * back / 2 + c * back**3 / 6) for x, y, a, c in zip(p, v, a0, j, strict=True))
    out, k = [], 0
    for (s0, w0, _), (s1, w1, f1) in zip(samples[:-1], samples[1:], strict=True):
        dt = s1 - s0
        alpha = tuple((b - a) / dt for a, b in zip(w0, w1, strict=True))
        ahead = _turn(q, tuple(0.5 * (a + b) for a, b in zip(w0, w1, strict=True)), dt)
        a1 = _world(ahead, f1, gravity)
        j = tuple((b - a) / dt for a, b in zip(a0, a1, strict=True))
        base = ahead if orientation_base == "advanced" else q
        while k < len(times) and times[k] <= s1:
            h = times[k] - s0
            out.append((_advance(p, v, a0, j, h), _turn(base, tuple(a + 0.5 * c * h for a, c in zip(w0, alpha, strict=True)), h)))
            k += 1
        p = _advance(p, v, a0, j, dt)
        v = tuple(x + a * dt + c * dt * dt / 2 for x, a, c in zip(v, a0, j, strict=True))
        q, a0 = ahead, a1
    return out


POSES = "drive_id {drive}, scan_id {scan}, stamp_ns long, px double, py double, pz double, qw double, qx double, qy double, qz double"


def integrate_imu(starts: DataFrame, requests: DataFrame, imu: DataFrame, gravity: float = 9.80665, orientation_base: str = "earlier") -> DataFrame:
    """starts (drive_id, scan_id, start_ns, px..qz, vx..vz), requests (drive_id, scan_id, stamp_ns), corrected imu ->
    a pose for each requested time that the samples reach.

    Segments of a few dozen samples are folded each on its own; a group holds the scans that start in one minute of a
    drive.
    """
    ends = requests.groupBy(*SCAN).agg(F.max("stamp_ns").alias("end_ns"))
    kinds = dict(starts.dtypes)
    schema = POSES.format(drive=kinds["drive_id"], scan=kinds["scan_id"])
    spans = starts.select("drive_id", "scan_id", "start_ns").join(ends, list(SCAN))
    minute = F.floor(F.col("start_ns") / BUCKET_NS).cast("long").alias("__b")
    samples = imu_time_range_join(spans, imu).select(*SCAN, minute, "stamp_ns", "wx", "wy", "wz", "ax", "ay", "az")
    wanted = requests.select(*SCAN, "stamp_ns").distinct().join(starts, list(SCAN)).select(*SCAN, minute, "stamp_ns", "start_ns", *STATE)

    def fold(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        rows = []
        segments = {k: v for k, v in own.sort_values("stamp_ns").groupby("scan_id")}
        for scan, times in asked.sort_values("stamp_ns").groupby("scan_id"):
            if (seg := segments.get(scan)) is None:
                continue
            first = times.iloc[0].to_dict()
            state = tuple(tuple(first[c] for c in part) for part in (STATE[:3], STATE[3:7], STATE[7:]))
            sec = lambda c, zero=int(first["start_ns"]): ((c.to_numpy(np.int64) - zero) / 1e9).tolist()  # noqa: E731  from the start: differences stay exact
            v = seg[["wx", "wy", "wz", "ax", "ay", "az"]].to_numpy().tolist()
            series = [(t, x[:3], x[3:]) for t, x in zip(sec(seg["stamp_ns"]), v, strict=True)]
            found = integrate_segment(0.0, state, series, sec(times["stamp_ns"]), gravity, orientation_base)
            rows += [(first["drive_id"], scan, t, *p, *q) for t, (p, q) in zip(times["stamp_ns"].tolist(), found, strict=False)]
        return pd.DataFrame(rows, columns=[x.split()[0] for x in POSES.split(", ")])

    return samples.groupBy("drive_id", "__b").cogroup(wanted.groupBy("drive_id", "__b")).applyInPandas(fold, schema)


def scan_prior(starts: DataFrame, scans: DataFrame, imu: DataFrame, gravity: float = 9.80665) -> DataFrame:
    """A pose for each scan at its header stamp, without motion correction within the scan."""
    return integrate_imu(starts, scans.select(*SCAN, F.col("scan_stamp_ns").alias("stamp_ns")), imu, gravity)


def deskew(points: DataFrame, imu: DataFrame, starts: DataFrame, calibration: DataFrame, gravity: float = 9.80665, orientation_base: str = "earlier") -> DataFrame:
    """Every point in the world frame, by the pose at its own time: points plus deskewed (boolean), and the scan's prior
    pose as prior_px..prior_qz at its median time, scan_median_ns.

    A scan whose times are not all reached by samples (the first of a drive, too few samples) is moved rigidly by its
    start pose, deskewed false. One pose is made for each different time, not for each point.
    """
    stamps = distinct_stamps(points).select(*SCAN, "stamp_ns")
    poses = integrate_imu(starts, stamps, imu, gravity, orientation_base)
    n = stamps.groupBy(*SCAN).agg(F.count(F.lit(1)).alias("__asked"))
    got = poses.groupBy(*SCAN).agg(F.count(F.lit(1)).alias("__got"))
    median = scan_median_stamp(points)
    whole = n.join(got, list(SCAN), "left").join(median, list(SCAN)).join(starts.select(*SCAN, *[F.col(c).alias(f"__{c}") for c in STATE[:7]]), list(SCAN), "left")
    whole = whole.withColumn("deskewed", F.coalesce(F.col("__asked") == F.col("__got"), F.lit(False)))
    at_median = poses.select(*SCAN, F.col("stamp_ns").alias("median_stamp_ns"), *[F.col(c).alias(f"prior_{c}") for c in STATE[:7]])
    whole = whole.join(at_median, [*SCAN, "median_stamp_ns"], "left")
    pick = {f"prior_{c}": F.when(F.col("deskewed"), F.col(f"prior_{c}")).otherwise(F.col(f"__{c}")) for c in STATE[:7]}
    whole = whole.withColumns(pick).withColumnRenamed("median_stamp_ns", "scan_median_ns").drop("__asked", "__got")
    d = points.join(whole, list(SCAN)).join(poses, [*SCAN, "stamp_ns"], "left").join(calibration.select("drive_id", "lidar_r", "lidar_t"), "drive_id", "left")
    own = lambda c: F.when(F.col("deskewed"), F.col(c)).otherwise(F.coalesce(F.col(f"__{c}"), F.lit(1.0 if c == "qw" else 0.0)))
    eye = F.array(*[F.lit(float(i % 4 == 0)) for i in range(9)])
    body = G.se3_apply(G.items(F.coalesce("lidar_r", eye), 9), G.items(F.coalesce("lidar_t", F.array(*[F.lit(0.0)] * 3)), 3), G.vec("x", "y", "z"))
    world = G.add(G.rotate(tuple(own(c) for c in STATE[3:7]), body), tuple(own(c) for c in STATE[:3]))
    keep = [c for c in points.columns if c not in "xyz"]
    return d.select(*keep, *[w.alias(c) for c, w in zip("xyz", world, strict=True)], "deskewed", "scan_median_ns", *[f"prior_{c}" for c in STATE[:7]])
