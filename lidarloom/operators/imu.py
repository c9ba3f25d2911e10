"""IMU series: intervals, lever arm, calibration, correction, rates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..params import Params
from ..plans.ordered import affine_scan, before, folded, running

NS = 1e9
RATE = ("wx", "wy", "wz")
ACCEL = ("ax", "ay", "az")


def in_drive(*order: str, of: DataFrame | None = None) -> Window:
    """Rows of a drive in order; of equal stamps those of `of` go by event_id or scan_id, where it has one."""
    tie = [c for c in ("scan_id", "event_id") if of is not None and c in of.columns]
    return Window.partitionBy("drive_id").orderBy(*(order or ("stamp_ns",)), *tie)


def with_before(df: DataFrame, columns: tuple[str, ...], width: int | None) -> DataFrame:
    """df plus __before: the struct of `columns` of the drive's row before. width: of a time bucket in nanoseconds, so
    that a long drive is spread over tasks; None: one ordered pass a drive."""
    tie = [c for c in ("scan_id", "event_id") if c in df.columns]
    if width is None:
        return df.withColumn("__before", F.lag(F.struct(*columns)).over(in_drive(of=df)))
    return before(df, ["drive_id"], "stamp_ns", width, columns, tie, "__before")


def _fields(names: tuple[str, ...]) -> G.Vec:
    return tuple(F.col("__before").getField(c) for c in names)


def _gap(fallback_hz: float):
    gap = (F.col("stamp_ns") - F.col("__before.stamp_ns")) / NS
    return F.when(gap == 0, 1.0 / fallback_hz).otherwise(gap)


def imu_dt(imu: DataFrame, fallback_hz: float = 200.0, width: int | None = None) -> DataFrame:
    """dt: seconds since the sample before; 1 / fallback_hz where that is 0, null for the first sample of a drive. Of
    equal stamps the smaller scan_id or event_id goes first, where there is one. width: see with_before()."""
    return with_before(imu, ("stamp_ns",), width).withColumn("dt", _gap(fallback_hz)).drop("__before")


def angular_acceleration(imu: DataFrame, width: int | None = None) -> DataFrame:
    """alpha_*: change of the rate over dt; mean_w*: rate halfway to the sample before. Needs dt."""
    d = with_before(imu, RATE, width)
    w, last = G.vec(*RATE), _fields(RATE)
    step = G.sub(w, last)
    return d.withColumns({**{f"alpha_{c}": x / F.col("dt") for c, x in zip("xyz", step, strict=True)}, **{f"mean_w{c}": b + 0.5 * x for c, b, x in zip("xyz", last, step, strict=True)}}).drop("__before")


def jerk(imu: DataFrame, gravity: float = 9.80665, width: int | None = None) -> DataFrame:
    """world_a*: acceleration in the world frame without gravity; jerk_*: its change over dt. Needs dt and qw..qz."""
    a = G.rotate(G.vec("qw", "qx", "qy", "qz"), G.vec(*ACCEL))
    names = ("world_ax", "world_ay", "world_az")
    out = with_before(imu.withColumns(dict(zip(names, (a[0], a[1], a[2] - gravity), strict=True))), names, width)
    return out.withColumns({f"jerk_{c}": (F.col(f"world_a{c}") - b) / F.col("dt") for c, b in zip("xyz", _fields(names), strict=True)}).drop("__before")


def ties(df: DataFrame, *but: str) -> list[str]:
    return [c for c in ("scan_id", "event_id") if c in df.columns and c not in but]


def trailing_rate(df: DataFrame, stamp: str = "stamp_ns", last: int = 100, width: int | None = None) -> DataFrame:
    """rate: 1 / gap, and trailing_rate: the mean of the last `last` rates; the first row of a drive has none. Rates are
    added up in whole micro-hertz, so that the mean doesn't depend on the order of addition.

    width: of a time bucket in stamp's unit. Rows are then numbered and totalled in buckets, and a row's frame is its
    total less that of the row `last` places before, so a drive is spread over tasks; None: one ordered pass a drive.
    """
    if width is None:
        order = in_drive(stamp, of=df)
        gap = (F.col(stamp) - F.lag(stamp).over(order)) / NS
        out = df.withColumn("rate", F.when(gap > 0, 1.0 / gap))
        frame = order.rowsBetween(-(last - 1), 0)
        total = F.sum(F.round(F.col("rate") * 1e6).cast("bigint")).over(frame)
        return out.withColumn("trailing_rate", total / F.count("rate").over(frame) / 1e6)
    tie = ties(df, stamp)
    d = before(df, ["drive_id"], stamp, width, (stamp,), tie, "__before")
    gap = (F.col(stamp) - F.col("__before").getField(stamp)) / NS
    d = d.withColumn("rate", F.when(gap > 0, 1.0 / gap)).drop("__before")
    d = running(d, ["drive_id"], stamp, width, {"__s": F.round(F.col("rate") * 1e6).cast("bigint"), "__m": F.col("rate").isNotNull().cast("bigint")}, tie, "__n")
    past = d.select("drive_id", (F.col("__n") + last).alias("__n"), F.col("__s").alias("__s0"), F.col("__m").alias("__m0"))
    d = d.join(past, ["drive_id", "__n"], "left")
    total, n = (F.col(f"__{c}") - F.coalesce(f"__{c}0", F.lit(0)) for c in "sm")
    return d.select(*df.columns, "rate", F.when(n > 0, total / n / 1e6).alias("trailing_rate"))


def elapsed_time(scans: DataFrame, stamp: str = "scan_stamp_ns", width: int | None = None) -> DataFrame:
    """elapsed and scan_dt in seconds: since the drive's first scan, since the one before. width: see trailing_rate()."""
    if width is None:
        order = in_drive(stamp, of=scans)
        first = F.first(stamp).over(order.rowsBetween(Window.unboundedPreceding, 0))
        return scans.withColumns({"elapsed": (F.col(stamp) - first) / NS, "scan_dt": (F.col(stamp) - F.lag(stamp).over(order)) / NS})
    first = scans.groupBy("drive_id").agg(F.min(stamp).alias("__first"))
    d = before(scans, ["drive_id"], stamp, width, (stamp,), ties(scans, stamp), "__before").join(first, "drive_id")
    return d.select(*scans.columns, ((F.col(stamp) - F.col("__first")) / NS).alias("elapsed"), ((F.col(stamp) - F.col("__before").getField(stamp)) / NS).alias("scan_dt"))


def calibration_window(imu: DataFrame, seconds: float = 3.0) -> DataFrame:
    """Samples less than `seconds` after the drive's first."""
    first = imu.groupBy("drive_id").agg(F.min("stamp_ns").alias("__first"))
    return imu.join(first, "drive_id").filter((F.col("stamp_ns") - F.col("__first")) / NS < seconds).drop("__first")


def latest_samples(imu: DataFrame, n: int = 5000) -> DataFrame:
    """The newest n samples of each drive; partial limits before the shuffle keep a long drive from one task."""
    return imu.withColumn("__k", F.row_number().over(Window.partitionBy("drive_id").orderBy(F.desc("stamp_ns"), *[F.desc(c) for c in ("scan_id", "event_id") if c in imu.columns]))).filter(F.col("__k") <= n).drop("__k")


def transform_imu(imu: DataFrame, calibration: DataFrame, fallback_hz: float = 200.0, width: int | None = None) -> DataFrame:
    """Rates and accelerations at the body's origin: turned by the mounting, and rid of what the lever arm adds; and dt.

    w' = R w; a' = R a + (w' - w'_before) / dt x (-t) + w' x (w' x (-t)). A drive's first sample has no change of rate.
    width: see with_before().
    """
    turned = imu.join(calibration.select("drive_id", "imu_r", "imu_t"), "drive_id")
    r, t = G.items(F.col("imu_r"), 9), G.items(F.col("imu_t"), 3)
    arm = G.scale(t, -1.0)
    out = turned.withColumns(dict(zip(RATE, G.mat_vec(r, G.vec(*RATE)), strict=True)))
    out = with_before(out, ("stamp_ns", *RATE), width).withColumn("dt", _gap(fallback_hz))
    w = G.vec(*RATE)
    change = tuple(F.coalesce((x - b) / F.col("dt"), F.lit(0.0)) for x, b in zip(w, _fields(RATE), strict=True))
    out = out.withColumns({f"__d{c}": x for c, x in zip("xyz", change, strict=True)})
    a = G.add(G.add(G.mat_vec(r, G.vec(*ACCEL)), G.cross(G.vec("__dx", "__dy", "__dz"), arm)), G.cross(w, G.cross(w, arm)))
    return out.withColumns(dict(zip(ACCEL, a, strict=True))).drop("imu_r", "imu_t", "__dx", "__dy", "__dz", "__before")


def correct_imu(imu: DataFrame, biases: DataFrame, scale: bool = True) -> DataFrame:
    """a = S a - b_a, w = w - b_g; biases has drive_id, accel_bias, gyro_bias and, if scale, accel_sm."""
    keep = ["drive_id", "accel_bias", "gyro_bias", *(["accel_sm"] if scale else [])]
    d = imu.join(biases.select(*keep), "drive_id")
    a = G.mat_vec(G.items(F.col("accel_sm"), 9), G.vec(*ACCEL)) if scale else G.vec(*ACCEL)
    a = G.sub(a, G.items(F.col("accel_bias"), 3))
    w = G.sub(G.vec(*RATE), G.items(F.col("gyro_bias"), 3))
    return d.withColumns({**dict(zip(ACCEL, a, strict=True)), **dict(zip(RATE, w, strict=True))}).drop(*keep[1:])


def calibrate_imu(imu: DataFrame, params: Params | None = None, prior: DataFrame | None = None) -> DataFrame:
    """Standstill calibration of each drive from its first seconds: n, mean_*, gravity_*, qw..qz, accel_bias, gyro_bias,
    yaw, pitch, roll.

    Gravity is the mean acceleration, less a prior accel_bias where one is given, brought to the known length; the
    attitude turns it upright; biases are what is left over. Means come from sums of whole micro-units.
    """
    p = params or Params()
    mean = lambda c: (F.sum(F.round(F.col(c) * 1e6).cast("bigint")) / F.count(F.lit(1)) / 1e6).alias(f"mean_{c}")
    m = calibration_window(imu, p.imu_calib_time_s).groupBy("drive_id").agg(F.count(F.lit(1)).alias("n"), *[mean(c) for c in (*RATE, *ACCEL)])
    zero = F.array(*[F.lit(0.0)] * 3)
    if prior is not None:
        m = m.join(prior.select("drive_id", F.col("accel_bias").alias("__ab"), F.col("gyro_bias").alias("__gb")), "drive_id", "left")
    else:
        m = m.withColumns({"__ab": zero, "__gb": zero})
    m = m.withColumns({"__ab": F.coalesce("__ab", zero), "__gb": F.coalesce("__gb", zero)})
    mean_a, mean_w = G.vec("mean_ax", "mean_ay", "mean_az"), G.vec("mean_wx", "mean_wy", "mean_wz")
    up = (F.lit(0.0), F.lit(0.0), F.lit(p.gravity))
    g = G.scale(G.normalize(G.sub(mean_a, G.items(F.col("__ab"), 3))), abs(p.gravity)) if p.gravity_align else up
    m = m.withColumns({f"gravity_{c}": x for c, x in zip("xyz", g, strict=True)})
    g = G.vec("gravity_x", "gravity_y", "gravity_z")
    q = G.quat_between(g, up) if p.gravity_align else tuple(map(F.lit, (1.0, 0.0, 0.0, 0.0)))
    m = m.withColumns(dict(zip(("qw", "qx", "qy", "qz"), q, strict=True)))
    m = m.withColumn("accel_bias", F.array(*G.sub(mean_a, g)) if p.calibrate_accel else F.col("__ab"))
    m = m.withColumn("gyro_bias", F.array(*mean_w) if p.calibrate_gyro else F.col("__gb"))
    angles = G.euler_zyx_deg(G.quat_to_matrix(G.vec("qw", "qx", "qy", "qz")))
    return m.withColumns(dict(zip(("yaw", "pitch", "roll"), angles, strict=True))).drop("__ab", "__gb")


def after_calibration(imu: DataFrame, seconds: float = 3.0) -> DataFrame:
    """Samples that calibration leaves for use: those after the one that ended it. Of equal stamps the smaller scan_id or
    event_id goes first, then the row's hash. Two aggregations of a row a drive; no drive is ordered as a whole."""
    first = imu.groupBy("drive_id").agg(F.min("stamp_ns").alias("__first"))
    place = F.struct("stamp_ns", *ties(imu), F.xxhash64(*imu.columns).alias("h"))
    late = imu.join(first, "drive_id").filter((F.col("stamp_ns") - F.col("__first")) / NS >= seconds).withColumn("__at", place)
    end = late.groupBy("drive_id").agg(F.min("__at").alias("__end"))
    d = late.join(end, "drive_id")
    again = d.filter(F.col("__at") == F.col("__end")).withColumn("__k", F.row_number().over(Window.partitionBy("drive_id").orderBy("__at"))).filter("__k > 1")
    return d.filter(F.col("__at") > F.col("__end")).select(*imu.columns).unionByName(again.select(*imu.columns))


def ema(df: DataFrame, value: str, name: str, order: str = "scan_stamp_ns", alpha: float = 0.05, key: str = "drive_id", width: int | None = None) -> DataFrame:
    """df plus name: y = (1 - alpha) * y_before + alpha * x along `order`, seeded with the first x. Of equal `order` the
    smaller scan_id goes first, where there is one, and else the row's hash decides; repeated rows each count.

    width: of a bucket in the unit of `order`: buckets are then reduced side by side, as affine maps that compose, so a
    drive is spread over tasks. None: a drive's rows are folded in order, a batch at a time. A null value leaves y as it
    is.
    """
    tie = [c for c in ("scan_id",) if c in df.columns and c != order]
    if width is not None:
        return affine_scan(df, [key], order, width, value, alpha, [*tie, F.xxhash64(*df.columns)], name)

    def start():
        y = None

        def step(pdf: pd.DataFrame) -> pd.DataFrame:
            nonlocal y
            out = []
            for x in pdf[value].astype(float):
                if x == x:
                    y = x if y is None else (1 - alpha) * y + alpha * x
                out.append(y)
            return pdf.assign(**{name: np.array(out, dtype=float)})

        return step

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return folded(df, key, [order, *tie, F.xxhash64(*df.columns)], start, f"{fields}, `{name}` double")
