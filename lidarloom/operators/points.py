"""Point clouds: cleaning, sensor time, transforms, voxels and per-scan metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G

SCAN = ("drive_id", "scan_id")
MICRO = 1_000_000


def drop_nan(points: DataFrame) -> DataFrame:
    """Points with all of x, y, z finite."""
    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in "xyz"]
    return points.filter(finite[0] & finite[1] & finite[2])


def crop_box(points: DataFrame, size: float = 1.0) -> DataFrame:
    """Points outside the cube of half-length size around the sensor; its faces count as inside."""
    inside = [F.col(c).between(-size, size) for c in "xyz"]
    return points.filter(~(inside[0] & inside[1] & inside[2]))


def detect_sensor(raw: DataFrame, keys: Sequence[str] = SCAN) -> DataFrame:
    """raw plus sensor, by which of the fields t, time and timestamp its schema has first (wire order). Values of
    timestamp up to 1e14 are seconds, above it nanoseconds; the first point of a scan decides."""
    field = next((c for c in raw.columns if c in ("t", "time", "timestamp")), None)
    if field != "timestamp":
        return raw.withColumn("sensor", F.lit({"t": "OUSTER", "time": "VELODYNE"}.get(field, "UNKNOWN")))
    first = F.first("timestamp").over(Window.partitionBy(*keys).orderBy("point_id"))
    return raw.withColumn("sensor", F.when(first < 1e14, "HESAI").when(first > 1e14, "LIVOX").otherwise("UNKNOWN"))


def normalize_point_time(raw: DataFrame) -> DataFrame:
    """stamp_ns from the sensor's own time field and the scan's stamp, in whole nanoseconds; null if the sensor is
    unknown."""
    has = set(raw.columns)
    ref = F.col("scan_stamp_ns")
    ns = lambda seconds: F.round(seconds * 1e9).cast("bigint")
    null = F.lit(None).cast("bigint")
    of = lambda field, value: value if field in has else null
    return raw.withColumn(
        "stamp_ns",
        F.when(F.col("sensor") == "OUSTER", of("t", ref + (F.col("t") if "t" in has else null).cast("bigint")))
        .when(F.col("sensor") == "VELODYNE", of("time", ref + ns(F.col("time"))) if "time" in has else null)
        .when(F.col("sensor") == "HESAI", ns(F.col("timestamp")) if "timestamp" in has else null)
        .when(F.col("sensor") == "LIVOX", F.col("timestamp").cast("bigint") if "timestamp" in has else null),
    )


def apply_time_offset(points: DataFrame, enabled: bool = True, keys: Sequence[str] = SCAN) -> DataFrame:
    """Moves all times of a scan so that its first point is at the scan's stamp."""
    if not enabled:
        return points
    first = F.min("stamp_ns").over(Window.partitionBy(*keys))
    return points.withColumn("stamp_ns", F.col("stamp_ns") + (F.col("scan_stamp_ns") - first))


def min_points_gate(points: DataFrame, least: int = 64, keys: Sequence[str] = SCAN) -> DataFrame:
    """Scans with more than `least` points."""
    enough = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > least).select(*keys)
    return points.join(enough, list(keys), "left_semi")


def first_valid_scan_gate(scans: DataFrame, imu: DataFrame) -> DataFrame:
    """Per drive, scans from the first one on whose stamp is later than the drive's first IMU sample."""
    first = imu.groupBy("drive_id").agg(F.min("stamp_ns").alias("first_imu_ns"))
    return scans.join(first, "drive_id").filter(F.col("scan_stamp_ns") > F.col("first_imu_ns")).drop("first_imu_ns")


def complete_cloud_check(points: DataFrame, scans: DataFrame, keys: Sequence[str] = SCAN) -> DataFrame:
    """Scans whose number of points is width * height."""
    n = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_points"))
    return scans.join(n, list(keys)).filter(F.col("n_points") == F.col("width") * F.col("height"))


def transform_points(points: DataFrame, transforms: DataFrame, keys: Sequence[str], r: str = "r", t: str = "t") -> DataFrame:
    """p' = R p + t with the transform (arrays of 9 and 3) of the same keys; r and t don't come along."""
    moved = points.join(transforms.select(*keys, F.col(r).alias("__r"), F.col(t).alias("__t")), list(keys))
    p = G.se3_apply(G.items(F.col("__r"), 9), G.items(F.col("__t"), 3), G.vec("x", "y", "z"))
    return moved.withColumns(dict(zip("xyz", p, strict=True))).drop("__r", "__t")


def transform_covariances(covs: DataFrame, transforms: DataFrame, keys: Sequence[str], r: str = "r") -> DataFrame:
    """C' = R C R^T."""
    names = ("cxx", "cxy", "cxz", "cyy", "cyz", "czz")
    moved = covs.join(transforms.select(*keys, F.col(r).alias("__r")), list(keys))
    c = G.sym_rotate(G.items(F.col("__r"), 9), G.vec(*names))
    return moved.withColumns(dict(zip(names, c, strict=True))).drop("__r")


def micro(c: Column) -> Column:
    """Whole micrometres: sums of these don't depend on their order."""
    return F.round(c * MICRO).cast("bigint")


def cell(c: Column, size: float) -> Column:
    return F.floor(c / size).cast("bigint")


def voxel_sums(points: DataFrame, leaf: float, keys: Sequence[str] = SCAN, means: Sequence[str] = ("intensity",)) -> DataFrame:
    """One row an occupied cube: vx, vy, vz, n, sum_x_um, sum_y_um, sum_z_um and a sum for each of `means`. Rows can be
    added up again, so maps merge by these."""
    at = [cell(F.col(c), leaf).alias(f"v{c}") for c in "xyz"]
    sums = [F.sum(micro(F.col(c))).alias(f"sum_{c}_um") for c in "xyz"]
    more = [F.sum(micro(F.col(c))).alias(f"sum_{c}_micro") for c in means]
    return points.groupBy(*keys, *at).agg(F.count(F.lit(1)).alias("n"), *sums, *more)


def voxel_centroids(sums: DataFrame, means: Sequence[str] = ("intensity",)) -> DataFrame:
    mean = lambda total: F.col(total) / F.col("n") / MICRO
    rest = [c for c in sums.columns if not c.startswith("sum_")]
    return sums.select(*rest, *[mean(f"sum_{c}_um").alias(c) for c in "xyz"], *[mean(f"sum_{c}_micro").alias(c) for c in means])


def voxel_grid(points: DataFrame, leaf: float = 0.25, keys: Sequence[str] = SCAN, means: Sequence[str] = ("intensity",)) -> DataFrame:
    """The centroid of each occupied cube of side leaf, with the mean of the other numeric fields named. One shuffle,
    with partial sums before it, so a dense cell is a row a task."""
    return voxel_centroids(voxel_sums(points, leaf, keys, means), means)


def bounding_box(points: DataFrame, keys: Sequence[str] = SCAN) -> DataFrame:
    return points.groupBy(*keys).agg(*[f(c).alias(f"{name}_{c}") for c in "xyz" for name, f in (("min", F.min), ("max", F.max))])


def upper_median(df: DataFrame, keys: Sequence[str], value: Column, name: str) -> DataFrame:
    """Element n div 2 (from 0) of each group's sorted values. Values are counted first, so what is ranked is a row for
    each different value, and ranks come from running counts."""
    v = df.filter(value.isNotNull()).groupBy(*keys, value.alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__v"))
    total = F.sum("__n").over(Window.partitionBy(*keys))
    v = v.withColumn("__upto", upto).withColumn("__at", F.floor(total / 2).cast("bigint"))
    return v.filter((F.col("__upto") > F.col("__at")) & (F.col("__upto") - F.col("__n") <= F.col("__at"))).select(*keys, F.col("__v").alias(name))


def median_planar_range(points: DataFrame, keys: Sequence[str] = SCAN) -> DataFrame:
    return upper_median(points, keys, G.planar_range(F.col("x"), F.col("y")), "median_range")


def distinct_stamps(points: DataFrame, keys: Sequence[str] = SCAN) -> DataFrame:
    """Each different point time of a scan, how many points have it, and the first of them."""
    return points.groupBy(*keys, "stamp_ns").agg(F.count(F.lit(1)).alias("n"), F.min("point_id").alias("first_point_id")) if "point_id" in points.columns else points.groupBy(*keys, "stamp_ns").agg(F.count(F.lit(1)).alias("n"))


def scan_median_stamp(points: DataFrame, keys: Sequence[str] = SCAN) -> DataFrame:
    """Element n div 2 of a scan's different times, in order."""
    stamps = points.groupBy(*keys, "stamp_ns").agg(F.lit(1).alias("one"))
    at = Window.partitionBy(*keys).orderBy("stamp_ns")
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    ranked = stamps.withColumn("__k", F.row_number().over(at)).withColumn("__n", n)
    return ranked.filter(F.col("__k") == F.floor(F.col("__n") / 2) + 1).select(*keys, F.col("stamp_ns").alias("median_stamp_ns"))


def sort_by_time(points: DataFrame, keys: Sequence[str] = SCAN) -> DataFrame:
    """Each scan's points in order of time, then id, scans kept whole in a partition."""
    return points.repartition(*keys).sortWithinPartitions(*keys, "stamp_ns", "point_id")


def clean_scan(points: DataFrame, size: float = 1.0) -> DataFrame:
    return crop_box(drop_nan(points), size)
