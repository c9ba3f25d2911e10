"""Odometry as one job: from points and IMU samples of many drives to trajectories, keyframes and maps.

A live system feeds each corrected pose into the next scan's prior, one scan after the other. Here passes go over all
scans at once: every pair of neighbouring scans is registered in parallel and the steps are chained; then every scan is
corrected for its own motion and registered to the submap of earlier keyframes, in parallel again, as often as wanted.
Results agree with the chain's within tolerance, not bit by bit, and biases are those of the calibration throughout.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import covariance, deskew, imu, keyframes, mapping, observer, points, registration, spatial, trajectory
from ..operators.points import SCAN
from ..params import Params
from ..session import stored
from ..sources.tables import load_calibration

POSE = ("px", "py", "pz", "qw", "qx", "qy", "qz")
CORNER = dict.fromkeys(POSE, 0.0) | {"qw": 1.0}


@dataclass(frozen=True)
class Odometry:
    """poses: drive_id, scan_id, stamp_ns, px..qz of each scan; states: rows of observe(); keyframes; keyframe_points and
    map (voxel sums) in the world, of scans from the first move on if wanted; metrics: of each scan; lengths: metres come
    so far, by the threshold of a move; frames: edges of the poses and the mounting; dense: every scan's cloud in the
    world, all its points or, if wanted, its voxels."""

    poses: DataFrame
    states: DataFrame
    keyframes: DataFrame
    keyframe_points: DataFrame
    map: DataFrame
    metrics: DataFrame
    lengths: DataFrame
    frames: DataFrame
    dense: DataFrame


def cleaned(raw: DataFrame, p: Params) -> DataFrame:
    """Points that count: finite, outside the crop box, in scans of enough of them, with times from the scan's stamp on."""
    kept = points.min_points_gate(points.clean_scan(raw, p.crop_size), p.min_points)
    return points.apply_time_offset(kept, p.time_offset)


def corrected_imu(samples: DataFrame, calibration: DataFrame, p: Params) -> tuple[DataFrame, DataFrame]:
    """(samples at the body's origin without biases, attitude of each drive at its start). Where a drive calibrates itself,
    its first seconds are used up by that, and scale and misalignment are left as they are."""
    body = stored(imu.transform_imu(samples, calibration, p.fallback_rate_hz))
    if not p.calibrate_imu:
        biases = calibration.select("drive_id", "accel_bias", "gyro_bias", "accel_sm")
        return imu.correct_imu(body, biases), calibration.select("drive_id", *[F.lit(float(c == "qw")).alias(c) for c in POSE[3:]])
    cal = stored(imu.calibrate_imu(body, p, calibration))
    biases = cal.select("drive_id", "accel_bias", "gyro_bias")
    used = imu.after_calibration(body, p.imu_calib_time_s)
    return imu.correct_imu(used, biases, scale=False), cal.select("drive_id", "qw", "qx", "qy", "qz")


def voxels(cloud: DataFrame, p: Params) -> DataFrame:
    """A scan's cloud, by voxels if wanted, each with an id of its own and the covariance of its surroundings."""
    if p.voxelize:
        v = points.voxel_grid(cloud, p.voxel_leaf)
        cloud = v.select(*SCAN, spatial.morton(F.col("x"), F.col("y"), F.col("z"), p.voxel_leaf).alias("point_id"), *"xyz", "intensity")
    v = stored(cloud.select(*SCAN, F.col("point_id").cast("long").alias("point_id"), *"xyz", "intensity"))
    near = stored(spatial.knn_join(v, v, p.k_neighbours, offsets=True))
    covs = covariance.local_covariance(near, v, "PLANE").drop("n")
    return stored(v.join(covs, [*SCAN, "point_id"]))


def pair_of(drive: str = "drive_id", scan: str = "scan_id"):
    return F.concat_ws("/", F.col(drive).cast("string"), F.col(scan).cast("string"))


def neighbour_steps(scans: DataFrame, cloud: DataFrame, samples: DataFrame, p: Params) -> DataFrame:
    """Each scan in the frame of the one before: drive_id, scan_id, stamp_ns, r, t; the first is at the origin. Rates of the
    samples between two scans give the turn to start from."""
    order = Window.partitionBy("drive_id").orderBy("stamp_ns", "scan_id")  # a row a scan
    s = stored(scans.select("*", F.lag("scan_id").over(order).alias("last_id"), F.lag("stamp_ns").over(order).alias("last_ns")))
    later = s.filter("last_id is not null")
    at_rest = {**{c: F.lit(v) for c, v in CORNER.items()}, **{c: F.lit(0.0) for c in ("vx", "vy", "vz")}}
    starts = later.select(*SCAN, F.col("last_ns").alias("start_ns")).withColumns(at_rest)
    turned = deskew.integrate_imu(starts, later.select(*SCAN, "stamp_ns"), samples, p.gravity)
    matrix = F.array(*G.quat_to_matrix(G.vec("qw", "qx", "qy", "qz")))
    guess = stored(turned.select(pair_of().alias("pair_id"), matrix.alias("r"), F.array(*[F.lit(0.0)] * 3).alias("t")))
    source = cloud.join(later.select(*SCAN), list(SCAN), "left_semi").withColumn("pair_id", pair_of())
    target = cloud.withColumnRenamed("scan_id", "last_id").join(later.select("drive_id", "scan_id", "last_id"), ["drive_id", "last_id"]).withColumn("pair_id", pair_of())
    found = registration.register(source, target, guess, p).select("pair_id", "r", "t")
    eye, zero = F.array(*map(F.lit, registration.EYE)), F.array(*[F.lit(0.0)] * 3)
    out = s.withColumn("pair_id", pair_of()).join(found, "pair_id", "left")
    return out.select(*SCAN, "stamp_ns", F.coalesce("r", eye).alias("r"), F.coalesce("t", zero).alias("t"))


def scan_metrics(cloud: DataFrame, scans: DataFrame, p: Params) -> DataFrame:
    """spaciousness and density of each scan, averaged along the drive, and the thresholds that follow from them."""
    near = spatial.knn_join(cloud, cloud, p.k_neighbours)
    m = points.median_planar_range(cloud).join(covariance.knn_density(near, p.k_neighbours), list(SCAN)).join(scans.select(*SCAN, F.col("stamp_ns").alias("scan_stamp_ns")), list(SCAN))
    m = imu.ema(imu.ema(m, "median_range", "spaciousness", alpha=p.ema_alpha), "density", "__density", alpha=p.ema_alpha)
    return keyframes.adaptive_params(m.drop("density").withColumnRenamed("__density", "density"), p.keyframe_dist, p.max_corr_dist)


def chosen(poses: DataFrame, metrics: DataFrame, p: Params) -> DataFrame:
    if not p.adaptive:
        return keyframes.select_keyframes(poses, p.keyframe_dist, p.keyframe_rot_deg)
    return keyframes.select_keyframes(poses.join(metrics.select(*SCAN, "keyframe_thresh"), list(SCAN)), None, p.keyframe_rot_deg)


def submaps(poses: DataFrame, kf: DataFrame, alpha: float, p: Params) -> DataFrame:
    """drive_id, scan_id, kf_id: of each scan the nearest earlier keyframes, those on the convex and on the concave hull."""
    convex = stored(keyframes.convex_hull_keyframes(kf))
    concave = stored(keyframes.concave_hull_keyframes(kf, alpha))
    return keyframes.submap_select(poses, kf, convex, concave, p.submap_knn, p.submap_kcv, p.submap_kcc, before="stamp_ns")


def moved(cloud: DataFrame, samples: DataFrame, starts: DataFrame, calibration: DataFrame, p: Params) -> DataFrame:
    """Points in the world by the poses that their scans start from, corrected for the motion within the scan if wanted."""
    return deskew.deskew(cloud, samples if p.deskew else samples.limit(0), starts, calibration, p.gravity)


def with_velocity(poses: DataFrame) -> DataFrame:
    """vx, vy, vz from the poses before and after: all are there at once, so an observer, which starts at rest and follows,
    isn't needed for it. A drive's ends take the one neighbour that they have; a single pose is at rest."""
    order = Window.partitionBy("drive_id").orderBy("stamp_ns", "scan_id")  # a row a scan
    here = F.struct("stamp_ns", *POSE[:3])
    d = poses.withColumns({"__a": F.coalesce(F.lag(here).over(order), here), "__b": F.coalesce(F.lead(here).over(order), here)})
    dt = (F.col("__b.stamp_ns") - F.col("__a.stamp_ns")) / 1e9
    return d.withColumns({f"v{c}": F.when(dt > 0, (F.col(f"__b.p{c}") - F.col(f"__a.p{c}")) / dt).otherwise(0.0) for c in "xyz"}).drop("__a", "__b")


def refined(cloud: DataFrame, samples: DataFrame, calibration: DataFrame, poses: DataFrame, metrics: DataFrame, p: Params) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One pass: (poses, and by them points and voxels in the world) from poses. Every scan is set into the world by the pose it starts
    from and the velocity there, corrected for its motion, and registered to its submap."""
    starts = stored(with_velocity(poses).select(*SCAN, F.col("stamp_ns").alias("start_ns"), *POSE, "vx", "vy", "vz"))
    world = stored(moved(cloud, samples, starts, calibration, p))
    prior = world.groupBy(*SCAN).agg(*[F.first(f"prior_{c}").alias(c) for c in POSE])
    v = voxels(world, p)
    kf = stored(chosen(poses, metrics, p))
    reach = metrics.agg(F.percentile_approx("keyframe_thresh", 0.5).alias("a")).first()["a"]
    members = stored(submaps(poses, kf, float(reach or p.keyframe_dist), p))
    of_kf = v.join(kf.select("drive_id", "scan_id", "kf_id"), list(SCAN)).drop("scan_id")
    # voxels of several keyframes may share an id, so it names the keyframe too
    target = keyframes.submap_assemble(members, of_kf).withColumn("point_id", F.xxhash64("kf_id", "point_id")).withColumn("pair_id", pair_of())
    source = v.join(members.select(*SCAN).distinct(), list(SCAN), "left_semi").withColumn("pair_id", pair_of())
    found = registration.register(source, target, None, p).select("pair_id", "r", "t")
    eye, zero = F.array(*map(F.lit, registration.EYE)), F.array(*[F.lit(0.0)] * 3)
    fix = poses.select(*SCAN, pair_of().alias("pair_id")).join(found, "pair_id", "left").select(*SCAN, F.coalesce("r", eye).alias("r"), F.coalesce("t", zero).alias("t"))
    fix = stored(fix)
    matrix = F.array(*G.quat_to_matrix(G.vec("qw", "qx", "qy", "qz")))
    # the correction is the same for the whole scan, so it moves the pose that the scan starts from
    at = starts.select(*SCAN, F.col("start_ns").alias("stamp_ns"), matrix.alias("r"), F.array("px", "py", "pz").alias("t")).join(prior.select(*SCAN), list(SCAN), "left_semi")
    out = stored(trajectory.corrected_poses(at, fix).select(*SCAN, "stamp_ns", *POSE))
    slim = (*SCAN, "point_id", *"xyz", "intensity")
    return out, points.transform_points(world.select(*slim), fix, list(SCAN)), stored(points.transform_points(v.select(*slim), fix, list(SCAN)))


def odometry(raw: DataFrame, samples: DataFrame, calibration: DataFrame | None = None, params: Params | None = None, initial: DataFrame | None = None, passes: int = 1) -> Odometry:
    """raw (points), samples (IMU) and the mounting of each drive -> Odometry. initial (drive_id, px..qz): the pose of each
    drive's first scan, by default the origin with the attitude that gravity tells. passes: rounds of motion correction
    and registration to submaps after the chain of neighbouring scans.

    Drives without samples or scans have no rows. Null points go, scans with too few points and scans up to the first
    sample in use too. Repeated points count each.
    """
    p = params or Params()
    calibration = stored(load_calibration(raw.select("drive_id").distinct()) if calibration is None else calibration)
    samples, upright = corrected_imu(samples, calibration, p)
    samples = stored(samples)
    cloud = cleaned(raw, p)
    scans = points.first_valid_scan_gate(cloud.groupBy(*SCAN).agg(F.min("scan_stamp_ns").alias("scan_stamp_ns")), samples)
    scans = stored(scans.select(*SCAN, F.col("scan_stamp_ns").alias("stamp_ns")))
    cloud = stored(cloud.join(scans.select(*SCAN), list(SCAN), "left_semi"))
    lidar = calibration.select("drive_id", F.col("lidar_r").alias("r"), F.col("lidar_t").alias("t"))
    body = voxels(points.transform_points(cloud, lidar, ["drive_id"]), p)
    metrics = stored(scan_metrics(body, scans, p))
    chain = trajectory.chain_poses(neighbour_steps(scans, body, samples, p))
    first = (upright.withColumns({c: F.lit(0.0) for c in POSE[:3]}) if initial is None else initial).select("drive_id", F.array(*G.quat_to_matrix(G.vec("qw", "qx", "qy", "qz"))).alias("r"), F.array("px", "py", "pz").alias("t"))
    poses = trajectory.corrected_poses(chain.select(*SCAN, "stamp_ns", "r", "t"), chain.select(*SCAN).join(first, "drive_id"))
    poses = stored(poses.select(*SCAN, "stamp_ns", *POSE))
    if passes < 1:
        at = stored(poses.select(*SCAN, F.array(*G.quat_to_matrix(G.vec("qw", "qx", "qy", "qz"))).alias("r"), F.array("px", "py", "pz").alias("t")))
        slim = (*SCAN, "point_id", *"xyz", "intensity")
        full, world = (points.transform_points(c.select(*slim), at, list(SCAN)) for c in (points.transform_points(cloud, lidar, ["drive_id"]), body))
    for _ in range(passes):
        poses, full, world = refined(cloud, samples, calibration, poses, metrics, p)
    kf = stored(chosen(poses, metrics, p))
    lengths = stored(trajectory.trajectory_length(poses, p.move_threshold))
    mapped = trajectory.wait_until_move(kf, lengths, p.move_threshold) if p.wait_until_move else kf
    kf_points = world.join(mapped.select("drive_id", "scan_id", "kf_id"), list(SCAN)).select("drive_id", "kf_id", "point_id", *"xyz", "intensity")
    return Odometry(
        poses, observer.observe(samples, poses, p), kf, kf_points, mapping.map_voxels(kf_points, p.map_leaf), metrics, lengths, trajectory.frames(poses, calibration, p),
        world if p.dense_filtered else full,
    )
