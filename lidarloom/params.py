"""Parameters and table schemas."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import types as T


@dataclass(frozen=True)
class Params:
    """Scalar parameters; defaults are the shipped configuration's."""

    gravity: float = 9.80665
    imu_calib_time_s: float = 3.0
    gravity_align: bool = True
    calibrate_accel: bool = True
    calibrate_gyro: bool = True
    imu_buffer: int = 5000
    time_offset: bool = True
    deskew: bool = True
    crop_size: float = 1.0
    voxel_leaf: float = 0.25
    map_leaf: float = 0.25
    keyframe_dist: float = 1.0
    keyframe_rot_deg: float = 45.0
    submap_knn: int = 10
    submap_kcv: int = 10
    submap_kcc: int = 10
    adaptive: bool = True
    min_points: int = 64
    k_neighbours: int = 16
    max_corr_dist: float = 0.5
    max_iterations: int = 32
    inner_iterations: int = 10
    trans_eps: float = 0.01
    rot_eps: float = 0.01
    init_lambda: float = 1e-9
    k_p: float = 4.5
    k_v: float = 11.25
    k_q: float = 4.0
    k_ab: float = 2.25
    k_gb: float = 1.0
    abias_max: float = 5.0
    gbias_max: float = 0.5
    move_threshold: float = 0.1
    ema_alpha: float = 0.05
    fallback_rate_hz: float = 200.0
    calibrate_imu: bool = True
    voxelize: bool = True
    dense_filtered: bool = False
    wait_until_move: bool = True
    vehicle: str = ""
    odom_frame: str = "odom"
    base_frame: str = "base_link"
    imu_frame: str = "imu"
    lidar_frame: str = "lidar"

    def frame(self, name: str) -> str:
        """A frame's name, behind the vehicle's where it has one."""
        own = getattr(self, f"{name}_frame")
        return f"{self.vehicle}/{own}" if self.vehicle else own

    @classmethod
    def of(cls, values: dict) -> Params:
        """From a mapping such as a parsed configuration; names it doesn't know are an error."""
        known = {f.name: f.type for f in fields(cls)}
        if odd := sorted(set(values) - set(known)):
            raise ValueError(f"unknown parameters: {', '.join(odd)}")
        return cls(**values)


def _schema(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)


def schema(name: str) -> T.StructType:
    """Schema of a canonical table."""
    return _schema(SCHEMAS[name])


XYZ = "x double, y double, z double"
POSE = "px double, py double, pz double, qw double, qx double, qy double, qz double"
SE3 = "struct<r: array<double>, t: array<double>>"
SCHEMAS = {
    "points": f"drive_id string, scan_id bigint, point_id bigint, scan_stamp_ns bigint, stamp_ns bigint, {XYZ}, intensity double",
    "imu": "drive_id string, stamp_ns bigint, wx double, wy double, wz double, ax double, ay double, az double",
    "calibration": "drive_id string, imu_r array<double>, imu_t array<double>, lidar_r array<double>, lidar_t array<double>, accel_sm array<double>, accel_bias array<double>, gyro_bias array<double>",
    "poses": f"drive_id string, scan_id bigint, stamp_ns bigint, {POSE}, vx double, vy double, vz double",
    "keyframes": f"drive_id string, kf_id bigint, scan_id bigint, stamp_ns bigint, {POSE}, t_corr {SE3}",
    "keyframe_points": f"drive_id string, kf_id bigint, point_id bigint, {XYZ}, intensity double",
    "states": f"drive_id string, stamp_ns bigint, {POSE}, vx double, vy double, vz double, wx double, wy double, wz double",
}
