"""Sources and sinks: canonical tables, in batch and as streams."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.points import apply_time_offset, detect_sensor, normalize_point_time
from ..operators.trajectory import frames
from ..params import Params, schema

EYE, ZERO = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0], [0.0, 0.0, 0.0]


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(schema(name)).parquet(path)


def read_table_stream(spark: SparkSession, path: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema(name))
    return (reader if files_per_trigger is None else reader.option("maxFilesPerTrigger", files_per_trigger)).parquet(path)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, "points")


def read_points_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    return read_table_stream(spark, path, "points", files_per_trigger)


def read_imu(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, "imu")


def read_imu_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    return read_table_stream(spark, path, "imu", files_per_trigger)


def read_keyframes_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    return read_table_stream(spark, path, "keyframe_points", files_per_trigger)


def points_of_raw(raw: DataFrame, time_offset: bool = True) -> DataFrame:
    """Raw clouds of any sensor (drive_id, scan_id, point_id, scan_stamp_ns, x, y, z, intensity and the sensor's own
    time field) as points, times in nanoseconds."""
    p = apply_time_offset(normalize_point_time(detect_sensor(raw)), time_offset)
    return p.select(*[F.col(f.name).cast(f.dataType) for f in schema("points").fields], "sensor")


def load_calibration(source: DataFrame) -> DataFrame:
    """Calibration of each drive with defaults where a field is missing: no rotation, no shift, no bias, unit scale."""
    default = {"imu_r": EYE, "lidar_r": EYE, "accel_sm": EYE, "imu_t": ZERO, "lidar_t": ZERO, "accel_bias": ZERO, "gyro_bias": ZERO}
    lit = lambda v: F.array(*map(F.lit, v))
    return source.select("drive_id", *[(F.coalesce(F.col(c).cast("array<double>"), lit(v)) if c in source.columns else lit(v)).alias(c) for c, v in default.items()])


def load_params(source: DataFrame) -> Params:
    """Parameters from a table of name and value; names it lacks keep their defaults."""
    known = {f.name: f.type for f in fields(Params)}
    rows = {r["name"]: r["value"] for r in source.filter(F.col("name").isin(*known)).select("name", F.col("value").cast("string").alias("value")).limit(len(known)).collect()}
    as_type = {"float": float, "int": lambda v: int(float(v)), "bool": lambda v: v.strip().lower() in ("true", "1"), "str": str}
    return Params.of({k: as_type[known[k]](v) for k, v in rows.items()})


def append(df: DataFrame, path: str, by: tuple[str, ...] = ("drive_id",)) -> None:
    """Appends to a table that is laid out by drive."""
    df.write.mode("append").partitionBy(*by).parquet(path)


def write_states(states: DataFrame, path: str) -> None:
    append(states, path)


def write_path(poses: DataFrame, path: str) -> None:
    append(poses, path)


def write_frames(poses: DataFrame, calibration: DataFrame, path: str, params: Params | None = None) -> None:
    append(frames(poses, calibration, params), path)


def write_keyframes(keyframes: DataFrame, path: str) -> None:
    append(keyframes, path)


def write_keyframe_points(points: DataFrame, path: str) -> None:
    append(points, path)


def write_stream(df: DataFrame, path: str, checkpoint: str, every: str | None = None):
    """Appends a stream to a table; every: a trigger interval such as '10 milliseconds', else all there is, once."""
    w = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()
