"""Maps: appended keyframes, merged voxels, export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .points import transform_points, voxel_centroids, voxel_grid, voxel_sums

CELL = ("vx", "vy", "vz")


def map_append(map_points: DataFrame | None, keyframe_points: DataFrame, leaf: float = 0.25, keys: Sequence[str] = ("drive_id", "kf_id")) -> DataFrame:
    """The live map: each keyframe's points are voxelised alone and appended, without merging across keyframes."""
    own = voxel_grid(keyframe_points, leaf, keys)
    return own if map_points is None else map_points.unionByName(own)


def map_voxels(points: DataFrame, leaf: float = 0.25) -> DataFrame:
    """A drive's map as voxel sums, which merge by addition."""
    return voxel_sums(points, leaf, ("drive_id",))


def merge_voxels(*maps: DataFrame) -> DataFrame:
    out = maps[0]
    for m in maps[1:]:
        out = out.unionByName(m)
    sums = [c for c in out.columns if c.startswith("sum_")]
    return out.groupBy("drive_id", *CELL).agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in sums])


def map_export(points: DataFrame, leaf: float, path: str, files: int | None = None) -> bool:
    """Writes the whole map, voxelised anew at leaf, below path; False if its parent folder is not there."""
    spark = points.sparkSession
    parent = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    if parent is None or not parent.getFileSystem(spark._jsc.hadoopConfiguration()).exists(parent):
        return False
    out = voxel_centroids(voxel_sums(points, leaf, ("drive_id",))).select("drive_id", "x", "y", "z", "intensity", "n")
    (out if files is None else out.coalesce(files)).write.mode("overwrite").parquet(path)
    return True


def dense_cloud(deskewed: DataFrame, voxelised: DataFrame, corrections: DataFrame, filtered: bool = False) -> DataFrame:
    """The cloud to publish: the voxelised one if filtered, else the full one, moved by each scan's correction."""
    return transform_points(voxelised if filtered else deskewed, corrections, ("drive_id", "scan_id"))
