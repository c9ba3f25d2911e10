"""A table of points that grows and shrinks by versions: additions and removal marks, merged when it is read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEYS = ("drive_id", "scan_id", "point_id")
#: What a folder holds; of one version removals count before additions.
ADD, REMOVE = "add", "remove"


def _folders(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(version, kind) of the folders below path that were written to their end, in order."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for x in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(path, "version=*/op=*/_SUCCESS")) or ():
        own = x.getPath().getParent()
        found.append((int(own.getParent().getName().removeprefix("version=")), own.getName().removeprefix("op=")))
    return sorted(found)


def _path(path: str, version: int, op: str) -> str:
    return f"{path}/version={version}/op={op}"


def latest(spark: SparkSession, path: str) -> int | None:
    """The newest version; None where there is none."""
    return max((v for v, _ in _folders(spark, path)), default=None)


def add(points: DataFrame, path: str, version: int) -> None:
    """Points of this version; a key that is there already is replaced, one that was removed is back. Writing a version
    again gives the same."""
    points.write.mode("overwrite").parquet(_path(path, version, ADD))


def remove(keys: DataFrame, path: str, version: int, on: Sequence[str] = KEYS) -> None:
    """Keys that go with this version; those that are not there are no matter."""
    keys.select(*on).distinct().write.mode("overwrite").parquet(_path(path, version, REMOVE))


def read(spark: SparkSession, path: str, version: int | None = None, on: Sequence[str] = KEYS) -> DataFrame:
    """The points of a version, by default the newest: one scan from the newest base on, and one shuffle by key.

    Of each key the newest entry decides: an addition's rows are there (all of them, if it has several), a removal's are
    not. Null keys are keys like others. Without any version this raises.
    """
    there = [x for x in _folders(spark, path) if version is None or x[0] <= version]
    if not there:
        raise ValueError(f"no version below {path}")
    base = max((v for v, op in there if op == "base"), default=None)
    used = [_path(path, v, op) for v, op in there if base is None or v > base or (v, op) == (base, "base")]
    log = spark.read.option("basePath", path).option("mergeSchema", "true").parquet(*used)
    place = F.struct("version", (F.col("op") != REMOVE).alias("present"))
    last = F.max(place).over(Window.partitionBy(*on))
    return log.withColumn("__at", place).withColumn("__last", last).filter((F.col("__at") == F.col("__last")) & F.col("__at.present")).drop("__at", "__last", "version", "op")


def compact(spark: SparkSession, path: str, on: Sequence[str] = KEYS) -> None:
    """Writes the newest version as a base, from which reading then starts; older versions can still be read until
    vacuum()."""
    newest = latest(spark, path)
    if newest is not None and (newest, "base") not in _folders(spark, path):
        read(spark, path, newest, on).write.mode("overwrite").parquet(_path(path, newest, "base"))


def vacuum(spark: SparkSession, path: str) -> int:
    """Deletes what the newest base covers; versions before it can't be read any more. Gives the number of folders."""
    there = _folders(spark, path)
    base = max((v for v, op in there if op == "base"), default=None)
    old = [(v, op) for v, op in there if base is not None and (v, op) != (base, "base") and v <= base]
    for v, op in old:
        p = spark._jvm.org.apache.hadoop.fs.Path(_path(path, v, op))
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return len(old)
