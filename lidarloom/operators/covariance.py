"""Local covariances of neighbourhoods, and density."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COVS = ("cxx", "cxy", "cxz", "cyy", "cyz", "czz")
METHODS = ("NONE", "MIN_EIG", "NORMALIZED_MIN_EIG", "PLANE", "FROBENIUS")


def raw_covariance(neighbours: DataFrame, points: DataFrame, on: Sequence[str] = ("drive_id", "scan_id"), point: str = "point_id") -> DataFrame:
    """Population covariance of each left point's neighbours: on, point, n, and the six entries.

    Moments are taken about the left point, whose coordinates the neighbours share to within the search distance, so
    little is lost to cancellation. Neighbours that have dx, dy, dz (knn_join with offsets) need no look at the points.
    """
    if {"dx", "dy", "dz"} <= set(neighbours.columns):
        pairs = neighbours.select(*on, "left_id", *[F.col(f"d{c}").alias(c) for c in "xyz"])
    else:
        p = points.select(*on, point, *"xyz")
        pairs = neighbours.select(*on, "left_id", "right_id")
        pairs = pairs.join(p.select(*on, F.col(point).alias("left_id"), *[F.col(c).alias(f"l{c}") for c in "xyz"]), [*on, "left_id"])
        pairs = pairs.join(p.select(*on, F.col(point).alias("right_id"), *[F.col(c).alias(f"r{c}") for c in "xyz"]), [*on, "right_id"])
        pairs = pairs.select(*on, "left_id", *[(F.col(f"r{c}") - F.col(f"l{c}")).alias(c) for c in "xyz"])
    return pairs.groupBy(*on, F.col("left_id").alias(point)).agg(F.count(F.lit(1)).alias("n"), *[(F.sum(F.col(a) * F.col(b)) / F.count(F.lit(1)) - F.avg(a) * F.avg(b)).alias(f"c{a}{b}") for a, b in (x[1:] for x in COVS)])


def regularised(c: np.ndarray, method: str) -> np.ndarray:
    """c: n x 3 x 3."""
    if method == "NONE" or not len(c):
        return c
    if method == "FROBENIUS":
        loose = c + 1e-3 * np.eye(3)
        inverse = np.linalg.inv(loose)
        return np.linalg.inv(inverse / np.linalg.norm(inverse, axis=(1, 2), keepdims=True))
    values, vectors = np.linalg.eigh(c)  # ascending
    if method == "PLANE":
        normal = vectors[:, :, 0]
        return np.eye(3) - 0.999 * normal[:, :, None] * normal[:, None, :]
    if method == "MIN_EIG":
        values = np.maximum(values, 1e-3)
    elif method == "NORMALIZED_MIN_EIG":
        values = np.maximum(values / values[:, 2:], 1e-3)
    else:
        raise ValueError(f"method is one of {', '.join(METHODS)}")
    return (vectors * values[:, None, :]) @ vectors.transpose(0, 2, 1)


def regularise(covs: DataFrame, method: str = "PLANE") -> DataFrame:
    """The six entries after regularisation, eigenvectors by Arrow batch; the rest as it was."""
    if method not in METHODS:
        raise ValueError(f"method is one of {', '.join(METHODS)}")
    if method == "NONE":
        return covs

    def run(batches):
        for pdf in batches:
            v = pdf[list(COVS)].to_numpy()
            c = regularised(v[:, [0, 1, 2, 1, 3, 4, 2, 4, 5]].reshape(-1, 3, 3), method)
            pdf[list(COVS)] = c.reshape(-1, 9)[:, [0, 1, 2, 4, 5, 8]]
            yield pdf

    return covs.mapInPandas(run, covs.schema)


def local_covariance(neighbours: DataFrame, points: DataFrame, method: str = "PLANE", on: Sequence[str] = ("drive_id", "scan_id"), point: str = "point_id") -> DataFrame:
    return regularise(raw_covariance(neighbours, points, on, point), method)


def knn_density(neighbours: DataFrame, k: int, on: Sequence[str] = ("drive_id", "scan_id")) -> DataFrame:
    """Per key: mean over its points of the sum of squared distances to neighbours 2 to k over ((k - 1)(k + 2)) div 2.
    Sums are of whole square micrometres."""
    of_point = neighbours.groupBy(*on, "left_id").agg(F.sum(F.when(F.col("rank") > 1, F.round(F.col("d2") * 1e6).cast("bigint")).otherwise(0)).alias("s"))
    over = ((k - 1) * (k + 2)) // 2
    return of_point.groupBy(*on).agg((F.sum("s") / F.count(F.lit(1)) / over / 1e6).alias("density"))


