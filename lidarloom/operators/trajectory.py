"""Poses along a drive: chains, lengths, frames, statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..params import Params
from ..plans.ordered import folded, ordinal

HOUR_NS = 3_600_000_000_000


def turns(r: pd.Series) -> np.ndarray:
    """Rotations in extended precision from nine numbers each, or from three: a rotation vector."""
    v = np.array(r.to_list(), dtype=np.longdouble)
    if v.shape[1] == 9:
        return v.reshape(-1, 3, 3)
    s2 = (v**2).sum(1)
    s, tiny = np.sqrt(s2), s2 < 1e-12
    one = np.where(tiny, 1, s)
    a = np.where(tiny, 1 - s2 / 6, np.sin(s) / one)[:, None, None]
    b = np.where(tiny, 0.5 - s2 / 24, (1 - np.cos(s)) / one**2)[:, None, None]
    k = np.zeros((len(v), 3, 3), dtype=np.longdouble)
    for i, j, c, sign in ((0, 1, 2, -1), (0, 2, 1, 1), (1, 2, 0, -1)):
        k[:, i, j], k[:, j, i] = sign * v[:, c], -sign * v[:, c]
    return np.eye(3, dtype=np.longdouble) + a * k + b * (k @ k)


#: A place and a turn in extended precision as pairs of doubles.
PARTS = ("r", "r_low", "t", "t_low")


def in_parts(r: np.ndarray, t: np.ndarray) -> dict[str, list[list[float]]]:
    out = {}
    for name, v in (("r", r.reshape(len(r), 9)), ("t", t)):
        high = v.astype(float)
        out |= {name: high.tolist(), f"{name}_low": (v - high).astype(float).tolist()}
    return out


def of_parts(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    r, r_low, t, t_low = (np.array(pdf[c].to_list(), dtype=np.longdouble) for c in PARTS)
    return (r + r_low).reshape(-1, 3, 3), t + t_low


def products(r: np.ndarray, t: np.ndarray, turn: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each step set behind all before it, the first behind turn and place."""
    rs, ts = np.empty_like(r), np.empty_like(t)
    for i in range(len(r)):
        place, turn = turn @ t[i] + place, turn @ r[i]
        rs[i], ts[i] = turn, place
    return rs, ts


def chain_poses(steps: DataFrame, width: int = HOUR_NS) -> DataFrame:
    """steps (drive_id, scan_id, stamp_ns, r, t: this scan in the frame of the one before) -> r, t in the drive's first
    frame, and px..qz. r: nine numbers, or three: a rotation vector, which holds a turn more exactly than its sines.

    A prefix product: the product of each (drive, time bucket), chained per drive (a row a bucket), and each bucket's rows
    behind the buckets before it. Small errors of a turn grow with the way behind it, so products are of extended
    precision and rounded once, at the end.
    """
    d = steps.select("drive_id", F.floor(F.col("stamp_ns") / width).cast("long").alias("__b"), "scan_id", "stamp_ns", "r", "t")
    keys = f"drive_id {dict(steps.dtypes)['drive_id']}, __b long"
    parts = f"{keys}, " + ", ".join(f"{c} array<double>" for c in PARTS)
    start = np.eye(3, dtype=np.longdouble), np.zeros(3, dtype=np.longdouble)

    def ordered(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
        pdf = pdf.sort_values(["stamp_ns", "scan_id"])
        return pdf, turns(pdf["r"]), np.array(pdf["t"].to_list(), dtype=np.longdouble)

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, r, t = ordered(pdf)
        r, t = products(r, t, *start)
        return pdf[["drive_id", "__b"]].tail(1).assign(**in_parts(r[-1:], t[-1:]))

    def before(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__b")
        r, t = products(*of_parts(pdf), *start)
        r, t = (np.concatenate([a[None], x[:-1]]) for a, x in zip(start, (r, t), strict=True))
        return pdf[["drive_id", "__b"]].assign(**in_parts(r, t))

    def behind(pdf: pd.DataFrame, head: pd.DataFrame) -> pd.DataFrame:
        pdf, r, t = ordered(pdf)
        turn, place = of_parts(head)
        r, t = products(r, t, turn[0], place[0])
        return pdf[["drive_id", "scan_id", "stamp_ns"]].assign(r=r.reshape(-1, 9).astype(float).tolist(), t=t.astype(float).tolist())

    heads = d.groupBy("drive_id", "__b").applyInPandas(total, parts).groupBy("drive_id").applyInPandas(before, parts)
    both = d.groupBy("drive_id", "__b").cogroup(heads.groupBy("drive_id", "__b"))
    return with_pose(both.applyInPandas(behind, f"{keys.removesuffix(', __b long')}, scan_id long, stamp_ns long, r array<double>, t array<double>"))


def with_pose(df: DataFrame) -> DataFrame:
    """Adds px..qz from r and t; the quaternion has length 1."""
    q = G.normalize(G.matrix_to_quat(G.items(F.col("r"), 9)))
    return df.withColumns({**{f"p{c}": F.get("t", i) for i, c in enumerate("xyz")}, **dict(zip(("qw", "qx", "qy", "qz"), q, strict=True))})


def corrected_poses(priors: DataFrame, corrections: DataFrame) -> DataFrame:
    """T = T_corr T_prior for each scan: priors (drive_id, scan_id, stamp_ns, r, t), corrections (drive_id, scan_id, r, t)."""
    c = corrections.select("drive_id", "scan_id", F.col("r").alias("__r"), F.col("t").alias("__t"))
    d = priors.join(c, ["drive_id", "scan_id"])
    r, t = G.se3_compose((G.items(F.col("__r"), 9), G.items(F.col("__t"), 3)), (G.items(F.col("r"), 9), G.items(F.col("t"), 3)))
    return with_pose(d.withColumns({"r": F.array(*r), "t": F.array(*t)}).drop("__r", "__t"))


def trajectory_length(poses: DataFrame, least: float = 0.1, stamp: str = "stamp_ns", tie: str = "scan_id") -> DataFrame:
    """(drive_id, stamp, tie, px, py, pz) -> drive_id, stamp, tie, length so far: the sum of steps of at least `least`,
    each measured from the last pose that was accepted. A step depends on which poses were accepted before, so a drive's
    poses, six numbers each, are folded in order, a batch at a time."""
    kinds = dict(poses.dtypes)

    def start():
        at, total = None, 0.0

        def step(pdf: pd.DataFrame) -> pd.DataFrame:
            nonlocal at, total
            out = []
            for p in pdf[["px", "py", "pz"]].to_numpy(float).tolist():
                at = p if at is None else at
                d = sum((a - b) ** 2 for a, b in zip(p, at, strict=True)) ** 0.5
                if d >= least:
                    total, at = total + d, p
                out.append(total)
            return pdf[["drive_id", stamp, tie]].assign(length=out)

        return step

    slim = poses.select("drive_id", stamp, tie, "px", "py", "pz")
    return folded(slim, "drive_id", [stamp, tie], start, f"drive_id {kinds['drive_id']}, {stamp} {kinds[stamp]}, {tie} {kinds[tie]}, length double")


def wait_until_move(scans: DataFrame, lengths: DataFrame, least: float = 0.1) -> DataFrame:
    """Scans from when their drive has come `least` metres."""
    return scans.join(lengths.select("drive_id", "scan_id", "length"), ["drive_id", "scan_id"]).filter(F.col("length") >= least).drop("length")


def frames(poses: DataFrame, calibration: DataFrame, params: Params | None = None) -> DataFrame:
    """Three edges a scan: odom to base_link (the pose), base_link to imu and to lidar (the mounting), by the names that
    params give them."""
    name = (params or Params()).frame
    d = poses.join(calibration.select("drive_id", "imu_r", "imu_t", "lidar_r", "lidar_t"), "drive_id")

    def edge(parent, child, r, t):
        q = G.matrix_to_quat(r) if r is not None else G.vec("qw", "qx", "qy", "qz")
        fields = [F.lit(parent).alias("parent"), F.lit(child).alias("child"), *[x.alias(f"t{c}") for c, x in zip("xyz", t, strict=True)], *[x.alias(f"r{c}") for c, x in zip("wxyz", q, strict=True)]]
        return F.struct(*fields)

    edges = F.array(
        edge(name("odom"), name("base"), None, G.vec("px", "py", "pz")),
        edge(name("base"), name("imu"), G.items(F.col("imu_r"), 9), G.items(F.col("imu_t"), 3)),
        edge(name("base"), name("lidar"), G.items(F.col("lidar_r"), 9), G.items(F.col("lidar_t"), 3)),
    )
    return d.select("drive_id", "scan_id", "stamp_ns", F.explode(edges).alias("e")).select("drive_id", "scan_id", "stamp_ns", "e.*")


def run_statistics(scans: DataFrame) -> DataFrame:
    """Per drive, from logged columns (comp_time, rate, is_keyframe, deskew_stamps, px, py, pz, scan_stamp_ns): average
    and largest processing time, average rate, numbers of scans, keyframes and corrected times, distance from the
    origin at the end."""
    return scans.groupBy("drive_id").agg(
        F.count(F.lit(1)).alias("n_scans"), F.avg("comp_time").alias("avg_comp_time"), F.max("comp_time").alias("max_comp_time"), F.avg("rate").alias("avg_rate"),
        F.count_if("is_keyframe").alias("n_keyframes"), F.sum("deskew_stamps").alias("n_deskew_stamps"),
        F.max_by(F.sqrt(F.col("px") ** 2 + F.col("py") ** 2 + F.col("pz") ** 2), F.struct("scan_stamp_ns", *[c for c in ("scan_id",) if c in scans.columns])).alias("distance_to_origin"),
    )


def pose_places(poses: DataFrame, width: int = HOUR_NS) -> DataFrame:
    """Poses with n, their place in the drive: the index of the path."""
    return ordinal(poses, ["drive_id"], "stamp_ns", width, ["scan_id"], "n")
