"""State of a drive between and at scans: strapdown steps per IMU sample, a geometric observer per scan pose."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import Params
from ..plans.ordered import folded

NAMES = ("px", "py", "pz", "qw", "qx", "qy", "qz", "vx", "vy", "vz", "bax", "bay", "baz", "bgx", "bgy", "bgz")


def product(a, b):
    """Of two quaternions (w, x, y, z), as plain numbers: a fold takes one event at a time, so arrays would only cost."""
    aw, ax, ay, az = a
    bw, bx, by, bz = b
    return (aw * bw - ax * bx - ay * by - az * bz, aw * bx + bw * ax + ay * bz - az * by, aw * by + bw * ay + az * bx - ax * bz, aw * bz + bw * az + ax * by - ay * bx)


def turned(q, v):
    w, x, y, z = q
    ux, uy, uz = v
    tx, ty, tz = 2 * (y * uz - z * uy), 2 * (z * ux - x * uz), 2 * (x * uy - y * ux)
    return (ux + w * tx + y * tz - z * ty, uy + w * ty + z * tx - x * tz, uz + w * tz + x * ty - y * tx)


def conjugate(q):
    return (q[0], -q[1], -q[2], -q[3])


def unit(q):
    n = sum(x * x for x in q) ** 0.5
    return tuple(x / n for x in q)


def plus(a, b, k: float = 1.0):
    return tuple(x + k * y for x, y in zip(a, b, strict=True))


def held(v, most: float):
    return tuple(min(max(x, -most), most) for x in v)


ZERO = (0.0, 0.0, 0.0)


@dataclass
class State:
    p: tuple = ZERO
    q: tuple = (1.0, 0.0, 0.0, 0.0)
    v: tuple = ZERO
    ba: tuple = ZERO
    bg: tuple = ZERO
    body_v: tuple = ZERO
    body_w: tuple = ZERO

    def propagate(self, w, a, dt: float, gravity: float) -> None:
        """One sample: world acceleration by the attitude before it, position and velocity, then the attitude."""
        x, y, z = turned(self.q, a)
        world = (x, y, z - gravity)
        self.p = plus(plus(self.p, self.v, dt), world, dt * dt / 2)
        self.v = plus(self.v, world, dt)
        self.body_v = turned(conjugate(self.q), self.v)
        self.q, self.body_w = unit(plus(self.q, product(self.q, (0.0, *w)), dt / 2)), tuple(w)

    def observe(self, p, q, dt: float, k: Params) -> None:
        """One measured pose: pulls the state and the biases towards it in proportion to the errors and to dt."""
        e = product(conjugate(self.q), q)
        side = -1.0 if e[0] < 0 else 1.0
        pull = product(self.q, (1 - abs(e[0]), *(side * x for x in e[1:])))
        err = plus(p, self.p, -1.0)
        self.ba = held(plus(self.ba, turned(conjugate(self.q), err), -dt * k.k_ab), k.abias_max)
        self.bg = held(plus(self.bg, e[1:], -dt * k.k_gb * e[0]), k.gbias_max)
        self.p = plus(self.p, err, dt * k.k_p)
        self.v = plus(self.v, err, dt * k.k_v)
        self.q = unit(plus(self.q, pull, dt * k.k_q))

    def row(self) -> list[float]:
        return [*self.p, *self.q, *self.v, *self.ba, *self.bg]

    @staticmethod
    def of(values) -> State:
        x = tuple(map(float, values))
        return State(x[:3], x[3:7], x[7:10], x[10:13], x[13:16])


class Fold:
    """Events of one drive in order: (stamp_ns, kind, values); kind 'imu' with w and a, kind 'pose' with p and q.

    The first pose sets the state; samples before it are passed over. Samples are corrected by the present biases.
    """

    def __init__(self, params: Params, state: State | None = None, last_imu: int | None = None, last_pose: int | None = None) -> None:
        self.k, self.state, self.last_imu, self.last_pose = params, state, last_imu, last_pose

    def take(self, stamp: int, kind: str, values) -> list[float] | None:
        x = tuple(values)
        if kind == "pose":
            if self.state is None:
                self.state = State(p=x[:3], q=unit(x[3:7]))
            else:
                self.state.observe(x[:3], x[3:7], (stamp - self.last_pose) / 1e9, self.k)
            self.last_pose = stamp
        else:
            gap = None if self.last_imu is None else (stamp - self.last_imu) / 1e9
            self.last_imu = stamp
            if self.state is None or gap is None:
                return None
            dt = gap if gap else 1.0 / self.k.fallback_rate_hz
            self.state.propagate(plus(x[:3], self.state.bg, -1.0), plus(x[3:6], self.state.ba, -1.0), dt, self.k.gravity)
        return self.state.row()


def events(imu: DataFrame, poses: DataFrame) -> DataFrame:
    """The two series as one: drive_id, stamp_ns, kind, v (6 or 7 numbers)."""
    a = imu.select("drive_id", "stamp_ns", F.lit("imu").alias("kind"), F.array(*[F.col(c).cast("double") for c in ("wx", "wy", "wz", "ax", "ay", "az")]).alias("v"))
    b = poses.select("drive_id", "stamp_ns", F.lit("pose").alias("kind"), F.array(*[F.col(c).cast("double") for c in NAMES[:7]]).alias("v"))
    return a.unionByName(b)


def observe(imu: DataFrame, poses: DataFrame, params: Params | None = None) -> DataFrame:
    """The state after every IMU sample and scan pose of each drive: drive_id, stamp_ns, kind, px..qz, v, biases.

    Of one stamp the sample comes first. Each event needs the state before it, so a drive is one ordered fold, a batch
    of events at a time; drives run in parallel.
    """
    k = params or Params()
    e = events(imu, poses).select("drive_id", "stamp_ns", "kind", *[F.get("v", i).alias(f"v{i}") for i in range(7)])
    schema = f"drive_id {dict(imu.dtypes)['drive_id']}, stamp_ns long, kind string, " + ", ".join(f"{c} double" for c in NAMES)

    def start():
        f = Fold(k)

        def step(pdf: pd.DataFrame) -> pd.DataFrame:
            drive, rows = pdf["drive_id"].iloc[0], []
            for stamp, kind, *v in zip(pdf["stamp_ns"].tolist(), pdf["kind"].tolist(), *[pdf[f"v{i}"].tolist() for i in range(7)], strict=True):
                if (row := f.take(stamp, kind, v)) is not None:
                    rows.append((drive, stamp, kind, *row))
            return pd.DataFrame(rows, columns=["drive_id", "stamp_ns", "kind", *NAMES])

        return step

    return folded(e, "drive_id", ["stamp_ns", "kind", *[f"v{i}" for i in range(7)]], start, schema)


def propagate_state(imu: DataFrame, start: DataFrame, params: Params | None = None) -> DataFrame:
    """Strapdown only: from a start pose (drive_id, stamp_ns, px..qz) through all later samples."""
    return observe(imu, start, params).filter(F.col("kind") == "imu")
