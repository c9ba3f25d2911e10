"""Streams: waiting for IMU data, calibration, observer, keyframes and map, averages."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.keyframes import PLACE, TURN, Kept
from ..operators.mapping import map_voxels, merge_voxels
from ..operators.observer import NAMES, Fold, State, events
from ..params import Params

#: A drive's state is one value of bytes: JSON, or plain arrays where it can grow.
STATE = "state binary"


def by_drive(df: DataFrame, step: Callable[..., pd.DataFrame], schema: str, idle_ms: int | None = None) -> DataFrame:
    """step(drive, rows of the micro-batch, kept dict) -> rows; kept is the drive's state, a small JSON value. With
    idle_ms a drive that has sent nothing for so long is called with no rows, so that what waits can be let go; such a
    query goes on making micro-batches until it is stopped, so an availableNow trigger doesn't end it."""
    kinds = dict(df.dtypes)
    empty = {c: [] for c in kinds}

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState):
        kept = json.loads(bytes(state.get[0])) if state.exists else {}
        idle = state.hasTimedOut
        out = step(key[0], pd.DataFrame(empty) if idle else pd.concat(list(batches)), kept)
        if idle and not kept:
            state.remove()
        else:
            state.update((json.dumps(kept).encode(),))
            if idle_ms is not None and not idle:
                state.setTimeoutDuration(idle_ms)
        yield out

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return df.groupBy("drive_id").applyInPandasWithState(run, schema, STATE, "append", timeout)


def sync_scans(events_: DataFrame, buffer: int = 5000, patience_ns: int = 10_000_000_000, idle_ms: int | None = None) -> DataFrame:
    """Scans as soon as IMU data reach their end.

    events_: drive_id, kind ('imu' or 'scan'), stamp_ns (of the sample, or of the scan's start), scan_id, end_ns. Gives
    drive_id, scan_id, status and n_samples: 'ok'; 'no_imu' where no kept sample precedes the scan; 'starved' where
    samples have not come although the drive's other data are patience_ns past the scan's end, or the drive has been
    silent for idle_ms. A drive keeps its newest `buffer` stamps, those within patience_ns of its newest data, and the
    scans that wait; points are joined to the result later, by scan.
    """

    def step(drive, pdf, kept):
        silent = not len(pdf)
        scans = pdf[pdf["kind"] == "scan"]
        stamps = sorted(set(kept.get("imu", []) + pdf.loc[pdf["kind"] == "imu", "stamp_ns"].astype("int64").tolist()))
        waiting = kept.get("scans", []) + [[int(a), int(b), int(c)] for a, b, c in zip(scans["scan_id"], scans["stamp_ns"], scans["end_ns"], strict=True)]
        newest = stamps[-1] if stamps else None
        now = max([kept.get("now", -(2**63)), *pdf["stamp_ns"].astype("int64").tolist()])
        rows, still = [], []
        at = np.array(stamps, dtype=np.int64)
        for scan_id, start, end in sorted(waiting, key=lambda s: s[1]):
            if newest is None or newest < end:
                if silent or now - end > patience_ns:
                    rows.append((drive, scan_id, "starved", 0))
                else:
                    still.append([scan_id, start, end])
                continue
            first, last = int(np.searchsorted(at, start)) - 1, int(np.searchsorted(at, end))
            rows.append((drive, scan_id, "ok" if first >= 0 else "no_imu", last - first + 1 if first >= 0 else 0))
        oldest = min([x[1] for x in still], default=now) - patience_ns
        kept.clear()
        if not silent or still:
            kept.update(imu=[x for x in stamps if x >= oldest][-buffer:], scans=still, now=now)
        return pd.DataFrame(rows, columns=["drive_id", "scan_id", "status", "n_samples"])

    kind = dict(events_.dtypes)["drive_id"]
    return by_drive(events_, step, f"drive_id {kind}, scan_id long, status string, n_samples long", idle_ms)


CALIBRATED = ("n", *[f"mean_{c}" for c in ("wx", "wy", "wz", "ax", "ay", "az")], "gravity_x", "gravity_y", "gravity_z", "qw", "qx", "qy", "qz", "accel_bias", "gyro_bias")


def calibrated(samples: np.ndarray, p: Params) -> tuple:
    """What calibrate_imu() gives for a drive, from rows of wx..az: means, gravity, the attitude that turns it upright,
    and biases."""
    mean = np.rint(samples * 1e6).sum(0) / len(samples) / 1e6
    up = np.array([0.0, 0.0, p.gravity])
    g = mean[3:] / np.linalg.norm(mean[3:]) * abs(p.gravity) if p.gravity_align else up
    u, v = g / np.linalg.norm(g), up / np.linalg.norm(up)
    c = float(u @ v)
    if not p.gravity_align:
        q = np.array([1.0, 0, 0, 0])
    elif c < -1 + 1e-12:
        side = np.cross(u, [1.0, 0, 0] if abs(u[0]) < 0.9 else [0, 1.0, 0])
        q = np.array([0, *side / np.linalg.norm(side)])
    else:
        q = np.array([1 + c, *np.cross(u, v)])
        q /= np.linalg.norm(q)
    zero = np.zeros(3)
    accel, gyro = (mean[3:] - g if p.calibrate_accel else zero), (mean[:3] if p.calibrate_gyro else zero)
    return (len(samples), *mean, *g, *q, accel.tolist(), gyro.tolist())


def streaming_calibration(imu: DataFrame, params: Params | None = None) -> DataFrame:
    """One row a drive, when its first sample imu_calib_time_s or more after the first arrives: CALIBRATED, as
    calibrate_imu() gives it for the samples before. Late samples of the window count while it is open. The state holds
    the window's samples and, once it is closed, nothing but that."""
    p = params or Params()
    names = ["wx", "wy", "wz", "ax", "ay", "az"]
    columns = ["drive_id", *CALIBRATED]

    def step(drive, pdf, kept):
        if kept.get("done"):
            return pd.DataFrame(columns=columns)
        rows = kept.get("rows", []) + [[int(s), *map(float, v)] for s, v in zip(pdf["stamp_ns"], pdf[names].to_numpy(), strict=True)]
        first = min(r[0] for r in rows)
        inside = [r for r in rows if (r[0] - first) / 1e9 < p.imu_calib_time_s]
        if len(inside) == len(rows):
            kept["rows"] = rows
            return pd.DataFrame(columns=columns)
        kept.clear()
        kept["done"] = True
        return pd.DataFrame([(drive, *calibrated(np.array([r[1:] for r in sorted(inside)]), p))], columns=columns)

    kind = dict(imu.dtypes)["drive_id"]
    kinds = {"n": "long", "accel_bias": "array<double>", "gyro_bias": "array<double>"}
    return by_drive(imu, step, f"drive_id {kind}, " + ", ".join(f"{c} {kinds.get(c, 'double')}" for c in CALIBRATED))


def streaming_observer(imu: DataFrame, poses: DataFrame, params: Params | None = None, delay_ns: int = 1_000_000_000, idle_ms: int | None = None) -> DataFrame:
    """The observer over two streams: rows of observe() plus status. Events wait until delay_ns of later data are there,
    or the drive has been silent for idle_ms, and are then folded in order ('ok'). What comes later still gets a row
    without a state, 'late', so nothing is left out unseen."""
    k = params or Params()
    none = (None,) * len(NAMES)

    def step(drive, pdf, kept):
        done = kept.get("done")
        new = [[int(s), t, list(map(float, v))] for s, t, v in zip(pdf["stamp_ns"], pdf["kind"], pdf["v"], strict=True)]
        rows = [(drive, s, t, *none, "late") for s, t, _ in new if done is not None and s <= done]
        waiting = sorted([e for e in kept.get("waiting", []) + new if done is None or e[0] > done], key=lambda e: (e[0], e[1]))
        horizon = (waiting[-1][0] - (delay_ns if len(pdf) else 0)) if waiting else 0
        state = State.of(kept["state"]) if "state" in kept else None
        fold = Fold(k, state, kept.get("imu"), kept.get("pose"))
        for stamp, t, v in waiting:
            if stamp > horizon:
                break
            if (row := fold.take(stamp, t, v)) is not None:
                rows.append((drive, stamp, t, *row, "ok"))
            kept["done"] = stamp
        kept["waiting"] = [e for e in waiting if e[0] > horizon]
        kept["imu"], kept["pose"] = fold.last_imu, fold.last_pose
        if fold.state is not None:
            kept["state"] = list(map(float, fold.state.row()))
        return pd.DataFrame(rows, columns=["drive_id", "stamp_ns", "kind", *NAMES, "status"])

    kind = dict(imu.dtypes)["drive_id"]
    return by_drive(events(imu, poses), step, f"drive_id {kind}, stamp_ns long, kind string, " + ", ".join(f"{c} double" for c in NAMES) + ", status string", idle_ms)


class Choosing(StatefulProcessor):
    """Keyframes by cell: a micro-batch reads the cells around its poses and writes those that get one."""

    def __init__(self, dist: float, rot_deg: float) -> None:
        self.dist, self.rot_deg = dist, rot_deg

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cells = handle.getMapState("cells", "i long, j long, k long", "poses array<double>")
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        def load(cell):
            flat = list(self.cells.getValue(cell)[0]) if self.cells.containsKey(cell) else []
            return [flat[i : i + 7] for i in range(0, len(flat), 7)]

        first = self.count.get()[0] if self.count.exists() else 0
        own, out = Kept(first, load), []
        pdf = pd.concat(list(rows)).sort_values(["stamp_ns", "scan_id"])
        for scan, stamp, *x in zip(pdf["scan_id"].tolist(), pdf["stamp_ns"].tolist(), *[pdf[c].tolist() for c in (*PLACE, *TURN)], strict=True):
            if own.take(x[:3], x[3:], x[:3], x[3:], self.dist, self.rot_deg):
                out.append((key[0], len(own) - 1, scan, stamp, *x))
        for cell in own.changed:
            self.cells.updateValue(cell, ([v for x in own.cells[cell] for v in x],))
        self.count.update((len(own),))
        yield pd.DataFrame(out, columns=["drive_id", "kf_id", "scan_id", "stamp_ns", *PLACE, *TURN], dtype=object)

    def close(self) -> None:
        pass


def streaming_keyframes(states: DataFrame, dist: float = 1.0, rot_deg: float = 45.0) -> DataFrame:
    """New keyframes of a stream of poses, in the order of stamps within each micro-batch. The state is a drive's
    keyframes by cell, of which a pose meets those around it; it is never read or written as a whole."""
    kind = dict(states.dtypes)["drive_id"]
    schema = f"drive_id {kind}, kf_id long, scan_id long, stamp_ns long, " + ", ".join(f"{c} double" for c in (*PLACE, *TURN))
    slim = states.select("drive_id", "scan_id", "stamp_ns", *PLACE, *TURN)
    return slim.groupBy("drive_id").transformWithStateInPandas(Choosing(dist, rot_deg), schema, "append", "None")


def streaming_ema(metrics: DataFrame, value: str, alpha: float = 0.05) -> DataFrame:
    """drive_id, scan_id, ema of a stream of per-scan values, in order of scan_id within each micro-batch."""

    def step(drive, pdf, kept):
        y, rows = kept.get("y"), []
        for scan, x in sorted(zip(pdf["scan_id"], pdf[value], strict=True)):
            y = float(x) if y is None else (1 - alpha) * y + alpha * float(x)
            rows.append((drive, scan, y))
        kept["y"] = y
        return pd.DataFrame(rows, columns=["drive_id", "scan_id", "ema"])

    kind = dict(metrics.dtypes)["drive_id"]
    return by_drive(metrics, step, f"drive_id {kind}, scan_id long, ema double")


def latest_only(batch: DataFrame, stamp: str = "scan_stamp_ns") -> DataFrame:
    """Of a micro-batch of scans each drive's newest; for use inside foreachBatch."""
    w = Window.partitionBy("drive_id").orderBy(F.desc(stamp), F.desc("scan_id"))
    return batch.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")


def stream_map(keyframe_points: DataFrame, path: str, checkpoint: str, leaf: float = 0.25, every: str | None = None, compact_after: int = 100):
    """Keeps the map of a stream of keyframe points as voxel sums below path. A micro-batch writes its own sums only, as
    a version of their own, so its work follows its rows and not the map, and running it again gives the same.
    read_map() adds versions up; after every compact_after versions (0: never) they are put together, and what the base
    before that one covered is deleted."""

    def write(batch: DataFrame, n: int) -> None:
        map_voxels(batch, leaf).write.mode("overwrite").parquet(f"{path}/version={n}")
        if compact_after and (n + 1) % compact_after == 0:
            vacuum_map(batch.sparkSession, path)
            compact_map(batch.sparkSession, path)

    w = keyframe_points.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def _complete(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders below path that were written to their end: the map's manifest."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return [x.getPath().getParent().getName() for x in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(path, "*/_SUCCESS"))]


def _versions(spark: SparkSession, path: str) -> tuple[int | None, list[int]]:
    """The newest base, and the versions after it."""
    names = _complete(spark, path)
    base = max([int(x.removeprefix("base=")) for x in names if x.startswith("base=")], default=None)
    return base, sorted(n for n in (int(x.removeprefix("version=")) for x in names if x.startswith("version=")) if base is None or n > base)


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """The map that stream_map() has written so far: one scan over the newest base and all later versions, added up."""
    base, versions = _versions(spark, path)
    parts = [*([f"{path}/base={base}"] if base is not None else []), *[f"{path}/version={n}" for n in versions]]
    return merge_voxels(spark.read.parquet(*parts))


def compact_map(spark: SparkSession, path: str) -> None:
    """Puts all versions so far together as a new base; readers use it once it is complete. What it covers stays until
    vacuum_map(), since running readers may still read it."""
    _, versions = _versions(spark, path)
    if versions:
        read_map(spark, path).write.mode("overwrite").parquet(f"{path}/base={versions[-1]}")


def vacuum_map(spark: SparkSession, path: str) -> int:
    """Deletes what the newest base covers, the base itself and what came later aside; gives how many folders that was."""
    base, _ = _versions(spark, path)
    old = [x for x in _complete(spark, path) if base is not None and (x.startswith("base=") and int(x[5:]) < base or x.startswith("version=") and int(x[8:]) <= base)]
    for name in old:
        p = spark._jvm.org.apache.hadoop.fs.Path(path, name)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return len(old)
