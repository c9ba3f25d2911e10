"""Streams in event time: scans released by timers at their end, and the observer in the order of stamps.

State is kept in pieces: samples and events by time bucket, waiting scans by the time that they are due. A micro-batch
reads and writes the buckets that its rows fall into, never a drive's whole state, and timers of the watermark let go of
what is complete or too old. Rows that come later than the watermark allows are left out by the stream itself, which
counts them in its progress (numRowsDroppedByWatermark); watermarks start at 1970, so stamps up to then count as late.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.observer import NAMES, Fold, State, events
from ..params import Params

MS = 1_000_000
SYNCED = "scan_id long, status string, n_samples long"
SYNCED_COLUMNS = ["drive_id", "scan_id", "status", "n_samples"]


def frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    """Rows as plain objects, which Arrow casts to the schema; strings of pandas' own come in chunks, which it won't take."""
    return pd.DataFrame(rows, columns=columns, dtype=object)


def event_time(df: DataFrame, stamp: str, delay: str) -> DataFrame:
    """df with ts, the stamp as a timestamp, and a watermark of `delay` on it."""
    return df.withColumn("ts", F.timestamp_micros(F.floor(F.col(stamp) / 1000).cast("long"))).withWatermark("ts", delay)


def released(start: int, end: int, stamps: np.ndarray, history_ns: int, patience_ns: int) -> tuple[str, int]:
    """(status, samples) of a scan: from the last sample before its start, no older than history_ns, to the first at or
    after its end, no later than patience_ns."""
    stamps = np.unique(stamps)
    before = stamps[(stamps < start) & (stamps >= start - history_ns)]
    after = stamps[(stamps >= end) & (stamps <= end + patience_ns)]
    if not len(after):
        return "starved", 0
    if not len(before):
        return "no_imu", 0
    return "ok", int(((stamps >= before[-1]) & (stamps <= after[0])).sum())


class Sync(StatefulProcessor):
    """Samples by time bucket; scans by the millisecond that they are due."""

    def __init__(self, kind: str, history_ns: int, patience_ns: int, longest_ns: int, bucket_ns: int) -> None:
        self.kind, self.history, self.patience, self.longest, self.width = kind, history_ns, patience_ns, longest_ns, bucket_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.samples = handle.getMapState("samples", "bucket long", "stamps array<long>")
        self.due = handle.getMapState("due", "at long", "scans array<struct<scan_id:long,start:long,stop:long>>")

    def evicted(self, bucket: int) -> int:
        """When no scan can ask for a bucket's samples any more, in milliseconds."""
        return ((bucket + 1) * self.width + self.history + self.longest + self.patience) // MS + 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pdf = pd.concat(list(rows))
        stamps = pdf.loc[pdf["kind"] == "imu", "stamp_ns"].to_numpy(np.int64)
        for bucket in np.unique(stamps // self.width).tolist():
            new = stamps[stamps // self.width == bucket].tolist()
            if self.samples.containsKey((bucket,)):
                new += list(self.samples.getValue((bucket,))[0])
            else:
                self.handle.registerTimer(self.evicted(bucket))
            self.samples.updateValue((bucket,), (new,))
        scans = pdf[pdf["kind"] == "scan"]
        for scan_id, start, end in zip(scans["scan_id"].astype("int64").tolist(), scans["stamp_ns"].tolist(), scans["end_ns"].astype("int64").tolist(), strict=True):
            at = (end + self.patience) // MS + 1
            waiting = [tuple(s) for s in self.due.getValue((at,))[0]] if self.due.containsKey((at,)) else []
            self.due.updateValue((at,), ([*waiting, (scan_id, start, end)],))
            self.handle.registerTimer(at)
        yield frame([], SYNCED_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at, out = expiredTimerInfo.getExpiryTimeInMs(), []
        if self.due.containsKey((at,)):
            for scan_id, start, end in self.due.getValue((at,))[0]:
                found = [np.zeros(0, np.int64)]
                for bucket in range((start - self.history) // self.width, (end + self.patience) // self.width + 1):
                    if self.samples.containsKey((bucket,)):
                        found.append(np.array(self.samples.getValue((bucket,))[0], dtype=np.int64))
                out.append((key[0], scan_id, *released(start, end, np.concatenate(found), self.history, self.patience)))
            self.due.removeKey((at,))
        latest = ((at - 1) * MS - self.history - self.longest - self.patience) // self.width
        for bucket in (latest - 1, latest):  # of the timers that fall on this millisecond
            if self.evicted(bucket) == at and self.samples.containsKey((bucket,)):
                self.samples.removeKey((bucket,))
        yield frame(out, SYNCED_COLUMNS)

    def close(self) -> None:
        pass


def sync_scans(events_: DataFrame, delay: str = "2 seconds", history_ns: int = 25_000_000_000, patience_ns: int = 1_000_000_000, longest_ns: int = 1_000_000_000, bucket_ns: int = 1_000_000_000) -> DataFrame:
    """events_ (drive_id, kind 'imu' or 'scan', stamp_ns: of the sample, or of the scan's start; scan_id, end_ns) of a
    stream -> drive_id, scan_id, status, n_samples.

    A scan waits until the watermark passes its end and patience_ns; then it is 'ok' with the samples from the last one
    before its start (no older than history_ns) to the first at or after its end, 'no_imu' without the former, 'starved'
    without the latter. Whatever order rows come in within `delay`, the result is that of sync_scans_batch(). A scan's
    event time is its end; longest_ns: a scan's length at most, after which samples are let go. Rows with null stamps
    take no part.
    """
    e = events_.filter(F.col("stamp_ns").isNotNull() & ((F.col("kind") == "imu") | F.col("end_ns").isNotNull() & F.col("scan_id").isNotNull()))
    e = event_time(e.withColumn("__at", F.when(F.col("kind") == "scan", F.col("end_ns")).otherwise(F.col("stamp_ns"))), "__at", delay)
    kind = dict(events_.dtypes)["drive_id"]
    processor = Sync(kind, history_ns, patience_ns, longest_ns, bucket_ns)
    return e.select("drive_id", "kind", "stamp_ns", "scan_id", "end_ns", "ts").groupBy("drive_id").transformWithStateInPandas(processor, f"drive_id {kind}, {SYNCED}", "append", "EventTime")


def sync_scans_batch(events_: DataFrame, history_ns: int = 25_000_000_000, patience_ns: int = 1_000_000_000) -> DataFrame:
    """The rows of sync_scans() from a table: samples are numbered, and each scan looks up the place of its first and
    last by as-of joins in time buckets of history_ns, so that a drive is not one key."""
    from ..plans.ordered import asof, ordinal

    width = max(history_ns, patience_ns)
    s = events_.filter("kind = 'imu' and stamp_ns is not null").select("drive_id", "stamp_ns").distinct()
    s = ordinal(s, ["drive_id"], "stamp_ns", width)
    scans = events_.filter("kind = 'scan' and stamp_ns is not null and end_ns is not null and scan_id is not null").select("drive_id", "scan_id", F.col("stamp_ns").alias("start_ns"), "end_ns")
    out = asof(scans, s, ["drive_id"], "start_ns", "stamp_ns", width, strict=True, name="a")
    out = asof(out, s, ["drive_id"], "end_ns", "stamp_ns", width, forward=True, name="b")
    first = F.when(F.col("a.stamp_ns") >= F.col("start_ns") - history_ns, F.col("a.n"))
    last = F.when(F.col("b.stamp_ns") <= F.col("end_ns") + patience_ns, F.col("b.n"))
    status = F.when(last.isNull(), "starved").when(first.isNull(), "no_imu").otherwise("ok")
    return out.select("drive_id", "scan_id", status.alias("status"), F.when(status == "ok", last - first + 1).otherwise(0).cast("long").alias("n_samples"))


class Live(StatefulProcessor):
    """In processing time: the samples that have come lately, by a list whose entries expire."""

    def __init__(self, ttl_ms: int, patience_ms: int) -> None:
        self.ttl, self.patience = ttl_ms, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.samples = handle.getListState("samples", "stamp long", self.ttl)
        self.waiting = handle.getMapState("waiting", "scan_id long", "start long, stop long, due long")

    def settle(self, key, now: int | None) -> pd.DataFrame:
        """Scans whose samples are there; with now, those that are due as well."""
        scans, out = [(k[0], *v) for k, v in self.waiting.iterator()], []
        if scans:
            stamps = np.unique(np.array([s[0] for s in self.samples.get()], dtype=np.int64))
            for scan_id, start, end, due in sorted(scans):
                last = int(np.searchsorted(stamps, end))
                if last < len(stamps):
                    first = int(np.searchsorted(stamps, start)) - 1
                    out.append((key[0], scan_id, "ok" if first >= 0 else "no_imu", last - first + 1 if first >= 0 else 0))
                elif now is not None and due <= now:
                    out.append((key[0], scan_id, "starved", 0))
                else:
                    continue
                self.waiting.removeKey((scan_id,))
        return frame(out, SYNCED_COLUMNS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentProcessingTimeInMs()
        for pdf in rows:
            new = [(int(s),) for s in pdf.loc[pdf["kind"] == "imu", "stamp_ns"]]
            if new:
                self.samples.appendList(new)
            scans = pdf[pdf["kind"] == "scan"]
            for scan_id, start, end in zip(scans["scan_id"], scans["stamp_ns"], scans["end_ns"], strict=True):
                self.waiting.updateValue((int(scan_id),), (int(start), int(end), now + self.patience))
                self.handle.registerTimer(now + self.patience)
        yield self.settle(key, None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self.settle(key, expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


def sync_scans_live(events_: DataFrame, history_ms: int = 25_000, patience_ms: int = 1_000) -> DataFrame:
    """As sync_scans(), but by the clock: samples are kept for history_ms after they came, appended one by one to a list
    that drops them by itself, and a scan is let go as soon as a sample at or after its end is there, 'starved' after
    patience_ms. For sources that keep up; results depend on when rows come."""
    kind = dict(events_.dtypes)["drive_id"]
    e = events_.filter(F.col("stamp_ns").isNotNull()).select("drive_id", "kind", "stamp_ns", "scan_id", "end_ns")
    return e.groupBy("drive_id").transformWithStateInPandas(Live(history_ms, patience_ms), f"drive_id {kind}, {SYNCED}", "append", "ProcessingTime")


class Observing(StatefulProcessor):
    """Events by time bucket until the watermark has passed it; then they are folded in order."""

    def __init__(self, params: Params, bucket_ns: int) -> None:
        self.params, self.width = params, bucket_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "bucket long", "events array<struct<stamp:long,kind:string,v:array<double>>>")
        self.state = handle.getValueState("state", "numbers array<double>, imu long, pose long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pdf = pd.concat(list(rows))
        bucket = pdf["stamp_ns"].to_numpy(np.int64) // self.width
        for b in np.unique(bucket).tolist():
            some = pdf[bucket == b]
            new = [(int(s), k, [float(x) for x in v]) for s, k, v in zip(some["stamp_ns"], some["kind"], some["v"], strict=True)]
            if self.waiting.containsKey((b,)):
                new += [(e[0], e[1], list(e[2])) for e in self.waiting.getValue((b,))[0]]
            else:
                self.handle.registerTimer((b + 1) * self.width // MS)
            self.waiting.updateValue((b,), (new,))
        yield frame([], ["drive_id", "stamp_ns", "kind", *NAMES])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        b, out = expiredTimerInfo.getExpiryTimeInMs() * MS // self.width - 1, []
        if self.waiting.containsKey((b,)):
            now = self.state.get() if self.state.exists() else None
            fold = Fold(self.params, State.of(now[0]) if now and now[0] else None, now[1] if now else None, now[2] if now else None)
            for stamp, kind, v in sorted(((e[0], e[1], list(e[2])) for e in self.waiting.getValue((b,))[0]), key=lambda e: e[:2]):
                if (row := fold.take(stamp, kind, v)) is not None:
                    out.append((key[0], stamp, kind, *row))
            numbers = [float(x) for x in fold.state.row()] if fold.state is not None else []
            self.state.update((numbers, fold.last_imu, fold.last_pose))
            self.waiting.removeKey((b,))
        yield frame(out, ["drive_id", "stamp_ns", "kind", *NAMES])

    def close(self) -> None:
        pass


def streaming_observer(imu: DataFrame, poses: DataFrame, params: Params | None = None, delay: str = "1 second", bucket_ns: int = 100 * MS) -> DataFrame:
    """The rows of observe() from two streams, in event time: whatever order samples and poses come in within `delay`,
    each time bucket is folded once the watermark has passed it, so the result is the batch's. bucket_ns: whole
    milliseconds. Rows with a null stamp take no part."""
    if bucket_ns % MS:
        raise ValueError("bucket_ns is whole milliseconds")
    kind = dict(imu.dtypes)["drive_id"]
    e = event_time(events(imu, poses).filter(F.col("stamp_ns").isNotNull()), "stamp_ns", delay)
    schema = f"drive_id {kind}, stamp_ns long, kind string, " + ", ".join(f"{c} double" for c in NAMES)
    return e.groupBy("drive_id").transformWithStateInPandas(Observing(params or Params(), bucket_ns), schema, "append", "EventTime")


def newest_of(df: DataFrame, stamp: str = "stamp_ns") -> DataFrame:
    """Each drive's newest row of a table, for reading a sink of states."""
    w = Window.partitionBy("drive_id").orderBy(F.desc(stamp))
    return df.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")
