"""Event-time streams give what the batch gives on rows that come out of order, and go on after a restart."""

import random
import time

import numpy as np

from lidarloom.operators import observer
from lidarloom.streaming import event_time

from .test_motion import IMU, circle, imu_rows

EVENTS = "k long, drive_id string, kind string, stamp_ns long, scan_id long, end_ns long"
S = 1_000_000_000


def start(spark, df, path, name, tmp_path, **trigger):
    q = df.writeStream.format("parquet").option("path", str(path)).option("checkpointLocation", str(tmp_path / f"c-{name}")).outputMode("append")
    return q.trigger(**(trigger or {"availableNow": True})).start()


def made(drives=3, seconds=20, seed=0):
    """Samples at 10 Hz with a gap, and scans of 0.1 s, some before all samples, in the gap, or after them; shuffled by up
    to a second."""
    r, rows = random.Random(seed), []
    for d in range(drives):
        stamps = [k * S // 10 for k in range(20, 10 * seconds) if not 80 <= k < 110]
        rows += [(s, f"d{d}", "imu", s, None, None) for s in stamps]
        for k in range(1, 10 * seconds + 20, 7):
            a = k * S // 10 + 37
            rows.append((a + S // 10, f"d{d}", "scan", a, 1000 * d + k, a + S // 10))
    rows.append((10**6 * S, "end", "imu", 10**6 * S, None, None))  # moves the watermark past all that is there
    rows.sort(key=lambda x: x[0] + (r.random() * S if x[1] != "end" else 0))
    return [(k, *x[1:]) for k, x in enumerate(rows)]


def parts(spark, rows, schema, path, n=6):
    step = -(-len(rows) // n)
    for k in range(n):
        spark.createDataFrame(rows[k * step : (k + 1) * step], schema).coalesce(1).write.mode("append").parquet(str(path))
        time.sleep(0.02)


def test_scans_are_released_in_event_time(spark, tmp_path):
    rows = made()
    batch = event_time.sync_scans_batch(spark.createDataFrame(rows, EVENTS), 3 * S, S // 2)
    want = sorted(map(tuple, batch.collect()))
    assert {r[2] for r in want} == {"ok", "no_imu", "starved"}
    plain = []
    for _, d, kind, a, scan, b in rows:
        if kind == "scan":
            stamps = np.array([s for _, e, k, s, _, _ in rows if e == d and k == "imu"])
            plain.append((d, scan, *event_time.released(a, b, stamps, 3 * S, S // 2)))
    assert want == sorted(plain)
    path, out = tmp_path / "e", tmp_path / "o"

    def stream():
        read = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(path))
        return event_time.sync_scans(read, "2 seconds", 3 * S, S // 2, S // 2)

    half = len(rows) // 2
    parts(spark, rows[:half], EVENTS, path, 3)
    start(spark, stream(), out, "sync", tmp_path).awaitTermination(240)
    parts(spark, rows[half:], EVENTS, path, 3)  # a new query goes on from the checkpoint
    q = start(spark, stream(), out, "sync", tmp_path)
    q.awaitTermination(240)
    assert q.exception() is None
    assert sorted(map(tuple, spark.read.parquet(str(out)).collect())) == want
    dropped = sum(o.numRowsDroppedByWatermark for p in q.recentProgress for o in p.stateOperators)
    left = [o.numRowsTotal for p in q.recentProgress for o in p.stateOperators][-1]
    assert dropped == 0 and left < 20  # samples that no scan can ask for are gone


def test_observer_in_event_time(spark, tmp_path):
    r = random.Random(4)
    samples = [(x[0], x[1] + S, *x[2:]) for x in imu_rows(0, 3, 50)]  # a watermark starts at 0
    i = spark.createDataFrame(samples, IMU)
    p = spark.createDataFrame([("d", S + k * 10**8, *circle(k / 10)[0].tolist(), *circle(k / 10)[1].tolist()) for k in range(30)], "drive_id string, stamp_ns long, px double, py double, pz double, qw double, qx double, qy double, qz double")
    want = {(x.stamp_ns, x.kind): x for x in observer.observe(i, p).collect()}
    end = [("end", 10**6 * S, *[0.0] * 6)]
    shuffled = sorted(samples, key=lambda x: x[1] + r.random() * S // 2) + end
    parts(spark, shuffled, IMU, tmp_path / "i", 5)
    parts(spark, sorted(p.collect(), key=lambda x: x.stamp_ns + r.random() * S // 2), p.schema, tmp_path / "p", 5)
    read = lambda name, s: spark.readStream.schema(s).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    stream = event_time.streaming_observer(read("i", IMU), read("p", p.schema), delay="4 seconds")
    q = start(spark, stream, tmp_path / "o", "observer", tmp_path)
    q.awaitTermination(240)
    assert q.exception() is None
    got = {(x.stamp_ns, x.kind): x for x in spark.read.parquet(str(tmp_path / "o")).filter("drive_id = 'd'").collect()}
    assert set(got) == set(want)
    assert all(abs(got[k][c] - want[k][c]) < 1e-12 for k in want for c in observer.NAMES)


def test_samples_expire_by_the_clock(spark, tmp_path):
    rows = [(0, "d", "imu", 10, None, None), (1, "d", "imu", 40, None, None), (2, "d", "scan", 20, 7, 30)]
    later = [(3, "d", "scan", 50, 8, 60), (4, "d", "imu", 70, None, None), (5, "d", "scan", 80, 9, 90)]
    path, out = tmp_path / "e", tmp_path / "o"
    parts(spark, rows, EVENTS, path, 1)
    stream = event_time.sync_scans_live(spark.readStream.schema(EVENTS).parquet(str(path)), 1500, 1000)
    q = start(spark, stream, out, "live", tmp_path, processingTime="200 milliseconds")
    def wait(n):  # a query with timers goes on making micro-batches, so it is never done
        until = time.time() + 25
        while time.time() < until and len(done()) < n:
            time.sleep(0.3)

    def done():
        return sorted(map(tuple, spark.read.schema(f"drive_id string, {event_time.SYNCED}").parquet(str(out)).collect())) if (out / "_spark_metadata").exists() else []

    try:
        wait(1)
        time.sleep(2)
        parts(spark, later, EVENTS, path, 1)
        wait(3)
    finally:
        q.stop()
    assert done() == [("d", 7, "ok", 2), ("d", 8, "no_imu", 0), ("d", 9, "starved", 0)]
