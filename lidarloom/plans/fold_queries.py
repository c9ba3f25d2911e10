"""Queries whose every row needs the state before it; their SQL walks along each drive."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import deskew, keyframes, observer, trajectory
from ..params import Params
from .ordered import ordinal
from .recorded import query, sql_units, units
from .registry import DAY_NS, HALF_TURN, attitudes, calibrations
from .scalar_queries import product

P = Params()


def paced(t) -> DataFrame:
    """IMU rows at 100 Hz in the order of their events: the table's own gaps are hours, which no integration bears."""
    i = ordinal(t("imu"), ["drive_id"], "stamp_ns", 10 * DAY_NS, ["event_id"], "n")
    return i.withColumn("stamp_ns", F.col("n") * 10_000_000).drop("n", "event_type")


PACED = "SELECT * REPLACE (n * 10000000 AS stamp_ns) FROM (SELECT *, row_number() OVER (PARTITION BY drive_id ORDER BY stamp_ns, event_id) - 1 AS n FROM imu)"


def names(letter: str, n: int) -> list[str]:
    return [f"{letter}{i}" for i in range(n)]


def turned(q: list[str], v: list[str]) -> list[str]:
    return product(product(q, ["0", *v]), [q[0], *[f"-({x})" for x in q[1:]]])[1:]


def as_unit(q: list[str]) -> list[str]:
    return [f"({x} / sqrt({' + '.join(f'{y} * {y}' for y in q)}))" for x in q]


def listed(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {c}" for c, e in columns.items())


# --- keyframes

HALF = "(pose_id % 360) * 0.5 * 3.141592653589793 / 180"


def turned_poses(t) -> DataFrame:
    """attitudes() by the C library's cosines: turns of the limit's very 45 degrees are told by their last bit, in which
    the JVM's differ."""
    p = attitudes(t).drop("qw", "qz").withColumn("half", F.expr(HALF_TURN))

    def run(batches):
        for pdf in batches:
            half = pdf["half"].tolist()
            yield pdf.drop(columns="half").assign(qw=[math.cos(x) for x in half], qz=[math.sin(x) for x in half])

    kinds = ", ".join(f"{c} {k}" for c, k in p.dtypes if c != "half")
    return p.mapInPandas(run, f"{kinds}, qw double, qz double")


@query(f"""WITH RECURSIVE o AS (SELECT drive_id, pose_id, stamp_ns, px, py, cos({HALF}) AS qw, sin({HALF}) AS qz, row_number() OVER (PARTITION BY drive_id ORDER BY stamp_ns, pose_id) AS k FROM poses),
    r AS (SELECT drive_id, pose_id, k, [{{'x': px, 'y': py, 'w': qw, 'z': qz}}] AS kept, true AS new FROM o WHERE k = 1
        UNION ALL SELECT drive_id, pose_id, k, CASE WHEN new THEN list_append(kept, {{'x': px, 'y': py, 'w': qw, 'z': qz}}) ELSE kept END, new FROM (
            SELECT *, d[best] > 1 OR (degrees(2 * acos(least(1, abs(qw * kept[best].w + qz * kept[best].z)))) > 45 AND len(list_filter(d, lambda x: x <= 1.5)) <= 1) AS new FROM (
                SELECT *, list_position(d, list_min(d)) AS best FROM (
                    SELECT o.drive_id, o.pose_id, o.k, o.px, o.py, o.qw, o.qz, r.kept, list_transform(r.kept, lambda x: sqrt((x.x - o.px) * (x.x - o.px) + (x.y - o.py) * (x.y - o.py))) AS d
                    FROM r JOIN o ON o.drive_id = r.drive_id AND o.k = r.k + 1))))
    SELECT drive_id, pose_id AS scan_id, len(kept) - 1 AS kf_id FROM r WHERE new""")
def select_keyframes(t):
    return keyframes.select_keyframes(turned_poses(t), 1.0, 45.0).select("drive_id", "scan_id", "kf_id")


@query("""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY drive_id ORDER BY stamp_ns, pose_id) AS k FROM poses),
    r AS (SELECT drive_id, pose_id, k, px AS ax, py AS ay, 0e0 AS length FROM o WHERE k = 1
        UNION ALL SELECT drive_id, pose_id, k, CASE WHEN d >= 2.5 THEN px ELSE ax END, CASE WHEN d >= 2.5 THEN py ELSE ay END, length + CASE WHEN d >= 2.5 THEN d ELSE 0 END
        FROM (SELECT o.*, r.ax, r.ay, r.length, sqrt((o.px - r.ax) ** 2 + (o.py - r.ay) ** 2) AS d FROM r JOIN o ON o.drive_id = r.drive_id AND o.k = r.k + 1))
    SELECT drive_id, pose_id, stamp_ns FROM r JOIN poses USING (drive_id, pose_id) WHERE length >= 2.5""")
def wait_until_move(t):
    p = t("poses").withColumn("scan_id", F.col("pose_id"))
    return trajectory.wait_until_move(p, trajectory.trajectory_length(p, 2.5), 2.5).select("drive_id", "pose_id", "stamp_ns")


# --- the observer: samples at 100 Hz, a measured pose at each tenth, after the sample of that time

STATE = [*names("p", 3), *names("q", 4), *names("v", 3), *names("ba", 3), *names("bg", 3)]
Q = names("q", 4)
WORLD = turned(Q, [f"(f{i} - ba{i})" for i in range(3)])
WORLD[2] = f"({WORLD[2]} - {P.gravity!r}::DOUBLE)"
RATE = [f"(w{i} - bg{i})" for i in range(3)]
SPUN = [f"({a} + dt / 2 * {b})" for a, b in zip(Q, product(Q, ["0", *RATE]), strict=True)]
#: A sample moves the state by the attitude before it, then turns it.
SAMPLE = {
    **{f"p{i}": f"p{i} + dt * v{i} + dt * dt / 2 * {WORLD[i]}" for i in range(3)},
    **{f"v{i}": f"v{i} + dt * {WORLD[i]}" for i in range(3)},
    **{f"q{i}": x for i, x in enumerate(as_unit(SPUN))},
    **{f"{b}{i}": f"{b}{i}" for b in ("ba", "bg") for i in range(3)},
}
#: A measured pose m, n pulls it: e is the attitude still to go, x the way still to go.
GONE = product(["q0", "-q1", "-q2", "-q3"], names("n", 4))
BODY = turned(["q0", "-q1", "-q2", "-q3"], names("x", 3))
PULL = product(Q, ["(1 - abs(e0))", *[f"(CASE WHEN e0 < 0 THEN -1 ELSE 1 END * e{i})" for i in (1, 2, 3)]])


def bounded(e: str, most: float) -> str:
    return f"least(greatest({e}, -{most!r}::DOUBLE), {most!r}::DOUBLE)"


POSE = {
    **{f"p{i}": f"p{i} + 0.1e0 * {P.k_p!r} * x{i}" for i in range(3)},
    **{f"v{i}": f"v{i} + 0.1e0 * {P.k_v!r} * x{i}" for i in range(3)},
    **{f"q{i}": x for i, x in enumerate(as_unit([f"({a} + 0.1e0 * {P.k_q!r} * {b})" for a, b in zip(Q, PULL, strict=True)]))},
    **{f"ba{i}": bounded(f"ba{i} - 0.1e0 * {P.k_ab!r} * {BODY[i]}", P.abias_max) for i in range(3)},
    **{f"bg{i}": bounded(f"bg{i} - 0.1e0 * {P.k_gb!r} * e0 * e{i + 1}", P.gbias_max) for i in range(3)},
}
MEASURED = {"m0": "{0}n / 40e0", "m1": "({0}n % 30) / 30e0", "m2": "0e0"}
ATTITUDE = {"n0": "cos({0}n / 60e0)", "n1": "0e0", "n2": "0e0", "n3": "sin({0}n / 60e0)"}
OBSERVED = ", ".join(sql_units(c, c, 1e5) for c in STATE)


@query(f"""WITH RECURSIVE i AS (SELECT drive_id, n, wx AS w0, wy AS w1, wz AS w2, ax AS f0, ay AS f1, az AS f2, 0.01e0 AS dt FROM ({PACED})),
    r AS (SELECT drive_id, n, false AS measured, {listed({**{c: '0e0' for c in STATE}, 'p0': '0e0', 'q0': '1e0'})} FROM i WHERE n = 0
        UNION ALL SELECT drive_id, CASE WHEN measured THEN n ELSE n + 1 END AS n, measured, {", ".join(f"CASE WHEN measured THEN ({POSE[c]}) ELSE ({SAMPLE[c]}) END" for c in STATE)} FROM (
            SELECT *, {listed({f"e{k}": x for k, x in enumerate(GONE)})}, {listed({f"x{k}": f"m{k} - p{k}" for k in range(3)})} FROM (
                SELECT r.* EXCLUDE (measured), {listed(MEASURED | ATTITUDE).replace("{0}", "r.")}, NOT r.measured AND r.n % 10 = 0 AND r.n > 0 AS measured, w0, w1, w2, f0, f1, f2, dt
                FROM r LEFT JOIN i ON i.drive_id = r.drive_id AND i.n = r.n + 1 WHERE i.n IS NOT NULL OR (NOT r.measured AND r.n % 10 = 0 AND r.n > 0))))
    SELECT drive_id, n * 10000000 AS stamp_ns, CASE WHEN measured OR n = 0 THEN 'pose' ELSE 'imu' END AS kind, {OBSERVED} FROM r""")
def observe(t):
    i = paced(t).withColumn("n", (F.col("stamp_ns") / 10_000_000).cast("long"))
    tenth = i.filter("n % 10 = 0")
    pose = dict(zip(observer.NAMES[:7], [*MEASURED.values(), *ATTITUDE.values()], strict=True))
    poses = tenth.select("drive_id", "stamp_ns", *[F.expr(e.replace("{0}", "")).cast("double").alias(c) for c, e in pose.items()])
    out = observer.observe(i, poses)
    return out.select("drive_id", "stamp_ns", "kind", *[units(c, s, 1e5) for c, s in zip(observer.NAMES, STATE, strict=True)])


# --- integration between poses: a scan for each tenth sample, 5 ms after it, over the 80 ms that follow, from rest

START_NS = 5_000_000
WAX = ("wx", "wy", "wz", "ax", "ay", "az")


def scan_starts(t) -> DataFrame:
    at_rest = {"px": 0.0, "py": 0.0, "pz": 0.0, "qw": 1.0, "qx": 0.0, "qy": 0.0, "qz": 0.0, "vx": 0.0, "vy": 0.0, "vz": 0.0}
    s = paced(t).filter(F.col("stamp_ns") % 100_000_000 == 0).select("drive_id", F.col("event_id").cast("long").alias("scan_id"), (F.col("stamp_ns") + START_NS).alias("start_ns"))
    return s.withColumns({k: F.lit(v) for k, v in at_rest.items()})


def spun(q: list[str], w: list[str], h: str) -> list[str]:
    return as_unit([f"({a} + {h} / 2 * {b})" for a, b in zip(q, product(q, ["0", *w]), strict=True)])


def world(q: list[str], f: list[str]) -> list[str]:
    out = turned(q, f)
    return [out[0], out[1], f"({out[2]} - {P.gravity!r}::DOUBLE)"]


U, F0, F1, W0, W1, ALPHA = names("u", 4), names("f", 3), names("g", 3), names("w", 3), names("y", 3), [f"((y{i} - w{i}) / 0.01e0)" for i in range(3)]
MID = [f"((w{i} + y{i}) / 2)" for i in range(3)]
#: The state goes back 5 ms to the first sample: attitude u, then accelerations a and their change j, then v and p.
BACK = [f"(-(w{i} + 0.0025e0 * {ALPHA[i]}))" for i in range(3)]
PAIR = f"""SELECT s.drive_id, s.n AS n0, s.event_id AS scan_id, {", ".join(f"a.{c} AS {n}" for c, n in zip(WAX, [*W0, *F0], strict=True))}, {", ".join(f"b.{c} AS {n}" for c, n in zip(WAX, [*W1, *F1], strict=True))}
    FROM i s JOIN i a ON a.drive_id = s.drive_id AND a.n = s.n JOIN i b ON b.drive_id = s.drive_id AND b.n = s.n + 1 WHERE s.n % 10 = 0"""
FIRST = f"""SELECT *, {", ".join(f"-(a{i} * 0.005e0 + j{i} * 0.0000125e0) AS v{i}" for i in range(3))}, {", ".join(f"-(-(a{i} * 0.005e0 + j{i} * 0.0000125e0) * 0.005e0 + a{i} * 0.0000125e0 + j{i} * 0.005e0 ** 3 / 6) AS p{i}" for i in range(3))} FROM (
    SELECT *, {", ".join(f"(b{i} - a{i}) / 0.01e0 AS j{i}" for i in range(3))} FROM (SELECT *, {listed({f"a{i}": x for i, x in enumerate(world(U, F0))})}, {listed({f"b{i}": x for i, x in enumerate(world(names("t", 4), F1))})} FROM (
        SELECT *, {listed({f"t{i}": x for i, x in enumerate(spun(U, MID, "0.01e0"))})} FROM (SELECT *, {listed({f"u{i}": x for i, x in enumerate(spun(["1e0", "0e0", "0e0", "0e0"], BACK, "0.005e0"))})} FROM ({PAIR})))))"""
KEEP = ["drive_id", "scan_id", "n0", *U, *names("a", 3), *names("v", 3), *names("p", 3)]
#: One sample on: attitude t, acceleration b there, its change j between.
AHEAD = f"""SELECT *, {", ".join(f"(b{i} - a{i}) / 0.01e0 AS j{i}" for i in range(3))} FROM (SELECT *, {listed({f"b{i}": x for i, x in enumerate(world(names("t", 4), F1))})} FROM (SELECT *, {listed({f"t{i}": x for i, x in enumerate(spun(U, MID, "0.01e0"))})} FROM (
    SELECT r.*, {", ".join(f"a.{c} AS {n}" for c, n in zip(WAX, [*W0, *F0], strict=True))}, {", ".join(f"b.{c} AS {n}" for c, n in zip(WAX, [*W1, *F1], strict=True))} FROM r JOIN i a ON a.drive_id = r.drive_id AND a.n = r.n0 + r.k JOIN i b ON b.drive_id = r.drive_id AND b.n = r.n0 + r.k + 1)))"""
MOVE = {**{f"u{i}": f"t{i}" for i in range(4)}, **{f"a{i}": f"b{i}" for i in range(3)}, **{f"v{i}": f"v{i} + a{i} * 0.01e0 + j{i} * 0.00005e0" for i in range(3)}, **{f"p{i}": f"p{i} + v{i} * 0.01e0 + a{i} * 0.00005e0 + j{i} * 0.01e0 ** 3 / 6" for i in range(3)}}
STEPS = f"""WITH RECURSIVE i AS ({PACED}), r AS (SELECT {", ".join(KEEP)}, 0 AS k FROM ({FIRST}) UNION ALL SELECT drive_id, scan_id, n0, {", ".join(MOVE[c] for c in KEEP[3:])}, k + 1 FROM ({AHEAD}) WHERE k < 7), s AS ({AHEAD})"""
#: A time h after a sample, within the step that starts there.
REACHED = {**{f"p{c}": f"p{i} + v{i} * h + a{i} * h * h / 2 + j{i} * h ** 3 / 6" for i, c in enumerate("xyz")}, **{f"q{c}": x for c, x in zip("wxyz", spun(U, [f"(w{i} + h / 2 * {ALPHA[i]})" for i in range(3)], "h"), strict=True)}}


@query(f"""{STEPS}, q AS (SELECT *, unnest(range(0, 4)) * 20 + 5 AS ms FROM s), x AS (SELECT *, (ms - 10 * k) / 1000e0 AS h FROM q WHERE ms > 10 * k AND ms <= 10 * k + 10)
    SELECT drive_id, scan_id, (n0 * 10 + ms) * 1000000 AS stamp_ns, {", ".join(sql_units(e, c, 1e8) for c, e in REACHED.items())} FROM x""")
def integrate_imu(t):
    s = scan_starts(t)
    asked = s.select("drive_id", "scan_id", F.explode(F.array(*[F.col("start_ns") + k * 20_000_000 for k in range(4)])).alias("stamp_ns"))
    out = deskew.integrate_imu(s, asked, paced(t))
    return out.select("drive_id", "scan_id", "stamp_ns", *[units(c, c, 1e8) for c in REACHED])


@query(f"""{STEPS}, x AS (SELECT *, 0.01e0 AS h FROM s WHERE k = 4)
    SELECT drive_id, scan_id, n0 * 10000000 + 50000000 AS stamp_ns, {", ".join(sql_units(e, c, 1e8) for c, e in REACHED.items())} FROM x""")
def scan_prior(t):
    """A pose a scan, at its header's time: 50 ms after the sample before it."""
    s = scan_starts(t)
    scans = s.select("drive_id", "scan_id", (F.col("start_ns") + 45_000_000).alias("scan_stamp_ns"))
    return deskew.scan_prior(s, scans, paced(t)).select("drive_id", "scan_id", "stamp_ns", *[units(c, c, 1e8) for c in REACHED])


MODS = dict(zip("xyz", (17, 13, 5), strict=True))
#: Through the mounting, a quarter turn and half a metre, then the pose at the point's time.
SEEN = turned(["qw", "qx", "qy", "qz"], ["(0.5e0 - (scan_id + m) % 13)", "((scan_id + m) % 17)", "((scan_id + m) % 5)"])


@query(f"""{STEPS}, q AS (SELECT *, unnest(range(0, 8)) AS m FROM s), y AS (SELECT *, (5 + 10 * m - 10 * k) / 1000e0 AS h, (scan_id + 0) AS id FROM q WHERE m = k),
    z AS (SELECT drive_id, scan_id, m, {", ".join(f"{e} AS {c}" for c, e in REACHED.items())} FROM y), f AS (SELECT *, count(*) OVER (PARTITION BY drive_id, scan_id) = 8 AS deskewed FROM z),
    all_ AS (SELECT i.drive_id, event_id AS scan_id, unnest(range(0, 8)) AS m, n FROM i WHERE n % 10 = 0),
    w AS (SELECT a.drive_id, a.scan_id, a.m, coalesce(f.deskewed, false) AS deskewed, {", ".join(f"CASE WHEN f.deskewed THEN f.{c} ELSE {int(c == 'qw')} END AS {c}" for c in REACHED)} FROM all_ a LEFT JOIN f ON f.drive_id = a.drive_id AND f.scan_id = a.scan_id AND f.m = a.m)
    SELECT drive_id, scan_id, m AS point_id, deskewed, {", ".join(sql_units(f"{SEEN[i]} + p{c}", c, 1e6) for i, c in enumerate("xyz"))} FROM w""")
def deskew_points(t):
    s = scan_starts(t)
    p = s.select("drive_id", "scan_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"), "start_ns")
    p = p.select("drive_id", "scan_id", F.col("k").cast("long").alias("point_id"), F.col("start_ns").alias("scan_stamp_ns"), (F.col("start_ns") + F.col("k") * 10_000_000).alias("stamp_ns"), *[((F.col("scan_id") + F.col("k")) % m * 1.0).alias(c) for c, m in MODS.items()], F.lit(1.0).alias("intensity"))
    i = paced(t)
    return deskew.deskew(p, i, s, calibrations(i)).select("drive_id", "scan_id", "point_id", "deskewed", *[units(c, c) for c in "xyz"])
