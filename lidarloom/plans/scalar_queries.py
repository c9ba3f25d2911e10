"""Queries of the scalar functions, of operators on single rows, and of what is written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import imu, mapping, points, spatial, trajectory
from ..session import shared_dir
from .recorded import query, sql_units, units
from .registry import HOUR_NS, POINT_COVS, ROTATION, TURN

#: Two unit quaternions a and b, a vector v and a rate w for each pose, by the same text on both sides.
RAW = """SELECT drive_id, pose_id, (pose_id % 5 + 1) / 4e0 AS a0, (pose_id % 7 - 3) / 4e0 AS a1, (pose_id % 11 - 5) / 4e0 AS a2, (pose_id % 13 - 6) / 4e0 AS a3,
    (pose_id % 3 + 1) / 4e0 AS b0, (pose_id % 13 - 6) / 4e0 AS b1, (pose_id % 5 - 2) / 4e0 AS b2, (pose_id % 7 - 3) / 4e0 AS b3,
    px - 4.81e0 AS v0, py - 2.63e0 AS v1, (pose_id % 31) / 10e0 - 1.5e0 AS v2, (pose_id % 17 - 8) / 7e0 AS w0, (pose_id % 19 - 9) / 7e0 AS w1, (pose_id % 23 - 11) / 7e0 AS w2 FROM {poses}"""
UNIT = f"""SELECT drive_id, pose_id, v0, v1, v2, w0, w1, w2, {", ".join(f"{q}{i} / sqrt({q}0 * {q}0 + {q}1 * {q}1 + {q}2 * {q}2 + {q}3 * {q}3) AS {q}{i}" for q in "ab" for i in range(4))} FROM ({RAW})"""
FRAMED = UNIT.format(poses="poses")


def given():
    """The columns a, b, v and w; columns need a session, so they are made when a query is."""
    return G.vec("a0", "a1", "a2", "a3"), G.vec("b0", "b1", "b2", "b3"), G.vec("v0", "v1", "v2"), G.vec("w0", "w1", "w2")


def framed(t):
    p = t("poses")
    return p.sparkSession.sql(UNIT.format(poses="{p}"), p=p)


def product(a: list[str], b: list[str]) -> list[str]:
    """Of two quaternions, row by row of its table."""
    sign = [[(0, 0, 1), (1, 1, -1), (2, 2, -1), (3, 3, -1)], [(0, 1, 1), (1, 0, 1), (2, 3, 1), (3, 2, -1)], [(0, 2, 1), (1, 3, -1), (2, 0, 1), (3, 1, 1)], [(0, 3, 1), (1, 2, 1), (2, 1, -1), (3, 0, 1)]]
    return ["(" + " + ".join(f"{s} * {a[i]} * {b[j]}" for i, j, s in row) + ")" for row in sign]


def names(letter: str, n: int) -> list[str]:
    return [f"{letter}{i}" for i in range(n)]


TURNED = product(product(names("a", 4), ["0", "v0", "v1", "v2"]), ["a0", "-a1", "-a2", "-a3"])[1:]
STEP = [f"(a{i} + 0.005e0 * {x})" for i, x in enumerate(product(names("a", 4), ["0", "w0", "w1", "w2"]))]
STEP_SIZE = "sqrt(" + " + ".join(f"{x} * {x}" for x in STEP) + ")"


@query(f"""SELECT drive_id, pose_id, {", ".join(sql_units(x, f"mul{i}") for i, x in enumerate(product(names("a", 4), names("b", 4))))}, {", ".join(sql_units(x, f"turned{i}") for i, x in enumerate(TURNED))},
    {sql_units("2 * acos(least(1, abs(a0 * b0 + a1 * b1 + a2 * b2 + a3 * b3)))", "angle", 1e4)}, {", ".join(sql_units(f"{x} / {STEP_SIZE}", f"step{i}") for i, x in enumerate(STEP))}, {sql_units("-a2", "inv2")} FROM ({FRAMED})""")
def quaternions(t):
    a, b, v, w = given()
    q = framed(t)
    parts = [("mul", G.quat_mul(a, b)), ("turned", G.rotate(a, v)), ("step", G.quat_step(a, w, F.lit(0.01)))]
    return q.select("drive_id", "pose_id", *[units(x, f"{n}{i}") for n, xs in parts for i, x in enumerate(xs)], units(G.quat_angle(a, b), "angle", 1e4), units(G.quat_inv(a)[2], "inv2"))


MATRIX = ["1 - 2 * (a2 * a2 + a3 * a3)", "2 * (a1 * a2 - a0 * a3)", "2 * (a1 * a3 + a0 * a2)", "2 * (a1 * a2 + a0 * a3)", "1 - 2 * (a1 * a1 + a3 * a3)", "2 * (a2 * a3 - a0 * a1)", "2 * (a1 * a3 - a0 * a2)", "2 * (a2 * a3 + a0 * a1)", "1 - 2 * (a1 * a1 + a2 * a2)"]


@query(f"""SELECT drive_id, pose_id, {", ".join(sql_units(m, f"m{i}") for i, m in enumerate(MATRIX))}, {", ".join(sql_units(f"a{i}", f"back{i}") for i in range(4))},
    {sql_units("a1 * a1 / 4", "sym0")} FROM ({FRAMED})""")
def rotations(t):
    a, _, _, _ = given()
    m = G.quat_to_matrix(a)
    back = G.matrix_to_quat(m)
    sign = F.when(back[0] < 0, -1.0).otherwise(1.0)  # a0 is above 0 by construction
    return framed(t).select("drive_id", "pose_id", *[units(x, f"m{i}") for i, x in enumerate(m)], *[units(x * sign, f"back{i}") for i, x in enumerate(back)], units(a[1] * a[1] / 4, "sym0"))


@query(f"""SELECT drive_id, pose_id, {sql_units("CASE WHEN flip THEN remainder2(yaw + 180) ELSE yaw END".replace("remainder2(yaw + 180)", "(yaw + 180) - 360 * round_even((yaw + 180) / 360, 0)"), "yaw", 1e4)},
    {sql_units("CASE WHEN flip THEN (180 - pitch) - 360 * round_even((180 - pitch) / 360, 0) ELSE pitch END", "pitch", 1e4)}, {sql_units("CASE WHEN flip THEN (roll + 180) - 360 * round_even((roll + 180) / 360, 0) ELSE roll END", "roll", 1e4)} FROM (
    SELECT *, abs((yaw + 180) - 360 * round_even((yaw + 180) / 360, 0)) < abs(yaw) AS flip FROM (SELECT *, degrees(atan2({MATRIX[3]}, {MATRIX[0]})) AS yaw,
        degrees(atan2(-({MATRIX[6]}), sqrt(({MATRIX[7]}) ** 2 + ({MATRIX[8]}) ** 2))) AS pitch, degrees(atan2({MATRIX[7]}, {MATRIX[8]})) AS roll FROM ({FRAMED})))""")
def euler_angles(t):
    a, _, _, _ = given()
    return framed(t).select("drive_id", "pose_id", *[units(x, n, 1e4) for n, x in zip(("yaw", "pitch", "roll"), G.euler_zyx_deg(G.quat_to_matrix(a)), strict=True)])


SMALL = "CASE WHEN pose_id % 4 = 0 THEN 1e-7 ELSE 1e0 END"
ANGLE = f"(sqrt(w0 * w0 + w1 * w1 + w2 * w2) * {SMALL})"


@query(f"""SELECT drive_id, pose_id, {sql_units(f"cos({ANGLE} / 2)", "q0")}, {", ".join(sql_units(f"CASE WHEN {ANGLE} = 0 THEN 0 ELSE sin({ANGLE} / 2) * w{i} * {SMALL} / {ANGLE} END", f"q{i + 1}", 1e9) for i in range(3))} FROM ({FRAMED})""")
def exponential(t):
    """Also of rates so small that the series decides."""
    _, _, _, w = given()
    k = F.expr(SMALL)
    q = G.so3_exp(tuple(x * k for x in w))
    return framed(t).select("drive_id", "pose_id", units(q[0], "q0"), *[units(x, f"q{i + 1}", 1e9) for i, x in enumerate(q[1:])])


CROSS = ["v1 * w2 - v2 * w1", "v2 * w0 - v0 * w2", "v0 * w1 - v1 * w0"]


@query(f"""SELECT drive_id, pose_id, {", ".join(sql_units(x, f"cross{i}") for i, x in enumerate(CROSS))}, {sql_units("v0 * w0 + v1 * w1 + v2 * w2", "dot")}, {sql_units("sqrt(v0 * v0 + v1 * v1 + v2 * v2)", "norm")},
    {sql_units("v2 / sqrt(v0 * v0 + v1 * v1 + v2 * v2)", "unit2")}, {sql_units("sqrt(v0 * v0 + v1 * v1)", "planar")}, {sql_units("greatest(-1, least(2, v0))", "held")}, printf('%.3f', v1) AS text FROM ({FRAMED})""")
def vectors(t):
    _, _, v, w = given()
    s = G.skew(v)
    return framed(t).select(
        "drive_id", "pose_id", *[units(x, f"cross{i}") for i, x in enumerate(G.mat_vec(s, w))], units(G.dot(v, w), "dot"), units(G.norm(v), "norm"), units(G.normalize(v)[2], "unit2"),
        units(G.planar_range(v[0], v[1]), "planar"), units(G.clamp(v[0], -1.0, 2.0), "held"), G.fixed(v[1], 3).alias("text"),
    )


@query(f"""SELECT drive_id, pose_id, {", ".join(sql_units(f"CASE WHEN nw = 0 THEN v{i} ELSE w{i} / nw * nv END", f"t{i}", 1e5) for i in range(3))} FROM (
    SELECT *, sqrt(v0 * v0 + v1 * v1 + v2 * v2) AS nv, sqrt(w0 * w0 + w1 * w1 + w2 * w2) AS nw FROM ({FRAMED})) WHERE nw > 0""")
def shortest_turns(t):
    """The shortest rotation from v to w, applied to v, gives w's direction at v's length."""
    _, _, v, w = given()
    return framed(t).filter("w0 <> 0 or w1 <> 0 or w2 <> 0").select("drive_id", "pose_id", *[units(x, f"t{i}", 1e5) for i, x in enumerate(G.rotate(G.quat_between(v, w), v))])


#: a then b as rigid transforms: rotation matrices times a vector, with shifts v and w.
BM = [m.replace("a", "b") for m in MATRIX]
MOVED = [" + ".join(f"({MATRIX[3 * i + j]}) * (pose_id % {5 + j})" for j in range(3)) + f" + v{i}" for i in range(3)]
THEN = [" + ".join(f"({BM[3 * i + j]}) * ({MOVED[j]})" for j in range(3)) + f" + w{i}" for i in range(3)]


@query(f"SELECT drive_id, pose_id, {', '.join(sql_units(x, f'p{i}', 1e5) for i, x in enumerate(THEN))} FROM ({FRAMED})")
def rigid_transforms(t):
    a, b, v, w = given()
    both = G.se3_compose((G.quat_to_matrix(b), w), (G.quat_to_matrix(a), v))
    p = tuple((F.col("pose_id") % k).cast("double") for k in (5, 6, 7))
    return framed(t).select("drive_id", "pose_id", *[units(x, f"p{i}", 1e5) for i, x in enumerate(G.se3_apply(*both, p))])


COVARIANCE = POINT_COVS
NAMED = ("cxx", "cxy", "cxz", "cyy", "cyz", "czz")
FULL = [["cxx", "cxy", "cxz"], ["cxy", "cyy", "cyz"], ["cxz", "cyz", "czz"]]
R = [ROTATION[:3], ROTATION[3:6], ROTATION[6:]]
TURNED_COV = {f"c{a}{b}": " + ".join(f"{R[i][k] * R[j][m]!r}::DOUBLE * {FULL[k][m]}" for k in range(3) for m in range(3)) for (a, i), (b, j) in ((("x", 0), ("x", 0)), (("x", 0), ("y", 1)), (("x", 0), ("z", 2)), (("y", 1), ("y", 1)), (("y", 1), ("z", 2)), (("z", 2), ("z", 2)))}


@query(f"SELECT scan_id, point_id, {', '.join(sql_units(e, c) for c, e in TURNED_COV.items())} FROM (SELECT *, {', '.join(f'{e} AS {c}' for c, e in COVARIANCE.items())} FROM cloud)")
def transform_covariances(t):
    c = t("cloud").withColumns({k: F.expr(e) for k, e in COVARIANCE.items()})
    turns = c.select("scan_id").distinct().withColumn("r", F.array(*map(F.lit, ROTATION)))
    return points.transform_covariances(c, turns, ["scan_id"]).select("scan_id", "point_id", *[units(x, x) for x in NAMED])


@query(f"""SELECT drive_id, event_id, {", ".join(sql_units(f"({x} - lag({x}) OVER w) / gap", f"jerk_{c}", 1e9) for c, x in zip("xyz", ("wax", "way", "waz"), strict=True))} FROM (
    SELECT *, c * ax - s * ay AS wax, s * ax + c * ay AS way, az - 9.80665e0 AS waz, (stamp_ns - lag(stamp_ns) OVER (PARTITION BY drive_id ORDER BY stamp_ns, event_id)) / 1000000000e0 AS gap FROM (
        SELECT *, cos(event_id % 100 / 50e0) AS c, sin(event_id % 100 / 50e0) AS s FROM imu)) WINDOW w AS (PARTITION BY drive_id ORDER BY stamp_ns, event_id)""")
def jerk(t):
    """With attitudes about z."""
    half = F.expr("event_id % 100 / 100e0")
    i = t("imu").withColumns({"qw": F.cos(half), "qx": F.lit(0.0), "qy": F.lit(0.0), "qz": F.sin(half)})
    return imu.jerk(imu.imu_dt(i)).select("drive_id", "event_id", *[units(f"jerk_{c}", f"jerk_{c}", 1e9) for c in "xyz"])


@query("SELECT drive_id, scan_id, 0e0 * x + -1e0 * y + 0e0 * z + scan_id AS x, 1e0 * x + 0e0 * y + 0e0 * z + 0e0 AS y, 0e0 * x + 0e0 * y + 1e0 * z + -1e0 AS z, intensity FROM points")
def dense_cloud(t):
    p = t("points")
    c = p.select("drive_id", "scan_id").distinct().withColumns({"r": F.array(*map(F.lit, TURN)), "t": F.array(F.col("scan_id").cast("double"), F.lit(0.0), F.lit(-1.0))})
    return mapping.dense_cloud(p, p.limit(0), c).select("drive_id", "scan_id", "x", "y", "z", "intensity")


@query(f"""SELECT drive_id, scan_id, {sql_units("-1e0 * sy / n / 1e6 + scan_id", "x")}, {sql_units("sx / n / 1e6", "y")}, {sql_units("sz / n / 1e6 - 1", "z")}, count(*) AS n_cells FROM (
    SELECT drive_id, scan_id, count(*) AS n, CAST(sum(CAST(round(x * 1e6) AS BIGINT)) AS BIGINT) AS sx, CAST(sum(CAST(round(y * 1e6) AS BIGINT)) AS BIGINT) AS sy, CAST(sum(CAST(round(z * 1e6) AS BIGINT)) AS BIGINT) AS sz
    FROM points GROUP BY drive_id, scan_id, floor(x / 4), floor(y / 4), floor(z / 4)) GROUP BY ALL""")
def dense_cloud_filtered(t):
    """The voxelised side of the dense cloud."""
    p = t("points")
    c = p.select("drive_id", "scan_id").distinct().withColumns({"r": F.array(*map(F.lit, TURN)), "t": F.array(F.col("scan_id").cast("double"), F.lit(0.0), F.lit(-1.0))})
    v = mapping.dense_cloud(p.limit(0), points.voxel_grid(p, 4.0), c, filtered=True)
    return v.groupBy("drive_id", "scan_id", *[units(x, x) for x in "xyz"]).agg(F.count(F.lit(1)).alias("n_cells"))


@query("SELECT drive_id, pose_id AS scan_id, row_number() OVER (PARTITION BY drive_id ORDER BY stamp_ns, pose_id) - 1 AS n FROM poses")
def pose_places(t):
    return trajectory.pose_places(t("poses").withColumn("scan_id", F.col("pose_id")), 30 * 24 * HOUR_NS).select("drive_id", "scan_id", "n")


@query(f"""SELECT drive_id, pose_id AS scan_id, {sql_units("1 - py", "px")}, {sql_units("px + 2", "py")}, {sql_units("pz + pose_id % 3", "pz")}, {sql_units(f"{0.5**0.5!r}::DOUBLE * (cos(half) - sin(half))", "qw")} FROM (SELECT *, (pose_id % 90) / 200e0 AS half FROM poses)""")
def corrected_poses(t):
    """A quarter turn about z and a shift behind each prior pose."""
    angle, o, one = F.expr("(pose_id % 90) / 100e0"), F.lit(0.0), F.lit(1.0)
    p = t("poses").withColumn("scan_id", F.col("pose_id"))
    prior = p.select("drive_id", "scan_id", "stamp_ns", F.array(F.cos(angle), -F.sin(angle), o, F.sin(angle), F.cos(angle), o, o, o, one).alias("r"), F.array("px", "py", "pz").alias("t"))
    fix = p.select("drive_id", "scan_id", F.array(*map(F.lit, TURN)).alias("r"), F.array(one, one * 2, (F.col("pose_id") % 3).cast("double")).alias("t"))
    return trajectory.corrected_poses(prior, fix).select("drive_id", "scan_id", *[units(c, c) for c in ("px", "py", "pz", "qw")])


@query("SELECT drive_id, scan_id, point_id, row_number() OVER (PARTITION BY drive_id, scan_id ORDER BY stamp_ns, point_id) AS place FROM stamps")
def sort_by_time(t):
    """Places counted in the order in which rows stand, which the operator has made that of time."""

    def count(batches):
        places: dict = {}
        for pdf in batches:
            out = []
            for key in zip(pdf["drive_id"].tolist(), pdf["scan_id"].tolist(), strict=True):
                if key not in places:
                    places = {key: 0}  # a scan stands together, so the one before it is over
                places[key] += 1
                out.append(places[key])
            yield pdf[["drive_id", "scan_id", "point_id"]].assign(place=out)

    s = points.sort_by_time(t("stamps"))
    kinds = dict(s.dtypes)
    return s.mapInPandas(count, f"drive_id {kinds['drive_id']}, scan_id {kinds['scan_id']}, point_id {kinds['point_id']}, place long")


VOXEL = ", ".join(f"CAST(floor({c} / 4) AS BIGINT) AS v{c}" for c in "xyz")
MEANS = ", ".join(f"CAST(sum(CAST(round({c} * 1000000) AS BIGINT)) AS BIGINT) / count(*) / 1000000 AS {c}" for c in ("x", "y", "z", "intensity"))


@query(f"SELECT drive_id, x, y, z, intensity, n FROM (SELECT drive_id, {VOXEL}, {MEANS}, count(*) AS n FROM (SELECT * FROM points) GROUP BY drive_id, floor(x / 4), floor(y / 4), floor(z / 4), vx, vy, vz)".replace(f"{VOXEL}, {MEANS}", f"{MEANS}, {VOXEL}").replace("GROUP BY drive_id, floor(x / 4), floor(y / 4), floor(z / 4), vx, vy, vz", "GROUP BY drive_id, vx, vy, vz"))
def map_export(t):
    """The map as it is written below a shared folder, read back."""
    p = t("points")
    path = f"{shared_dir(p.sparkSession).rstrip('/')}/map-{uuid.uuid4().hex}"
    p.sparkSession.range(1).write.parquet(f"{path}/parent")  # the export asks for a parent that is there
    assert mapping.map_export(p, 4.0, f"{path}/map")
    return p.sparkSession.read.parquet(f"{path}/map")


@query("SELECT drive_id, scan_id, point_id, x, y, z, concat_ws('_', CAST(floor(x / 2) AS BIGINT), CAST(floor(y / 2) AS BIGINT), CAST(floor(z / 2) AS BIGINT)) AS cell FROM cloud")
def layout(t):
    """Points as they are laid out on disk, read back."""
    c = t("cloud")
    path = f"{shared_dir(c.sparkSession).rstrip('/')}/layout-{uuid.uuid4().hex}"
    spatial.write_layout(c, path, 2.0, files=16)
    return c.sparkSession.read.parquet(path).drop("zkey")


TIMES = "SELECT drive_id, scan_id, point_id, scan_stamp_ns, {0} AS sensor, {1} AS stamp_ns FROM stamps WHERE point_id % 2 = {2}"


@query(TIMES.format("'OUSTER'", "scan_stamp_ns + point_id * 7", 0) + " UNION ALL " + TIMES.format("'HESAI'", "CAST(round((1700000000 + point_id / 1024e0) * 1e9) AS BIGINT)", 1))
def more_sensor_times(t):
    """The two sensor layouts that sensor_times has not."""
    s = t("stamps").drop("stamp_ns")
    ouster = points.normalize_point_time(points.detect_sensor(s.filter("point_id % 2 = 0").withColumn("t", (F.col("point_id") * 7).cast("long"))))
    hesai = points.normalize_point_time(points.detect_sensor(s.filter("point_id % 2 = 1").withColumn("timestamp", F.expr("1700000000 + point_id / 1024e0"))))
    keep = ["drive_id", "scan_id", "point_id", "scan_stamp_ns", "sensor", "stamp_ns"]
    return ouster.select(*keep).unionByName(hesai.select(*keep))


PAIRED = "list_zip(embedding, list_reverse(embedding))"


@query(f"""SELECT vec_id, {sql_units(f"list_sum(list_transform({PAIRED}, lambda p: abs(CAST(p[1] AS DOUBLE) - p[2])))", "l1", 1e4)}, {sql_units(f"list_sum(list_transform({PAIRED}, lambda p: (CAST(p[1] AS DOUBLE) - p[2]) ** 2))", "l2", 1e4)},
    {sql_units("(CAST(embedding[1] AS DOUBLE) - embedding[-1]) * 9 - 2 * pi() * (CASE WHEN (CAST(embedding[1] AS DOUBLE) - embedding[-1]) * 9 > pi() THEN 1 WHEN (CAST(embedding[1] AS DOUBLE) - embedding[-1]) * 9 < -pi() THEN -1 ELSE 0 END)", "so2", 1e4)} FROM embeddings""")
def array_distances(t):
    """Each vector against itself reversed; for angles scaled up, so that some wrap."""
    e = t.func(*t.args, "cloud").sparkSession.read.parquet(f"{t.args[1]}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    scaled = F.transform("v", lambda x: x * 9)
    return e.select("vec_id", *[units(spatial.distance_column(m, F.col("v"), F.reverse("v")), m, 1e4) for m in ("l1", "l2")], units(spatial.distance_column("so2", scaled, F.reverse(scaled)), "so2", 1e4))
