"""Column expressions against NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lidarloom.functions import geometry as G


def mat(q):
    w, x, y, z = q
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])


@pytest.fixture(scope="module")
def sample(spark):
    global Q, P, A, B  # Columns need a session
    Q, P, A, B = (G.vec(*[f"{n}{i}" for i in range(k)]) for n, k in (("q", 4), ("p", 4), ("a", 3), ("b", 3)))
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(50):
        q, p = rng.normal(size=4), rng.normal(size=4)
        rows.append([*(q / np.linalg.norm(q)).tolist(), *(p / np.linalg.norm(p)).tolist(), *rng.normal(size=6).tolist()])
    names = [*(f"q{i}" for i in range(4)), *(f"p{i}" for i in range(4)), *(f"a{i}" for i in range(3)), *(f"b{i}" for i in range(3))]
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))


def values(df, exprs, names):
    rows = df.select(*names, F.array(*exprs).alias("out")).collect()
    return [(r, np.array(r["out"])) for r in rows]


def part(r, name, n):
    return np.array([r[f"{name}{i}"] for i in range(n)])


ALL = [f"{n}{i}" for n, k in (("q", 4), ("p", 4), ("a", 3), ("b", 3)) for i in range(k)]


def test_rotation(sample):
    for r, out in values(sample, G.rotate(Q, A), ALL):
        assert np.allclose(out, mat(part(r, "q", 4)) @ part(r, "a", 3))


def test_product_and_matrix(sample):
    for r, out in values(sample, G.quat_to_matrix(G.quat_mul(Q, P)), ALL):
        assert np.allclose(out.reshape(3, 3), mat(part(r, "q", 4)) @ mat(part(r, "p", 4)))
    for r, out in values(sample, G.matrix_to_quat(G.quat_to_matrix(Q)), ALL):
        q = part(r, "q", 4)
        assert np.allclose(out, q) or np.allclose(out, -q)


def test_between(spark, sample):
    for r, out in values(sample, G.rotate(G.quat_between(A, B), A), ALL):
        b = part(r, "b", 3)
        assert np.allclose(out / np.linalg.norm(out), b / np.linalg.norm(b))
    one = spark.range(1)
    up, down = tuple(map(F.lit, (0.0, 0.0, 2.0))), tuple(map(F.lit, (0.0, 0.0, -1.0)))
    assert np.allclose(one.select(F.array(*G.rotate(G.quat_between(up, down), up))).first()[0], [0, 0, -2])


def test_angle(spark):
    q = tuple(map(F.lit, (math.cos(0.3), 0.0, 0.0, math.sin(0.3))))
    e = tuple(map(F.lit, (-1.0, 0.0, 0.0, 0.0)))
    assert abs(spark.range(1).select(G.quat_angle(q, e)).first()[0] - 0.6) < 1e-12


def test_exp(spark):
    for w in ((0.3, -0.2, 0.5), (1e-6, 2e-6, 0.0), (0.0, 0.0, 0.0)):
        out = spark.range(1).select(F.array(*G.so3_exp(tuple(map(F.lit, w))))).first()[0]
        t = np.linalg.norm(w)
        want = [math.cos(t / 2), *(np.array(w) * (math.sin(t / 2) / t if t else 0.5))]
        assert np.allclose(out, want, atol=1e-12)


def test_symmetric(sample):
    s = (A[0] * A[0] + 2, A[0] * A[1], A[0] * A[2], A[1] * A[1] + 2, A[1] * A[2], A[2] * A[2] + 2)
    for r, out in values(sample, G.sym_inverse(s), ALL):
        a = part(r, "a", 3)
        m = np.outer(a, a) + 2 * np.eye(3)
        assert np.allclose(out, np.linalg.inv(m)[np.triu_indices(3)])
    for r, out in values(sample, G.sym_rotate(G.quat_to_matrix(Q), s), ALL):
        a = part(r, "a", 3)
        m = np.outer(a, a) + 2 * np.eye(3)
        t = mat(part(r, "q", 4))
        assert np.allclose(out, (t @ m @ t.T)[np.triu_indices(3)])


def test_euler(spark):
    one = spark.range(1)
    for yaw, pitch, roll in ((30, 20, -40), (80, -10, 5), (120, 10, 20)):
        cy, sy, cp, sp, cr, sr = (f(math.radians(v)) for v in (yaw, pitch, roll) for f in (math.cos, math.sin))
        m = np.array([[cy, -sy, 0], [sy, cy, 0], [0, 0, 1]]) @ np.array([[cp, 0, sp], [0, 1, 0], [-sp, 0, cp]]) @ np.array([[1, 0, 0], [0, cr, -sr], [0, sr, cr]])
        out = one.select(F.array(*G.euler_zyx_deg(tuple(map(F.lit, m.ravel().tolist()))))).first()[0]
        want = [yaw, pitch, roll] if yaw <= 90 else [yaw - 180, 180 - pitch, roll - 180]
        assert np.allclose(out, want)


def test_distances(spark):
    d = spark.createDataFrame([([0.0, 3.0], [4.0, -3.0])], "a array<double>, b array<double>")
    got = d.select(G.l1(F.col("a"), F.col("b")), G.l2(F.col("a"), F.col("b")), G.so2(F.col("a"), F.col("b"))).first()
    assert got[0] == 10 and got[1] == 52 and abs(got[2] - (2 * math.pi - 6)) < 1e-12
    assert set(G.METRICS) == {"l1", "l2", "l2_simple", "so2", "so3"}


def test_clamp_and_format(spark):
    assert spark.range(1).select(G.clamp(F.lit(7.0), 0.5, 5.0), G.fixed(F.lit(3.14159), 3)).first()[:] == (5.0, "3.142")
