"""Vectors, quaternions, rotations and rigid transforms as Column expressions.

A vector is a tuple of 3 Columns, a quaternion of 4 (w, x, y, z), a matrix of 9 (row-major), a symmetric matrix of 6
(xx, xy, xz, yy, yz, zz). Everything stays inside code generation; nothing here is a UDF.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]
Quat = tuple[Column, Column, Column, Column]
Mat = tuple[Column, ...]


def vec(*names: str) -> tuple[Column, ...]:
    return tuple(F.col(n) for n in names)


def items(array: Column, n: int) -> tuple[Column, ...]:
    return tuple(F.get(array, i) for i in range(n))


def add(a: Sequence[Column], b: Sequence[Column]) -> tuple[Column, ...]:
    return tuple(x + y for x, y in zip(a, b, strict=True))


def sub(a: Sequence[Column], b: Sequence[Column]) -> tuple[Column, ...]:
    return tuple(x - y for x, y in zip(a, b, strict=True))


def scale(a: Sequence[Column], k: Column | float) -> tuple[Column, ...]:
    return tuple(x * k for x in a)


def dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    out = a[0] * b[0]
    for x, y in zip(a[1:], b[1:], strict=True):
        out = out + x * y
    return out


def norm(a: Sequence[Column]) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Sequence[Column]) -> tuple[Column, ...]:
    """Unit vector or unit quaternion; zero stays zero."""
    n = norm(a)
    return tuple(F.when(n > 0, x / n).otherwise(x) for x in a)


def cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def skew(a: Vec) -> Mat:
    """The matrix that crosses a with what it is applied to."""
    o = F.lit(0.0)
    return (o, -a[2], a[1], a[2], o, -a[0], -a[1], a[0], o)


def planar_range(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def clamp(value: Column, low: Column | float, high: Column | float) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.greatest(as_column(low), F.least(as_column(high), value))


def fixed(value: Column, digits: int) -> Column:
    """Text with a fixed number of decimals, no thousands separators."""
    return F.format_string(f"%.{digits}f", value)


# --- quaternions


def quat_mul(a: Quat, b: Quat) -> Quat:
    aw, av = a[0], a[1:]
    bw, bv = b[0], b[1:]
    return (aw * bw - dot(av, bv), *add(add(scale(bv, aw), scale(av, bw)), cross(av, bv)))


def quat_conj(q: Quat) -> Quat:
    return (q[0], -q[1], -q[2], -q[3])


def quat_inv(q: Quat) -> Quat:
    return tuple(x / dot(q, q) for x in quat_conj(q))


def quat_step(q: Quat, w: Vec, dt: Column) -> Quat:
    """One first-order step of q by body rate w over dt, normalised."""
    turned = quat_mul(q, (F.lit(0.0), *w))
    return normalize(add(q, scale(turned, 0.5 * dt)))


def rotate(q: Quat, v: Vec) -> Vec:
    """v turned by the unit quaternion q."""
    t = scale(cross(q[1:], v), 2.0)
    return add(add(v, scale(t, q[0])), cross(q[1:], t))


def quat_to_matrix(q: Quat) -> Mat:
    w, x, y, z = q
    return (
        1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y),
        2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
        2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y),
    )


def matrix_to_quat(m: Mat) -> Quat:
    """Unit quaternion of a rotation matrix: of four equal formulas, the one whose divisor is largest."""
    r = lambda i, j: m[3 * i + j]
    trace = r(0, 0) + r(1, 1) + r(2, 2)
    root = lambda s: F.sqrt(F.greatest(s, F.lit(0.0))) * 2
    sw = root(trace + 1)
    cases = [(sw / 4, (r(2, 1) - r(1, 2)) / sw, (r(0, 2) - r(2, 0)) / sw, (r(1, 0) - r(0, 1)) / sw)]
    for i in range(3):
        j, k = (i + 1) % 3, (i + 2) % 3
        s = root(1 + r(i, i) - r(j, j) - r(k, k))
        v: list[Column] = [F.lit(0.0)] * 3
        v[i], v[j], v[k] = s / 4, (r(j, i) + r(i, j)) / s, (r(k, i) + r(i, k)) / s
        cases.append(((r(k, j) - r(j, k)) / s, *v))
    xx, yy = (r(0, 0) >= r(1, 1)) & (r(0, 0) >= r(2, 2)), r(1, 1) >= r(2, 2)
    return tuple(F.when(trace > 0, c[0]).when(xx, c[1]).when(yy, c[2]).otherwise(c[3]) for c in zip(*cases, strict=True))


def quat_between(a: Vec, b: Vec) -> Quat:
    """The shortest rotation that turns a to b's direction; for opposite vectors half a turn about some normal."""
    u, v = normalize(a), normalize(b)
    c = dot(u, v)
    n = normalize((1 + c, *cross(u, v)))
    flat = F.abs(u[0]) < 0.9
    axis = normalize(cross(u, (F.when(flat, 1.0).otherwise(0.0), F.when(flat, 0.0).otherwise(1.0), F.lit(0.0))))
    opposite = c < -1 + 1e-12
    return tuple(F.when(opposite, h).otherwise(x) for h, x in zip((F.lit(0.0), *axis), n, strict=True))


def quat_angle(a: Quat, b: Quat) -> Column:
    """Angle in radians between two attitudes, the short way round."""
    sign = F.when(dot(a, b) < 0, -1.0).otherwise(1.0)
    d = quat_mul(a, quat_inv(scale(b, sign)))
    return 2 * F.atan2(norm(d[1:]), d[0])


def ieee_remainder(x: Column, y: float) -> Column:
    return x - y * F.rint(x / y)


def euler_zyx_deg(m: Mat) -> tuple[Column, Column, Column]:
    """(yaw, pitch, roll) in degrees with yaw as small as it can be: of the two triples that give one rotation, the
    first has its pitch within a quarter turn."""
    yaw = F.degrees(F.atan2(m[3], m[0]))
    pitch = F.degrees(F.atan2(-m[6], F.sqrt(m[7] * m[7] + m[8] * m[8])))
    roll = F.degrees(F.atan2(m[7], m[8]))
    other = (ieee_remainder(yaw + 180.0, 360.0), ieee_remainder(180.0 - pitch, 360.0), ieee_remainder(roll + 180.0, 360.0))
    swap = F.abs(other[0]) < F.abs(yaw)
    return tuple(F.when(swap, o).otherwise(x) for o, x in zip(other, (yaw, pitch, roll), strict=True))


# --- matrices and rigid transforms (matrix, vector)


def mat_mul(a: Mat, b: Mat) -> Mat:
    return tuple(dot(a[3 * i : 3 * i + 3], (b[j], b[3 + j], b[6 + j])) for i in range(3) for j in range(3))


def mat_vec(m: Mat, v: Vec) -> Vec:
    return tuple(dot(m[3 * i : 3 * i + 3], v) for i in range(3))


def transpose(m: Mat) -> Mat:
    return tuple(m[3 * j + i] for i in range(3) for j in range(3))


def se3_apply(r: Mat, t: Vec, p: Vec) -> Vec:
    return add(mat_vec(r, p), t)


def se3_compose(a: tuple[Mat, Vec], b: tuple[Mat, Vec]) -> tuple[Mat, Vec]:
    """First b, then a."""
    return mat_mul(a[0], b[0]), se3_apply(*a, b[1])


def so3_exp(w: Vec) -> Quat:
    """Unit quaternion of the rotation vector w; by series where the angle is tiny."""
    t2 = dot(w, w)
    t = F.sqrt(t2)
    tiny = t2 < 1e-10
    imag = F.when(tiny, 0.5 - t2 / 48.0 + t2 * t2 / 3840.0).otherwise(F.sin(t / 2) / F.when(tiny, 1.0).otherwise(t))
    real = F.when(tiny, 1.0 - t2 / 8.0 + t2 * t2 / 384.0).otherwise(F.cos(t / 2))
    return (real, *scale(w, imag))


def sym_to_mat(s: Sequence[Column]) -> Mat:
    xx, xy, xz, yy, yz, zz = s
    return (xx, xy, xz, xy, yy, yz, xz, yz, zz)


def sym_of(m: Mat) -> tuple[Column, ...]:
    return (m[0], m[1], m[2], m[4], m[5], m[8])


def sym_rotate(r: Mat, s: Sequence[Column]) -> tuple[Column, ...]:
    """R S R^T."""
    return sym_of(mat_mul(mat_mul(r, sym_to_mat(s)), transpose(r)))


def sym_inverse(s: Sequence[Column]) -> tuple[Column, ...]:
    xx, xy, xz, yy, yz, zz = s
    a, b, c = yy * zz - yz * yz, xz * yz - xy * zz, xy * yz - xz * yy
    det = xx * a + xy * b + xz * c
    return tuple(v / det for v in (a, b, c, xx * zz - xz * xz, xy * xz - xx * yz, xx * yy - xy * xy))


# --- distances between arrays, for kNN over vectors of any length


def l1(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)


def l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def so2(a: Column, b: Column) -> Column:
    """Signed difference of the last components as angles, wrapped to half a turn either way."""
    d = F.element_at(b, -1) - F.element_at(a, -1)
    return F.when(d > math.pi, d - 2 * math.pi).when(d < -math.pi, d + 2 * math.pi).otherwise(d)


METRICS: dict[str, Callable[[Column, Column], Column]] = {"l1": l1, "l2": l2, "l2_simple": l2, "so2": so2, "so3": l2}
