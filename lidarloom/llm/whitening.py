"""Whitening of embeddings: exact covariance sums, float32 eigenvectors refined in higher precision.

Vectors are whole numbers, so the covariance's sums are exact however they are added up. The eigenvectors come from a
float32 solver and are corrected by the iteration of Ogita and Aishima (2018), whose steps are matrix products in
extended precision; eigenvalues too close to be told apart are solved among themselves, as in their second paper (2019).
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Rounds of refinement at most; each about squares the error, so five will do where no eigenvalues are close.
ROUNDS = 12
#: A correction of this size leaves an error of its square.
SETTLED = 1e-10
#: Numbers that a task holds at once.
HELD = 1 << 21
#: Below this size sums of products and squares are exact in 64 bits.
SAFE = 1 << 62
Wide = np.longdouble


def finite(vector: Column) -> Column:
    """Not null, and all components neither null nor NaN nor infinite."""
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def whole(vector: Column) -> Column:
    """The vector in whole numbers: floor(SCALE * c) + SHIFT of each component c."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + SHIFT)


def blocks(batch: pa.RecordBatch, name: str):
    """(dimension, rows, matrix) of the batch's vectors by length, HELD numbers or so at a time."""
    column = batch.column(batch.schema.get_field_index(name))
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat, starts = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        for part in np.array_split(rows, len(rows) * d // HELD + 1):
            if len(part):
                yield d, part, flat[starts[part][:, None] + np.arange(d)]


def product_sums(vectors: DataFrame, centre: dict[int, np.ndarray], largest: dict[int, int]) -> DataFrame:
    """(x) -> d, i, j, s: sums over all vectors of length d of (x_i - c_i) * (x_j - c_j), j <= i, exact."""

    def run(batches):
        held: dict[int, np.ndarray] = {}  # a matrix for each length
        for batch in batches:
            for d, _, x in blocks(batch, "x"):
                y = x - centre[d]
                if largest[d] ** 2 * len(y) < SAFE:
                    sums = y.T @ y
                else:
                    wide = y.astype(object)
                    sums = wide.T @ wide
                held[d] = sums.astype(object) + held.get(d, 0)
        for d, sums in held.items():
            i, j = np.tril_indices(d)
            for part in np.array_split(np.arange(len(i)), len(i) // 65536 + 1):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), d)), pa.array(i[part]), pa.array(j[part]), pa.array([Decimal(int(v)) for v in sums[i[part], j[part]]], pa.decimal128(38, 0))], names=["d", "i", "j", "s"]
                )

    return vectors.select("x").mapInArrow(run, "d long, i long, j long, s decimal(38,0)").groupBy("d", "i", "j").agg(F.sum("s").alias("s"))


def close_groups(values: np.ndarray, gap) -> list[np.ndarray]:
    """Runs of two or more sorted values whose neighbours are no further apart than gap."""
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.diff(values[order]) > gap) + 1
    return [g for g in np.split(order, cuts) if len(g) > 1]


def refined(a: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors in columns) of a symmetric matrix, falling, in extended precision.

    Start: float32 eigenvectors X. A round takes R = I - X'X and S = X'AX in extended precision, reads the eigenvalues
    off as S_ii / (1 - R_ii), and corrects X by X @ E with E_ij = (S_ij + l_j R_ij) / (l_j - l_i). Where two eigenvalues
    are closer than the error of S they can't be told apart by that quotient: E_ij is R_ij / 2, which only makes their
    vectors orthonormal, and the group's own small matrix V'(A - mean)V, of which the common part is taken off so that
    its digits count in full, is solved and turns the group's vectors. The next round refines those. Equal eigenvalues
    stay a group; any orthonormal basis of theirs will do.
    """
    scale = max(float(np.abs(a).max()), np.finfo(float).tiny)
    a = a.astype(Wide) / Wide(scale)
    d = len(a)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(Wide)
    eye = np.eye(d, dtype=Wide)
    size = np.sqrt((a * a).sum())
    floor = 1e4 * d * np.finfo(Wide).eps * size  # values closer than this count as equal: rounding alone turns their vectors
    for _ in range(rounds):
        r = eye - x.T @ x
        s = x.T @ a @ x
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(values)
        error = max(floor, 2 * (np.sqrt((off * off).sum()) + size * np.sqrt((r * r).sum())))
        apart = values[None, :] - values[:, None]
        groups = close_groups(values, error)
        near = np.zeros((d, d), dtype=bool)
        for g in groups:
            near[np.ix_(g, g)] = True
        near |= np.abs(apart) <= error
        e = np.where(near, r / 2, (s + values[None, :] * r) / np.where(near, 1, apart))
        x = x + x @ e
        is_open = bool(np.abs(e).max() > SETTLED)
        for g in groups:
            v = x[:, g]
            own = v.T @ ((a - eye * values[g].mean()) @ v)
            own = (own + own.T) / 2
            most = np.abs(own).max()
            if most > floor:
                x[:, g] = v @ np.linalg.eigh((own / most).astype(np.float64))[1].astype(Wide)
                is_open = True
        if not is_open:
            break
    r = eye - x.T @ x
    x = x + x @ r / 2
    values = np.diag(x.T @ a @ x) * Wide(scale)
    order = np.argsort(-values, kind="stable")
    x = x[:, order]
    x = x * np.where(x[np.abs(x).argmax(0), np.arange(d)] < 0, -1, 1)  # the sign is free: the largest entry is positive
    return values[order], x


@dataclass(frozen=True)
class Whitening:
    """For vectors of one length: how many were fitted, their sums, the components as columns (each over the root of its
    eigenvalue), and the eigenvalues' shares of the trace. Components without variance are left out."""

    n: int
    sums: np.ndarray
    largest: int
    components: np.ndarray
    explained: np.ndarray

    @staticmethod
    def of(n: int, sums: list[int], centre: np.ndarray, products: np.ndarray, largest: int, components: int) -> Whitening:
        """products: sums of products about `centre`, whole numbers. What the centre is beside the mean, below 1, is
        taken off exactly before anything is rounded."""
        rest = np.array([s - n * int(c) for s, c in zip(sums, centre, strict=True)], dtype=object)
        exact = n * products - np.outer(rest, rest)
        high = np.array([[int(v) / (n * n) for v in row] for row in exact])  # correctly rounded
        low = np.array([[float(Fraction(int(v), n * n) - Fraction(h)) for v, h in zip(row, hs, strict=True)] for row, hs in zip(exact, high, strict=True)])
        cov = high.astype(Wide) + low.astype(Wide)
        values, vectors = refined(cov)
        some = values[:components] > values[0] * len(values) * np.finfo(float).eps
        keep = np.flatnonzero(some & (values[:components] > 0))
        trace = np.trace(cov)
        scaled = vectors[:, keep] / np.sqrt(values[keep])
        return Whitening(n, np.array(sums, dtype=object), largest, scaled.astype(float), (values[keep] / trace if trace > 0 else values[keep]).astype(float))

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact."""
        if (self.largest + 1) * self.n < SAFE and all(abs(int(s)) < SAFE for s in self.sums) and int(np.abs(x).max(initial=0)) * self.n < SAFE:
            return x * np.int64(self.n) - self.sums.astype(np.int64)
        return x.astype(object) * self.n - self.sums

    def whitened(self, deviations: np.ndarray) -> np.ndarray:
        return (deviations.astype(float) / self.n) @ self.components

    def squares(self, deviations: np.ndarray) -> list[int | None]:
        """Sums of squares; None where one is beyond 64 bits."""
        if (self.largest * self.n) ** 2 * len(self.sums) < SAFE:
            return (deviations * deviations).sum(1).tolist()
        wide = deviations.astype(object)
        return [v if v < 1 << 63 else None for v in (int(t) for t in (wide * wide).sum(1))]


def fitted(distinct: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """(x) distinct and stored -> the whitening of each length. What reaches the driver is a row for each length and
    pair of dimensions."""
    size = F.size("x").cast("long")
    found: dict[int, tuple[int, list[int], list[int], list[int]]] = {}
    each = distinct.select(size.alias("d"), F.posexplode("x").alias("i", "v"))
    for r in each.groupBy("d", "i").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("v").cast("decimal(20,0)")).alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("d", "i").collect():
        n, sums, lo, hi = found.setdefault(r["d"], (r["n"], [], [], []))
        sums.append(int(r["s"]))
        lo.append(r["lo"])
        hi.append(r["hi"])
    centre = {d: np.array([(2 * s + n) // (2 * n) for s in sums], dtype=np.int64) for d, (n, sums, _, _) in found.items()}
    largest = {d: max([1, *(h - low for low, h in zip(lo, hi, strict=True))]) for d, (_, _, lo, hi) in found.items()}
    if not found:
        return {}
    products = {d: np.zeros((d, d), dtype=object) for d in found}
    for r in product_sums(distinct, centre, largest).collect():
        products[r["d"]][r["i"], r["j"]] = products[r["d"]][r["j"], r["i"]] = int(r["s"])
    return {d: Whitening.of(n, sums, centre[d], products[d], largest[d], components) for d, (n, sums, _, _) in found.items()}


def identity_errors(distinct: DataFrame, models: dict[int, Whitening]) -> dict[int, float]:
    """For each length, by how much the covariance of the fitted vectors' whitened values is off the identity at most,
    measured on all of them."""

    def run(batches):
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for d, _, x in blocks(batch, "x"):
                if d in models and len(models[d].explained):
                    z = models[d].whitened(models[d].deviations(x))
                    before = held.get(d, (0.0, 0.0))
                    held[d] = (before[0] + z.sum(0), before[1] + z.T @ z)
        for d, (s, p) in held.items():
            k = len(s)
            table = np.concatenate([s[None, :], p])  # row 0: sums; the others: products
            i, j = np.indices(table.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k * (k + 1), d)), pa.array(i), pa.array(j), pa.array(table.ravel())], names=["d", "i", "j", "s"])

    rows = distinct.select("x").mapInArrow(run, "d long, i long, j long, s double").groupBy("d", "i", "j").agg(F.sum("s").alias("s")).collect()
    sums = {d: np.zeros((len(m.explained) + 1, len(m.explained))) for d, m in models.items()}
    for r in rows:
        sums[r["d"]][r["i"], r["j"]] = r["s"]
    out = {}
    for d, m in models.items():
        mean = sums[d][0] / m.n
        own = sums[d][1:] / m.n - np.outer(mean, mean)
        out[d] = float(np.abs(own - np.eye(len(mean))).max(initial=0.0))
    return out


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, embedding) -> vec_id, component (from 1), n, deviation, whitened, explained, identity_error: for each
    row, its value on each of the first `components` components of the embeddings' whole numbers x (see whole()).

    The fit is over each distinct x once; covariances are about the mean, divisor n. deviation is the sum of squares of
    n * x - S (S: the fit's sums), exact; null where that is beyond a long.

    Rows whose vector is null or holds null, NaN or infinite components are left out; empty vectors have no components
    and give no rows. A null vec_id stays. Repeated rows each get their rows. Vectors of several lengths are fitted each
    among its own. Components without variance (fewer distinct vectors than dimensions, or a constant) are left out.
    Equal eigenvalues have some orthonormal basis of theirs. An empty table gives no rows; other columns don't take part.
    """
    v = vectors.select("vec_id", F.col("embedding").alias("v")).filter(finite(F.col("v")) & (F.size("v") > 0))
    x = v.select("vec_id", whole(F.col("v")).alias("x"))
    distinct = stored(x.select("x").distinct())
    models = fitted(distinct, components)
    errors = identity_errors(distinct, models)
    kind = x.schema["vec_id"]

    def run(batches):
        for batch in batches:
            for d, rows, found in blocks(batch, "x"):
                y = models[d].deviations(found)
                z = models[d].whitened(y)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(rows)), pa.array(np.full(len(rows), d)), pa.array(models[d].squares(y), pa.int64()),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, max(z.shape[1], 1), dtype=np.int32)[: len(rows) + 1] if z.shape[1] else np.zeros(len(rows) + 1, np.int32)), pa.array(z.ravel())),
                    ],
                    names=["vec_id", "d", "deviation", "z"],
                )

    out = x.mapInArrow(run, f"vec_id {kind.dataType.simpleString()}, d long, deviation long, z array<double>")
    facts = [(d, m.n, errors[d], m.explained.tolist()) for d, m in models.items()]  # a row for each length
    facts = F.broadcast(out.sparkSession.createDataFrame(facts, "d long, n long, identity_error double, e array<double>"))
    out = out.join(facts, "d").select("vec_id", "n", "deviation", "identity_error", "e", F.posexplode("z").alias("k", "whitened"))
    return out.select("vec_id", (F.col("k") + 1).cast("int").alias("component"), "n", "deviation", "whitened", F.get("e", F.col("k")).alias("explained"), "identity_error")
