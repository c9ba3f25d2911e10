"""Registration of many scan pairs at once: correspondences, normal equations, Levenberg-Marquardt.

With the matches of an outer iteration fixed, the error is quadratic in the twelve entries of [R|t]. So 73 sums a pair
hold all that its inner trials need, and an outer iteration is one join and one aggregation for all pairs together;
only the 6 x 6 solves run in Python, a row a pair.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..params import Params
from ..session import shared_dir, stored
from .covariance import COVS
from .points import cell
from .spatial import AROUND, nn_within

#: Homogeneous index pairs and symmetric weight entries of the 60 second-order sums.
HOMOGENEOUS = [(i, j) for i in range(4) for j in range(i, 4)]
SYMMETRIC = [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]
EYE = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]


def correspondences(source: DataFrame, target: DataFrame, state: DataFrame, distance: float) -> DataFrame:
    """source, target (pair_id, point_id, x, y, z, cxx..czz), state (pair_id, r, t) -> pair_id, a*, b*, the weights m**
    of each source point whose moved place has a target point nearer than distance; its nearest one counts.

    The grid's cell is that distance, so one pass over 27 cells is exact; only ids and places go there, covariances are
    joined to the one match. The weight is the inverse of the target's covariance plus the turned one of the source.
    """
    s = source.join(state.select("pair_id", "r", "t"), "pair_id")
    r, t = G.items(F.col("r"), 9), G.items(F.col("t"), 3)
    s = s.withColumns({f"m{c}": v for c, v in zip("xyz", G.se3_apply(r, t, G.vec("x", "y", "z")), strict=True)})
    moved = s.select("pair_id", "point_id", *[F.col(f"m{c}").alias(c) for c in "xyz"])
    near = nn_within(moved, target, distance, ["pair_id"]).withColumnRenamed("left_id", "point_id")
    b = target.select("pair_id", F.col("point_id").alias("right_id"), *[F.col(c).alias(f"b{c}") for c in (*"xyz", *COVS)])
    best = near.join(s.drop("mx", "my", "mz"), ["pair_id", "point_id"]).join(b, ["pair_id", "right_id"])
    return weighed(best)


CELL = ("__cx", "__cy", "__cz")


def resident(points: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """points as a table in the shared folder that is bucketed by keys, one sorted file a bucket: joins on all of keys
    leave it where it is. As many buckets as shuffles have partitions, so the other side comes to it. discard() it."""
    spark = points.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"lidarloom_{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/{table}"
    points.repartition(n, *keys).write.format("parquet").option("path", path).bucketBy(n, *keys).sortBy(*keys).saveAsTable(table)
    return spark.table(table).withMetadata(keys[0], {"table": table, "path": path})


def discard(*tables: DataFrame) -> None:
    """Drops tables of resident() and deletes their files."""
    for df in tables:
        spark, at = df.sparkSession, next(f.metadata for f in df.schema if "table" in f.metadata)
        spark.sql(f"DROP TABLE IF EXISTS {at['table']}")
        p = spark._jvm.org.apache.hadoop.fs.Path(at["path"])
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def resident_target(target: DataFrame, distance: float) -> DataFrame:
    """target with its covariances, by pair and cell of the search distance."""
    at = [cell(F.col(c), distance).alias(k) for c, k in zip("xyz", CELL, strict=True)]
    return resident(target.select("pair_id", *at, F.col("point_id").alias("right_id"), *[F.col(c).alias(f"b{c}") for c in (*"xyz", *COVS)]), ["pair_id", *CELL], "target")


def resident_source(source: DataFrame) -> DataFrame:
    return resident(source.select("pair_id", "point_id", *"xyz", *COVS), ["pair_id", "point_id"], "source")


def matches_in_place(source: DataFrame, target: DataFrame, state: DataFrame, distance: float) -> DataFrame:
    """The rows of correspondences(), with tables of resident_source() and resident_target(): only the source's moved
    places travel to the target's cells, and each point's nearest match, covariance and all, back to its point."""
    s = source.join(state.select("pair_id", "r", "t"), "pair_id")
    moved = dict(zip("xyz", G.se3_apply(G.items(F.col("r"), 9), G.items(F.col("t"), 3), G.vec("x", "y", "z")), strict=True))
    shifts = F.explode(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip("xyz", x, strict=True)]) for x in AROUND])).alias("__s")
    sent = s.select("pair_id", "point_id", *[v.alias(f"m{c}") for c, v in moved.items()]).select("*", shifts)
    sent = sent.withColumns({k: cell(F.col(f"m{c}"), distance) + F.col(f"__s.{c}") for c, k in zip("xyz", CELL, strict=True)}).drop("__s")
    met = sent.join(target.hint("merge"), ["pair_id", *CELL])
    d2 = sum(((F.col(f"m{c}") - F.col(f"b{c}")) * (F.col(f"m{c}") - F.col(f"b{c}")) for c in "yz"), (F.col("mx") - F.col("bx")) * (F.col("mx") - F.col("bx")))
    met = met.select("pair_id", "point_id", d2.alias("d2"), "right_id", *[f"b{c}" for c in (*"xyz", *COVS)]).filter(F.col("d2") < distance * distance)
    best = met.groupBy("pair_id", "point_id").agg(F.min(F.struct("d2", "right_id", *[f"b{c}" for c in (*"xyz", *COVS)])).alias("m")).select("pair_id", "point_id", "m.*")
    return weighed(best.join(s.hint("merge"), ["pair_id", "point_id"]))


def weighed(best: DataFrame) -> DataFrame:
    """Matches of both sides' columns (and r) -> a*, b* and the weights m**."""
    r = G.items(F.col("r"), 9)
    turned = G.sym_rotate(r, G.vec(*COVS))
    weight = G.sym_inverse(G.add(turned, G.vec(*[f"b{c}" for c in COVS])))
    return best.select("pair_id", "point_id", "right_id", "d2", *[F.col(c).alias(f"a{c}") for c in "xyz"], "bx", "by", "bz", *[w.alias(f"m{i}{j}") for w, (i, j) in zip(weight, SYMMETRIC, strict=True)])


def normal_sums() -> list[Column]:
    """The 73 sums and the number of matches, as aggregates over correspondences()."""
    a = (*G.vec("ax", "ay", "az"), F.lit(1.0))
    b = G.vec("bx", "by", "bz")
    m = {ij: F.col(f"m{ij[0]}{ij[1]}") for ij in SYMMETRIC}
    mb = [sum((m[(min(i, j), max(i, j))] * b[j] for j in (1, 2)), m[(0, i)] * b[0]) for i in range(3)]
    out = [F.sum(a[i] * a[j] * m[k]).alias(f"g_{i}{j}_{k[0]}{k[1]}") for i, j in HOMOGENEOUS for k in SYMMETRIC]
    out += [F.sum(a[i] * mb[k]).alias(f"h_{i}_{k}") for i in range(4) for k in range(3)]
    out += [F.sum(G.dot(b, mb)).alias("e_bb"), F.count(F.lit(1)).alias("n_matches")]
    return out


def normal_equations(matches: DataFrame) -> DataFrame:
    """One row a pair: the 73 sums and n_matches (num_correspondences)."""
    return matches.groupBy("pair_id").agg(*normal_sums())


@dataclass
class Sums:
    """A pair's sums as tensors: g[i, j] = sum a_i a_j M, h[i] = sum a_i M b, bb = sum b' M b, with a = (ax, ay, az, 1)."""

    g: np.ndarray
    h: np.ndarray
    bb: float

    @staticmethod
    def of(row: dict) -> Sums:
        g = np.zeros((4, 4, 3, 3))
        for i, j in HOMOGENEOUS:
            for k, m in SYMMETRIC:
                for x, y in {(i, j), (j, i)}:
                    g[x, y, k, m] = g[x, y, m, k] = row[f"g_{i}{j}_{k}{m}"]
        return Sums(g, np.array([[row[f"h_{i}_{k}"] for k in range(3)] for i in range(4)]), row["e_bb"])

    def error(self, theta: np.ndarray) -> float:
        """sum e' M e at [R|t], given as 4 columns of length 3."""
        return float(self.bb - 2 * np.einsum("ik,ik", theta, self.h) + np.einsum("ik,ijkm,jm", theta, self.g, theta))

    def equations(self, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(H, b) of a small turn and shift applied after [R|t]; the Jacobian is [skew(T a), -I]."""
        k = np.stack([cross_matrix(c) for c in theta])
        residual = self.h - np.einsum("ijkm,jm->ik", self.g, theta)  # sum a_i M e
        h = np.zeros((6, 6))
        h[:3, :3] = np.einsum("ikp,ijkm,jmq->pq", k, self.g, k)
        h[:3, 3:] = -np.einsum("ikp,ikm->pm", k, self.g[:, 3])
        h[3:, :3] = h[:3, 3:].T
        h[3:, 3:] = self.g[3, 3]
        return h, np.concatenate([np.einsum("ikp,ik->p", k, residual), -residual[3]])


def cross_matrix(v: np.ndarray) -> np.ndarray:
    return np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])


def rotation(w: np.ndarray) -> np.ndarray:
    t = float(np.linalg.norm(w))
    k = cross_matrix(w)
    if t < 1e-5:
        return np.eye(3) + k + k @ k / 2
    return np.eye(3) + np.sin(t) / t * k + (1 - np.cos(t)) / t**2 * k @ k


def is_small(turn: np.ndarray, shift: np.ndarray, rot_eps: float, trans_eps: float) -> bool:
    """The convergence test: no entry of the step moves more than its tolerance."""
    return max(float(np.abs(turn - np.eye(3)).max()) / rot_eps, float(np.abs(shift).max()) / trans_eps) < 1


def step(sums: Sums, r: np.ndarray, t: np.ndarray, damping: float, p: Params, optimizer: str = "LM"):
    """One outer iteration's solve -> (r, t, damping, moved, converged, error at entry, H)."""

    def columns(r, t):
        return np.vstack([r.T, t])

    h, b = sums.equations(columns(r, t))
    start = sums.error(columns(r, t))
    if optimizer == "GN":
        d = np.linalg.lstsq(h, -b, rcond=None)[0]
        turn, shift = rotation(d[:3]), d[3:]
        return turn @ r, turn @ t + shift, damping, True, is_small(turn, shift, p.rot_eps, p.trans_eps), start, h
    if damping < 0:
        damping = p.init_lambda * float(np.abs(np.diag(h)).max())
    grow = 2.0
    for _ in range(p.inner_iterations):
        d = np.linalg.lstsq(h + damping * np.eye(6), -b, rcond=None)[0]
        turn, shift = rotation(d[:3]), d[3:]
        tr, tt = turn @ r, turn @ t + shift
        expected = float(d @ (damping * d - b))
        gain = (start - sums.error(columns(tr, tt))) / expected if expected else -1.0
        small = is_small(turn, shift, p.rot_eps, p.trans_eps)
        if gain < 0:
            if small:
                return r, t, damping, True, True, start, h
            damping, grow = damping * grow, grow * 2
            continue
        return tr, tt, damping * max(1 / 3, 1 - (2 * gain - 1) ** 3), True, small, start, h
    return r, t, damping, False, False, start, h


STATE = "pair_id {kind}, r array<double>, t array<double>, damping double, iterations int, converged boolean, stalled boolean, error double, n_matches long, hessian array<double>"


def start_state(source: DataFrame, guess: DataFrame | None, kind: str) -> DataFrame:
    """One row a pair, at the guess (pair_id, r, t) or the identity."""
    pairs = source.select("pair_id").distinct()
    eye, zero = F.array(*map(F.lit, EYE)), F.array(*[F.lit(0.0)] * 3)
    if guess is None:
        pairs = pairs.withColumns({"r": eye, "t": zero})
    else:
        pairs = pairs.join(guess.select("pair_id", "r", "t"), "pair_id", "left").withColumns({"r": F.coalesce("r", eye), "t": F.coalesce("t", zero)})
    return pairs.select("pair_id", "r", "t", F.lit(-1.0).alias("damping"), F.lit(0).alias("iterations"), F.lit(False).alias("converged"), F.lit(False).alias("stalled"), F.lit(0.0).alias("error"), F.lit(0).cast("long").alias("n_matches"), F.array().cast("array<double>").alias("hessian"))


def register(source: DataFrame, target: DataFrame, guess: DataFrame | None = None, params: Params | None = None, distance: float | None = None, optimizer: str = "LM") -> DataFrame:
    """T that brings each pair's source to its target: pair_id, r, t, and per pair error, hessian (36), iterations,
    converged and n_matches.

    source and target: pair_id, point_id, x, y, z, cxx..czz. Coordinates are centred on each pair's target while it
    runs. Both sides are laid out once, the target by cell with its covariances, and stay where they are: an iteration
    moves the source's places and their matches only. Every outer iteration handles all pairs that have not converged;
    the state table is written to the shared folder each time, so lineage stays short and a lost executor costs one
    iteration. optimizer: LM or GN.
    """
    p = params or Params()
    distance = p.max_corr_dist if distance is None else distance
    kind = dict(source.dtypes)["pair_id"]
    centre = stored(target.groupBy("pair_id").agg(*[F.avg(c).alias(f"__{c}") for c in "xyz"]))
    shift = lambda df: df.join(centre, "pair_id").withColumns({c: F.col(c) - F.col(f"__{c}") for c in "xyz"}).drop("__x", "__y", "__z")
    src = resident_source(shift(source.select("pair_id", "point_id", *"xyz", *COVS)))
    tgt = resident_target(shift(target.select("pair_id", "point_id", *"xyz", *COVS)), distance)
    state = start_state(source, guess, kind)
    c = G.vec("__x", "__y", "__z")
    # x -> R x + t becomes, in coordinates less c, x -> R x + (t + R c - c)
    state = state.join(centre, "pair_id").withColumn("t", F.array(*G.sub(G.se3_apply(G.items(F.col("r"), 9), G.items(F.col("t"), 3), c), c))).drop("__x", "__y", "__z")
    state = stored(state)

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                r, t = np.array(row["r"]).reshape(3, 3), np.array(row["t"])
                if pd.isna(row["n"]) or row["n"] < 6:  # nothing to solve for
                    out.append((row["pair_id"], row["r"], row["t"], row["damping"], row["iterations"], False, True, row["error"], 0, row["hessian"]))
                    continue
                r, t, damping, moved, done, error, h = step(Sums.of(row), r, t, row["damping"], p, optimizer)
                out.append((row["pair_id"], r.ravel().tolist(), t.tolist(), damping, row["iterations"] + 1, done, not moved, error, int(row["n"]), h.ravel().tolist()))
            yield pd.DataFrame(out, columns=["pair_id", "r", "t", "damping", "iterations", "converged", "stalled", "error", "n_matches", "hessian"])

    settled = None
    for _ in range(p.max_iterations):
        sums = normal_equations(matches_in_place(src, tgt, state, distance)).withColumnRenamed("n_matches", "n")
        moved = stored(state.join(sums, "pair_id", "left").mapInPandas(solve, STATE.format(kind=kind)))
        ended = moved.filter("converged or stalled")
        settled = ended if settled is None else settled.unionByName(ended)
        state = moved.filter("not converged and not stalled")
        if not state.limit(1).count():
            break
    discard(src, tgt)
    done = settled.unionByName(state).join(centre, "pair_id")
    back = G.add(G.sub(G.items(F.col("t"), 3), G.mat_vec(G.items(F.col("r"), 9), c)), c)
    return done.withColumn("t", F.array(*back)).drop("__x", "__y", "__z", "damping", "stalled")


def registration_error(source: DataFrame, target: DataFrame, state: DataFrame, distance: float) -> DataFrame:
    """pair_id, error, n_matches at given transforms: the sum of weighted squared residuals over fresh matches."""
    return error_of(correspondences(source, target, state, distance), state)


def error_of(matches: DataFrame, state: DataFrame) -> DataFrame:
    """The same over matches that are there already."""
    m = matches.join(state.select("pair_id", "r", "t"), "pair_id")
    e = G.sub(G.vec("bx", "by", "bz"), G.se3_apply(G.items(F.col("r"), 9), G.items(F.col("t"), 3), G.vec("ax", "ay", "az")))
    weight = G.sym_to_mat(G.vec(*[f"m{i}{j}" for i, j in SYMMETRIC]))
    return m.groupBy("pair_id").agg(F.sum(G.dot(e, G.mat_vec(weight, e))).alias("error"), F.count(F.lit(1)).alias("n_matches"))


def swap(source: DataFrame, target: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pair the other way round; covariances go with their points."""
    return target, source


def with_covariances(points: DataFrame, covariances: DataFrame | None, compute, on: Sequence[str] = ("pair_id",)) -> DataFrame:
    """points with given covariances, or, where there are none, with those that compute(points) makes."""
    covs = compute(points) if covariances is None else covariances
    return points.join(covs.select(*on, "point_id", *COVS), [*on, "point_id"])
