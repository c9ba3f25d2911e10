"""k nearest neighbours in any number of dimensions: a join over Voronoi cells, pruned by the triangle inequality."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

Metric = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _l2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a[:, None, :] - b[None, :, :]) ** 2).sum(-1)


def _l1(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.abs(a[:, None, :] - b[None, :, :]).sum(-1)


def _so2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.abs((b[None, :, -1] - a[:, None, -1] + np.pi) % (2 * np.pi) - np.pi)


#: Distances of all of some vectors to all of others; and what makes a metric of each, for which the triangle inequality
#: holds. A function of the caller's own has none, so nothing is pruned.
DISTANCES: dict[str, Metric] = {"l2": _l2, "l1": _l1, "so2": _so2}
METRIC: dict[str, Callable[[np.ndarray], np.ndarray]] = {"l2": np.sqrt, "l1": lambda d: d, "so2": lambda d: d}
#: Cells at most; numbers that a step holds at once; share by which bounds are widened against rounding.
CELLS, HELD, SLACK = 512, 1 << 22, 1e-9


def in_steps(distance: Metric, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """distance(a, b) with at most HELD numbers held on the way."""
    step = max(1, HELD // max(1, b.size))
    return np.concatenate([distance(a[i : i + step], b) for i in range(0, len(a), step)]) if len(a) else np.zeros((0, len(b)))


def candidates(distance: Metric, a: np.ndarray, b: np.ndarray, k: int, bound: np.ndarray):
    """(rows of a, rows of b, distances), at most so many pairs held at once, that hold each a's k nearest of b with all as
    near as the k-th, less those farther than its bound.

    Squared distances are first worked out by products of matrices; whatever may be among the k nearest for all that
    rounding can do is then worked out as distance() does.
    """
    for some in np.array_split(np.arange(len(a)), len(a) * len(b) // (HELD // 4) + 1 if distance is _l2 else a.size * len(b) // HELD + 1):
        if not len(some):
            continue
        q, exact, slack = a[some], distance is not _l2, 0.0
        if not exact:
            qq, bb = (q**2).sum(1), (b**2).sum(1)
            d = qq[:, None] + bb[None, :] - 2 * (q @ b.T)
            slack = (qq + bb.max())[:, None] * 4 * np.finfo(float).eps * (q.shape[1] + 8)
            exact = not np.isfinite(d).all()
        if exact:
            d, slack = in_steps(distance, q, b), 0.0
        most = np.full((len(q), 1), np.inf) if len(b) <= k else np.partition(d, k - 1, axis=1)[:, k - 1 : k] + slack
        r, c = np.nonzero(~(d > np.minimum(most, bound[some][:, None]) + slack))
        step = max(1, HELD // max(1, b.shape[1]))
        near = d[r, c] if exact else np.concatenate([((q[r[i : i + step]] - b[c[i : i + step]]) ** 2).sum(-1) for i in range(0, len(r), step)] or [np.zeros(0)])
        keep = ~(near > bound[some][r])
        yield some[r[keep]], c[keep], near[keep]


def in_runs(pivots: np.ndarray, apart: np.ndarray, size: np.ndarray, most: int) -> np.ndarray:
    """A number for each cell, the same for cells that lie one after the other on a path from each to its nearest not yet
    passed, up to `most` rows together."""
    path, left = [0], np.ones(len(pivots), dtype=bool)
    left[0] = False
    while left.any():
        path.append(int(np.where(left, apart[path[-1]], np.inf).argmin()))
        left[path[-1]] = False
    of, n, rows = np.zeros(len(pivots), np.int64), 0, 0
    for c in path:
        if rows and rows + size[c] > most:
            n, rows = n + 1, 0
        of[c] = n
        rows += size[c]
    return of


def knn_nd(left: DataFrame, right: DataFrame, k: int, vector: str = "embedding", point: str = "point_id", metric: str | Metric = "l2", chunk: int | None = None, block: int | None = None, cells: int | None = None, counted: bool = False) -> DataFrame:
    """Exact k nearest right vectors of each left vector: left_id, right_id, d, rank; ties to the smaller right id.
    metric: a name, or a function of some vectors (rows) and others that gives a row for each of the first.

    Right vectors belong to the nearest of `cells` pivots (a bounded sample, by hash of the id). A left vector first
    meets its own pivot's cell; what it finds, or what cells' sizes and radii say already, bounds its k-th distance.
    Then it meets those other cells only that the triangle inequality lets have something as near: a cell of radius r
    whose pivot is at D holds nothing nearer than D - r, nor than half of D less the distance to the own pivot. Cells lie
    in bins of neighbouring ones, to which a left vector is sent once with the names of those that it looks into. A group
    of work is a part of a bin (`block` rows) and a chunk of the left rows that look into it; both are by default an
    eighth of the right rows, but 2048 at least and no more than HELD numbers, so a vector is sent to eight groups, or to
    as many as the table has such blocks. Fewer than k right rows: all of them. Rows with null ids or vectors take no
    part. counted: one row instead, pairs: how many were compared.
    """
    distance = DISTANCES[metric] if isinstance(metric, str) else metric
    proper = METRIC.get(metric) if isinstance(metric, str) else None
    form = "array<float>" if {dict(df.dtypes)[vector] for df in (left, right)} == {"array<float>"} else "array<double>"
    v = F.col(vector).cast(form).alias("v")
    of = lambda df: df.select(F.col(point).alias("id"), v).filter(F.col("id").isNotNull() & F.col("v").isNotNull())
    spark, kind = left.sparkSession, dict(left.dtypes)[point]
    schema = f"left_id {kind}, right_id {kind}, d double"
    n_right = of(right).count()
    wanted = cells or (min(CELLS, max(1, int((n_right / 4) ** 0.5))) if proper else 1)
    sample = of(right).orderBy(F.xxhash64("id"), "id").limit(4 * wanted).select("v").collect()
    pivots = np.array(list(dict.fromkeys(tuple(r["v"]) for r in sample))[:wanted], dtype=float)
    if not len(pivots):
        return spark.createDataFrame([], f"{schema}, rank int")
    share = int(max(1, min(max(2048, -(-n_right // 8)), HELD // max(1, pivots.shape[1]))))
    chunk, block = chunk or share, block or share
    near = lambda x: in_steps(distance, x, pivots)
    dense = lambda pdf: np.stack(pdf["v"].to_list()).astype(float)

    def home(batches):
        for pdf in batches:
            if len(pdf):
                d = near(dense(pdf))
                own = d.argmin(1)
                yield pdf.assign(cell=own, r=d[np.arange(len(pdf)), own])

    b = stored(of(right).mapInPandas(home, f"id {kind}, v {form}, cell long, r double"))
    size, radius = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
    for r in b.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("r").alias("r")).collect():  # a row a cell
        size[r["cell"]], radius[r["cell"]] = r["n"], r["r"]
    own_metric = proper or (lambda d: d)
    radius = own_metric(radius)
    bin_of = in_runs(pivots, near(pivots), size, block)
    members = [np.flatnonzero(bin_of == i) for i in range(int(bin_of.max()) + 1)]
    held = np.bincount(bin_of, weights=size).astype(np.int64)

    def looks(first: bool):
        """Cells that each left row looks into, by bin: the nearest that has rows, or the others that its bound lets in."""

        def run(batches):
            for pdf in batches:
                if not len(pdf):
                    continue
                d = np.where(size > 0, own_metric(near(dense(pdf))), np.inf)
                own = d.argmin(1)
                if proper is None:
                    goes = np.tile(size > 0, (len(pdf), 1))
                elif first:
                    goes = np.zeros(d.shape, dtype=bool)
                    goes[np.arange(len(d)), own] = True
                else:
                    reach = np.where(size > 0, d + radius, np.inf)
                    order = np.argsort(reach, axis=1)
                    enough = (np.cumsum(size[order], axis=1) >= k).argmax(1)
                    bound = np.take_along_axis(reach, order, 1)[np.arange(len(d)), enough] if size.sum() >= k else np.full(len(d), np.inf)
                    bound = np.minimum(bound, own_metric(pdf["kth"].to_numpy())) * (1 + SLACK)
                    low = np.maximum(d - radius, (d - d.min(1, keepdims=True)) / 2) * (1 - SLACK)
                    goes = (low <= bound[:, None]) & (size > 0)
                    goes[np.arange(len(d)), own] = False
                to, cells_in = [[] for _ in pdf.index], [[] for _ in pdf.index]
                for i, these in enumerate(members):
                    some = goes[:, these]
                    for row, mask in zip(np.flatnonzero(some.any(1)).tolist(), np.packbits(some[some.any(1)], axis=1), strict=True):
                        to[row].append(i)
                        cells_in[row].append(mask.tobytes())
                yield pdf[["id", "v", "kth"]].assign(to=to, cells=cells_in, n=goes @ size)

        return run

    def met(asks: DataFrame) -> DataFrame:
        asks = stored(asks)
        compared.append(asks.select("n"))
        load = np.zeros(len(members), np.int64)
        for r in asks.select(F.explode("to").alias("c")).groupBy("c").count().collect():  # a row a bin
            load[r["c"]] = r["count"]
        lit = lambda x: F.array(*[F.lit(int(n)) for n in np.maximum(1, x)])
        parts, chunks = lit(-(-held // block)), lit(-(-load // chunk))
        every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        at = lambda counts: F.get(counts, F.col("bin").cast("int"))
        x = asks.select("id", "v", "kth", F.explode(F.arrays_zip("to", "cells")).alias("z")).select("id", "v", "kth", F.col("z.to").alias("bin"), F.col("z.cells").alias("cells"))
        x = x.withColumn("i", F.pmod(F.xxhash64("id"), at(chunks)).cast("int")).withColumn("j", every(at(parts)))
        y = b.select("id", "v", "cell", F.get(F.array(*[F.lit(int(n)) for n in bin_of]), F.col("cell").cast("int")).alias("bin"))
        y = y.withColumn("j", F.pmod(F.xxhash64("id", F.lit(1)), at(parts)).cast("int")).withColumn("i", every(at(chunks)))

        def search(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
            rows = [pd.DataFrame({"left_id": x["id"][:0], "right_id": y["id"][:0], "d": np.zeros(0)})]
            if len(x) and len(y):
                y = y.sort_values("id", kind="stable")
                own, ids, queries, vectors, cell = x["id"].to_numpy(), y["id"].to_numpy(), dense(x), dense(y), y["cell"].to_numpy()
                these = members[int(x["bin"].iloc[0])]
                asked = np.unpackbits(np.stack([np.frombuffer(m, np.uint8) for m in x["cells"]]), axis=1, count=len(these)).astype(bool)
                bound = x["kth"].to_numpy(float).copy()
                best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
                for n, c in enumerate(these.tolist()):
                    who, what = np.flatnonzero(asked[:, n]), np.flatnonzero(cell == c)
                    if not len(who) or not len(what):
                        continue
                    found = [(who[r], what[s], d) for r, s, d in candidates(distance, queries[who], vectors[what], k, bound[who])]
                    r, s, d = (np.concatenate(z) for z in zip(best, *found, strict=True))
                    order = np.lexsort((s, d, r))  # right rows are in order of id
                    r, s, d = r[order], s[order], d[order]
                    place = np.arange(len(r)) - np.searchsorted(r, r)
                    full = place == k - 1
                    bound[r[full]] = np.fmin(bound[r[full]], d[full])
                    best = [z[place < k] for z in (r, s, d)]
                rows.append(pd.DataFrame({"left_id": own[best[0]], "right_id": ids[best[1]], "d": best[2]}))
            return rows[-1]

        keys = ["bin", "i", "j"]
        return x.groupBy(*keys).cogroup(y.groupBy(*keys)).applyInPandas(search, schema)

    compared: list[DataFrame] = []
    w = Window.partitionBy("left_id").orderBy("d", "right_id")
    asked = f"id {kind}, v {form}, kth double, to array<int>, cells array<binary>, n long"
    best = lambda df: df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    found = stored(best(met(of(left).withColumn("kth", F.lit(float("inf"))).mapInPandas(looks(True), asked))))
    if proper:
        kth = found.filter(F.col("rank") == k).select(F.col("left_id").alias("id"), F.col("d").alias("kth"))
        rest = of(left).join(kth, "id", "left").withColumn("kth", F.coalesce("kth", F.lit(float("inf"))))
        found = best(found.drop("rank").unionByName(met(rest.mapInPandas(looks(False), asked))))
    if counted:
        pairs = compared[0]
        for more in compared[1:]:
            pairs = pairs.unionByName(more)
        return pairs.agg(F.sum("n").alias("pairs"))
    return found
