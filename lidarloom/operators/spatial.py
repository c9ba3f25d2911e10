"""Neighbours in three dimensions by grids, and points on disk by Morton key. For any number of dimensions: vectors."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..session import stored
from .points import cell
from .vectors import DISTANCES, knn_nd  # noqa: F401

#: The 27 cells around and with a cell.
AROUND = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]
PAIR = ("left_id", "right_id", "d2")


#: Columns that hold a place, unless the caller names others.
PLACES = ("x", "y", "z")


def placed(places: Sequence[str], *sides: DataFrame) -> list[DataFrame]:
    """Tables whose places are in the columns named, with x, y, z instead; columns of those names that are none go."""
    if tuple(places) == PLACES:
        return list(sides)
    return [df.select(*[F.col(c) for c in df.columns if c not in (*places, *PLACES)], *[F.col(c).alias(n) for c, n in zip(places, PLACES, strict=True)]) for df in sides]


def _celled(df: DataFrame, on: Sequence[str], point: str, size: float, name: str, also: Sequence[str]) -> DataFrame:
    at = [cell(F.col(c), size).alias(f"__c{c}") for c in "xyz"]
    return df.select(*on, F.col(point).alias(name), *[F.col(c).alias(f"__{name}_{c}") for c in ("x", "y", "z", *also)], *at)


def grid_pairs(left: DataFrame, right: DataFrame, on: Sequence[str], size: float, point: str = "point_id", offsets: bool = False, before: str | None = None, spread: str = "left") -> DataFrame:
    """Pairs in neighbouring cells of one key, with d2: all pairs no farther apart than size, and some that are.
    offsets: also dx, dy, dz from left to right. before: a column that must be smaller on the right.

    The side named by `spread`, which should be the smaller one, goes to its 27 cells, so the other is shuffled once; the
    join is an equality on key and cell, which AQE splits where a cell is dense. Only ids and places are sent to the
    cells.
    """
    also = [before] if before else []
    shifts = F.explode(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip("xyz", s, strict=True)]) for s in AROUND]))
    around = lambda df: df.withColumn("__s", shifts).withColumns({f"__c{c}": F.col(f"__c{c}") + F.col(f"__s.{c}") for c in "xyz"}).drop("__s")
    a, b = _celled(left, on, point, size, "left_id", also), _celled(right, on, point, size, "right_id", also)
    a, b = (around(a), b) if spread == "left" else (a, around(b))
    d = [F.col(f"__left_id_{c}") - F.col(f"__right_id_{c}") for c in "xyz"]
    pairs = a.join(b, [*on, "__cx", "__cy", "__cz"])
    if before:
        pairs = pairs.filter(F.col(f"__right_id_{before}") < F.col(f"__left_id_{before}"))
    more = [(-v).alias(f"d{c}") for c, v in zip("xyz", d, strict=True)] if offsets else []
    return pairs.select(*on, *PAIR[:2], (d[0] * d[0] + d[1] * d[1] + d[2] * d[2]).alias("d2"), *more)


#: Numbers that a step over pairs holds at once.
STEP = 1 << 18


def cells_of(places: np.ndarray, size: float) -> np.ndarray:
    """As points.cell(); places that are no number count as zero there too."""
    return np.nan_to_num(np.floor(places / size), nan=0.0, posinf=2.0**63, neginf=-(2.0**63))


class Grid:
    """Places by cell of space, so that those in the 27 cells around a cell are nine runs of the sorted cells."""

    def __init__(self, places: np.ndarray, size: float) -> None:
        self.size = size
        cells = cells_of(places, size)
        self.low = cells.min(0) - 1
        self.wide = cells.max(0) - self.low + 3  # a column on either side, so that runs never go on in the next row
        if float(np.prod(self.wide)) >= 2.0**62:  # too far apart for one number a cell: one cell for all
            self.low, self.wide = None, None
            return
        keys = self.key(cells)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def key(self, cells: np.ndarray) -> np.ndarray:
        at = (cells - self.low).astype(np.int64)
        wide = self.wide.astype(np.int64)
        return (at[..., 0] * wide[1] + at[..., 1]) * wide[2] + at[..., 2]

    def around(self, cell: np.ndarray) -> np.ndarray:
        """Rows in the 27 cells, in order."""
        rows = [np.zeros(0, dtype=np.int64)]
        for i in (-1, 0, 1):
            for j in (-1, 0, 1):
                at = cell + (i, j, 0)
                if ((at[:2] >= self.low[:2]) & (at[:2] < self.low[:2] + self.wide[:2])).all() and self.low[2] <= at[2] < self.low[2] + self.wide[2]:
                    k = self.key(at)
                    rows.append(self.order[slice(*np.searchsorted(self.keys, [k - 1, k + 2]))])
        return np.sort(np.concatenate(rows))


def meetings(left: np.ndarray, right: np.ndarray, size: float):
    """(rows of left, rows of right): the left places of each cell in small steps, with all right places in the 27 cells
    around."""
    grid = Grid(right, size)
    cells = cells_of(left, size)
    found, of = np.unique(cells, axis=0, return_inverse=True)
    order = np.argsort(of.ravel(), kind="stable")
    ends = np.cumsum(np.bincount(of.ravel(), minlength=len(found)))
    for cell_, rows in zip(found, np.split(order, ends[:-1]), strict=True):
        if grid.low is not None:
            others = grid.around(cell_)
        else:
            others = np.flatnonzero((np.abs(cells_of(right, size) - cell_) <= 1).all(1))
        if len(others):
            for some in np.array_split(rows, len(rows) * len(others) // STEP + 1):
                if len(some):
                    yield some, others


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all places a to all places b, added in the order in which Spark and the SQL add."""
    d = [a[:, None, i] - b[None, :, i] for i in range(3)]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def in_cells(left: DataFrame, right: DataFrame, on: Sequence[str], size: float, search: Callable[[pd.DataFrame, np.ndarray, pd.DataFrame, np.ndarray], pd.DataFrame], schema: str, point: str = "point_id", wide: int = 4, chunk: int = 1 << 14, block: int = 1 << 16) -> DataFrame:
    """What search() gives for left points and the right points in the cells around theirs: frames of both (id and
    places, right ones in order of id; for left ones also parts: how many blocks they meet) with their places as arrays.
    schema: of search()'s rows, which get the columns of `on` in front. No pair leaves its group, so pairs are never shuffled or sorted.

    A group is a block of `wide` cells of `size` each way: its left points meet all right points in it and in the cells
    next to it, so a right point goes to few groups (on average (1 + 2 / wide) ^ 3). Where many points crowd, groups are
    cut into chunks of left and blocks of right points, each two of which meet; a left point then has a row of search()
    for every block, which the caller merges.
    """
    kinds = dict(left.dtypes)

    def celled(df: DataFrame) -> DataFrame:
        d = df.select(*[F.col(c).alias(n) for c, n in [*zip(on, on), (point, "id"), *zip("xyz", "xyz")]]).withColumns({f"__c{c}": cell(F.col(c), size) for c in "xyz"})
        for c in (*on, "__cx", "__cy", "__cz"):
            d = d.filter(F.col(c).isNotNull())
        return d

    keys = [*on, "__kx", "__ky", "__kz"]
    a, b = celled(left), celled(right)
    for c in "xyz":
        at = F.pmod(F.col(f"__c{c}"), F.lit(wide))
        k = F.col(f"__c{c}") - at
        a = a.withColumn(f"__k{c}", k)
        b = b.withColumn(f"__k{c}", F.explode(F.array_compact(F.array(k, F.when(at == 0, k - wide), F.when(at == wide - 1, k + wide)))))
    a, b = (d.drop("__cx", "__cy", "__cz") for d in (a, b))
    n = lambda d, name: d.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    sizes = stored(n(a, "__a").join(n(b, "__b"), keys))
    parts = lambda name, most: F.ceil(F.col(name) / most).cast("int")
    dealt = lambda of, every: {of[0]: F.pmod(F.xxhash64("id"), of[1]).cast("int"), every[0]: F.explode(F.sequence(F.lit(0), every[1] - 1))}
    i, j = ("__i", parts("__a", chunk)), ("__j", parts("__b", block))
    x, y = a.join(sizes, keys).withColumns({**dealt(i, j), "parts": j[1]}).drop("__a", "__b"), b.join(sizes, keys).withColumns(dealt(j, i)).drop("__a", "__b")
    out = ", ".join(f"`{c}` {kinds[c]}" for c in on) + f", {schema}"
    names = [f.split()[0] for f in schema.split(",")]

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({c: [] for c in (*on, *names)}, dtype=object)
        y = y.sort_values("id", kind="stable")
        found = search(x, x[list("xyz")].to_numpy(float), y, y[list("xyz")].to_numpy(float))
        return found.assign(**{c: x[c].iloc[0] for c in on})[[*on, *names]]

    by = [*keys, "__i", "__j"]
    return x.groupBy(*by).cogroup(y.groupBy(*by)).applyInPandas(run, out)


def nearest_of(pairs: DataFrame, on: Sequence[str], k: int, ties: bool = False) -> DataFrame:
    """The k nearest of each left row, ties to the smaller right id, with their rank. ties: all as near as the k-th."""
    w = Window.partitionBy(*on, "left_id")
    rank = F.rank().over(w.orderBy("d2")) if ties else F.row_number().over(w.orderBy("d2", "right_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k)


def cell_size(reach: DataFrame, k: int) -> float:
    """A cell as large as the k-th neighbour is far in a typical key: the median, over keys, of what an even spread of
    the key's points over its extent would give. reach: n and the extents __x, __y, __z of each key."""
    wide = [F.col(f"__{c}") for c in "xyz"]
    flat = sum(((w > 1e-9).cast("int") for w in wide[1:]), (wide[0] > 1e-9).cast("int"))
    volume = wide[0] * 0 + 1.0
    for w in wide:
        volume = volume * F.when(w > 1e-9, w).otherwise(1.0)
    size = 0.8 * F.pow(F.lit(float(k)) * volume / F.col("n"), 1.0 / F.greatest(flat, F.lit(1)))
    found = reach.filter(F.col("n") > 0).agg(F.percentile_approx(size, 0.5).alias("m")).first()["m"]
    return float(found) if found else 1.0


def knn_join(left: DataFrame, right: DataFrame, k: int, on: Sequence[str] = ("drive_id", "scan_id"), size: float | None = None, point: str = "point_id", max_rounds: int = 60, offsets: bool = False, ties: bool = False, before: str | None = None, eps: float = 0.0, places: Sequence[str] = PLACES) -> DataFrame:
    """Exact k nearest right points of each left point of the same key: on, left_id, right_id, d2, rank. A self-join
    finds each point itself at distance 0. Fewer than k points: all of them. ties: also all that are as near as the
    k-th. offsets: also dx, dy, dz. before: a column that must be smaller on the right, such as a stamp.

    A grid of cell size finds every neighbour within size (by default measured from the density). A left point is
    settled once its k-th neighbour is that near, or cells reach over all that its key holds; the others look again
    with twice the size. eps: a point is settled already if its k-th neighbour is within (1 + eps) times the size, since
    whatever it has not met is farther than the size; so each of its neighbours is at most (1 + eps) times as far as the
    true one of that rank. places: the columns that hold a place.
    """
    left, right = placed(places, left, right)
    both = left.select(*on, *"xyz", F.lit(0).alias("r")).unionByName(right.select(*on, *"xyz", F.lit(1).alias("r")))
    reach = stored(both.groupBy(*on).agg(*[(F.max(c) - F.min(c)).alias(f"__{c}") for c in "xyz"], F.sum("r").alias("n"), F.count(F.lit(1)).alias("__all")))
    todo, out, h = left.select(*on, point, *"xyz", *([before] if before else [])), None, float(size or cell_size(reach, k))
    mine = Window.partitionBy(*on, "left_id")
    n = reach.agg(F.sum("n").alias("right"), F.sum(F.col("__all") - F.col("n")).alias("left")).first()
    n_right, n_todo = n["right"] or 0, n["left"] or 0
    for _ in range(max_rounds):
        near = nearest_of(grid_pairs(todo, right, on, h, point, offsets, before, "right" if n_right < n_todo else "left"), on, k, ties)
        near = near.withColumn("__ok", (F.count(F.lit(1)).over(mine) >= k) & (F.max("d2").over(mine) <= (h * (1 + eps)) ** 2))
        if ties:
            near = near.withColumn("__one", F.row_number().over(mine.orderBy("d2", "right_id")) == 1)
        found = stored(near)
        if found.filter(F.col("__ok") & (F.col("__one") if ties else F.col("rank") == 1)).count() == n_todo:
            done = found.drop("__ok", "__one")
            return done if out is None else out.unionByName(done)
        last = found.filter("__ok").select(*on, F.col("left_id").alias(point)).distinct()
        all_seen = reach.filter(F.greatest("__x", "__y", "__z") <= h).select(*on)
        open_ = stored(todo.join(last, [*on, point], "left_anti").join(all_seen, list(on), "left_anti"))
        n_todo = open_.count()
        done = found.filter("__ok").unionByName(found.filter("not __ok").join(all_seen, list(on), "left_semi")).drop("__ok", "__one")
        out = done if out is None else out.unionByName(done)
        if not n_todo:
            return out
        todo, h = open_, 2 * h
    raise RuntimeError(f"neighbours not settled with cells of {h}")


def radius_join(left: DataFrame, right: DataFrame, r2: float, on: Sequence[str] = ("drive_id", "scan_id"), point: str = "point_id", offsets: bool = False, places: Sequence[str] = PLACES) -> DataFrame:
    """All pairs of one key with a squared distance below r2. places: the columns that hold a place."""
    left, right = placed(places, left, right)
    return grid_pairs(left, right, on, float(np.sqrt(r2)), point, offsets).filter(F.col("d2") < r2)


def sorted_radius(pairs: DataFrame, on: Sequence[str] = ("drive_id", "scan_id")) -> DataFrame:
    """One row a left point: its matches by distance, nearest first."""
    return pairs.groupBy(*on, "left_id").agg(F.array_sort(F.collect_list(F.struct("d2", "right_id"))).alias("matches"))


def farthest_match(pairs: DataFrame, on: Sequence[str] = ("drive_id", "scan_id")) -> DataFrame:
    return pairs.groupBy(*on, "left_id").agg(F.max(F.struct("d2", "right_id")).alias("m")).select(*on, "left_id", F.col("m.right_id").alias("right_id"), F.col("m.d2").alias("d2"))


def approx_knn_join(left: DataFrame, right: DataFrame, k: int, size: float | None = None, on: Sequence[str] = ("drive_id", "scan_id"), point: str = "point_id", eps: float | None = None) -> DataFrame:
    """k near right points of each left point. With eps: the neighbour of each rank is at most (1 + eps) times as far as
    the true one, by shells of cells that grow until that is certain. Without: the nearest of the 27 cells of `size`
    around each point, in one pass, exact for neighbours within size and without those farther off."""
    if eps is not None:
        return knn_join(left, right, k, on, size, point, eps=eps)
    if size is None:
        raise ValueError("one pass needs the size of a cell")
    kind = dict(left.dtypes)[point]

    def search(x: pd.DataFrame, p: np.ndarray, y: pd.DataFrame, q: np.ndarray) -> pd.DataFrame:
        found = []
        for rows, others in meetings(p, q, size):
            d = squared(p[rows], q[others])
            if d.shape[1] > k:
                kth = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
                at, of = np.nonzero(~(d > kth))
            else:
                at, of = (v.ravel() for v in np.indices(d.shape))
            order = np.lexsort((of, d[at, of], at))  # right points are in order of id
            at, of = at[order], of[order]
            first = np.arange(len(at)) - np.searchsorted(at, at) < k
            found.append((rows[at[first]], others[of[first]], d[at[first], of[first]]))
        at, of, d = (np.concatenate(v) for v in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pd.DataFrame({"left_id": x["id"].to_numpy()[at], "right_id": y["id"].to_numpy()[of], "d2": d})

    return nearest_of(in_cells(left, right, on, size, search, f"left_id {kind}, right_id {dict(right.dtypes)[point]}, d2 double", point), on, k)


def radius_ends(left: DataFrame, right: DataFrame, r2: float, on: Sequence[str] = ("drive_id", "scan_id"), point: str = "point_id") -> DataFrame:
    """The ends of what sorted_radius() lists, without the list: on, left_id, n (how many right points have a squared
    distance below r2), first_id and first_d2 of the nearest (ties: the smaller id), last_id and last_d2 of the farthest
    (ties: the larger id). Left points without a match have no row. Memory and disk don't grow with the matches."""
    kind, size = dict(right.dtypes)[point], float(np.sqrt(r2)) * (1 + 1e-12)

    def search(x: pd.DataFrame, p: np.ndarray, y: pd.DataFrame, q: np.ndarray) -> pd.DataFrame:
        found = []
        for rows, others in meetings(p, q, size):
            d = squared(p[rows], q[others])
            inside = d < r2
            n = inside.sum(1)
            first = np.where(inside, d, np.inf).argmin(1)  # right points are in order of id
            last = d.shape[1] - 1 - np.where(inside, d, -1.0)[:, ::-1].argmax(1)
            i, hit = np.arange(len(rows)), n > 0
            found.append([v[hit] for v in (rows, n, others[first], d[i, first], others[last], d[i, last])])
        at, n, first, first_d2, last, last_d2 = (np.concatenate(v) for v in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 6
        ids = y["id"].to_numpy()
        return pd.DataFrame({"left_id": x["id"].to_numpy()[at], "n": n, "first_id": ids[first], "first_d2": first_d2, "last_id": ids[last], "last_d2": last_d2})

    parts = in_cells(left, right, on, size, search, f"left_id {dict(left.dtypes)[point]}, n long, first_id {kind}, first_d2 double, last_id {kind}, last_d2 double", point)
    ends = parts.groupBy(*on, "left_id").agg(F.sum("n").alias("n"), F.min(F.struct("first_d2", "first_id")).alias("first"), F.max(F.struct("last_d2", "last_id")).alias("last"))
    return ends.select(*on, "left_id", "n", *[F.col(f"{end}.{end}_{c}").alias(f"{end}_{c}") for end in ("first", "last") for c in ("id", "d2")])


def nn_within(left: DataFrame, right: DataFrame, distance: float, on: Sequence[str], point: str = "point_id", places: Sequence[str] = PLACES) -> DataFrame:
    """The nearest right point closer than distance; left points without one have no row. One pass, exact. places: the
    columns that hold a place."""
    left, right = placed(places, left, right)
    pairs = grid_pairs(left, right, on, distance, point).filter(F.col("d2") < distance * distance)
    return pairs.groupBy(*on, "left_id").agg(F.min(F.struct("d2", "right_id")).alias("m")).select(*on, "left_id", F.col("m.right_id").alias("right_id"), F.col("m.d2").alias("d2"))


def visit_radius(pairs: DataFrame, visitor: Callable[..., list[Column]] | Sequence[Column], on: Sequence[str] = ("drive_id", "scan_id")) -> DataFrame:
    """A radius search with the caller's own aggregates over each left point's matches (columns right_id and d2)."""
    return pairs.groupBy(*on, "left_id").agg(*(visitor() if callable(visitor) else visitor))


def tombstone(points: DataFrame, removed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Points not marked as removed; adding a point again after its mark is the caller's union of later rows."""
    return points.join(removed.select(*keys).distinct(), list(keys), "left_anti")


def add_points(points: DataFrame, more: DataFrame, removed: DataFrame | None = None, keys: Sequence[str] = ("drive_id", "scan_id", "point_id")) -> tuple[DataFrame, DataFrame | None]:
    """(points with more, marks without those of more): what is added again counts as present."""
    marks = None if removed is None else removed.join(more.select(*keys).distinct(), list(keys), "left_anti")
    return points.unionByName(more), marks


def merge_knn(parts: Sequence[DataFrame], k: int, on: Sequence[str] = ("drive_id", "scan_id")) -> DataFrame:
    """kNN results of several searchable sets as one."""
    out = parts[0].drop("rank")
    for p in parts[1:]:
        out = out.unionByName(p.drop("rank"))
    return nearest_of(out, on, k)


def distance_column(metric: str | Callable[[Column, Column], Column], a: Column, b: Column) -> Column:
    """Distance of two arrays by a name of functions.geometry.METRICS, or by the caller's own function of Columns."""
    return (G.METRICS[metric] if isinstance(metric, str) else metric)(a, b)


#: Bits of a cell's number that a Morton key interleaves, so that three fit 63; numbers beyond are held to the edge.
KEY_BITS = 21
EDGE = 1 << (KEY_BITS - 1)


def _spread(c: Column) -> Column:
    """The KEY_BITS low bits of a number, two free places after each."""
    out = c
    for shift in (32, 16, 8, 4, 2):
        mask = sum(1 << (3 * b) for b in range(KEY_BITS)) if shift == 2 else sum(((1 << (shift // 2)) - 1) << (3 * (shift // 2) * g) for g in range(-(-KEY_BITS // (shift // 2))))
        out = out.bitwiseOR(F.shiftleft(out, shift)).bitwiseAND(F.lit(mask & ((1 << 63) - 1)))
    return out


def morton(x: Column, y: Column, z: Column, size: float) -> Column:
    """The cell of a place as one BIGINT that keeps neighbours near: bits of the three cell numbers in turn, x first."""
    held = lambda c: F.least(F.greatest(cell(c, size), F.lit(-EDGE)), F.lit(EDGE - 1)) + EDGE
    return F.shiftleft(_spread(held(x)), 2).bitwiseOR(F.shiftleft(_spread(held(y)), 1)).bitwiseOR(_spread(held(z)))


def morton_ranges(low: Sequence[int], high: Sequence[int], most: int = 64) -> list[tuple[int, int]]:
    """At most `most` ranges of Morton keys that hold every cell from low to high (each of three, both included).

    The cube of all cells is halved in turn along x, y and z; halves outside the box go, those inside it are whole
    ranges. When there are as many as may be, those left that the box cuts are taken whole.
    """
    low, high = ([min(max(v, -EDGE), EDGE - 1) + EDGE for v in side] for side in (low, high))
    done, cut = [], [(0, 3 * KEY_BITS, (0, 0, 0), (2 * EDGE - 1,) * 3)]
    while cut and len(done) + 2 * len(cut) <= most:
        after = []
        for key, bits, a, b in cut:
            axis = (3 * KEY_BITS - bits) % 3
            middle = (a[axis] + b[axis] + 1) // 2
            for half in (0, 1):
                c = tuple(middle if half and i == axis else v for i, v in enumerate(a))
                d = tuple(middle - 1 if not half and i == axis else v for i, v in enumerate(b))
                if any(c[i] > high[i] or d[i] < low[i] for i in range(3)):
                    continue
                part = (key | half << (bits - 1), bits - 1, c, d)
                (done if all(low[i] <= c[i] and d[i] <= high[i] for i in range(3)) else after).append(part)
        cut = after
    out: list[tuple[int, int]] = []
    for key, bits, _, _ in sorted(done + cut):
        last = key + (1 << bits) - 1
        if out and out[-1][1] + 1 == key:
            out[-1] = (out[-1][0], last)
        else:
            out.append((key, last))
    return out


def write_layout(points: DataFrame, path: str, size: float, files: int = 200) -> None:
    """Points on disk by drive and Morton key (zkey) of their cell (cell: its name), so that a box meets few row groups: see read_box().
    Points without a place have no key and come first."""
    name = F.concat_ws("_", *[cell(F.col(c), size).cast("string") for c in "xyz"])
    keyed = points.withColumns({"cell": name, "zkey": morton(F.col("x"), F.col("y"), F.col("z"), size)})
    keyed.repartitionByRange(files, "drive_id", "zkey").sortWithinPartitions("drive_id", "zkey").write.mode("overwrite").parquet(path)


def in_box(points: DataFrame, low: Sequence[float], high: Sequence[float], size: float, most: int = 64) -> DataFrame:
    """Rows of a table of write_layout() (with the same size) whose place is from low to high, both included. The box
    becomes ranges of keys, by which the scan passes over files and row groups; the places decide."""
    ranges = morton_ranges([int(np.floor(v / size)) for v in low], [int(np.floor(v / size)) for v in high], most)
    keys = F.lit(False)
    for a, b in ranges:
        keys = keys | F.col("zkey").between(a, b)
    for c, a, b in zip("xyz", low, high, strict=True):
        keys = keys & F.col(c).between(float(a), float(b))
    return points.filter(keys)


def read_box(spark: SparkSession, path: str, low: Sequence[float], high: Sequence[float], size: float, drives: Sequence | None = None) -> DataFrame:
    """in_box() over the table at path, of some drives or all."""
    points = spark.read.parquet(path)
    return in_box(points if drives is None else points.filter(F.col("drive_id").isin(*drives)), low, high, size).drop("cell", "zkey")
