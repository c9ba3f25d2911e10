"""Hard negatives by anchor-clustered shared lists (after MAXIMUS, Abuzaid et al. 2019).

Anchors are clustered by direction. For a cluster whose members are within angle t of its centre, a candidate of norm r
at angle a from the centre has an inner product of at most |u| * r * cos(max(0, a - t)) with any member u. Candidates
are sorted by that bound once for a whole cluster; every member walks the list until the bound of what is left is below
what it already holds. The bound also decides which candidates are sent to a cluster at all.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .whitening import blocks, finite

SCALE = 256
#: Clusters at most, anchors that they are found from (by hash of the id), and rounds of that.
CLUSTERS, SAMPLE, ROUNDS = 1024, 16384, 8
#: Members of a cluster that one group of work holds; numbers of candidates' vectors that it holds; candidates a step.
MEMBERS = 2048
HELD = 1 << 21
STEP = 1024
#: Radians and share by which bounds are widened, far above their rounding errors.
SLACK = 1e-6
FOUND = "anchor_id long, ask int, vec_id long, score long"


def whole(vector: Column) -> Column:
    """The vector in whole numbers: floor(SCALE * c) of each component c."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE))


def angles(x: np.ndarray, norms: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Radians between each vector and each centre (unit vectors); 0 for zero vectors, whose bounds are 0 anyway."""
    cos = (x @ centres.T) / np.where(norms > 0, norms, 1)[:, None]
    return np.where(norms[:, None] > 0, np.arccos(np.clip(cos, -1, 1)), 0.0)


def bounds(norms: np.ndarray, angle: np.ndarray, width: np.ndarray | float) -> np.ndarray:
    """What the inner product with a unit vector within `width` of the centre can be at most."""
    return norms * (np.cos(np.maximum(0, angle - width - SLACK)) + SLACK)


def centres_of(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """k unit vectors, by spherical k-means over the distinct directions of a bounded sample; fewer if it has fewer."""
    norms = np.linalg.norm(x, axis=1)
    unit = np.unique(x[norms > 0] / norms[norms > 0, None], axis=0)
    if not len(unit):
        return np.eye(1, x.shape[1])
    rng = np.random.default_rng(1)
    centres = unit[rng.permutation(len(unit))[:k]]
    for _ in range(rounds):
        own = (unit @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, unit)
        length = np.linalg.norm(sums, axis=1)
        centres = np.where(length[:, None] > 1e-12, sums / np.maximum(length, 1e-12)[:, None], centres)
    return centres


def dense(column, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<i8").reshape(-1, d)


@dataclass
class Best:
    """For each member and ask the best `k` so far, as rows (slot = member * asks + ask), and the score to beat."""

    k: int
    least: np.ndarray
    slot: np.ndarray
    ids: np.ndarray
    score: np.ndarray

    @staticmethod
    def start(floor: np.ndarray, k: int) -> Best:
        none = np.zeros(0, np.int64)
        return Best(k, floor.ravel().astype(float), none, none, none)

    def take(self, slot: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        slot, ids, score = np.concatenate([self.slot, slot]), np.concatenate([self.ids, ids]), np.concatenate([self.score, score])
        o = np.lexsort((ids, -score, slot))
        slot, ids, score = slot[o], ids[o], score[o]
        nth = np.arange(len(slot)) - np.searchsorted(slot, slot, side="left")
        keep = nth < self.k
        last = nth == self.k - 1
        self.least[slot[last]] = np.maximum(self.least[slot[last]], score[last])
        self.slot, self.ids, self.score = slot[keep], ids[keep], score[keep]


def walk(members: dict[str, np.ndarray], candidates: dict[str, np.ndarray], bound: np.ndarray, same: bool, k: int, step: int = STEP) -> tuple[Best, int]:
    """The best k candidates of every ask of every member, and how many products that took.

    members: ids, x, norm, label, lo, hi, floor (asks in columns); candidates: ids, x, label. same: only candidates of
    the member's label, else only others. A member stops once its norm times the bound of the rest is below the score to
    beat of each of its asks; candidates that score the same are met still, for ties go by id.
    """
    order = np.argsort(-bound, kind="stable")
    asks = members["lo"].shape[1]
    best, made = Best.start(np.maximum(members["floor"], members["lo"]), k), 0
    for a in range(0, len(order), step):
        weakest = best.least.reshape(-1, asks).min(1)
        alive = np.flatnonzero(members["norm"] * bound[order[a]] * (1 + SLACK) >= weakest)
        if not len(alive):
            break
        some = order[a : a + step]
        score = members["x"][alive] @ candidates["x"][some].T
        made += score.size
        fits = (members["label"][alive, None] == candidates["label"][None, some]) == same
        fits &= members["ids"][alive, None] != candidates["ids"][None, some]
        for j in range(asks):
            slot = alive * asks + j
            row, col = np.nonzero(fits & (score >= best.least[slot][:, None]) & (score <= members["hi"][alive, j][:, None]))
            if len(row):
                best.take(slot[row], candidates["ids"][some[col]], score[row, col].astype(np.int64))
    return best, made


@dataclass(frozen=True)
class Clusters:
    """Centres, how wide each cluster of anchors is, in how many parts its members come, and their dimension."""

    centres: np.ndarray
    width: np.ndarray
    parts: np.ndarray
    exact: str

    @property
    def d(self) -> int:
        return self.centres.shape[1]


def prepared(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """(vec_id, label, x array) of one length -> vec_id, label, x binary, norm, home: the nearest centre, angle: to it."""

    def run(batches):
        for batch in batches:
            for d, at, x in blocks(batch, "x"):
                norms = np.linalg.norm(x.astype(float), axis=1)
                angle = angles(x.astype(float), norms, centres)
                home = angle.argmin(1)
                data = np.ascontiguousarray(x, dtype="<i8").tobytes()
                cells = [data[8 * d * i : 8 * d * (i + 1)] for i in range(len(x))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(cells, pa.binary()), pa.array(norms), pa.array(home), pa.array(angle[np.arange(len(x)), home])],
                    names=["vec_id", "label", "x", "norm", "home", "angle"],
                )

    return rows.select("vec_id", "label", "x").mapInArrow(run, "vec_id long, label long, x binary, norm double, home long, angle double")


def met(members: DataFrame, candidates: DataFrame, loads: dict[int, int], clusters: Clusters, same: bool, k: int) -> DataFrame:
    """members (with lo, hi, floor) and candidates (with `cluster`, where each is sent) -> FOUND.

    A group of work is a part of a cluster's members and a block of its candidates; loads: candidates of each cluster.
    """
    block = max(256, HELD // clusters.d)
    n = F.array(*[F.lit(-(-loads.get(c, 0) // block)).cast("long") for c in range(len(clusters.centres))])
    parts = F.array(*[F.lit(int(p)).cast("long") for p in clusters.parts])
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), count - 1))
    left = members.filter(F.get(n, F.col("home").cast("int")) > 0)
    left = left.select("vec_id", "label", "x", "norm", "lo", "hi", "floor", F.col("home").alias("cluster"), F.pmod(F.xxhash64("vec_id"), F.get(parts, F.col("home").cast("int"))).alias("part"))
    left = left.select("*", every(F.get(n, F.col("cluster").cast("int"))).alias("block"))
    right = candidates.select("vec_id", "label", "x", "norm", "cluster", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.get(n, F.col("cluster").cast("int"))).alias("block"))
    right = right.select("*", every(F.get(parts, F.col("cluster").cast("int"))).alias("part"))

    def group(key, u: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(u) or not len(v):
            return pd.DataFrame({"anchor_id": [], "ask": [], "vec_id": [], "score": []})
        c, kind = int(key[0]), clusters.exact
        x = dense(v["x"], clusters.d)
        angle = angles(x.astype(float), v["norm"].to_numpy(), clusters.centres[c : c + 1])[:, 0]
        table = lambda name: np.stack(u[name].to_list()).astype(float)
        asked = {"ids": u["vec_id"].to_numpy(), "x": dense(u["x"], clusters.d).astype(kind), "norm": u["norm"].to_numpy(), "label": u["label"].to_numpy(), "lo": table("lo"), "hi": table("hi"), "floor": table("floor")}
        held = {"ids": v["vec_id"].to_numpy(), "x": x.astype(kind), "label": v["label"].to_numpy()}
        best, _ = walk(asked, held, bounds(v["norm"].to_numpy(), angle, clusters.width[c]), same, k)
        asks = asked["lo"].shape[1]
        return pd.DataFrame({"anchor_id": asked["ids"][best.slot // asks], "ask": best.slot % asks, "vec_id": best.ids, "score": best.score})

    keys = ["cluster", "part", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(group, FOUND)


def best_k(found: DataFrame, k: int) -> DataFrame:
    """FOUND -> the best k of each ask, with rank."""
    order = Window.partitionBy("anchor_id", "ask").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def loads_of(sent: DataFrame) -> dict[int, int]:
    return {r["cluster"]: r["count"] for r in sent.groupBy("cluster").count().collect()}  # a row a cluster


def search(members: DataFrame, candidates: DataFrame, clusters: Clusters, same: bool, k: int) -> DataFrame:
    """The best k of each ask of each member -> FOUND and rank, stored. members (stored): vec_id, label, x, norm, home, lo,
    hi: arrays of one entry an ask; candidates (stored): of prepared().

    First every cluster meets the candidates whose nearest centre is its own. What its members then hold tells which
    others their bounds let in; only those are sent.
    """
    none = F.transform("lo", lambda _: F.lit(float("-inf")))
    home = candidates.withColumn("cluster", F.col("home"))
    first = stored(best_k(met(members.withColumn("floor", none), home, loads_of(home), clusters, same, k), k))
    full = first.filter(F.col("rank") == k).groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("ask", F.col("score").cast("double").alias("s")))).alias("least"))
    floor = F.transform("lo", lambda lo, i: F.greatest(lo, F.coalesce(F.try_element_at("least", i.cast("int")), F.lit(float("-inf")))))
    now = stored(members.join(full.withColumnRenamed("anchor_id", "vec_id"), "vec_id", "left").withColumn("floor", floor).drop("least"))
    weakest = F.array_min("floor")
    needs = np.full(len(clusters.centres), np.inf)
    share = F.when(F.col("norm") > 0, weakest / F.col("norm")).when(weakest > 0, float("inf")).otherwise(float("-inf"))
    for r in now.groupBy("home").agg(F.min(share).alias("s")).collect():  # a row a cluster
        needs[r["home"]] = r["s"]
    known = np.isfinite(needs)
    needs[known] -= np.abs(needs[known]) * SLACK

    def aim(batches):
        for batch in batches:
            x = dense(batch.column(2).to_pylist(), clusters.d).astype(float)
            norms, home = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            goes = bounds(norms[:, None], angles(x, norms, clusters.centres), clusters.width[None, :]) * (1 + SLACK) >= needs[None, :]
            goes[np.arange(len(home)), home] = False
            row, to = np.nonzero(goes)
            cuts = np.concatenate([[0], np.cumsum(goes.sum(1))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(to))
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(4)] + [lists], names=["vec_id", "label", "x", "norm", "to"])

    aimed = stored(candidates.select("vec_id", "label", "x", "norm", "home").mapInArrow(aim, "vec_id long, label long, x binary, norm double, to array<long>"))
    away = aimed.select("vec_id", "label", "x", "norm", F.explode("to").alias("cluster"))
    second = met(now, away, loads_of(away.select("cluster")), clusters, same, k)
    return stored(best_k(first.drop("rank").unionByName(second), k))


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90) -> DataFrame:
    """(vec_id, embedding, label) -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are rows whose vec_id is divisible by `every`. Scores are inner products of whole numbers (see whole());
    higher ones come first, ties by the smaller vec_id. An anchor's positives are its first `positives` other rows of its
    label. For each, the first `negatives` rows of other labels follow whose score is from `least` to `most` percent of
    the positive's, both exactly. All rows are candidates, however their labels and vectors repeat; the result is exact.

    Rows with a null id, label or vector, or a null, NaN or infinite component, take no part. Vectors of several lengths
    meet their own length only. Rows that repeat an id are candidates each, never of an anchor with that id; as an
    anchor the least of them (by label, then vector) stands. A zero vector scores 0 with all. Scores beyond 64 bits
    raise. An empty table, or one without anchors, gives no rows. Other columns don't take part.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").alias("v"))
    v = v.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("v")) & (F.size("v") > 0))
    rows = v.select("vec_id", "label", whole(F.col("v")).alias("x"))
    is_anchor = F.col("vec_id") % every == 0
    norm2 = F.aggregate("x", F.lit(0.0), lambda s, c: s + c.cast("double") * c)
    shapes = rows.groupBy(F.size("x").alias("d")).agg(F.countDistinct(F.when(is_anchor, F.col("vec_id"))).alias("anchors"), F.max(norm2).alias("most"))
    out = rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    for r in shapes.filter("anchors > 0").orderBy("d").collect():
        if r["most"] >= 2.0**63:
            raise ValueError("inner products of these vectors don't fit 64 bits")
        own = rows.filter(F.size("x") == r["d"])
        out = out.unionByName(of_length(own, r["anchors"], r["most"], is_anchor, positives, negatives, least, most))
    return out


def of_length(rows: DataFrame, n_anchors: int, largest: float, is_anchor: Column, positives: int, negatives: int, least: int, most: int) -> DataFrame:
    anchors = rows.filter(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("r")).select("vec_id", "r.label", "r.x")
    sample = np.array([r["x"] for r in anchors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("x").collect()], dtype=float)
    centres = centres_of(sample, min(CLUSTERS, max(1, int(n_anchors**0.5) // 2)))
    anchors, candidates = stored(prepared(anchors, centres)), stored(prepared(rows, centres))
    width, parts = np.zeros(len(centres)), np.ones(len(centres), dtype=np.int64)
    for r in anchors.groupBy("home").agg(F.max("angle").alias("a"), F.count(F.lit(1)).alias("n")).collect():  # a row a cluster
        width[r["home"]], parts[r["home"]] = r["a"], -(-r["n"] // MEMBERS)
    # every partial sum of an inner product is at most the product of the norms, so below 2^53 floats are exact
    clusters = Clusters(centres, width, parts, "f8" if largest < 2.0**53 else "i8")
    one = lambda v: F.array(F.lit(v))
    asks = anchors.select("vec_id", "label", "x", "norm", "home", one(float("-inf")).alias("lo"), one(float("inf")).alias("hi"))
    found = search(stored(asks), candidates, clusters, True, positives)
    p = found.select(F.col("anchor_id").alias("vec_id"), (F.col("rank") - 1).alias("nth"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # n is within least to most percent of p: n from ceil(least * p / 100) to floor(most * p / 100)
    hundredths = lambda share: F.expr(f"(positive_score * {share} - pmod(positive_score * {share}, 100)) div 100")
    bounded = p.withColumn("hi", hundredths(most)).withColumn("lo", -F.expr(f"(-positive_score * {least} - pmod(-positive_score * {least}, 100)) div 100"))
    windows = bounded.filter("positive_score >= 0").groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("nth", "lo", "hi"))).alias("w"))
    as_floats = lambda name: F.transform(F.col(f"w.{name}"), lambda x: x.cast("double"))
    # of fewer positives the asks that are left out can't be met
    padded = lambda name, v: F.slice(F.concat(as_floats(name), F.array_repeat(F.lit(v), positives)), 1, positives)
    asks = anchors.join(windows, "vec_id").select("vec_id", "label", "x", "norm", "home", padded("lo", float("inf")).alias("lo"), padded("hi", float("-inf")).alias("hi"))
    mined = search(stored(asks), candidates, clusters, False, negatives)
    mined = mined.select(F.col("anchor_id").alias("vec_id"), F.col("ask").alias("nth"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = mined.join(p, ["vec_id", "nth"])
    return out.select(F.col("vec_id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")
