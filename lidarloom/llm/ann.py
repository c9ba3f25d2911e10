"""Approximate nearest neighbours by a permutation index."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

#: Pivots, and how many of its nearest ones a vector's or query's list holds.
PIVOTS = 512
LISTED = 64
#: Inverted files that a vector is posted in, and files that a query looks into: those of its nearest pivots.
POSTED = 5
VISITED = 112
#: Of what a query meets in a file, this share is reranked, by footrule distance.
SHARE = 0.3
#: Postings and queries that one group of work holds.
FILE = 16384
CHUNK = 8192
#: Numbers that a step of the reranking holds at once.
HELD = 1 << 21


def usable(vector: Column) -> Column:
    """Neither null nor zero, and all components finite."""
    v = F.coalesce(vector, F.array().cast("array<double>"))
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return ~odd & F.exists(v, lambda x: x != 0)


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, norm: float | None, listed: int) -> np.ndarray:
    """Pivots by nearness. The largest inner product is the smallest distance once every vector has one more component
    that lifts it to the same norm; queries (norm None) have 0 there."""
    near = vectors @ pivots.T
    if norm is not None:
        lift = lambda x: np.sqrt(np.maximum(norm**2 - (x**2).sum(1), 0))
        near = near + lift(vectors)[:, None] * lift(pivots)[None, :]
    return np.argsort(-near, axis=1, kind="stable")[:, :listed]


def likeness(asked: np.ndarray, held: np.ndarray, pivots: int) -> np.ndarray:
    """For each query's list (row of asked) and each posted list (row of held) how far their footrule distance is below
    the most there can be, halved.

    With absent pivots at place n, the footrule of two lists of n is n * (n + 1) less twice the sum, over pivots in
    both, of n less the later of the two places. That sum is gathered from inverted files: for each pivot the lists
    that hold it, with n less their place.
    """
    n = held.shape[1]
    out = np.zeros((len(asked), len(held)), dtype=np.int32)

    def inverted(lists: np.ndarray):
        flat = lists.ravel()
        o = np.argsort(flat, kind="stable")
        cuts = np.searchsorted(flat[o], np.arange(pivots + 1))
        return o // n, (n - o % n).astype(np.int32), cuts

    (q_row, q_weight, q_at), (v_row, v_weight, v_at) = inverted(asked), inverted(held)
    for p in np.flatnonzero((np.diff(q_at) > 0) & (np.diff(v_at) > 0)).tolist():
        a, b = slice(q_at[p], q_at[p + 1]), slice(v_at[p], v_at[p + 1])
        out[np.ix_(q_row[a], v_row[b])] += np.minimum.outer(q_weight[a], v_weight[b])
    return out


@dataclass(frozen=True)
class Routes:
    """Where each pivot's file lies: it has `parts` groups of work from `first` on, and queries of a group come in
    `chunks` chunks. Small files share a group."""

    first: np.ndarray
    parts: np.ndarray
    chunks: np.ndarray

    @staticmethod
    def of(postings: np.ndarray, visits: np.ndarray, queries: int, file: int, chunk: int) -> Routes:
        n = len(postings)
        first, parts, asked, at = np.zeros(n, np.int64), np.ones(n, np.int64), np.zeros(n, np.int64), 0
        big = postings > file
        for p in np.flatnonzero(big).tolist():
            first[p], parts[p], asked[p] = at, -(-int(postings[p]) // file), visits[p]
            at += int(parts[p])
        small = np.flatnonzero(~big)
        shared = np.cumsum(postings[small]) // file
        for g in np.unique(shared).tolist():
            these = small[shared == g]
            first[these], asked[these] = at, visits[these].sum()
            at += 1
        return Routes(first, parts, np.maximum(1, -(-np.minimum(asked, queries) // chunk)))

    def holds(self, group: int, files: np.ndarray) -> np.ndarray:
        return (self.first[files] <= group) & (group < self.first[files] + self.parts[files])


def search_file(q_ids, q_lists, q_vectors, skip, ids, lists, vectors, pivots, k, share):
    """(row of the query, id, score) of the k best that each query finds in one file. Its postings are ranked by
    footrule distance, ties to the smaller id, the first `share` of them, k + 1 at least, by inner product. skip: pairs
    that meet in another file."""
    key = -likeness(q_lists, lists, pivots).astype(np.int64) * len(ids) + np.argsort(np.argsort(ids, kind="stable"), kind="stable")
    key[skip | (q_ids[:, None] == ids[None, :])] = np.iinfo(np.int64).max
    wanted = min(len(ids), max(k + 1, int(np.ceil(share * len(ids)))))
    near = np.argpartition(key, wanted - 1, axis=1)[:, :wanted]
    meets = np.take_along_axis(key, near, 1) < np.iinfo(np.int64).max
    out = []
    step = max(1, HELD // (wanted * vectors.shape[1]))
    for a in range(0, len(near), step):
        some = near[a : a + step]
        # products are summed in the order of components, the same for equal vectors wherever they stand
        score = (vectors[some] * q_vectors[a : a + step, None, :]).sum(-1)
        score[~meets[a : a + step]] = -np.inf
        best = np.lexsort((ids[some], -score), axis=-1)[:, :k]
        score = np.take_along_axis(score, best, 1)
        row, col = np.nonzero(score > -np.inf)
        out.append((a + row, ids[np.take_along_axis(some, best, 1)[row, col]], score[row, col]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def best_of(row: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Which entries are among the k best of their query."""
    o = np.lexsort((ids, -score, row))
    start = np.searchsorted(row[o], row[o], side="left")
    return o[np.arange(len(o)) - start < k]


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, pivots: int = PIVOTS, share: float = SHARE, posted: int = POSTED, visited: int = VISITED, file: int = FILE, chunk: int = CHUNK) -> DataFrame:
    """(vec_id, embedding) -> query_id, rank, vec_id, score: for rows whose vec_id is divisible by `every`, the k rows
    with the largest inner product, by score (double precision), ties to the smaller vec_id.

    Pivots are a bounded sample (`pivots` distinct vectors, by hash of the id). A vector's list is its LISTED nearest
    pivots in order. Every vector is posted in the inverted files of its `posted` nearest pivots, a query looks into
    those of its `visited` nearest ones, and meets a vector in the first file that both name. In each file what a query
    meets is ranked by the footrule distance of the lists; the first `share` is reranked by exact inner products.
    Files are the shuffle's keys; large ones are split, so no task holds more than `file` postings and `chunk` queries.
    On vectors without any structure (the hardest case) the tests measure the recall.

    Null ids, and vectors that are null, zero or hold null or non-finite components, take no part. Vectors of several
    lengths are searched each among its own, since only those have inner products. Of rows that repeat a query's id the
    least vector asks; rows with the query's id are not its candidates. Empty table: no rows. Other columns don't take
    part.
    """
    kind = vectors.schema["embedding"].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("v"))
    v = v.filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    norm2 = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    shapes = v.groupBy(F.size("v").alias("d")).agg(F.countDistinct(F.when(F.col("vec_id") % every == 0, F.col("vec_id"))).alias("q"), F.max(norm2).alias("norm2"))
    out = v.sparkSession.createDataFrame([], "query_id long, vec_id long, score double")
    for shape in shapes.filter("q > 0").orderBy("d").collect():
        own = v.filter(F.size("v") == shape["d"])
        out = out.unionByName(found(own, shape["q"], float(np.sqrt(shape["norm2"])), every, k, pivots, share, posted, max(visited, k), file, chunk))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def found(v: DataFrame, n_queries: int, norm: float, every: int, k: int, pivots: int, share: float, posted: int, visited: int, file: int, chunk: int) -> DataFrame:
    """(vec_id, v) of one length -> query_id, vec_id, score: the k best of each query in each group of files."""
    sc = v.sparkSession.sparkContext
    sample = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(4 * pivots).collect()
    chosen = np.array(list(dict.fromkeys(tuple(r["v"]) for r in sample))[:pivots], dtype=np.float64)
    table = sc.broadcast(chosen)  # at most `pivots` vectors
    n, listed, kind = len(chosen), min(LISTED, len(chosen)), v.schema["v"].dataType.simpleString()

    def ordered(rows: DataFrame, lift: float | None, files: int) -> DataFrame:
        def run(batches):
            for pdf in batches:
                if len(pdf):
                    order = nearest_pivots(np.stack(pdf["v"].to_list()).astype(np.float64), table.value, lift, max(listed, files)).astype("<u2")
                    yield pdf.assign(list=[x.tobytes() for x in order[:, :listed]], files=list(order[:, :files].astype(np.int32)))

        return stored(rows.mapInPandas(run, f"vec_id long, v {kind}, list binary, files array<int>"))

    rows = ordered(v, norm, posted)
    asks = ordered(v.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")), None, visited)

    def counted(df: DataFrame) -> np.ndarray:  # a row a pivot
        out = np.zeros(n, dtype=np.int64)
        for r in df.select(F.explode("files").alias("p")).groupBy("p").count().collect():
            out[r["p"]] = r["count"]
        return out

    routes = Routes.of(counted(rows), counted(asks), n_queries, file, chunk)
    arrays = {name: F.array(*[F.lit(int(x)) for x in getattr(routes, name)]) for name in ("first", "parts", "chunks")}
    of = lambda name, p: F.get(arrays[name], p).cast("long")
    part = lambda p: F.pmod(F.xxhash64("vec_id"), of("parts", p))
    # a vector has one part of each file, and every chunk of queries; a query has every part, and one chunk
    place = lambda g, c: F.struct(g.cast("long").alias("grp"), c.cast("long").alias("chunk"))
    held = F.flatten(F.transform("files", lambda p: F.transform(F.sequence(F.lit(0).cast("long"), of("chunks", p) - 1), lambda c: place(of("first", p) + part(p), c))))
    asked = F.flatten(F.transform("files", lambda p: F.transform(F.sequence(F.lit(0).cast("long"), of("parts", p) - 1), lambda x: place(of("first", p) + x, F.pmod(F.xxhash64("vec_id", F.lit(1)), of("chunks", p))))))
    left = asks.select("*", F.explode(F.array_distinct(asked)).alias("at")).select("vec_id", "v", "list", "files", "at.*")
    right = rows.select("*", F.explode(F.array_distinct(held)).alias("at")).select("vec_id", "v", "list", "files", "at.*")
    where = sc.broadcast(routes)

    def search(key, asks: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        got = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(asks) and len(rows):
            lists = lambda df: np.frombuffer(b"".join(df["list"]), "<u2").reshape(len(df), -1).astype(np.int64)
            dense = lambda df: np.stack(df["v"].to_list()).astype(np.float64)
            q_ids, q_lists, q_vectors = asks["vec_id"].to_numpy(), lists(asks), dense(asks)
            ids, held, vectors, files = rows["vec_id"].to_numpy(), lists(rows), dense(rows), np.stack(rows["files"].to_list())
            looks = np.zeros((len(asks), n), dtype=bool)
            np.put_along_axis(looks, np.stack(asks["files"].to_list()), True, axis=1)
            here = where.value.holds(int(key[0]), files)
            for p in np.unique(files[here]).tolist():
                v_row, nth = np.nonzero(here & (files == p))
                q_row = np.flatnonzero(looks[:, p])
                for some in np.array_split(q_row, len(q_row) * len(v_row) // HELD + 1):
                    if not len(some):
                        continue
                    earlier = np.zeros((len(some), len(v_row)), dtype=bool)
                    for j in range(files.shape[1] - 1):
                        earlier |= looks[np.ix_(some, files[v_row, j])] & (j < nth)[None, :]
                    row, i, s = search_file(q_ids[some], q_lists[some], q_vectors[some], earlier, ids[v_row], held[v_row], vectors[v_row], n, k, share)
                    got.append((some[row], i, s))
            row, i, s = (np.concatenate(x) for x in zip(*got, strict=True))
            best = best_of(row, i, s, k)
            got = [(q_ids[row[best]], i[best], s[best])]
        return pd.DataFrame({"query_id": got[0][0], "vec_id": got[0][1], "score": got[0][2]})

    return left.groupBy("grp", "chunk").cogroup(right.groupBy("grp", "chunk")).applyInPandas(search, "query_id long, vec_id long, score double")
