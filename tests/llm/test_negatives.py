"""Hard negatives against all pairs, with copies, ties and structure; what the bounds spare."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lidarloom.llm import negatives, queries


def plain(rows, every, positives=5, count=10):
    """rows: (id, label, whole vector) -> the operator's rows, by all inner products."""
    out = []
    for a, la, xa in rows:
        if a % every:
            continue
        s = sorted(((-int(xa @ x), i, lab) for i, lab, x in rows if i != a))
        for m, p, lab in [t for t in s if t[2] == la][:positives]:
            fits = [(-n, i) for n, i, other in s if other != la and 30 * -m <= 100 * -n <= 90 * -m]
            out += [(a, p, k + 1, i, -m, n) for k, (n, i) in enumerate(fits[:count])]
    return sorted(out)


def made(kind, n, seed=0):
    rng = np.random.default_rng(seed)
    if kind == "random":
        x = rng.normal(size=(n, 12))
    elif kind == "clustered":
        x = rng.normal(size=(8, 12))[rng.integers(0, 8, n)] * 3 + 0.2 * rng.normal(size=(n, 12))
    else:  # copies: a third of all rows is one vector, and another third ties with it
        x = rng.normal(size=(n, 12))
        x[::3], x[1::3] = x[0], np.roll(x[0], 1)
    return x, rng.integers(0, 4, n)


@pytest.mark.parametrize("kind", ["random", "clustered", "copies"])
def test_all_pairs(spark, kind, monkeypatch):
    monkeypatch.setattr(negatives, "HELD", 12 * 100)  # several blocks, several parts
    monkeypatch.setattr(negatives, "MEMBERS", 8)
    monkeypatch.setattr(negatives, "STEP", 64)
    x, label = made(kind, 900)
    e = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label))], "vec_id long, embedding array<double>, label int")
    got = sorted(map(tuple, negatives.hard_negatives(e, every=9).collect()))
    want = plain([(i, int(k), np.floor(256 * v).astype(np.int64)) for i, (v, k) in enumerate(zip(x, label))], 9)
    assert len(want) > 500 and got == want


def test_walks_end_early():
    """On vectors with structure most of the list is not walked, and what is found is what a full walk finds."""
    rng = np.random.default_rng(5)
    x = np.floor(256 * (rng.normal(size=(40, 16))[np.arange(20_000) % 40] * 2 + 0.1 * rng.normal(size=(20_000, 16))))
    norms = np.linalg.norm(x, axis=1)
    own = np.flatnonzero(np.arange(20_000) % 40 == 7)[:50]
    centre = negatives.centres_of(x[own], 1)
    width = negatives.angles(x[own], norms[own], centre).max()
    members = {"ids": own, "x": x[own], "norm": norms[own], "label": np.zeros(50), "lo": np.full((50, 1), -np.inf), "hi": np.full((50, 1), np.inf), "floor": np.full((50, 1), -np.inf)}
    held = {"ids": np.arange(20_000), "x": x, "label": np.zeros(20_000)}
    bound = negatives.bounds(norms, negatives.angles(x, norms, centre)[:, 0], width)
    assert all((x @ u <= np.linalg.norm(u) * bound).all() for u in x[own])
    best, made_products = negatives.walk(members, held, bound, True, 10)
    full, all_products = negatives.walk(members, held, np.full(20_000, np.inf), True, 10)
    assert (best.ids == full.ids).all() and (best.score == full.score).all() and made_products < all_products / 4


def test_edges(spark):
    rows = [
        (0, [1.0, 0.0], 1), (100, None, 1), (200, [1.0, None], 1), (300, [float("nan"), 1.0], 1), (400, [1.0, 1.0], None), (None, [1.0, 0.0], 1), (500, [], 1), (600, [1.0, 0.0, 0.0], 1), (700, [0.0, 0.0], 1), (800, [float("inf"), 1.0], 1),
        (1, [1.0, 0.5], 1), (2, [0.5, 0.0], 2), (2, [0.5, 0.0], 2), (3, [0.5, 1.0], 3), (4, [-1.0, 0.0], 2), (0, [1.0, 0.0], 1), (5, [1.0, 0.0], 2), (6, [0.9, 0.0], 2), (7, [0.0, 1.0], 2),
    ]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit("x") for c in ("x", "norm", "home", "cluster", "lo", "score", "rank", "d", "to")})
    got = sorted(map(tuple, negatives.hard_negatives(e).collect()))
    near = [(2, 32768), (2, 32768), (3, 32768)]  # 5 scores 65536 and 6 58880: 90 percent of 65536 is 58982
    first = [(0, 1, k + 1, i, 65536, s) for k, (i, s) in enumerate([(6, 58880), *near])]
    zero = [(0, 700, k + 1, i, 0, 0) for k, i in enumerate([7])]
    other = [(700, p, k + 1, i, 0, 0) for p in (0, 0, 1) for k, i in enumerate([2, 2, 3, 4, 5, 6, 7])]
    assert got == sorted(first + zero + other)
    assert negatives.hard_negatives(e.limit(0)).count() == 0
    assert negatives.hard_negatives(e.filter("vec_id > 0 and vec_id < 50")).count() == 0


def test_query_on_the_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    turned = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, np.floor(256 * np.array(r.embedding, dtype=float)).astype(np.int64)) for r in rows]
    assert sorted(map(tuple, queries.op12_shared_list_negatives(spark, sf).collect())) == plain(turned, 100)
