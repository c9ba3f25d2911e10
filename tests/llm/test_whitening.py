"""Whitening against numpy's solver on the whole table, and its refinement on close and equal eigenvalues."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lidarloom.llm import queries, whitening


def symmetric(values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))[0]
    a = (q * np.array(values, dtype=float)) @ q.T
    return (a + a.T) / 2


@pytest.mark.parametrize("values", [np.linspace(1, 2, 40), [5] * 3 + [3, 3 + 1e-9, 3 + 2e-9, 3 + 1e-13] + list(np.linspace(0.1, 2, 23)), [2] * 5, [0, 0, 1e-12, 1], list(1 + np.arange(30) * 1e-8), [0.0] * 3, [7.0]])
def test_refined(values):
    a = symmetric(values)
    e, x = whitening.refined(a)
    assert np.abs(x.T @ x - np.eye(len(e))).max() < 1e-16
    assert np.abs(a @ x - x * e).max() < 1e-15 * max(1, np.abs(a).max())
    assert (np.diff(e) <= 0).all() and np.abs(np.sort(e) - np.linalg.eigvalsh(a)).max() < 1e-14 * max(1, np.abs(a).max())


def test_close_values_are_solved_among_themselves():
    """Gaps far below float32's reach still give the vectors that belong to them."""
    q = np.linalg.qr(np.random.default_rng(3).normal(size=(6, 6)))[0].astype(np.longdouble)
    for _ in range(3):
        q = q @ (3 * np.eye(6, dtype=np.longdouble) - q.T @ q) / 2
    values = np.array([4, 1 + 2e-10, 1 + 1e-10, 1, 0.5, 0.25], dtype=np.longdouble)
    _, x = whitening.refined((q * values) @ q.T)
    assert np.abs(np.abs(q.T @ x) - np.eye(6)).max() < 1e-7
    assert np.abs(np.abs(np.linalg.eigh(((q * values) @ q.T).astype(np.float32))[1].T @ q.astype(float)).max(1) - 1).max() > 1e-3


def test_whole_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.floor(64 * np.array([r.embedding for r in rows], dtype=float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    c = (n * fit - s) / n
    e, v = (y[..., ::-1] for y in np.linalg.eigh(c.T @ c / n))
    want = ((n * x - s) / n) @ v[:, :16] / np.sqrt(e[:16])
    out = queries.op11_refined_whitening(spark, sf).toPandas().sort_values(["vec_id", "component"])
    assert len(out) == 16 * len(x) and set(out.n) == {n} and len(set(out.identity_error)) == 1 and out.identity_error.max() < 1e-9
    got = out.whitened.to_numpy().reshape(-1, 16)
    assert np.abs(np.abs(got) - np.abs(want)).max() < 1e-8
    assert (out.deviation.to_numpy().reshape(-1, 16)[:, 0] == ((n * x - s) ** 2).sum(1)).all()
    assert np.allclose(out.explained.to_numpy()[:16], e[:16] / e.sum(), rtol=1e-10)


def test_edges(spark):
    rng = np.random.default_rng(1)
    base = [(i, v.tolist(), "x") for i, v in enumerate(rng.normal(size=(40, 3)))]
    odd = [(None, [1.0, 2.0, 3.0], "x"), (50, None, "x"), (51, [1.0, None, 2.0], "x"), (52, [float("nan"), 1.0, 2.0], "x"), (53, [1.0, float("-inf"), 2.0], "x"), (54, [], "x"), (55, [1.0, 2.0], "x"), (56, [1.0, 2.0], "x"), (57, [0.0, 0.0, 0.0], "x"), (1, base[1][1], "x")]
    d = spark.createDataFrame(base + odd, "vec_id long, embedding array<double>, n string").withColumns({c: F.lit("x") for c in ("x", "d", "z", "e", "deviation", "component", "v")})
    out = whitening.whiten(d).toPandas()
    assert list(out.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert set(out.n) == {42} and out.identity_error.max() < 1e-9  # 40 vectors, [1, 2, 3] and zero; two of one length have no variance
    assert out.groupby("vec_id", dropna=False).size().to_dict() == {**{i: 3 for i in range(40)}, 1: 6, 57: 3, float("nan"): 3} or out.vec_id.isna().sum() == 3
    assert not set(out.vec_id.dropna()) & {50, 51, 52, 53, 54, 55, 56}
    assert whitening.whiten(d.limit(0)).count() == 0
    assert whitening.whiten(d.filter("vec_id in (2, 3)")).groupBy("component").count().count() == 1  # two vectors have one direction
    twice = whitening.whiten(d.union(d)).toPandas()
    assert set(twice.n) == {42} and len(twice) == 2 * len(out)


def test_large_numbers(spark):
    """Sums beyond 64 bits are exact; a deviation beyond them is null."""
    far = [(i, [1e9 * i, -1e9 * i * i, 3.0]) for i in range(5)]
    x = np.array([[int(64 * c) + 1_000_000 for c in v] for _, v in far], dtype=object)
    s = x.sum(0)
    want = {i: int(((5 * x[i] - s) ** 2).sum()) for i in range(5)}
    out = whitening.whiten(spark.createDataFrame(far, "vec_id long, embedding array<double>")).toPandas()
    assert out.identity_error.max() < 1e-6 and set(out.component) == {1, 2}
    assert all(want[r.vec_id] >= 1 << 63 and np.isnan(r.deviation) for r in out.itertuples())
