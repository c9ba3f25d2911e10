"""Registration of the whole table against plain steps, and where its data lie."""

import numpy as np
import pytest

from lidarloom.operators import registration
from lidarloom.params import Params
from lidarloom.plans import registry


def plain_register(source, target, covs_s, covs_t, distance, p=Params()):
    """Nearest neighbours by brute force, sums of every pair's own Jacobians -> r, t, iterations, converged, matches."""
    r, t, damping = np.eye(3), np.zeros(3), -1.0
    centre = target.mean(0)
    src, tgt = source - centre, target - centre
    done, pairs, iterations = False, [], 0
    while iterations < p.max_iterations and not done:
        moved = src @ r.T + t
        d2 = ((moved[:, None] - tgt[None]) ** 2).sum(-1)
        j = d2.argmin(1)
        pairs = [(src[i], tgt[j[i]], np.linalg.inv(covs_t[j[i]] + r @ covs_s[i] @ r.T)) for i in np.flatnonzero(d2[np.arange(len(src)), j] < distance**2)]
        if len(pairs) < 6:
            return r, t + centre - r @ centre, iterations, False, 0
        iterations += 1
        error = lambda r, t: sum((b - r @ a - t) @ m @ (b - r @ a - t) for a, b, m in pairs)  # noqa: B023, E731
        jac = [np.hstack([registration.cross_matrix(r @ a + t), -np.eye(3)]) for a, _, _ in pairs]
        h = sum(x.T @ m @ x for x, (_, _, m) in zip(jac, pairs, strict=True))
        g = sum(x.T @ m @ (b - r @ a - t) for x, (a, b, m) in zip(jac, pairs, strict=True))
        damping = p.init_lambda * np.abs(np.diag(h)).max() if damping < 0 else damping
        start, grow, moved_on = error(r, t), 2.0, False
        for _ in range(p.inner_iterations):
            d = np.linalg.solve(h + damping * np.eye(6), -g)
            dr, dt = registration.rotation(d[:3]), d[3:]
            gain = (start - error(dr @ r, dr @ t + dt)) / (d @ (damping * d - g))
            small = registration.is_small(dr, dt, p.rot_eps, p.trans_eps)
            if gain >= 0:
                r, t, damping, done, moved_on = dr @ r, dr @ t + dt, damping * max(1 / 3, 1 - (2 * gain - 1) ** 3), small, True
                break
            if small:
                done = moved_on = True
                break
            damping, grow = damping * grow, grow * 2
        if not moved_on:
            break
    return r, t + centre - r @ centre, iterations, done, len(pairs)


def test_every_pair_of_the_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    cloud = {}
    for r in rows:
        cloud.setdefault(r.label, []).append([10.0 * x for x in r.embedding[:3]])
    cloud = {k: np.array(v) for k, v in cloud.items()}
    eye = lambda n: np.repeat(np.eye(3)[None], n, 0)
    got = {r.pair_id: r for r in registry.queries()["register_pairs"](spark, sf).collect()}
    assert set(got) == {k for k in cloud if k + 1 in cloud} | {k for k in cloud if k in got}
    for k, g in got.items():
        if k + 1 in cloud:
            r, t, iterations, done, n = plain_register(cloud[k], cloud[k + 1], eye(len(cloud[k])), eye(len(cloud[k + 1])), 1.0)
            assert (g.iterations, g.converged) == (iterations, done) and (n == 0 or g.n_matches == n), k
            assert np.allclose(np.array(g.r).reshape(3, 3), r, atol=1e-7) and np.allclose(g.t, t, atol=1e-7)


@pytest.fixture(scope="module")
def pair(spark):
    rng = np.random.default_rng(2)
    cols = "pair_id int, point_id long, x double, y double, z double, cxx double, cxy double, cxz double, cyy double, cyz double, czz double"
    make = lambda: spark.createDataFrame([(k, i, *rng.uniform(-3, 3, 3).tolist(), 1.0 + i % 3, 0.1, 0.0, 2.0, 0.1, 1.5) for k in range(3) for i in range(200)], cols)
    return make(), make()


def test_target_stays_where_it_is(spark, pair):
    source, target = pair
    state = registration.stored(registration.start_state(source, None, "int"))
    src, tgt = registration.resident_source(source), registration.resident_target(target, 0.8)
    here = registration.matches_in_place(src, tgt, state, 0.8)
    lines = registration.normal_equations(here)._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    at = next(i for i, x in enumerate(lines) if "lidarloom_target" in x)
    above, d = [], depth(lines[at])
    for x in reversed(lines[:at]):
        if depth(x) < d:
            above.append(x)
            d = depth(x)
    join = next(i for i, x in enumerate(above) if "SortMergeJoin" in x)
    assert not any("Exchange" in x for x in above[:join])
    there = registration.correspondences(source, target, state, 0.8)
    columns = sorted(there.columns)
    assert sorted(map(tuple, here.select(*columns).collect())) == sorted(map(tuple, there.select(*columns).collect())) and here.count() > 100
    registration.discard(src, tgt)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("lidarloom_")]


def test_error_swap_and_given_covariances(spark, pair):
    source, target = pair
    state = registration.start_state(source, None, "int")
    m = registration.correspondences(source, target, state, 0.8)
    want = {r.pair_id: (r.error, r.n_matches) for r in registration.error_of(m, state).collect()}
    got = {r.pair_id: (r.error, r.n_matches) for r in registration.registration_error(source, target, state, 0.8).collect()}
    assert got.keys() == want.keys() and all(got[k][1] == want[k][1] and abs(got[k][0] - want[k][0]) < 1e-9 * want[k][0] for k in want)  # sums in any order
    rows = m.collect()
    w = np.array([[[r.m00, r.m01, r.m02], [r.m01, r.m11, r.m12], [r.m02, r.m12, r.m22]] for r in rows])
    e = np.array([[r.bx - r.ax, r.by - r.ay, r.bz - r.az] for r in rows])
    assert abs(sum(v[0] for v in want.values()) - np.einsum("ni,nij,nj", e, w, e)) < 1e-6
    other = registration.swap(source, target)
    assert other[0] is target and other[1] is source
    bare = source.select("pair_id", "point_id", "x", "y", "z")
    given = source.select("pair_id", "point_id", *registration.COVS)
    again = registration.with_covariances(bare, given, None)
    assert sorted(map(tuple, again.select(*source.columns).collect())) == sorted(map(tuple, source.collect()))
    made = registration.with_covariances(bare, None, lambda p: given)
    assert made.count() == source.count()
