"""Folds, rows before, and neighbours, against plain versions."""

import numpy as np

from lidarloom.operators import covariance, imu, keyframes, registration, spatial
from lidarloom.params import Params
from lidarloom.plans.ordered import before


def test_average_of_rows_without_scan_id(spark):
    rng = np.random.default_rng(1)
    rows = [("ab"[k % 2], int(rng.integers(0, 10**6)), float(rng.normal())) for k in range(20000)]
    out = imu.ema(spark.createDataFrame(rows, "drive_id string, scan_stamp_ns long, v double").repartition(7), "v", "y").collect()
    assert len(out) == 20000
    for d in "ab":
        y = None
        for r in sorted((r for r in out if r.drive_id == d), key=lambda r: r.scan_stamp_ns):
            y = r.v if y is None else 0.95 * y + 0.05 * r.v
        last = max((r for r in out if r.drive_id == d), key=lambda r: r.scan_stamp_ns)
        assert abs(last.y - y) < 1e-6


def test_average_of_repeated_rows(spark):
    rows = [("d", 1, 5, 1.0), ("d", 1, 5, 1.0), ("d", 2, 6, 3.0)]
    out = imu.ema(spark.createDataFrame(rows, "drive_id string, scan_id long, scan_stamp_ns long, v double"), "v", "y", alpha=0.5)
    assert sorted(r.y for r in out.collect()) == [1.0, 1.0, 2.0] and out.columns == ["drive_id", "scan_id", "scan_stamp_ns", "v", "y"]
    empty = imu.ema(spark.createDataFrame([], "drive_id string, scan_stamp_ns long, v double"), "v", "y")
    assert empty.count() == 0


def test_rows_before(spark):
    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(0, 3)), int(rng.integers(0, 500)), k) for k in range(400)]
    got = {r.k: (r.before.k if r.before else None) for r in before(spark.createDataFrame(rows, "d long, s long, k long"), ["d"], "s", 40, ["k"], ["k"]).collect()}
    last, want = {}, {}
    for d, _, k in sorted(rows):
        want[k], last[d] = last.get(d), k
    assert got == want


def cloud(spark, n=300, seed=3):
    rng = np.random.default_rng(seed)
    p = np.round(rng.normal(size=(n, 3)) * 4)  # whole numbers: ties are exact
    p[-1] = (500, 0, 0)
    return p, spark.createDataFrame([("d", i, i, *x) for i, x in enumerate(p.tolist())], "drive_id string, point_id long, stamp_ns long, x double, y double, z double")


def test_neighbours_with_ties_and_order(spark):
    p, df = cloud(spark)
    d2 = ((p[:, None] - p[None]) ** 2).sum(-1)
    got = {}
    for r in spatial.knn_join(df, df, 4, ["drive_id"], ties=True, before="stamp_ns", offsets=True).collect():
        got.setdefault(r.left_id, set()).add(r.right_id)
        assert np.allclose((r.dx, r.dy, r.dz), p[r.right_id] - p[r.left_id])
    for i in range(len(p)):
        own = d2[i, :i]
        want = set() if not i else set(np.flatnonzero(own <= np.sort(own)[min(3, i - 1)]).tolist())
        assert got.get(i, set()) == want
    k = spatial.knn_join(df, df, 5, ["drive_id"], offsets=True)
    a = {r.point_id: r for r in covariance.raw_covariance(k, df, ["drive_id"]).collect()}
    b = {r.point_id: r for r in covariance.raw_covariance(k.drop("dx", "dy", "dz"), df, ["drive_id"]).collect()}
    assert len(a) == len(p) and all(np.allclose([a[i][c] for c in covariance.COVS], [b[i][c] for c in covariance.COVS]) for i in a)


def plain_vertices(p):
    """A point is a vertex if leaving it out leaves it outside: some plane through it has all others strictly on one
    side. Directions are tried until one is found; the nearest point of the others' hull gives the best one."""
    out = set()
    for i, x in enumerate(p):
        rest = np.delete(p, i, 0) - x
        g = rest.mean(0)
        for _ in range(20000):  # towards the point of the others' hull that is nearest to x
            s = rest[np.argmin(rest @ g)]
            d = g - s
            step = np.clip((g @ d) / max(d @ d, 1e-300), 0, 1)
            if step < 1e-12 or g @ g < 1e-20:
                break
            g = g - step * d
        if g @ g > 1e-8 and (rest @ g).min() > 1e-9:
            out.add(i)
    return out


def hulls(spark, p, **how):
    k = spark.createDataFrame([("d", i, *x) for i, x in enumerate(np.asarray(p, float).tolist())], "drive_id string, kf_id long, px double, py double, pz double")
    return {r.kf_id for r in keyframes.convex_hull_keyframes(k, **how).collect()}


def test_convex_hull_is_exact(spark):
    rng = np.random.default_rng(4)
    ball = rng.normal(size=(80, 3))
    ball /= np.linalg.norm(ball, axis=1)[:, None]
    inner = rng.normal(size=(60, 3)) * 0.2
    assert hulls(spark, np.concatenate([ball, inner])) == set(range(80))
    mixed = rng.normal(size=(120, 3))
    want = plain_vertices(mixed)
    assert hulls(spark, mixed) == want and hulls(spark, mixed, slice_size=16) == want
    grid = np.array([(x, y, z) for x in range(4) for y in range(4) for z in range(4)])
    assert hulls(spark, grid) == {i for i, x in enumerate(grid.tolist()) if all(v in (0, 3) for v in x)}
    flat = np.array([(x, y, x + y) for x in range(5) for y in range(5)])
    assert {tuple(flat[i, :2]) for i in hulls(spark, flat)} == {(0, 0), (0, 4), (4, 0), (4, 4)}
    line = np.array([(x, 2 * x, 0) for x in range(6)])
    assert hulls(spark, line) == {0, 5}
    assert hulls(spark, np.ones((6, 3))) == {0}


def test_concave_hull_by_brute_force(spark):
    rng = np.random.default_rng(6)
    p, alpha = rng.normal(size=(40, 3)), 1.2
    want = set()
    for i in range(len(p)):
        for j in range(len(p)):
            for k in range(j):
                if i in (j, k):
                    continue
                a, b = p[j] - p[i], p[k] - p[i]
                n = np.cross(a, b)
                centre = np.cross((a @ a) * b - (b @ b) * a, n) / (2 * n @ n)
                h2 = alpha**2 - centre @ centre
                if h2 < 0:
                    continue
                for sign in (1, -1):
                    o = p[i] + centre + sign * n / np.linalg.norm(n) * h2**0.5
                    d2 = ((np.delete(p, [i, j, k], 0) - o) ** 2).sum(1)
                    if (d2 >= alpha**2).all():
                        want.add(i)
    k = spark.createDataFrame([("d", i, *x) for i, x in enumerate(p.tolist())], "drive_id string, kf_id long, px double, py double, pz double")
    assert {r.kf_id for r in keyframes.concave_hull_keyframes(k, alpha).collect()} == want


def test_concave_hull_where_keyframes_are_dense(spark):
    """Copies of a place, a grid with many on one sphere, and cells that the nearest close: every ball tried as before."""
    rng = np.random.default_rng(8)
    p, alpha = np.concatenate([rng.uniform(-2, 2, (260, 3)), np.array([(x, y, z) for x in (0, 1) for y in (0, 1) for z in (0, 1)]) + 3.0]), 1.5
    p = np.concatenate([p, p[:5]])
    want = set()
    for i in range(len(p)):
        offsets = np.unique(p - p[i], axis=0)
        d2 = (offsets**2).sum(1)
        if keyframes.touches_empty_ball(offsets[(d2 > 0) & (d2 <= 4 * alpha**2)], alpha):
            want.add(i)
    assert 50 < len(want) < len(p) - 50
    k = spark.createDataFrame([("d", i, *x) for i, x in enumerate(p.tolist())], "drive_id string, kf_id long, px double, py double, pz double")
    for near in (0.5, 1.0):
        assert {r.kf_id for r in keyframes.concave_hull_keyframes(k, alpha, near=near).collect()} == want


def test_sides_of_a_voronoi_cell():
    axes = np.concatenate([np.eye(3), -np.eye(3)])
    sides, reach = keyframes.voronoi_neighbours(np.concatenate([axes, 3 * axes]))
    assert set(sides.tolist()) == set(range(6)) and abs(reach - 0.75**0.5) < 1e-9
    sides, reach = keyframes.voronoi_neighbours(axes[[0, 1, 3, 4]])
    assert set(sides.tolist()) == {0, 1, 2, 3} and reach == np.inf
    assert keyframes.voronoi_neighbours(axes[:0])[1] == np.inf
    rng = np.random.default_rng(3)
    many = rng.normal(size=(3000, 3))
    sides, reach = keyframes.voronoi_neighbours(many)
    assert len(sides) < 60 and reach < 1
    for x in rng.normal(size=(500, 3)) * reach:  # inside of the cell by all is inside by its sides
        assert (((x - many) ** 2).sum(1) >= x @ x).all() == (((x - many[sides]) ** 2).sum(1) >= x @ x).all()


def test_registration_by_plain_steps(spark):
    """The same steps on plain arrays: nearest neighbours by brute force, sums of every pair's own Jacobians."""
    rng = np.random.default_rng(8)
    target = rng.uniform(-3, 3, size=(150, 3))
    turn, shift = registration.rotation(np.array([0.02, -0.03, 0.05])), np.array([0.1, -0.05, 0.08])
    source = (target - shift) @ turn + rng.normal(size=target.shape) * 0.01
    covs = [np.diag(rng.uniform(0.5, 2, 3)) for _ in range(2 * len(target))]
    names = ("cxx", "cxy", "cxz", "cyy", "cyz", "czz")
    at = [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]
    frame = lambda p, c: spark.createDataFrame([(1, i, *x, *[float(c[i][k]) for k in at]) for i, x in enumerate(p.tolist())], "pair_id int, point_id long, x double, y double, z double, " + ", ".join(f"{n} double" for n in names))
    got = registration.register(frame(source, covs[:150]), frame(target, covs[150:]), distance=0.5).first()
    r, t, damping, p = np.eye(3), np.zeros(3), -1.0, Params()
    centre = target.mean(0)
    src, tgt = source - centre, target - centre
    for iterations in range(1, p.max_iterations + 1):
        moved = src @ r.T + t
        d2 = ((moved[:, None] - tgt[None]) ** 2).sum(-1)
        j = d2.argmin(1)
        ok = d2[np.arange(len(src)), j] < 0.25
        pairs = [(src[i], tgt[j[i]], np.linalg.inv(covs[150 + j[i]] + r @ covs[i] @ r.T)) for i in np.flatnonzero(ok)]
        error = lambda r, t, pairs=pairs: sum((b - r @ a - t) @ m @ (b - r @ a - t) for a, b, m in pairs)
        jac = [np.hstack([registration.cross_matrix(r @ a + t), -np.eye(3)]) for a, _, _ in pairs]
        h = sum(x.T @ m @ x for x, (_, _, m) in zip(jac, pairs, strict=True))
        g = sum(x.T @ m @ (b - r @ a - t) for x, (a, b, m) in zip(jac, pairs, strict=True))
        damping = p.init_lambda * np.abs(np.diag(h)).max() if damping < 0 else damping
        start, grow, done = error(r, t), 2.0, False
        for _ in range(p.inner_iterations):
            d = np.linalg.solve(h + damping * np.eye(6), -g)
            dr, dt = registration.rotation(d[:3]), d[3:]
            gain = (start - error(dr @ r, dr @ t + dt)) / (d @ (damping * d - g))
            done = registration.is_small(dr, dt, p.rot_eps, p.trans_eps)
            if gain >= 0 or done:
                break
            damping, grow = damping * grow, grow * 2
        if gain >= 0:
            r, t, damping = dr @ r, dr @ t + dt, damping * max(1 / 3, 1 - (2 * gain - 1) ** 3)
        if done:
            break
    back = t + centre - r @ centre
    assert got.converged and got.iterations == iterations and got.n_matches == len(pairs)
    assert np.allclose(np.array(got.r).reshape(3, 3), r, atol=1e-8) and np.allclose(got.t, back, atol=1e-8)
    assert np.allclose(r, turn, atol=0.01) and np.allclose(back, shift, atol=0.02)
