"""Searches whose pairs stay in the group of work of their cells."""

import numpy as np
import pytest

from lidarloom.operators import keyframes, spatial


@pytest.fixture(scope="module")
def clouds(spark):
    """Two clouds over two scans: on a grid, so that distances tie, with copies of a place, far points and rows without one."""
    rng = np.random.default_rng(3)
    place = np.concatenate([rng.integers(-12, 12, size=(500, 3)) / 2, np.full((60, 3), 0.25), rng.normal(size=(40, 3)) * 1e9])
    rows = [(i % 2, int(i), *p) for i, p in enumerate(place.tolist())]
    kind = "scan int, point_id long, x double, y double, z double"
    left = spark.createDataFrame([*rows[::3], (0, 9001, None, 0.0, 0.0), (None, 9002, 0.0, 0.0, 0.0)], kind)
    return left, spark.createDataFrame([*rows, (0, 9003, 0.0, None, 0.0)], kind), rows[::3], rows


def met(clouds):
    """(left id, right id, squared distance, whether their cells of 1.5 touch) of all pairs of a scan."""
    a, b = (np.array(x) for x in clouds[2:])
    out = {}
    for r in a:
        d = r[2:] - b[:, 2:]
        near = (np.abs(np.floor(r[2:] / 1.5) - np.floor(b[:, 2:] / 1.5)) <= 1).all(1)
        out[int(r[1])] = [(x, int(i), bool(n)) for x, i, s, n in zip(d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2], b[:, 1], b[:, 0], near, strict=True) if s == r[0]]
    return out


@pytest.mark.parametrize("sizes", [{}, {"wide": 1, "chunk": 7, "block": 11}])
def test_ends_and_nearest(clouds, sizes, monkeypatch):
    whole = spatial.in_cells
    monkeypatch.setattr(spatial, "in_cells", lambda *a, **b: whole(*a, **b, **sizes))
    left, right = clouds[:2]
    want = met(clouds)
    got = {r.left_id: (r.n, r.first_id, r.first_d2, r.last_id, r.last_d2) for r in spatial.radius_ends(left, right, 2.25, ["scan"]).collect()}
    for i, pairs in want.items():
        inside = [(d, j) for d, j, _ in pairs if d < 2.25]
        assert got.pop(i) == (len(inside), min(inside)[1], min(inside)[0], max(inside)[1], max(inside)[0])
    assert not got
    rows = spatial.approx_knn_join(left, right, 8, 1.5, ["scan"]).collect()
    near = {i: sorted((d, j) for d, j, n in pairs if n)[:8] for i, pairs in want.items()}
    assert sorted((r.left_id, r["rank"], r.d2, r.right_id) for r in rows) == sorted((i, k + 1, *v) for i, x in near.items() for k, v in enumerate(x))


@pytest.mark.parametrize("search", [lambda c: spatial.radius_ends(c, c, 2.25, ["scan"]), lambda c: spatial.approx_knn_join(c, c, 8, 1.5, ["scan"])])
def test_pairs_are_not_shuffled(clouds, search):
    """No join or exchange of pairs: places meet in a cogroup, and only its rows are grouped afterwards."""
    plan = search(clouds[1])._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "__right_id_x" not in plan


def test_nothing_in_reach(spark, clouds):
    none = clouds[1].limit(0)
    for a, b in ((clouds[0], none), (none, clouds[0])):
        assert spatial.radius_ends(a, b, 2.25, ["scan"]).count() == 0 and spatial.approx_knn_join(a, b, 8, 1.5, ["scan"]).count() == 0


@pytest.mark.parametrize("sizes", [{}, {"chunk": 50, "block": 60}])
def test_concave_hull_in_blocks(spark, sizes, monkeypatch):
    """Neighbours of a keyframe don't leave the group of work in which they meet, also where they come in blocks."""
    whole = keyframes.in_cells
    monkeypatch.setattr(keyframes, "in_cells", lambda *a, **b: whole(*a, **{**b, **sizes}))
    rng = np.random.default_rng(8)
    p, alpha = np.concatenate([rng.uniform(0, 3, (90, 3)), rng.integers(0, 5, (40, 3)) / 4 + 2, rng.uniform(6, 9, (3, 3))]), 1.2
    want = set()
    for i in range(len(p)):
        offsets = np.unique(p - p[i], axis=0)
        d2 = (offsets**2).sum(1)
        if keyframes.touches_empty_ball(offsets[(d2 > 0) & (d2 <= 4 * alpha**2)], alpha):
            want.add(i)
    assert 20 < len(want) < len(p) - 5
    k = spark.createDataFrame([("d", i, *x) for i, x in enumerate(p.tolist())], "drive_id string, kf_id long, px double, py double, pz double")
    hull = keyframes.concave_hull_keyframes(k, alpha)
    assert "FlatMapCoGroupsInPandas" in hull._jdf.queryExecution().optimizedPlan().toString()
    assert {r.kf_id for r in hull.collect()} == want


def test_what_directions_tell_of_balls():
    """Neither of the two quick answers contradicts the balls."""
    rng = np.random.default_rng(2)
    for n in (30, 120, 900):
        p = rng.uniform(0, 2, (n, 3)) if n < 900 else np.unique(rng.integers(0, 14, (n, 3)) / 7, axis=0)
        inside, told = keyframes.surrounded(p, p, 0.4, 0.8), 0
        for i in range(0, len(p), max(1, len(p) // 60)):
            d = p - p[i]
            d2 = (d**2).sum(1)
            d = d[(d2 > 0) & (d2 < 2.56)]
            room, true = keyframes.has_room(d, 0.8), keyframes.touches_empty_ball(keyframes.sides_of(d), 0.8)
            assert not (room and not true) and not (inside[i] and true)
            told += room or inside[i]
        assert n < 900 or told > 30
    assert not keyframes.has_room(np.zeros((0, 3)), 0.8) and not keyframes.touches_empty_ball(keyframes.sides_of(np.zeros((0, 3))), 0.8)
    assert not keyframes.has_room(np.array([[1.5, 0, 0], [0, 1.5, 0.0]]), 0.8)  # balls that don't cross
