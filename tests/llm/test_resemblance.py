"""The pipeline's near-duplicate stage against all pairs by plain sets of five words."""

import numpy as np
import pytest

import corpus_pipeline
from lidarloom.llm import resemblance


def plain(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def plain_keepers(rows):
    ids = [r[0] for r in rows]
    sets = [plain(r[1]) for r in rows]
    root = list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    near = 0
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                near += 1
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return [ids[k] for k in range(len(rows)) if top(k) == k], near


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out = []
    for g in range(25):
        base = [f"w{x}" for x in rng.integers(0, 4000, int(rng.integers(30, 400)))]
        for _ in range(6):  # from copies to texts well below the threshold
            w = list(base)
            for k in rng.choice(len(w), int(len(w) * rng.choice([0, 0.01, 0.015, 0.02, 0.025, 0.04])), replace=False):
                w[k] = f"new{rng.integers(0, 10**6)}"
            out.append((len(out), " ".join(w).upper() if g % 5 == 0 else " ".join(w)))
    return [*out, (900, None), (901, ""), (902, " \n"), (903, "a b"), (904, "A  b"), (905, "a c")]


def test_groups_are_those_of_all_pairs(spark, sf, rows):
    want, near = plain_keepers(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf).collect())
    assert near > 50 and got == want
    for small, block in ((2, 16),):  # all bands but the smallest are crowded, and come in several blocks
        groups = resemblance.near_groups(docs.withColumnRenamed("doc_id", "uid"), small=small, block=block).collect()
        assert sorted({r.group for r in groups}) == want and len(groups) == len(rows)


def test_rows_without_id_and_empty_table(spark):
    d = spark.createDataFrame([(None, "one two three"), (4, "One two\tthree"), (4, "One two three"), (None, "x")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in resemblance.keep_one(d).collect()) == ["4", "None"]
    assert resemblance.keep_one(d.limit(0)).count() == 0


def test_crowded_bands_lose_no_pair():
    """Of pairs at 0.8 that share a band, each is found in one of the bands that they share, and in one only."""
    import pandas as pd

    rng = np.random.default_rng(11)
    found = shared = 0
    for _ in range(40):
        u, v = [], []
        for k in range(75):
            both, rest = rng.integers(0, 1 << 63, 400, dtype=np.uint64), rng.integers(0, 1 << 63, 100, dtype=np.uint64)
            for side, own in ((u, rest[:50]), (v, rest[50:])):
                runs = np.sort(np.concatenate([both, own]))
                least = resemblance.minima(runs)
                side.append({"uid": 2 * k + (side is v), "root": 2 * k + (side is v), "main": -1, "n": len(runs), "bands": resemblance.bands(least).view(np.int64), "minima": resemblance.mixed(least).astype(np.uint8).tobytes(), "low": (runs[: resemblance.LOWEST] >> np.uint64(32)).astype("<u4").tobytes()})
        u, v = (pd.DataFrame(x) for x in (u, v))
        v["uid"] += 10_000  # so that u's come before
        together = np.stack(u["bands"].to_list()) == np.stack(v["bands"].to_list())
        agree = np.array([(np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)).sum() for a, b in zip(u["minima"], v["minima"])]) >= resemblance.AGREE
        meets = together.any(1) & agree
        shared += int(meets.sum())
        times = np.zeros(len(u), dtype=int)
        for band in range(resemblance.BANDS):
            here = np.flatnonzero(together[:, band])  # who meets in this band
            for a, b in resemblance.agreeing(band, u.iloc[here], v.iloc[here], 0.79, None):
                for x, y in zip(a.tolist(), b.tolist()):
                    if (y - 10_000) // 2 == x // 2:
                        times[x // 2] += 1
        assert (times[meets] <= 1).all()
        found += int((times[meets] == 1).sum())
    assert shared > 2500 and found >= shared - 2  # what lowest shingles may miss: 3e-6 of pairs
