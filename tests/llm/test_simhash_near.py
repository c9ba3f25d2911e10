"""Near-copies by SimHash: fingerprints against plain majorities, groups against all pairs."""

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from lidarloom.llm import resemblance, simhash_near
from lidarloom.llm.resemblance import WordHashes, mixed, shingles, words_of

from .test_resemblance import plain_keepers, rows  # noqa: F401


@pytest.fixture(scope="module")
def crowd():
    """A text with 150 copies about the threshold, so that most of them are near it and few near each other; one with 100
    nearer copies; others."""
    rng = np.random.default_rng(5)
    out = []
    for copies, share in ((150, 0.021), (100, 0.008), (0, 0), (0, 0), (2, 0.01)):
        base = [f"w{x}" for x in rng.integers(0, 4000, 300)]
        out.append(base)
        for _ in range(copies):
            w = list(base)
            for k in rng.choice(len(w), int(len(w) * share), replace=False):
                w[k] = f"new{rng.integers(0, 10**6)}"
            out.append(w)
    order = rng.permutation(len(out))
    return [(k, " ".join(out[i])) for k, i in enumerate(order.tolist())]


def print_of(text):
    return simhash_near.wide(shingles(words_of(text), WordHashes()))


def test_fingerprints_are_majorities():
    for n in (0, 1, 2, 9, 255, 256, 5000):
        runs = np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64)
        hashes = [runs, *(mixed(runs * resemblance.ODD[2, k]) for k in range(simhash_near.WORDS - 1))]
        want = [2 * sum(x >> b & 1 for x in h.tolist()) > n for h in hashes for b in range(64)]
        assert np.unpackbits(simhash_near.wide(runs).view(np.uint8), bitorder="little").tolist() == want


def test_orders_miss_no_more_than_said():
    """Pairs whose bits differ by chance as those of texts at 0.8 do: all agree in the leading bits of some order."""
    rng = np.random.default_rng(8)
    apart = rng.random((100_000, simhash_near.BITS)) < simhash_near.APART
    for depth in (1, 4, 6):
        meet = np.zeros(len(apart), dtype=bool)
        for order in simhash_near.orders(depth):
            assert len(set(order.tolist())) == depth
            meet |= ~apart[:, order].any(axis=1)
        assert (~meet).sum() <= 3
    assert (apart.sum(axis=1) > simhash_near.reach(100)).sum() <= 5


def test_stage_proposes_by_fingerprints(spark, sf, rows, monkeypatch):  # noqa: F811
    """The stage's pairs are those whose fingerprints are near; the texts decide."""
    seen, close = [], simhash_near.close

    def watched(pairs, texts, least):
        name = {r.uid: r.text for r in texts.collect()}
        seen.extend((name[r.a], name[r.b]) for r in pairs.collect())
        return close(pairs, texts, least)

    monkeypatch.setattr(simhash_near, "close", watched)
    want, near = plain_keepers(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()) == want
    assert len(seen) > 50
    for s, t in seen:
        n = min(len(shingles(words_of(x), WordHashes())) for x in (s, t))
        assert np.bitwise_count(print_of(s) ^ print_of(t)).sum() <= simhash_near.reach(n)


def test_groups_are_those_of_all_pairs(spark, rows, crowd):  # noqa: F811
    for table in (rows, crowd):
        want, _ = plain_keepers(table)
        docs = spark.createDataFrame(table, "uid long, text string")
        for subtrie in (simhash_near.SUBTRIE, 60):  # of few fingerprints: leading bits, and crowded subtries in parts
            groups = simhash_near.near_groups(docs, subtrie=subtrie).collect()
            assert sorted({r.group for r in groups}) == want and len(groups) == len(table)


def test_what_is_left_out_comes_later(crowd):
    """Every pair within reach is in the first round, or both of its rows are among those that have more, and then comes
    in the last one, once in all of the subtries; whatever parts a subtrie is cut into."""
    texts = [t for _, t in crowd]
    runs = [shingles(words_of(t), WordHashes()) for t in texts]
    pdf = pd.DataFrame({"uid": np.arange(len(texts)), "n": [len(r) for r in runs], "fp": [simhash_near.wide(r).tobytes() for r in runs]})
    pdf["root"], pdf["lowest"] = pdf["uid"], [(r[: resemblance.LOWEST] >> np.uint64(32)).astype("<u4").tobytes() for r in runs]
    fp = simhash_near.prints(pdf)
    far = np.bitwise_count(fp[:, None] ^ fp).sum(-1)
    inside = {(i, j) for i, j in zip(*np.nonzero(far <= simhash_near.reach(100)), strict=True) if i < j}
    near = {(i, j) for i, j in inside if len(np.intersect1d(runs[i], runs[j])) * 1.8 >= 0.8 * (len(runs[i]) + len(runs[j]))}
    leading = simhash_near.orders(1)
    for parts in (1, 3):
        pdf["part"] = pdf["uid"] % parts
        first, later = set(), []
        for k, order in enumerate(leading):
            for home in (0, 1):
                own = pdf[simhash_near.homes(fp, order) == home]
                for low in range(parts):
                    for high in range(low, parts):
                        some = own[own["part"].isin([low, high])]
                        if some.empty:
                            continue
                        first |= set(simhash_near.first_pairs(some, low, high, 0.8).itertuples(index=False, name=None))
                        got = simhash_near.later_pairs(some, low, high, leading[:k], 0.8, False)
                        later += list(zip(got["a"], got["b"], strict=True))
        few, more = {(a, b) for a, b, w in first if w is pd.NA}, {a for a, b, w in first if w is not pd.NA}
        assert few <= inside and all((a, b) in few or {a, b} <= more for a, b in inside)
        assert len(later) == len(set(later)) and near <= set(later) <= inside


def test_lowest_shingles_at_once():
    """As resemblance.alike says pair by pair."""
    rng = np.random.default_rng(4)
    sizes = [int(x) for x in rng.choice([3, 90, 255, 256, 257, 900], 120)]
    runs = [np.sort(rng.choice(1 << 32, 1100, replace=False)) for _ in range(2)]
    low, n = [], []
    for s in sizes:
        own = np.unique(np.concatenate([rng.choice(runs[0], s * 9 // 10, replace=False) if s < 900 else runs[0][:s], rng.choice(runs[1], s // 10, replace=False)]))
        low.append(own[: resemblance.LOWEST].astype("<u4"))
        n.append(len(own))
    i, j = np.triu_indices(len(n), 1)
    held, n = simhash_near.filled(pd.Series([x.tobytes() for x in low])), np.array(n)
    for least in (0.5, 0.8):
        want = [resemblance.alike(low[a], low[b], int(n[a]), int(n[b]), least) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
        assert simhash_near.alike(held[i], held[j], n[i], n[j], least).tolist() == want
    assert 0 < sum(simhash_near.alike(held[i], held[j], n[i], n[j], 0.3))


def test_driver_plans_less_than_before(spark, crowd):
    """The driver keeps the plans of jobs: the stage needs fewer than banded minima do where bands are crowded."""
    docs = spark.createDataFrame(crowd, "doc_id long, text string")
    jobs = []
    for k, module in enumerate((simhash_near, resemblance)):
        spark.sparkContext.setJobGroup(f"near-{k}", "")
        module.keep_one(docs).count()
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"near-{k}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] < jobs[1], jobs


def test_picked_rows(spark):
    """The chosen rows, however their numbers lie, whether they are sent as bits or shuffled."""
    numbers = [*range(-70, 200), *(1 << k for k in range(8, 63)), (1 << 33) - 1, (1 << 33) + 63, (1 << 63) - 1, -(1 << 63)]
    rows = spark.createDataFrame([(u, str(u)) for u in numbers], "uid long, text string")
    want = sorted(u for k, u in enumerate(numbers) if k % 3 == 0 or k > 320)
    chosen = spark.createDataFrame([(u,) for u in [*want, *want, 201, 1 << 40 | 1]], "uid long")
    for few in (True, False):
        assert sorted((r.uid, r.text) for r in simhash_near.picked(rows, chosen, "uid", few).collect()) == [(u, str(u)) for u in want]
        assert simhash_near.picked(rows, chosen.limit(0), "uid", few).count() == 0
    assert simhash_near.is_few(rows, "uid")


def test_texts_without_partners_stay_where_they_are(spark, monkeypatch):
    """Only texts that are compared are shuffled, also where nothing is small enough for Spark to broadcast by itself. With
    too many rows for that all are, and the same rows stay."""
    rng = np.random.default_rng(6)
    table = [(k, " ".join(f"{x:08x}" for x in rng.integers(0, 1 << 32, 3000))) for k in range(60)]
    table += [(100 + k, table[0][1].replace(" ", f" {k} ", 1)) for k in range(2)]
    docs = spark.createDataFrame(table, "doc_id long, text string")
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    none = gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList()

    def shuffled() -> int:
        stages = store.stageList(None, False, False, *none)
        return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        moved = []
        for blocks in (simhash_near.BLOCKS, 0):
            monkeypatch.setattr(simhash_near, "BLOCKS", blocks)
            before = shuffled()
            assert sorted(r.doc_id for r in simhash_near.keep_one(docs).select("doc_id", "text").collect()) == list(range(60))
            moved.append(shuffled() - before)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    of_texts = sum(len(t) for _, t in table)
    assert moved[0] < 0.25 * of_texts < of_texts < moved[1], (moved, of_texts)


def test_edges(spark):
    d = spark.createDataFrame([(None, "one two three"), (4, "One two\tthree"), (4, "One two three"), (None, "x"), (7, None), (8, " \n")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in simhash_near.keep_one(d).collect()) == ["4", "7", "None"]
    assert simhash_near.keep_one(d.limit(0)).count() == 0
