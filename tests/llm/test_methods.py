"""Operators against plain versions of what they compute."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lidarloom.llm import ann, mixing, packing, quality, rules, simhash, suffixes, urls
from lidarloom.llm.components import components

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def made_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(9000, 64))
    x[5000:5400] = x[17]  # ties go to the smaller id
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")


@pytest.mark.parametrize("sizes", [{}, {"file": 700, "chunk": 100, "pivots": 256}])
def test_ann_recall(spark, sizes):
    """In one group for many files, and with files split into parts and queries into chunks."""
    x, e = made_vectors(spark)
    got = defaultdict(list)
    for r in ann.nearest(e, **sizes).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hits = 0
    for q in range(0, len(x), 20):
        s = x @ x[q]
        best = [i for i in np.lexsort((np.arange(len(x)), -np.round(s, 9))) if i != q][:20]
        hits += len(set(best) & {i for i, _ in got[q]})
        assert all(abs(score - s[i]) < 1e-9 for i, score in got[q]) and len({i for i, _ in got[q]}) == 20
    assert hits / (20 * 450) >= 0.93
    assert [i for i, _ in got[5000]] == [17, *range(5001, 5020)]


def test_footrule():
    rng = np.random.default_rng(2)
    lists = np.stack([rng.permutation(40)[:12] for _ in range(30)])

    def footrule(a, b):
        place = lambda x: {p: k for k, p in enumerate(x.tolist())}
        pa, pb = place(a), place(b)
        return sum(abs(pa.get(p, 12) - pb.get(p, 12)) for p in pa.keys() | pb.keys())

    got = ann.likeness(lists[:10], lists, 40)
    assert all(12 * 13 - 2 * got[i, j] == footrule(lists[i], lists[j]) for i in range(10) for j in range(30))


def test_files_decide_what_is_met(spark):
    """With one file a query, it finds only what is posted there."""
    x, e = made_vectors(spark)
    few = ann.nearest(e, posted=1, visited=1, k=1, share=1.0).collect()
    assert 0 < len(few) <= 450
    want = {q: max((float(x[q] @ v), -i) for i, v in enumerate(x) if i != q) for q in range(0, 9000, 20)}
    missed = sum(abs(r.score - want[r.query_id][0]) > 1e-9 for r in few)
    assert missed > 100


def test_water_filling(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1), (None, 500)], "source string, source_size long")
    t = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    assert t["a"] == 30 and t["c"] == 3
    assert abs(t["b"] / t[None] - 2 / 1) < 1e-9 and abs(sum(t.values()) - 1511) < 1e-6


def test_mix_nears_targets(docs):
    r = mixing.pareto_mix(docs).collect()
    texts = {d.doc_id: d.text for d in docs.collect()}
    taken, target, largest = Counter(), {}, Counter()
    for x in r:
        assert x["size"] == len(SPLIT.findall(texts[x.doc_id] or ""))
        largest[x.source] = max(largest[x.source], x["size"])
        taken[x.source] += x.taken
        target[x.source] = x.target
        assert x.taken % max(1, x["size"]) == 0 and x.taken <= 3 * x["size"]
    # whole documents come as near as half of one; ten documents a source here
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1 for s in target)
    assert sorted(r) == sorted(mixing.pareto_mix(docs.repartition(3)).collect())


def plain_mix(rows, targets):
    """rows (doc_id, source, size) -> copies: expected copies by bisection, then one ranking by odds over odds."""
    out = {}
    for source, target in targets.items():
        own = [(i, n) for i, s, n in rows if s == source and n > 0]
        out |= {i: 0 for i, s, n in rows if s == source and n == 0}
        weight = {i: round(n**0.5 * 1000) for i, n in own}
        lo, hi = 0.0, 1.0
        for _ in range(200):
            rate = (lo + hi) / 2
            lo, hi = (rate, hi) if sum(min(3.0, rate * weight[i]) * n for i, n in own) < target else (lo, rate)
        expected = {i: min(3.0, rate * weight[i]) for i, _ in own}
        copies = {i: int(expected[i]) for i, _ in own}
        need = max(0, round(target - sum(copies[i] * n for i, n in own)))
        ranking = []
        for i, n in own:
            u = (int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            p = expected[i] - copies[i]
            if p > 0:
                ranking.append(((u / (1 - u)) / (p / (1 - p)), n, i))
        ranking.sort()
        total, rest = 0, []
        for k, (odds, n, i) in enumerate(ranking):
            if total + n > need:
                rest = ranking[k:]
                break
            total, copies[i] = total + n, copies[i] + 1
        fits = [(abs(n - (need - total)), odds, n, i) for odds, n, i in rest if abs(n - (need - total)) < need - total]
        if fits:
            copies[min(fits)[3]] += 1
        out |= copies
    return out


def test_mix_is_a_pareto_sample(docs):
    r = mixing.pareto_mix(docs).collect()
    want = plain_mix([(x.doc_id, x.source, x["size"]) for x in r], {x.source: x.target for x in r})
    assert {x.doc_id: x.copies for x in r} == want
    # chances differ within a source
    by = defaultdict(set)
    for x in r:
        if x["size"]:
            by[x.source].add(x.copies)
    assert any(len(v) > 2 for v in by.values())


def plain_fingerprint(text):
    ws = re.findall(SPLIT, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not ws:
        return 0
    shingles = [" ".join(ws[i : i + 4]) for i in range(len(ws) - 3)] or [" ".join(ws)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs):
    rows = docs.select("doc_id", "text").collect()
    fps = {r.doc_id: plain_fingerprint(r.text) for r in rows}
    ids = sorted(fps)
    f = np.array([fps[i] for i in ids], dtype=np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= 4
    label = np.arange(len(ids))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(ids))])
        if (new == label).all():
            break
        label = new
    for subtrie in (simhash.SUBTRIE, 16):
        got = {r.doc_id: r for r in simhash.near_duplicates(docs, subtrie=subtrie).collect()}
        assert all(int(got[i].fingerprint, 16) == fps[i] and len(got[i].fingerprint) == 16 for i in ids)
        assert all(got[i].component_id == ids[label[k]] for k, i in enumerate(ids))


def test_trie_links_are_all_pairs():
    rng = np.random.default_rng(1)
    x = []
    for _ in range(60):
        base = int(rng.integers(0, 2**63))
        for _ in range(15):
            m = sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 6), replace=False))
            x.append(base ^ m)
    x = np.unique(np.array(x, dtype=np.uint64))
    d = np.bitwise_count(x[:, None] ^ x[None, :])
    for errors, depth in ((4, 0), (4, 10), (4, 16), (4, 20), (3, 12), (1, 8), (0, 3)):
        want = {(i, j) for i, j in zip(*np.nonzero(d <= errors), strict=True) if i < j}
        got = set()
        for trie in simhash.tries(depth, errors):
            assert sorted(trie.order) == list(range(64)) and trie.exact >= depth
            r = trie.key(x)
            o = np.argsort(r)
            for i, j in simhash.trie_links(r[o], r[o], True, trie, errors):
                got |= {tuple(sorted(p)) for p in zip(o[i].tolist(), o[j].tolist(), strict=True)}
        assert got == want
    assert [len(simhash.tries(p)) for p in (0, 10, 16, 18, 20)] == [2, 6, 12, 20, 30]


def test_crowded_subtries_are_walked_in_parts(spark, monkeypatch):
    """Fingerprints that mostly agree in their leading bits: subtries of many times the usual size lose no link."""
    rng = np.random.default_rng(5)
    near = np.array([sum(1 << int(k) for k in rng.choice(64, int(rng.integers(0, 9)), replace=False)) for _ in range(700)], dtype=np.uint64)
    x = np.unique(np.concatenate([near, rng.integers(0, 2**63, 300).astype(np.uint64)]))
    want = {v: v for v in x.view(np.int64).tolist()}

    def root(v):
        while want[v] != v:
            v = want[v]
        return v

    signed = x.view(np.int64).tolist()
    for i, j in zip(*np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= 4), strict=True):
        u, v = root(signed[i]), root(signed[j])
        want[max(u, v)] = min(u, v)
    distinct = spark.createDataFrame([(v,) for v in signed], "fp long")
    for few in (simhash.FEW, 0):
        monkeypatch.setattr(simhash, "FEW", few)
        links = simhash.near_links(distinct, subtrie=16)
        got = {r.node: r.root for r in components(links).collect()}
        assert {v: got.get(v, v) for v in signed} == {v: root(v) for v in signed}


def test_components(spark):
    chain = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7)]
    r = {x.node: x.root for x in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(r[i] == 0 for i in range(201)) and r[501] == 500 and r[500] == 500


def plain_removal(rows, length=100):
    seen, out = {}, {}
    for i, b in sorted((i, (t or "").encode()) for i, t in rows):
        off = np.zeros(len(b), dtype=bool)
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                off[p : p + length] = True
            else:
                seen[w] = True
        kept = np.frombuffer(b, np.uint8)[~off].tobytes()
        out[i] = (len(b), int(off.sum()), int(off[:1].sum()) + int((off[1:] & ~off[:-1]).sum()), hashlib.sha256(kept).hexdigest())
    return out


def made():
    rng = np.random.default_rng(3)
    base = "".join(rng.choice(list("abcdefghij kl"), 3000))
    rows = [(0, None), (1, ""), (2, "a" * 1000), (3, "b" + "a" * 500), (4, "ab" * 400), (5, base), (6, base[:99]), (7, base[500:600]), (8, base[500:599] + "!"), (9, "xx" + base[700:1500] + "yy" + base[1400:2200])]
    noise = lambda: "".join(rng.choice(list("mnopq"), rng.integers(0, 80)))
    for k in range(150):
        a, n = rng.integers(0, 2800), rng.integers(60, 180)
        rows.append((10 + k, noise() + base[a : a + n] + noise()))
    rows += [(1000 + k, "".join(rng.choice(list("ab é"), 40)) + base[100:170] + "".join(rng.choice(list("ab é"), 40))) for k in range(100)]
    return rows


def test_repeats(spark, docs):
    for rows in ([(r.doc_id, r.text) for r in docs.collect()], made()):
        d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(d).collect()}
        assert got == plain_removal(rows)


def test_repeats_of_dealt_out_keys(spark, monkeypatch):
    for name, value in {"SALT": 3, "HOT": 5, "SLAB": 2000, "SHARDS": 3, "MERGE_WINDOWS": 50, "GROUP_BYTES": 4000}.items():
        monkeypatch.setattr(suffixes, name, value)
    rows = made()
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(d).collect()}
    assert got == plain_removal(rows)


def test_merged_transforms_are_sorted():
    """The merged order is the order of suffixes, and its common prefixes are theirs."""
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("ab"), 30)) * 8 for _ in range(6)]
    n = np.array([len(t) - 99 for t in texts]).clip(max=100)
    joined = "".join(t[: k + 99] for t, k in zip(texts, n, strict=True)).encode()
    string, window = suffixes.repeated_windows(np.arange(6), np.zeros(6, np.int64), n, joined, shards=3)
    want = set()
    seen = set()
    for i, (t, k) in enumerate(zip(texts, n, strict=True)):
        for p in range(int(k)):
            w = t[p : p + 100]
            if w in seen:
                want.add((i, p))
            seen.add(w)
    assert set(zip(string.tolist(), window.tolist(), strict=True)) == want


def test_packing(docs, spark):
    from tokenizers import Tokenizer

    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(10**6, None), (10**6 + 1, " a  b <|endoftext|>\n\n xé  ²Ⅷ it's don't 12three   ")]
    r = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    tok = Tokenizer.from_file(packing.vocabulary())
    by = defaultdict(list)
    for x in r:
        by[x.doc_id].append(x)
    for i, text in rows:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        at = 0
        for x in sorted(by[i], key=lambda x: x.start):
            assert (x.start, x.doc_tokens) == (at, len(ids))
            assert x.ids_crc32 == zlib.crc32(np.array(ids[at : at + x.length], dtype="<u4").tobytes())
            at += x.length
        assert at == len(ids)
    places = sorted((x.sequence_id * 1024 + x.offset, x.length) for x in r)
    assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:], strict=False))
    assert all(x.offset + x.length <= 1024 for x in r)


def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    r = quality.score_quality(spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id").collect()
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) for x in r)
    out = [x for x in r if x.held_out]
    good, bad = [x.score for x in out if x.quality == 1], [x.score for x in out if x.quality == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.95


def plain_statistics(text):
    """The transformed statistics of a text, counted word by word."""
    text = text or ""
    ws = SPLIT.findall(text)
    lines = [x for x in text.split("\n") if SPLIT.search(x)]
    n, chars = len(ws) + 10, sum(map(len, ws)) + 50
    count = lambda chars: sum(c in chars for c in text)
    capitals, stops = sum("A" <= c <= "Z" for c in text) + 1.5, count(".,;:?") + 1.5
    repeats, dup = plain_rules(text)[4], len(lines) - len(set(lines))
    return [np.log1p(chars / n), (count("#*$%&|<>") / n) ** 0.5, (capitals / chars) ** 0.5, (count("!") / n) ** 0.5, (stops / n) ** 0.5, (repeats / n) ** 2, dup / (len(lines) + 1)]


def test_quality_is_the_discriminant(spark):
    """Scores against densities worked out row by row: Mahalanobis distances by solving, no factors."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    known = {r.doc_id: r.quality for r in labels.collect()}
    x = {i: np.array(plain_statistics(t)) for i, t in texts.items()}
    learn = {c: np.array([x[i] for i in x if known.get(i) == c and zlib.crc32(str(i).encode()) % 3 != 1]) for c in (0, 1)}
    total = sum(map(len, learn.values()))
    pooled = sum((a - a.mean(0)).T @ (a - a.mean(0)) for a in learn.values()) / total
    density = {}
    for c, a in learn.items():
        cov = (1 - quality.SHRINK) * np.cov(a.T, bias=True) + quality.SHRINK * pooled
        cov = (1 - quality.SHRINK) * cov + quality.SHRINK * np.diag(np.diag(cov)) + quality.RIDGE * np.eye(len(cov))
        density[c] = lambda v, a=a, cov=cov: np.log(len(a) / total) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * (v - a.mean(0)) @ np.linalg.solve(cov, v - a.mean(0))
    for r in quality.score_quality(docs, labels).collect():
        t = (density[1](x[r.doc_id]) - density[0](x[r.doc_id])) / 2
        assert abs(r.score - (0.5 + 0.5 * t / (1 + abs(t)))) < 1e-6 and r.predicted == int(r.score >= 0.5)


def plain_rules(text):
    ws = SPLIT.findall(text or "")
    windows = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
    covered = {j for i in range(len(ws) - 4) if windows[tuple(ws[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if SPLIT.search(x)]
    return (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), len(ws) < 10 or 100 * len(covered) > 20 * len(ws))


def test_rules(spark):
    d = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    quality_of = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    r = rules.rule_report(spark.read.parquet(f"{d}/documents.parquet")).collect()
    for x in r:
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == plain_rules(texts[x.doc_id])
    open_ = [x for x in r if not x.base_failed and x.doc_id in quality_of]
    assert all(x.kept for x in open_ if quality_of[x.doc_id] == 1)
    assert np.mean([x.kept for x in open_ if quality_of[x.doc_id] == 0]) < 0.2


def test_mined_rules(spark):
    rows = [(f"http://{'bad-pills' if i % 4 == 0 else 'site'}{i % 7}.example.org/{'buy' if i % 4 == 0 else 'en'}/{i}", i % 4 == 0) for i in range(400)]
    d = spark.createDataFrame(rows, "url string, bad boolean").withColumn("tokens", urls.tokens(F.col("url")))
    mined = urls.mine(d.select("tokens", "bad"))
    asked = spark.createDataFrame([("http://bad-pills9.example.com/buy/1",), ("http://site3.example.org/en/4",)], "key string").withColumn("tokens", urls.tokens(F.col("key")))
    hits = {r.key for r in urls.match(asked, mined).collect()}
    assert hits == {"http://bad-pills9.example.com/buy/1"}


def plain_matches(urls_tokens, rules):
    out = {}
    for key, own in urls_tokens.items():
        sure = [c for antecedent, c in rules if set(antecedent) <= set(own)]
        if sure:
            out[key] = max(sure)
    return out


def test_rules_against_brute_force(spark):
    """Many rules, among them from long URLs and of common tokens: mined sets have the counts that they claim, none that
    should be there is missing, and the index finds what checking every rule finds."""
    rng = np.random.default_rng(7)
    rows = []
    for i in range(600):
        keys = "&".join(f"k{chr(97 + int(k))}=1" for k in rng.choice(26, 6, replace=False))
        long = "/".join(f"{chr(97 + int(k))}x" for k in rng.integers(0, 26, int(rng.integers(0, 4)) if i % 40 else 60))
        url = f"http://h{chr(97 + i % 3)}.example.{rng.choice(['com', 'org'])}/{rng.choice(['buy', 'en', 'de'])}/{long}?{keys}"
        rows.append((url, bool(("/buy/" in url and ".com" in url and rng.random() < 0.9) or rng.random() < 0.05)))
    d = spark.createDataFrame(rows, "url string, bad boolean").withColumn("tokens", urls.tokens(F.col("url")))
    mined = urls.mine(d.select("tokens", "bad"), support=0.06, confidence=0.6)
    rules_ = [(tuple(r.antecedent), r.confidence, r.support) for r in mined.collect()]
    local = [(set(r.tokens), r.bad) for r in d.collect()]
    for antecedent, confidence, support in rules_:
        fits = [bad for own, bad in local if set(antecedent) <= own]
        assert abs(sum(fits) / len(fits) - confidence) < 1e-9 and abs(sum(fits) / len(local) - support) < 1e-9
        assert confidence >= 0.6 and support >= 0.06 - 1e-9
    # every pair that is sure and common enough fits some mined rule at least as sure
    tokens = sorted(set().union(*(own for own, _ in local)))
    for i, a in enumerate(tokens):
        for b in tokens[i:]:
            fits = [bad for own, bad in local if a in own and b in own]
            if fits and sum(fits) / len(local) >= 0.06 and sum(fits) / len(fits) >= 0.6:
                assert any(set(r) <= {a, b} and c >= sum(fits) / len(fits) - 1e-9 for r, c, _ in rules_)
    asked = d.select(F.col("url").alias("key"), "tokens").distinct()
    got = {r.key: r.rule_confidence for r in urls.match(asked, mined).collect()}
    assert got == plain_matches({r.key: r.tokens for r in asked.collect()}, [(a, c) for a, c, _ in rules_]) and got
