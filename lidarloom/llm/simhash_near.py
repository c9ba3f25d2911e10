"""Near-copies by SimHash: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Fingerprints propose pairs, the texts themselves decide. A fingerprint has BITS bits, each the majority of the shingles'
hashes, so that two texts differ in a share of bits that their similarity fixes: at 0.8 in APART of them on average. As in
a trie join, fingerprints are dealt to subtries by their leading bits, here in several orders of the bits; within a subtrie
all meet that are at most reach() bits apart.

A pair at 0.8 is in no subtrie together with probability MISSED or less, and too far apart with some 1e-5; copies nearer to
each other are missed less often. Nothing else is left to chance.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored, with_class
from .components import components
from .resemblance import LEAST, LOWEST, ODD, SLACK, WordHashes, close, lowest, mixed, shingles, words_of
from .simhash import CROWDED, FEW, SEED

WORDS = 4
BITS = 64 * WORDS
#: The angle between sets of equal size at 0.8, over pi: acos(2 * 0.8 / 1.8) / pi. Up to SHORT shingles ties make it more.
APART = 0.1515
SHORT, APART_SHORT = 16, 0.1875
SPREAD = 4.5
MISSED = 1e-6
#: Fingerprints that one subtrie is to hold; their number sets how many leading bits part the work.
SUBTRIE = 16384
#: A row with so many partners or fewer in a subtrie is looked at with all of them at once; likeliest partners after that.
PARTNERS = 4
#: Rows that are tried as the middle of a cluster, and rows near one that make it a cluster; pairs compared at once, at
#: some 130 bytes each where all of them are near.
LEADERS, CLUSTER = 64, 64
COMPARED = 1 << 18
#: Blocks of 64 numbers, a bit each, that are few enough to broadcast.
BLOCKS = 1 << 19


def reach(n: np.ndarray | int, bits: int = BITS) -> np.ndarray:
    """Bits in which fingerprints may differ where the smaller text has n shingles."""
    apart = np.where(np.asarray(n) <= SHORT, APART_SHORT, APART)
    return np.ceil(apart * bits + SPREAD * np.sqrt(apart * (1 - apart) * bits)).astype(np.int64)


def wide(runs: np.ndarray) -> np.ndarray:
    """WORDS * 64 bits of distinct shingles' hashes: a bit is 1 if it is set in over half of them."""
    set_bits = np.zeros(BITS, dtype=np.int64)
    for part in np.array_split(runs, len(runs) // 4096 + 1):
        if len(part):
            h = np.stack([part, *(mixed(part * ODD[2, k]) for k in range(WORDS - 1))], axis=1)
            bits = np.unpackbits(h.astype("<u8").view(np.uint8).ravel(), bitorder="little").reshape(-1, BITS)
            for k in range(0, len(bits), 255):  # so many ones fit into a byte
                set_bits += bits[k : k + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * set_bits > len(runs), bitorder="little").view("<u8")


def orders(depth: int) -> list[np.ndarray]:
    """The leading bits of as many orders as it takes for a pair at 0.8 to agree in all of those of one: of each
    permutation of the bits as many orders as have bits of their own."""
    if not depth:
        return [np.zeros(0, dtype=np.int64)]
    p = [comb(BITS, d) * APART**d * (1 - APART) ** (BITS - d) for d in range(BITS - depth + 1)]
    apart = np.array([1 - comb(BITS - d, depth) / comb(BITS, depth) for d in range(BITS - depth + 1)])
    n = 1
    while (np.array(p) * apart**n).sum() > MISSED:
        n += 1
    rng = np.random.default_rng(SEED)
    out: list[np.ndarray] = []
    while len(out) < n:
        some = rng.permutation(BITS)
        out += [some[k : k + depth] for k in range(0, BITS - depth + 1, depth)]
    return out[:n]


def homes(fp: np.ndarray, order: np.ndarray) -> np.ndarray:
    out = np.zeros(len(fp), dtype=np.int64)
    for bit in order.tolist():
        out = (out << 1) | ((fp[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1)).astype(np.int64)
    return out


def sketches(docs: DataFrame) -> DataFrame:
    """(uid, text) -> uid, h1, h2: the words' 128-bit hash, n: distinct shingles, fp."""

    def run(batches):
        import xxhash

        known = WordHashes()
        for pdf in batches:
            rows = []
            for uid, text in zip(pdf["uid"], pdf["text"], strict=True):
                words = words_of(text)
                whole = np.frombuffer(xxhash.xxh128_digest(b" ".join(words), SEED), dtype=np.int64)
                runs = shingles(words, known)
                rows.append((uid, int(whole[0]), int(whole[1]), len(runs), wide(runs).tobytes()))
            yield pd.DataFrame(rows, columns=["uid", "h1", "h2", "n", "fp"])

    return docs.mapInPandas(run, "uid long, h1 long, h2 long, n long, fp binary")


def prints(df: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(df["fp"]), "<u8").reshape(len(df), WORDS)


def met(n: np.ndarray, fp: np.ndarray, x: np.ndarray, y: np.ndarray, least: float):
    """Places (i, j) of fingerprints near each other, i of x and j of y, both in the order of n; x is y: each pair once."""
    if not len(x) or not len(y):
        return
    same, n_y = x is y, n[y]
    rough = reach(0, 128)
    chunk = max(1, COMPARED // len(y))
    for s in range(0, len(x), chunk):
        part = x[s : s + chunk]
        lo, hi = np.searchsorted(n_y, np.floor(least * n[part[0]])), np.searchsorted(n_y, np.ceil(n[part[-1]] / least), "right")
        other = y[max(lo, s + 1) if same else lo : hi]
        d = np.bitwise_count(fp[part, 0][:, None] ^ fp[other, 0]) + np.bitwise_count(fp[part, 1][:, None] ^ fp[other, 1])
        i, j = np.nonzero(d <= rough)
        if same:
            late = j + max(lo, s + 1) > i + s
            i, j = i[late], j[late]
        i, j = part[i], other[j]
        low, high = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        ok = (low >= least * high) & (np.bitwise_count(fp[i] ^ fp[j]).sum(axis=1, dtype=np.int64) <= reach(low))
        yield i[ok], j[ok]


def clusters(n: np.ndarray, fp: np.ndarray, rank: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """leader: the row whose cluster each row is in, -1 for those in none; only large clusters count. The leader is the
    cluster's middle: it differs least from the majority of its bits, as what the others were copied from would."""
    leader = np.full(len(n), -1, dtype=np.int64)

    def about(c: int) -> np.ndarray:
        free = np.flatnonzero(leader < 0)
        low, high = np.minimum(n[free], n[c]), np.maximum(n[free], n[c])
        return free[(low >= least * high) & (np.bitwise_count(fp[free] ^ fp[c]).sum(axis=1, dtype=np.int64) <= reach(low))]

    for c in np.argsort(rank)[:LEADERS].tolist():
        if leader[c] >= 0 or len(near := about(c)) <= CLUSTER:
            continue
        ones = np.unpackbits(fp[near].view(np.uint8).ravel(), bitorder="little").reshape(-1, BITS).sum(axis=0)
        middle = np.packbits(2 * ones > len(near), bitorder="little").view("<u8")
        c = int(near[np.lexsort((rank[near], np.bitwise_count(fp[near] ^ middle).sum(axis=1, dtype=np.int64)))[0]])
        leader[about(c)] = c
    return leader


def first_pairs(pdf: pd.DataFrame, low: int, high: int, least: float) -> pd.DataFrame:
    """Pairs (a, b, w) of a subtrie to look at first: w is null where a row has few partners, it is looked at with all of
    them. Of one with more, a, there is one, b, and w is the size of the cluster that b leads, or 0 for the first partner in
    an order of all rows of the table. So a pair left out is one of rows with more partners.
    """
    pdf = pdf.sort_values("n", kind="stable")
    uid, n, part, fp = pdf["uid"].to_numpy(), pdf["n"].to_numpy(), pdf["part"].to_numpy(), prints(pdf)
    first = mixed(uid.view(np.uint64))
    by_rank = np.argsort(first)
    rank = np.empty(len(uid), dtype=np.int64)
    rank[by_rank] = np.arange(len(uid))
    count, best = np.zeros(len(uid), dtype=np.int64), np.full(len(uid), len(uid), dtype=np.int64)
    leader = clusters(n, fp, rank, least)
    inside = np.flatnonzero((leader >= 0) & (leader != np.arange(len(uid))))
    best[inside] = rank[leader[inside]]
    middles = np.unique(leader[inside])
    best[middles] = rank[middles]
    count[inside] = count[middles] = PARTNERS + 1
    kept: list[tuple[np.ndarray, np.ndarray]] = []

    def look(x: np.ndarray, y: np.ndarray) -> None:
        for i, j in met(n, fp, x, y, least):
            for own, other in ((i, j), (j, i)):
                loose = leader[own] < 0
                np.minimum.at(best, own[loose], rank[other[loose]])
            count[:] += np.bincount(i, minlength=len(uid)) + np.bincount(j, minlength=len(uid))
            some = (count[i] <= PARTNERS) | (count[j] <= PARTNERS)
            kept.append((i[some], j[some]))

    groups = [np.flatnonzero(leader == c) for c in [-1, *np.unique(leader[leader >= 0]).tolist()]]
    for k, g in enumerate(groups):
        for h in groups[k:]:
            if g is h and k:
                continue
            if low == high:
                look(g, h)
            else:
                look(g[part[g] == low], h[part[h] == high])
                if g is not h:
                    look(g[part[g] == high], h[part[h] == low])
    i, j = (np.concatenate(v) for v in zip(*kept, strict=True)) if kept else (np.zeros(0, np.int64),) * 2
    some = (count[i] <= PARTNERS) | (count[j] <= PARTNERS)
    more = np.flatnonzero(count > PARTNERS)
    size = np.where(leader >= 0, np.bincount(leader[leader >= 0], minlength=len(uid))[leader], 0)
    few = pd.DataFrame({"a": np.minimum(uid[i[some]], uid[j[some]]), "b": np.maximum(uid[i[some]], uid[j[some]]), "w": None})
    return pd.concat([few, pd.DataFrame({"a": uid[more], "b": uid[by_rank[best[more]]], "w": size[more]})]).astype({"w": "Int64"})


def filled(lowest: pd.Series) -> np.ndarray:
    """Rows' lowest shingles, to the width of LOWEST with numbers that no shingle and no other row has."""
    out = (1 << 32) + np.arange(len(lowest) * LOWEST, dtype=np.int64).reshape(-1, LOWEST)
    for row, b in zip(out, lowest, strict=True):
        own = np.frombuffer(b, "<u4")
        row[: len(own)] = own
    return out


def alike(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, least: float) -> np.ndarray:
    """resemblance.alike for many pairs at once: whether texts of n and m shingles with these lowest ones can be near."""
    both = np.sort(np.concatenate([x, y], axis=1), axis=1)
    same = both[:, 1:] == both[:, :-1]
    common = same.sum(axis=1)
    every = common >= least * (n + m - common)
    sample = (same & (1 + np.cumsum(~same, axis=1) <= LOWEST)).sum(axis=1)
    some = sample >= least * LOWEST - SLACK * (least * (1 - least) * LOWEST) ** 0.5
    return np.where((n <= LOWEST) & (m <= LOWEST), every, some)


def later_pairs(pdf: pd.DataFrame, low: int, high: int, before: list[np.ndarray], least: float, best: bool) -> pd.DataFrame:
    """Of rows with more partners the pairs (a, b, w) that links leave apart.

    best: only the PARTNERS nearest ones, b, that a row outside the largest group has, w bits apart, and a row (a, a, null)
    where a has others. Else all that the lowest shingles allow, in the first subtrie that both are in, w null.
    """
    pdf = pdf.sort_values("n", kind="stable")
    uid, n, part, root, fp = *(pdf[c].to_numpy() for c in ("uid", "n", "part", "root")), prints(pdf)
    roots, times = np.unique(root, return_counts=True)
    held = [(np.zeros(0, dtype=np.int64),) * 3]
    masks = [np.zeros(WORDS, dtype=np.uint64) for _ in before]
    for m, order in zip(masks, before, strict=True):
        for bit in order.tolist():
            m[bit // 64] |= np.uint64(1 << (bit % 64))
    shingle = None if best else filled(pdf["lowest"])

    def look(x: np.ndarray, y: np.ndarray) -> None:
        for i, j in met(n, fp, x, y, least):
            ok = root[i] != root[j]
            i, j = i[ok], j[ok]
            apart = fp[i] ^ fp[j]
            if best:
                bits = np.bitwise_count(apart).sum(axis=1, dtype=np.int64)
                for own, other in ((i, j), (j, i)):
                    at = np.lexsort((bits, own))
                    start = np.flatnonzero(np.diff(own[at], prepend=-1))
                    place = np.arange(len(at)) - np.repeat(start, np.diff(start, append=len(at)))
                    at = at[(place < PARTNERS) & ~main[own[at]]]
                    held.append((own[at], other[at], bits[at]))
                more[i] = more[j] = True
                continue
            for m in masks:
                ok = ((apart & m) != 0).any(axis=1)
                i, j, apart = i[ok], j[ok], apart[ok]
            for some in np.array_split(np.arange(len(i)), len(i) // 2048 + 1):
                p, q = i[some], j[some]
                ok = alike(shingle[p], shingle[q], n[p], n[q], least)
                held.append((p[ok], q[ok], p[ok]))

    more = np.zeros(len(uid), dtype=bool)
    main = root == roots[times.argmax()]
    out, of_main = np.flatnonzero(~main), np.flatnonzero(main)
    for x, y in ((out, out), (out, of_main)):
        if low == high:
            look(x, y)
        else:
            look(x[part[x] == low], y[part[y] == high])
            if x is not y:
                look(x[part[x] == high], y[part[y] == low])
    i, j, bits = (np.concatenate(v) for v in zip(*held, strict=True))
    if not best:
        return pd.DataFrame({"a": np.minimum(uid[i], uid[j]), "b": np.maximum(uid[i], uid[j]), "w": pd.array([None] * len(i), dtype="Int64")})
    near = pd.DataFrame({"a": uid[i], "b": uid[j], "w": bits}).sort_values("w", kind="stable").groupby("a").head(PARTNERS)
    return pd.concat([near, pd.DataFrame({"a": uid[more], "b": uid[more], "w": None})]).astype({"w": "Int64"})


def block(uid: str) -> Column:
    return F.shiftright(uid, 6)


def is_few(rows: DataFrame, uid: str) -> bool:
    """Whether any choice of these rows can be broadcast by picked()."""
    return rows.select(block(uid)).distinct().count() <= BLOCKS


def picked(rows: DataFrame, chosen: DataFrame, uid: str, few: bool) -> DataFrame:
    """The rows whose number is in chosen (uid, repeats allowed). If the blocks are few, chosen numbers are sent to the rows
    as bits, so that texts stay where they are; else rows and numbers are shuffled."""
    if not few:
        return rows.join(chosen.distinct(), uid, "left_semi")
    place = F.col(uid).bitwiseAND(63).cast("int")
    bits = chosen.groupBy(block(uid).alias("__block")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place)).alias("__bits"))
    return rows.join(F.broadcast(bits), (block(uid) == F.col("__block")) & (F.getbit("__bits", place) == 1), "left_semi")


def near_groups(docs: DataFrame, least: float = LEAST, subtrie: int = SUBTRIE) -> DataFrame:
    """(uid long distinct, text) -> uid, group: the smallest uid that links of similarity `least` reach.

    Texts of the same words are one class; classes meet in subtries. First each is looked at with its partners if they are
    few, else with one; those with more are then looked at with what links leave apart, the likeliest first. A
    subtrie in which very many fingerprints agree is cut into parts by hash, and each two of its parts are a group of
    work. least is 0.8 or more. Null, empty and blank texts are one class.
    """
    docs = docs.select("uid", F.col("text").cast("string").alias("text"))
    sk = stored(sketches(docs))
    total, few_blocks = sk.count(), is_few(sk, "uid")
    classes = stored(sk.groupBy("h1", "h2").agg(F.min("uid").alias("class"), F.count(F.lit(1)).alias("__n")))
    of = stored(with_class(sk.select("uid", "h1", "h2"), classes, ["h1", "h2"], "__n", total).select("uid", "class"))
    one = of.filter("uid = class").select("uid")
    n_classes = classes.count()
    depth = int(np.ceil(np.log2(n_classes / subtrie))) if n_classes > subtrie else 0
    leading = orders(depth)

    def at_home(batches):
        for pdf in batches:
            fp = prints(pdf)
            yield pd.DataFrame({"uid": pdf["uid"], "n": pdf["n"], "fp": pdf["fp"], "homes": list(np.stack([homes(fp, o) for o in leading], axis=1))})

    at = stored(sk.select("uid", "n", "fp").join(one, "uid", "left_semi").mapInPandas(at_home, "uid long, n long, fp binary, homes array<long>"))

    def dealt(rows: DataFrame) -> DataFrame:
        """A row for each order and part that a fingerprint meets."""
        sent = rows.select("*", F.posexplode("homes").alias("trie", "home")).drop("homes")
        parts = F.lit(1)
        if n_crowded := crowded.count():
            sent = sent.join(F.broadcast(crowded) if n_crowded <= FEW else crowded, ["trie", "home"], "left")
            parts = F.coalesce("parts", F.lit(1))
        sent = sent.withColumn("part", F.pmod(F.xxhash64("uid"), parts.cast("long"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1)))
        sent = sent.withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")}).drop("other", "parts")
        return sent.repartition(max(16, len(leading) << min(depth, 12)), *keys).groupBy(*keys)

    keys = ["trie", "home", "low", "high"]
    sizes = at.select(F.posexplode("homes").alias("trie", "home")).groupBy("trie", "home").count()
    crowded = stored(sizes.filter(F.col("count") > CROWDED // 4 * subtrie).select("trie", "home", F.ceil(F.col("count") / subtrie).alias("parts")))
    schema = "a long, b long, w long"
    found = stored(dealt(at).applyInPandas(lambda key, pdf: first_pairs(pdf, int(key[2]), int(key[3]), least), schema))
    tried = None

    def settle(pairs: DataFrame) -> DataFrame:
        """Looks at pairs not looked at before -> node, root by all links found so far."""
        nonlocal tried
        pairs = pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti")
        pairs = stored(pairs)
        sides = pairs.select(F.explode(F.array("a", "b")).alias("uid"))
        seen = stored(close(pairs, stored(picked(docs, sides, "uid", few_blocks)), least))
        tried = seen if tried is None else tried.unionByName(seen)
        return stored(components(tried.filter("near").select("a", "b")))

    def later(best: bool):
        return lambda key, pdf: later_pairs(pdf, int(key[2]), int(key[3]), leading[: int(key[0])], least, best)

    many = found.filter("w is not null").groupBy("a").agg(F.max_by("b", F.struct("w", "b")).alias("b"))
    joined = settle(found.filter("w is null").select("a", "b").union(many))
    left = many.select(F.col("a").alias("uid"))
    for best in (True, False):
        rows = at.join(left, "uid", "left_semi").join(joined.withColumnRenamed("node", "uid"), "uid", "left")
        rows = stored(rows.withColumn("root", F.coalesce("root", "uid")))
        if rows.agg(F.min("root") == F.max("root")).first()[0] is not False:
            break
        if not best:
            rows = rows.join(lowest(picked(docs, rows.select("uid"), "uid", few_blocks)).withColumnRenamed("low", "lowest"), "uid")
        found = stored(dealt(rows).applyInPandas(later(best), schema))
        if not found.limit(1).count():
            break
        few = found.filter("a <> b")
        if best:  # the nearest of what the subtries have found
            few = few.groupBy("a").agg(F.slice(F.array_sort(F.collect_set(F.struct("w", "b"))), 1, PARTNERS).alias("x")).select("a", F.explode("x.b").alias("b"))
        joined = settle(few)
        left = found.filter("a = b").select(F.col("a").alias("uid"))
    return of.join(joined, F.col("class") == F.col("node"), "left").select("uid", F.coalesce("root", "class").alias("group"))


def keep_one(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """One row of each group of near-copies: that with the smallest doc_id (null last), and of rows that share it any
    one. Columns stay as they were. Null, empty and blank texts are one group; an empty table gives no rows."""
    d = stored(docs.select(F.struct("*").alias("__row"), F.monotonically_increasing_id().alias("__uid")))
    with small_batches(d.sparkSession):  # what is left for later runs no Python
        groups = near_groups(d.select(F.col("__uid").alias("uid"), F.col("__row.text").alias("text")), least)
    named = d.select("__uid", F.col("__row.doc_id").alias("__id")).join(groups.select(F.col("uid").alias("__uid"), "group"), "__uid")
    stay = named.groupBy("group").agg(F.min(F.struct(F.col("__id").isNull(), "__id", "__uid"))["__uid"].alias("__uid"))
    return picked(d, stay.select("__uid"), "__uid", is_few(d, "__uid")).select("__row.*")
