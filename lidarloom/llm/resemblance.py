"""Near-copies by resemblance: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Banded minima propose pairs, the texts themselves decide. Two texts of similarity j share no band with probability
(1 - j^ROWS)^BANDS: 4.7e-8 at j = 0.8, less above. In crowded bands a pair must also agree in AGREE of all BANDS * ROWS
minima, which a pair at 0.8 fails with probability 1e-7, and where a text has more than LOWEST shingles, in as many of
its lowest ones as SLACK standard deviations below 0.8 would bring (3e-6). Nothing else is left to chance.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, with_class
from .components import components
from .simhash import LOWER, SEED

SIZE = 5
LEAST = 0.8
BANDS, ROWS = 32, 4
#: Texts up to which a band's texts simply meet each other; of more, those still apart meet by their minima.
SMALL = 32
#: Of BANDS * ROWS minima a pair in a crowded band agrees in so many at least.
AGREE = 77
#: Texts of a crowded band that a task holds on either side; partners that each first tries; bytes compared at once.
BLOCK = 1024
BEST = 4
#: Of a text in a crowded band the lowest shingles that a task looks at: all of them, if it has no more.
LOWEST = 256
SLACK = 4.5
COMPARED = 1 << 26
ODD = np.random.default_rng(SEED).integers(0, 1 << 64, (3, BANDS * ROWS), dtype=np.uint64) | np.uint64(1)
#: Words whose hash a task keeps.
HELD = 1 << 18


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh64_intdigest(word, SEED)
        if len(self) < HELD:
            self[word] = value
        return value


def words_of(text: str | None) -> list[bytes]:
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").translate(LOWER).encode())


def mixed(h: np.ndarray) -> np.ndarray:
    for k in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(k)
    return h ^ (h >> np.uint64(33))


def shingles(words: list[bytes], known: WordHashes, size: int = SIZE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `size` words; fewer words make one run, none give an empty set."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(size, len(h))
    runs = np.zeros(len(h) - size + 1, dtype=np.uint64)
    for k in range(size):
        runs = (runs + h[k : k + len(runs)]) * ODD[0, k]
    return np.unique(mixed(runs))


def minima(runs: np.ndarray) -> np.ndarray:
    """BANDS * ROWS minima, each under an order of the set of its own. The empty set has minima of its own."""
    least = np.full(BANDS * ROWS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for part in np.array_split(runs, len(runs) // 512 + 1):
        if len(part):
            least = np.minimum(least, (part[None, :] * ODD[0][:, None] + ODD[1][:, None]).min(axis=1))
    return least


def bands(least: np.ndarray) -> np.ndarray:
    """One hash for each band of ROWS minima."""
    rows = least.reshape(BANDS, ROWS)
    out = np.zeros(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        out = mixed((out + rows[:, k]) * ODD[2, k])
    return out


def sketches(docs: DataFrame) -> DataFrame:
    """(uid, text) -> uid, h1, h2: the words' 128-bit hash, n: distinct shingles, bands, minima: a byte of each."""

    def run(batches):
        import xxhash

        known = WordHashes()
        for pdf in batches:
            rows = []
            for uid, text in zip(pdf["uid"], pdf["text"], strict=True):
                words = words_of(text)
                whole = np.frombuffer(xxhash.xxh128_digest(b" ".join(words), SEED), dtype=np.int64)
                runs = shingles(words, known)
                least = minima(runs)
                rows.append((uid, int(whole[0]), int(whole[1]), len(runs), bands(least).view(np.int64), mixed(least).astype(np.uint8).tobytes()))
            yield pd.DataFrame(rows, columns=["uid", "h1", "h2", "n", "bands", "minima"])

    return docs.mapInPandas(run, "uid long, h1 long, h2 long, n long, bands array<long>, minima binary")


def close(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """pairs (a, b) of texts (uid, text) -> a, b, near: whether their similarity is at least `least`, from the texts."""

    def run(batches):
        known = WordHashes()
        for pdf in batches:
            near, last, x = [], None, None
            for s, t in zip(pdf["s"], pdf["t"], strict=True):
                if s != last:
                    last, x = s, shingles(words_of(s), known)
                y = shingles(words_of(t), known)
                both = len(np.intersect1d(x, y, assume_unique=True))
                near.append(both >= least * (len(x) + len(y) - both))
            yield pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "near": near})

    side = lambda key, name: texts.select(F.col("uid").alias(key), F.col("text").alias(name))
    met = pairs.join(side("b", "t"), "b").join(side("a", "s"), "a").select("a", "b", "s", "t")
    return met.mapInPandas(run, "a long, b long, near boolean")


def lowest(texts: DataFrame) -> DataFrame:
    """(uid, text) -> uid, low: the lowest of its shingles' hashes in order, 32 bits of each."""

    def run(batches):
        known = WordHashes()
        for pdf in batches:
            low = [(shingles(words_of(t), known)[:LOWEST] >> np.uint64(32)).astype("<u4").tobytes() for t in pdf["text"]]
            yield pd.DataFrame({"uid": pdf["uid"], "low": low})

    return texts.mapInPandas(run, "uid long, low binary")


def alike(x: np.ndarray, y: np.ndarray, n: int, m: int, least: float) -> bool:
    """Whether texts of n and m shingles with these lowest ones can be of similarity `least`: exact if they are all."""
    if n <= LOWEST and m <= LOWEST:
        both = len(np.intersect1d(x, y, assume_unique=False))
        return both >= least * (n + m - both)
    # the lowest of the union are the lowest of both lists; which of them are in both is a sample of the union
    union = np.union1d(x, y)[:LOWEST]
    both = int((np.isin(union, x) & np.isin(union, y)).sum())
    return both >= least * len(union) - SLACK * (least * (1 - least) * len(union)) ** 0.5


def agreeing(band: int, u: pd.DataFrame, v: pd.DataFrame, least: float, best: int | None):
    """Rows of u and of v whose texts may be near: still apart, of fitting sizes, with enough minima in common, and
    this band the first that they share, so a pair comes once. best: only so many of v for each of u, by minima. The
    first band is that of the bands' own hashes, by which texts meet, not of the bytes kept of their minima: those agree
    by chance now and then, and a pair would wait for a band in which it never meets."""
    held = lambda df: np.frombuffer(b"".join(df["minima"]), np.uint8).reshape(len(df), -1)
    s, t = held(u), held(v)
    hashes_u, hashes_v = (np.stack(df["bands"].to_list()) for df in (u, v))
    uid, root, n = (v[c].to_numpy() for c in ("uid", "root", "n"))
    main = v["main"].to_numpy() == root
    for part in np.array_split(np.arange(len(u)), s.shape[1] * len(u) * len(v) // COMPARED + 1):
        if not len(part):
            continue
        own, own_root, own_n = (u[c].to_numpy()[part] for c in ("uid", "root", "n"))
        same = s[part][:, None, :] == t[None, :, :]
        agree = same.sum(-1, dtype=np.int32)
        ok = (agree >= AGREE) & (own_root[:, None] != root) & (main | (own[:, None] < uid))
        ok &= np.minimum(own_n[:, None], n) >= least * np.maximum(own_n[:, None], n)
        i, j = np.nonzero(ok)
        for some in np.array_split(np.arange(len(i)), len(i) // (COMPARED // BANDS) + 1):
            late = (hashes_u[part[i[some]]] == hashes_v[j[some]]).argmax(-1) != band
            ok[i[some[late]], j[some[late]]] = False
        if best is not None and best < len(v):
            rank = np.where(ok, -agree, 1)
            near = np.argpartition(rank, best, axis=1)[:, :best]
            few = np.zeros_like(ok)
            np.put_along_axis(few, near, True, axis=1)
            ok &= few
        i, j = np.nonzero(ok)
        if best is None:
            low = lambda df: [np.frombuffer(b, "<u4") for b in df["low"]]
            x, y = low(u.iloc[part]), low(v)
            near = np.array([alike(x[a], y[b], int(own_n[a]), int(n[b]), least) for a, b in zip(i.tolist(), j.tolist(), strict=True)], dtype=bool)
            i, j = i[near], j[near]
        yield own[i], uid[j]


def crowded_pairs(posted: DataFrame, sketch: DataFrame, root: DataFrame, least: float, best: int | None, block: int) -> DataFrame:
    """posted (uid, band, h) of crowded bands, sketch (uid, n, bands, minima; low unless best), root (uid, root) -> a, b: pairs
    to look at.

    In each band those that are not in its largest group meet all of the band. Both sides come in blocks, so a task
    holds `block` or so of either; for the `best` partners a text's own block will do.
    """
    now = posted.select("uid", "band", "h").join(root, "uid")
    groups = now.groupBy("band", "h", "root").agg(F.count(F.lit(1)).alias("c"))
    groups = groups.groupBy("band", "h").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.sum("c").alias("__n"), (F.sum("c") - F.max("c")).alias("__left"))
    groups = stored(groups.filter("__left > 0"))
    total = groups.agg(F.sum("__n")).first()[0] or 0
    now = with_class(now, groups, ["band", "h"], "__n", total).join(sketch, "uid")
    of = lambda n: F.ceil(F.col(n) / block).cast("long")
    part = lambda salt, n: F.pmod(F.xxhash64("uid", F.lit(salt)), of(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), of(n) - 1))
    keep = ["uid", "band", "h", "root", "main", "n", "bands", "minima", *([] if best else ["low"])]
    left = now.filter("root <> main").select(*keep, part(0, "__left").alias("i"), (part(1, "__n") if best else every("__n")).alias("j"))
    right = now.select(*[F.col(c).alias(c) for c in keep], part(1, "__n").alias("j"), every("__left").alias("i"))

    def meet(key, u: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        if len(u) and len(v):
            found += agreeing(int(key[0]), u, v, least, best)
        x, y = (np.concatenate(p) for p in zip(*found, strict=True))
        return pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    keys = ["band", "h", "i", "j"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, "a long, b long")


def near_groups(docs: DataFrame, least: float = LEAST, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """(uid long distinct, text) -> uid, group: the smallest uid that links of similarity `least` reach.

    Texts of the same words are one class. Classes that share a band are proposed to each other where their numbers of
    shingles allow the similarity, in four steps, each for those that the links found so far leave apart: all meet the
    one of their band that shares most bands with others, so a group of n copies of one text takes n comparisons; in
    bands of up to `small` all meet; in crowded ones each first tries its few likeliest partners, and then all that its
    minima and lowest shingles allow. No pair that shares a band stays undecided. Null, empty and blank texts are one class.
    """
    sk = stored(sketches(docs.select("uid", F.col("text").cast("string").alias("text"))))
    total = sk.count()
    classes = stored(sk.groupBy("h1", "h2").agg(F.min("uid").alias("class"), F.count(F.lit(1)).alias("__n")))
    of = stored(with_class(sk.select("uid", "h1", "h2"), classes, ["h1", "h2"], "__n", total).select("uid", "class"))
    posted = stored(sk.join(of.filter("uid = class").select("uid"), "uid", "left_semi").select("uid", "n", F.posexplode("bands").alias("band", "h")))
    shared = stored(posted.groupBy("band", "h").agg(F.count(F.lit(1)).alias("__c")).filter("__c > 1"))
    n_posted = posted.count()
    posted = stored(with_class(posted, shared, ["band", "h"], "__c", n_posted))
    posted = stored(posted.join(posted.groupBy("uid").agg(F.sum("__c").alias("known")), "uid"))
    members = stored(posted.select("uid").distinct())
    texts = stored(docs.join(members, "uid", "left_semi").select("uid", F.col("text").cast("string").alias("text")))
    sketch = sk.select("uid", "n", "bands", "minima")
    root, tried = members.select("uid", F.col("uid").alias("root")), None
    fits = F.least("n", "m") >= F.lit(least) * F.greatest("n", "m")

    def settle(pairs: DataFrame) -> DataFrame:
        """Looks at pairs (a, b) not looked at before -> node, root by all links found so far."""
        nonlocal root, tried
        pairs = pairs.distinct()
        if tried is not None:
            pairs = pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti")
        found = stored(close(pairs, texts, least))
        tried = found if tried is None else tried.unionByName(found)
        joined = stored(components(tried.filter("near").select("a", "b")))
        root = members.join(joined, F.col("uid") == F.col("node"), "left").select("uid", F.coalesce("root", "uid").alias("root"))
        return joined

    pair = [F.least("uid", "v").alias("a"), F.greatest("uid", "v").alias("b")]
    stars = posted.groupBy("band", "h").agg(F.max_by(F.struct(F.col("uid").alias("v"), F.col("n").alias("m")), F.struct("known", "uid")).alias("f"), F.count(F.lit(1)).alias("__n"))
    stars = stored(stars.select("band", "h", "f.v", "f.m", "__n"))
    settle(with_class(posted, stars, ["band", "h"], "__n", n_posted).filter("uid <> v").filter(fits).select(*pair))
    few = posted.filter(F.col("__c") <= small).select("uid", "n", "band", "h").join(root, "uid")
    other = few.select("band", "h", F.col("uid").alias("v"), F.col("n").alias("m"), F.col("root").alias("r"))
    joined = settle(few.join(other, ["band", "h"]).filter("uid < v and root <> r").filter(fits).select(*pair))
    crowd = posted.filter(F.col("__c") > small)
    if crowd.limit(1).count():
        joined = settle(crowded_pairs(crowd, sketch, root, least, BEST, block))
        low = stored(lowest(texts.join(crowd.select("uid").distinct(), "uid", "left_semi")))
        joined = settle(crowded_pairs(crowd, sketch.join(low, "uid"), root, least, None, block))
    return of.join(joined, F.col("class") == F.col("node"), "left").select("uid", F.coalesce("root", "class").alias("group"))


def keep_one(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """One row of each group of near-copies: that with the smallest doc_id (null last), and of rows that share it any
    one. Columns stay as they were. Null, empty and blank texts are one group; an empty table gives no rows."""
    d = stored(docs.select(F.struct("*").alias("__row"), F.monotonically_increasing_id().alias("__uid")))
    groups = near_groups(d.select(F.col("__uid").alias("uid"), F.col("__row.text").alias("text")), least)
    named = d.select("__uid", F.col("__row.doc_id").alias("__id")).join(groups.select(F.col("uid").alias("__uid"), "group"), "__uid")
    stay = named.groupBy("group").agg(F.min(F.struct(F.col("__id").isNull(), "__id", "__uid"))["__uid"].alias("__uid"))
    return d.join(stay.select("__uid"), "__uid", "left_semi").select("__row.*")
