"""SimHash near-duplicates: fingerprints, and a self-join of the binary trie that they form."""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .common import stored, with_class

SHINGLE = 4
ERRORS = 4
BITS = 64
SEED = 42
LOWER = {k: k + 32 for k in range(65, 91)}
HALF = BITS // 2
#: Fingerprints that one subtrie is to hold; their number sets how many leading bits part the work. Subtries of CROWDED
#: times as many are walked in parts.
SUBTRIE = 32768
CROWDED = 8
#: Subtries to walk in parts that are few enough to broadcast.
FEW = 100_000
#: Node pairs that are held at once, and edges that are held before they are reduced to a forest.
PAIRS = 1 << 19
EDGES = 1 << 20
LEAF = 24


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """64 bits: bit k is 1 if it is set in over half the XXH64 (seed 42) of the text's shingles of `size` words, repeats
    included. Fewer words make one shingle; none give 0."""
    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").translate(LOWER).encode())
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: 1 - size].tolist(), ends[size - 1 :].tolist(), strict=True)]
    return over_half(np.array(hashes, dtype=np.uint64))


def over_half(hashes: np.ndarray) -> int:
    set_bits = np.zeros(BITS, dtype=np.int64)
    for part in np.array_split(hashes, len(hashes) // 8192 + 1):
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += bits.sum(axis=0, dtype=np.int64)
    return int(sum(1 << k for k in np.flatnonzero(2 * set_bits > len(hashes)).tolist()))


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, text) -> doc_id, fp: the fingerprint as a signed 64-bit number."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            fp = np.array([fingerprint(t, size) for t in pdf["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fp": fp})

    ids = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return ids.mapInPandas(run, "doc_id string, fp long").withColumn("doc_id", F.col("doc_id").cast(kind))


@dataclass(frozen=True)
class Trie:
    """An order of a fingerprint's bits: some blocks of one half, then what else that half has, then the other half.

    Links whose errors are few enough in that half, and none in those blocks, are those that this trie is to find.
    """

    order: tuple[int, ...]
    exact: int

    def key(self, fp: np.ndarray) -> np.ndarray:
        """Fingerprints with their bits in this order, the first in the highest place."""
        out, one = np.zeros(len(fp), dtype=np.uint64), np.uint64(1)
        for bit in self.order:
            out = (out << one) | ((fp >> np.uint64(bit)) & one)
        return out

    def budget(self, depth: int, errors: int) -> int:
        """Errors that a pair may have in its first depth + 1 bits."""
        return 0 if depth < self.exact else errors // 2 if depth < HALF else errors


def tries(depth: int, errors: int = ERRORS) -> list[Trie]:
    """Tries that find all links between them, each with `depth` leading bits or more in which links don't differ.

    Of the two halves one has at most half the errors. Cut into more blocks than it has errors, it has blocks without
    any: for each choice of those there is a trie. The fewest blocks whose free ones have `depth` bits are taken, at most
    as many as leave a bit for each.
    """
    most = errors // 2
    blocks = max(most, 1)
    while blocks < HALF and min_bits(blocks, most) < depth:
        blocks += 1
    out = []
    for half in (range(BITS - 1, HALF - 1, -1), range(HALF - 1, -1, -1)):
        other = [b for b in range(BITS - 1, -1, -1) if b not in half]
        cut = [c.tolist() for c in np.array_split(np.array(half), blocks)]
        for free in combinations(range(blocks), blocks - most):
            first = [b for k in free for b in cut[k]]
            out.append(Trie((*first, *(b for b in half if b not in first), *other), len(first)))
    return out


def min_bits(blocks: int, errors: int) -> int:
    """Bits that the blocks of a half have, at least, that `errors` errors leave free."""
    return sum(sorted(len(c) for c in np.array_split(np.arange(HALF), blocks))[: blocks - errors])


def trie_links(a: np.ndarray, b: np.ndarray, same: bool, trie: Trie, errors: int = ERRORS):
    """Pairs of equal-or-close keys between two sorted arrays of distinct keys (the leaves of two subtries).

    Node pairs of the two tries are walked down together, bit by bit. A node is the range of keys below it. The bits in
    which a pair's paths differ add up; a pair is dropped when they exceed the trie's budget at that depth: none within
    its free blocks, half of the errors within its first half, all of them after.
    Ranges that are small enough are compared outright. At most PAIRS or so node pairs are held, depth first.
    Yields (index in a, index in b); same: a is b, and each unordered pair comes once.
    """
    if not len(a) or not len(b):
        return
    start = np.array([[0, len(a), 0, len(b), 0]], dtype=np.int64)
    stack = [(start, 0)]
    while stack:
        nodes, depth = stack.pop()
        if len(nodes) > PAIRS:
            half = len(nodes) // 2
            stack += [(nodes[half:], depth), (nodes[:half], depth)]
            continue
        small = (nodes[:, 1] - nodes[:, 0]) * (nodes[:, 3] - nodes[:, 2]) <= LEAF
        if depth == BITS:
            small[:] = True
        yield from compared(a, b, nodes[small], same, errors)
        nodes = nodes[~small]
        if not len(nodes):
            continue
        bit = np.uint64(BITS - 1 - depth)
        a_mid, b_mid = split(a, nodes[:, 0], nodes[:, 1], bit), split(b, nodes[:, 2], nodes[:, 3], bit)
        lo_a, hi_a, lo_b, hi_b, e = nodes.T
        budget = trie.budget(depth, errors)
        twin = same & (lo_a == lo_b) & (hi_a == hi_b)
        children = [np.stack([lo_a, a_mid, lo_b, b_mid, e], 1), np.stack([a_mid, hi_a, b_mid, hi_b, e], 1)]
        more = e < budget
        children.append(np.stack([lo_a, a_mid, b_mid, hi_b, e + 1], 1)[more])
        children.append(np.stack([a_mid, hi_a, lo_b, b_mid, e + 1], 1)[more & ~twin])
        nodes = np.concatenate(children)
        stack.append((nodes[(nodes[:, 0] < nodes[:, 1]) & (nodes[:, 2] < nodes[:, 3])], depth + 1))


def split(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.uint64) -> np.ndarray:
    """Where in keys[lo:hi], all alike above `bit`, that bit turns to 1."""
    some = lo < hi
    first = np.zeros(len(lo), dtype=np.uint64)
    first[some] = keys[lo[some]]
    one = np.uint64(1)
    wanted = ((first >> bit) | one) << bit
    return np.minimum(np.maximum(np.searchsorted(keys, wanted), lo), hi)


def compared(a: np.ndarray, b: np.ndarray, nodes: np.ndarray, same: bool, errors: int):
    for part in np.array_split(nodes, len(nodes) // (PAIRS // 4) + 1):
        width = part[:, 3] - part[:, 2]
        count = (part[:, 1] - part[:, 0]) * width
        which = np.repeat(np.arange(len(part)), count)
        k = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        i, j = part[which, 0] + k // width[which], part[which, 2] + k % width[which]
        near = np.bitwise_count(a[i] ^ b[j]) <= errors
        if same:
            near &= i < j
        if near.any():
            yield i[near], j[near]


def forest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few edges as keep together what edges (x, y) keep together: each node to its component's least."""
    nodes, flat = np.unique(np.concatenate([x, y]), return_inverse=True)
    u, v = flat[: len(x)], flat[len(x) :]
    root = np.arange(len(nodes))
    while True:
        ru, rv = root[u], root[v]
        apart = ru != rv
        if not apart.any():
            break
        u, v, ru, rv = u[apart], v[apart], ru[apart], rv[apart]
        np.minimum.at(root, np.maximum(ru, rv), np.minimum(ru, rv))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    out = root != np.arange(len(nodes))
    return nodes[root[out]], nodes[out]


def linked(a: np.ndarray, b: np.ndarray, same: bool, trie: Trie, errors: int) -> pd.DataFrame:
    """Forest edges (a, b) of the links between the fingerprints of two subtries."""
    ka, kb = trie.key(a), trie.key(b)
    oa, ob = np.argsort(ka), np.argsort(kb)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0
    for i, j in trie_links(ka[oa], kb[ob], same, trie, errors):
        held.append((a[oa[i]], b[ob[j]]))
        n += len(i)
        if n >= EDGES:
            held = [forest(*(np.concatenate(x) for x in zip(*held, strict=True)))]
            n = len(held[0][0])
    none = np.zeros(0, dtype=np.uint64)
    x, y = forest(*(np.concatenate(v) for v in zip(*held, strict=True))) if held else (none, none)
    return pd.DataFrame({"a": x.view(np.int64), "b": y.view(np.int64)})


def near_links(distinct: DataFrame, errors: int = ERRORS, subtrie: int = SUBTRIE) -> DataFrame:
    """(fp long) distinct -> (a, b): links that join all fingerprints within `errors` bits of each other, as forests.

    A fingerprint goes once to each of the tries, to the subtrie of its p leading bits, in which links of that trie don't
    differ; so a subtrie is a group of work that needs no other. With 4 errors there are 2 tries up to SUBTRIE
    fingerprints, 6 while p is at most 10, and 30 for p = 20, at some 3 * 10^10 fingerprints. A subtrie in which very
    many fingerprints agree is cut into parts by hash, and each two of its parts are a group.
    """
    n = distinct.count()
    p = int(np.ceil(np.log2(n / subtrie))) if n > subtrie else 0
    all_tries = tries(p, errors)
    p = min(p, min(t.exact for t in all_tries))

    def send(batches):
        for pdf in batches:
            fp = pdf["fp"].to_numpy().view(np.uint64)
            for k, t in enumerate(all_tries):
                home = (t.key(fp) >> np.uint64(BITS - p)).astype(np.int64) if p else np.zeros(len(fp), dtype=np.int64)
                yield pd.DataFrame({"trie": np.int32(k), "home": home, "fp": fp.view(np.int64)})

    def meet(key, pdf):
        fp, part = pdf["fp"].to_numpy().view(np.uint64), pdf["part"].to_numpy()
        low, high = int(key[2]), int(key[3])
        mine = fp[part == low]
        return linked(mine, mine if low == high else fp[part == high], low == high, all_tries[int(key[0])], errors)

    sent = distinct.select("fp").mapInPandas(send, "trie int, home long, fp long")
    parts = F.lit(1)
    if p:  # without leading bits there is one subtrie a trie, of at most `subtrie` fingerprints
        crowded = stored(sent.groupBy("trie", "home").count().filter(F.col("count") > CROWDED * subtrie).select("trie", "home", F.ceil(F.col("count") / subtrie).alias("parts")))
        if n_crowded := crowded.count():
            sent = sent.join(F.broadcast(crowded) if n_crowded <= FEW else crowded, ["trie", "home"], "left")
            parts = F.coalesce("parts", F.lit(1))
    part = F.pmod(F.xxhash64("fp"), parts.cast("long"))
    sent = sent.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1)))
    sent = sent.select("trie", "home", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "fp")
    groups = max(16, len(all_tries) << min(p, 14))
    return sent.repartition(groups, "trie", "home", "low", "high").groupBy("trie", "home", "low", "high").applyInPandas(meet, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, errors: int = ERRORS, subtrie: int = SUBTRIE) -> DataFrame:
    """(doc_id, text) -> doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id that links reach.

    Documents link if their fingerprints differ in at most `errors` bits. Copies share a fingerprint, so the join and
    the components work on distinct fingerprints only, and a group of any size is one trie leaf.

    Null, empty and blank texts have fingerprint 0 and link like others. Rows with a null doc_id get their
    fingerprint; they hold groups together and never name one unless no row of the group has an id. Repeated rows stay.
    An empty table gives no rows. Columns besides doc_id and text don't take part.
    """
    fps = stored(fingerprints(docs, size))
    classes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    found = components(near_links(classes, errors, subtrie))  # node, root: fingerprints that have a link
    linked_classes = stored(found.join(classes, found["node"] == classes["fp"]).select("root", "fp", "least"))
    named = stored(linked_classes.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("__n")))
    total, n_linked = classes.agg(F.sum("n")).first()[0] or 0, linked_classes.count()
    of_class = with_class(linked_classes.select("root", "fp"), named, ["root"], "__n", n_linked).select("fp", "component_id")
    classes = stored(classes.join(of_class, "fp", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id")))
    out = with_class(fps, classes, ["fp"], "n", total)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, size: int = SHINGLE, errors: int = ERRORS) -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest doc_id (null last), and of rows that share it
    any one. Columns stay as they were. Null, empty and blank texts are one group, and near others of fingerprint 0; an
    empty table gives no rows."""
    d = stored(docs.select(F.struct("*").alias("__row"), F.monotonically_increasing_id().alias("__uid")))
    groups = near_duplicates(d.select(F.col("__uid").alias("doc_id"), F.col("__row.text").alias("text")), size, errors)
    named = d.select("__uid", F.col("__row.doc_id").alias("__id")).join(groups.select(F.col("doc_id").alias("__uid"), "component_id"), "__uid")
    stay = named.groupBy("component_id").agg(F.min(F.struct(F.col("__id").isNull(), "__id", "__uid"))["__uid"].alias("__uid"))
    return d.join(stay.select("__uid"), "__uid", "left_semi").select("__row.*")
