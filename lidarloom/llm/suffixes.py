"""Repeated byte strings by merging shard Burrows-Wheeler transforms.

The plan, for strings of LENGTH bytes (a window is such a string at one place):

1. units: every window is keyed by the least hash of its KEY-byte grams, which its content alone decides; a unit is a
   run of neighbouring windows with one key. A key that occurs in one unit only has no repeated window. Copies of a
   whole unit are reduced to the first. What is left are different units with a common key: there, and only there, it
   is open which windows repeat.
2. transforms: the open units are strings over an alphabet of SYMBOL-byte grams, read in steps of SYMBOL bytes. Each
   shard sorts its own suffixes and keeps its Burrows-Wheeler transform; the shards are merged by refining their
   interleave, symbol by symbol, from the transforms alone. The round in which two neighbours part gives their common
   prefix; runs of common prefixes of LENGTH are the repeated intervals, and all but the first window of each go.
3. spans: windows become byte spans, and spans of a document are merged and cut out of its text.

Tasks get bounded pieces: units go by key, or, for keys with very many different units, by unit and then window by
window; documents go by id. Between tasks columns travel as packed arrays.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

LENGTH = 100
KEY = 50
SYMBOL = 25
STEPS = LENGTH // SYMBOL
#: Text that is hashed at once; text whose units are held at once; text a group of tasks' work holds; open windows that
#: a merge holds.
SLAB = 1 << 19
CHUNK = 4 << 20
GROUP_BYTES = 8 << 20
MERGE_WINDOWS = 100_000
SHARDS = 8
#: Different units of one key in one chunk, or in one group, from which the key's units are dealt out.
SALT, HOT = 64, 2000
#: Windows of a unit at most: its first and last window then cover it.
UNIT = 100
#: Added to a unit's number of windows where some of them can be alike.
LOOPS = 128
NO_ID = np.int64(2**63 - 1)

U = np.uint64
BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A well-mixed number for each number."""
    x = x ^ (x >> U(31))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(29)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(32))


BYTES = mix(np.arange(1, 257, dtype=np.uint64) * U(BASE)) | U(1)


def power(n: int) -> np.uint64:
    return U(pow(BASE, n, 1 << 64))


def doubled(data: np.ndarray, most: int) -> dict[int, np.ndarray]:
    """Hashes of all grams of 1, 2, 4 ... up to `most` bytes."""
    out, n = {1: BYTES[data]}, 1
    while 2 * n <= most:
        h = out[n]
        out[2 * n] = h[:-n] * power(n) + h[n:] if len(h) > n else h[:0]
        n *= 2
    return out


def grams(parts: dict[int, np.ndarray], n: int) -> np.ndarray:
    """Hashes of all n-byte grams, put together from those of powers of two."""
    at, out = 0, None
    for k in sorted(parts, reverse=True):
        if n - at >= k:
            h = parts[k][at:]
            if out is None:
                out = h
            else:
                m = min(len(out), len(h))
                out = out[:m] * power(k) + h[:m]
            at += k
    return out


def least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` neighbours."""
    n = 1
    while 2 * n <= width:
        x = np.minimum(x[:-n], x[n:]) if len(x) > n else x[:0]
        n *= 2
    r = width - n
    return (np.minimum(x[:-r], x[r:]) if len(x) > r else x[:0]) if r else x


def units(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """data: texts end to end; ends: where each ends. -> text, start in it, windows, key, hash of each unit, and whether
    windows of one unit can be alike.

    Two windows of a unit are alike only where the text repeats in steps shorter than a unit. Then some window of the
    unit starts with its least gram, and the next window, which has that gram behind it, has it once more.
    """
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, U), np.zeros(0, bool))
    if len(data) < LENGTH:
        return none
    starts = np.concatenate([[0], ends[:-1]])
    parts = doubled(data, 64)
    own_gram = mix(grams(parts, KEY))
    keys = least(own_gram, LENGTH - KEY + 1)
    valid = np.zeros(len(keys) + 1, dtype=np.int8)
    has = ends - starts >= LENGTH
    if not has.any():
        return none
    np.add.at(valid, starts[has], 1)
    np.add.at(valid, ends[has] - LENGTH + 1, -1)
    valid = np.cumsum(valid[:-1]) > 0
    first = valid.copy()
    first[1:] &= keys[1:] != keys[:-1]
    first[starts[has]] = True
    at = np.flatnonzero(first)
    text = np.searchsorted(ends, at, side="right")
    stop = np.minimum(np.append(at[1:], len(keys)), ends[text] - LENGTH + 1)
    n = stop - at
    if (n > UNIT).any():
        pieces = -(-n // UNIT)
        k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at, text, stop = np.repeat(at, pieces) + k * UNIT, np.repeat(text, pieces), np.repeat(stop, pieces)
        n = np.minimum(stop - at, UNIT)
    again = np.concatenate([[0], np.cumsum((keys[1:] == keys[:-1]) & (own_gram[: len(keys) - 1] == keys[:-1]))])
    loops = again[at + n - 1] > again[at]
    whole = grams(parts, LENGTH)
    own = mix(mix(whole[at] + U(1)) + whole[at + n - 1] * U(3) + n.astype(U))
    return text, at - starts[text], n, keys[at], own, loops


def packed(**columns: np.ndarray) -> bytes:
    """Equally long arrays as one compressed value; bytes of equal weight stand together, ids and places as steps."""
    out = [np.int64(len(next(iter(columns.values())))).tobytes()]
    for x in columns.values():
        x = np.ascontiguousarray(x)
        if x.dtype == np.int64:
            x = np.diff(x, prepend=np.int64(0))
        out.append(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes())
    raw = b"".join(out)
    return np.int64(len(raw)).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def opened(blob: bytes, **kinds: type) -> dict[str, np.ndarray]:
    raw = pa.decompress(blob[8:], decompressed_size=int(np.frombuffer(blob[:8], np.int64)[0]), codec="zstd", asbytes=True)
    n, at, out = int(np.frombuffer(raw[:8], np.int64)[0]), 8, {}
    for name, kind in kinds.items():
        size = np.dtype(kind).itemsize
        x = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T.copy().view(kind).reshape(n)
        out[name] = np.cumsum(x) if kind is np.int64 else x
        at += n * size
    return out


def gathered(blobs, **kinds: type) -> dict[str, np.ndarray]:
    parts = [opened(b, **kinds) for b in blobs]
    return {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, t) for k, t in kinds.items()}


UNITS = {"doc": np.int64, "dup": np.int64, "pos": np.uint32, "n": np.uint8, "key": np.uint64, "own": np.uint64}
SPANS = {"doc": np.int64, "dup": np.int64, "pos": np.uint32, "count": np.uint32}
ASKED = {"doc": np.int64, "dup": np.int64, "pos": np.uint32, "n": np.uint8, "key": np.uint64, "hot": np.uint8}
STRINGS = {"doc": np.int64, "dup": np.int64, "pos": np.uint32, "n": np.uint8}


def shelf(doc: np.ndarray, dup: np.ndarray, shelves: int) -> np.ndarray:
    """The group that a document's text and spans meet in."""
    return (mix(doc.astype(np.int64).view(U) * U(BASE) + dup.astype(U) + U(7)) % U(shelves)).astype(np.int64)


def runs(doc: np.ndarray, dup: np.ndarray, pos: np.ndarray, count: np.ndarray) -> dict[str, np.ndarray]:
    """Spans of windows, those that follow on each other as one."""
    o = np.lexsort((pos, dup, doc))
    doc, dup, pos, count = doc[o], dup[o], pos[o].astype(np.int64), count[o].astype(np.int64)
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (dup[1:] != dup[:-1]) | (pos[1:] != pos[:-1] + count[:-1])
    at = np.flatnonzero(new)
    total = np.add.reduceat(count, at) if len(at) else count
    return {"doc": doc[at], "dup": dup[at], "pos": pos[at].astype(np.uint32), "count": total.astype(np.uint32)}


def by_group(group: np.ndarray, columns: dict[str, np.ndarray]):
    """(group, columns of its rows) for each group."""
    o = np.argsort(group, kind="stable")
    g = group[o]
    cuts = np.flatnonzero(np.diff(g)) + 1
    for part in np.split(o, cuts) if len(o) else []:
        yield int(group[part[0]]), {k: v[part] for k, v in columns.items()}


def first_of(o: np.ndarray, same: np.ndarray) -> np.ndarray:
    """For rows in order o, the row that leads each one's run of equals (same[k]: the k-th equals the one before)."""
    lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(o))))
    return o[lead]


def unit_rows(docs: DataFrame, buckets: int, shelves: int) -> DataFrame:
    """(doc, dup, text) -> (grp, kind, weight, blob): kind 0 units by key, 1 units of dealt-out keys, 2 the keys that
    were dealt out, 3 spans that go. Units that a batch has twice are left out already, as spans that go."""

    def batch_rows(batch):
        batch = batch.sort_values(["doc", "dup"], kind="stable")
        size = batch["text"].str.len().fillna(0).to_numpy().cumsum() // CHUNK
        for _, pdf in batch.groupby(size, sort=False):
            yield from chunk_rows(pdf)

    def chunk_rows(pdf):
        cols: list[tuple[np.ndarray, ...]] = []
        held, ids, size = [], [], 0

        def hashed():
            nonlocal held, ids, size
            if held:
                ends = np.cumsum([len(x) for x in held])
                text, pos, n, key, own, loops = units(np.frombuffer(b"".join(held), np.uint8), ends)
                cols.append((np.array(ids)[text], pos, n, key, own, loops))
            held, ids, size = [], [], 0

        for k, t in enumerate(pdf["text"]):
            if t:
                b = t.encode()
                if len(b) >= LENGTH:
                    held.append(b)
                    ids.append(k)
                    size += len(b)
                    if size >= SLAB:
                        hashed()
        hashed()
        if not cols:
            return
        row, pos, n, key, own, loops = (np.concatenate(x) for x in zip(*cols, strict=True))
        doc, dup = pdf["doc"].to_numpy(np.int64)[row], pdf["dup"].to_numpy(np.int64)[row]
        o = np.lexsort((own, key))  # stable: equal units stay in order of document and place
        same = np.zeros(len(o), dtype=bool)
        same[1:] = (key[o][1:] == key[o][:-1]) & (own[o][1:] == own[o][:-1])
        first = first_of(o, same)
        later = np.zeros(len(o), dtype=bool)
        later[o] = same & ((doc[o] != doc[first]) | (pos[o] != pos[first]))
        if later.any():
            spans = runs(doc[later], dup[later], pos[later], n[later])
            for g, part in by_group(shelf(spans["doc"], spans["dup"], shelves), spans):
                yield g, 3, 0, packed(**part)
        keep = ~later
        lead = ~same
        keys, which = np.unique(key[o][lead], return_counts=True)
        dealt = keys[which > SALT]
        salted = keep & np.isin(key, dealt) if len(dealt) else np.zeros(len(key), dtype=bool)
        columns = {"doc": doc, "dup": dup, "pos": pos.astype(np.uint32), "n": (n + LOOPS * loops).astype(np.uint8), "key": key, "own": own}
        for kind, these, group in ((0, keep & ~salted, mix(key + U(5))), (1, salted, mix(key ^ mix(own)))):
            if these.any():
                for g, part in by_group((group[these] % U(buckets)).astype(np.int64), {k: v[these] for k, v in columns.items()}):
                    yield g, kind, 0, packed(**part)
        if len(dealt):
            for g, part in by_group((mix(dealt + U(5)) % U(buckets)).astype(np.int64), {"key": dealt}):
                yield g, 2, 0, packed(**part)

    return docs.mapInPandas(rows_of(batch_rows), "grp long, kind int, weight long, blob binary")


def rows_of(make):
    """mapInPandas function from a generator of (grp, kind, weight, blob) over one frame."""

    def run(batches):
        for pdf in batches:
            rows, size = [], 0
            for r in make(pdf):
                rows.append(r)
                size += len(r[3])
                if size >= GROUP_BYTES:
                    yield pd.DataFrame(rows, columns=["grp", "kind", "weight", "blob"])
                    rows, size = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=["grp", "kind", "weight", "blob"])

    return run


def sifted(rows: DataFrame, shelves: int) -> DataFrame:
    """Units by key -> by document: kind 3 spans that go (whole units with an earlier copy), 4 units that are open."""

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        passed = pdf[pdf["kind"] == 3]
        out += zip(passed["grp"], passed["kind"], passed["weight"], passed["blob"], strict=True)
        marked = gathered(pdf["blob"][pdf["kind"] == 2], key=np.uint64)["key"]
        for kind in (0, 1):
            u = gathered(pdf["blob"][pdf["kind"] == kind], **UNITS)
            key, own, doc, pos = u["key"], u["own"], u["doc"], u["pos"]
            loops, u["n"] = u["n"] >= LOOPS, u["n"] % np.uint8(LOOPS)
            if not len(key):
                continue
            o = np.lexsort((pos, doc, own, key))
            k, w = key[o], own[o]
            new_key = np.ones(len(o), dtype=bool)
            new_key[1:] = k[1:] != k[:-1]
            same = ~new_key
            same[1:] &= w[1:] == w[:-1]
            first = first_of(o, same)
            gone = same & ((doc[o] != doc[first]) | (pos[o] != pos[first]))
            of_key = np.cumsum(new_key) - 1
            kinds = np.bincount(of_key, weights=~same)[of_key]
            hot = (kinds > HOT) | np.isin(k, marked) | (kind == 1)
            asked = ~gone & ((kinds > 1) | hot | loops[o])
            if gone.any():
                spans = runs(doc[o][gone], u["dup"][o][gone], pos[o][gone], u["n"][o][gone])
                out += [(g, 3, 0, packed(**p)) for g, p in by_group(shelf(spans["doc"], spans["dup"], shelves), spans)]
            if asked.any():
                ask = {c: u[c][o][asked] for c in ("doc", "dup", "pos", "n", "key")} | {"hot": hot[asked].astype(np.uint8)}
                for g, p in by_group(shelf(ask["doc"], ask["dup"], shelves), ask):
                    out.append((g, 4, int(p["n"].sum()), packed(**p)))
        return pd.DataFrame(out, columns=["grp", "kind", "weight", "blob"])

    # spans that go belong to a shelf, not to a bucket: they pass through one group of their number
    keyed = rows.withColumn("bucket", F.col("grp"))
    return keyed.groupBy("bucket").applyInPandas(group, "grp long, kind int, weight long, blob binary")


def shelved(docs: DataFrame, shelves: int) -> DataFrame:
    """(doc, dup, text) -> (grp, texts): texts by document id, packed."""

    def run(batches):
        for pdf in batches:
            doc, dup = pdf["doc"].to_numpy(np.int64), pdf["dup"].to_numpy(np.int64)
            texts = [(t or "").encode() for t in pdf["text"]]
            size = np.array([len(t) for t in texts], dtype=np.int64)
            rows, held = [], 0
            for g, p in by_group(shelf(doc, dup, shelves), {"at": np.arange(len(doc))}):
                at = p["at"]
                raw = b"".join(texts[i] for i in at.tolist())
                head = packed(doc=doc[at], dup=dup[at], size=size[at])
                body = pa.compress(raw, codec="zstd", asbytes=True)
                rows.append((g, np.int64(len(head)).tobytes() + head + np.int64(len(raw)).tobytes() + body))
                held += len(body)
                if held >= GROUP_BYTES:
                    yield pd.DataFrame(rows, columns=["grp", "texts"])
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=["grp", "texts"])

    return docs.mapInPandas(run, "grp long, texts binary")


def unshelved(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    n = int(np.frombuffer(blob[:8], np.int64)[0])
    head = opened(blob[8 : 8 + n], doc=np.int64, dup=np.int64, size=np.int64)
    size = int(np.frombuffer(blob[8 + n : 16 + n], np.int64)[0])
    return head["doc"], head["dup"], head["size"], pa.decompress(blob[16 + n :], decompressed_size=size, codec="zstd", asbytes=True)


def matched(doc: np.ndarray, dup: np.ndarray, want: dict[str, np.ndarray]) -> list[tuple[int, int, int]]:
    """(document, from, to): which rows of want, sorted by doc and dup, are each document's."""
    if not len(want["doc"]):
        return []
    new = np.ones(len(want["doc"]), dtype=bool)
    new[1:] = (want["doc"][1:] != want["doc"][:-1]) | (want["dup"][1:] != want["dup"][:-1])
    at = np.flatnonzero(new)
    stop = np.append(at[1:], len(new))
    where = {(d, e): (a, b) for d, e, a, b in zip(want["doc"][at].tolist(), want["dup"][at].tolist(), at.tolist(), stop.tolist(), strict=True)}
    return [(k, *where[x]) for k, x in enumerate(zip(doc.tolist(), dup.tolist(), strict=True)) if x in where]


def as_blob(columns: dict[str, np.ndarray], raw: bytes) -> bytes:
    """Places of strings and the strings themselves, end to end, as one value."""
    head = packed(**columns)
    return np.int64(len(head)).tobytes() + head + np.int64(len(raw)).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def from_blobs(blobs) -> tuple[dict[str, np.ndarray], bytes]:
    heads, raws = [], []
    for blob in blobs:
        n = int(np.frombuffer(blob[:8], np.int64)[0])
        heads.append(opened(blob[8 : 8 + n], **STRINGS))
        raws.append(pa.decompress(blob[16 + n :], decompressed_size=int(np.frombuffer(blob[8 + n : 16 + n], np.int64)[0]), codec="zstd", asbytes=True))
    return {k: np.concatenate([h[k] for h in heads]) for k in STRINGS}, b"".join(raws)


def earliest(doc: np.ndarray, pos: np.ndarray, raw: bytes) -> np.ndarray:
    """For single windows, end to end in raw: which of them no equal one stands before, byte for byte."""
    window = np.unique(np.frombuffer(raw, f"V{LENGTH}"), return_inverse=True)[1]
    o = np.lexsort((pos, doc, window))
    same = np.zeros(len(o), dtype=bool)
    same[1:] = window[o][1:] == window[o][:-1]
    first = first_of(o, same)
    stays = np.zeros(len(o), dtype=bool)
    stays[o] = (doc[o] == doc[first]) & (pos[o] == pos[first])  # rows of one document id are one place
    return stays


OPEN = "grp long, kind int, weight long, blob binary"


def parted(columns: dict[str, np.ndarray], raw: bytes, group: np.ndarray, shelves: int):
    """Single windows -> rows of OPEN: kind 1 the earliest of equal ones, by merge; kind 3 the others, as spans that go."""
    stays = earliest(columns["doc"], columns["pos"], raw)
    gone = {k: v[~stays] for k, v in columns.items()}
    if len(gone["doc"]):
        spans = runs(gone["doc"], gone["dup"], gone["pos"], np.ones(len(gone["doc"]), np.int64))
        for g, p in by_group(shelf(spans["doc"], spans["dup"], shelves), spans):
            yield g, 3, 0, packed(**p)
    at = np.flatnonzero(stays)
    for g, p in by_group(group[at], {k: v[at] for k, v in columns.items()} | {"at": at}):
        rows = p.pop("at")
        yield g, 1, len(rows), as_blob(p, b"".join(raw[i * LENGTH : (i + 1) * LENGTH] for i in rows.tolist()))


def merge_of(raw: bytes, merges: int) -> np.ndarray:
    """The merge of each single window: by its hash."""
    whole = grams(doubled(np.frombuffer(raw, np.uint8), 64), LENGTH)[::LENGTH]
    return (mix(whole + U(13)) % U(merges)).astype(np.int64)


def open_strings(shelves_of_text: DataFrame, asked: DataFrame, merges: int, shelves: int) -> DataFrame:
    """Texts and their open units -> rows of OPEN by merge: kind 0 the units' strings; those of keys that were dealt out
    go window by window (kind 1), of equal ones in a shelf the earliest only, the others being spans that go (kind 3)."""

    def group(texts: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        want = gathered(asks["blob"], **ASKED)
        o = np.lexsort((want["pos"], want["dup"], want["doc"]))
        want = {k: v[o] for k, v in want.items()}
        strings: dict[str, list] = {"grp": [], "doc": [], "dup": [], "pos": [], "n": [], "text": []}
        windows: dict[str, list] = {"doc": [], "dup": [], "pos": [], "text": []}
        if len(o):
            merge = (mix(want["key"] + U(11)) % U(merges)).astype(np.int64)
            for blob in texts["texts"]:
                doc, dup, size, raw = unshelved(blob)
                starts = np.cumsum(size) - size
                for k, a, b in matched(doc, dup, want):
                    base = int(starts[k])
                    for i in range(a, b):
                        pos, n = int(want["pos"][i]), int(want["n"][i])
                        at = base + pos
                        if want["hot"][i]:
                            windows["doc"] += [doc[k]] * n
                            windows["dup"] += [dup[k]] * n
                            windows["pos"] += range(pos, pos + n)
                            windows["text"] += [raw[at + j : at + j + LENGTH] for j in range(n)]
                        else:
                            for name, value in (("grp", merge[i]), ("doc", doc[k]), ("dup", dup[k]), ("pos", pos), ("n", n), ("text", raw[at : at + n + LENGTH - 1])):
                                strings[name].append(value)
        kinds = STRINGS | {"grp": np.int64}
        rows = []
        if strings["grp"]:
            columns = {k: np.array(strings[k], kinds[k]) for k in ("doc", "dup", "pos", "n")} | {"i": np.arange(len(strings["grp"]))}
            for g, p in by_group(np.array(strings["grp"], np.int64), columns):
                raw = b"".join(strings["text"][i] for i in p.pop("i").tolist())
                rows.append((g, 0, int(p["n"].sum()), as_blob(p, raw)))
        if windows["doc"]:
            raw = b"".join(windows["text"])
            columns = {k: np.array(windows[k], kinds[k]) for k in ("doc", "dup", "pos")} | {"n": np.ones(len(windows["doc"]), np.uint8)}
            rows += parted(columns, raw, merge_of(raw, merges), shelves)
        return pd.DataFrame(rows, columns=["grp", "kind", "weight", "blob"])

    return shelves_of_text.groupBy("grp").cogroup(asked.groupBy("grp")).applyInPandas(group, OPEN)


def thinned(rows: DataFrame, merges: int, shelves: int) -> DataFrame:
    """Rows of OPEN with single windows -> the same rows, but of a window that many shelves hold the earliest of each of
    several parts only. Merges with more than MERGE_WINDOWS single windows are parted so that each part holds so many."""
    load = rows.filter("kind = 1").groupBy("grp").agg(F.sum("weight").alias("__w")).filter(F.col("__w") > MERGE_WINDOWS)
    load = stored(load)
    if not load.limit(1).count():
        return rows

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        columns, raw = from_blobs(pdf["blob"])
        return pd.DataFrame(list(parted(columns, raw, merge_of(raw, merges), shelves)), columns=["grp", "kind", "weight", "blob"])

    single = F.col("kind") == 1
    many = rows.filter(single).join(load, "grp").withColumn("__part", F.pmod(F.xxhash64("blob"), F.ceil(F.col("__w") / MERGE_WINDOWS)))
    some = rows.join(load.select("grp", F.lit(1).alias("kind")), ["grp", "kind"], "left_anti").select("grp", "kind", "weight", "blob")
    return some.unionByName(many.groupBy("grp", "__part").applyInPandas(group, OPEN))


class Shard:
    """Strings of one shard, their suffixes in order, and the transform: the symbol before each suffix."""

    def __init__(self, entries: slice, code: np.ndarray, after: np.ndarray, before: np.ndarray) -> None:
        """code: symbol of each entry, 0 at a string's end; after, before: one symbol's entry on either side, or -1."""
        a, b = entries.start, entries.stop
        own = code[a:b].astype(np.uint64)
        keys, at = [], np.arange(a, b)
        for _ in range(4):  # a unit has at most eight symbols in a row, its end included
            here = np.where(at >= 0, code[at], 0).astype(np.uint64)
            at = np.where(at >= 0, after[at], -1)
            there = np.where(at >= 0, code[at], 0).astype(np.uint64)
            at = np.where(at >= 0, after[at], -1)
            keys.append((here << U(32)) | there)
        self.order = np.lexsort(keys[::-1]) + a
        self.n_ends = int((own == 0).sum())
        left = before[self.order]
        self.bwt = np.where(left >= 0, code[left], -1)


def merged(shards: list[Shard], steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Entries in merged order, and the common prefix of each with the one before it, in symbols up to `steps`.

    Only the shards' transforms are read. Z says which shard each merged place is from. In each round the places are
    passed through in their present order and dealt to the symbol before their suffix, which sorts Z by one symbol
    more; a place whose symbol, or whose block of the round before, differs from its neighbour's starts a block, and the
    round is their common prefix. String ends differ from all else.
    """
    sizes = [len(s.order) for s in shards]
    total = sum(sizes)
    z = np.repeat(np.arange(len(shards), dtype=np.uint8), sizes)
    ends = np.repeat(np.arange(len(shards), dtype=np.uint8), [s.n_ends for s in shards])
    bwt = np.concatenate([s.bwt for s in shards])
    block = np.zeros(total, dtype=np.int64)
    common = np.full(total, steps, dtype=np.int64)
    for step in range(steps):
        symbol = np.empty(total, dtype=bwt.dtype)
        symbol[np.argsort(z, kind="stable")] = bwt
        has = symbol >= 0
        symbol, from_block, from_z = symbol[has], block[has], z[has]
        o = np.argsort(symbol, kind="stable")
        z = np.concatenate([ends, from_z[o]])
        new = np.ones(total, dtype=bool)
        symbol, from_block = symbol[o], from_block[o]
        new[len(ends) + 1 :] = (symbol[1:] != symbol[:-1]) | (from_block[1:] != from_block[:-1])
        common[new & (common == steps)] = step
        block = np.cumsum(new)
    entry = np.empty(total, dtype=np.int64)
    entry[np.argsort(z, kind="stable")] = np.concatenate([s.order for s in shards])
    return entry, common


def repeated_windows(doc: np.ndarray, pos: np.ndarray, n: np.ndarray, texts: bytes, shards: int = SHARDS) -> tuple[np.ndarray, np.ndarray]:
    """Strings of n windows each, end to end in texts, from (doc, pos) -> (string, window) of the windows whose bytes
    stand earlier too, among all these strings."""
    length = n + LENGTH - 1
    base = np.cumsum(length) - length
    # entries: a string's symbols and its ends, for each way of reading it in steps of SYMBOL that a window needs
    m = n + LENGTH
    string = np.repeat(np.arange(len(n)), m)
    p = np.arange(len(string)) - np.repeat(np.cumsum(m) - m, m)
    use = p % SYMBOL < n[string]
    where = np.full(len(p), -1, dtype=np.int64)
    where[use] = np.arange(int(use.sum()))
    lead = np.flatnonzero(use)
    string, p = string[use], p[use]
    end = p >= n[string] + LENGTH - SYMBOL
    after = np.full(len(p), -1, dtype=np.int64)
    after[~end] = where[lead[~end] + SYMBOL]
    before = np.full(len(p), -1, dtype=np.int64)
    inner = p >= SYMBOL
    before[inner] = where[lead[inner] - SYMBOL]
    data = np.frombuffer(texts, np.uint8)
    hashes = mix(grams(doubled(data, 16), SYMBOL))
    code = np.zeros(len(p), dtype=np.int32)
    code[~end] = np.unique(hashes[(base[string] + p)[~end]], return_inverse=True)[1] + 1
    # shards of whole strings
    bounds = np.searchsorted(string, np.unique(np.linspace(0, len(n), min(shards, len(n)) + 1).astype(np.int64)))
    built = [Shard(slice(int(a), int(b)), code, after, before) for a, b in zip(bounds[:-1], bounds[1:], strict=True) if b > a]
    entry, common = merged(built)
    # a run of common prefixes of LENGTH bytes is a repeated interval
    start = common < STEPS
    at = np.flatnonzero(start)
    rank = np.unique(doc, return_inverse=True)[1].astype(np.uint64)
    place = (rank[string[entry]] << U(34)) | (pos[string[entry]].astype(np.uint64) + p[entry].astype(np.uint64))
    earliest = np.repeat(np.minimum.reduceat(place, at), np.diff(np.append(at, len(start))))
    gone = entry[place > earliest]
    return string[gone], p[gone]


def merge_transforms(strings: DataFrame, shelves: int) -> DataFrame:
    """Strings by merge (kinds 0 and 1 of OPEN) -> by document, kind 3: spans of windows that stand earlier."""

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        s, raw = from_blobs(pdf["blob"])
        string, window = repeated_windows(s["doc"], s["pos"].astype(np.int64), s["n"].astype(np.int64), raw)
        spans = runs(s["doc"][string], s["dup"][string], s["pos"][string].astype(np.int64) + window, np.ones(len(string), np.int64))
        rows = [(g, 3, 0, packed(**p)) for g, p in by_group(shelf(spans["doc"], spans["dup"], shelves), spans)]
        return pd.DataFrame(rows, columns=["grp", "kind", "weight", "blob"])

    return strings.groupBy("grp").applyInPandas(group, "grp long, kind int, weight long, blob binary")


def covered(size: int, pos: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Which bytes of a text its spans of windows cover."""
    step = np.zeros(size + 1, dtype=np.int64)
    np.add.at(step, pos, 1)
    np.add.at(step, pos + count + LENGTH - 1, -1)
    return np.cumsum(step[:-1]) > 0


def cut_texts(shelves_of_text: DataFrame, spans: DataFrame, with_text: bool) -> DataFrame:
    """doc, dup, n_bytes, n_removed, n_spans, kept_sha256, and kept (the text that is left) if with_text."""

    def group(texts: pd.DataFrame, gone: pd.DataFrame) -> pd.DataFrame:
        want = gathered(gone["blob"], **SPANS)
        o = np.lexsort((want["pos"], want["dup"], want["doc"]))
        want = {k: v[o] for k, v in want.items()}
        rows = []
        for blob in texts["texts"]:
            doc, dup, size, raw = unshelved(blob)
            starts = (np.cumsum(size) - size).tolist()
            mine = {k: (a, b) for k, a, b in matched(doc, dup, want)}
            for k, (d, e, n) in enumerate(zip(doc.tolist(), dup.tolist(), size.tolist(), strict=True)):
                text = raw[starts[k] : starts[k] + n]
                removed = spans_n = 0
                if k in mine:
                    a, b = mine[k]
                    off = covered(n, want["pos"][a:b].astype(np.int64), want["count"][a:b].astype(np.int64))
                    removed, spans_n = int(off.sum()), int(off[0]) + int((off[1:] & ~off[:-1]).sum())
                    text = np.frombuffer(text, np.uint8)[~off].tobytes()
                rows.append((d, e, n, removed, spans_n, hashlib.sha256(text).hexdigest(), text.decode("utf-8", "ignore") if with_text else None))
        return pd.DataFrame(rows, columns=["doc", "dup", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    schema = "doc long, dup long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"
    return shelves_of_text.groupBy("grp").cogroup(spans.groupBy("grp")).applyInPandas(group, schema)


def numbered(docs: DataFrame) -> DataFrame:
    """docs plus doc (the id; null: the largest) and dup, which tells rows of one doc_id apart. Where ids repeat, rows are
    stored, so that their numbers are settled, and no id's rows are gathered anywhere."""
    d = docs.withColumn("doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NO_ID))))
    if d.groupBy("doc").count().filter("count > 1").limit(1).count():
        return stored(d.withColumn("dup", F.monotonically_increasing_id()))
    return d.withColumn("dup", F.lit(0).cast("long"))


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """(doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and doc, dup; kept if with_text).

    Every byte goes that lies in a LENGTH-byte string which also starts earlier: in a document with a smaller id, or
    earlier in its own. Texts count as UTF-8; a character of which a part goes is left out of kept altogether.

    Null and short texts lose nothing; null counts as empty. A null doc_id counts as larger than any. Rows with one
    doc_id count as one place: a string at the same start in two of them is not earlier in either. An empty table gives
    no rows. Columns besides doc_id and text don't take part.
    """
    return removed(numbered(docs.select("doc_id", F.col("text").cast("string").alias("text"))), with_text)


def removed(docs: DataFrame, with_text: bool) -> DataFrame:
    """docs of numbered() -> remove_repeats()."""
    d = docs.select("doc", F.col("dup").cast("long").alias("dup"), "text")
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = shelves = max(16, int(size) // GROUP_BYTES)
    v = stored(sifted(unit_rows(d, buckets, shelves), shelves))
    open_windows = v.filter("kind = 4").agg(F.sum("weight")).first()[0] or 0
    texts = shelved(d, shelves)
    spans = v.filter("kind = 3")
    if open_windows:
        merges = max(16, int(open_windows) // MERGE_WINDOWS)
        strings = thinned(stored(open_strings(texts, v.filter("kind = 4").select("grp", "blob"), merges, shelves)), merges, shelves)
        spans = spans.union(strings.filter("kind = 3")).union(stored(merge_transforms(strings.filter("kind < 3"), shelves)))
    out = cut_texts(texts, spans.select("grp", "blob"), with_text)
    return out.withColumn("doc_id", F.when(F.col("doc") != int(NO_ID), F.col("doc")))


def cut_repeats(docs: DataFrame) -> DataFrame:
    """docs with the texts that remove_repeats() leaves, n_chars (if there) counted anew, all else as it was. Null texts
    stay null."""
    others = F.struct(F.lit(0).alias("__"), *[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    d = numbered(docs.select(others.alias("__row"), "doc_id", F.col("text").cast("string").alias("text")))
    kept = removed(d, True).select("doc", "dup", "kept")
    # numbers are settled, so both sides of the join agree; only what is left of the texts is shuffled
    out = d.select("__row", "doc", "dup", F.col("text").isNull().alias("__null")).join(kept, ["doc", "dup"])
    text = F.when(~F.col("__null"), F.col("kept"))
    own = {"text": text.alias("text")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return out.select(*[own[c] if c in own else F.col(f"__row.`{c}`").alias(c) for c in docs.columns])
