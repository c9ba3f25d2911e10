"""Each stage of the pipeline on its own input, against plain versions of what it does."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lidarloom.llm import packing
from lidarloom.llm.common import stored

from .test_edges import CLASH, ROWS, SCHEMA
from .test_methods import plain_mix, plain_removal, plain_rules
from .test_resemblance import plain_keepers

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def steps(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], sf)))
    return out


def test_columns_stay(steps):
    assert all(d.columns == steps[0].columns for d in steps[:-1])


def test_rejected_documents_go(steps, spark):
    """What fails the base rule goes, and so does what labels call bad; what they call good stays if the base rule lets it."""
    before, after = {r.doc_id: r.text for r in steps[0].collect()}, {r.doc_id for r in steps[1].collect()}
    assert after <= set(before) and not any(plain_rules(before[i])[-1] for i in after)
    quality = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    open_ = [i for i in before if i in quality and not plain_rules(before[i])[-1]]
    good, bad = [i in after for i in open_ if quality[i] == 1], [i in after for i in open_ if quality[i] == 0]
    assert all(good) and (not bad or np.mean(bad) < 0.3)


def test_one_of_each_group_stays(steps):
    keep, _ = plain_keepers(sorted((r.doc_id, r.text) for r in steps[1].collect()))
    assert sorted(r.doc_id for r in steps[2].collect()) == keep


def test_repeats_are_cut(steps):
    before = [(r.doc_id, r.text) for r in steps[2].collect()]
    after = {r.doc_id: r for r in steps[3].collect()}
    lost = plain_removal(before)
    assert after.keys() == lost.keys()
    for i, text in before:
        n, gone, _, _ = lost[i]
        # characters that are cut in two go altogether
        assert n - gone - 6 * lost[i][2] <= len((after[i].text or "").encode()) <= n - gone
        assert after[i].n_chars == (None if text is None else len(after[i].text))


def test_mix_is_as_planned(steps):
    rows = [(r.doc_id, r.source, len(SPLIT.findall(r.text or ""))) for r in steps[3].collect()]
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n
    names = sorted(sizes, key=lambda s: (s is None, s))
    weights = {s: 1 + k % 3 for k, s in enumerate(names)}
    left, share = set(names), {}
    while True:  # what is above three times a source's size goes to the others
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in names if s not in left)
        share = {s: rest * weights[s] / sum(weights[x] for x in left) if s in left else 3 * sizes[s] for s in names}
        over = {s for s in left if share[s] > 3 * sizes[s]}
        if not over:
            break
        left -= over
    want = plain_mix(rows, share)
    assert Counter(r.doc_id for r in steps[4].collect()) == Counter({i: n for i, n in want.items() if n})


def test_all_is_packed(steps):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.vocabulary())
    texts = {r.doc_id: r.text for r in steps[4].collect()}
    times = Counter(r.doc_id for r in steps[4].collect())
    rows = steps[5].collect()
    places = sorted((r.sequence_id * 1024 + r.offset, r.length) for r in rows)
    assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:], strict=False))
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    for i, own in pieces.items():
        ids = [*tok.encode(texts[i] or "", add_special_tokens=False).ids, 0]
        assert sum(r.length for r in own) == times[i] * len(ids)
        assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes()) for r in own)


def test_stages_on_edges(spark):
    """Nulls, empty and very long texts, repeated ids, clashing names, and no rows at all."""
    long = [(100, " ".join(f"word{i} of a very long text" for i in range(60000)), "en", "s9", 0)]
    for rows in (ROWS + long, []):
        docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in CLASH})
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stored(stage(spark, docs, ""))
            assert out.columns == docs.columns and out.filter(" or ".join(f"`{c}` <> 'x'" for c in CLASH)).count() == 0, name
        assert (corpus_pipeline.STAGES[-1][1](spark, docs, "").count() > 0) == bool(rows)
