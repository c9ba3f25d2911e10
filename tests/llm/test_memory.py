"""What the near-duplicate stage holds at once."""

import tracemalloc

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lidarloom.llm import common, simhash_near


def test_many_near_fingerprints_are_compared_in_parts():
    """Of two large groups all of whose fingerprints are near, a few pairs are held at once, and every pair comes."""
    fp = np.zeros((16_684, simhash_near.WORDS), dtype=np.uint64)
    n, rows, found = np.full(len(fp), 100), np.arange(len(fp)), 0
    tracemalloc.start()
    try:
        for i, j in simhash_near.met(n, fp, rows[:300], rows[300:], 0.8):
            found += len(i)
        assert tracemalloc.get_traced_memory()[1] < 64 << 20
    finally:
        tracemalloc.stop()
    assert found == 300 * 16_384


def test_batches_of_long_texts_are_small(spark, monkeypatch):
    """The stage's Python workers get some 2 MB at once; the session's own setting is back afterwards."""
    before = spark.conf.get(common.BATCH_KEY)
    docs = spark.range(0, 4000, 1, 1).select(F.col("id").cast("string").alias("doc_id"), F.concat(F.col("id").cast("string"), F.repeat(F.lit(" x"), 1500)).alias("text"))
    most = []

    def measured(docs, least):
        held = docs.mapInPandas(lambda it: (pd.DataFrame({"n": [x["text"].str.len().sum()]}) for x in it), "n long")
        most.append(held.agg(F.max("n")).first()[0])
        return docs.select("uid", F.col("uid").alias("group"))

    monkeypatch.setattr(simhash_near, "near_groups", measured)
    assert simhash_near.keep_one(docs).count() == 4000
    assert most[0] <= 2 * common.BATCH
    assert spark.conf.get(common.BATCH_KEY) == before
    with common.small_batches(spark):
        with common.small_batches(spark):
            pass
        assert spark.conf.get(common.BATCH_KEY) != before
    assert spark.conf.get(common.BATCH_KEY) == before
