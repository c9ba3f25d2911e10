"""Tables that a run stores: whose they are, and when they go."""

import os
import threading

from pyspark.sql import functions as F

import corpus_pipeline
from lidarloom.llm import common


def there(spark):
    return {x for x in os.listdir(common.shared_dir(spark).removeprefix("file:")) if x.startswith("llm-")}


def stage(n, ready=None, go=None):
    @common.staged
    def run(spark, docs, sf_dir):
        out = common.stored(docs.selectExpr(f"x + {n} AS x"))
        if ready:
            ready.set()
            go.wait(60)
        return out

    return run


def test_runs_side_by_side(spark):
    docs = spark.range(5).select(F.col("id").alias("x"))
    ready, go, out = threading.Event(), threading.Event(), []
    first = threading.Thread(target=lambda: out.append(sum(r.x for r in stage(1, ready, go)(spark, docs, "").collect())))
    first.start()
    ready.wait(60)
    with common.one_run() as tables:  # while the other run's stage is at work
        a = tables.keep(stage(2)(spark, docs, ""))
        b = tables.keep(stage(3)(spark, a, ""))
    loose = common.stored(docs)  # outside any stage: no stage's end touches it
    go.set()
    first.join(60)
    assert out == [15] and sum(r.x for r in b.collect()) == 35 and loose.count() == 5


def test_a_stage_s_tables_go_when_the_next_starts(spark):
    docs = spark.range(5).select(F.col("id").alias("x"))
    before = there(spark)
    with common.one_run() as tables:
        kept = tables.keep(stage(1)(spark, docs, ""))
        inner = there(spark) - before
        kept = tables.keep(stage(2)(spark, kept, ""))
        assert len(inner) == 2 and len(there(spark) - before) == 2 and not inner & there(spark)
        assert kept.agg(F.sum("x")).first()[0] == 25


def test_the_pipeline_leaves_what_its_result_needs(spark, sf):
    before = there(spark)
    rows = corpus_pipeline.run(spark, sf).count()
    held = there(spark) - before
    texts = [x for x in held if "text" in spark.read.parquet(f"{common.shared_dir(spark)}/{x}").columns]
    assert rows > 100 and len(texts) <= 1
