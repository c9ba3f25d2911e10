"""Ordered plans that Spark has no operator for: places in an order, rows before, as-of joins, and folds.

All but the folds work in two levels: rows are ordered within (key, bucket) and only a row a bucket is ordered within
the key, so a key of any length is spread over tasks. A fold, whose every step needs the state before it, runs through a
key's rows one Arrow batch after the other.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket_of(stamp: Column, width: int) -> Column:
    return F.floor(stamp / F.lit(width)).cast("bigint")


def ordinal(df: DataFrame, keys: Sequence[str], stamp: str, width: int, tie: Sequence[str] = (), name: str = "n") -> DataFrame:
    """name: place of each row (from 0) within its keys by stamp and tie; width: of a bucket, in stamp's unit."""
    d = df.withColumn("__b", bucket_of(F.col(stamp), width))
    counts = d.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__c"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__first", F.coalesce(F.sum("__c").over(before), F.lit(0))).drop("__c")
    own = Window.partitionBy(*keys, "__b").orderBy(stamp, *tie)
    d = d.withColumn("__k", F.row_number().over(own) - 1).join(counts, [*keys, "__b"])
    return d.withColumn(name, (F.col("__first") + F.col("__k")).cast("bigint")).drop("__b", "__k", "__first")


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], left_stamp: str, right_stamp: str, width: int, tie: Sequence[str] = (), strict: bool = False, forward: bool = False, name: str = "match") -> DataFrame:
    """left plus name: the struct of the right row of the same keys with the latest stamp not after left's (strict:
    before it; forward: the earliest not before it), null if there is none. tie: numeric columns; of equal stamps the
    last by them wins (forward: the first)."""
    sign = -1 if forward else 1
    ties = [f"__tie{i}" for i in range(len(tie))]
    lft = left.select(*keys, (F.col(left_stamp) * sign).alias("__t"), F.struct(*left.columns).alias("__left"))
    rgt = right.select(*keys, (F.col(right_stamp) * sign).alias("__t"), F.struct(*right.columns).alias("__row"), *[(F.col(c) * sign).alias(t) for c, t in zip(tie, ties, strict=True)])
    lft, rgt = (d.withColumn("__b", bucket_of(F.col("__t"), width)) for d in (lft, rgt))
    row_type, left_type = rgt.schema["__row"].dataType, lft.schema["__left"].dataType

    # the last right row of each bucket, carried to the buckets after it
    last = rgt.groupBy(*keys, "__b").agg(F.max_by("__row", F.struct("__t", *ties)).alias("__last"))
    marks = last.unionByName(lft.select(*keys, "__b").distinct().withColumn("__last", F.lit(None).cast(row_type)))
    marks = marks.groupBy(*keys, "__b").agg(F.first("__last", ignorenulls=True).alias("__last"))
    earlier = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    seeds = marks.withColumn("__seed", F.last("__last", ignorenulls=True).over(earlier)).select(*keys, "__b", "__seed")

    # within a bucket: of one stamp the right rows stand before the left ones, or after them if strict
    right_side = rgt.withColumns({"__side": F.lit(int(strict)), "__left": F.lit(None).cast(left_type)})
    left_side = lft.withColumns({"__side": F.lit(int(not strict)), "__row": F.lit(None).cast(row_type), **{t: F.lit(None).cast(rgt.schema[t].dataType) for t in ties}})
    upto = Window.partitionBy(*keys, "__b").orderBy("__t", "__side", *ties).rowsBetween(Window.unboundedPreceding, 0)
    both = right_side.unionByName(left_side).withColumn("__found", F.last("__row", ignorenulls=True).over(upto)).filter(F.col("__left").isNotNull())
    return both.join(seeds, [*keys, "__b"], "left").select("__left.*", F.coalesce("__found", "__seed").alias(name))


def running(df: DataFrame, keys: Sequence[str], stamp: str, width: int, sums: dict[str, Column], tie: Sequence[str] = (), name: str = "n") -> DataFrame:
    """df plus name, the place of each row (from 0) within its keys by stamp and tie, and, for each of sums, its running
    total up to and with the row (nulls count as 0). width: of a bucket, in stamp's unit."""
    d = df.withColumn("__b", bucket_of(F.col(stamp), width)).withColumns({f"__x{i}": F.coalesce(c, F.lit(0)) for i, c in enumerate(sums.values())})
    parts = [f"__x{i}" for i in range(len(sums))]
    totals = d.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__c"), *[F.sum(c).alias(f"__t{c}") for c in parts])
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    heads = totals.select(*keys, "__b", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(h) for c, h in [("__c", "__first"), *[(f"__t{c}", f"__h{c}") for c in parts]]])
    own = Window.partitionBy(*keys, "__b").orderBy(stamp, *tie)
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({"__k": F.row_number().over(own) - 1, **{f"__r{c}": F.sum(c).over(upto) for c in parts}}).join(heads, [*keys, "__b"])
    out = {name: (F.col("__first") + F.col("__k")).cast("bigint"), **{n: F.col(f"__h{c}") + F.col(f"__r{c}") for n, c in zip(sums, parts, strict=True)}}
    return d.select(*df.columns, *[v.alias(k) for k, v in out.items()])


def affine_scan(df: DataFrame, keys: Sequence[str], stamp: str, width: int, value: str, alpha: float, tie: Sequence[str | Column], name: str) -> DataFrame:
    """df plus name: y = (1 - alpha) * y_before + alpha * value along stamp and tie within keys, seeded with the first value;
    nulls leave y as it is.

    Steps y -> a * y + b compose, so each time bucket is reduced on its own, its rows' maps are kept, and only a row a
    bucket is chained within a key. width: of a bucket, in stamp's unit.
    """
    d = df.withColumn("__b", bucket_of(F.col(stamp), width))

    def start():
        a, b, y, i = 1.0, 0.0, None, 0

        def step(pdf: pd.DataFrame) -> pd.DataFrame:
            nonlocal a, b, y, i
            out = []
            for x in pdf[value].astype(float).tolist():
                if x == x:
                    a, b = (1 - alpha) * a, (1 - alpha) * b + alpha * x
                    y = x if y is None else (1 - alpha) * y + alpha * x
                out.append((a, b, float("nan") if y is None else y, i))
                i += 1
            return pdf.assign(**dict(zip(("__a", "__c", "__y", "__i"), zip(*out, strict=True), strict=True)))

        return step

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields)
    rows = folded(d, [*keys, "__b"], [stamp, *tie], start, f"{fields}, __a double, __c double, __y double, __i long")
    last = rows.groupBy(*keys, "__b").agg(F.max_by(F.struct("__a", "__c", "__y"), "__i").alias("m")).select(*keys, "__b", "m.*")

    def chained():
        y = None

        def step(pdf: pd.DataFrame) -> pd.DataFrame:
            nonlocal y
            heads = []
            for a, c, fresh in zip(pdf["__a"], pdf["__c"], pdf["__y"], strict=True):
                heads.append(float("nan") if y is None else y)
                if y is not None:
                    y = a * y + c
                elif fresh == fresh:
                    y = fresh
            return pdf[[*keys, "__b"]].assign(__head=heads)

        return step

    kinds = dict(last.dtypes)
    heads = folded(last, list(keys), ["__b"], chained, ", ".join(f"`{k}` {kinds[k]}" for k in (*keys, "__b")) + ", __head double")
    both = rows.join(heads, [*keys, "__b"])
    none = lambda c: F.col(c).isNull() | F.isnan(c)
    y = F.when(none("__head"), F.when(~none("__y"), F.col("__y"))).otherwise(F.col("__a") * F.col("__head") + F.col("__c"))
    return both.select(*df.columns, y.alias(name))


def folded(df: DataFrame, key: str | Sequence[str], order: Sequence[str | Column], start: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """Each key's rows in order through one function made by start(), a frame of neighbouring rows at a time; what it
    keeps between calls is the fold's state. Memory is a batch and the state, however long a key's rows are."""

    names = [key] if isinstance(key, str) else list(key)

    def run(batches):
        now, step = None, None
        for pdf in batches:
            keys = [pdf[c].to_numpy() for c in names]
            same = np.ones(max(len(pdf) - 1, 0), dtype=bool)
            for k in keys:
                same &= (k[1:] == k[:-1]) | (pd.isna(k[1:]) & pd.isna(k[:-1]))
            for a, b in pairwise([0, *(np.flatnonzero(~same) + 1).tolist(), len(pdf)]):
                if a == b:
                    continue
                here = [k[a] for k in keys]
                if step is None or not all(x == y or (pd.isna(x) and pd.isna(y)) for x, y in zip(here, now, strict=True)):
                    now, step = here, start()
                yield step(pdf.iloc[a:b])

    return df.repartition(*names).sortWithinPartitions(*names, *order).mapInPandas(run, schema)


def before(df: DataFrame, keys: Sequence[str], stamp: str, width: int, columns: Sequence[str], tie: Sequence[str] = (), name: str = "before") -> DataFrame:
    """df plus name: the struct of `columns` of the row before, by stamp and tie, within the same keys; null for the
    first. width: of a bucket, in stamp's unit."""
    d = df.withColumn("__b", bucket_of(F.col(stamp), width))
    held = F.struct(*columns)
    last = d.groupBy(*keys, "__b").agg(F.max_by(held, F.struct(stamp, *tie)).alias("__last"))
    earlier = Window.partitionBy(*keys).orderBy("__b")
    last = last.select(*keys, "__b", F.lag("__last").over(earlier).alias("__seed"))
    own = Window.partitionBy(*keys, "__b").orderBy(stamp, *tie)
    d = d.withColumn(name, F.lag(held).over(own)).join(last, [*keys, "__b"])
    return d.withColumn(name, F.coalesce(name, "__seed")).drop("__b", "__seed")
