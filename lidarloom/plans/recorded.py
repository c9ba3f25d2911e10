"""What queries over the given tables are recorded with, and how their numbers are compared."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .inputs import oracle, read

RECORDED: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}
#: Added before numbers are cut to whole units, so that decimal fractions are never at the edge between two.
SHIFT = 0.618033988749


def micro(c: Column | str, name: str) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c) * 1e6).cast("bigint").alias(name)


def units(c: Column | str, name: str, scale: float = 1e6) -> Column:
    """Whole units of 1 / scale; the next number is the same unless it is a unit away."""
    return F.floor((F.col(c) if isinstance(c, str) else c) * F.lit(float(scale)) + F.lit(SHIFT)).cast("bigint").alias(name)


def sql_units(expression: str, name: str, scale: float = 1e6) -> str:
    return f"CAST(floor(({expression}) * {float(scale)!r}::DOUBLE + {SHIFT!r}::DOUBLE) AS BIGINT) AS {name}"


def query(sql: str | None = None):
    """Registers a function of the reader of sensor tables as a query, with its oracle."""

    def add(f):
        RECORDED[f.__name__] = (lambda spark, sf_dir: f(partial(read, spark, sf_dir)), None if sql is None else oracle(sql))
        return f

    return add
