"""Pieces that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, and what parts words: ASCII white space only.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share. Where it is unset a session on one machine, as in tests, gets a
    temporary folder; a cluster raises, since no folder of its driver would be seen by its executors."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


#: A key with this share of all rows is hot; so there are at most as many hot keys.
HOT_KEYS = 10_000


def with_class(rows: DataFrame, classes: DataFrame, on: list[str], n: str, total: int) -> DataFrame:
    """rows joined to classes: one row for each value of `on`, with n, how many of the `total` rows have it.

    Keys that hold a HOT_KEYS-th of all rows or more are at most HOT_KEYS in number, so those are broadcast and their
    rows stay where they are; the others are shuffled, and none of them is hot. classes is read twice: store it.
    """
    hot = F.col(n) * F.lit(HOT_KEYS) >= F.lit(total)
    few = F.broadcast(classes.filter(hot))
    rest = rows.join(F.broadcast(classes.filter(hot).select(*on)), on, "left_anti").join(classes.filter(~hot), on)
    return rows.join(few, on).unionByName(rest)


class Tables:
    """The tables that one run of a pipeline has written, by what they are needed for: `inner` are a stage's own, needed
    until its result is written, `before` those of the stage before it."""

    def __init__(self) -> None:
        self.inner: list[str] = []
        self.before: list[str] = []
        self.output: list[str] = []

    def keep(self, df: DataFrame) -> DataFrame:
        """A stage's result, written; that of the stage before, which it was made from, goes."""
        out, path = written(df)
        drop(df.sparkSession, self.output)
        self.output = [path]
        return out


#: The run whose stage is at work, in this thread or task alone; None outside a stage. And the run that stages called one
#: by one belong to.
_NOW: ContextVar[Tables | None] = ContextVar("now", default=None)
_RUN: ContextVar[Tables | None] = ContextVar("run", default=None)


def stored(df: DataFrame) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back; cuts lineage and survives lost executors.

    Within a stage the table goes when the next stage starts; any other goes with the application at the latest.
    """
    out, path = written(df)
    if (tables := _NOW.get()) is not None:
        tables.inner.append(path)
    return out


#: Bytes of rows that go to a Python worker at once; by Spark's own setting 64 MB, held by either side in several copies.
BATCH = 2 << 20
BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
_LOCK, _INSIDE = threading.Lock(), {}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of BATCH bytes for what this session runs meanwhile; the last one to leave puts its setting back."""
    with _LOCK:
        n, before = _INSIDE.get(spark) or (0, spark.conf.get(BATCH_KEY))
        _INSIDE[spark] = n + 1, before
        spark.conf.set(BATCH_KEY, BATCH)
    try:
        yield
    finally:
        with _LOCK:
            n, before = _INSIDE.pop(spark)
            if n > 1:
                _INSIDE[spark] = n - 1, before
            else:
                spark.conf.set(BATCH_KEY, before)


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """df as a table of the shared folder, and where it is."""
    path = f"{shared_dir(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    drop_at_end(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


@contextmanager
def one_run() -> Iterator[Tables]:
    """Stages called within belong to one run and to no other, whatever runs beside them."""
    tables = Tables()
    token = _RUN.set(tables)
    try:
        yield tables
    finally:
        _RUN.reset(token)


def staged(stage):
    """A stage of a pipeline whose result is written before the run's next stage starts: when that one starts, the tables
    that this one stored are deleted, so only one stage's are there at a time. Stages called outside one_run() belong to
    a run of their thread's (or context's) own, one after the other."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        tables = _RUN.get()
        if tables is None:
            _RUN.set(tables := Tables())
        drop(spark, tables.before)
        tables.inner, tables.before = [], []
        token = _NOW.set(tables)
        try:
            return stage(spark, docs, sf_dir)
        finally:
            _NOW.reset(token)
            tables.before = tables.inner

    return run


def _file(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def drop_at_end(spark: SparkSession, path: str) -> None:
    """The file system deletes path when the application ends."""
    p, fs = _file(spark, path)
    fs.deleteOnExit(p)


def drop(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        p, fs = _file(spark, path)
        fs.delete(p, True)
        fs.cancelDeleteOnExit(p)
