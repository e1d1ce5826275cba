"""Helpers the corpus operators share: written intermediate tables, word splitting, workers' memory."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed, clean_up, remove, work_path  # noqa: F401

#: The six white-space characters that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPACES_RE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Rows of a batch that carries whole texts to Python at most, and rows of a few numbers that are broadcast at most.
TEXT_ROWS, FEW = 2000, 1_000_000

written = checkpointed


def text_batches(spark: SparkSession) -> None:
    """Let batches for Python hold few rows from now on, since rows hold whole texts: workers and the JVM keep a batch in memory several times over."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= TEXT_ROWS:
        spark.conf.set(name, str(TEXT_ROWS))


def few(df: DataFrame) -> DataFrame:
    """``df``, a written table of a few numbers a row, to be broadcast if it has at most FEW rows, and shuffled otherwise."""
    return F.broadcast(df) if df.count() <= FEW else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_cuts(df: DataFrame, column: str, parts: int, error: float) -> list[float]:
    """At most ``parts`` - 1 distinct values that cut the column into about equal ranges; none for empty and all-null columns."""
    at = [i / parts for i in range(1, parts)]
    return sorted(set(df.where(F.col(column).isNotNull()).approxQuantile(column, at, error))) if at else []


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def strip_spaces(text: Column) -> Column:
    return F.trim(text, F.lit(SPACES))


def words(text: Column) -> Column:
    """The maximal runs of characters other than SPACES; null or blank texts have none."""
    stripped = strip_spaces(F.coalesce(text, F.lit("")))
    return F.when(stripped == "", F.array().cast("array<string>")).otherwise(F.split(stripped, SPACES_RE))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def released(task: Callable[..., Iterator], *forget: Callable[[], None]) -> Callable[..., Iterator]:
    """``task``, a function over the batches of a partition, after which a Python worker gives its memory back.

    Workers are used again by later tasks and stages, so what they keep would add up. ``forget`` is called first.
    """

    @wraps(task)
    def run(*args) -> Iterator:
        try:
            yield from task(*args)
        finally:
            for f in forget:
                f()
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return run
