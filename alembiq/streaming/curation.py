"""Curation of measurements as they arrive: for each compound the best record, the number of measurements and their median, kept as state.

The curation of a table as a streaming aggregate. The state of a key is its best record so far and a histogram of its values (distinct values and how often each
occurred), so the median is exact, batches can come in any cut, and nothing is read again. Each batch returns the
current row of the keys it touched; n_measurements only grows, so of several rows of a key the largest one is the last.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..operators.curation import deduplicate
from .scoring import latest

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def deduplicated(stream: DataFrame, key: str, value: str = "standard_value", order: Sequence[str] = ("source_index",)) -> DataFrame:
    """A stream of updated rows, one for each key a batch touches: the key's row of highest confidence_score (the first in ``order`` among equals), its median value and n_measurements.

    What ``operators.curation.deduplicate`` gives of a table; ``order`` must tell rows apart. Null and empty keys are dropped, values that are no
    numbers count as measurements but not in the median. Update mode; the state store of ``stateful`` keeps states out of the heap.
    """
    return deduplicate(stream, key, value, "median", order)


@contextmanager
def stateful(spark: SparkSession) -> Iterator[None]:
    """The state store that keeps states out of the heap, while a query starts."""
    old = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, old)


def curated(stream: DataFrame, key: str, out: str, checkpoint: str, value: str = "standard_value", order: Sequence[str] = ("source_index",)) -> DataFrame:
    """All keys' current rows once all that has arrived is in; a later call goes on where this one ended."""
    with stateful(stream.sparkSession):
        return latest(deduplicated(stream, key, value, order), [key], out, checkpoint)
