"""Which values of a very large table occur in a smaller one: a Bloom filter of the smaller one keeps most others from being shuffled.

The filter is built by bit-or aggregates, word by word, and is one row: an array of words that every task of the
large scan probes at HASHES places. What passes is exact after the join that follows; values wrongly passed
(about one in a hundred) only cost their shuffle.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits a value, places that are set for each, and bits of a filter at most (32 MB); a smaller table with more values is not filtered by.
BITS, HASHES, MOST = 10, 5, 1 << 28


def _places(value: Column, bits: int) -> list[Column]:
    text = value.cast("string")
    a, b = F.xxhash64(text), F.xxhash64(text, F.lit(1))
    # Shifted down, so that sums stay in 64 bits.
    return [F.pmod(F.shiftright(a, 4) + F.shiftright(b, 4) * i, F.lit(bits)) for i in range(HASHES)]


def bloom(values: DataFrame, column: str, bits: int) -> DataFrame:
    """One row with ``words``: the filter of ``bits`` (a multiple of 64) of a column's values."""
    places = values.where(F.col(column).isNotNull()).select(F.explode(F.array(*_places(F.col(column), bits))).alias("p"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))
    words = places.groupBy((F.col("p") / 64).cast("long").alias("w")).agg(F.bit_or(bit).alias("b"))
    every = values.sparkSession.range(bits // 64).withColumnRenamed("id", "w").join(words, "w", "left")
    return every.agg(F.transform(F.sort_array(F.collect_list(F.struct("w", F.coalesce("b", F.lit(0).cast("long")).alias("b")))), lambda s: s["b"]).alias("words"))


def passing(df: DataFrame, column: str, words: DataFrame, bits: int) -> DataFrame:
    """The rows of ``df`` whose value may be among those of the filter; never a row less."""
    row = words.withColumnRenamed("words", "_words")
    test = lambda p: F.call_function("shiftright", F.get("_words", (p / 64).cast("int")), (p % 64).cast("int")).bitwiseAND(F.lit(1)) == 1
    return df.join(F.broadcast(row)).where(reduce(and_, [test(p) for p in _places(F.col(column), bits)])).drop("_words")


def occurring(large: DataFrame, small: DataFrame, column: str) -> DataFrame:
    """Distinct values of ``large`` in a column: all that occur in ``small``, and few others."""
    rows = large.select(column).where(F.col(column).isNotNull())
    n = small.where(F.col(column).isNotNull()).agg(F.approx_count_distinct(column)).first()[0]
    bits = max(64, -(-n * BITS // 64) * 64)
    if bits > MOST:
        return rows.distinct()
    return passing(rows, column, bloom(small, column, bits), bits).distinct()
