"""Running totals and exact quantiles that do not gather a table in one task.

Running totals come from sorted ranges, quantiles from repeated histograms; both are exact at any size.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import number
from ..session import checkpointed

#: Bins of a histogram, and values of an interval that are fetched rather than counted again.
BINS, FETCHED = 4096, 2000


def running_sum(df: DataFrame, order: Sequence[Column], value: str, out: str) -> DataFrame:
    """``df`` with the sum of ``value`` over its rows up to and with each one; ``order`` must be total."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = checkpointed(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "running")
    sums = placed.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = sums.select("_part", (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias("_before"))  # one row a range
    inside = F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return placed.join(F.broadcast(before), "_part").withColumn(out, inside + F.col("_before")).drop("_part", "_before")


def order_statistics(values: DataFrame, at: Mapping[str, Sequence[int]], bounds: Mapping[str, tuple[float, float]], bins: int = BINS, fetched: int = FETCHED) -> dict[tuple[str, int], float]:
    """The values at positions (from 0, in order) of several groups: ``values`` has g (of a few groups) and x, ``bounds`` their least and largest x.

    Each pass counts, for all groups and positions together, the bins of the intervals that hold them, at most
    ``bins`` rows an interval; intervals of few values are fetched. A value that fills an interval alone is found from its bounds.
    """
    left = {(g, k): (k, *bounds[g]) for g, ks in at.items() for k in ks}
    found: dict[tuple[str, int], float] = {}
    while left:
        done = {key for key, (_, lo, hi) in left.items() if not lo < hi}
        found |= {key: left[key][1] for key in done}
        left = {key: v for key, v in left.items() if key not in done}
        spans = sorted({(g, lo, hi) for (g, _), (_, lo, hi) in left.items()})
        if not spans:
            break
        rows = _spanned(values, spans)
        width = F.element_at(F.array(*[F.lit((hi - lo) / bins) for _, lo, hi in spans]), F.col("span") + 1)
        low = F.element_at(F.array(*[F.lit(float(lo)) for _, lo, _ in spans]), F.col("span") + 1)
        cut = F.when(width > 0, F.least(F.floor((F.col("x") - low) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))).otherwise((F.col("x") > low).cast("long"))
        counted = rows.groupBy("span", cut.alias("b")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
        by: dict[int, list] = {}
        for r in sorted(counted, key=lambda r: (r["span"], r["b"])):
            by.setdefault(r["span"], []).append(r)
        few: dict[tuple[str, float, float], list] = {}
        for key, (k, lo, hi) in list(left.items()):
            for r in by[spans.index((key[0], lo, hi))]:
                if k < r["n"]:
                    break
                k -= r["n"]
            left[key] = (k, r["lo"], r["hi"])
            if r["lo"] < r["hi"] and r["n"] <= fetched:
                few.setdefault((key[0], r["lo"], r["hi"]), []).append(key)
        if few:
            some = sorted(few)
            got: dict[int, list[float]] = {}
            for r in _spanned(values, some).select("span", "x").collect():
                got.setdefault(r["span"], []).append(r["x"])
            for i, span in enumerate(some):
                for key in few[span]:
                    found[key] = sorted(got[i])[left.pop(key)[0]]
    return found


def _spanned(values: DataFrame, spans: Sequence[tuple[str, float, float]]) -> DataFrame:
    """x and span, the number of the interval that holds it; intervals of a group are disjoint."""
    span = F.when(F.lit(False), 0)
    for i, (g, lo, hi) in enumerate(spans):
        span = span.when((F.col("g") == g) & F.col("x").between(lo, hi), i)
    return values.select(span.alias("span"), "x").where("span IS NOT NULL")


def order_statistic(df: DataFrame, column: str, k: int, low: float, high: float, bins: int = BINS, fetched: int = FETCHED) -> float:
    """The value at position ``k`` of a column with the bounds ``low`` and ``high``."""
    return order_statistics(df.select(F.lit("").alias("g"), F.col(column).alias("x")), {"": [k]}, {"": (low, high)}, bins, fetched)["", k]


def many_quantiles(df: DataFrame, columns: Sequence[str], at: Sequence[float]) -> dict[str, list[float | None]]:
    """Exact interpolated quantiles of numeric columns, all from the same few passes; missing values are left out."""
    pairs = F.array(*[F.struct(F.lit(c).alias("g"), number(F.col(c)).cast("double").alias("x")) for c in columns])
    values = df.select(F.explode(pairs).alias("v")).select("v.*").where("x IS NOT NULL")
    stats = {r["g"]: r for r in values.groupBy("g").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()}
    places = {g: [q * (r["n"] - 1) for q in at] for g, r in stats.items()}
    found = order_statistics(values, {g: sorted({f(p) for p in ps for f in (math.floor, math.ceil)}) for g, ps in places.items()}, {g: (r["lo"], r["hi"]) for g, r in stats.items()})
    between = lambda a, b, f: a + (b - a) * f
    return {c: [between(found[c, math.floor(p)], found[c, math.ceil(p)], p % 1) for p in places[c]] if c in stats else [None] * len(at) for c in columns}


def quantiles(df: DataFrame, column: str, at: Sequence[float]) -> list[float | None]:
    """Exact interpolated quantiles of a numeric column; missing values are left out."""
    return many_quantiles(df, [column], at)[column]
