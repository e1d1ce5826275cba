"""Whitening of embeddings by hierarchical merging of singular value decompositions.

Each partition decomposes its rows, in blocks, and keeps their number, their mean and all singular values and
right vectors of the centred rows. Two such states merge by stacking their scaled vectors and one more row,
sqrt(n m / (n + m)) times the difference of the means, and decomposing again: exactly what decomposing
all rows at once would give, so no dimension is lost. States merge in groups of FAN, level by level, on the
executors; what reaches the driver is the last one, whose size depends on the width alone.

Values are taken relative to an origin, the vector of some row, before anything is multiplied, so a large
common offset costs no digits; of whole numbers the sums are exact.

Defined results: vectors that are null, or hold null or non-finite entries or such of 2^45 and more in size, are dropped, and so are
those of another length than most have (the smaller one on ties); components without variance (beyond the rank)
are left out, so tables without two different vectors, and empty ones, give an empty result. Repeated
vectors count once in the fit and are transformed each; ids may be null or repeat. Further columns of the input are kept by
``Whitening.transform``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import released, table, written

#: Components that are kept.
COMPONENTS = 16
#: States that merge in one task.
FAN = 8
#: Rows that are decomposed at once.
BLOCK = 4096
#: Entries of this size and above count as broken: whole numbers of 64 times that are exact as doubles.
LARGEST = 2.0**45

_STATE = "node int, n long, total array<double>, scale array<double>, axes array<double>"


@dataclass(frozen=True)
class State:
    """Rows seen: their number, the sum of their offsets from the origin, and the singular values and right vectors of the centred rows."""

    n: int
    total: np.ndarray
    scale: np.ndarray
    axes: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray) -> State:
        total = rows.sum(axis=0)
        return cls(len(rows), total, *_decomposed(rows - total / len(rows)))

    def merged(self, other: State) -> State:
        n = self.n + other.n
        correction = np.sqrt(self.n * other.n / n) * (self.total / self.n - other.total / other.n)
        stacked = np.vstack([self.scale[:, None] * self.axes, other.scale[:, None] * other.axes, correction])
        return State(n, self.total + other.total, *_decomposed(stacked))

    def covariance(self) -> np.ndarray:
        scaled = self.scale[:, None] * self.axes
        return scaled.T @ scaled / self.n


def _decomposed(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, scale, axes = np.linalg.svd(rows, full_matrices=False)
    return scale, axes


def merged(states: Iterable[State]) -> State | None:
    out = None
    for s in states:
        out = s if out is None else out.merged(s)
    return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _row(node: int, s: State) -> dict:
    return {"node": [node], "n": [s.n], "total": [s.total.tolist()], "scale": [s.scale.tolist()], "axes": [s.axes.ravel().tolist()]}


def _state(n: int, total, scale, axes) -> State:
    total = np.asarray(total, float)
    return State(int(n), total, np.asarray(scale, float), np.asarray(axes, float).reshape(-1, len(total)))


def decomposed(vectors: DataFrame, column: str, origin: np.ndarray) -> State | None:
    """The state of all vectors (arrays of one length) of a column; None without rows."""
    width = len(origin)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            for i in range(0, b.num_rows, BLOCK):
                s = State.of(_matrix(b.column(0).slice(i, BLOCK), width) - origin)
                held = s if held is None else held.merged(s)
        if held is not None:
            yield pa.RecordBatch.from_pydict(_row(TaskContext.get().partitionId(), held), pa.schema([("node", pa.int32()), ("n", pa.int64()), *[(c, pa.list_(pa.float64())) for c in ("total", "scale", "axes")]]))

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        return pd.DataFrame(_row(int(rows["node"].iloc[0]) // FAN, merged(_state(*r) for r in rows[["n", "total", "scale", "axes"]].itertuples(index=False))))

    states = written(vectors.select(column).mapInArrow(released(of), _STATE), "whitening-states")
    last = states.agg(F.max("node")).first()[0]
    while last:
        states = states.groupBy(F.floor(F.col("node") / FAN)).applyInPandas(join, _STATE)
        last //= FAN
    row = states.first()
    return None if row is None else _state(row["n"], row["total"], row["scale"], row["axes"])


@dataclass(frozen=True)
class Whitening:
    """A fit: rows, origin, sum of offsets from it, unit components as columns (falling variance), their variances, and the variance of all dimensions."""

    n: int
    origin: np.ndarray
    total: np.ndarray
    components: np.ndarray
    variance: np.ndarray
    all_variance: float

    @classmethod
    def of(cls, s: State, origin: np.ndarray, components: int) -> Whitening:
        rank = int((s.scale > (s.scale[0] if len(s.scale) else 0) * max(s.n, len(origin)) * np.finfo(float).eps).sum())
        axes = s.axes[: min(components, rank)]
        # Either sign would do; the largest entry is made positive, so that reruns agree.
        sign = np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)]) if len(axes) else np.ones(0)
        return cls(s.n, origin, s.total, (axes * sign[:, None]).T, s.scale[: len(axes)] ** 2 / s.n, float((s.scale**2).sum() / s.n))

    @property
    def explained(self) -> list[float]:
        return (self.variance / self.all_variance).tolist() if len(self.variance) else []

    def _values(self, offsets: np.ndarray) -> np.ndarray:
        return (offsets - self.total / self.n) @ (self.components / np.sqrt(self.variance))

    def _deviation(self, offsets: np.ndarray) -> np.ndarray:
        """Sums of (n x - S)^2 over whole numbers x; S is their sum over the fit. Raises where 64 bits do not hold them."""
        scaled = self.n * offsets.astype(np.int64) - self.total.astype(np.int64)
        if len(scaled) and (scaled.astype(float) ** 2).sum(axis=1).max() >= 2.0**63:
            raise OverflowError("a deviation does not fit 64 bits")
        return (scaled * scaled).sum(axis=1)

    def transform(self, df: DataFrame, column: str, out: str = "whitened", deviation: str | None = None) -> DataFrame:
        """``df`` (vectors of the fit's length) with the whitened values as an array and, for whole numbers, the exact deviation from the mean."""
        width, kept = len(self.origin), df.columns
        whole = deviation is not None

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                offsets = _matrix(b.column(1), width) - self.origin
                z = self._values(offsets)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32()), pa.array(z.ravel(), pa.float64()))
                found = [b.column(0), lists, *([pa.array(self._deviation(offsets), pa.int64())] if whole else [])]
                yield pa.RecordBatch.from_arrays(found, ["row", "z", *(["d"] if whole else [])])

        rows = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(column).alias("x"))
        schema = f"row {rows.schema['row'].dataType.simpleString()}, z array<double>" + (", d long" if whole else "")
        return rows.mapInArrow(released(of), schema).select("row.*", F.col("z").alias(out), *([F.col("d").alias(deviation)] if whole else []))


def usable(df: DataFrame, column: str) -> DataFrame:
    """The rows of ``df`` whose vector is whole, and as long as most are."""
    c = lambda x: x.cast("double")
    broken = F.exists(column, lambda x: x.isNull() | F.isnan(c(x)) | (F.abs(c(x)) >= LARGEST))
    rows = df.where(F.col(column).isNotNull() & (F.size(column) > 0) & ~broken)
    common = rows.groupBy(F.size(column).alias("width")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "width").first()
    return rows.where(F.size(column) == (common["width"] if common else 0))


def fit(vectors: DataFrame, column: str, components: int = COMPONENTS) -> tuple[Whitening | None, float | None]:
    """The whitening of the distinct vectors of a column, and the largest entry of their whitened covariance minus the identity."""
    once = written(vectors.select(F.col(column).alias("x")).distinct(), "whitening-fit")
    first = once.first()
    if first is None:
        return None, None
    origin = np.asarray(first["x"], float)
    found = Whitening.of(decomposed(once, "x", origin), origin, components)
    k = len(found.variance)
    if not k:
        return found, None
    again = decomposed(found.transform(once, "x", "z"), "z", np.zeros(k))
    return found, float(np.abs(again.covariance() - np.eye(k)).max())


def _whole(column: str) -> Column:
    return F.transform(column, lambda c: F.floor(64 * c.cast("double")) + F.lit(1_000_000).cast("long"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding").select("vec_id", _whole("embedding").alias("x"))
    found, error = fit(rows, "x")
    if error is None:
        return spark.createDataFrame([], f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    each = found.transform(rows, "x", "z", "deviation").select("vec_id", "deviation", F.posexplode("z").alias("at", "whitened"))
    share = F.element_at(F.array(*[F.lit(x) for x in found.explained]), F.col("at") + 1)
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(found.n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))
