"""Sums of products of vectors (Gram matrices), and what follows from them: folds, shuffled labels, leverage.

One scan gives the matrices of all groups. A task adds up its rows in blocks and returns each matrix as packed
square tiles; tiles of one place are added on the executors, FAN at a time, level by level. What reaches the driver
are the sums, whose size depends on the width and the number of groups alone. Values are taken
relative to an origin, so an offset that all rows share costs no digits.

A least-squares model of any set of groups is solved from the sum of their matrices, and its errors on a group follow from
that group's matrix: k folds need one scan instead of k trainings, and n shuffles of the labels are n more columns of it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .running import running_sum

#: Rows that are multiplied at once, side of a tile, tiles that are added in one task.
BLOCK, TILE, FAN = 4096, 256, 16
#: Entries of a matrix at most, over all groups of a task.
MOST = 1 << 27

_TILES = pa.schema([("g", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("node", pa.int32()), ("m", pa.binary())])


def vector(columns: Sequence[str]) -> Column:
    """The columns as an array of doubles; null where any is null, not a number or infinite."""
    number = [F.col(c).cast("double") for c in columns]
    broken = F.exists(F.array(*number), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~broken, F.array(*number))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


@dataclass(frozen=True)
class Gram:
    """Sum over rows of [1, x - origin]' [1, x - origin]."""

    origin: np.ndarray
    sums: np.ndarray

    @property
    def n(self) -> int:
        return round(self.sums[0, 0])

    def __add__(self, other: Gram) -> Gram:
        return Gram(self.origin, self.sums + other.sums)

    def __sub__(self, other: Gram) -> Gram:
        return Gram(self.origin, self.sums - other.sums)

    def covariance(self) -> np.ndarray:
        """Of the population; zero without rows."""
        mean = self.sums[0, 1:] / max(self.n, 1)
        return self.sums[1:, 1:] / max(self.n, 1) - np.outer(mean, mean)


def grams(df: DataFrame, column: str, group: Column | None = None, centred: bool = True) -> dict[int, Gram]:
    """The matrix of the vectors of a column (rows without one are left out) for each value of ``group`` (a small integer), in one scan."""
    rows = df.select(F.col(column).alias("x"), (F.lit(0) if group is None else group).cast("int").alias("g")).where("x IS NOT NULL AND g IS NOT NULL")
    first = rows.first()
    if first is None:
        return {}
    p = len(first["x"])
    origin = np.asarray(first["x"], float) if centred else np.zeros(p)
    edges = range(0, p + 1, TILE)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                x, g = matrix(b.column(0).slice(at, BLOCK), p) - origin, b.column(1).slice(at, BLOCK).to_numpy()
                for k in np.unique(g).tolist():
                    own = np.hstack([np.ones((int((g == k).sum()), 1)), x[g == k]])
                    if k not in sums:
                        if (len(sums) + 1) * (p + 1) ** 2 > MOST:
                            raise ValueError("too many groups for vectors of this width")
                        sums[k] = np.zeros((p + 1, p + 1))
                    sums[k] += own.T @ own
        node = TaskContext.get().partitionId()
        for k, s in sums.items():
            for i in edges:
                tiles = [(k, i, j, node, s[i : i + TILE, j : j + TILE].tobytes()) for j in edges if j >= i]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*tiles), _TILES.types)], schema=_TILES)

    def add(t: pa.Table) -> pa.Table:
        t = t.sort_by("node")
        total = sum(np.frombuffer(m.as_py()) for m in t.column("m"))
        row = [t.column(c)[0].as_py() for c in ("g", "i", "j")]
        return pa.table([[row[0]], [row[1]], [row[2]], [t.column("node")[0].as_py() // FAN], [total.tobytes()]], schema=_TILES)

    ddl = "g int, i int, j int, node int, m binary"
    tiles = checkpointed(rows.mapInArrow(of, ddl), "gram-tiles")
    last = tiles.agg(F.max("node")).first()[0]
    while last:
        tiles = tiles.groupBy("g", "i", "j", F.floor(F.col("node") / FAN)).applyInArrow(lambda t: add(t), ddl)
        last //= FAN
    out: dict[int, np.ndarray] = {}
    for r in tiles.toLocalIterator():
        s = out.setdefault(r["g"], np.zeros((p + 1, p + 1)))
        high, wide = min(TILE, p + 1 - r["i"]), min(TILE, p + 1 - r["j"])
        tile = np.frombuffer(r["m"]).reshape(high, wide)
        s[r["i"] : r["i"] + high, r["j"] : r["j"] + wide] = tile
        s[r["j"] : r["j"] + wide, r["i"] : r["i"] + high] = tile.T
    return {k: Gram(origin, s) for k, s in sorted(out.items())}


def least_squares(g: Gram, features: int, ridge: float = 0.0) -> np.ndarray:
    """Intercept and coefficients (rows), relative to the origin, of the columns after the first ``features`` (columns). ``ridge`` is relative to standardised features; constant ones get 0."""
    c, mean = g.covariance(), g.sums[0, 1:] / max(g.n, 1)
    sd = np.sqrt(np.maximum(np.diag(c)[:features], 0))
    sd = np.where(sd > 1e-12 * np.sqrt(np.maximum(np.diag(g.sums)[1 : features + 1] / max(g.n, 1), 1e-300)), sd, np.inf)
    inner = c[:features, :features] / np.outer(sd, sd)
    w = np.linalg.pinv(inner + ridge * np.eye(features), hermitian=True) @ (c[:features, features:] / sd[:, None]) / sd[:, None]
    return np.vstack([mean[features:] - mean[:features] @ w, w])


def scores(g: Gram, features: int, model: np.ndarray) -> list[dict[str, float]]:
    """n, r2, rmse and pearson (0 where undefined) of each label's model on the rows of a matrix."""
    out, s, n = [], g.sums, g.n
    for k in range(model.shape[1]):
        u, y = np.zeros(len(s)), 1 + features + k
        u[: features + 1] = model[:, k]
        residual = u.copy()
        residual[y] -= 1
        sse, sst = max(float(residual @ s @ residual), 0.0), float(s[y, y] - s[0, y] ** 2 / n) if n else 0.0
        fitted, both = float(u @ s @ u - (u @ s[0]) ** 2 / n) if n else 0.0, float(u @ s[y] - (u @ s[0]) * s[0, y] / n) if n else 0.0
        ok = sst > 1e-12 * max(s[y, y], 1e-300) and n > 0
        out.append({"n": n, "r2": 1 - sse / sst if ok else 0.0, "rmse": math.sqrt(sse / n) if n else 0.0, "pearson": both / math.sqrt(sst * fitted) if ok and fitted > 1e-12 * sst else 0.0})
    return out


def cross_validate_linear(df: DataFrame, features: Sequence[str], label: str, id_: str, k: int = 5, seed: int = 42, ridge: float = 0.0) -> DataFrame:
    """fold, n, r2, rmse, pearson: least squares fitted on the other folds, judged on each, from one scan. Rows that lack a value are left out."""
    from .modelling import folds

    rows = folds(df.select(F.col(id_).alias("_id"), vector([*features, label]).alias("x")), "_id", k, seed)
    found, p = grams(rows, "x", F.col("fold")), len(features)
    total = sum(list(found.values())[1:], next(iter(found.values()))) if found else None
    out = [(f, *scores(g, p, least_squares(total - g, p, ridge))[0].values()) for f, g in found.items()]
    return df.sparkSession.createDataFrame(out, "fold int, n long, r2 double, rmse double, pearson double")


#: Odd steps between the multipliers of shuffles, and their bound: products with row numbers up to 2^43 fit 64 bits.
_STEP, _LARGEST = 7919, 1 << 20


def shuffles(n: int, how_many: int) -> list[tuple[int, int]]:
    """Multipliers a, prime to ``n``, and shifts b: row j's label goes to row (a j + b) mod n, a different order each."""
    out = []
    for s in range(1, how_many + 1):
        a = (s * _STEP * 2 + 1) % min(n, _LARGEST) or 1
        while math.gcd(a, n) != 1:
            a += 1
        out.append((a, s * _STEP % n))
    return out


def shuffled_scores(df: DataFrame, features: Sequence[str], label: str, id_: str, n: int = 10, seed: int = 42, ridge: float = 0.0) -> DataFrame:
    """shuffle (0: the true labels), n, r2: training scores of least squares with ``n`` shuffles of the labels, from one scan.

    Rows are numbered in the order of a hash of the id (ids must be distinct), and a shuffle sends the label of row j to
    row (a j + b) mod rows. All shuffles are one exchange of the labels.
    """
    from .modelling import id_hash

    rows = df.select(F.col(id_).alias("_id"), vector([*features, label]).alias("x")).where("x IS NOT NULL").withColumn("_h", id_hash(F.col("_id"), seed)).withColumn("_one", F.lit(1))
    numbered = checkpointed(running_sum(rows, [F.col("_h"), F.col("_id")], "_one", "_i").select((F.col("_i") - 1).cast("long").alias("i"), "x"), "shuffled")
    count, p = numbered.count(), len(features)
    if not count:
        return df.sparkSession.createDataFrame([], "shuffle int, n long, r2 double")
    sent = F.array(*[F.struct(F.lit(s).alias("s"), ((F.col("i") * a + b) % count).alias("i")) for s, (a, b) in enumerate(shuffles(count, n))])
    moved = numbered.select(F.explode(sent).alias("to"), F.get("x", F.lit(p)).alias("y")).groupBy(F.col("to.i").alias("i")).agg(*[F.max(F.when(F.col("to.s") == s, F.col("y"))).alias(f"y{s}") for s in range(n)])
    wide = numbered.join(moved, "i").select(F.concat("x", F.array(*[F.col(f"y{s}") for s in range(n)]) if n else F.array().cast("array<double>")).alias("x"))
    g = grams(wide if n else numbered, "x")[0]
    out = [(s, count, m["r2"]) for s, m in enumerate(scores(g, p, least_squares(g, p, ridge)))]
    return df.sparkSession.createDataFrame(out, "shuffle int, n long, r2 double")


def leverage(train: DataFrame, query: DataFrame, column: str, factor: float = 3.0) -> DataFrame:
    """``query`` with leverage and in_domain (leverage <= factor * p / n) of its vectors, null where there is none. No row of ``train`` has a vector: null.

    x (X'X)+ x' with the matrix of the training vectors as they are; its pseudo-inverse is p by p.
    """
    found = grams(train, column, centred=False).get(0)
    kept = [c for c in query.columns if c not in ("leverage", "in_domain")]
    if found is None:
        return query.select(*[F.col(f"`{c}`") for c in kept]).withColumns({"leverage": F.lit(None).cast("double"), "in_domain": F.lit(None).cast("boolean")})
    p = len(found.origin)
    inverse, limit = np.linalg.pinv(found.sums[1:, 1:], hermitian=True), factor * p / found.n

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            have = np.flatnonzero(b.column(1).is_valid().to_numpy(zero_copy_only=False))
            h = np.full(b.num_rows, np.nan)
            x = matrix(b.column(1).take(pa.array(have)), p)
            h[have] = np.einsum("ij,ij->i", x @ inverse, x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(h, mask=np.isnan(h))], ["row", "h"])

    rows = query.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(column).alias("x"))
    done = rows.mapInArrow(of, f"row {rows.schema['row'].dataType.simpleString()}, h double")
    return done.select("row.*", F.col("h").alias("leverage"), (F.col("h") <= limit).alias("in_domain"))


def principal_axes(df: DataFrame, column: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, the first ``k`` components (columns, largest entry positive) and their variances, of vectors of any width."""
    g = grams(df, column).get(0)
    if g is None:
        return np.zeros(0), np.zeros((0, 0)), np.zeros(0)
    e, axes = np.linalg.eigh(g.covariance())
    axes = axes[:, ::-1][:, :k]
    sign = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    return g.origin + g.sums[0, 1:] / g.n, axes * sign, e[::-1][:k]
