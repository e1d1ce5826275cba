"""Nearest-neighbour graphs of vectors by descent, and their layout in the plane.

The graph starts from neighbours in random projections and is refined: a row's neighbours, and the rows whose neighbour it is, are
compared with each other, since neighbours of a row are often neighbours; a row keeps its best, and lists are bounded, so every
round costs the same for each row at most; only pairs as near as a row's farthest neighbour so far leave a task. No row meets all others.

The layout moves points along a neighbour-embedding gradient: edges attract, all points repel. Repulsion comes from the cells of a
grid over the plane, whose number is fixed, so its broadcast does not grow. A round deals the points, in order of their first
coordinate, over blocks that make several steps against their neighbours' last known places. A row that is a neighbour of very
many others brings all its edges to its block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from .grams import principal_axes

#: Rows that a projection's neighbourhoods hold, projections at the start, lists that are compared in one group, points of a block of the layout, and cells of a side of its grid.
LEAF, PROJECTIONS, LISTS, BLOCK_POINTS, CELLS = 64, 4, 256, 20_000, 24


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.combine_chunks()
    return rows.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), -1)


def _best_pairs(t: pa.Table, k: int) -> pa.Table:
    """For each of the vectors of a small group the ``k`` nearest others of it, not farther than the row's ``far`` where the table has it: a, b, d."""
    id_, x = t.column("id").to_numpy(), _matrix(t.column("v"))
    sq = (x * x).sum(axis=1)
    d = np.maximum(sq[:, None] + sq[None] - 2 * x @ x.T, 0)
    d[id_[:, None] == id_[None]] = np.inf
    limit = t.column("far").to_numpy()[:, None] if "far" in t.column_names else np.inf
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    a, b, far = np.repeat(id_, near.shape[1]), id_[near].ravel(), np.sqrt(np.take_along_axis(d, near, axis=1)).ravel()
    keep = np.isfinite(far) & (far <= np.broadcast_to(limit, near.shape).ravel())
    return pa.table({"a": pa.array(a[keep], pa.int64()), "b": pa.array(b[keep], pa.int64()), "d": pa.array(far[keep], pa.float64())})


def _best_of_lists(t: pa.Table, k: int) -> pa.Table:
    """``_best_pairs`` of each list x of a table, of all pairs found the ``k`` nearest of a row."""
    t = t.sort_by([("x", "ascending"), ("id", "ascending")])
    x = t.column("x").to_numpy()
    cuts = [0, *(np.flatnonzero(x[1:] != x[:-1]) + 1).tolist(), len(x)]
    found = pa.concat_tables([_best_pairs(t.slice(i, j - i), k) for i, j in zip(cuts, cuts[1:])])
    a, b, d = (found.column(c).to_numpy() for c in "abd")
    order = np.lexsort((b, d, a))
    order = order[np.concatenate(([True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])))] if len(order) else order
    starts = np.flatnonzero(np.concatenate(([True], a[order][1:] != a[order][:-1]))) if len(order) else np.zeros(0, int)
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.concatenate((starts, [len(order)]))))
    return found.take(pa.array(order[place < k]))


_EDGE = "a long, b long, d double"


def _top(edges: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of each a."""
    place = F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))
    return edges.groupBy("a", "b").agg(F.min("d").alias("d")).withColumn("place", place).where(F.col("place") <= k).drop("place")


def neighbour_graph(df: DataFrame, vector: str, k: int = 15, rounds: int = 5, id_: str = "id", seed: int = 7) -> DataFrame:
    """a, b, d: about the ``k`` nearest rows of each row by Euclidean distance. Ids must be distinct whole numbers; rows without a vector are left out.

    Approximate: measure the recall on a sample of rows where it matters. Projections are cut into neighbourhoods by
    quantiles of a sample, ties included, so rows that are all alike are dealt by a hash.
    """
    single = df.schema[vector].dataType.elementType.typeName() == "float"
    v = F.col(vector) if single else F.transform(vector, lambda x: x.cast("double"))
    rows = df.where(F.col(vector).isNotNull()).select(F.col(id_).cast("long").alias("id"), v.alias("v"))
    # The table may be one file; what is done with a row is not small.
    rows = checkpointed(rows.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, "id"), "graph-vectors")
    first, n = rows.first(), rows.count()
    if n < 2:
        return df.sparkSession.createDataFrame([], _EDGE)
    draw, edges = np.random.default_rng(seed), None
    for p in range(PROJECTIONS):
        axis = F.array(*[F.lit(float(w)) for w in draw.normal(size=len(first["v"]))])
        value = F.aggregate(F.zip_with("v", axis, lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)
        parts = -(-n // LEAF)
        placed = rows.withColumn("s", value + F.pmod(F.xxhash64("id", F.lit(p)), F.lit(1 << 20)) * 1e-15)
        # Leaves of about LEAF rows: ranges of the projection, of which a large number is cut again by a second hash.
        cuts = sorted(set(placed.approxQuantile("s", [i / min(parts, 512) for i in range(1, min(parts, 512))], 0.001))) if parts > 1 else []
        leaf = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<double>"), lambda c: c <= F.col("s")))
        again = -(-parts // 512)
        grouped = placed.withColumn("leaf", leaf).withColumn("again", F.pmod(F.xxhash64("id", F.lit(p + 100)), F.lit(again)))
        found = grouped.groupBy("leaf", "again").applyInArrow(lambda t: _best_pairs(t, k), _EDGE)
        edges = found if edges is None else edges.unionByName(found)
    edges = checkpointed(_top(edges, k), "graph")
    for turn in range(rounds):
        back = F.row_number().over(Window.partitionBy("b").orderBy(F.xxhash64("a", "b", F.lit(turn))))
        reverse = edges.withColumn("place", back).where(F.col("place") <= k).select(F.col("b").alias("x"), F.col("a").alias("id"))
        lists = edges.select(F.col("a").alias("x"), F.col("b").alias("id")).unionByName(reverse).unionByName(rows.select(F.col("id").alias("x"), "id")).distinct()
        far = edges.groupBy(F.col("a").alias("id")).agg(F.when(F.count("*") >= k, F.max("d")).alias("far"))
        held = rows.join(far, "id", "left").withColumn("far", F.coalesce("far", F.lit(float("inf"))))
        better = lists.join(held, "id").groupBy(F.pmod(F.xxhash64("x"), F.lit(-(-n // LISTS)))).applyInArrow(lambda t: _best_of_lists(t, k), _EDGE)
        edges = checkpointed(_top(edges.unionByName(better), k), "graph", edges)
    return edges


def edge_weights(edges: DataFrame) -> DataFrame:
    """a, b, w in both directions, with a sum of 1: weights that fall with the distance beyond the nearest, on the scale of the row's own neighbourhood."""
    own = Window.partitionBy("a")
    scaled = edges.withColumn("near", F.min("d").over(own)).withColumn("scale", F.avg(F.col("d") - F.col("near")).over(own))
    weighed = scaled.select("a", "b", F.exp(-(F.col("d") - F.col("near")) / F.greatest("scale", F.lit(1e-9))).alias("w"))
    both = weighed.unionByName(weighed.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("a", "b").agg(F.sum("w").alias("w"))
    total = both.agg(F.sum("w")).first()[0] or 1.0
    return both.select("a", "b", (F.col("w") / total).alias("w"))


def _repulsion(p: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Summed forces of the cells (x, y, n) on points, not yet divided by the sum of all kernels, and each point's share of that sum."""
    force, z = np.zeros_like(p), np.zeros(len(p))
    for at in range(0, len(p), 4096):
        delta = p[at : at + 4096, None, :] - cells[None, :, :2]
        q = 1 / (1 + (delta * delta).sum(axis=2))
        z[at : at + 4096] = (cells[:, 2] * q).sum(axis=1)
        force[at : at + 4096] = ((cells[:, 2] * q * q)[:, :, None] * delta).sum(axis=1)
    return force, z


def layout(df: DataFrame, vector: str, edges: DataFrame, rounds: int = 12, steps: int = 25, id_: str = "id") -> DataFrame:
    """id, x, y: places in the plane in which neighbours of the graph are near each other, from the first two principal components on.

    ``rounds`` passes of ``steps`` steps. Rows without an edge keep their component's place.
    """
    rows = df.where(F.col(vector).isNotNull()).select(F.col(id_).cast("long").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    mean, axes, variance = principal_axes(rows, "v", 2)
    if not len(mean):
        return df.sparkSession.createDataFrame([], "id long, x double, y double")
    spread = float(np.sqrt(max(variance[0], 1e-300)))

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = (b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(mean)) - mean) @ axes / spread
            p = np.hstack([p, np.zeros((len(p), 2 - p.shape[1]))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p[:, 0]), pa.array(p[:, 1])], ["id", "x", "y"])

    places = checkpointed(rows.mapInArrow(start, "id long, x double, y double"), "layout")
    n = places.count()
    weighed = checkpointed(edge_weights(edges), "layout-edges")
    for turn in range(rounds):
        box = places.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
        cell = lambda c, lo, hi: F.least(F.floor((F.col(c) - lo) / max((hi - lo) / CELLS, 1e-12)), F.lit(CELLS - 1))
        grid = places.groupBy(cell("x", box[0], box[1]), cell("y", box[2], box[3])).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n"))
        cells = np.array([(r["x"], r["y"], r["n"]) for r in grid.collect()])  # CELLS x CELLS rows at most
        # The sum of all kernels, with cells in place of both points; a point does not repel itself.
        z = float((cells[:, 2] * _repulsion(cells[:, :2], cells)[1]).sum()) - n
        parts = -(-n // BLOCK_POINTS)
        cuts = sorted(set(places.approxQuantile("x", [i / parts for i in range(1, parts)], 0.01))) if parts > 1 else []
        block = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<double>"), lambda c: c <= F.col("x")))
        pull, rate = 4.0 if turn < rounds // 4 else 1.0, max(n / 48, 5.0)

        def move(t: pa.Table, cells: np.ndarray = cells, z: float = z, pull: float = pull, rate: float = rate) -> pa.Table:
            a, b = t.column("id").to_numpy(), t.column("b").to_numpy()
            id_, at = np.unique(a, return_index=True)
            p = np.stack([t.column(c).to_numpy()[at] for c in "xy"], axis=1)
            i, w = np.searchsorted(id_, a), t.column("w").to_numpy()
            j = np.minimum(np.searchsorted(id_, b), len(id_) - 1)
            inside = id_[j] == b
            fixed = np.stack([t.column(c).to_numpy(zero_copy_only=False) for c in ("bx", "by")], axis=1)
            v = np.zeros_like(p)
            for _ in range(steps):
                delta = p[i] - np.where(inside[:, None], p[j], fixed)
                f = (w / (1 + (delta * delta).sum(axis=1)))[:, None] * delta
                attract = np.stack([np.bincount(i, f[:, c], len(id_)) for c in (0, 1)], axis=1)
                gradient = 4 * (pull * attract - _repulsion(p, cells)[0] / max(z, 1e-12))
                v = 0.7 * v - rate * gradient
                v *= np.minimum(1, 2 / np.maximum(np.abs(v).max(axis=1, keepdims=True), 1e-12))
                p = p + v
            return pa.table({"id": pa.array(id_, pa.int64()), "x": pa.array(p[:, 0]), "y": pa.array(p[:, 1])})

        other = places.select(F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
        joined = places.withColumn("block", block).join(weighed, F.col("id") == F.col("a")).drop("a").join(other, "b")
        moved = joined.groupBy("block").applyInArrow(lambda t: move(t), "id long, x double, y double")
        kept = places.join(weighed.select(F.col("a").alias("id")).distinct(), "id", "left_anti")
        places = checkpointed(moved.unionByName(kept), "layout", places)
    return places


def trustworthiness(x: np.ndarray, p: np.ndarray, k: int = 10) -> float:
    """How far neighbours in the plane are neighbours of the vectors (1: all), for rows given in full: a measure for samples."""

    def rank(m: np.ndarray) -> np.ndarray:
        d = ((m[:, None] - m[None]) ** 2).sum(axis=2)
        np.fill_diagonal(d, -1)
        return np.argsort(np.argsort(d, axis=1, kind="stable"), axis=1)

    high, low, n = rank(x), rank(p), len(x)
    near = (low >= 1) & (low <= k)
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * float(np.maximum(high - k, 0)[near].sum())
