"""Packed bit sets compared in pairs of blocks.

Rows are dealt by their number of set bits into blocks of at most ROWS rows, and a block is one row of a table. Pairs of
blocks whose numbers of set bits allow the similarity meet in groups of their own; in such a group a few rows at a time are
compared with the whole other block by numpy, so memory is that of two blocks, whatever the number of rows. What is left of the pairs
(counts, or those similar enough) is all that leaves a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpointed

#: Rows of a block at most, pairs of rows that are compared at a time, and tasks that share the pairs of blocks at most.
ROWS, TILE, TASKS = 8192, 1 << 17, 1000
#: Against rounding where a bound is met exactly; what passes is compared exactly.
EPSILON = 1e-9


@dataclass
class Block:
    """Rows in order of their numbers of set bits ``n``: words (word by word), and the values of the other columns."""

    words: np.ndarray
    n: np.ndarray
    table: pa.Table

    def take(self, name: str, at: np.ndarray) -> pa.Array:
        return self.table.column(name).take(pa.array(at))


def _words(f: pa.ListArray) -> np.ndarray:
    """Rows of words of one width; shorter rows end with words of no bits."""
    sizes = np.diff(f.offsets.to_numpy())
    flat, width = f.flatten().to_numpy(zero_copy_only=False).view(np.uint64), int(sizes.max(initial=1))
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.uint64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def packed(rows: DataFrame, most: int = ROWS) -> DataFrame:
    """``rows`` (f, n, other columns) as blocks of at most ``most``: block, lo, hi (least and largest n), and an array of each column; written."""
    parts = max(1, -(-rows.count() // most))
    dealt, columns = rows.repartitionByRange(parts, "n", F.xxhash64("f")), rows.columns
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("block", "lo", "hi")] + [T.StructField(f.name, T.ArrayType(f.dataType)) for f in rows.schema])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, made, own = [], 0, TaskContext.get().partitionId() << 32

        def block(t: pa.Table) -> pa.RecordBatch:
            nonlocal made
            t = t.sort_by("n")
            n, made = t.column("n").to_numpy(), made + 1
            one = [pa.array([v], pa.int64()) for v in (own + made, n[0], n[-1])]
            values = [t.column(c).combine_chunks() for c in columns]
            ends = pa.array([0, len(n)], pa.int32())
            return pa.RecordBatch.from_arrays(one + [pa.ListArray.from_arrays(ends, v.chunk(0) if isinstance(v, pa.ChunkedArray) else v) for v in values], names=["block", "lo", "hi", *columns])

        for b in batches:
            held.append(b)
            while sum(x.num_rows for x in held) >= most:
                t = pa.Table.from_batches(held)
                yield block(t.slice(0, most))
                held = t.slice(most).to_batches()
        if sum(x.num_rows for x in held):
            yield block(pa.Table.from_batches(held))

    return checkpointed(dealt.mapInArrow(pack, schema), "blocks")


def _block(t: pa.Table, at: int, columns: Sequence[str]) -> Block:
    values = {c: t.column(c).combine_chunks() for c in columns}
    values = {c: (v.chunk(0) if isinstance(v, pa.ChunkedArray) else v) for c, v in values.items()}
    values = {c: v.slice(at, 1).flatten() for c, v in values.items()}
    return Block(np.ascontiguousarray(_words(values.pop("f")).T), values["n"].to_numpy(), pa.table(values))


def meet(left: DataFrame, right: DataFrame | None, threshold: float, of: Callable[[Block, Block, bool], pa.Table], schema: str | T.StructType) -> DataFrame:
    """What ``of`` gives of each pair of blocks (packed tables of the same columns) that a Tanimoto similarity of ``threshold`` allows.

    Without ``right`` the blocks of ``left`` meet one another once, and themselves; ``of`` is told of the latter by its last argument.
    """
    other, own = (left, True) if right is None else (right, False)
    columns = [c for c in left.columns if c not in ("block", "lo", "hi")]
    ends = lambda d, p: d.select(F.col("block").alias(p), F.col("lo").alias(f"{p}lo"), F.col("hi").alias(f"{p}hi"))
    t = threshold - EPSILON
    fits = (F.col("ahi") >= F.col("blo") * t) & (F.col("bhi") >= F.col("alo") * t)
    pairs = ends(left, "a").crossJoin(ends(other, "b")).where(fits)
    pairs = checkpointed((pairs.where("a <= b") if own else pairs).select("a", "b"), "block-pairs")
    side = lambda d, c, i: pairs.join(d.withColumnRenamed("block", c), c).select("a", "b", F.lit(i).alias("side"), *columns)
    second = side(other, "b", 1)
    met = side(left, "a", 0).unionByName(second.where("a < b") if own else second)
    tasks = max(1, min(TASKS, pairs.count()))

    def compare(t: pa.Table) -> pa.Table:
        t = t.sort_by("side")
        x = _block(t, 0, columns)
        return of(x, x, True) if t.num_rows == 1 else of(x, _block(t, 1, columns), False)

    return met.repartition(tasks, "a", "b").groupBy("a", "b").applyInArrow(lambda t: compare(t), schema)


def tiles(x: Block, y: Block) -> Iterator[tuple[int, int, np.ndarray]]:
    """From, to, and the common bits of these rows of ``x``, all of one number of set bits, with all rows of ``y``."""
    width, step = min(len(x.words), len(y.words)), max(1, TILE // max(1, len(y.n)))
    starts = [0, *(np.flatnonzero(np.diff(x.n)) + 1).tolist(), len(x.n)]
    for lo, hi in zip(starts, starts[1:]):
        for at in range(lo, hi, step):
            to = min(hi, at + step)
            common = np.bitwise_count(x.words[0, at:to, None] & y.words[0][None])
            if width > 1:
                common = common.astype(np.uint16)
                for w in range(1, width):
                    common += np.bitwise_count(x.words[w, at:to, None] & y.words[w][None])
            yield at, to, common


def _rows(parts: list[dict[str, np.ndarray]], names: Sequence[str]) -> pa.Table:
    return pa.table({c: pa.array(np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.int64), pa.int64()) for c in names})


COUNTS = "c long, lo long, hi long, w long"


def counts(x: Block, y: Block, same: bool) -> pa.Table:
    """How many pairs have so many common bits and numbers of set bits (lo <= hi); a row stands for ``m`` equal ones. Pairs of equal rows are left out."""
    values, place = np.unique(y.n, return_inverse=True)
    width = 64 * max(len(x.words), len(y.words)) + 1
    offsets, mx, my = place * width, x.table.column("m").to_numpy(), y.table.column("m").to_numpy()
    single, parts, total = bool((mx == 1).all() and (my == 1).all()), [], None
    for at, to, common in tiles(x, y):
        code = (common + offsets).ravel()
        found = np.bincount(code, minlength=len(values) * width) if single else np.bincount(code, (mx[at:to, None] * my[None]).ravel(), len(values) * width).astype(np.int64)
        total = found if total is None else total + found
        if to < len(x.n) and x.n[to] == x.n[at]:
            continue
        n, at = int(x.n[at]), np.flatnonzero(x.n == x.n[at])
        if same:
            # Both orders of a pair are there, and each row with itself.
            own = int(np.searchsorted(values, n))
            total[: own * width] = 0
            total[own * width + n] -= int((mx[at] * mx[at]).sum())
            total[own * width : (own + 1) * width] //= 2
        hit = np.flatnonzero(total)
        other, one = values[hit // width], np.full(len(hit), n)
        parts.append({"c": hit % width, "lo": np.minimum(one, other), "hi": np.maximum(one, other), "w": total[hit]})
        total = None
    return _rows(parts, ("c", "lo", "hi", "w"))


def similar(threshold: float) -> Callable[[Block, Block, bool], pa.Table]:
    """x, y (values of the column class) and c, nx, ny of the pairs that may have the Tanimoto similarity; those of a block with itself once."""

    def of(x: Block, y: Block, same: bool) -> pa.Table:
        found = []
        for at, to, common in tiles(x, y):
            n = int(x.n[at])
            least = np.ceil((n + y.n) * (threshold / (1 + threshold)) - EPSILON).astype(common.dtype)
            i, j = np.nonzero(common >= least)
            c = common[i, j].astype(np.int64)
            i = i + at
            keep = i < j if same else slice(None)
            found.append((i[keep], j[keep], c[keep]))
        i, j, c = (np.concatenate([f[k] for f in found]) for k in range(3))
        return pa.table({"x": x.take("class", i), "y": y.take("class", j), "c": pa.array(c), "nx": pa.array(x.n[i]), "ny": pa.array(y.n[j])})

    return of


def _values(metric: str, c: np.ndarray, nx: int, ny: np.ndarray) -> np.ndarray:
    """The kernels of ``functions.similarity`` on a tile."""
    over = {"tanimoto": lambda: nx + ny - c, "dice": lambda: np.broadcast_to(nx + ny, c.shape), "cosine": lambda: np.broadcast_to(np.sqrt(nx * ny), c.shape)}[metric]()
    return np.divide(2 * c if metric == "dice" else c, over, out=np.zeros(c.shape), where=over > 0)


def scores(metric: str, how: str, threshold: float) -> Callable[[Block, Block, bool], pa.Table]:
    """row, id and value: the sum of a row's similarities to the rows of the other block (mean), or the largest where it reaches the threshold (max)."""

    def of(x: Block, y: Block, same: bool) -> pa.Table:
        out = np.zeros(len(x.n))
        for at, to, common in tiles(x, y):
            value = _values(metric, common.astype(np.int64), int(x.n[at]), y.n)
            out[at:to] = value.max(axis=1) if how == "max" else value.sum(axis=1)
        at = np.flatnonzero(out >= threshold) if how == "max" else np.arange(len(out))
        return pa.table({"row": x.take("row", at), "id": x.take("id", at), "value": pa.array(out[at])})

    return of


def _part(b: Block, at: np.ndarray) -> Block:
    return Block(b.words[:, at], b.n[at], b.table.take(pa.array(at)))


def nearest(metric: str, k: int) -> Callable[[Block, Block, bool], pa.Table]:
    """q, id, similarity: of each number of set bits in ``y`` the ``k`` rows (id) most similar to each query (q) that asks for it (its array bits), ties by id, if they reach the query's least."""

    def of(x: Block, y: Block, same: bool) -> pa.Table:
        asked = x.table.column("bits").combine_chunks()
        asked = asked.chunk(0) if isinstance(asked, pa.ChunkedArray) else asked
        by, bits = pc.list_parent_indices(asked).to_numpy(), asked.flatten().to_numpy()
        out = [pa.table({"q": x.take("q", np.zeros(0, int)), "id": y.take("id", np.zeros(0, int)), "similarity": pa.array([], pa.float64())})]
        for b in np.unique(y.n):
            want, rows = np.unique(by[bits == b]).astype(int), np.flatnonzero(y.n == b)
            if not len(want):
                continue
            queries, rows = _part(x, want), rows[pc.sort_indices(y.take("id", rows), null_placement="at_start").to_numpy()]
            held, m = _part(y, rows), len(rows)
            least = queries.table.column("least").to_numpy()
            for at, to, common in tiles(queries, held):
                # Equal numbers of set bits: the order of common bits is that of similarities.
                if m > k:
                    top = np.argpartition(common.astype(np.int64) * m + np.arange(m - 1, -1, -1), m - k, axis=1)[:, m - k :]
                else:
                    top = np.broadcast_to(np.arange(m), common.shape)
                value = _values(metric, np.take_along_axis(common, top, 1).astype(np.int64), int(queries.n[at]), held.n[: top.shape[1]])
                i, j = np.nonzero(value >= least[at:to, None])
                out.append(pa.table({"q": queries.take("q", i + at), "id": held.take("id", top[i, j]), "similarity": pa.array(value[i, j])}))
        return pa.concat_tables(out)

    return of
