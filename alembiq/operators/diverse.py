"""Diverse subsets by farthest-first picks over Tanimoto distance: exact, and by composable core-sets in a fixed number of jobs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..session import checkpointed

#: Rows that are looked at together between two passes of the exact picks; rows of a group of the core-sets, about.
POOL_ROWS = 4096
GROUP_ROWS = 100_000


def _distances(f: np.ndarray, n: np.ndarray, one: int) -> np.ndarray:
    """Tanimoto distances of all rows to one of them; 1 where neither has a bit."""
    common = np.bitwise_count(f & f[one]).sum(axis=1, dtype=np.int64)
    union = n + n[one] - common
    return 1 - np.divide(common, union, out=np.zeros(len(f)), where=union > 0)


def farthest_first(f: np.ndarray, n: int) -> list[int]:
    """Positions of ``n`` picks, the first row first; of equally far rows the earlier one."""
    sizes = np.bitwise_count(f).sum(axis=1, dtype=np.int64)
    d = np.full(len(f), 2.0)
    out: list[int] = []
    while len(out) < min(n, len(f)):
        i = int(d.argmax())
        out.append(i)
        d = np.minimum(d, _distances(f, sizes, i))
        d[out] = -1
    return out


def maxmin_pick(df: DataFrame, n: int, id_: str = "id", fp: str = "fp") -> DataFrame:
    """Greedy farthest-first picks by Tanimoto distance, from the smallest id on: id and turn.

    Exact, with lazy bounds. Distances to the nearest pick only fall. So of the POOL_ROWS farthest rows the driver can
    pick on, as greedy picks over the whole table would, while the best of them comes before the last of them
    as it stood, in order of distance and id: no row outside can come first. Then all picks since are taken off all rows' distances in one pass.
    Rows without an id or fingerprint are left out.
    """
    state = df.where(F.col(fp).isNotNull() & F.col(id_).isNotNull()).select(id_, F.col(fp).alias("f"), S.popcount(F.col(fp)).alias("c"), F.lit(2.0).alias("d"))
    picks: list = []
    while len(picks) < n:
        pool = state.where("d >= 0").orderBy(F.col("d").desc(), id_).limit(POOL_ROWS).collect()
        if not pool:
            break
        f = np.array([r["f"] for r in pool], np.int64).reshape(len(pool), -1).view(np.uint64)
        last, place = (pool[-1]["d"] if len(pool) == POOL_ROWS else -1.0), len(pool) - 1
        # In order of ids argmax takes the smallest of equally far rows, also of those that came to be as far as others.
        order = sorted(range(len(pool)), key=lambda i: pool[i][id_])
        pool, f, place, new = [pool[i] for i in order], f[order], order.index(place), []
        sizes, d = np.bitwise_count(f).sum(axis=1, dtype=np.int64), np.array([r["d"] for r in pool])
        while len(picks) + len(new) < n:
            i = int(d.argmax())
            if d[i] < max(last, 0.0) or (d[i] == last and i > place):
                break
            new.append(i)
            d = np.minimum(d, _distances(f, sizes, i))
            d[new] = -1
        picks += [pool[i][id_] for i in new]
        if len(picks) < n:
            state = checkpointed(_nearer(state, [pool[i] for i in new], id_), "maxmin")
    kind = df.schema[id_].dataType.simpleString()
    return df.sparkSession.createDataFrame([(p, i) for i, p in enumerate(picks)], f"{id_} {kind}, turn int")


def _nearer(state: DataFrame, new: list, id_: str) -> DataFrame:
    """``state`` with the distances to the new picks taken in; picks get -1."""
    ids, fs, cs = [r[id_] for r in new], [r["f"] for r in new], [r["c"] for r in new]
    width = len(fs[0])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        other, many = np.array(fs, np.int64).reshape(-1, width).view(np.uint64), np.array(cs, np.int64)
        for b in batches:
            f, c, d = b.column("f").flatten().to_numpy().reshape(-1, width).view(np.uint64), b.column("c").to_numpy(), b.column("d").to_numpy().copy()
            for g, m in zip(other, many):
                common = np.bitwise_count(f & g).sum(axis=1, dtype=np.int64)
                union = c + m - common
                d = np.minimum(d, 1 - np.divide(common, union, out=np.zeros(len(f)), where=union > 0))
            yield b.set_column(b.schema.get_field_index("d"), "d", pa.array(d))

    far = state.mapInArrow(of, state.schema)
    return far.withColumn("d", F.when(F.col(id_).isin(ids), F.lit(-1.0)).otherwise(F.col("d")))


def maxmin_coreset(df: DataFrame, n: int, id_: str = "id", fp: str = "fp", groups: int | None = None) -> DataFrame:
    """``n`` diverse rows by composable core-sets: id and turn. One pass over the table, whatever ``n`` is.

    The rows are dealt by a hash of the id into groups of about GROUP_ROWS; each gives its own ``n`` farthest-first picks, from its smallest id
    on; these are dealt and picked from again, until they fit one group, whose picks are returned. With one level every row lies within four times
    the least radius that any ``n`` centres have (farthest-first alone: two times); each further level adds two. Rows without an id or fingerprint are left out.
    """
    if n * 4 > GROUP_ROWS:
        raise ValueError(f"at most {GROUP_ROWS // 4} picks")
    schema = f"{id_} {df.schema[id_].dataType.simpleString()}, f array<long>, turn int"

    def of(t: pa.Table) -> pa.Table:
        t = t.sort_by(id_)
        f = t.column("f").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1).view(np.uint64)
        at = farthest_first(f, n)
        t = t.select([id_, "f"]).take(at).append_column("turn", pa.array(range(len(at)), pa.int32()))
        return t.set_column(1, "f", t.column("f").cast(pa.list_(pa.int64())))

    rows = df.where(F.col(fp).isNotNull() & F.col(id_).isNotNull()).select(id_, F.col(fp).alias("f"))
    groups = groups or -(-rows.count() // GROUP_ROWS)
    while groups > 1:
        rows = rows.withColumn("g", F.pmod(F.xxhash64(id_, F.lit(groups)), F.lit(groups))).groupBy("g").applyInArrow(lambda t: of(t), schema).select(id_, "f")
        groups = -(-groups * n // GROUP_ROWS)
    return rows.withColumn("g", F.lit(0)).groupBy("g").applyInArrow(of, schema).select(id_, "turn")
