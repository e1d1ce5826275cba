"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints that differ in at most ``RADIUS`` bits are linked. The masks are a covering: bit i gets
a vector of RADIUS + 1 bits, and mask v keeps the bits whose vector has an odd product with v. The
vectors of up to RADIUS differing bits do not span the space, so some v is orthogonal to all of them,
and under its mask the two fingerprints are equal. Hence every pair within the radius collides in
one of the 2^(RADIUS+1) - 1 tables; there is no chance of a miss.

Only distinct fingerprints enter the tables, so exact copies cost nothing. Buckets of up to
``SMALL`` fingerprints are compared inside; a larger bucket is dealt out again by a second covering
of the bits its mask left free, after which at most 16 bits are free, so a bucket holds at most 65,536
fingerprints, and neighbours are found by flipping bits rather than by comparing pairs. Each bucket
returns a spanning forest of its links, never all of them. The forests are joined into components by
alternating large-star and small-star steps on tables in the shared folder.

Defined results: a null text is empty; texts without words have fingerprint 0; a null doc_id ranks
after all others, and its row gets the component of its fingerprint; rows that repeat a doc_id are
kept, each with its own fingerprint; the component is named by its smallest doc_id (null where it has
only null ids); an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, partitions, released, table, text_batches, written

SHINGLE = 3
RADIUS = 3
SEED = 42
#: Fingerprints a bucket may hold before it is dealt out again.
SMALL = 512
#: Shingles hashed into bits at once.
BLOCK = 1 << 16

_LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())


def _shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 of each shingle of ``k`` words (UTF-8; all words where there are fewer)."""
    w = (text or "").encode("utf-8", "surrogatepass").translate(_LOWERED).split()
    if not w:
        return np.empty(0, np.uint64)
    joined = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(w) - k + 1)
    h = xxhash.xxh64_intdigest
    last = ends[min(k, len(w)) - 1 :]
    return np.fromiter((h(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist())), np.uint64, n)


def simhash(text: str | None, k: int = SHINGLE) -> int:
    """The 64-bit fingerprint: a bit is 1 if it is set in over half the shingle hashes."""
    hashes = _shingle_hashes(text, k)
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BLOCK):
        ones += np.unpackbits(hashes[i : i + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((simhash(t.as_py(), k) for t in b.column("text")), np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    text_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(released(of), "doc_id long, fp long")


def covering(bits: list[int], radius: int = RADIUS) -> list[int]:
    """Masks over the given bit positions: any ``radius`` of them are all left out by some mask."""
    n = (1 << (radius + 1)) - 1
    vector = {b: i % n + 1 for i, b in enumerate(bits)}
    return [sum(1 << b for b in bits if (vector[b] & v).bit_count() & 1) for v in range(1, n + 1)]


MASKS = covering(list(range(64)))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _keys(fps: DataFrame, masks: list[int]) -> DataFrame:
    """mask, key, fp: one row for each fingerprint and mask."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)])).alias("k")
    return fps.select("fp", each).select("k.mask", "k.key", "fp")


class _Forest:
    """Union-find over the members 0..n-1 of one bucket; links are the edges of a spanning forest."""

    def __init__(self, n: int):
        self.root, self.links = list(range(n)), []

    def find(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = self.root[self.root[x]]
            x = self.root[x]
        return x

    def join(self, a: int, b: int) -> None:
        x, y = self.find(a), self.find(b)
        if x != y:
            self.root[max(x, y)] = min(x, y)
            self.links.append((a, b))


def bucket_links(fps: np.ndarray, free: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest of the links (pairs within the radius) among distinct fingerprints that agree outside the ``free`` bits.

    Small buckets are compared row by row; larger ones look each fingerprint up with up to ``radius``
    free bits flipped, which takes as many steps as there are flips, whatever the bucket's size.
    """
    fps = np.sort(fps.view(np.uint64))
    forest, n = _Forest(len(fps)), len(fps)
    flips = [0]
    for _ in range(radius):
        flips = sorted({f | 1 << b for f in flips for b in free} | set(flips))
    if n <= max(64, len(flips)):
        for i in range(n - 1):
            for j in (np.nonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= radius)[0] + i + 1).tolist():
                forest.join(i, j)
    else:
        for f in flips[1:]:
            other = fps ^ np.uint64(f)
            at = np.searchsorted(fps, other)
            at[at == n] = 0
            hit = np.nonzero((fps[at] == other) & (at > np.arange(n)))[0]
            for i, j in zip(hit.tolist(), at[hit].tolist()):
                forest.join(i, j)
    view = fps.view(np.int64).tolist()
    return [(view[a], view[b]) for a, b in forest.links]


def _group_runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups of rows that arrive sorted by ``keys``; a group may span batches."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        change = (b[keys].to_numpy()[1:] != b[keys].to_numpy()[:-1]).any(axis=1)
        cuts = [0, *(np.nonzero(change)[0] + 1).tolist(), len(b)]
        for s, e in zip(cuts, cuts[1:]):
            part = b.iloc[s:e]
            if held and (held[-1][keys].iloc[-1].to_numpy() != part[keys].iloc[0].to_numpy()).any():
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(part)
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def _links(buckets: DataFrame, keys: list[str], free_of: list[list[int]], radius: int) -> DataFrame:
    """a, b: the spanning forests of all buckets. ``buckets``: keys, fp; the first key picks the free bits."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple[int, int]] = []
        for g in _group_runs(batches, keys):
            out += bucket_links(g["fp"].to_numpy(np.int64), free_of[int(g[keys[0]].iloc[0])], radius)
            if len(out) > 50_000:
                yield pd.DataFrame(out, columns=["a", "b"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=["a", "b"])

    dealt = buckets.repartition(partitions(buckets.sparkSession), *keys).sortWithinPartitions(*keys)
    return dealt.mapInPandas(released(of), "a long, b long")


def links(fps: DataFrame, radius: int = RADIUS, small: int = SMALL) -> DataFrame:
    """a, b: links enough to connect all distinct fingerprints (column fp) that pairs within the radius connect."""
    masks = covering(list(range(64)), radius)
    free = [[b for b in range(64) if not m >> b & 1] for m in masks]
    keyed = _keys(fps, masks)
    sizes = keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = written(keyed.join(sizes, ["mask", "key"]), "simhash-buckets")
    found = _links(shared.where(F.col("n") <= small).drop("n"), ["mask", "key"], free, radius)
    large = shared.where(F.col("n") > small).select("mask", "fp")
    # Second covering: of the bits each first mask left free, together with the bits it fixed.
    pairs = [(i, m | m2, f) for i, (m, f) in enumerate(zip(masks, free)) for m2 in covering(f, radius)]
    seconds = F.array(*[F.struct(F.lit(j).alias("mask2"), F.lit(i).alias("of"), F.lit(_signed(m)).alias("bits")) for j, (i, m, _) in enumerate(pairs)])
    again = large.withColumn("s", F.explode(F.filter(seconds, lambda s: s["of"] == F.col("mask"))))
    again = again.select(F.col("s.mask2").alias("mask2"), F.col("fp").bitwiseAND(F.col("s.bits")).alias("key"), "fp")
    free2 = [[b for b in range(64) if not m >> b & 1] for _, m, _ in pairs]
    return written(found.unionByName(_links(again, ["mask2", "key"], free2, radius)), "simhash-links")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node it is connected with), by alternating large-star and small-star steps.

    Each step is an aggregation over the edges, written to the shared folder; the number of steps
    grows with the logarithm of the number of nodes. A large-star step links each node's larger
    neighbours to its smallest neighbour, a small-star step the others; a fixed point is a set of stars.
    Minima are combined before the shuffle, and a hub's edges meet their minimum in a merge join that
    AQE can split, so no node's edges must fit one task.
    """

    def step(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        lows = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
        joined = both.join(lows, "a")
        if large:
            return joined.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        return joined.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(lows.select("a", F.col("low").alias("b"))).where("a <> b").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    before = state(e)
    while before[0]:
        for large in (True, False):
            e = written(step(e, large), "components", e)
        now = state(e)
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, k: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable over links)."""
    prints = written(fingerprints(docs, k), "simhash")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-classes")
    roots = components(links(classes.select("fp"), radius))
    of = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    of = written(of, "simhash-roots")
    least = of.groupBy("root").agg(F.min("first").alias("component_id"))
    named = of.join(least, "root").select(F.col("fp").alias("_fp"), "component_id")
    return prints.join(named, prints["fp"] == named["_fp"]).select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame, k: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One document of each component, the one of smallest doc_id, with the columns of ``docs``.

    Rows without a doc_id are kept. Rows that repeat a kept doc_id with the same text are reduced to one.
    """
    dropped = near_duplicates(docs, k, radius).where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_copy")).distinct()
    kept = docs.join(dropped, docs["doc_id"] == dropped["_copy"], "left_anti")
    repeated = written(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_copy")), "simhash-repeated")
    if repeated.isEmpty():
        return kept
    again = docs["doc_id"] == repeated["_copy"]
    return kept.join(repeated, again, "left_anti").unionByName(kept.join(repeated, again, "left_semi").dropDuplicates(["doc_id", "text"]))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
