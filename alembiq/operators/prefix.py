"""Similarity join of bit sets through an inverted index of their rarest bits.

Bits are ranked from the rarest to the most frequent. Two sets of sizes nx >= ny reach a Tanimoto similarity t
only if they share o = ceil((nx + ny) t / (1 + t)) bits, so the nx - ceil(t nx) + 1 rarest bits of the larger and the
ny - ceil(2 t ny / (1 + t)) + 1 rarest of the smaller have one in common: those prefixes are all that is indexed.
A pair is taken at its first common bit only, hence once, without a distinct. Where all pairs must share several bits, the first two or three of them
together can be the key (prefixes are then one or two bits longer): far fewer rows meet, for more entries a row; the number
is chosen by the bits' frequencies. What the places of the key's last bit leave possible, and what the counts of set bits in GROUPS ranges of ranks leave possible, bounds the overlap from
above; only pairs that pass both bounds are candidates, whose bits are fetched and compared.

A key's list is no single key of a shuffle: lists of over LIST_ROWS rows are compared in pairs of blocks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..session import checkpointed

#: Rows of a block of a bit's list, about.
LIST_ROWS = 4096
#: Ranges of ranks whose set bits are counted.
GROUPS = 16
#: Bits of a key at most, keys of a row at most, and what an entry costs, in meetings.
KEY_BITS, ENTRIES, ENTRY = 3, 100, 4
#: Against rounding up where a product is whole but for its last digit.
EPSILON = 1e-9


def _ceil(x: Column) -> Column:
    return F.ceil(x - EPSILON)


def _least_overlap(nx: Column, ny: Column, t: float) -> Column:
    return _ceil((nx + ny) * (t / (1 + t)))


def size_pairs(classes: DataFrame, threshold: float) -> int:
    """Pairs of rows whose numbers of set bits (column n) allow the similarity; one row a number reaches the driver."""
    sizes = sorted((r["n"], r["w"]) for r in classes.groupBy("n").agg(F.count("*").alias("w")).collect())
    return sum(w * (w - 1) // 2 + w * sum(v for m, v in sizes if m < n and m >= threshold * n - EPSILON) for n, w in sizes)


def _key_bits(sizes: dict[int, int], seen: dict[int, int], t: float) -> int:
    """Bits of a key: the number with the least work, were bits independent, among those that all pairs share in any case."""
    total = sum(sizes.values())
    if not total:
        return 1
    shared = [1.0] + [0.0] * KEY_BITS  # expected keys of so many bits that two rows share
    for w in seen.values():
        for k in range(KEY_BITS, 0, -1):
            shared[k] += shared[k - 1] * (w / total) ** 2
    work = {}
    for k in range(1, max(1, min(KEY_BITS, math.ceil(min(sizes) * (2 * t / (1 + t)) - EPSILON))) + 1):
        keys = {n: math.comb(min(n, n - math.ceil(n * t - EPSILON) + k), k) for n in sizes}
        if k == 1 or max(keys.values()) <= ENTRIES:
            work[k] = total * total * shared[k] / 2 + ENTRY * sum(w * keys[n] for n, w in sizes.items())
    return min(work, key=work.get)


class Prefixes:
    """The indexed prefixes of ``classes`` (class, f, n; n > 0): ranked bits, the lists' lengths of keys (ranks of ``width`` bits), and candidates."""

    def __init__(self, classes: DataFrame, threshold: float, words: int | None = None):
        self.threshold = threshold
        bits = classes.select(F.explode(S.set_bits(F.col("f"), words)).alias("bit"))
        # As many rows as a fingerprint has bits, at most.
        seen = {r["bit"]: r["w"] for r in bits.groupBy("bit").agg(F.count("*").alias("w")).collect()}
        order = sorted(seen, key=lambda b: (seen[b], b))
        rank = [0] * (max(order, default=0) + 1)
        for i, b in enumerate(order):
            rank[b] = i
        total, upto, cuts = sum(seen.values()), 0, [0]
        for i, b in enumerate(order):
            upto += seen[b]
            if upto >= total * len(cuts) / GROUPS and i + 1 < len(order):
                cuts.append(i + 1)
        places = F.lit(rank)
        ranked = F.array_sort(F.transform(S.set_bits(F.col("f"), words), lambda b: F.get(places, b)))
        inside = lambda lo, hi: F.size(F.filter("ranks", lambda r: (r >= lo) & (r < hi)))
        mass = F.array(*[inside(lo, hi) for lo, hi in zip(cuts, [*cuts[1:], len(rank)])])
        n, t = F.col("n"), threshold
        # One row a number of set bits reaches the driver.
        sizes = {r["n"]: r["w"] for r in classes.groupBy("n").agg(F.count("*").alias("w")).collect()}
        self.width, self.ranks = _key_bits(sizes, seen, t), max(len(rank), 1)
        probed, indexed = (n - _ceil(n * t) + self.width).cast("int"), (n - _ceil(n * (2 * t / (1 + t))) + self.width).cast("int")
        rows = classes.select("class", "n", ranked.alias("ranks")).select("class", "n", F.slice("ranks", F.lit(1), probed).alias("prefix"), indexed.alias("indexed"), mass.alias("mass"))
        # A row becomes many, so few rows are spread too.
        self.rows = checkpointed(rows.repartition(2 * classes.sparkSession.sparkContext.defaultParallelism), "prefixes")
        listed = self.rows.select("indexed", F.inline(self._keys("prefix")))
        self.lists = checkpointed(listed.groupBy("bit").agg(F.count("*").alias("probes"), F.count_if(F.col("at") < F.col("indexed")).alias("entries")), "prefix-lists")

    def _keys(self, prefix: str) -> Column:
        """at, bit: the keys of a prefix (``width`` of its ranks, read as one number) with the place of their last bit."""
        one = lambda at, bit: F.struct(at.cast("int").alias("at"), bit.cast("long").alias("bit"))
        keys = F.transform(prefix, lambda r, i: one(i, r))
        for _ in range(self.width - 1):
            rest = lambda s: F.slice(F.col(prefix), s["at"] + 2, F.greatest(F.size(prefix) - s["at"] - 1, F.lit(0)))
            keys = F.flatten(F.transform(keys, lambda s: F.transform(rest(s), lambda r, i: one(s["at"] + 1 + i, s["bit"] * self.ranks + r))))
        return keys

    def meetings(self) -> int:
        """Rows that meet in the lists."""
        return self.lists.agg(F.coalesce(F.sum(F.col("probes") * F.col("entries")), F.lit(0))).first()[0]

    def candidates(self) -> DataFrame:
        """x, y: pairs of classes, x the larger set, that no bound rules out; every pair of the similarity is among them."""
        t = self.threshold
        blocks = lambda c: F.ceil(F.col(c) / LIST_ROWS).cast("int")
        # Only lists of several blocks, of which there are at most as many as entries by LIST_ROWS, are looked up.
        long = F.broadcast(self.lists.where(F.greatest("probes", "entries") > LIST_ROWS).select("bit", F.greatest(F.lit(1), blocks("probes")).alias("ps"), F.greatest(F.lit(1), blocks("entries")).alias("qs")))
        dealt = lambda d: d.join(long, "bit", "left").fillna(1, ["ps", "qs"])
        own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = self.rows.select(F.col("class").alias("x"), F.col("n").alias("nx"), F.col("prefix").alias("px"), F.col("mass").alias("mx"))
        left = dealt(left.select("*", F.inline(self._keys("px")))).withColumnRenamed("at", "i").withColumn("p", own("x", "ps")).withColumn("q", every("qs")).drop("ps", "qs")
        right = self.rows.select(F.col("class").alias("y"), F.col("n").alias("ny"), F.slice("prefix", F.lit(1), F.col("indexed")).alias("py"), F.col("mass").alias("my"))
        right = dealt(right.select("*", F.inline(self._keys("py")))).withColumnRenamed("at", "j").withColumn("q", own("y", "qs")).withColumn("p", every("ps")).drop("ps", "qs")
        met = left.join(right, ["bit", "p", "q"])
        once = (F.col("nx") > F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") > F.col("y")))
        least = _least_overlap(F.col("nx"), F.col("ny"), t)
        upto = self.width + F.least(F.col("nx") - F.col("i"), F.col("ny") - F.col("j")) - 1
        before = F.slice("px", F.lit(1), F.col("i")), F.slice("py", F.lit(1), F.col("j"))
        first = ~F.arrays_overlap(*before) if self.width == 1 else F.size(F.array_intersect(*before)) == self.width - 1
        common = F.aggregate(F.zip_with("mx", "my", lambda a, b: F.least(a, b)), F.lit(0), lambda s, v: s + v)
        fits = (F.col("ny") >= F.col("nx") * t - EPSILON) & (upto >= least)
        return met.where(once & fits).where((common >= least) & first).select("x", "y")


def similar(classes: DataFrame, candidates: DataFrame, threshold: float, words: int | None = None) -> DataFrame:
    """a < b and similarity of the candidates that reach the threshold."""
    side = lambda c: classes.select(F.col("class").alias(c), F.col("f").alias(f"f{c}"), F.col("n").alias(f"n{c}"))
    met = candidates.join(side("x"), "x").join(side("y"), "y")
    value = S.tanimoto(S.common_bits(F.col("fx"), F.col("fy"), words), F.col("nx"), F.col("ny"))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), value.alias("similarity")).where(F.col("similarity") >= threshold)


