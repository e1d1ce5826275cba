"""Top-k similarity search of many queries over a stored index of fingerprints.

The index is a table of files partitioned by the number of set bits. Of two fingerprints with na and nb of them
the similarity is at most that of nested ones, so a query's answers lie near its own number. Round one reads,
for each query, the partitions with the best bounds that hold k rows together; the similarity of the
k-th of those tells which other partitions can still hold an answer, and round two reads only these. The
result is exact. Partitions that no query wants are pruned when the files are listed.

A partition is no single key: its rows are dealt over blocks, which meet blocks of queries, and only the best k of a query leave a pair of blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import similarity as S
from ..session import checkpointed, work_path
from . import blocks as B

#: Rows of a block of the index or of queries at most; queries and partitions they ask for that are broadcast at most.
BLOCK_ROWS = B.ROWS
BROADCAST_QUERIES = 100


def write_index(df: DataFrame, path: str | None = None, id_: str = "id", fp: str = "fp", words: int | None = None) -> str:
    """Write the fingerprints of ``df`` (rows without one are left out) as an index; returns its path, a new one if none is given."""
    path = path or work_path(df.sparkSession, "fingerprint-index")
    rows = df.where(F.col(fp).isNotNull()).select(F.col(id_).alias("id"), F.col(fp).alias("f"), S.popcount(F.col(fp), words).cast("int").alias("bits"))
    # Small partitions share a task and write a file each; large ones are split.
    rows.hint("rebalance", "bits").write.mode("overwrite").partitionBy("bits").parquet(path)
    return path


class Index:
    """A stored index, and how many rows each of its partitions holds (as many numbers as a fingerprint has bits, at most)."""

    def __init__(self, spark: SparkSession, path: str, words: int | None = None, id_type: str = "long"):
        self.rows, self.words = spark.read.schema(f"id {id_type}, f array<long>, bits int").parquet(path), words
        self.sizes = {r["bits"]: r["w"] for r in self.rows.groupBy("bits").agg(F.count("*").alias("w")).collect()}

    def partitions(self, bits: list[int]) -> DataFrame:
        """The rows of some partitions; the others are not listed."""
        return self.rows.where(F.col("bits").isin(sorted(bits)))

    def _near(self, wanted: DataFrame, metric: str, k: int) -> DataFrame:
        """q, id, similarity of the queries' partitions, of many queries only what may be among the best ``k``. ``wanted``: q, fq, nq, bits, least."""
        found = sorted(r[0] for r in wanted.select("bits").distinct().collect())
        rows = self.partitions(found)
        if wanted.count() <= BROADCAST_QUERIES:
            met = rows.join(F.broadcast(wanted), "bits")
            value = S.METRICS[metric](S.common_bits(F.col("f"), F.col("fq"), self.words), F.col("bits").cast("long"), F.col("nq"))
            return met.withColumn("similarity", value).where(F.col("similarity") >= F.col("least")).select("q", "id", "similarity")
        kinds = {"q": wanted.schema["q"].dataType, "id": self.rows.schema["id"].dataType, "bits": T.ArrayType(T.LongType()), "least": T.DoubleType()}
        none = lambda *names: [F.lit(None).cast(kinds[c]).alias(c) for c in names]
        asked = wanted.groupBy("q").agg(F.first("fq").alias("f"), F.first("nq").cast("long").alias("n"), F.collect_list(F.col("bits").cast("long")).alias("bits"), F.first("least").alias("least"))
        queries = B.packed(asked.select("q", *none("id"), "f", "n", "bits", "least"), BLOCK_ROWS)
        held = B.packed(rows.select(*none("q"), "id", "f", F.col("bits").cast("long").alias("n"), *none("bits", "least")), BLOCK_ROWS)
        of = T.StructType([T.StructField("q", kinds["q"]), T.StructField("id", kinds["id"]), T.StructField("similarity", T.DoubleType())])
        return B.meet(queries, held, 0.0, B.nearest(metric, k), of)

    def search(self, queries: DataFrame, k: int = 10, metric: str = "tanimoto", id_: str = "id", fp: str = "fp") -> DataFrame:
        """q, id, similarity and place (1 to ``k``) of the rows most similar to each query, ties by id. Ids of queries must be distinct.

        Queries without a fingerprint have no answers; a query of an index with fewer than ``k`` rows has as many as there are.
        """
        asked = checkpointed(queries.where(F.col(fp).isNotNull()).select(F.col(id_).alias("q"), F.col(fp).alias("fq"), S.popcount(F.col(fp), self.words).alias("nq")), "search-queries")
        numbers = [r[0] for r in asked.select("nq").distinct().collect()]
        first = F.create_map(*[x for n in numbers for x in (F.lit(n), F.lit(self._enough(n, k, metric)))]) if numbers and self.sizes else None
        if first is None:
            return asked.select("q", F.lit(None).cast(self.rows.schema["id"].dataType).alias("id"), F.lit(0.0).alias("similarity"), F.lit(1).alias("place")).limit(0)
        one = checkpointed(best(self._near(asked.withColumn("bits", F.explode(first[F.col("nq")])).withColumn("least", F.lit(0.0)), metric, k), k), "search-first")
        reached = one.groupBy("q").agg(F.when(F.count("*") >= k, F.min("similarity")).otherwise(0.0).alias("least"))
        every = F.lit(sorted(self.sizes))
        bound = lambda b: S.BOUNDS[metric](b.cast("long"), F.col("nq"))
        left = F.filter(every, lambda b: ~F.array_contains(first[F.col("nq")], b) & (bound(b) >= F.col("least")))
        more = checkpointed(asked.join(reached, "q").withColumn("bits", F.explode(left)), "search-wanted")
        return best(one.drop("place").unionByName(self._near(more, metric, k)), k)

    def _enough(self, n: int, k: int, metric: str) -> list[int]:
        """Partitions in order of the bound for ``n`` set bits, until they hold ``k`` rows."""
        out, held = [], 0
        for b in sorted(self.sizes, key=lambda b: (-_bound(metric, b, n), abs(b - n), b)):
            if held >= k:
                break
            out.append(b)
            held += self.sizes[b]
        return out


def _bound(metric: str, a: int, b: int) -> float:
    lo, hi = min(a, b), max(a, b)
    if not lo:
        return 0.0
    return {"tanimoto": lo / hi, "dice": 2 * lo / (lo + hi), "cosine": (lo / hi) ** 0.5}[metric]


def best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` rows of largest similarity of each q, with their place; each task keeps its own best before rows are dealt by q."""
    place: Column = F.row_number().over(Window.partitionBy("q").orderBy(F.col("similarity").desc(), "id"))
    return found.withColumn("place", place).where(F.col("place") <= k)
