"""Mixing sources to target weights by hash-threshold histograms.

Every source gets a word budget; which of its documents are taken is decided by a hash of ``doc_id``
and text alone. A histogram of words by source and leading hash bits finds the bucket in which the budget
runs out; only that bucket is histogrammed again by the next bits, until it holds one document.
What is left is one hash threshold a source, and taking documents is a filter: nothing is sorted,
and each pass after the first touches one bucket in 4096.

Defined results: null or blank texts have size 0 and take no words; a null source is a source of its
own, last in order; a null doc_id counts as empty; rows equal in doc_id and text share a hash, and where
the budget runs out among them, as many of them are taken as it has room for (they are alike, so reruns
agree); an empty table gives an empty result. Further columns of the input are kept, whatever their names.
The sources themselves are ranked in one task: one row for each of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, words, written

#: Bits of the document hash, and how many of them each histogram resolves.
HASH_BITS = 60
LEVEL_BITS = 12


def doc_hash() -> Column:
    named = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def hashed_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words) and h, a 60-bit hash of doc_id and text."""
    return docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), doc_hash().alias("h"))


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """One row a source: source, source_size, target. The share of all words goes to sources by weight; no target exceeds ``most`` times its source.

    With sources in the order of their cap per weight, the level at which the rest can be shared by
    weight without reaching a cap is found in one pass; it is the fixed point of repeated resharing.
    The windows run over one row a source.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), turn + 1)
    capped = sources.withColumn("weight", weight.cast("long")).withColumn("cap", F.lit(int(most)) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    levels = capped.withColumn("level", left / F.sum("weight").over(after)).withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    level = F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(everything)["level"]
    target = F.least(F.col("cap").cast("double"), F.coalesce(level, F.lit(float("inf"))) * F.col("weight"))
    return levels.withColumn("target", target).select("source", "source_size", "target")


def _boundaries(sizes: DataFrame, needs: DataFrame, level: int) -> DataFrame:
    """needs: source, need, prefix (hash bits fixed so far). The bucket, one level deeper, in which each need runs out."""
    shift = HASH_BITS - LEVEL_BITS * level
    rows = sizes.join(needs, sizes["source"].eqNullSafe(needs["source"])).where(F.shiftright("h", shift) == F.col("prefix"))
    bucket = F.shiftright(F.col("h"), shift - LEVEL_BITS).alias("bucket")
    histogram = rows.groupBy(sizes["source"].alias("source"), "need", bucket).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    upto = Window.partitionBy("source").orderBy("bucket")
    runs_out = histogram.withColumn("upto", F.sum("words").over(upto)).where(F.col("upto") > F.col("need"))
    first = runs_out.groupBy("source").agg(F.min(F.struct("bucket", "upto", "words", "n", "need")).alias("b"))
    return first.select("source", (F.col("b.need") - (F.col("b.upto") - F.col("b.words"))).alias("need"), F.col("b.bucket").alias("prefix"), F.col("b.n").alias("n"), F.col("b.words").alias("words"))


def thresholds(sizes: DataFrame, targets: DataFrame, most: int = 2) -> DataFrame:
    """One row a source: source, source_size, target, copies (whole), threshold (documents below it are taken once more), extra (as many that are at it, too)."""
    copies = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long")
    whole = written(targets.withColumn("copies", copies), "mix-targets")
    rest = F.col("target") - F.col("copies") * F.col("source_size")
    needs = whole.where((F.col("copies") < most) & (rest > 0)).select("source", rest.alias("need"), F.lit(0).cast("long").alias("prefix"))
    done = None
    for level in range(HASH_BITS // LEVEL_BITS):
        found = written(_boundaries(sizes, needs, level), "mix-boundaries")
        shift = HASH_BITS - LEVEL_BITS * (level + 1)
        last = shift == 0
        room = F.when(F.lit(last) & (F.col("words") > 0), F.floor(F.col("need") * F.col("n") / F.col("words"))).otherwise(0).cast("long")
        ended = found.where(F.lit(last) | (F.col("n") == 1)).select("source", F.shiftleft("prefix", shift).alias("threshold"), room.alias("extra"))
        done = ended if done is None else done.unionByName(ended)
        needs = found.where(F.col("n") > 1).drop("n", "words")
        if last or needs.isEmpty():
            break
    at = done.withColumnRenamed("source", "at_source")
    joined = whole.join(at, whole["source"].eqNullSafe(at["at_source"]), "left").drop("at_source")
    return joined.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("threshold", "extra")})


def _copied(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (source, size, h and others) with source_size, target and copies, the times the mix takes a row; ``plan`` as of ``thresholds``."""
    plan = plan.withColumnRenamed("source", "plan_source")
    joined = rows.join(plan, rows["source"].eqNullSafe(plan["plan_source"])).drop("plan_source")
    below = F.col("copies") + (F.col("h") < F.col("threshold")).cast("long")
    tied = (F.col("extra") > 0) & (F.col("h") == F.col("threshold"))
    if plan.where("extra > 0").isEmpty():
        return joined.withColumn("copies", below).drop("threshold", "extra")
    # Rows alike in doc_id and text at a source's threshold: the first of them are taken, whichever these are.
    place = F.row_number().over(Window.partitionBy("source", "h").orderBy("size"))
    some = joined.where(tied).withColumn("copies", F.col("copies") + (place <= F.col("extra")).cast("long"))
    return joined.where(~tied).withColumn("copies", below).unionByName(some).drop("threshold", "extra")


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (times the mix takes the document), taken (words)."""
    sizes = written(hashed_sizes(docs), "mix-sizes")
    plan = written(thresholds(sizes, source_targets(sizes, weights, share, most), most), "mix-plan")
    found = _copied(sizes, plan)
    return found.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it is taken, with the columns of ``docs``."""
    sizes = written(hashed_sizes(docs), "mix-sizes")
    rows = docs.select("source", F.lit(0).alias("size"), doc_hash().alias("h"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    plan = written(thresholds(sizes, source_targets(sizes, weights, share, most), most), "mix-plan")
    found = _copied(rows, plan)
    return found.where("copies > 0").withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM d GROUP BY source
), l AS (
  SELECT *, 2 * source_size AS cap,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s
), t AS (
  SELECT source, source_size,
         least(cap::DOUBLE, weight * (SELECT min_by(level, cap / weight) FROM l WHERE level * weight <= cap)) AS target
  FROM l
), c AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(2, floor(target / source_size)) ELSE 0 END::BIGINT AS copies FROM t
), r AS (
  SELECT d.doc_id, d.size, c.source_size, c.target, c.copies, c.target - c.copies * c.source_size AS need,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (copies + CASE WHEN need > 0 AND copies < 2 AND upto <= need THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""
