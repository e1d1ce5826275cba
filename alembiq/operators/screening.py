"""Filters with verdicts, patterns, ranges, ranking and top lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import rules
from ..functions.scores import weighted_mean, within


def filter_rules(df: DataFrame, lipinski: bool = True, veber: bool = False, pains: bool = True, brenk: bool = False, most: int = 1, remove: bool = False) -> DataFrame:
    """``<rule>_pass`` and violation columns; PAINS and Brenk read the alert arrays pains_alerts and brenk_alerts. ``remove`` drops rows that fail any."""
    new: dict[str, Column] = {}
    if lipinski:
        new |= {"lipinski_violation_details": rules.violations(K.LIPINSKI), "lipinski_violations": rules.lipinski_violations(), "lipinski_pass": rules.lipinski(most)}
    if veber:
        new |= {"veber_violation_details": rules.violations(K.VEBER), "veber_pass": rules.veber()}
    for name, on in (("pains", pains), ("brenk", brenk)):
        if on:
            alerts = F.col(f"{name}_alerts") if f"{name}_alerts" in df.columns else F.array().cast("array<string>")
            new |= {f"{name}_pass": F.size(alerts) == 0, f"{name}_violation_details": F.slice(alerts, 1, 1)}
    out = df.withColumns(new)
    passes = [F.col(c) for c in new if c.endswith("_pass")]
    return out.where(reduce(lambda a, b: a & b, passes)) if remove and passes else out


def split_status(df: DataFrame, passed: Column, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows that pass; and the others, with status ``filtered`` and a step added to their provenance."""
    ok = F.coalesce(passed, F.lit(False))
    lost = df.where(~ok).withColumn("status", F.lit("filtered"))
    step = F.lit(f"filter:{name}:fail")
    return df.where(ok), lost.withColumn("provenance", F.array_append(F.coalesce("provenance", F.array().cast("array<string>")), step) if "provenance" in df.columns else F.array(step))


def valid(df: DataFrame) -> DataFrame:
    """Rows with a structure that did not fail; filtered rows are valid."""
    return df.where(F.col("smiles").isNotNull() & (F.coalesce(F.col("status"), F.lit("raw")) != "failed"))


def screen_patterns(df: DataFrame, text: str, patterns: Mapping[str, str], match_all: bool = False, exclude: bool = False) -> DataFrame:
    """Rows whose text matches any (or all) regular expressions, or the others; adds matched names and their share."""
    hit = F.array_compact(F.array(*[F.when(F.col(text).rlike(p), F.lit(n)) for n, p in patterns.items()]))
    out = df.withColumn("matched", hit).withColumn("match_ratio", F.size("matched") / len(patterns))
    found = F.size("matched") == len(patterns) if match_all else F.size("matched") > 0
    return out.where(~found if exclude else found)


def screen_counts(df: DataFrame, counts: Mapping[str, int], match_all: bool = True) -> DataFrame:
    """Rows that reach all (or any) required counts; counts are columns, missing ones 0. Adds the share reached."""
    met = [F.coalesce(F.col(c).cast("long"), F.lit(0)) >= n for c, n in counts.items()]
    out = df.withColumn("pharm_ratio", reduce(lambda a, b: a + b, [m.cast("int") for m in met]) / len(met))
    return out.where(reduce((lambda a, b: a & b) if match_all else (lambda a, b: a | b), met))


def parse_counts(text: str) -> dict[str, int]:
    """"Donor:1,Acceptor" as {"Donor": 1, "Acceptor": 1}."""
    out = {}
    for part in filter(None, (x.strip() for x in text.split(","))):
        name, _, n = part.partition(":")
        if name.strip() not in K.PHARMACOPHORE_FAMILIES:
            raise ValueError(f"unknown feature {name.strip()!r}")
        out[name.strip()] = int(n) if n else 1
    return out


def flag_candidates(df: DataFrame, ranges: Mapping[str, tuple[float, float]] | None = None) -> DataFrame:
    have = {c: r for c, r in (ranges or K.CANDIDATE_RANGES).items() if c in df.columns}
    return df.withColumn("is_candidate", within(have) if have else F.lit(True))


def min_max(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """The column scaled to 0..1 (0.5 where it is constant). Bounds come from an aggregate of one row, so nothing is gathered in one task."""
    bounds = df.agg(F.min(column).alias("_low"), F.max(column).alias("_high"))
    scaled = F.when(F.col("_high") > F.col("_low"), (F.col(column) - F.col("_low")) / (F.col("_high") - F.col("_low"))).when(F.col(column).isNotNull(), 0.5)
    return df.crossJoin(F.broadcast(bounds)).withColumn(out or f"{column}_norm", scaled).drop("_low", "_high")


def composite(df: DataFrame, weights: Mapping[str, float] | None = None, normalize: str | None = None) -> DataFrame:
    """composite_score: the mean of the components present, by weight; ``normalize`` names one to be scaled to 0..1 first."""
    weights = dict(weights or K.COMPOSITE_WEIGHTS)
    if normalize and normalize in weights:
        df = min_max(df, normalize)
        weights[f"{normalize}_norm"] = weights.pop(normalize)
    have = {c: w for c, w in weights.items() if c in df.columns}
    return df.withColumn("composite_score", weighted_mean(have) if have else F.lit(0.0))


def rank(df: DataFrame, score: str = "composite_score", tie: Sequence[str] = ("source_index",), ascending: bool = False) -> DataFrame:
    """Rows with a score, and distinct ranks from 1.

    Ranks are made without gathering the table: rows are sorted into ranges, numbered in each, and the
    sizes of the ranges before are added.
    """
    order = [F.col(score).asc() if ascending else F.col(score).desc(), *[F.col(t).asc() for t in tie]]
    spark = df.sparkSession
    from ..session import checkpointed

    ranged = df.where(F.col(score).isNotNull()).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    placed = checkpointed(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "rank")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("n"), F.min("_at").alias("first"))
    before = sizes.select("_part", "first", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("before"))  # one row a partition
    return placed.join(F.broadcast(before), "_part").withColumn("rank", F.col("_at") - F.col("first") + F.col("before") + 1).drop("_part", "_at", "first", "before")


def top(df: DataFrame, n: int, score: str = "composite_score", tie: Sequence[str] = ("source_index",), ascending: bool = False) -> DataFrame:
    """The first ``n`` of ``rank``, by a top-n that keeps n rows a task; the window then numbers n rows."""
    order = [F.col(score).asc() if ascending else F.col(score).desc(), *[F.col(t).asc() for t in tie]]
    first = df.where(F.col(score).isNotNull()).orderBy(*order).limit(n)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def candidate_order(df: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """Sum of weights times columns, missing ones 0, without renormalising; highest first."""
    total = reduce(lambda a, b: a + b, [w * F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c, w in weights.items()])
    return df.withColumn("composite", total).orderBy(F.col("composite").desc())
