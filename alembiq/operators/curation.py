"""Curation of bioactivity measurements: relations, units, confidence, duplicates, outliers, labels."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.scores import confidence, number, pic50, to_nanomolar
from ..session import checkpointed, remove_written
from .running import order_statistics


def filter_relation(df: DataFrame, allowed: Sequence[str] = K.EXACT_RELATIONS, relation: str = "standard_relation") -> DataFrame:
    """Rows whose trimmed relation is allowed; missing relations are not."""
    return df.where(F.trim(F.col(relation).cast("string")).isin(list(allowed)))


def normalize_units(df: DataFrame, value: str = "standard_value", unit: str = "standard_units", target: str = "nM") -> DataFrame:
    """Rows with a numeric value and a known unit, the value in nM and the unit named ``target``."""
    nm = to_nanomolar(number(F.col(value)), F.trim(F.col(unit).cast("string")))
    return df.withColumn(value, nm).withColumn(unit, F.lit(target)).where(F.col(value).isNotNull())


def with_confidence(df: DataFrame, relation: str = "standard_relation", pchembl: str = "pchembl_value", assay: str = "assay_type", unit: str = "standard_units") -> DataFrame:
    have = lambda c: F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")
    return df.withColumn("confidence_score", confidence(have(relation), have(pchembl), have(assay), have(unit)))


def deduplicate(df: DataFrame, key: str, value: str = "standard_value", how: str = "median", order: Sequence[str] = ("source_index",)) -> DataFrame:
    """One row a key: the row of highest confidence (the first in ``order`` among equals), with the aggregated value and n_measurements.

    Null and empty keys are dropped. Partial aggregation keeps one candidate a key and task, so the
    shuffle carries no more than that; the median keeps counts of values, not rows.
    """
    if how not in ("median", "mean"):
        raise ValueError(f"how must be median or mean, not {how!r}")
    rows = df.where(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    score = F.coalesce(F.col("confidence_score").cast("double"), F.lit(0.0)) if "confidence_score" in df.columns else F.lit(0.0)
    rest = [c for c in df.columns if c not in (key, value, "n_measurements")]
    v = number(F.col(value))
    first = F.min_by(F.struct(*[F.col(c) for c in rest]), F.struct((-score).alias("_s"), *[F.col(c) for c in order]))
    best = rows.groupBy(key).agg((F.median(v) if how == "median" else F.avg(v)).alias(value), F.count("*").alias("n_measurements"), first.alias("_best"))
    return best.select(*[F.col(c) if c in (key, value) else F.col(f"_best.{c}").alias(c) for c in df.columns if c != "n_measurements"], "n_measurements")


def outlier_bounds(df: DataFrame, value: str, multiplier: float = K.IQR_MULTIPLIER) -> DataFrame:
    """One row: low and high of the log10 fence; null with fewer than four positive values.

    Quartiles are the values at positions n/4 and 3n/4 (whole divisions) in order. The logarithms are
    written once, and the quartiles found by repeated histograms, so no task collects the column.
    """
    logs = df.select(F.log10(F.when(number(F.col(value)) > 0, number(F.col(value)))).alias("x")).where("x IS NOT NULL")
    logs = checkpointed(logs, "outliers")
    n, low, high = logs.agg(F.count("*").alias("n"), F.min("x"), F.max("x")).first()
    if n < 4:
        return df.sparkSession.createDataFrame([(None, None)], "low double, high double")
    at = (n // 4, 3 * n // 4)
    found = order_statistics(logs.select(F.lit("").alias("g"), "x"), {"": at}, {"": (low, high)})
    q1, q3 = (found["", k] for k in at)
    remove_written(logs)
    spread = multiplier * (q3 - q1)
    return df.sparkSession.createDataFrame([(q1 - spread, q3 + spread)], "low double, high double")


def remove_outliers(df: DataFrame, value: str = "standard_value", multiplier: float = K.IQR_MULTIPLIER) -> DataFrame:
    """Rows whose log10 value lies inside the fence; values that are not positive numbers are dropped. Fewer than four values: all rows."""
    low, high = outlier_bounds(df, value, multiplier).first()
    if low is None:
        return df
    v = number(F.col(value))
    return df.where((v > 0) & F.log10(F.when(v > 0, v)).between(low, high))


def label(df: DataFrame, mode: str = "binary", active: float = K.ACTIVE_NM, inactive: float | None = None, value: str = "standard_value") -> DataFrame:
    """Adds pIC50, activity_class and activity_label. Rows without a number keep nulls.

    binary: 1 below ``active``, else 0; ternary: 1, 0 between the thresholds, -1 from ``inactive`` on.
    """
    inactive = K.INACTIVE_NM if inactive is None and mode == "ternary" else inactive
    if mode not in ("binary", "ternary"):
        raise ValueError(f"mode must be binary or ternary, not {mode!r}")
    if mode == "ternary" and inactive <= active:
        raise ValueError("the inactive threshold must exceed the active one")
    v = number(F.col(value))
    cls = F.when(v < active, 1)
    cls = cls.when(v.isNotNull(), 0) if mode == "binary" else cls.when(v >= inactive, -1).when(v.isNotNull(), 0)
    names = {1: "active", 0: "inactive" if mode == "binary" else "intermediate", -1: "inactive"}
    text: Column = F.when(F.lit(False), F.lit(""))
    for k, name in names.items():
        text = text.when(F.col("activity_class") == k, name)
    return df.withColumn("pIC50", F.round(pic50(v), 4)).withColumn("activity_class", cls.cast("int")).withColumn("activity_label", text)


@dataclass
class Curated:
    """A curated table, and counts of each step, available after an action on it."""

    data: DataFrame
    steps: dict[str, Observation] = field(default_factory=dict)

    def counts(self) -> dict[str, int]:
        return {k: o.get["n"] for k, o in self.steps.items()}


def curate(df: DataFrame, key: str = "smiles", relations: Sequence[str] = K.EXACT_RELATIONS, dedup: bool = True, outliers: bool = False, value: str = "standard_value", order: Sequence[str] = ("source_index",)) -> Curated:
    """relation, units, confidence, then duplicates and outliers if asked for; counts are observed in the same job."""
    steps: dict[str, Observation] = {}

    def watch(name: str, d: DataFrame) -> DataFrame:
        steps[name] = Observation(name)
        return d.observe(steps[name], F.count(F.lit(1)).alias("n"))

    d = watch("relation", filter_relation(watch("input", df), relations))
    d = with_confidence(watch("units", normalize_units(d, value)))
    if dedup:
        d = watch("deduplicated", deduplicate(d, key, value, order=order))
    if outliers:
        d = watch("inliers", remove_outliers(d, value))
    return Curated(d, steps)
