"""Null-aware means, units, potency and score columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def number(c: Column) -> Column:
    """A double, or null where the value is no finite number; NaN counts as missing in every rule."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d), d)


def weighted_mean(weights: Mapping[str, float], inverted: Sequence[str] = (), default: float = 0.0) -> Column:
    """Mean of the columns that are present, by weight; weights of missing ones are left out. ``inverted`` columns enter as 1 - x."""
    value = {c: (1 - F.col(c).cast("double")) if c in inverted else F.col(c).cast("double") for c in weights}
    top = reduce(add, [F.coalesce(value[c] * w, F.lit(0.0)) for c, w in weights.items()])
    bottom = reduce(add, [F.when(value[c].isNotNull(), F.lit(float(w))).otherwise(0.0) for c, w in weights.items()])
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(default))


def mean_present(values: Sequence[Column], default: float) -> Column:
    top = reduce(add, [F.coalesce(v, F.lit(0.0)) for v in values])
    n = reduce(add, [v.isNotNull().cast("int") for v in values])
    return F.when(n > 0, top / n).otherwise(F.lit(default))


def to_nanomolar(value: Column, unit: Column) -> Column:
    """The value in nM; null for units other than M, mM, uM, nM and pM."""
    factor = reduce(lambda w, kv: w.when(unit == kv[0], F.lit(kv[1])), K.NANOMOLAR.items(), F.when(F.lit(False), F.lit(0.0)))
    return value * factor


def pic50(nanomolar: Column) -> Column:
    """9 - log10(nM); 0 for values that are not positive."""
    return F.when(nanomolar <= 0, F.lit(0.0)).when(nanomolar.isNotNull(), 9 - F.log10(F.when(nanomolar > 0, nanomolar)))


def confidence(relation: Column, pchembl: Column, assay_type: Column, unit: Column) -> Column:
    w = K.CONFIDENCE
    parts = [(F.trim(relation) == "=", w["exact"]), (number(pchembl).isNotNull(), w["pchembl"]), (F.trim(assay_type) == "B", w["binding_assay"]), (F.trim(unit) == "nM", w["nanomolar"])]
    return F.round(reduce(add, [F.when(F.coalesce(c, F.lit(False)), F.lit(x)).otherwise(0.0) for c, x in parts]), 2)


def sa_normalized(sa: Column) -> Column:
    """Synthetic accessibility 1 (easy) to 10 (hard), as 1 to 0."""
    low, high = K.SA_RANGE
    return F.when(sa.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(high) - sa) / (high - low))))


def drug_likeness(weights: Mapping[str, float] | None = None) -> Column:
    return weighted_mean(weights or K.DRUG_LIKENESS_WEIGHTS)


def within(ranges: Mapping[str, tuple[float, float]]) -> Column:
    """All columns in their ranges; missing values pass."""
    return reduce(lambda a, b: a & b, [F.coalesce(F.col(c).between(lo, hi), F.lit(True)) for c, (lo, hi) in ranges.items()])
